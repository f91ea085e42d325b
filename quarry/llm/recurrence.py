"""Which content-chosen keys recur over documents dealt to chunks of a bounded size, and how the text that has them meets.

Documents go to chunks by a hash of identifier and text; a chunk names its keys (64-bit hashes whose lowest bit tells that the
key recurs in the chunk itself); equal keys of all chunks meet in buckets by their highest bits; each chunk learns which of its
own keys recur, and which of them are hot: named by more than HOT chunks. Then a chunk sends the runs of text that have such a
key, equal ones once, to the key's bucket. A hot key is split by a second one, chosen from the same text by another hash, so that
equal windows still meet but what only shares the first key does not. Every key and every distinct run travels once a chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed

_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: A key that more chunks name is split.
HOT = 64
FIELDS = ("body", "size", "ids", "rows", "starts", "segment")


def chunked(docs: DataFrame, id: str, text: str, chunks: int) -> DataFrame:
    """(chunk, id, text)."""
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return own.select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "id", "text")


def gram_hashes(x: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each n neighbours of x (64-bit values), by doubling."""
    out, at, have, level, x = None, 0, 1, 0, mixed(x ^ np.uint64(salt)) if salt else x
    while True:
        if n & have:
            out = x if out is None else out[: len(x) - at] * np.uint64(_STEP[5]) + x[at : at + len(out)] if len(x) > at else out[:0]
            at += have
        if have * 2 > n:
            return mixed(out[: max(0, len(out))])
        x = x[: max(0, len(x) - have)] * np.uint64(_STEP[level % 5]) + x[have:]
        have, level = have * 2, level + 1


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each of x is in the ordered array."""
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the highest 32 bits: ordered keys have ordered buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def edges(x: np.ndarray) -> np.ndarray:
    """Where another value begins in x."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)


def by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ordered keys."""
    own = bucket_of(keys, buckets)
    edge = edges(own)
    return [(int(own[a]), int(a), int(b)) for a, b in zip(edge, np.r_[edge[1:], len(own)].astype(int))]


def _meet(table, hot: int):
    """Of one bucket: for each chunk, those of its keys that recur; their lowest bit then tells which are hot."""
    import pyarrow as pa

    chunks, blobs = table.column("chunk").to_pylist(), [np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()]
    every, count = np.unique(np.concatenate(blobs) >> np.uint64(1), return_counts=True)
    twice, many = every[count > 1], every[count > hot]
    kept = [(c, x[(x & np.uint64(1)).astype(bool) | member(x >> np.uint64(1), twice)]) for c, x in zip(chunks, blobs)]
    kept = [(c, (x & ~np.uint64(1)) | member(x >> np.uint64(1), many).astype(np.uint64)) for c, x in kept if len(x)]
    return pa.table({"chunk": pa.array([c for c, _ in kept], pa.int32()), "keys": pa.array([x.tobytes() for _, x in kept], pa.binary())})


def recurring(chunks: DataFrame, keys_of: Callable, buckets: int, hot: int = HOT) -> DataFrame:
    """(chunk, keys): the keys of a chunk that occur in other chunks too, or are marked. keys_of(table): ordered distinct keys."""

    def name(table):
        import pyarrow as pa

        keys = keys_of(table)
        parts = by_bucket(keys, buckets)
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([p[0] for p in parts], pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int32()), "keys": pa.array([keys[a:b].tobytes() for _, a, b in parts], pa.binary())})

    named = chunks.groupBy("chunk").applyInArrow(name, "bucket int, chunk int, keys binary")
    return named.groupBy("bucket").applyInArrow(lambda t: _meet(t, hot), "chunk int, keys binary")


class Runs(NamedTuple):
    """Runs of windows that share a key: key, row, identifier and start of each, in whatever unit; its bytes from begin to end of body."""

    key: np.ndarray
    row: np.ndarray
    id: np.ndarray
    start: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    body: np.ndarray


def chosen(first: np.ndarray, ok: np.ndarray, keys: np.ndarray, second: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(key of each window, whether it is sent): first is its first key; hot ones are joined with second(), made only if there are any."""
    own = keys & ~np.uint64(1)
    ok = ok & member(first, own)
    hot = ok & member(first, own[(keys & np.uint64(1)).astype(bool)])
    return (np.where(hot, mixed(first ^ second()) & ~np.uint64(1), first) if hot.any() else first), ok


def spans(key: np.ndarray, row: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run: neighbours of one key and row that are ok."""
    if not ok.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]]
    return np.flatnonzero(new & ok), np.flatnonzero(np.r_[new[1:] | ~ok[1:], True] & ok)


def met(chunks: DataFrame, keys: DataFrame, runs_of: Callable, buckets: int) -> DataFrame:
    """(bucket, chunk, FIELDS): the distinct runs of a chunk by bucket, and the places of each. runs_of(table, ordered keys): Runs."""

    def segments(left, right):
        import pyarrow as pa

        out = {k: [] for k in ("bucket", "chunk", *FIELDS)}
        if left.num_rows and right.num_rows:
            r = runs_of(left, np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in right.column("keys").to_pylist()])))
            order = np.argsort(bucket_of(r.key, buckets), kind="stable")
            own = bucket_of(r.key, buckets)[order]
            cuts, body = edges(own), r.body.tobytes()
            for f, t in zip(cuts, np.r_[cuts[1:], len(own)].astype(int)):
                of = order[f:t]
                where: dict[bytes, int] = {}
                number = [where.setdefault(body[a:b], len(where)) for a, b in zip(r.begin[of].tolist(), r.end[of].tolist())]
                out["bucket"].append(int(own[f]))
                out["body"].append(b"".join(where))
                out["size"].append(np.fromiter(map(len, where), dtype=np.uint32).tobytes())
                out["ids"].append(r.id[of].tobytes())
                out["rows"].append(r.row[of].astype(np.uint32).tobytes())
                out["starts"].append(r.start[of].astype(np.uint32).tobytes())
                out["segment"].append(np.array(number, dtype=np.uint32).tobytes())
            out["chunk"] = [left.column("chunk")[0].as_py()] * len(out["bucket"])
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((k, pa.binary()) for k in FIELDS)]))

    return chunks.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(segments, "bucket int, chunk int, " + ", ".join(f"{k} binary" for k in FIELDS))


class Places(NamedTuple):
    """What one chunk sent to a bucket: of each run its row, start, identifier and the number of its text."""

    chunk: int
    row: np.ndarray
    start: np.ndarray
    id: np.ndarray
    of: np.ndarray


def opened(table) -> tuple[list[bytes], list[Places]]:
    """(distinct texts of one bucket's runs, their places by chunk)."""
    where: dict[bytes, int] = {}
    places = []
    for chunk, body, size, ids, rows, starts, of in zip(*(table.column(c).to_pylist() for c in ("chunk", *FIELDS))):
        size, ids = np.frombuffer(size, dtype=np.uint32).astype(np.int64), np.frombuffer(ids, dtype=np.int64)
        rows, starts, of = (np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in (rows, starts, of))
        ends = np.cumsum(size)
        number = np.array([where.setdefault(body[a:b], len(where)) for a, b in zip((ends - size).tolist(), ends.tolist())], dtype=np.int64)
        places.append(Places(chunk, rows, starts, ids, number[of]))
    return list(where), places


def expanded(of: np.ndarray, lower: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) for every place and every finding of its text: those of text k are lower[k] and the count[k] - 1 after it."""
    n = count[of]
    return np.repeat(np.arange(len(of)), n), np.repeat(lower[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def answered(found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
    """An Arrow table (chunk, rows, first, last) of the windows that go."""
    import pyarrow as pa

    found = [x for x in found if len(x[1])]
    cols = {k: pa.array([x[n].astype(np.uint32).tobytes() for x in found], pa.binary()) for n, k in enumerate(("rows", "first", "last"), 1)}
    return pa.table({"chunk": pa.array([x[0] for x in found], pa.int32()), **cols})


ANSWER = "chunk int, rows binary, first binary, last binary"


def marked(answers, begin: np.ndarray, total: int, window: int) -> np.ndarray:
    """Which units of a chunk its answers remove; begin: the first unit of each row."""
    marks = np.zeros(total + 1, dtype=np.int32)
    for rows, first, last in zip(*(answers.column(k).to_pylist() for k in ("rows", "first", "last"))):
        at = begin[np.frombuffer(rows, dtype=np.uint32)]
        np.add.at(marks, at + np.frombuffer(first, dtype=np.uint32), 1)
        np.add.at(marks, at + np.frombuffer(last, dtype=np.uint32) + window, -1)
    return np.cumsum(marks)[:-1] > 0
