"""Suffix-array dedup by bucket-pointer refinement.

A window is a string of so many bytes of one document. Its anchor is the smallest hash of the q-grams in it, so equal windows
have equal anchors, and a document falls into runs of windows of one anchor. Runs whose anchor recurs meet by their anchor, equal
ones merged, in buckets; an anchor that many chunks hold is split by a second one. The suffixes of a bucket's text are sorted at
least to the depth of a window: buckets of equal 8-grams first, then one block of buckets after the other is refined to the end
by sorting on the bucket pointers at the offset that is known to be equal. Pointers are updated at once, so that a bucket refined
later compares as many bytes in one step as the buckets it points to are deep. Suffixes that begin with equal windows are
neighbours then; all but the earliest go.

Defined results: texts are UTF-8 bytes (null: empty); matches never cross documents; a byte goes if a window that covers it
also starts earlier (smaller identifier, or same document and earlier start), judged on the input; rows with the same
identifier are different documents of equal rank, so that equal starts in them do not count as earlier; a null identifier
comes after all others; a very long text is whole in its chunk's task, and its runs go to many buckets; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import mixed, packed, pieces, sliding_minimum, text_bytes
from .recurrence import ANSWER, HOT, Runs, answered, chosen, chunked, edges, expanded, gram_hashes, marked, met, opened, recurring, spans

_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_SECOND = 0x5851F42D4C957F2D
#: Suffixes that are refined together.
_BLOCK = 1 << 16


class _Chunk:
    def __init__(self, table, window: int, gram: int):
        self.table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids, self.body, self.begin = packed(self.table, "id", "text")
        self.window, self.gram = window, gram
        row, n = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.begin)), max(0, len(self.body) - window + 1)
        self.row, self.ok = row[:n], row[:n] == row[len(row) - n :]  # of the window that begins at each byte

    def minima(self, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(q-gram hashes, the smallest in the window that begins at each byte)."""
        if not len(self.row):
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        grams = gram_hashes(_BYTE[self.body], self.gram, salt)
        return grams, sliding_minimum(grams, self.window - self.gram + 1)

    def named(self) -> np.ndarray:
        """Anchors; the lowest bit is set if one stands at two places."""
        grams, low = self.minima()
        if not self.ok.any():
            return np.zeros(0, dtype=np.uint64)
        span = self.window - self.gram + 1
        padded = np.r_[np.zeros(span - 1, dtype=np.uint64), np.where(self.ok, low, np.uint64(0)), np.zeros(span - 1, dtype=np.uint64)]
        high = ~sliding_minimum(~padded, span)  # of the windows that hold the q-gram
        x = np.sort(mixed(grams[high[: len(grams)] == grams]) & ~np.uint64(1))  # minima are small numbers: mixed, they fill all buckets alike
        edge = edges(x)
        return x[edge] | (np.diff(np.r_[edge, len(x)]) > 1).astype(np.uint64)

    def runs(self, keys: np.ndarray) -> Runs:
        key, ok = chosen(mixed(self.minima()[1]) & ~np.uint64(1), self.ok, keys, lambda: mixed(self.minima(_SECOND)[1]))
        a, b = spans(key, self.row, ok)
        row = self.row[a]
        return Runs(key[a], row, self.ids[row], a - self.begin[row], a, b + self.window, self.body)


def refine(text: np.ndarray, depth: int, q: int = 8, block: int = _BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket-pointer refinement: (suffixes in order, the bucket pointer of each place of text, 8-grams). Suffixes with one pointer share at least depth bytes, or are one.

    A pointer is the place of the bucket's first suffix in the order; have[p] tells how many bytes the suffixes of p's bucket
    are known to share. Beyond the text all suffixes are one that comes first."""
    n = len(text)
    body = np.r_[text, np.zeros(q, dtype=np.uint8)]
    grams = np.ndarray((n,), dtype=">u8", buffer=body, strides=(1,)).astype(np.uint64) if n else np.zeros(0, dtype=np.uint64)
    pointer, have = np.full(n + depth, -1, dtype=np.int64), np.full(n + depth, depth, dtype=np.int16)
    order = np.argsort(grams)
    edge = edges(grams[order])
    size = np.diff(np.r_[edge, n])
    pointer[order] = np.repeat(edge, size)
    have[:n] = q
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    own = np.repeat(edge, size)[open_]
    cuts = edges(own)  # buckets, dealt to blocks in their order
    cuts = cuts[np.flatnonzero(np.diff(np.r_[-1, cuts // block]))] if len(cuts) else cuts
    for f, t in zip(cuts, np.r_[cuts[1:], len(open_)].astype(int)):
        live = open_[f:t]
        while len(live):
            at = order[live]
            to = at + have[at]
            key, deep = (pointer[at].astype(np.uint64) << np.uint64(32)) | (pointer[to] + 1).astype(np.uint64), have[at] + have[to]
            by = np.argsort(key)
            at, deep, edge = at[by], deep[by], edges(key[by])
            size = np.diff(np.r_[edge, len(at)])
            order[live], pointer[at], have[at] = at, np.repeat(live[edge], size), deep
            live = live[np.repeat(size > 1, size) & (deep < depth)]
    return order, pointer[:n], grams


def repeats(text: np.ndarray, remain: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, number of the window that begins there, in any order) of windows that begin at more than one place; remain: bytes of the segment from each place on."""
    order, pointer, grams = refine(text, window)
    at = order[remain[order] >= window]
    if not len(at):
        return at, at
    same = pointer[at[1:]] == pointer[at[:-1]]
    look = np.flatnonzero(~same)  # refined apart, maybe by bytes beyond the window
    for k in [*range(0, window - 7, 8), window - 8]:
        look = look[grams[at[look + 1] + k] == grams[at[look] + k]]
    same[look] = True
    number = np.cumsum(np.r_[True, ~same])
    many = np.r_[same, False] | np.r_[False, same]
    return at[many], number[many]


def _late(table, window: int):
    """Of one bucket: for each chunk, the windows (row, first, last) that also start earlier."""
    texts, places = opened(table)
    every = np.concatenate([np.stack([p.id, p.start, p.of]) for p in places], axis=1)
    every = every[:, np.lexsort((every[1], every[0], every[2]))]
    least = every[:, edges(every[2])]  # each distinct run's earliest place
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(size)
    body = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at, number = repeats(body, np.repeat(ends, size) - np.arange(len(body)), window)
    of = np.searchsorted(ends, at, side="right")
    ids, begin = least[0][of], least[1][of] + at - (ends - size)[of]
    order = np.lexsort((begin, ids, number))
    number, ids, begin, at = number[order], ids[order], begin[order], at[order]
    edge = edges(number)
    head = np.repeat(edge, np.diff(np.r_[edge, len(number)]))
    late = np.zeros(len(body) + 1, dtype=bool)
    late[at[(ids > ids[head]) | (begin > begin[head])]] = True
    # spans of late windows in each distinct run, for its earliest place; any later place loses all its windows
    late[ends - 1] = False  # no window starts at a run's last byte
    step = np.diff(np.r_[False, late].astype(np.int8))
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    of = np.searchsorted(ends, a, side="right")
    a, b = a - (ends - size)[of], b - (ends - size)[of]
    lower = np.searchsorted(of, np.arange(len(texts)))
    count = np.searchsorted(of, np.arange(len(texts)), side="right") - lower
    out = []
    for p in places:
        later = (p.id > least[0][p.of]) | (p.start > least[1][p.of])
        first = np.flatnonzero(~later)
        place, one = expanded(p.of[first], lower, count)
        place = first[place]
        out.append((p.chunk, np.r_[p.row[later], p.row[place]], np.r_[p.start[later], p.start[place] + a[one]], np.r_[p.start[later] + size[p.of[later]] - window, p.start[place] + b[one]]))
    return answered(out)


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 100, gram: int = 32, chunk_bytes: int = 2 << 20, bucket_bytes: int = 3 << 19, hot: int = HOT) -> DataFrame:
    """One row for each of docs: id, n_bytes, kept (the bytes that stay), spans (byte offsets from, to of what went, maximal)."""
    total = text_bytes(docs, text)
    buckets = pieces(total, bucket_bytes)
    chunks = chunked(docs, id, text, pieces(total, chunk_bytes))
    anchors = recurring(chunks, lambda t: _Chunk(t, window, gram).named(), buckets, hot)
    sent = met(chunks, anchors, lambda t, keys: _Chunk(t, window, gram).runs(keys), buckets)
    late = sent.groupBy("bucket").applyInArrow(lambda t: _late(t, window), ANSWER)

    def remove(left, right):
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))])
        if not left.num_rows:
            return schema.empty_table()
        c = _Chunk(left, window, gram)
        gone = marked(right, c.begin, len(c.body), window)
        out = {"id": c.table.column("id"), "n_bytes": np.diff(c.begin), "kept": [], "spans": []}
        for a, b in zip(c.begin[:-1], c.begin[1:]):
            g = gone[a:b]
            if g.any():
                step = np.diff(np.r_[False, g, False].astype(np.int8))
                out["kept"].append(c.body[a:b][~g].tobytes())
                out["spans"].append(np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1).tolist())
            else:
                out["kept"].append(c.body[a:b].tobytes())
                out["spans"].append([])
        return pa.table(out, schema=schema)

    out = chunks.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(remove, "id long, n_bytes long, kept binary, spans array<array<long>>")
    return out.withColumnRenamed("id", id)
