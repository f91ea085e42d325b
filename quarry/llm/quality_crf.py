"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line is described by shares of kinds of characters, of repeated neighbouring words and of lines that the document
repeats, and by the same of the lines before and after it. The field labels every line good or bad; forward-backward
marginals, weighted by the lines' lengths, give the document's quality, which a logistic curve fitted on the same documents
turns into a probability.

Learning takes at most sample_docs labelled documents of at most sample_lines lines, chosen by a hash of their identifier;
every line of a document is taught the document's label. Defined results: a null or empty text is one empty line; a null
label or identifier teaches nothing, of repeated labels the greatest counts; without labels every score is 0.5; repeated
rows are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, blocks, packed, released, span_hashes, words_of

_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~=+<>{}[]\\/_`", "|", "!?", ".,;:'\"()-")
_BLOCK = 1 << 20
FEATURES = len(_KINDS) + 7


def line_features(body: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length in bytes, the number of the first line of each row, one more than rows)."""
    edge = np.zeros(len(body) + 1, dtype=bool)
    edge[1:] = body == 10
    # a line begins at every row and after every newline in it
    after = np.flatnonzero(edge)
    row_of = np.searchsorted(begin[1:], after - 1, side="right")
    rows = np.r_[np.arange(len(begin) - 1), row_of]
    starts = np.r_[begin[:-1], after]
    order = np.lexsort((starts, rows))
    row, start = rows[order], starts[order]
    end = np.r_[start[1:] - (row[1:] == row[:-1]), begin[-1]] if len(start) else start
    first = np.searchsorted(row, np.arange(len(begin)))
    size = end - start
    safe = np.maximum(size, 1)
    cols = []
    for chars in _KINDS:
        kind = np.zeros(256, dtype=np.int32)
        kind[list(chars.encode())] = 1
        sums = np.r_[0, np.cumsum(kind[body])]
        cols.append((sums[end] - sums[start]) / safe)
    letters = cols[0] + cols[1]
    cols.append(cols[1] / np.maximum(letters, 1e-9) * (letters > 0.05))
    ws, we, _ = words_of(body, begin)
    h = span_hashes(body, ws, we)
    low, high = np.searchsorted(ws, start), np.searchsorted(ws, end)
    n = high - low
    again = np.r_[0, np.cumsum(np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0))]
    cols.append((again[high] - again[np.minimum(low + 1, high)]) / np.maximum(n, 1))  # no word before the line counts
    whole = span_hashes(body, start, end)
    _, which, times = np.unique(whole ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    cols.append(((times[which] > 1) & (size > 0)).astype(float))
    odd = np.r_[0, np.cumsum(~SPACE[body] & (body < 128) & ~np.isin(body, list("".join(_KINDS[:3]).encode())))]
    cols.append(np.minimum((odd[end] - odd[start]) / np.maximum(n, 1), 5) / 5)
    cols.append(np.minimum(size / np.maximum(n, 1), 30) / 30)
    cols.append(np.log1p(size) / 10)
    cols.append((size == 0).astype(float))
    return np.stack(cols, axis=1), size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and the one after it in the row, and a constant."""
    before, after = np.r_[x[:1] * 0, x[:-1]], np.r_[x[1:], x[:1] * 0]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def marginals(score: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By forward-backward, (probability that each line is good, expected moves between labels); score: a line's log-odds of good by its own features. Rows step together, longest first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    state = np.stack([np.zeros(len(score)), score], axis=1)
    a, b = state.copy(), np.zeros_like(state)
    longest = int(size.max(initial=0))
    alive = [int(np.searchsorted(-size, -t, side="right")) for t in range(longest + 1)]
    for t in range(1, longest):
        p = start[: alive[t + 1]] + t if t + 1 <= longest else start[:0]
        a[p] += np.logaddexp(a[p - 1, :1] + move[0], a[p - 1, 1:] + move[1])
    for t in range(longest - 2, -1, -1):
        p = start[: alive[t + 2]] + t
        x = state[p + 1] + b[p + 1]
        b[p] = np.logaddexp(x[:, :1] + move[:, 0], x[:, 1:] + move[:, 1])
    both = a + b
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    inner = np.ones(len(score), dtype=bool)
    inner[first[:-1]] = False
    p = np.flatnonzero(inner)
    pair = np.exp(a[p - 1][:, :, None] + move[None] + (state[p] + b[p])[:, None, :] - z[p][:, None, None])
    return good, pair.sum(axis=0)


def quality(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marginals weighted by length."""
    w = size + 1.0
    return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)


class Model:
    def __init__(self):
        self.weights, self.move, self.curve = np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), np.array([0.0, 0.0])

    def fit(self, x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120, l2: float = 1e-4) -> Model:
        x = with_neighbours(x, first)
        lines = np.repeat(label, np.diff(first)).astype(float)
        share = 1.0 / np.repeat(np.diff(first), np.diff(first))  # every document counts alike
        y = lines.astype(int)
        inner = np.ones(len(y), dtype=bool)
        inner[first[:-1]] = False
        p = np.flatnonzero(inner)
        moves = np.bincount(2 * y[p - 1] + y[p], minlength=4).reshape(2, 2)
        flat, m, v = np.zeros(len(self.weights) + 4), 0.0, 0.0
        for t in range(1, rounds + 1):
            good, pairs = marginals(x @ flat[:-4], first, flat[-4:].reshape(2, 2))
            g = np.r_[x.T @ ((lines - good) * share) / len(label), ((moves - pairs) / max(1, len(y))).ravel()] - l2 * flat
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            flat = flat + 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.move = flat[:-4], flat[-4:].reshape(2, 2)
        good, _ = marginals(x @ self.weights, first, self.move)
        q = self._odds(quality(good, size, first))
        curve = np.zeros(2)
        for _ in range(30):  # Newton's steps
            s = 1 / (1 + np.exp(-(curve[0] * q + curve[1])))
            w, d = s * (1 - s) + 1e-6, np.stack([q, np.ones(len(q))], axis=1)
            curve = curve + np.linalg.solve(d.T @ (d * w[:, None]) + 1e-2 * np.eye(2), d.T @ (label - s) - 1e-2 * curve)
        self.curve = curve
        return self

    @staticmethod
    def _odds(q: np.ndarray) -> np.ndarray:
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def score(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _ = marginals(with_neighbours(x, first) @ self.weights, first, self.move)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * self._odds(quality(good, size, first)) + self.curve[1], -50, 50)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = 3000, sample_lines: int = 128) -> Model:
    """A model from at most sample_docs labelled rows; learn: which identifiers (column `id`) may teach."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(learn)
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id", F.lit(2)), "id").limit(sample_docs)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")

    @released
    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            _, body, begin = packed(b, "id", "text")
            x, size, first = line_features(body, begin)
            few = [k for k in range(b.num_rows) if first[k + 1] - first[k] <= sample_lines]
            yield pa.RecordBatch.from_arrays(
                [b.column("y").take(pa.array(few, pa.int64())), pa.array([x[first[k] : first[k + 1]].astype(np.float32).tobytes() for k in few], pa.binary()), pa.array([size[first[k] : first[k + 1]].tobytes() for k in few], pa.binary())], ["y", "x", "size"]
            )

    got = rows.select("id", "text", "y").mapInArrow(each, "y int, x binary, size binary").collect()
    model = Model()
    if not got:
        return model
    got.sort(key=lambda r: (r.y, bytes(r.x)))
    x = np.concatenate([np.frombuffer(r.x, dtype=np.float32).reshape(-1, FEATURES) for r in got]).astype(float)
    size = [np.frombuffer(r.size, dtype=np.int64) for r in got]
    return model.fit(x, np.concatenate(size), np.cumsum([0, *map(len, size)]), np.array([r.y for r in got], dtype=float))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of the probability that the label is 1, in place of any of that name."""
    docs = docs.drop(out)
    from pyspark.sql import types as T

    @released
    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            one = pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, dtype=np.int64)), col], ["id", "text"])
            _, body, begin = packed(one, "id", "text")
            own = [model.score(*line_features(body[begin[f] : begin[t]], begin[f : t + 1] - begin[f])) for f, t in blocks(np.diff(begin), _BLOCK)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(own) if own else np.zeros(0))], [*b.schema.names, out])

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
