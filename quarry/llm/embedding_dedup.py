"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with a cosine of at least c differ by a squared distance of at most 2 - 2c. They are rotated at random and split
into low-dimensional blocks, each with a share of that budget in proportion to its dimensions: in one block at least, a pair
keeps its budget. Vectors are dealt to buckets, and two buckets meet in a tile, whose task joins them block by block: what keeps
the budget of a block is verified exactly, and a pair found in several blocks counts in the first only. Equal vectors are merged
before. A tile gives back counts and a spanning forest of its links, never its pairs. A vector is sent once for each bucket, and
neither once for each block and each cell of a grid: random-like vectors leave a grid over a few coordinates nothing to prune.

Defined results: a vector that is null, zero or holds a null or non-finite component links with nothing; vectors of different
dimension do not link; rows with one identifier are one node, whose links are counted together; a null identifier is a node
of its own without links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

_SLACK = 1e-9


def rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))[0]


def blocks_of(dim: int, each: int) -> list[tuple[int, int]]:
    n = max(1, dim // each)
    return [(k * dim // n, (k + 1) * dim // n) for k in range(n)]


def _units(payload: list[bytes], dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(payload), dtype=dtype).reshape(len(payload), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def embedding_dedup(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, block: int = 16, tile: int = 32_768, seed: int = 42) -> DataFrame:
    """One row for each of rows: id, n_links, component_id, kept. tile: vectors of a bucket at most, in the mean."""
    kind = rows.schema[vector].dataType.elementType.typeName()
    dtype = np.float32 if kind == "float" else np.float64
    budget = 2 - 2 * cosine + _SLACK

    def clean(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            col = b.column(1)
            values = col.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(dtype)
            end = np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            begin = np.r_[0, end[:-1]]
            odd, some = (np.r_[0, np.cumsum(x)] for x in (~np.isfinite(values), values != 0))
            good = (odd[end] == odd[begin]) & (some[end] > some[begin])
            at = pa.py_buffer((np.r_[0, end] * values.itemsize).astype(np.int32))
            payload = pa.Array.from_buffers(pa.binary(), len(col), [None, at, pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(pa.array(good), payload, pa.scalar(None, pa.binary()))], ["id", "payload"])

    own = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(clean, "id long, payload binary")
    own = cut(own)
    merged = own.where("payload is not null and id is not null").groupBy("payload").agg(F.min("id").alias("node"), F.count_distinct("id").alias("n"))
    merged = cut(merged)

    def join(table):
        import pyarrow as pa

        left, right = table.column("left").to_numpy(), table.column("right").to_numpy()
        dim = table.column("dim")[0].as_py()
        node, n, payload = table.column("node").to_numpy(), table.column("n").to_numpy(), table.column("payload").to_pylist()
        unit = _units(payload, dtype)
        turned = unit @ rotation(dim, seed)
        cuts = blocks_of(dim, block)
        squares = np.stack([(turned[:, f:t] ** 2).sum(axis=1) for f, t in cuts])
        limit = [budget * (t - f) / dim for f, t in cuts]
        root, links = np.arange(len(node)), np.zeros(len(node), dtype=np.int64)
        guest, home = np.flatnonzero(left), np.flatnonzero(right)

        def apart(k, i, j):
            f, t = cuts[k]
            return squares[k][i][:, None] + squares[k][j] - 2 * turned[i, f:t] @ turned[j, f:t].T

        def joined(a, b):
            while len(a):  # hook roots together; what is left joins different trees
                ra, rb = root[a], root[b]
                other = ra != rb
                a, b, ra, rb = a[other], b[other], ra[other], rb[other]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (root[root] != root).any():
                    root[:] = root[root]

        for number, (f, t) in enumerate(cuts):
            # a first look in single precision, with room for its rounding: squared distances of the block as one product
            own, one = turned[:, f:t], np.ones(len(turned))
            asks = np.c_[-2 * own, squares[number], one].astype(np.float32)[guest]
            answers = np.ascontiguousarray(np.c_[own, one, squares[number]].astype(np.float32)[home].T)
            step = max(16, (1 << 19) // max(1, len(home)))
            for lo in range(0, len(guest), step):
                g = guest[lo : lo + step]
                near = asks[lo : lo + step] @ answers <= np.float32(limit[number] + 1e-5)
                if (many := np.count_nonzero(near)) > 0.05 * near.size:  # dense: whole matrices
                    near = (apart(number, g, home) <= limit[number]) & (unit[g] @ unit[home].T >= cosine)
                    for k in range(number):
                        near &= apart(k, g, home) > limit[k]
                    i, j = np.nonzero(near)
                    a, b = g[i], home[j]
                elif many:
                    i, j = np.divmod(np.flatnonzero(near), len(home))
                    a, b = g[i], home[j]
                    ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                    a, b = a[ok], b[ok]
                    for k in range(number + 1):
                        f, t = cuts[k]
                        d = squares[k][a] + squares[k][b] - 2 * np.einsum("ij,ij->i", turned[a, f:t], turned[b, f:t])
                        ok = d > limit[k] if k < number else d <= limit[k]
                        a, b = a[ok], b[ok]
                else:
                    continue
                other = a != b
                a, b = a[other], b[other]
                links += np.bincount(a, weights=n[b], minlength=len(node)).astype(np.int64)
                if not left.all():  # two buckets meet once, for both
                    links += np.bincount(b, weights=n[a], minlength=len(node)).astype(np.int64)
                joined(a, b)
        on = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        return pa.table({"node": node[on], "links": links[on], "peer": node[root[on]]}, schema=pa.schema([("node", pa.int64()), ("links", pa.int64()), ("peer", pa.int64())]))

    # so many buckets that their pairs keep a cluster busy, and more where they would be too large for a task
    size = merged.count()
    many = max(min(8, -(-size // 1024)), -(-size // tile), 1)
    mine = F.pmod(F.xxhash64("node"), F.lit(many)).cast("int")
    x = merged.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    x = x.select(F.length("payload").cast("int").alias("bytes"), F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "node", "n", "payload")
    x = x.select((F.col("bytes") / np.dtype(dtype).itemsize).cast("int").alias("dim"), "p", "q", (F.col("mine") == F.col("p")).alias("left"), (F.col("mine") == F.col("q")).alias("right"), "node", "n", "payload")
    found = cut(x.groupBy("dim", "p", "q").applyInArrow(join, "node long, links long, peer long"))
    linked = components(found.where("node <> peer").select(F.col("node").alias("a"), F.col("peer").alias("b")).union(own.join(merged, "payload").where("id <> node").select("id", "node")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = merged.join(counts, "node", "left").select("payload", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    byid = own.where("id is not null").join(per, "payload", "left").groupBy("id").agg(F.sum("links").alias("links"))
    byid = byid.join(linked, F.col("id") == F.col("node"), "left").select("id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = own.select(F.col("id").alias("_id")).join(byid, F.col("_id") == F.col("id"), "left")
    return out.select(F.col("_id").alias(id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))
