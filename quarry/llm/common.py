"""What several operators share: the shared folder, lineage cuts, packed text and connected components."""

from __future__ import annotations

import contextlib
import functools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import shared_dir

#: Stands for a null identifier inside workers: after every real one.
NULL_ID = np.iinfo(np.int64).max
#: ASCII white space, the complement of [^\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Links that one task joins up at most.
LOCAL_LINKS = 2_000_000
#: Tables in the shared folder, by application.
_TABLES: dict[str, list[str]] = {}
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _TABLES.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> list[str]:
    """The tables written so far and not removed, in order."""
    return _TABLES.setdefault(spark.sparkContext.applicationId, [])


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        tables(spark).remove(path)


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts, for sizing partitions."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def dealt(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def packed(table, ids: str, texts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From an Arrow table: identifiers (null: NULL_ID), all text bytes end to end, and where each row's begin (one more than rows)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    own = pc.fill_null(table.column(ids).cast(pa.int64()), NULL_ID).to_numpy()
    col = pc.fill_null(table.column(texts).cast(pa.large_string()), "")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    _, at, data = col.buffers()
    begin = np.frombuffer(at, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, dtype=np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return own, body[begin[0] : begin[-1]], begin - begin[0]


def released(each: Callable) -> Callable:
    """each, a function over a task's batches, which gives its worker's free memory back at the end: a worker stays for later tasks."""

    @functools.wraps(each)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from each(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def blocks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive rows of about so much in all."""
    edge = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(sizes) // most]))
    return list(zip(edge.tolist(), np.r_[edge[1:], len(sizes)].tolist())) if len(sizes) else []


def text_sizes(column) -> np.ndarray:
    """Bytes of each text of an Arrow column (null: 0)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of body, from prefix sums of a polynomial."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(_BASE, len(body)), powers(_INVERSE, len(body) + 1)  # an empty span may begin at the end
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    sums = np.zeros(len(body) + 1, dtype=np.uint64)
    np.cumsum(table[body] * up[: len(body)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words_of(body: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each row (one more than rows). Words never cross rows."""
    word = ~SPACE[body]
    edge = np.zeros(len(body) + 1, dtype=bool)
    edge[begin] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, begin)


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours of x."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, the smallest node reachable from each) of links."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        ra, rb = root[a], root[b]
        other = ra != rb
        if not other.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[other], b[other], ra[other], rb[other]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def components(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) of every node of links (a, b), component the smallest node reachable.

    Up to local links (16 bytes each) are joined up in one task; more by alternating large and small stars, each round cut off in
    the shared folder."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = cut(edges), None

    def at_once(batches: Iterator) -> Iterator:
        import pyarrow as pa

        every = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if every:
            nodes, least = joined_up(np.concatenate([a for a, _ in every]), np.concatenate([b for _, b in every]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])

    while True:
        seen = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] <= local:
            return edges.repartition(1).mapInArrow(at_once, "node long, component long")
        if seen == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
        before = seen
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down).where("a <> b").distinct())
