"""Exact dedup as a log-structured merge index, in DataFrame operations only.

Rows are dealt to memtables; each is flushed as a run of (digest, kept identifier, count) sorted by digest, with a filter of
one 64-bit word per few digests. A digest that another run's filter may hold goes through compaction, which merges the runs;
the rest need no merge. Digests that occur more than once (hits) are verified byte by byte; texts that only share a digest
are told apart.

Defined results: a null text counts as empty and equals an empty one; of equal texts the largest (or smallest) identifier
stays; rows with the same identifier and text form one group of their own count, and every such row that carries the kept
identifier is kept; a null identifier stays only if no other in its group is set; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, text_bytes, pieces, written

#: Hits up to this many are broadcast (32 bytes each); more are joined by shuffle.
BROADCAST_HITS = 200_000
_SALTS = 8


def _mask(digest):
    """Three bits of a word, by parts of the digest."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(64)).cast("int")) for k in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def flush(rows: DataFrame, memtables: int, keep: str = "largest") -> tuple[DataFrame, DataFrame]:
    """Runs (run, digest, keep_id, n, word, mask) sorted by digest, and their filters (word, runs: array of (run, mask))."""
    best = F.max if keep == "largest" else F.min
    words = pieces(rows.count(), 4)
    runs = rows.withColumn("run", dealt(F.col("id"), memtables)).groupBy("run", "digest").agg(best("id").alias("keep_id"), F.count("*").alias("n"))
    runs = runs.withColumns({"word": F.pmod(F.xxhash64("digest"), F.lit(words)), "mask": _mask(F.col("digest"))})
    runs = written(runs.sortWithinPartitions("run", "digest"), "runs")
    filters = runs.groupBy("word", "run").agg(F.bit_or("mask").alias("mask")).groupBy("word").agg(F.collect_list(F.struct("run", "mask")).alias("runs"))
    return runs, filters


def compact(runs: DataFrame, filters: DataFrame, keep: str = "largest") -> DataFrame:
    """One level (digest, keep_id, n): runs merged where another run's filter may hold the digest."""
    best = F.max if keep == "largest" else F.min
    probed = runs.join(filters, "word", "left").withColumn("may", F.exists("runs", lambda f: (f["run"] != F.col("run")) & (f["mask"].bitwiseAND(F.col("mask")) == F.col("mask"))))
    probed = written(probed.select("digest", "keep_id", "n", "may"), "probed")
    merged = probed.where("may").groupBy("digest").agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return merged.union(probed.where("not may").select("digest", "keep_id", "n"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "largest", digest_bits: int = 256, memtable_bytes: int = 64 << 20, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each of docs: id, keep_id, group_size, kept, text_sha256. digest_bits under 256 shortens the index's digest (equal texts are still told by bytes). carry: columns of docs to return too."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c).alias(f"own_{c}") for c in carry))
    full = F.unhex(F.sha2("text", 256))
    digest = full if digest_bits == 256 else F.substring(full, 1, digest_bits // 8)
    seen = written(rows.select("id", full.alias("sha"), digest.alias("digest"), *(f"own_{c}" for c in carry)), "digests")
    memtables = min(64, pieces(text_bytes(rows, "text"), memtable_bytes))
    runs, filters = flush(seen, memtables, keep)
    hits = written(compact(runs, filters, keep).where("n > 1"), "hits")
    # hits receive byte verification: the least and the greatest text of a digest are the same bytes, or it is shared by chance
    n_hits = hits.count()
    keys = hits.select("digest")
    same = rows.select("id", "text", digest.alias("digest")).join(F.broadcast(keys) if n_hits <= BROADCAST_HITS else keys, "digest", "left_semi")
    chance = written(same.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest"), "chance")
    best = F.max if keep == "largest" else F.min
    parts = same.join(chance, "digest", "left_semi").groupBy("digest", F.unhex(F.sha2("text", 256)).alias("sha"), "text").agg(best("id").alias("keep_id"), F.count("*").alias("n"))
    found = hits.join(chance, "digest", "left_anti").select("digest", F.lit(None).cast("binary").alias("sha"), "keep_id", "n").union(parts.select("digest", "sha", "keep_id", "n"))
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    left = seen.withColumn("salt", dealt(F.col("id"), _SALTS)).alias("l")
    on = (F.col("l.digest") == F.col("r.digest")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("r.sha").isNull() | (F.col("l.sha") == F.col("r.sha")))
    out = left.join(salted.alias("r"), on, "left")
    one = F.col("r.n").isNull()
    return out.select(
        F.col("l.id").alias(id),
        F.when(one, F.col("l.id")).otherwise(F.col("r.keep_id")).alias("keep_id"),
        F.coalesce("r.n", F.lit(1).cast("long")).alias("group_size"),
        F.when(one, F.lit(True)).otherwise(F.col("l.id").eqNullSafe(F.col("r.keep_id"))).alias("kept"),
        F.lower(F.hex("l.sha")).alias("text_sha256"),
        *(F.col(f"l.own_{c}").alias(c) for c in carry),
    )
