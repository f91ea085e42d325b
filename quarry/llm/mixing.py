"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

All words are cut into equal blocks. Blocks go to sources by the highest quotients target / (2k + 1), then in each source to
its shards by the highest quotients size / (2k + 1). In a shard, documents lie end to end in a seeded order; its quota is
taken as whole passes over the shard and one seeded run of consecutive blocks, which wraps around.

Defined results: size counts [^\\x20\\x09-\\x0D]+ (null text: 0); a null source is a source, last in the order; a document of
size 0 is never taken; a table without words has targets 0; rows with the same identifier are rows like others, ties in the
seeded order fall by identifier and size; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Tables of at most so many sources are broadcast.
BROADCAST_SOURCES = 50_000


def apportion(df: DataFrame, group: Sequence[str], key: Sequence[str], votes: str, seats: str, out: str) -> DataFrame:
    """df with a column out: its integer quota of the seats (one number per group) by the highest quotients votes / (2k + 1).

    Rounding votes / (total / seats) misses the number of seats by at most half the rows; each row's quota is then within
    its share of that, so only so many quotients a row need ranking, in proportion to the rows of the group."""
    w = Window.partitionBy(*(group or [F.lit(0)]))
    x = df.withColumns({"_total": F.sum(F.col(votes).cast("double")).over(w), "_rows": F.count("*").over(w)}).where(F.col(votes) > 0)
    x = x.withColumn("_near", F.floor(F.col(votes) / F.col("_total") * F.col(seats) + 0.5))
    x = x.withColumn("_span", F.ceil(F.col(votes) / F.col("_total") * F.col("_rows") / 2) + 1)
    x = x.withColumn("_base", F.greatest(F.col("_near") - F.col("_span"), F.lit(0).cast("long")))
    x = x.withColumn("_open", F.col(seats) - F.sum("_base").over(w))
    x = x.withColumn("_k", F.explode(F.sequence("_base", F.col("_near") + F.col("_span"))))
    x = x.withColumn("_rank", F.row_number().over(w.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *(F.col(k).asc_nulls_last() for k in key))))
    names = (*group, *key)
    won = x.groupBy(*(F.col(c).alias(f"_{c}") for c in names)).agg((F.max("_base") + F.count_if(F.col("_rank") <= F.col("_open"))).alias("_won"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return df.join(won, on, "left").select(*df.columns, F.coalesce("_won", F.lit(0).cast("long")).alias(out))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), repeats: float = 3) -> DataFrame:
    """(source, source_size, total, target) from (source, source_size): target by weight, at most repeats times the size, the excess shared again by weight.

    Sources that are full are those with the least repeats * size / weight; one pass over them in that order finds how many."""
    order, every = Window.orderBy(F.col("source").isNull(), "source"), Window.partitionBy(F.lit(0))
    x = sizes.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)))
    x = x.withColumns({"total": F.sum("source_size").over(every), "_cap": F.col("source_size") * float(repeats)})
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    x = x.withColumns({"_full": F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), "_rest": F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))})
    x = x.withColumn("_level", (F.col("total") - F.coalesce("_full", F.lit(0.0))) / F.col("_rest"))
    x = x.withColumn("_at", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(every)["level"])
    return x.select("source", "source_size", "total", F.least(F.col("_cap"), F.coalesce(F.col("_at"), F.lit(float("inf"))) * F.col("_w")).alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), repeats: int = 3, seed: int = 42, blocks: int = 10_000_000, shard_words: int = 65_536, max_shards: int = 4096, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each of docs: id, size, source_size, target, taken, and the columns carried."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = cut(docs.select(F.col(id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"), *(F.col(c).alias(f"own_{c}") for c in carry)))
    per = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    per = per.withColumn("block", F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / blocks))).withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long"))
    per = apportion(per, [], ["source"], "target", "seats", "quota")
    per = cut(per.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(max_shards), F.ceil(F.col("source_size") / shard_words).cast("int")))).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    few = F.broadcast(per) if per.count() <= BROADCAST_SOURCES else per
    x = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source").join(few, "key")
    x = x.withColumn("lot", F.xxhash64("id", F.lit(seed))).withColumn("shard", F.pmod("lot", F.col("shards")))
    shards = x.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    shards = apportion(shards, ["key"], ["shard"], "words", "quota", "blocks").drop("quota")
    line = Window.partitionBy("key", "shard").orderBy(F.xxhash64("lot", F.lit(seed + 1)), "id", "size")
    x = x.withColumn("hi", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(shards, ["key", "shard"])
    x = x.withColumn("lo", F.col("hi") - F.col("size"))
    x = x.withColumn("budget", F.least(F.col("blocks") * F.col("block"), repeats * F.col("words")))
    x = x.withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("budget") / F.col("words"))).otherwise(F.lit(0).cast("long")))
    x = x.withColumn("rest", F.col("budget") - F.col("passes") * F.col("words"))
    x = x.withColumn("start", F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("words") / F.col("block")))) * F.col("block"))
    x = x.withColumn("end", F.col("start") + F.col("rest"))
    none = F.lit(0).cast("long")
    run = F.greatest(none, F.least("hi", "end") - F.greatest("lo", "start"))
    around = F.greatest(none, F.least(F.col("hi"), F.col("end") - F.col("words")) - F.col("lo"))
    return x.select(F.col("id").alias(id), "size", "source_size", "target", (F.col("passes") * F.col("size") + run + around).cast("long").alias("taken"), *(F.col(f"own_{c}").alias(c) for c in carry))
