"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at many places of a ring of 64-bit hashes (its virtual nodes), a row at the hash of its text; a row's shard is
the first virtual node clockwise whose shard has room. No shard takes more than its share of the bytes and a little slack, so
what a full shard cannot take continues clockwise, and only that.

Rows of more than a thousandth of a share (there are no more than a thousand of them a shard, however many rows) are placed first, one by
one, the largest first. The others are laid end to end in the order of the ring, by one sort over all partitions; between two virtual
nodes they are an arc, known by its length. Arcs are dealt in rounds: each goes to the next shard with room, a shard that fills
up cuts the last one, and what is cut off continues. Every round but the last fills a shard, so there are no more rounds than
shards; the driver holds arcs and their cuts, a number that depends on shards and virtual nodes alone. A row is then looked
up by its arc and its place in it, so that a group of equal texts, which all stand at one place of the ring, stays in one shard as
far as that has room, and a group larger than a shard continues in the next ones.

Defined results: a null text is sized as an empty one; a row larger than a share is alone as far as possible, and the others share what is left
evenly; ties in the order of the ring fall by identifier and size; null identifiers and repeated rows are rows like others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Cells of the ring, by its highest bits, in which virtual nodes are looked up.
_CELL_BITS = 12


class Ring(NamedTuple):
    """Virtual nodes in the order of the ring: their places (signed 64-bit) and shards."""

    at: list[int]
    shard: list[int]

    @classmethod
    def of(cls, shards: int, nodes: int, seed: int = 42) -> Ring:
        places = {xxhash.xxh64_intdigest(f"{s}/{k}", seed) - (1 << 63): s for s in range(shards) for k in range(nodes)}
        return cls(sorted(places), [places[x] for x in sorted(places)])

    def arc(self, place: int) -> int:
        """The number of the first virtual node from a place on."""
        return bisect_left(self.at, place) % len(self.at)


class Piece(NamedTuple):
    """From one length of an arc to another."""

    arc: int
    low: int
    high: int


def level(loads: Sequence[int], more: int) -> float:
    """How high so much more fills up the given loads, if it flows to the lowest."""
    own = sorted(loads)
    for k in range(len(own), 0, -1):
        if (full := (sum(own[:k]) + more) / k) >= own[k - 1]:
            return full
    return float(max(own))


def place_large(ring: Ring, rows: Sequence[tuple[int, int]], loads: list[int], room: float) -> list[int]:
    """The shard of each of rows (place, size), placed one after the other: the first clockwise that it still fits into, else the emptiest."""
    out = []
    for place, size in rows:
        first = ring.arc(place)
        clockwise = (ring.shard[(first + k) % len(ring.at)] for k in range(len(ring.at)))
        shard = next((s for s in clockwise if loads[s] + size <= room), None)
        shard = min(range(len(loads)), key=loads.__getitem__) if shard is None else shard
        loads[shard] += size
        out.append(shard)
    return out


def deal_arcs(ring: Ring, lengths: dict[int, int], loads: Sequence[int], slack: float) -> list[tuple[Piece, int]]:
    """(piece, shard) of all arcs of the given lengths, in rounds; a shard takes up to the level that loads and lengths make, and the slack."""
    top = level(loads, sum(lengths.values())) * (1 + slack)
    rooms = [math.ceil(max(0.0, top - x)) + 1 for x in loads]
    waiting, out, n = [(arc, Piece(arc, 0, size)) for arc, size in sorted(lengths.items())], [], len(ring.at)
    while waiting:
        # the next virtual node with room, from each one on
        following, near = [0] * n, None
        for k in reversed(range(2 * n)):
            near = k % n if rooms[ring.shard[k % n]] > 0 else near
            following[k % n] = near
        queues: dict[int, list[tuple[int, Piece]]] = {}
        for at, piece in waiting:
            queues.setdefault(ring.shard[following[at]], []).append((following[at], piece))
        waiting = []
        for shard, queue in queues.items():
            for at, piece in sorted(queue):
                take = min(piece.high - piece.low, rooms[shard])
                if take:
                    out.append((Piece(piece.arc, piece.low, piece.low + take), shard))
                    rooms[shard] -= take
                if piece.low + take < piece.high:
                    waiting.append((at, Piece(piece.arc, piece.low + take, piece.high)))
        waiting.sort()
    return sorted(out)


def _arc(ring: Ring, df: DataFrame, place: str) -> DataFrame:
    """df with arc, the number of the virtual node that follows a place."""
    spark, cells = df.sparkSession, []
    for c in range(1 << _CELL_BITS):
        low, high = (c << (64 - _CELL_BITS)) - (1 << 63), ((c + 1) << (64 - _CELL_BITS)) - (1 << 63)
        first, last = bisect_left(ring.at, low), bisect_left(ring.at, high)
        cells.append((c, first, ring.at[first:last]))
    table = spark.createDataFrame(cells, "_cell long, _first int, _places array<long>")
    cell = F.shiftright(F.col(place), 64 - _CELL_BITS) + (1 << (_CELL_BITS - 1))
    passed = F.size(F.filter("_places", lambda x: x < F.col(place)))
    return df.withColumn("_cell", cell).join(F.broadcast(table), "_cell").withColumn("arc", F.pmod(F.col("_first") + passed, F.lit(len(ring.at)))).drop("_cell", "_first", "_places")


def _before(x: DataFrame, by: str, sums: dict[str, Column]) -> DataFrame:
    """(_part, by, sums over all partitions before it): no more rows than partitions times values of by."""
    w = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = x.groupBy("_part", by).agg(*(c.alias(k) for k, c in sums.items()))
    return per.select("_part", by, *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums))


def shard_rows(docs: DataFrame, size: Column, key: Column, id: str = "doc_id", shards: int = 24, nodes: int = 128, slack: float = 0.001, large: int = 1000, carry: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """One row for each of docs: id, size, shard, slot (from 0 on in each shard), and the columns carried.

    key: a long that is the row's place on the ring; size: a long, 1 or more."""
    spark, ring = docs.sparkSession, Ring.of(shards, nodes, seed)
    rows = docs.select(F.col(id).cast("long").alias("id"), size.alias("size"), key.alias("place"), *(F.col(c).alias(f"own_{c}") for c in carry))
    rows = written(rows.withColumn("lot", F.xxhash64("id", F.lit(seed))), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, -(-total // (shards * large)))
    # at most shards * large rows; those of one identifier, place and size are alike, and so go together
    many = rows.where(F.col("size") > least).groupBy("id", "place", "size").agg(F.count("*").alias("n")).collect()
    many = sorted(many, key=lambda r: (-r.size, r.place, r.id is None, r.id or 0))
    loads, giant = [0] * shards, 0
    sizes = [r["size"] for r in many for _ in range(r.n)]
    while giant < min(len(sizes), shards - 1) and sizes[giant] > (total - sum(sizes[:giant])) / (shards - giant):
        giant += 1  # a row larger than the share of what is left
    room = (total - sum(sizes[:giant])) / (shards - giant) * (1 + slack)
    where = place_large(ring, [(r.place, r["size"]) for r in many for _ in range(r.n)], loads, room)
    # copies of one row, if they went to several shards, are told apart by a number
    k, named = 0, []
    for r in many:
        named += [(r.id, r.place, r["size"], c, where[k + c]) for c in range(r.n)]
        k += r.n
    named = spark.createDataFrame(named, "l_id long, l_place long, l_size long, l_copy int, shard int")
    copy = F.row_number().over(Window.partitionBy("id", "place", "size").orderBy("lot")) - 1
    on = F.col("id").eqNullSafe(F.col("l_id")) & (F.col("place") == F.col("l_place")) & (F.col("size") == F.col("l_size")) & (F.col("copy") == F.col("l_copy"))
    big = rows.where(F.col("size") > least).withColumn("copy", copy).join(F.broadcast(named), on).drop("copy", "l_id", "l_place", "l_size", "l_copy")

    small = _arc(ring, rows.where(F.col("size") <= least), "place")
    small = written(small.sort("place", "lot", "id", "size").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ring")
    lengths = {r.arc: r.n for r in small.groupBy("arc").agg(F.sum("size").alias("n")).collect()}  # a row for each virtual node at most
    dealt = deal_arcs(ring, lengths, loads, slack)
    cuts: dict[int, list[tuple[int, int]]] = {}
    for piece, shard in dealt:
        cuts.setdefault(piece.arc, []).append((piece.low, shard))
    table = spark.createDataFrame(list(cuts.items()), "arc int, _cuts array<struct<low: long, shard: int>>")
    # how far along its arc each row begins: sums within a partition, and those of the partitions before it
    starts = _before(small, "arc", {"_before": F.sum("size")})
    own = Window.partitionBy("_part", "arc").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    x = small.join(starts, ["_part", "arc"]).withColumn("_low", F.col("_before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    x = x.join(F.broadcast(table), "arc")
    last = F.element_at(F.filter("_cuts", lambda c: c["low"] <= F.col("_low")), -1)
    columns = ["id", "size", "shard", *(f"own_{c}" for c in carry)]
    x = x.withColumn("shard", last["shard"]).select(*columns).union(big.select(*columns))
    x = written(x.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "shards")
    first = _before(x, "shard", {"_first": F.count("*")})
    slot = F.col("_first") + F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_at")) - 1
    x = x.join(first, ["_part", "shard"]).withColumn("slot", slot)
    return x.select(F.col("id").alias(id), "size", "shard", "slot", *(F.col(f"own_{c}").alias(c) for c in carry))


def shard_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", overhead: int = 8, **options) -> DataFrame:
    """Documents by their texts: id, size (UTF-8 bytes and an overhead), text_crc32, shard, slot."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(id).alias("id"), (F.octet_length(body) + overhead).cast("long").alias("bytes"), F.xxhash64(body).alias("key"), F.crc32(body.cast("binary")).alias("text_crc32"))
    out = shard_rows(own, F.col("bytes"), F.col("key"), "id", carry=["text_crc32"], **options)
    return out.select(F.col("id").alias(id), "size", "text_crc32", "shard", "slot")
