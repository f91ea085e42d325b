"""SimHash near-dedup by multi-index hashing.

A fingerprint of 64 bits falls into segments, and a distance of so many bits is shared out among them: two fingerprints
within the distance differ in one segment by no more than that segment's share. Each segment has a table of its values.
Small Hamming balls are enumerated within the segment, half the share around the values in the table and the other half around
those that look them up, the matches are fetched, and of every match the complete distance is verified. A value that too many
fingerprints share is split by exact pieces of the other segments, one more than the distance, of which close fingerprints
share at least one; where the distance is too great for pieces of 8 bits, adaptive execution splits the join instead.

With a similarity, a match within the distance is linked only if the Jaccard similarity of the whole shingle sets reaches it. A
fingerprint is too coarse to find all such pairs by its segments: the segment tables then serve a small distance only, and further
tables hold bands, each of a few minima of the shingle set under different orders, which a similar pair shares with a known
probability (at 0.8, all but 1 of 5,000 pairs share one of 12 bands of 3 minima). What no other text shares is dropped from the tables at once.
Texts that share a table entry are first compared with one leader of theirs, a few times over with different leaders, those that share
most with others first; those that no leader has linked meet in tiles of bounded blocks, whose task compares them and gives back a
forest of links, so that no pair of them is a row.

Defined results: words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a text with fewer words than a shingle is one shingle;
a text without words, or null, has fingerprint zero and no shingles, and all such texts are similar; texts are told apart by
64-bit hashes; rows with the same identifier or a null one are rows like others (a null never names a component unless alone);
very long texts count whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, components, cut, mixed, pieces, released, text_sizes, written

_BLOCK = 1 << 20
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: An address is a segment's number and a value of it.
_VALUE_BITS = 40
#: Addresses with more table entries than this are split by the other segments.
HOT = 4096
#: Rounds in which texts are compared with one leader of those that share a table entry.
LEADERS = 4
#: Bands of minima, and minima in a band.
BANDS, MINIMA = 12, 3
#: The distance that segment tables serve beside the bands.
NEAR = 2
_ORDERS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = np.random.default_rng(12).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of shingle sets in a block, about, and texts in it.
_SETS = 4 << 20
_NODES = 512


def shingles(text: bytes | None, shingle: int = 5, seed: int = 42) -> list[int]:
    """A 64-bit hash of each shingle of a text."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return []
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, seed)]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]


def shingle_set(text: bytes | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.array(shingles(text, shingle, seed), dtype=np.uint64))


def fingerprint(hashes) -> int:
    """The fingerprint of shingle hashes, unsigned: bits set in over half of them."""
    if not len(hashes):
        return 0
    cells = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(cells[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """An address for each band of minima of a set of shingle hashes, none for an empty set: sets of similarity s share one with probability s ** MINIMA."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    low = np.full(len(_ORDERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[k : k + 4096, None] * _ORDERS).min(axis=0))
    return mixed((mixed(low).reshape(BANDS, MINIMA) * _JOIN).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _rows(docs: DataFrame, id: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("key"), body.alias("text"), *(F.col(c).alias(f"own_{c}") for c in carry))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, repeats: bool = False, carry: Sequence[str] = (), banded: bool = False) -> DataFrame:
    """(id, key, fp, n, bands, carried columns as own_...): key a hash of the text, fp as a signed long, n distinct shingles, bands empty unless banded. repeats: whether a shingle counts as often as it occurs."""

    @released
    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = shingles if repeats else shingle_set
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            own, n, found = np.zeros(len(texts), dtype=np.uint64), np.zeros(len(texts), dtype=np.int64), []
            for f, t in blocks(text_sizes(texts), _BLOCK):
                for k, x in enumerate(texts.slice(f, t - f).to_pylist(), f):
                    hashes = of(x, shingle)
                    own[k], n[k] = fingerprint(hashes), len(set(hashes)) if repeats else len(hashes)
                    found.append(bands(hashes) if banded else hashes[:0])
            at = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            listed = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.view(np.int64)), pa.array(n), listed, *b.columns[3:]], names)

    rows = _rows(docs, id, text, carry)
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), *rows.schema.fields[3:]])
    names = schema.names
    return rows.mapInArrow(each, schema)


def segments_of(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of each segment needed: two fingerprints within the distance differ in one of them by its radius or less."""
    widths = [64 // segments + (k < 64 % segments) for k in range(segments)]
    share = [(distance + 1) // segments + (k < (distance + 1) % segments) for k in range(segments)]
    return [(64 - sum(widths[k:]), w, s - 1) for k, (w, s) in enumerate(zip(widths, share)) if s]


def _longs(values: Sequence[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _value(offset: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _ball(width: int, radius: int) -> Column:
    """All changes of at most radius bits."""
    return _longs([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)])


def addresses(rows: DataFrame, parts: list[tuple[int, int, int]], look_up: bool) -> DataFrame:
    """rows by the addresses of their fp (a column): the balls to look up, or those in the tables."""

    def near(k: int, offset: int, width: int, radius: int) -> Column:
        value = _value(offset, width)
        return F.transform(_ball(width, radius - radius // 2 if look_up else radius // 2), lambda x: value.bitwiseXOR(x) + F.lit(k << _VALUE_BITS).cast("long"))

    own = [near(k, *part) for k, part in enumerate(parts)]
    return rows.select(F.explode(F.concat(*own)).alias("address"), *rows.columns)


def _split(entries: DataFrame, hot: DataFrame, parts: list[tuple[int, int, int]], distance: int) -> DataFrame:
    """Entries by address and sub: those of hot addresses by the pieces of their other bits, any others once, with sub 0."""

    def pieces(offset: int, width: int) -> Column:
        turned = F.shiftrightunsigned("fp", (offset + width) % 64).bitwiseOR(F.shiftleft("fp", (64 - offset - width) % 64))
        left, n, at, out = 64 - width, distance + 1, 0, []
        for k in range(n):
            size = left // n + (k < left % n)
            out.append(F.shiftrightunsigned(turned, at).bitwiseAND(F.lit((1 << size) - 1).cast("long")) + F.lit((k + 1) << _VALUE_BITS).cast("long"))
            at += size
        return F.array(*out)

    sub = F.array(F.lit(0).cast("long"))
    for k, (o, w, _) in enumerate(parts):
        sub = F.when(F.col("hot") & (F.shiftright("address", _VALUE_BITS) == k), pieces(o, w)).otherwise(sub)
    own = entries.join(hot.withColumn("hot", F.lit(True)), "address", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    return own.select("address", F.explode(sub).alias("sub"), *entries.columns[1:])


def matches(nodes: DataFrame, distance: int, segments: int, more: Column | None = None, hot: int = HOT) -> DataFrame:
    """(a, b): all pairs of nodes (node, fp, n, c) of different c whose fingerprints differ in at most distance bits; more: a further condition on a.n and b.n."""
    parts = segments_of(distance, segments)
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but many entries of each: not to be coalesced
    nodes = nodes.repartition(spread, F.xxhash64("node"))
    table, asked, on = addresses(nodes, parts, False), addresses(nodes, parts, True), ["address"]
    if all((64 - w) // (distance + 1) >= 8 for _, w, _ in parts):
        many = cut(table.groupBy("address").count().where(F.col("count") > hot).select("address"))
        table, asked, on = _split(table, many, parts, distance), _split(asked, many, parts, distance), ["address", "sub"]
    close = (F.col("a.node") < F.col("b.node")) & (F.col("a.c") != F.col("b.c")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
    met = asked.alias("a").join(table.alias("b"), on).where(close if more is None else close & more)
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


class _Sets:
    """The shingle sets of texts, by text hash, each computed once and kept in the shared folder."""

    def __init__(self, docs: DataFrame, id: str, text: str, shingle: int):
        self.docs, self.shingle, self.known = _rows(docs, id, text).select("key", "text"), shingle, None

    def of(self, keys: DataFrame) -> DataFrame:
        """(key, hs), of these keys (a column key) at least."""
        shingle = self.shingle

        @released
        def sets(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                texts = b.column(1).cast(pa.binary())
                for f, t in blocks(text_sizes(texts), _BLOCK):
                    own = [shingle_set(x, shingle).view(np.int64) for x in texts.slice(f, t - f).to_pylist()]
                    at = np.cumsum([0, *map(len, own)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(f, t - f), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own)))], ["key", "hs"])

        new = keys if self.known is None else keys.join(self.known.select("key"), "key", "left_anti")
        new = written(new, "keys")
        if self.known is None or not new.isEmpty():
            own = written(self.docs.join(new, "key", "left_semi").mapInArrow(sets, "key long, hs array<long>").dropDuplicates(["key"]), "shingle-sets")
            self.known = own if self.known is None else self.known.union(own)
        return self.known


def _similar(pairs: DataFrame, sets: _Sets, least: int) -> DataFrame:
    """Of pairs (a, b) of text hashes, those whose shingle sets have a similarity of least percent or more."""

    def verified(left, right):
        """Of one bucket's pairs those that are similar; right: the sets of their texts."""
        import pyarrow as pa

        if not left.num_rows:
            return left.select(["a", "b"])
        keys, at = right.column("key").to_numpy(), right.column("hs").combine_chunks()
        order = np.argsort(keys)  # sets are in the order of unsigned hashes
        hashes, ends = at.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))
        sets = np.split(hashes, ends[:-1]) if len(keys) else []
        left = left.sort_by("a")
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        i, j = (order[np.searchsorted(keys, x, sorter=order)] for x in (a, b))
        keep = np.zeros(len(a), dtype=bool)
        edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        for f, t in zip(edge, np.r_[edge[1:], len(i)]):
            own, others = sets[i[f]], [sets[k] for k in j[f:t]]
            size = np.array([len(x) for x in others])
            every = np.concatenate(others)
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every if len(own) else np.zeros(len(every), dtype=bool)
            same = np.diff(np.r_[0, np.cumsum(hit)][np.r_[0, np.cumsum(size)]])
            keep[f:t] = same * (100 + least) >= (len(own) + size) * least
        return pa.table({"a": a[keep], "b": b[keep]})

    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    # texts that any pairs connect form a group; a set travels to its group's bucket once, or if the group has several blocks, once for each
    nodes = written(components(pairs), "groups").select(F.col("node").alias("key"), F.col("component").alias("group"))
    own = written(sets.of(nodes.select("key")).join(nodes, "key"), "grouped-sets")
    size = F.sum(8 * F.size("hs"))
    shared = pieces(own.agg(size).first()[0] or 0, _SETS)  # buckets of small groups
    parts = own.groupBy("group").agg(F.ceil(size / _SETS).cast("int").alias("parts")).withColumn("parts", F.greatest("parts", F.lit(1)))
    parts = written(nodes.join(parts, "group"), "parts")

    def bucket(x: Column, y: Column) -> Column:
        one = F.pmod(F.xxhash64("group"), F.lit(shared))
        return F.when(F.col("parts") == 1, one).otherwise(F.xxhash64("group", F.least(x, y), F.greatest(x, y)))

    mine = F.pmod(F.xxhash64("key"), F.col("parts"))
    needed = own.join(parts.select("key", "parts"), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    needed = needed.select(bucket(mine, F.col("other").cast("long")).alias("room"), "key", "hs")
    met = pairs.join(parts.withColumnRenamed("key", "a"), "a")
    met = met.select("a", "b", bucket(F.pmod(F.xxhash64("a"), F.col("parts")), F.pmod(F.xxhash64("b"), F.col("parts"))).alias("bucket"))
    return written(met.groupBy("bucket").cogroup(needed.groupBy("room")).applyInArrow(verified, "a long, b long"), "links")


def _shared(entries: DataFrame, by: str) -> DataFrame:
    """The entries whose address is in the table under more than one value of a column."""
    many = entries.groupBy("address").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo < hi").select("address")
    return entries.join(many, "address", "left_semi")


def _met(table, least: int, distance: int):
    """A forest of links among one tile's texts: those of a group that share an address, are of different c and, where the tile has two blocks, of different parts."""
    import pyarrow as pa

    def column(name: str, kind: type = np.int64) -> np.ndarray:
        return table.column(name).to_numpy().view(kind)

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        x = table.column(name).combine_chunks()
        return x.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]

    table = table.sort_by("group")
    group, node, c, n, part, fp = (column(k) for k in ("group", "node", "c", "n", "part", "fp"))
    (at, first), (hs, begin) = lists("at"), lists("hs")
    cross, links = table.column("lo")[0].as_py() != table.column("hi")[0].as_py(), []
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for f, t in zip(edge.tolist(), np.r_[edge[1:], len(group)].tolist()):
        may = np.zeros((t - f, t - f), dtype=bool)
        own, of = at[first[f] : first[t]], np.repeat(np.arange(t - f), np.diff(first[f : t + 1]))
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        for shared in np.split(of[order], cuts):
            if len(shared) > 1:
                may[np.ix_(shared, shared)] = True
        few, many = np.minimum.outer(n[f:t], n[f:t]), np.maximum.outer(n[f:t], n[f:t])
        may &= (few * 100 >= many * least) & (np.bitwise_count(np.bitwise_xor.outer(fp[f:t].view(np.uint64), fp[f:t].view(np.uint64))) <= distance)
        if cross:
            may &= np.not_equal.outer(part[f:t], part[f:t])
        may, root = np.triu(may, 1), np.unique(c[f:t], return_inverse=True)[1]
        number, mine = np.unique(hs[begin[f] : begin[t]], return_inverse=True)[1], np.zeros(begin[t] - begin[f], dtype=bool)
        size, start = np.diff(begin[f : t + 1]), begin[f : t + 1] - begin[f]
        for i in np.flatnonzero(may.any(axis=1)).tolist():
            others = np.flatnonzero(may[i] & (root != root[i]))
            if not len(others):
                continue
            mine[number[start[i] : start[i + 1]]] = True
            same = np.array([np.count_nonzero(mine[number[start[j] : start[j + 1]]]) for j in others.tolist()])
            mine[number[start[i] : start[i + 1]]] = False
            for j in others[same * (100 + least) >= (size[i] + size[others]) * least].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    links.append(sorted((int(node[f + i]), int(node[f + j]))))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _tiled(entries: DataFrame, sets: _Sets, least: int, distance: int) -> DataFrame:
    """Links (a, b) that join all similar nodes of different c that share an address, as forests: no pair is a row.

    Nodes that addresses connect are a group. A group falls into blocks of bounded bytes and texts, every two of which meet in a tile; small groups share one."""
    lead = entries.groupBy("address").agg(F.min("node").alias("lead"))
    stars = entries.join(lead, "address").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    groups = written(components(stars), "groups").select("node", F.col("component").alias("group"))
    nodes = entries.groupBy("node").agg(*(F.first(k).alias(k) for k in ("fp", "n", "c")), F.collect_set("address").alias("at"))
    size, own = 8 * F.col("n"), written(nodes.join(groups, "node"), "grouped")
    shared = pieces(own.agg(F.sum(size)).first()[0] or 0, _SETS)  # buckets of small groups
    parts = own.groupBy("group").agg(F.ceil(F.greatest(F.sum(size) / _SETS, F.count("*") / _NODES)).cast("int").alias("parts"))
    one, part, other = F.col("parts") <= 1, F.pmod(F.xxhash64("node"), F.col("parts")), F.col("other").cast("long")
    x = own.join(parts, "group").withColumn("part", F.when(one, F.lit(0).cast("long")).otherwise(part))
    x = x.join(sets.of(own.select(F.col("node").alias("key"))).withColumnRenamed("key", "node"), "node")
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)))
    room = F.when(one, F.pmod(F.xxhash64("group"), F.lit(shared))).otherwise(F.col("group"))
    x = x.select(room.alias("room"), F.least("part", other).alias("lo"), F.greatest("part", other).alias("hi"), "group", "part", "node", "fp", "n", "c", "at", "hs")
    return written(x.groupBy("room", "lo", "hi").applyInArrow(lambda t: _met(t, least, distance), "a long, b long"), "tiles")


def _named(entries: DataFrame, named: DataFrame | None) -> DataFrame:
    """Entries (address, node, fp, n, weight) with c, the component of their node."""
    return entries.withColumn("c", F.col("node")) if named is None else entries.join(named, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _led(entries: DataFrame, close: Column, similar) -> DataFrame | None:
    """(node, component) by links to leaders alone; None without any link. Each round, the leader of an address is the heaviest node outside the component that led before."""
    named, before = None, None
    for turn in range(LEADERS):
        now = _shared(_named(entries, named), "c")
        if before is not None:
            past = before.select("address", F.col("node").alias("past")).join(named.withColumnRenamed("node", "past"), "past", "left").select("address", F.coalesce("component", "past").alias("past"))
            free = now.join(past, "address", "left").where("past is null or c <> past").drop("past")
        else:
            free = now
        lead = free.groupBy("address").agg(F.max(F.struct("weight", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "fp", "n", "c")).alias("m")).select("address", "m.*").drop("h", "weight")
        before = lead = written(lead, "leaders")
        met = now.alias("a").join(lead.alias("b"), "address").where((F.col("a.c") != F.col("b.c")) & close)
        links = similar(met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct())
        if links.isEmpty():
            break
        named = written(components(links if named is None else links.union(named.select(F.col("node").alias("a"), F.col("component").alias("b")))), "led")
    return named


def simhash_dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 22, segments: int = 2, similarity: int | None = 80, repeats: bool = False, carry: Sequence[str] = (), hot: int = HOT
) -> DataFrame:
    """One row for each of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable by links), and the columns carried.

    A link: fingerprints that differ in distance bits or fewer and, unless similarity (percent) is None, shingle sets that are so similar.
    Without a similarity the segment tables serve the whole distance; with one they serve NEAR bits and bands the rest."""
    rows = cut(fingerprints(docs, id, text, shingle, repeats, carry, banded=similarity is not None).withColumn("node", F.col("fp" if similarity is None else "key")))
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    if similarity is None:
        links = matches(nodes.select("node", "fp", "n", F.col("node").alias("c")), distance, segments, hot=hot)
    else:
        nodes, sets = cut(nodes), _Sets(docs, id, text, shingle)
        may = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * similarity
        close = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance) & may

        def similar(pairs: DataFrame) -> DataFrame:
            return _similar(pairs, sets, similarity)

        entries = written(_shared(nodes.select("node", "fp", "n", F.explode("bands").alias("address")), "node"), "entries")
        # a node weighs as much as others share its addresses
        weight = entries.join(entries.groupBy("address").agg(F.count("*").alias("many")), "address").groupBy("node").agg(F.sum("many").alias("weight"))
        entries = written(entries.join(weight, "node"), "weighed")
        sets.of(entries.select("node").distinct().withColumnRenamed("node", "key"))
        led = _led(entries, close, similar)
        now = _shared(_named(entries, led), "c")
        near = matches(_named(nodes.select("node", "fp", "n"), led), min(distance, NEAR), segments, may, hot)
        links = _tiled(now, sets, similarity, distance).union(similar(near))
        links = links if led is None else links.union(led.select(F.col("node").alias("a"), F.col("component").alias("b")))
    own = cut(rows.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")))
    ids = own.groupBy("component").agg(F.min("id").alias("component_id"))
    return own.join(ids, "component").select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(F.col(f"own_{c}").alias(c) for c in carry))
