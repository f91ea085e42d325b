"""Hierarchical (single-linkage) clustering: a minimum spanning forest of links by Boruvka rounds, cut at stated heights.

Each round, every component picks its lowest link to another one (ties by the ends of the link), the picked links join the forest, and
components that they connect become one by pointer jumping. A round at least halves the components that have links, so there are
log2(nodes) rounds at most, each cut off in the shared folder; no group is collected anywhere. The forest's links in the order of their heights are
the merges of the dendrogram; those up to a height leave the clusters at that height."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import staged


def contracted(parents: DataFrame) -> DataFrame:
    """(c, root) from parents (c, parent) in which each c appears once and chains end in a c that is its own parent: pointers are doubled until they stand."""
    x = parents.select("c", F.col("parent").alias("root"))
    while True:
        up = x.select(F.col("c").alias("root"), F.col("root").alias("next"))
        x = staged(x.join(up, "root").select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if x.where("moved").isEmpty():
            return x.select("c", "root")
        x = x.select("c", "root")


def spanning_forest(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, height): a minimum spanning forest of links (a, b, height) over nodes (node). Links to themselves, with nulls or ends outside the nodes do not count; parallel ones once."""
    labels = staged(nodes.where("node is not null").select("node", F.col("node").alias("c")).distinct())
    open_ = links.where("a <> b and height is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "height")
    open_ = staged(open_.groupBy("a", "b").agg(F.min("height").alias("height")).join(labels.select(F.col("node").alias("a")), "a", "left_semi").join(labels.select(F.col("node").alias("b")), "b", "left_semi"))
    found = []
    while True:
        ca, cb = labels.select(F.col("node").alias("a"), F.col("c").alias("ca")), labels.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        open_ = staged(open_.join(ca, "a").join(cb, "b").where("ca <> cb").select("a", "b", "height", "ca", "cb"))
        if open_.isEmpty():
            break
        least = F.min(F.struct("height", "a", "b", "other")).alias("m")
        ends = open_.select("a", "b", "height", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("other")))).alias("e"))
        picked = staged(ends.select("a", "b", "height", "e.*").groupBy("c").agg(least).select("c", "m.*"))
        found.append(picked.select("a", "b", "height").distinct())
        # two components that picked each other: the smaller is its own parent
        back = picked.select(F.col("c").alias("other"), F.col("other").alias("theirs"))
        parents = picked.join(back, "other", "left").select("c", F.when((F.col("theirs") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("parent"))
        rest = labels.select("c").distinct().join(picked.select("c"), "c", "left_anti").select("c", F.col("c").alias("parent"))
        roots = contracted(staged(parents.union(rest)))
        labels = staged(labels.join(roots, "c").select("node", F.col("root").alias("c")))
        open_ = open_.select("a", "b", "height")
    empty = open_.select("a", "b", "height")
    return reduce(DataFrame.union, found, empty)


def clusters_at(nodes: DataFrame, forest: DataFrame, height: float) -> DataFrame:
    """(node, cluster): the smallest node that links of the forest up to a height reach."""
    labels = staged(nodes.where("node is not null").select("node", F.col("node").alias("cluster")).distinct())
    links = staged(forest.where(F.col("height") <= height).select("a", "b"))
    both = links.union(links.select("b", "a"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("cluster").alias("m")), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
        hooked = labels.join(near, "node", "left").select("node", "cluster", F.least("cluster", F.coalesce("m", "cluster")).alias("least"))
        # a cluster takes the least that any of its members sees, so that whole clusters move at once
        parents = staged(hooked.groupBy(F.col("cluster").alias("c")).agg(F.min("least").alias("parent")))
        if parents.where("parent < c").isEmpty():
            return labels
        roots = contracted(parents)
        labels = staged(labels.join(roots.withColumnRenamed("c", "cluster"), "cluster").select("node", F.col("root").alias("cluster")))


def _kruskal(n: int, keys: np.ndarray) -> np.ndarray:
    """Of links between n nodes, as height << 40 | i << 20 | j, those of the minimum spanning forest, in order."""
    keys = np.unique(keys)
    root, at, kept = np.arange(n), np.arange(len(keys)), np.zeros(len(keys), dtype=bool)
    i, j = (keys >> 20) & 0xFFFFF, keys & 0xFFFFF
    while len(at):
        a, b = root[i], root[j]
        apart = a != b
        at, i, j, a, b = at[apart], i[apart], j[apart], a[apart], b[apart]
        if not len(at):
            break
        least = np.full(n, -1)
        least[np.c_[a, b].ravel()[::-1]] = np.repeat(np.arange(len(at)), 2)[::-1]  # the last to be written is the lowest link
        own = np.flatnonzero(least >= 0)
        pick = least[own]
        kept[at[pick]] = True
        to = np.arange(n)
        to[own] = np.where(a[pick] == own, b[pick], a[pick])
        both = (to[to] == np.arange(n)) & (np.arange(n) < to)  # picked each other
        to[both] = np.flatnonzero(both)
        while (to[to] != to).any():
            to = to[to]
        root = to[root]
    return keys[kept]


def _components(n: int, keys: np.ndarray) -> np.ndarray:
    root, i, j = np.arange(n), (keys >> 20) & 0xFFFFF, keys & 0xFFFFF
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _tile_forest(v: np.ndarray, side: np.ndarray | None, least: float, links: int = 16, held: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, height in steps of 1e-6) with i < j: a minimum spanning forest of unit vectors by links as below, ties by i and j; side: links lead to the other one only.

    Links are taken up by rising heights, at first about so many a vector, then eight times as many, until one component or the last height is
    reached; after the first step only vectors outside the largest component are multiplied, and only links between components count. A first look in single
    precision leaves room for its rounding. No more than about so many links are held."""
    n, top = len(v), int(np.floor((1 - least) * 1e6 + 1e-3))
    place, single = np.arange(n), v.astype(np.float32)
    forest, root, below = np.empty(0, dtype=np.int64), np.arange(n), -1
    ends = [(place, place)] if side is None else [(np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min()))]
    while below < top and (root != root[0]).any():
        if below >= 0:
            far = root != np.bincount(root).argmax()
            ends = [(g[far[g]], h) for g, h in (e[::k] for e in whole for k in (1, -1))]
        else:
            whole = ends
        # the height up to which about links * n links lie, by some rows of what is looked at
        some = [(g[:: max(1, len(g) // 128)], h) for g, h in ends if len(g) and len(h)]
        if not some:
            break
        near, share = [], sum(len(g) * len(h) for g, h in ends) / sum(len(g) * len(h) for g, h in some)
        for g, h in some:
            s = single[g] @ single[h].T
            near.append(s[(root[g][:, None] != root[h]) & (s >= np.float32(least - 1e-5))])
        near = np.concatenate(near)
        want = int(links * n / share)
        height = top if len(near) <= want else min(top, max(below + 1, int(np.ceil((1 - float(-np.partition(-near, want)[want])) * 1e6))))
        found, count = [forest], len(forest)
        bound = np.float32(1 - (height + 1) * 1e-6 - 1e-5)
        for g, h in ends:
            if not len(g) or not len(h):
                continue
            home, step = np.ascontiguousarray(single[h].T), max(1, (1 << 21) // len(h))
            for lo in range(0, len(g), step):
                i, j = np.divmod(np.flatnonzero(single[g[lo : lo + step]] @ home >= bound), len(h))
                i, j = g[lo + i], h[j]
                i, j = np.minimum(i, j), np.maximum(i, j)
                other = root[i] != root[j]
                i, j = i[other], j[other]
                steps = np.maximum(np.floor((1 - np.einsum("ij,ij->i", v[i], v[j])) * 1e6 + 0.5).astype(np.int64), 0)
                ok = (steps <= height) & (i != j)
                found.append((steps[ok] << 40) | (i[ok] << 20) | j[ok])
                count += len(found[-1])
                if count > held:
                    found = [_kruskal(n, np.concatenate(found))]
                    count = len(found[0])
        forest = _kruskal(n, np.concatenate(found))
        root, below, links = _components(n, forest), height, 8 * links
    return (forest >> 20) & 0xFFFFF, forest & 0xFFFFF, forest >> 40


def canopy_forest(rows: DataFrame, id: str, vector: str, bits: int, least: float, block: int = 16384) -> DataFrame:
    """(a, b, height): links of vectors that agree in the signs of their first components (so many bits; 0: all vectors) and have a cosine of least or more, as far as a minimum spanning forest may hold them.

    height is 1 minus the cosine, in 6 decimals. Vectors meet in canopies only, and there in tiles of two blocks of so many at most, in the mean, each of
    which gives back a minimum spanning forest of its own links: what it leaves out is the highest link of some circle (ties by height, a, b), so the forest
    of what is given back is that of all links. Forests of tiles that share blocks are merged likewise, 16 at a time, while they have a million nodes
    at most. A vector that is null, zero or holds a null or a number that is not finite has no links."""
    kind = "float" if rows.schema[vector].dataType.elementType.typeName() == "float" else "double"
    x = rows.select(F.col(id).cast("long").alias("id"), F.transform(F.col(vector), lambda c: c.cast(kind)).alias("v"))
    x = x.where(F.col("id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    x = staged(x.withColumn("canopy", F.array_join(F.transform(F.slice("v", 1, bits), lambda c: F.when(c >= 0, "1").otherwise("0")), "") if bits else F.lit("")).withColumn("dim", F.size("v")))
    # one row a canopy; at least eight blocks where they are not small
    blocks = F.greatest(F.ceil(F.count("*") / block), F.least(F.lit(8), F.ceil(F.count("*") / 1536)))
    sizes = staged(x.groupBy("canopy", "dim").agg(blocks.cast("int").alias("blocks")))
    tiles, most = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long"), F.max("blocks")).first()
    x = x.join(F.broadcast(sizes), ["canopy", "dim"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("mine", "other")).withColumn("q", F.greatest("mine", "other"))

    def each(t):
        import pyarrow as pa

        t = t.sort_by("id")
        ids, side = t.column("id").to_numpy(), t.column("mine").to_numpy()
        v = np.asarray(pa.concat_arrays(t.column("v").chunks).flatten()).reshape(len(ids), -1).astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        i, j, height = _tile_forest(v, side if t.column("p")[0] != t.column("q")[0] else None, least)
        return pa.table({"canopy": pa.repeat(t.column("canopy")[0], len(i)), "dim": pa.repeat(t.column("dim")[0], len(i)), "p": pa.repeat(t.column("p")[0], len(i)), "q": pa.repeat(t.column("q")[0], len(i)), "a": ids[i], "b": ids[j], "height": height})

    def merge(t):
        import pyarrow as pa

        a, b, height = (t.column(c).to_numpy() for c in ("a", "b", "height"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        keys = _kruskal(len(ids), (height << 40) | (at[: len(a)] << 20) | at[len(a) :])
        i, j = (keys >> 20) & 0xFFFFF, keys & 0xFFFFF
        return pa.table({"canopy": pa.repeat(t.column("canopy")[0], len(i)), "dim": pa.repeat(t.column("dim")[0], len(i)), "p": pa.repeat(t.column("p")[0], len(i)), "q": pa.repeat(t.column("q")[0], len(i)), "a": ids[i], "b": ids[j], "height": keys >> 40})

    keys, schema = ["canopy", "dim", "p", "q"], "canopy string, dim int, p int, q int, a long, b long, height long"
    x = x.select(*keys, "id", "mine", "v").repartition(min(2 * (tiles or 1), 4096), *keys)
    out, wide = x.groupBy(*keys).applyInArrow(each, schema), block
    while (most or 0) > 2 and 8 * wide <= 1 << 20:
        out = out.withColumn("p", F.floor(F.col("p") / 4).cast("int")).withColumn("q", F.floor(F.col("q") / 4).cast("int")).groupBy(*keys).applyInArrow(merge, schema)
        most, wide = -(-most // 4), 4 * wide
    return out.select("a", "b", (F.col("height") / 1e6).alias("height"))
