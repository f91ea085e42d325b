"""Canopies in tiles that give back forests, against all links of the canopies."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import hierarchy


def test_forests_of_tiles_hold_the_forest_of_all_links(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=(150, 4)), 1)
    v[100:130] = v[:30]  # equal vectors: many ties
    rows = [(int(k), [float(c) for c in x]) for k, x in enumerate(v)] + [(150, None), (151, [0.0] * 4), (152, [1.0, None, 0.0, 0.0]), (153, [float("nan")] * 4), (154, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    near = [(i, j, float(np.floor((1 - unit[i] @ unit[j]) * 1e6 + 0.5) / 1e6)) for i in range(150) for j in range(i + 1, 150) if ((unit[i, :2] >= 0) == (unit[j, :2] >= 0)).all()]
    near = [x for x in near if x[2] <= 0.8]
    root, want = list(range(155)), set()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j, h in sorted(near, key=lambda x: (x[2], x[0], x[1])):
        if top(i) != top(j):
            root[max(top(i), top(j))] = min(top(i), top(j))
            want.add((i, j, h))
    nodes = df.select(F.col("vec_id").alias("node"))
    for block in (12, 1000):
        links = hierarchy.canopy_forest(df, "vec_id", "v", 2, 0.2, block)
        assert links.count() < len(near) / 3
        assert {tuple(r) for r in hierarchy.spanning_forest(nodes, links).collect()} == want
    assert hierarchy.canopy_forest(df.limit(0), "vec_id", "v", 2, 0.2).count() == 0
