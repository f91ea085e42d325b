"""Dendrograms of all vectors, whatever the signs of their components; forests of tiles against all links."""

import numpy as np

from quarry.operators import hierarchy
from quarry.plans import queries


def _kruskal(unit, side=None, least=0.2):
    n, root, out = len(unit), list(range(len(unit))), []
    links = [(max(0, int(np.floor((1 - unit[i] @ unit[j]) * 1e6 + 0.5))), i, j) for i in range(n) for j in range(i + 1, n) if side is None or side[i] != side[j]]
    for h, i, j in sorted(x for x in links if x[0] <= round((1 - least) * 1e6)):
        a, b = i, j
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[b] = a
            out.append((h, i, j))
    return out


def test_tiles_hold_forests_in_few_links():
    rng = np.random.default_rng(4)
    v = np.r_[rng.normal(size=(60, 5)), np.repeat(rng.normal(size=(9, 5)), 5, axis=0)]
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    side = np.arange(len(v)) % 2
    for s in (None, side):
        for links, held in ((16, 1 << 22), (1, 20)):
            i, j, h = hierarchy._tile_forest(v, s, 0.2, links, held)
            assert list(zip(h.tolist(), i.tolist(), j.tolist())) == _kruskal(v, s)


def test_vectors_of_other_signs_are_linked(spark, tmp_path):
    v = np.full((6, 64), 1.0)
    for k in range(6):
        v[k, :k] = -0.1 * k  # alike, though the signs of their first components differ
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(i, j, h / 1e6) for h, i, j in _kruskal(v / np.sqrt((v * v).sum(axis=1, keepdims=True)))}
    assert len(want) == 5
    assert {tuple(r) for r in queries.QUERIES["dendrogram_merges"](spark, str(tmp_path)).collect()} == want
