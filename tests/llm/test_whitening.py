import math

import numpy as np
import pytest

from quarry.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, id string, x int, component int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, "own", 1, 2) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def wanted(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def same(got, vectors, components=8):
    """got: rows whose identifiers are the places of vectors."""
    n, deviation, whitened, explained = wanted(vectors, components)
    k = whitened.shape[1]
    assert len(got) == len(vectors) * k and all(x.n == n and x.deviation == deviation[x.vec_id] and x.identity_error < 1e-10 for x in got)
    own = np.zeros_like(whitened)
    for x in got:
        own[x.vec_id, x.component - 1] = x.whitened
        assert abs(x.explained / explained[x.component - 1] - 1) < 1e-9
    assert all(min(np.abs(own[:, j] - whitened[:, j]).max(), np.abs(own[:, j] + whitened[:, j]).max()) < 1e-8 for j in range(k))


def cloud(n, d, seed=1):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) @ (r.standard_normal((d, d)) * np.linspace(1, 0.1, d))).tolist()


def test_against_dense_algebra(spark):
    vectors = cloud(300, 40)
    vectors += vectors[:20]
    same(whitening.whiten(table(spark, vectors).repartition(3)).collect(), vectors)


def test_query_drops_odd_vectors(spark, tmp_path):
    vectors = cloud(200, 64, 2)
    odd = [None, [], [None] + [1.0] * 63, [math.nan] + [1.0] * 63, [math.inf] + [1.0] * 63, [1.0, 2.0], [1e300] + [0.0] * 63]
    table(spark, vectors + odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(queries.op12_embedding_whitening(spark, str(tmp_path)).collect(), vectors)


def test_null_identifiers_and_repeated_rows_count(spark):
    vectors = cloud(50, 5, 3)
    out = whitening.whiten(table(spark, [*vectors, vectors[0], vectors[1]], [*range(50), 0, None])).collect()
    assert len(out) == 52 * 5 and all(x.n == 52 for x in out) and sum(x.vec_id is None for x in out) == 5 and sum(x.vec_id == 0 for x in out) == 10


def test_few_or_flat_dimensions(spark):
    same(whitening.whiten(table(spark, cloud(40, 3, 4))).collect(), cloud(40, 3, 4), 3)
    flat = [[x[0], 2 * x[0], 0.0, x[1]] for x in cloud(30, 2, 5)]
    got = whitening.whiten(table(spark, [[math.floor(c * 1024) / 1024 for c in v[:1]] + [2 * math.floor(v[0] * 1024) / 1024, 0.0, v[3]] for v in flat])).collect()
    assert {x.component for x in got} == {1, 2} and all(x.identity_error < 1e-9 for x in got)
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    for vectors in ([], [None], [[]]):
        out = whitening.whiten(table(spark, vectors))
        assert out.count() == 0 and out.columns[0] == "vec_id"


def test_large_numbers_stay_exact(spark):
    vectors = [[1e4 * a, 100 * b] for a, b in cloud(300, 2, 6)]
    n, deviation, *_ = wanted(vectors)
    got = whitening.whiten(table(spark, vectors)).collect()
    assert len(got) == 600 and {x.deviation is None for x in got} == {True, False} and all(x.deviation == (deviation[x.vec_id] if deviation[x.vec_id] < 1 << 63 else None) for x in got)


@pytest.mark.parametrize("spectrum", [np.linspace(1, 2, 200), np.r_[np.ones(150), np.full(50, 3.0)], 0.5 ** np.arange(200)])
def test_lobpcg(spectrum):
    r = np.random.default_rng(7)
    q = np.linalg.qr(r.standard_normal((200, 200)))[0]
    a, calls = (q * spectrum) @ q.T, []

    def product(block):
        calls.append(block.shape[1])
        return a @ block

    values, vectors, residual, rounds = whitening.lobpcg(product, 200, 8)
    assert np.abs(values - np.sort(spectrum)[::-1][:8]).max() < 1e-10 and residual < 1e-11 and len(calls) <= rounds + 5 and max(calls) <= 16
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12 and np.abs(a @ vectors - vectors * values).max() < 1e-10
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(product, 200, 8, rounds=1)
