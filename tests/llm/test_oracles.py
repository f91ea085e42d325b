"""The queries with SQL, held against it in DuckDB on small tables of hard cases."""

import math
import random

import duckdb
import pytest
import xxhash

from quarry.llm import oracles, queries

from .helpers import SCHEMA, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(7), tmp_path_factory.mktemp("tables")
    texts = corpus(3, 150)
    texts += [t.upper() for t in texts if t and len(t) > 50][:15]
    texts += [t.replace("b", "c", 1) for t in texts if t and len(t) > 200][:20]
    texts.append(" ".join(r.choice(["x", "yy", "é" * 40, "漢"]) for _ in range(3000)))
    ids = r.sample(range(10 * len(texts)), len(texts))
    rows = [(i, t, None, r.choice(["a", "a", "a", "É", "z", None, "n" * 50]), None, 1, "x", None) for i, t in zip(ids, texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vectors = [None, [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]
    vectors += [[x + r.gauss(0, s) for x in r.choice(base)] for s in (0.0, 0.02, 0.2, 0.35) for _ in range(25)]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    turns = [(c, k, r.choice(["user", "assistant", "system"]), r.choice([None, "", "\\", "<|x|>", "\\<|", "é <| \\n", t])) for c, t in enumerate(texts[:20]) for k in range(r.randint(1, 4))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def said(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", oracles.ORACLES)
def test_query_against_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = db.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert said(tuple(r) for r in got.select(*columns).collect()) == said(want.fetchall())


def test_hash_in_sql():
    r = random.Random(2)
    cases = [(r.randbytes(n), r.choice([0, 42, r.getrandbits(64)])) for n in [*range(70), 127, 128, 1000]]
    db = duckdb.connect()
    db.execute("CREATE TABLE t (k INT, hx VARCHAR, sd UHUGEINT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, b.hex(), s) for k, (b, s) in enumerate(cases)])
    got = dict(db.execute(f"WITH {oracles._xxh64('t', 'out')} SELECT k, h FROM out").fetchall())
    assert got == {k: xxhash.xxh64_intdigest(b, s) for k, (b, s) in enumerate(cases)}
