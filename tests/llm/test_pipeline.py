import random

import corpus_pipeline
from pyspark.sql import functions as F

from quarry.llm import mixing, quality_crf, sentencepiece_codec
from quarry.llm.simhash import shingle_set

from .helpers import corpus, docs
from .test_simhash import edited, grouped

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns of documents, of names that stages use themselves.
ODD = ["times", "key", "_key", "_", "doc", "at", "ids", "score", "kept", "component_id", "size", "col"]


def table(spark, path, texts, sources):
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own " + c) for c in ODD})
    docs.union(docs.where("doc_id % 9 = 0")).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("$$$" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    texts = corpus(11, 120)
    texts += [" ".join(w + "$$$" for w in r.choices(["house", "river", "near"], k=20)) for _ in range(20)] + texts[8:30]
    base = [f"b{k}" for k in range(150)]
    texts += [" ".join(base), *(edited(r, base, 2) for _ in range(6))]
    sources = [r.choice(["a", "b", "c", None]) for _ in texts]
    table(spark, tmp_path, texts, sources)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    seen = []

    def step(name):
        nonlocal docs
        docs = stages[name](spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen.append(sorted(x.doc_id for x in docs.select("doc_id").collect()))
        return seen[-1]

    model = quality_crf.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    good = sorted(x.doc_id for x in quality_crf.score(docs, model).where("score >= 0.3").collect())
    assert step("quality") == good and len(good) < len(texts)
    last = {}
    for i in good:
        last[texts[i] or ""] = i
    assert step("exact_dedup") == sorted(last.values())  # of rows with one doc_id and text, too, one stays
    ids = seen[-1]
    own = [set(shingle_set((texts[i] or "").encode()).tolist()) for i in ids]
    first = grouped(len(ids), lambda i, j: 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]))
    assert step("simhash_dedup") == sorted({ids[k] for k in first}) and len(seen[-1]) < len(ids) - 5
    times = {x.doc_id: round(x.taken / x.size) if x.size else 1 for x in mixing.mix(docs).collect()}
    assert step("mixing") == sorted(i for i, k in times.items() for _ in range(k))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *ODD] and docs.where("times <> 'own times' or ids <> 'own ids'").isEmpty()
    e = sentencepiece_codec.Encoder()
    out = stages["sentencepiece"](spark, docs, sf).collect()
    assert sorted(x.doc_id for x in out) == seen[-1]
    for x in out:
        assert (x.ids is None) == (texts[x.doc_id] is None)
        if x.ids:
            assert x.ids == e.encode([texts[x.doc_id]])[0].tolist()
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, sf).collect()) == seen[-1]


def test_empty(spark, tmp_path):
    table(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_stage_drops_near_copies(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    own = [" ".join(base), *(edited(r, base, 3) for _ in range(5)), " ".join(base[:100])]
    out = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs(spark, own), "")
    assert sorted(x.doc_id for x in out.collect()) == [0, 6]


def test_rows_that_share_an_identifier(spark):
    own = docs(spark, ["one two", "one two", "other text", None, "", "three"], [1, 1, 1, None, None, 2])
    out = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, own, "")
    assert sorted((str(x.doc_id), x.text or "") for x in out.collect()) == [("1", "one two"), ("1", "other text"), ("2", "three"), ("None", "")]
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, out, "")
    assert {x.doc_id for x in out.collect()} <= {1, 2, None}
