"""Total orders over partitions, the ROC curve and the stemmer."""

import pytest
from pyspark.sql import functions as F

from quarry.config import EngineConfig
from quarry.functions.stem import english, porter
from quarry.operators import metrics, order, terms
from quarry.sources import readers


def test_numbers_are_dense_whatever_the_partitions(spark):
    """Wide rows in small partitions: a count of fewer columns would be coalesced otherwise."""
    n, old = 20_000, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        items = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(n))).alias("key"), F.repeat(F.lit("x"), 200).alias("content"))
        got = readers.numbered(items, ["key"], "item").select("key", "item").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(got) == n and all(r.key == r.item for r in got)
    assert readers.numbered(spark.createDataFrame([], "key long"), ["key"], "item").collect() == []


def test_running_sums(spark):
    rows = spark.range(0, 1000, 1, 7).select("id", (F.col("id") % 5).alias("x"))
    got = {r.id: r.running_x for r in order.running(rows, [F.desc("id")], ["x"]).collect()}
    assert got == {i: sum(j % 5 for j in range(i, 1000)) for i in range(1000)}


def test_roc_against_pairs(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (0, 0.05), (None, 0.7), (1, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    known = [(y, s) for y, s in rows if y is not None and s is not None]
    got = {r.threshold: (r.tp, r.fp) for r in metrics.roc(df, "y", "s").collect()}
    assert got == {t: (sum(y == 1 and s >= t for y, s in known), sum(y == 0 and s >= t for y, s in known)) for t in {s for _, s in known}}
    pairs = [(a > b) + (a == b) / 2 for y, a in known if y == 1 for z, b in known if z == 0]
    assert metrics.auc(df, "y", "s").first().auc == round(sum(pairs) / len(pairs), 6)
    one = metrics.auc(df.where("y = 1"), "y", "s").first()
    assert (one.positives, one.negatives, one.auc) == (3, 0, None)
    assert metrics.roc(df.limit(0), "y", "s").collect() == []


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
     ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("electrical", "electr"), ("adoption", "adopt"), ("replacement", "replac"), ("rate", "rate"),
     ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil"), ("cafés", "cafés"), ("is", "is")],
)
def test_porter(word, stem):
    assert porter(word) == stem


def test_stems_take_the_place_of_lemmas(spark):
    docs = spark.createDataFrame([(0, "running runs run"), (1, None), (2, "")], "doc_id long, text string")
    got = terms.term_counts(docs, EngineConfig(stopwords=()), terms.stem_table(docs, EngineConfig(stopwords=())))
    assert [(r.doc_id, r.stem, r.cnt) for r in got.collect()] == [(0, "run", 3)]


def test_english():
    pairs = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
    consistently consist consolation consol consolations consol consolatory consolatori consolidate consolid knack knack knackeries knackeri knavish knavish
    kneaded knead kneeling kneel knightly knight knots knot cries cri ties tie by by say say generate generat generously generous communism communism
    dying die skies sky news news hopping hop hoping hope falling fall fizzed fizz bed bed succeed succeed ugly ugli relational relat argument argument
    happily happili rationally ration ability abil national nation gas gas this this kiwis kiwi luxuriated luxuri feudally feudal shed shed youth youth""".split()
    assert [(w, english(w)) for w in pairs[::2]] == list(zip(pairs[::2], pairs[1::2]))
    assert english("café") == "café" and english("x1y") == "x1y" and english("") == ""
