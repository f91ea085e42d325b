"""Registered queries of the document engine and their SQL. Each runs over its whole tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STOPWORDS, EngineConfig
from ..functions import text as fn
from ..functions.stem import english
from ..operators import classify, cluster, hierarchy, incremental, machines, metrics, mining, similarity, terms
from ..operators.corpus import Corpus
from ..operators.order import shared_dir, staged
from ..operators.vectors import Vectors
from ..sources import readers, writers
from ..streaming import frequencies, scoring

CONFIG = EngineConfig(centers=5, iterations=2, k=10)
ITEM_LIMIT = 500
LEMMAS = (("inches", "inch"), ("onshes", "onsh"), ("ndes", "nd"), ("eaux", "eau"), ("des", "de"))

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _asked(id: str = "doc_id") -> Column:
    """The stated set of queries: identifiers divisible by 100."""
    return F.col(id) % 100 == 0


def _r(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.tfidf(_docs(spark, sf_dir), CONFIG)


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(_docs(spark, sf_dir), CONFIG)


def _ranked(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(_docs(spark, sf_dir), CONFIG, ranked=True)


def _labels(spark: SparkSession, sf_dir: str, doc_terms: DataFrame | Vectors, iterations: int = 2) -> DataFrame:
    ids = _docs(spark, sf_dir).select("doc_id")
    centers = [r.doc_id for r in cluster.initial_centers(ids, CONFIG.centers).collect()]
    return cluster.cluster(ids, doc_terms, centers, EngineConfig(iterations=iterations))


def _near(spark: SparkSession, sf_dir: str, exclude_self: bool = True) -> tuple[DataFrame, DataFrame, Corpus]:
    """(neighbours, labels, corpus)."""
    corpus = _corpus(spark, sf_dir)
    labels = staged(_labels(spark, sf_dir, corpus.vectors))
    stated = _docs(spark, sf_dir).where(_asked())  # those without terms, too
    near = classify.neighbors(corpus.vectors.rows.where(_asked()), corpus.vectors, labels, CONFIG, exclude_self, stated)
    return staged(near), labels, corpus


def _machine_labels(near: DataFrame, labels: DataFrame, corpus: Corpus) -> DataFrame:
    """(new_id, svm_class) of the stated documents."""
    voted, rows = classify.candidates(near), corpus.scaled
    return classify.svm_label(machines.votes(classify.class_pairs(voted), labels, rows, rows.where(_asked()), CONFIG.svm_c), voted)


# --- SQL: blocks that queries share

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_NORM = r"lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]+', ' ', 'g'))"
_BASE = rf"""
    toks AS (SELECT doc_id, list_filter(string_split({_NORM}, ' '), lambda w: w <> '') AS ws FROM documents),
    toks2 AS (SELECT doc_id, ws, list_filter(ws, lambda w: w NOT IN ({_STOP})) AS ts FROM toks),
    wc AS (SELECT doc_id, len(ws) AS n_words, len(ts) AS n_nonstop, len(ws) + len(ts) AS word_count, ts FROM toks2),
    ex AS (SELECT doc_id, unnest(ts) AS stem FROM wc),
    tc AS (SELECT doc_id, stem, count(*) AS cnt FROM ex GROUP BY ALL),
    tf AS (SELECT tc.doc_id, stem, cnt, floor(cnt / CAST(word_count AS DOUBLE) * 100000.0::DOUBLE) / 100000.0::DOUBLE AS tf FROM tc JOIN wc USING (doc_id)),
    idf AS (SELECT stem, count(*) AS df, 1 + ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM tc GROUP BY stem),
    dt AS (SELECT doc_id, stem, cnt, tf, idf, tf * idf AS tf_idf FROM tf JOIN idf USING (stem)),
    nrm AS (SELECT doc_id, count(*) AS n_terms, sqrt(sum(tf_idf * tf_idf)) AS norm FROM dt GROUP BY doc_id),
    unit AS (SELECT dt.doc_id, stem, tf_idf / norm AS w FROM dt JOIN nrm USING (doc_id) WHERE norm > 0)"""


def _snap(x: str) -> str:
    return f"floor({x} * 1000.0::DOUBLE + 0.000001::DOUBLE) / 1000.0::DOUBLE"


def _with(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([_BASE, *more]) + "\n" + body


_CENTERS0 = "c0 AS (SELECT doc_id AS center_id FROM documents ORDER BY (doc_id * 7919) % 1000003, doc_id LIMIT 5)"


def _assign(c: str, out: str) -> str:
    return f"""
    {out}_s AS (
        SELECT u.doc_id, v.doc_id AS center_id, {_snap("sum(u.w * v.w)")} AS sim FROM unit u JOIN unit v USING (stem) WHERE v.doc_id IN (SELECT center_id FROM {c}) AND u.doc_id <> v.doc_id GROUP BY ALL
        UNION ALL SELECT center_id, center_id, 1.0 FROM {c}
        UNION ALL SELECT doc_id, (SELECT min(center_id) FROM {c}), 0.0 FROM documents),
    {out} AS (SELECT doc_id, center_id, sim FROM {out}_s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, center_id) = 1)"""


def _reselect(a: str, out: str) -> str:
    return f"""
    {out}_d AS (SELECT center_id, doc_id, round(abs(sim - avg(sim) OVER (PARTITION BY center_id)), 9) AS diff, count(*) OVER (PARTITION BY center_id) AS n FROM {a}),
    {out}_b AS (SELECT center_id, doc_id FROM {out}_d WHERE diff > 0.1 AND n > 1 QUALIFY row_number() OVER (PARTITION BY center_id ORDER BY diff, doc_id DESC) = 1),
    {out}_n AS (SELECT k.center_id, coalesce(b.doc_id, k.center_id) AS next_center FROM (SELECT DISTINCT center_id FROM {a}) k LEFT JOIN {out}_b b USING (center_id)),
    {out} AS (SELECT DISTINCT next_center AS center_id FROM {out}_n)"""


_CLUSTERED = (_CENTERS0, _assign("c0", "a1"), _reselect("a1", "c1"), _assign("c1", "a2"))
_NEAR = f"""
    asked AS (SELECT doc_id AS new_id FROM documents WHERE doc_id % 100 = 0),
    sims AS (SELECT u.doc_id AS new_id, v.doc_id, {_snap("sum(u.w * v.w)")} AS sim FROM unit u JOIN unit v USING (stem) WHERE u.doc_id % 100 = 0 AND u.doc_id <> v.doc_id GROUP BY ALL),
    near AS (
        SELECT new_id, row_number() OVER (PARTITION BY new_id ORDER BY z.sim DESC, doc_id) AS rank, doc_id, z.sim AS sim, center_id AS class
        FROM (SELECT new_id, d.doc_id, coalesce(sim, 0.0) AS sim FROM asked JOIN documents d ON new_id <> d.doc_id LEFT JOIN sims USING (new_id, doc_id)) z JOIN a2 USING (doc_id)
        QUALIFY rank <= 10)"""
_KNN = (*_CLUSTERED, _NEAR)
_VOTED = "voted AS (SELECT new_id, class, count(*) AS votes, min(rank) AS first_rank FROM near GROUP BY ALL)"


# --- sources


@query(f"SELECT doc_id, source, n_chars FROM documents WHERE doc_id < {ITEM_LIMIT} AND NOT (source = 'src0')")
def redirect_filter_limit(spark, sf_dir):
    """The item limit counts redirects (here: one source's rows)."""
    items = _docs(spark, sf_dir).withColumn("redirect_title", F.when(F.col("source") == "src0", "x"))
    return readers.without_redirects(readers.limited(items, ITEM_LIMIT)).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS item_id FROM documents")
def dense_item_ids(spark, sf_dir):
    return readers.numbered(_docs(spark, sf_dir).select("doc_id", "source"), ["source", "doc_id"], "item_id").select("doc_id", "item_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id >= 100 AND doc_id < 200")
def id_range_scan(spark, sf_dir):
    return readers.id_range(_docs(spark, sf_dir), 100, 100).select("doc_id", "n_chars")


@query("SELECT max(doc_id) AS largest_id, count(*) AS n_docs, count(*) FILTER (source = 'src0') AS n_redirects, count(*) = 0 AS is_empty FROM documents")
def corpus_counters(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.max("doc_id").alias("largest_id"), F.count("*").alias("n_docs"), F.count_if(F.col("source") == "src0").alias("n_redirects"), (F.count("*") == 0).alias("is_empty"))


@query("SELECT doc_id, title, text FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, 'doc_' || doc_id AS title, coalesce(text, '') AS text, source FROM documents) WHERE source IS DISTINCT FROM 'src0'")
def dump_round_trip(spark, sf_dir):
    """All documents as a page dump of many files, written and read back: one source's documents are redirects, every seventh page has a second revision."""
    docs = _docs(spark, sf_dir)
    to = F.when(F.col("source") == "src0", F.lit("elsewhere"))
    second = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("an older text")))
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    writers.save_dump(docs.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("title"), "text", to.alias("redirect_title"), second.alias("revisions")), path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return readers.corpus_from_xml(spark, path)


# --- terms


@query(f"SELECT doc_id, {_NORM} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fn.normalized(F.coalesce("text", F.lit(""))).alias("norm"))


@query(_with("SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_nonstop AS BIGINT) AS n_nonstop, CAST(word_count AS BIGINT) AS word_count FROM wc"))
def word_counts(spark, sf_dir):
    return terms.tokenized(_docs(spark, sf_dir), CONFIG).drop("tokens")


@query(_with("SELECT doc_id, array_to_string(ts, ' ') AS kept FROM wc"))
def stopword_filtered(spark, sf_dir):
    return terms.tokenized(_docs(spark, sf_dir), CONFIG).select("doc_id", F.array_join("tokens", " ").alias("kept"))


@query(_with("SELECT doc_id, stem, cnt FROM tc"))
def term_counts(spark, sf_dir):
    return terms.term_counts(_docs(spark, sf_dir), CONFIG).select("doc_id", "stem", "cnt")


@query(
    _with(
        "SELECT doc_id, coalesce(lemma, stem) AS stem, CAST(sum(cnt) AS BIGINT) AS cnt FROM tc LEFT JOIN lemmas ON stem = word GROUP BY ALL",
        "lemmas(word, lemma) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEMMAS) + ")",
    )
)
def lemmatized_counts(spark, sf_dir):
    lemmas = spark.createDataFrame(LEMMAS, "word string, lemma string")
    return terms.term_counts(_docs(spark, sf_dir), CONFIG, lemmas).select("doc_id", "stem", "cnt")


@query(
    _with(
        """SELECT word, lemma FROM (SELECT v.word, substring(v.word, 1, length(v.word) - length(e.old)) || e.new AS lemma FROM vocabulary v JOIN endings e ON ends_with(v.word, e.old) AND length(v.word) > length(e.old))
        WHERE lemma IN (SELECT word FROM vocabulary) QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(lemma), lemma) = 1""",
        "vocabulary AS (SELECT DISTINCT stem AS word FROM ex)",
        "endings(old, new) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in terms.NOUN_ENDINGS) + ")",
    )
)
def noun_lemmas(spark, sf_dir):
    """The vocabulary of the documents is both what is lemmatised and what lemmas are checked against."""
    words = terms.term_counts(_docs(spark, sf_dir), CONFIG).select(F.col("stem").alias("word")).distinct()
    return terms.noun_lemmas(words, words)


@query()
def stemmed_counts(spark, sf_dir):
    """Term counts by English stems."""
    return _corpus(spark, sf_dir).counts_by(english)


@query(_with("SELECT doc_id, stem, tf FROM tf"))
def term_frequency(spark, sf_dir):
    return terms.term_frequency(terms.term_counts(_docs(spark, sf_dir), CONFIG), CONFIG).select("doc_id", "stem", "tf")


@query(_with("SELECT stem, df FROM idf"))
def document_frequency(spark, sf_dir):
    return terms.document_frequency(terms.term_counts(_docs(spark, sf_dir), CONFIG))


@query(_with("SELECT stem, df FROM idf"))
def incremental_document_frequency(spark, sf_dir):
    """The frequencies of all documents, reached by a base and two deltas: new documents; texts put right, and strangers deleted again."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.lit(False).alias("deleted"))
    strangers = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select((-1 - F.col("item_id")).alias("doc_id"), "text", F.lit(False).alias("deleted"))
    wrong = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text")))
    table = incremental.TokenTable(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", CONFIG)
    table.apply("base", wrong.union(strangers))
    table.apply("new", docs.where("doc_id % 3 = 0"))
    table.apply("right", docs.where("doc_id % 5 = 0").union(strangers.withColumn("deleted", F.lit(True))))
    return table.document_frequency()


@query(_with("SELECT stem, df FROM idf"))
def streamed_document_frequency(spark, sf_dir):
    """The frequencies of all documents, arrived in two deliveries: two thirds of them, then all, the first two thirds again; the stream stops in between."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for arrived in (docs.where("doc_id % 3 <> 0"), docs):
        arrived.write.mode("append").parquet(f"{at}/in")
        frequencies.count_stream(scoring.documents(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint", CONFIG).awaitTermination()
    return frequencies.counted(spark, f"{at}/out")


@query(_with("SELECT stem, df, round(idf, 6) AS idf FROM idf"))
def inverse_document_frequency(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return terms.inverse_document_frequency(terms.term_counts(docs, CONFIG), docs).select("stem", "df", _r("idf"))


@query(_with("SELECT doc_id, stem, cnt, tf, round(idf, 6) AS idf, round(tf_idf, 6) AS tf_idf FROM dt"))
def tfidf(spark, sf_dir):
    return _terms(spark, sf_dir).select("doc_id", "stem", "cnt", "tf", _r("idf"), _r("tf_idf"))


@query(_with("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf_idf, 9) DESC, stem) AS rank, stem, round(tf_idf, 6) AS tf_idf FROM dt QUALIFY rank <= 5"))
def top_tokens(spark, sf_dir):
    return terms.top_tokens(_corpus(spark, sf_dir).heaviest(5)).select("doc_id", F.col("rank").cast("long").alias("rank"), "stem", _r("tf_idf"))


@query(_with("SELECT doc_id, n_terms, round(norm, 6) AS norm FROM nrm"))
def doc_norms(spark, sf_dir):
    return _corpus(spark, sf_dir).norms().select("doc_id", "n_terms", _r("norm"))


@query(
    _with(
        """SELECT item_id, stem, round(floor(n / CAST(wc AS DOUBLE) * 100000.0::DOUBLE) / 100000.0::DOUBLE * coalesce(idf, 1 + ln((SELECT count(*) FROM documents)::DOUBLE + 1)), 6) AS tf_idf
        FROM (SELECT item_id, stem, wc, count(*) AS n FROM (SELECT item_id, len(ws) + len(ts) AS wc, unnest(ts) AS stem FROM b2) GROUP BY ALL) LEFT JOIN idf USING (stem)""",
        f"b1 AS (SELECT item_id, list_filter(string_split({_NORM}, ' '), lambda w: w <> '') AS ws FROM benchmark)",
        f"b2 AS (SELECT item_id, ws, list_filter(ws, lambda w: w NOT IN ({_STOP})) AS ts FROM b1)",
    )
)
def new_doc_tfidf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    idf = terms.inverse_document_frequency(terms.term_counts(docs, CONFIG), docs)
    new = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return terms.tfidf_of_new(new, idf, docs.agg(F.count("*").alias("n_docs")), CONFIG).select(F.col("doc_id").alias("item_id"), "stem", _r("tf_idf"))


@query(_with("SELECT gram, CAST(sum(c) AS BIGINT) AS cnt, count(*) AS df FROM (SELECT doc_id, gram, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1])) AS gram FROM wc WHERE len(ts) >= 2) GROUP BY ALL) GROUP BY gram"))
def bigram_counts(spark, sf_dir):
    return mining.ngram_counts(_docs(spark, sf_dir), 2, CONFIG)


@query(_with("SELECT doc_id, stem, printf('%-20s count: %3d  tf: %.5f', stem, cnt, tf) AS line FROM tf"))
def token_lines(spark, sf_dir):
    x = terms.term_frequency(terms.term_counts(_docs(spark, sf_dir), CONFIG), CONFIG)
    return x.select("doc_id", "stem", F.format_string("%-20s count: %3d  tf: %.5f", "stem", "cnt", "tf").alias("line"))


@query("SELECT doc_id, lower(source) IN ('yes', 'true', 't', '1') AS source_flag, lower(CAST(quality AS VARCHAR)) IN ('yes', 'true', 't', '1') AS quality_flag, doc_id + n_chars * 10 AS cell FROM documents LEFT JOIN labels USING (doc_id)")
def scalar_functions(spark, sf_dir):
    x = _docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return x.select("doc_id", fn.as_bool(F.col("source")).alias("source_flag"), fn.as_bool(F.col("quality").cast("string")).alias("quality_flag"), fn.flat_index(F.col("doc_id"), F.col("n_chars"), 10).alias("cell"))


# --- similarity


@query(_with(f"SELECT u.doc_id AS doc_a, v.doc_id AS doc_b, {_snap('sum(u.w * v.w)')} AS sim FROM unit u JOIN unit v USING (stem) WHERE u.doc_id > v.doc_id GROUP BY ALL"))
def pairwise_cosine(spark, sf_dir):
    return similarity.pairwise_cosine(_ranked(spark, sf_dir).vectors, CONFIG)


@query(
    _with(
        "SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n, 0) AS n_links FROM documents d LEFT JOIN same USING (doc_id) LEFT JOIN linked USING (doc_id)",
        "same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM (SELECT doc_id, string_agg(stem || ' ' || tf, ',' ORDER BY stem) AS k FROM tf JOIN unit USING (doc_id, stem) GROUP BY doc_id))",
        f"linked AS (SELECT doc_id, count(*) AS n FROM (SELECT u.doc_id, v.doc_id AS other FROM unit u JOIN unit v USING (stem) WHERE u.doc_id <> v.doc_id GROUP BY ALL HAVING {_snap('sum(u.w * v.w)')} >= 0.8) GROUP BY doc_id)",
    )
)
def similar_documents(spark, sf_dir):
    """How many documents have a cosine similarity of 0.8 or more to each."""
    return similarity.similar_documents(_docs(spark, sf_dir), _ranked(spark, sf_dir), 0.8, CONFIG)


@query(
    _with(
        "SELECT x AS doc_a, y AS doc_b, sim FROM low UNION ALL SELECT y, x, sim FROM low UNION ALL SELECT doc_id, doc_id, 1.0::DOUBLE FROM documents",
        f"low AS (SELECT u.doc_id AS x, v.doc_id AS y, {_snap('sum(u.w * v.w)')} AS sim FROM unit u JOIN unit v USING (stem) WHERE u.doc_id > v.doc_id GROUP BY ALL)",
    )
)
def similarity_matrix(spark, sf_dir):
    """Both triangles and the diagonal, of pairs that share a stem."""
    return similarity.similarity_matrix(_docs(spark, sf_dir), _ranked(spark, sf_dir).vectors, CONFIG)


@query(
    _with(
        "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, CASE WHEN a.doc_id = b.doc_id THEN 1.0 ELSE coalesce(sim, 0.0) END::DOUBLE AS sim FROM documents a JOIN documents b ON a.doc_id % 100 = 0 LEFT JOIN s ON s.x = a.doc_id AND s.y = b.doc_id",
        f"s AS (SELECT u.doc_id AS x, v.doc_id AS y, {_snap('sum(u.w * v.w)')} AS sim FROM unit u JOIN unit v USING (stem) WHERE u.doc_id % 100 = 0 GROUP BY ALL)",
    )
)
def similarity_matrix_rows(spark, sf_dir):
    ids = _docs(spark, sf_dir).select("doc_id")
    return similarity.matrix_rows(ids.where(_asked()), ids, _corpus(spark, sf_dir).vectors, CONFIG)


@query(
    _with(
        """SELECT r.i AS row, c.i AS col, CASE WHEN greatest(r.i, c.i) NOT IN (SELECT doc_id FROM there) THEN -1.0 WHEN least(r.i, c.i) NOT IN (SELECT doc_id FROM there) THEN -2.0
            WHEN r.i = c.i THEN 1.0 ELSE coalesce(sim, 0.0) END::DOUBLE AS sim
        FROM (SELECT doc_id AS i FROM documents WHERE doc_id % 100 = 0) r, (SELECT unnest(generate_series(0, (SELECT max(doc_id) FROM there))) AS i) c LEFT JOIN s ON s.x = r.i AND s.y = c.i""",
        "there AS (SELECT doc_id FROM documents WHERE source <> 'src0' OR source IS NULL)",
        f"s AS (SELECT u.doc_id AS x, v.doc_id AS y, {_snap('sum(u.w * v.w)')} AS sim FROM unit u JOIN unit v USING (stem) WHERE u.doc_id % 100 = 0 GROUP BY ALL)",
    )
)
def dense_grid_sentinels(spark, sf_dir):
    """One source's documents count as redirects: they are missing."""
    docs = _docs(spark, sf_dir)
    there = docs.where(~F.coalesce(F.col("source") == "src0", F.lit(False))).select("doc_id")
    return similarity.dense_rows(docs.where(_asked()).select("doc_id"), there, there.agg(F.max("doc_id").alias("largest")), _corpus(spark, sf_dir).vectors, CONFIG)


@query(_with(f"SELECT u.doc_id, {', '.join(f'max(CASE WHEN rn = {k} THEN sim END) AS c{k}' for k in range(1, 6))} FROM (SELECT u.doc_id, rn, {_snap('sum(u.w * v.w)')} AS sim FROM unit u JOIN unit v USING (stem) JOIN cn ON cn.center_id = v.doc_id GROUP BY ALL) u GROUP BY 1", _CENTERS0, "cn AS (SELECT center_id, row_number() OVER (ORDER BY center_id) AS rn FROM c0)"))
def center_pivot(spark, sf_dir):
    """Similarities of all documents to the first centers, one column a center."""
    doc_terms = _terms(spark, sf_dir)
    centers = sorted(r.doc_id for r in cluster.initial_centers(_docs(spark, sf_dir), CONFIG.centers).collect())
    sims = similarity.cross_cosine(doc_terms.where(F.col("doc_id").isin(centers)), doc_terms, CONFIG)
    x = similarity.pivoted(sims, "right_id", "left_id", centers)
    return x.select(F.col("right_id").alias("doc_id"), *(F.col(str(c)).alias(f"c{k}") for k, c in enumerate(centers, 1)))


# --- clustering


@query(f"WITH {_CENTERS0} SELECT center_id FROM c0")
def initial_centers(spark, sf_dir):
    return cluster.initial_centers(_docs(spark, sf_dir), CONFIG.centers).select(F.col("doc_id").alias("center_id"))


@query(_with("SELECT * FROM a1", _CENTERS0, _assign("c0", "a1")))
def assign_centers(spark, sf_dir):
    return _labels(spark, sf_dir, _corpus(spark, sf_dir).vectors, 1).select("doc_id", "center_id", "sim")


@query(_with("SELECT center_id, count(*) AS size, round(avg(sim), 6) AS avg_sim FROM a1 GROUP BY center_id", _CENTERS0, _assign("c0", "a1")))
def center_averages(spark, sf_dir):
    return cluster.averages(_labels(spark, sf_dir, _corpus(spark, sf_dir).vectors, 1)).select("center_id", "size", _r("avg_sim"))


@query(_with("SELECT * FROM c1_n", _CENTERS0, _assign("c0", "a1"), _reselect("a1", "c1")))
def reselect_centers(spark, sf_dir):
    return cluster.reselect(_labels(spark, sf_dir, _corpus(spark, sf_dir).vectors, 1), CONFIG)


@query(_with("SELECT * FROM a2", *_CLUSTERED))
def cluster_labels(spark, sf_dir):
    return _labels(spark, sf_dir, _corpus(spark, sf_dir).vectors).select("doc_id", "center_id", "sim")


@query(_with("SELECT center_id, count(*) AS size FROM a2 GROUP BY center_id", *_CLUSTERED))
def cluster_sizes(spark, sf_dir):
    return cluster.sizes(_labels(spark, sf_dir, _corpus(spark, sf_dir).vectors))


@query(
    _with(
        """SELECT center_id, count(*) AS size, round(avg(sim), 6) AS avg_sim, array_to_string(list_sort(list(doc_id) FILTER (r <= 3)), ' ') AS farthest
        FROM (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY sim, doc_id) AS r FROM a2) GROUP BY center_id""",
        *_CLUSTERED,
    )
)
def cluster_descriptions(spark, sf_dir):
    x = cluster.described(_labels(spark, sf_dir, _corpus(spark, sf_dir).vectors))
    return x.select("center_id", "size", _r("avg_sim"), F.array_join("farthest", " ").alias("farthest"))


# --- classification


@query(_with("SELECT new_id, rank, doc_id, sim, class FROM near", *_KNN))
def knn_neighbors(spark, sf_dir):
    return _near(spark, sf_dir)[0].withColumn("rank", F.col("rank").cast("long"))


@query(_with("SELECT new_id, class, votes, first_rank FROM voted", *_KNN, _VOTED))
def knn_candidate_classes(spark, sf_dir):
    return classify.candidates(_near(spark, sf_dir)[0]).withColumn("first_rank", F.col("first_rank").cast("long"))


@query(_with("SELECT new_id, class AS knn_class FROM voted QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY votes DESC, first_rank) = 1", *_KNN, _VOTED))
def knn_label(spark, sf_dir):
    return classify.knn_label(_near(spark, sf_dir)[0])


@query(_with("SELECT new_id, class AS knn_class FROM (SELECT new_id, class, round(sum(sim), 6) AS w, min(rank) AS r FROM near GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY w DESC, r) = 1", *_KNN))
def weighted_knn_label(spark, sf_dir):
    return classify.knn_label(_near(spark, sf_dir)[0], weighted=True)


@query(_with("SELECT a.new_id, a.class AS class1, b.class AS class2 FROM voted a JOIN voted b ON a.new_id = b.new_id AND a.class < b.class", *_KNN, _VOTED))
def class_pairs(spark, sf_dir):
    return classify.class_pairs(classify.candidates(_near(spark, sf_dir)[0]))


@query(_with("SELECT doc_id, center_id FROM a2 WHERE center_id IN (SELECT class FROM voted)", *_KNN, _VOTED))
def class_members(spark, sf_dir):
    near, labels, *_ = _near(spark, sf_dir)
    return classify.class_members(classify.candidates(near), labels)


@query()
def svm_one_vs_one(spark, sf_dir):
    return _machine_labels(*_near(spark, sf_dir))


@query()
def label_report(spark, sf_dir):
    near, labels, corpus = _near(spark, sf_dir)
    svm = _machine_labels(near, labels, corpus)
    titles = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id")).alias("title"))
    return classify.report(classify.knn_label(near), svm, labels, titles)


@query(_with("SELECT new_id, 'doc_' || a2.doc_id AS title FROM voted_best JOIN a2 ON a2.center_id = knn_class", *_KNN, _VOTED, "voted_best AS (SELECT new_id, class AS knn_class FROM voted QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY votes DESC, first_rank) = 1)"))
def label_titles(spark, sf_dir):
    """The titles of all documents that share a new document's label."""
    near, labels, *_ = _near(spark, sf_dir)
    titles = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id")).alias("title"))
    return classify.shared_titles(classify.knn_label(near).select("new_id", F.col("knn_class").alias("center_id")), labels, titles)


def _cells(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, labels) of vectors, whose components are their stems."""
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null")
    cells = rows.select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("stem", "w")).select("doc_id", F.col("stem").cast("string").alias("stem"), F.col("w").cast("double").alias("tf_idf"))
    return cells, rows.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("center_id"))


def _machines(spark: SparkSession, sf_dir: str, kernel: str) -> DataFrame:
    """(vec_id, svm_class): one machine for each pair of labels of embeddings, whose components are its stems."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and label is not null and embedding is not null")
    cells = rows.select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("stem", "w")).select("doc_id", F.col("stem").cast("string").alias("stem"), F.col("w").cast("double").alias("tf_idf"))
    labels = rows.where(~_asked("vec_id")).select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("center_id"))
    voted = rows.where(_asked("vec_id")).select(F.col("vec_id").alias("new_id")).crossJoin(F.broadcast(labels.select(F.col("center_id").alias("class")).distinct())).withColumn("votes", F.lit(0))
    taught, asked = cells.where(~_asked()), cells.where(_asked())
    votes = classify.svm_votes(classify.class_pairs(voted), labels, taught, asked, replace(CONFIG, kernel=kernel))
    return classify.svm_label(votes, voted).select(F.col("new_id").alias("vec_id"), "svm_class")


@query()
def svm_rbf(spark, sf_dir):
    return _machines(spark, sf_dir, "rbf")


@query()
def svm_poly(spark, sf_dir):
    return _machines(spark, sf_dir, "poly")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, stated rows) with features and label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and label is not null and embedding is not null")
    rows = rows.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return rows.where(~_asked("vec_id")), rows.where(_asked("vec_id"))


def _predicted(x: DataFrame) -> DataFrame:
    return x.select("vec_id", F.col("prediction").cast("int").alias("prediction"))


_HEIGHTS = (0.4, 0.6, 0.8)
_VECTORS = """u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_inner_product(a.v, b.v), 6) AS height FROM u a JOIN u b ON a.vec_id <> b.vec_id)"""
_REACH = "r{n} AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT l.b, r{n}.c FROM r{n} JOIN l ON r{n}.node = l.a WHERE r{n}.c < l.b AND l.height <= {h}), g{n} AS (SELECT node, min(c) AS c FROM r{n} GROUP BY node)"


@query(
    f"WITH RECURSIVE {_VECTORS}, " + ", ".join(_REACH.format(n=n, h=h) for n, h in enumerate(_HEIGHTS))
    + " SELECT g0.node AS vec_id, " + ", ".join(f"g{n}.c AS cluster_{int(10 * h)}" for n, h in enumerate(_HEIGHTS)) + " FROM g0 JOIN g1 USING (node) JOIN g2 USING (node)"
)
def hierarchical_clusters(spark, sf_dir):
    """Clusters of all vectors at three heights of the dendrogram."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    nodes = rows.select(F.col("vec_id").alias("node"))
    forest = hierarchy.spanning_forest(nodes, hierarchy.canopy_forest(rows, "vec_id", "embedding", 0, 0.2))
    out = nodes
    for h in _HEIGHTS:
        out = out.join(hierarchy.clusters_at(nodes, forest, h).withColumnRenamed("cluster", f"cluster_{int(10 * h)}"), "node")
    return out.withColumnRenamed("node", "vec_id")


@query(
    f"""WITH {_BASE},
    lab AS (SELECT doc_id, lang FROM documents WHERE doc_id % 100 <> 0 AND lang IS NOT NULL),
    nct AS (SELECT lang, stem, CAST(sum(cnt) AS BIGINT) AS n FROM tc JOIN lab USING (doc_id) GROUP BY ALL),
    cls AS (SELECT lang, ln(count(*)::DOUBLE / (SELECT count(*) FROM lab)) AS prior FROM lab GROUP BY lang),
    den AS (SELECT lang, prior, coalesce((SELECT sum(n) FROM nct WHERE nct.lang = cls.lang), 0) + (SELECT count(DISTINCT stem) FROM nct) AS total FROM cls),
    ask AS (SELECT doc_id FROM documents WHERE doc_id % 100 = 0),
    per AS (SELECT a.doc_id, d.lang, d.prior + coalesce(sum(tc.cnt * (ln(coalesce(nct.n, 0) + 1.0::DOUBLE) - ln(d.total::DOUBLE))), 0) AS score
        FROM ask a CROSS JOIN den d LEFT JOIN tc ON tc.doc_id = a.doc_id LEFT JOIN nct ON nct.lang = d.lang AND nct.stem = tc.stem GROUP BY a.doc_id, d.lang, d.prior)
    SELECT doc_id, lang AS class, round(score, 4) AS score FROM per QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, lang) = 1"""
)
def term_bayes_labels(spark, sf_dir):
    """Languages of the stated documents by multinomial naive Bayes over the terms of all others."""
    docs = _docs(spark, sf_dir).withColumn("class", F.col("lang"))
    taught, asked = docs.where(~_asked()), docs.where(_asked())
    model = mining.train_term_bayes(terms.term_counts(taught.where("class is not null"), CONFIG, keep=("class",)), taught)
    out = mining.term_bayes(model, asked, terms.term_counts(asked, CONFIG))
    return out.withColumn("score", F.round("score", 4))


@query()
def dendrogram_merges(spark, sf_dir):
    """The merges of single linkage, with their heights."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hierarchy.spanning_forest(rows.select(F.col("vec_id").alias("node")), hierarchy.canopy_forest(rows, "vec_id", "embedding", 0, 0.2))


@query()
def one_vs_rest_labels(spark, sf_dir):
    return _predicted(mining.one_vs_rest_svm(*_vectors(spark, sf_dir)))


@query()
def naive_bayes_labels(spark, sf_dir):
    return _predicted(mining.naive_bayes(*_vectors(spark, sf_dir)))


@query()
def perceptron_labels(spark, sf_dir):
    return _predicted(mining.perceptron(*_vectors(spark, sf_dir), layers=[64, 16, 10]))


@query(
    """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)
    SELECT a.vec_id AS new_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 6) DESC, b.vec_id) AS rank, b.vec_id AS doc_id, round(list_inner_product(a.v, b.v), 6) AS sim, CAST(b.label AS BIGINT) AS class
    FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0 QUALIFY rank <= 10"""
)
def knn_embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return classify.dense_neighbors(rows.where(_asked("vec_id")), rows, 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    """WITH x AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn
        FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
    SELECT tp, fn, fp, tn, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS tpr, round(fn / nullif(tp + fn, 0)::DOUBLE, 6) AS fnr, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr, round(tn / nullif(fp + tn, 0)::DOUBLE, 6) AS tnr,
        round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS ppv, round(fp / nullif(tp + fp, 0)::DOUBLE, 6) AS fdr, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS npv, round(fn / nullif(tn + fn, 0)::DOUBLE, 6) AS for_rate,
        round((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 6) AS acc, round(tp::DOUBLE * (fp + tn) / nullif((tp + fn)::DOUBLE * fp, 0), 6) AS lr_pos, round(fn::DOUBLE * (fp + tn) / nullif((tp + fn)::DOUBLE * tn, 0), 6) AS lr_neg,
        round(tp::DOUBLE * tn / nullif(fp::DOUBLE * fn, 0), 6) AS dor FROM x"""
)
def confusion_metrics(spark, sf_dir):
    """Quality as the truth, the absence of toxicity as its prediction."""
    x = spark.read.parquet(f"{sf_dir}/labels.parquet").select("quality", F.when(F.col("toxic") == 0, 1).when(F.col("toxic").isNotNull(), 0).alias("clean"))
    return metrics.confusion(x, "quality", "clean")


FOLDS = 5
_FOLD = f"('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 7))::BIGINT % {FOLDS}"
_PER_CLASS = """SELECT class, count(*) FILTER (t = class AND p = class) AS tp, count(*) FILTER (t = class AND p <> class) AS fn, count(*) FILTER (t <> class AND p = class) AS fp, count(*) FILTER (t <> class AND p <> class) AS tn
    FROM (SELECT t AS class FROM told UNION SELECT p FROM told) CROSS JOIN told GROUP BY class"""


@query(
    _with(
        _PER_CLASS,
        f"lab AS (SELECT doc_id, lang, {_FOLD} AS fold FROM documents WHERE lang IS NOT NULL)",
        "fs AS (SELECT DISTINCT fold FROM lab)",
        "nct AS (SELECT fs.fold, lang, stem, CAST(sum(cnt) AS BIGINT) AS n FROM fs JOIN lab ON lab.fold <> fs.fold JOIN tc USING (doc_id) GROUP BY ALL)",
        "cls AS (SELECT fold, lang, ln(n::DOUBLE / (sum(n) OVER (PARTITION BY fold))::DOUBLE) AS prior FROM (SELECT fs.fold, lang, count(*) AS n FROM fs JOIN lab ON lab.fold <> fs.fold GROUP BY ALL))",
        "den AS (SELECT fold, lang, prior, coalesce((SELECT sum(n) FROM nct WHERE nct.lang = cls.lang AND nct.fold = cls.fold), 0) + (SELECT count(DISTINCT stem) FROM nct WHERE nct.fold = cls.fold) AS total FROM cls)",
        """per AS (SELECT a.doc_id, a.lang AS t, d.lang AS p, d.prior + coalesce(sum(tc.cnt * (ln(coalesce(nct.n, 0) + 1.0::DOUBLE) - ln(d.total::DOUBLE))), 0) AS score
            FROM lab a JOIN den d USING (fold) LEFT JOIN tc ON tc.doc_id = a.doc_id LEFT JOIN nct ON nct.fold = d.fold AND nct.lang = d.lang AND nct.stem = tc.stem GROUP BY a.doc_id, a.lang, d.lang, d.prior)""",
        "told AS (SELECT t, p FROM per QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, p) = 1)",
    )
)
def term_bayes_folds(spark, sf_dir):
    """True and false positives and negatives of each language by naive Bayes, every document held out once."""
    docs = _docs(spark, sf_dir)
    told = mining.fold_term_bayes(terms.term_counts(docs, CONFIG), docs.select("doc_id", F.col("lang").alias("class")), FOLDS)
    return metrics.per_class(told, "class", "predicted")


@query(
    f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    near AS (SELECT a.vec_id, CAST(a.label AS BIGINT) AS t, CAST(b.label AS BIGINT) AS p, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 6) DESC, b.vec_id) AS rank
        FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0 QUALIFY rank <= 10),
    told AS (SELECT t, p FROM (SELECT vec_id, t, p, count(*) AS votes, min(rank) AS r FROM near GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, r) = 1)
    {_PER_CLASS}"""
)
def knn_class_metrics(spark, sf_dir):
    """The same of labels of vectors by ten nearest neighbours; each stated vector is left out of what answers it."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = rows.where(_asked("vec_id"))
    told = classify.knn_label(classify.dense_neighbors(asked, rows, 10))
    return metrics.per_class(told.join(asked.select(F.col("vec_id").alias("new_id"), F.col("label").cast("long").alias("class")), "new_id"), "class", "knn_class")


@query()
def svm_class_folds(spark, sf_dir):
    """The same of labels of vectors by machines of all pairs of labels, every vector held out once."""
    cells, labels = _cells(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return metrics.per_class(classify.fold_svm(labels, cells, FOLDS, CONFIG), "class", "predicted")


_SCORED = "s AS (SELECT CAST(n_chars AS BIGINT) AS threshold, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1)"
_RAN = "r AS (SELECT threshold, p, n, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM s WINDOW w AS (ORDER BY threshold DESC))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's length as a score of its quality."""
    return _docs(spark, sf_dir).select("doc_id", "n_chars").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


@query(f"WITH {_SCORED}, {_RAN} SELECT threshold, tp, fp, round(tp / (SELECT sum(p) FROM s)::DOUBLE, 6) AS tpr, round(fp / (SELECT sum(n) FROM s)::DOUBLE, 6) AS fpr FROM r")
def roc_curve(spark, sf_dir):
    return metrics.roc(_scored(spark, sf_dir), "quality", "n_chars")


@query(f"WITH {_SCORED}, {_RAN} SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(sum((tp - p / 2::DOUBLE) * n) / (sum(p)::DOUBLE * sum(n)), 6) AS auc FROM r")
def roc_auc(spark, sf_dir):
    return metrics.auc(_scored(spark, sf_dir), "quality", "n_chars")


@query(
    """WITH b AS (SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL)
    SELECT lang, source, n, round(ln(n::DOUBLE * sum(n) OVER () / ((sum(n) OVER (PARTITION BY lang))::DOUBLE * sum(n) OVER (PARTITION BY source))), 6) AS mi FROM b"""
)
def mutual_information(spark, sf_dir):
    return metrics.mutual_information(_docs(spark, sf_dir), "lang", "source")


@query(
    """WITH RECURSIVE """ + _BASE + """,
    f AS (SELECT i, list(doc_id) AS tids FROM (SELECT doc_id, unnest(list_distinct(ts)) AS i FROM wc) GROUP BY i HAVING count(*) >= 0.2 * (SELECT count(*) FROM documents)),
    s AS (
        SELECT [i] AS items, tids, len(tids) AS n FROM f
        UNION ALL SELECT items, tids, len(tids) FROM (SELECT list_append(s.items, f.i) AS items, list_intersect(s.tids, f.tids) AS tids FROM s JOIN f ON f.i > s.items[len(s.items)]) WHERE len(tids) >= 0.2 * (SELECT count(*) FROM documents)),
    r AS (SELECT list_filter(items, lambda x: x <> c) AS a, c, n FROM (SELECT items, n, unnest(items) AS c FROM s WHERE len(items) > 1))
    SELECT array_to_string(a, ' ') AS antecedent, c AS consequent, round(r.n / s.n::DOUBLE, 6) AS confidence, round(r.n / (SELECT count(*) FROM documents)::DOUBLE, 6) AS support FROM r JOIN s ON s.items = r.a WHERE r.n / s.n::DOUBLE >= 0.5"""
)
def association_rules(spark, sf_dir):
    baskets = terms.tokenized(_docs(spark, sf_dir), CONFIG).select(F.array_distinct("tokens").alias("items"))
    out = mining.association_rules(baskets, "items", support=0.2, confidence=0.5)
    return out.select(F.array_join(F.array_sort("antecedent"), " ").alias("antecedent"), F.array_join("consequent", " ").alias("consequent"), _r("confidence"), _r("support"))
