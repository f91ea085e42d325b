"""Terms and their weights: one long table doc_terms (doc_id, stem, ...) is what all other operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.stem import english_stem, porter_stem
from ..functions.text import truncated, without, words


def tokenized(docs: DataFrame, config: EngineConfig = EngineConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_nonstop, word_count, tokens) of docs (doc_id, text), and columns to keep; no shuffle."""
    x = docs.select("doc_id", *keep, words(F.col("text")).alias("all_words"))
    x = x.select("doc_id", *keep, F.size("all_words").cast("long").alias("n_words"), without(F.col("all_words"), config.stopwords).alias("tokens"))
    x = x.withColumn("n_nonstop", F.size("tokens").cast("long"))
    count = {"compat": F.col("n_words") + F.col("n_nonstop"), "total": F.col("n_words"), "nonstop": F.col("n_nonstop")}[config.tf_denominator]
    return x.select("doc_id", *keep, "n_words", "n_nonstop", count.alias("word_count"), "tokens")


def lemmatized(terms: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """stem replaced by its lemma in lemmas (word, lemma) where there is one."""
    if lemmas is None:
        return terms
    return terms.join(lemmas, terms.stem == lemmas.word, "left").withColumn("stem", F.coalesce("lemma", "stem")).drop("word", "lemma")


def stem_table(docs: DataFrame, config: EngineConfig = EngineConfig(), stemmer: str = "english") -> DataFrame:
    """(word, lemma): the stem of each word that has another, to be used in place of a table of lemmas. stemmer: english or porter. Only the vocabulary reaches Python."""
    x = tokenized(docs, config).select(F.explode("tokens").alias("word")).distinct()
    return x.withColumn("lemma", {"english": english_stem, "porter": porter_stem}[stemmer]("word")).where("word <> lemma")


#: The endings of English nouns that are detached, and what takes their place.
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def noun_lemmas(words: DataFrame, vocabulary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, lemma) of words (word) whose lemma is another word: an exception (word, lemma) if there is one, else the shortest candidate in the vocabulary (word), ties alphabetical.

    Candidates come of detaching noun endings; a word without any keeps its own form and has no row. Joins only: neither table is collected."""
    words = words.select("word").where("word is not null").distinct()
    known = vocabulary.select(F.col("word").alias("lemma")).where("lemma is not null").distinct()
    made = [F.when(F.col("word").endswith(a) & (F.length("word") > len(a)), F.concat(F.expr(f"left(word, length(word) - {len(a)})"), F.lit(b))) for a, b in NOUN_ENDINGS]
    found = words.select("word", F.explode(F.array(*made)).alias("lemma")).where("lemma is not null").join(known, "lemma", "left_semi")
    best = found.groupBy("word").agg(F.min(F.struct(F.length("lemma").alias("n"), "lemma")).alias("m")).select("word", "m.lemma")
    if exceptions is None:
        return best
    own = exceptions.select("word", F.col("lemma").alias("stated")).join(words, "word", "left_semi")
    return own.join(best, "word", "full").select("word", F.coalesce("stated", "lemma").alias("lemma")).where("lemma <> word")


def runs(tokens: str) -> list[Column]:
    """Of a column of sorted tokens: the last place of each distinct one, as an array, and the array of (stem, cnt) that follows from it."""
    ends = F.filter(F.transform(tokens, lambda w, i: F.when(w == F.get(tokens, i + 1), 0).otherwise(i + 1)), lambda end: end > 0)
    count = lambda end, k: (end - F.coalesce(F.get("_ends", k - 1), F.lit(0))).cast("long")
    return [ends, F.transform("_ends", lambda end, k: F.struct(F.get(tokens, end - 1).alias("stem"), count(end, k).alias("cnt")))]


def term_counts(docs: DataFrame, config: EngineConfig = EngineConfig(), lemmas: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns to keep, word_count, stem, cnt): stop words go before words are lemmatised. A row of docs is a document.

    A document's terms are counted where it lies, as runs of its sorted tokens: no shuffle but for lemmas. The outer form of
    inline keeps the optimizer from tokenising a second time, to see whether there is any term."""
    ends, found = runs("_sorted")
    x = tokenized(docs, config, keep).select("doc_id", *keep, "word_count", F.sort_array("tokens").alias("_sorted"))
    x = x.withColumn("_ends", ends).withColumn("_runs", found)
    counts = x.select("doc_id", *keep, "word_count", F.inline_outer("_runs")).where(F.col("stem").isNotNull())
    if lemmas is None:
        return counts
    return lemmatized(counts, lemmas).groupBy("doc_id", *keep, "word_count", "stem").agg(F.sum("cnt").alias("cnt"))


def term_frequency(counts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return counts.select("doc_id", "stem", "cnt", truncated(F.col("cnt") / F.col("word_count"), config.tf_digits).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("stem").agg(F.count("*").alias("df"))


def inverse_document_frequency(counts: DataFrame, total: int | DataFrame) -> DataFrame:
    """(stem, df, idf); total: a number, or docs to be counted."""
    df = document_frequency(counts)
    if isinstance(total, DataFrame):
        df = df.join(F.broadcast(total.agg(F.count("*").alias("n_docs"))))  # one row
    else:
        df = df.withColumn("n_docs", F.lit(total))
    return df.select("stem", "df", (F.lit(1.0) + F.log(F.col("n_docs").cast("double") / F.col("df"))).alias("idf"))


def tfidf(docs: DataFrame, config: EngineConfig = EngineConfig(), lemmas: DataFrame | None = None, idf: DataFrame | None = None) -> DataFrame:
    """doc_terms (doc_id, stem, cnt, tf, idf, tf_idf)."""
    counts = term_counts(docs, config, lemmas)
    idf = idf if idf is not None else inverse_document_frequency(counts, config.idf_total or docs)
    return term_frequency(counts, config).join(idf.select("stem", "idf"), "stem").select("doc_id", "stem", "cnt", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"))


def tfidf_of_new(docs: DataFrame, idf: DataFrame, n_docs: DataFrame, config: EngineConfig = EngineConfig(), lemmas: DataFrame | None = None) -> DataFrame:
    """doc_terms of documents outside the corpus: a stem that the corpus lacks counts as rarer than any. n_docs: one row (n_docs)."""
    tf = term_frequency(term_counts(docs, config, lemmas), config)
    x = tf.join(idf.select("stem", "idf"), "stem", "left").join(F.broadcast(n_docs))
    x = x.withColumn("idf", F.coalesce("idf", F.lit(1.0) + F.log(F.col("n_docs").cast("double") + 1)))
    return x.select("doc_id", "stem", "cnt", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"))


def top_tokens(doc_terms: DataFrame, n: int = 5) -> DataFrame:
    """The n heaviest terms of each document, with their rank."""
    w = Window.partitionBy("doc_id").orderBy(F.round("tf_idf", 9).desc(), "stem")
    return doc_terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def norms(doc_terms: DataFrame) -> DataFrame:
    """(doc_id, n_terms, norm)."""
    return doc_terms.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sqrt(F.sum(F.col("tf_idf") * F.col("tf_idf"))).alias("norm"))


def unit_terms(doc_terms: DataFrame) -> DataFrame:
    """(doc_id, stem, w): weights over the document's norm; documents without weight drop out. A window, so that doc_terms is computed and moved once."""
    norm = F.sqrt(F.sum(F.col("tf_idf") * F.col("tf_idf")).over(Window.partitionBy("doc_id")))
    return doc_terms.select("doc_id", "stem", "tf_idf", norm.alias("norm")).where("norm > 0").select("doc_id", "stem", (F.col("tf_idf") / F.col("norm")).alias("w"))
