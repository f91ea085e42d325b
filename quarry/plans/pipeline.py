"""The whole dataflow: parse, cluster, classify; each stage timed."""

from __future__ import annotations

import argparse
import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import classify, cluster, similarity, terms
from ..operators.order import staged
from ..sources import readers, writers

log = logging.getLogger("quarry")


@dataclass
class Pipeline:
    spark: SparkSession
    config: EngineConfig = EngineConfig()
    timings: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def timed(self, stage: str):
        began = time.perf_counter()
        yield
        self.timings.append((stage, time.perf_counter() - began))
        log.info("%s took %.3f s", stage, self.timings[-1][1])

    def timing_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.timings, "stage string, seconds double")

    def parse(self, docs: DataFrame) -> Pipeline:
        """docs (doc_id, text, perhaps title)."""
        with self.timed("parse"):
            self.docs = docs
            counts = terms.term_counts(docs, self.config)
            self.idf = terms.inverse_document_frequency(counts, self.config.idf_total or docs).persist()
            self.terms = terms.tfidf(docs, self.config, idf=self.idf).persist()
            self.terms.count()
        return self

    def distance(self) -> Pipeline:
        """similarities (doc_a, doc_b, sim) of all pairs that share a stem, in the shared folder."""
        with self.timed("distance"):
            self.similarities = staged(similarity.pairwise_cosine(self.terms, self.config))
        return self

    def save(self) -> dict[str, int]:
        """Documents and inverse document frequencies, into their tables; returns what the writing passes counted."""
        writers.create_tables(self.spark)
        title = F.col("title") if "title" in self.docs.columns else F.lit("")
        seen = writers.save_documents(self.docs.select("doc_id", F.coalesce(title, F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null"))
        seen |= writers.save_idf(self.idf)
        log.info("saved %s", seen)
        return seen

    def cluster(self) -> Pipeline:
        with self.timed("cluster"):
            ids = self.docs.select("doc_id")
            centers = [r.doc_id for r in cluster.initial_centers(ids, self.config.centers).collect()]
            if len(centers) < self.config.centers:
                raise ValueError(f"{len(centers)} documents are too few for {self.config.centers} centers")
            self.labels = cluster.cluster(ids, self.terms, centers, self.config).persist()
            self.labels.count()
        return self

    def classify(self, new: DataFrame, svm: bool = True) -> DataFrame:
        """(new_id, knn_class, svm_class) of new (doc_id, text)."""
        n_docs = self.docs.agg(F.count("*").alias("n_docs"))
        with self.timed("classify"):
            new_terms = terms.tfidf_of_new(new, self.idf, n_docs, self.config).persist()
            near = classify.neighbors(new_terms, self.terms, self.labels, self.config, asked=new).persist()
            out = classify.knn_label(near).persist()
            out.count()
        if not svm:
            return out
        with self.timed("classify_svm"):
            voted = classify.candidates(near)
            votes = classify.svm_votes(classify.class_pairs(voted), self.labels, self.terms, new_terms, self.config)
            out = out.join(classify.svm_label(votes, voted), "new_id").persist()
            out.count()
        return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Analyse a corpus of documents")
    parser.add_argument("--config", help="an INI file")
    parser.add_argument("--xml", default="", help="an XML dump")
    parser.add_argument("--table", default="", help="a Parquet folder or table with doc_id and text")
    parser.add_argument("--log", default="", help="a file for the log, beside the console")
    parser.add_argument("--new", default="", help="a Parquet folder with new documents (doc_id, text)")
    for flag in ("debug", "clean", "parse", "distance", "cluster", "classify", "svm"):
        parser.add_argument(f"--{flag}", action=argparse.BooleanOptionalAction)
    a = parser.parse_args(argv)
    logging.basicConfig()
    before, to_file = log.level, logging.FileHandler(a.log) if a.log else None
    log.setLevel(logging.DEBUG if a.debug else logging.INFO)  # whatever handlers the root logger has
    if to_file:
        log.addHandler(to_file)
    try:
        _run(a)
    finally:
        log.setLevel(before)
        if to_file:
            log.removeHandler(to_file)
            to_file.close()


def _run(a: argparse.Namespace) -> None:
    config = EngineConfig.from_ini(a.config) if a.config else EngineConfig()
    spark = SparkSession.builder.getOrCreate()
    if a.clean:
        writers.clean_tables(spark)
    if not (a.parse or a.distance or a.cluster or a.classify or a.svm):
        return
    run = Pipeline(spark, config).parse(readers.corpus(spark, config, a.xml, a.table))
    if config.save_to_db:
        run.save()
    if a.distance:
        run.distance()
    if a.cluster or a.classify or a.svm:
        run.cluster()
    if (a.classify or a.svm) and a.new:
        run.classify(readers.read_table(spark, a.new), svm=bool(a.svm)).show(100, False)
    run.timing_table().show(truncate=False)


if __name__ == "__main__":
    main()
