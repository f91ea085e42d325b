"""Language identification by segmentation-marginalised unigrams.

For each language, piece probabilities over a fixed public vocabulary are fitted by expectation maximisation over all
segmentations of words. A text's score in a language is the probability that the forward algorithm sums over all its
segmentations; no piece crosses the space before a word, so it is the product of the words' own, and a bounded memory of
words saves repeating them. Words are lower-cased and of any length: in a script without spaces a whole line is one.

Learning takes about per_language documents of each language, chosen by a hash of their identifier, and of these the first
in the order of that hash whose texts come to sample_chars characters together (at least one); those bounds are the only
sample, and every word of it teaches. What the driver and each worker hold grows with the number of languages, which are meant to be
at most some hundreds. Defined results: a text that is null or has no letter is `und` with score 0, as is every text if nothing could be
learned; a null or unseen language teaches nothing; ties fall to the first language by code point; repeated rows are rows
like others; a very long text or word is scored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, released, text_sizes
from .pieces import MODEL, Units, backward, forward, viterbi, vocabulary

MEMORY = 200_000
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 21


def words_of(text: str) -> list[str]:
    return text.lower().split()


def fit(samples: list[tuple[str, str]], model: str = MODEL, rounds: int = 2, smooth: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by piece and language) from (language, text)."""
    vocab, names = vocabulary(model), sorted({x for x, _ in samples})
    counts = [Counter() for _ in names]
    for name, text in samples:
        counts[names.index(name)].update(words_of(text))
    units = sorted({w for c in counts for w in c})
    if not units:
        return [], np.zeros((vocab.size, 0), dtype=np.float32)
    weight = np.array([[c[w] for c in counts] for w in units], dtype=float)
    units = [vocab.spaced(w) for w in units]
    live = np.zeros(vocab.size, dtype=bool)
    live[vocab.normal] = live[vocab.byte] = True

    def normal(found: np.ndarray) -> np.ndarray:
        found = np.where(live[:, None], found + smooth, 1e-300)
        return np.log(found / found.sum(axis=0))

    found = np.zeros((vocab.size, len(names)))
    ids, spans = viterbi(vocab, units)
    of = np.repeat(np.arange(len(units)), spans[:, 1] - spans[:, 0])
    for k in range(len(names)):  # begin with the best segmentations
        found[:, k] = np.bincount(np.concatenate([ids[a:b] for a, b in spans]), weights=weight[of, k], minlength=vocab.size)
    table = normal(found)
    for _ in range(rounds):
        u = Units(vocab, units)
        a = forward(u, table)
        full = table if not hasattr(u, "kinds") else np.concatenate([table, np.stack([table[vocab.unknown(int(c))].sum(axis=0) for c in u.kinds])])
        b = backward(u, full)
        lane = np.repeat(np.arange(len(u.size)), u.size)
        total, own = a[u.end + np.arange(len(u.size))], weight[u.order]
        found = np.zeros((len(full), len(names)))
        for l, got in enumerate(u.ids, 1):
            p = np.flatnonzero(got >= 0)
            i = p + lane[p]
            part = np.exp(a[i] + full[got[p]] + b[i + l] - total[lane[p]]) * own[lane[p]]
            for k in range(len(names)):
                found[:, k] += np.bincount(got[p], weights=part[:, k], minlength=len(full))
        for c, x in zip(getattr(u, "kinds", ()), found[vocab.size :]):
            for i in vocab.unknown(int(c)):
                found[i] += x
        table = normal(found[: vocab.size])
    return names, table


class Scorer:
    def __init__(self, table: np.ndarray, model: str = MODEL, memory: int = MEMORY):
        self.vocab, self.table, self.memory = vocabulary(model), table, memory
        self.number: dict[str, int] = {}
        self.values = np.zeros((0, table.shape[1]))

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text by language."""
        if len(self.number) > self.memory:
            self.number, self.values = {}, self.values[:0]
        number, known = self.number, len(self.number)
        words = [words_of(x) for x in texts]
        flat = np.array([number.setdefault(w, len(number)) for row in words for w in row], dtype=np.int64)
        if len(number) > known:
            u = Units(self.vocab, [self.vocab.spaced(w) for w in list(number)[known:]])
            new = np.empty((len(u.size), self.table.shape[1]))
            new[u.order] = forward(u, self.table)[u.end + np.arange(len(u.size))]
            self.values = np.concatenate([self.values, new])
        row = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        values = self.values[flat]
        return np.stack([np.bincount(row, weights=values[:, k], minlength=len(texts)) for k in range(values.shape[1])], axis=1)


def sample(docs: DataFrame, id: str, text: str, lang: str, learn: Column, per_language: int = 400, sample_chars: int = 4_000_000) -> list[tuple[str, str]]:
    """About per_language documents of each language among those to learn from, and not more than sample_chars characters of texts, but for one text at least."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    part = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))))
    order = F.xxhash64("id", F.lit(4))
    few = rows.where(F.pmod(order, F.lit(1_000_000)) / 1e6 < part[F.col("lang")])
    before = F.sum(F.char_length("text")).over(Window.partitionBy("lang").orderBy(order, "id", "text").rowsBetween(Window.unboundedPreceding, -1))
    few = few.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.char_length("text") <= sample_chars))
    return [(r.lang, r.text) for r in few.select("lang", "text").collect()]


def identify(docs: DataFrame, names: list[str], table: np.ndarray, id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """One row for each of docs: id, lang_pred, score (the language's share of the probability)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    @released
    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(sent.value, model)
        for b in batches:
            for f, t in blocks(text_sizes(b.column(1)), _BLOCK):
                texts = [x or "" for x in b.column(1).slice(f, t - f).to_pylist()]
                said = np.array([bool(_LETTER.search(x)) for x in texts]) & bool(names)
                pred, score = np.full(t - f, "und", dtype=object), np.zeros(t - f)
                if said.any():
                    x = scorer.score([x for x, ok in zip(texts, said) if ok])
                    best = x.argmax(axis=1)
                    pred[said] = np.array(names, dtype=object)[best]
                    score[said] = 1 / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(f, t - f), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(each, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id)
