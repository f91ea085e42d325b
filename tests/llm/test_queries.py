"""The registered queries that have no SQL, against brute force: op2, op4 and op5 over small tables of their own."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import langid, pieces, quality_crf, queries
from quarry.llm.common import packed

from .test_pieces import brute

#: Columns of names that operators use themselves.
ODD = ["id", "score", "ids", "decoded", "y", "predicted", "held_out", "lang_pred"]


def fold(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def table(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).withColumns({c: F.lit("own") for c in ODD}).repartition(3).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def junky(r, good):
    words = ["the", "house", "is", "near", "a", "river."]
    lines = [" ".join(r.choices(words, k=r.randint(1, 8))) for _ in range(r.randint(1, 6))]
    return "\n".join(x if good or r.random() < 0.4 else " ".join(w + "$$$" for w in x.split()) for x in lines)


def enumerated(model, text):
    """The score of a text by all labellings of its lines."""
    x, size, first = quality_crf.line_features(*packed(pa.table({"id": [0], "text": [text]}), "id", "text")[1:])
    node = quality_crf.with_neighbours(x, first) @ model.weights
    z, good = 0.0, np.zeros(len(node))
    for y in itertools.product((0, 1), repeat=len(node)):
        w = np.exp(sum(s for s, k in zip(node, y) if k) + sum(model.move[a, b] for a, b in zip(y, y[1:])))
        z, good = z + w, good + w * np.array(y)
    q = np.clip(((good / z) * (size + 1)).sum() / (size + 1).sum(), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(model.curve[0] * np.log(q / (1 - q)) + model.curve[1])))


def test_op2(spark, tmp_path):
    r = random.Random(3)
    label = {i: int(r.random() < 0.7) for i in range(250)}
    texts = {i: junky(r, y) for i, y in label.items()} | {250: None, 251: "", 252: "\n", 253: "x" * 200_000, 254: "a\n" * 3000}
    rows = [*texts.items(), (None, "the house"), (7, texts[7])]  # a null identifier, a repeated row

    def run(marks):
        table(spark, tmp_path, "documents", rows, "doc_id long, text string")
        table(spark, tmp_path, "labels", [*marks.items(), (None, 1), (9999, 0), (11, None), (13, marks[13])], "doc_id long, quality int")
        return queries.op2_quality_crf(spark, str(tmp_path)).collect()

    got = run(label)
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    assert all(x.held_out == (fold(x.doc_id, 5) == 0) for x in got if x.doc_id is not None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = [(i, y) for i, y in label.items() if fold(i, 5)]
    model = quality_crf.train(docs, spark.createDataFrame(learn, "doc_id long, quality int"), F.lit(True))
    for x in got:
        if x.doc_id is None or x.doc_id < 253:
            assert abs(x.score - enumerated(model, texts.get(x.doc_id, "the house"))) < 1e-9
    held = [(x.predicted, label[x.doc_id]) for x in got if x.held_out and x.doc_id in label]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.85
    # labels of the held-out fold change nothing
    other = run({i: y if fold(i, 5) else 1 - y for i, y in label.items()})
    assert sorted((str(x.doc_id), x.score) for x in other) == sorted((str(x.doc_id), x.score) for x in got)


def segmented(vocab, look, logs, word):
    """The log-probability of a word by every segmentation, one column a language."""
    total = np.zeros(logs.shape[1])
    for cut in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(word)]
        ids = [[look[p]] if p in look else vocab.unknown(ord(p)) if len(p) == 1 else None for p in (word[i:j] for i, j in itertools.pairwise(at))]
        if all(ids):
            total += np.exp(logs[[i for y in ids for i in y]].sum(axis=0))
    return np.log(total)


def test_op4(spark, tmp_path):
    r = random.Random(4)
    lexicon = {"aa": ["the", "and", "ing", "over"], "bb": ["le", "que", "eau", "dan"], "zh": ["是不了在人有我他", ""], "ja": ["のにはをたがでて", ""]}
    rows = []
    for i in range(240):
        name = r.choice(list(lexicon))
        if name in ("zh", "ja"):  # no spaces: a line is one word of 30 to 200 characters
            text = "\n".join("".join(r.choices(lexicon[name][0] + "日本人大学中国", k=r.randint(30, 200))) for _ in range(2))
        else:
            text = " ".join("".join(r.choices(lexicon[name], k=r.randint(1, 2))) for _ in range(r.randint(3, 9)))
        rows.append((i, text, name if i % 11 else None))
    odd = [(240, None, "aa"), (241, "", "aa"), (242, "12 34 !", "bb"), (243, rows[3][1], "aa"), (243, rows[3][1], "aa"), (None, "the and", None), (245, "the" * 4000, None), (246, rows[8][1], "bb")]

    def run(rows):
        table(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
        return queries.op4_language_id(spark, str(tmp_path)).collect()

    got = run(rows + odd)
    assert len(got) == len(rows) + len(odd) and all(0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (fold(x.doc_id, 3) == 1) for x in got if x.doc_id is not None)
    held = [(x.lang_pred, rows[x.doc_id][2]) for x in got if x.held_out and x.doc_id is not None and x.doc_id < 240 and rows[x.doc_id][2]]
    assert len(held) > 40 and {b for _, b in held} == set(lexicon) and np.mean([a == b for a, b in held]) > 0.95
    by = {x.doc_id: x for x in got}
    assert [by[k].lang_pred for k in (240, 241, 242)] == ["und"] * 3 and by[242].score == 0 and by[245].lang_pred == "aa"
    # the score itself, by every segmentation of every word
    names, logs = langid.fit([(lang, text) for i, text, lang in rows + odd if lang and text is not None and (i is None or fold(i, 3) != 1)])
    vocab = pieces.vocabulary()
    look = {vocab.pieces[i]: int(i) for i in vocab.normal}
    for x in got:
        if x.doc_id is not None and x.doc_id < 60 and rows[x.doc_id][2] in ("aa", "bb"):
            said = sum(segmented(vocab, look, logs, vocab.spaced(w)) for w in rows[x.doc_id][1].lower().split())
            share = np.exp(said - said.max()) / np.exp(said - said.max()).sum()
            assert x.lang_pred == names[int(share.argmax())] and abs(x.score - share.max()) < 1e-6
    # languages of the held-out fold change nothing
    other = run([(i, t, l if i is None or fold(i, 3) != 1 else "zz") for i, t, l in rows + odd])
    assert sorted((str(x.doc_id), x.lang_pred, round(x.score, 9)) for x in other) == sorted((str(x.doc_id), x.lang_pred, round(x.score, 9)) for x in got)


def test_every_word_of_the_sample_teaches():
    """Scripts without spaces are told apart by samples of nothing else, and very long words teach and are scored."""
    r = random.Random(5)
    script = {"zh": "是不了在人有我他的", "ja": "のにはをたがでてす"}
    samples = [(k, "".join(r.choices(s, k=150))) for k, s in script.items() for _ in range(20)]
    names, table = langid.fit(samples)
    scorer = langid.Scorer(table)
    for k, s in script.items():
        x = scorer.score(["".join(r.choices(s, k=90)), "".join(r.choices(s, k=20_000))])
        assert [names[j] for j in x.argmax(axis=1)] == [k, k]
    long = langid.fit([("aa", "the" * 7000), ("bb", "que" * 7000)])
    assert np.isfinite(long[1]).all() and langid.Scorer(long[1]).score(["thethethe"])[0].argmax() == 0


def test_long_lanes_sum_alike():
    """Few lanes are worked one by one; the sums are those of many lanes."""
    vocab, r = pieces.vocabulary(), random.Random(6)
    table = np.log(np.random.default_rng(0).dirichlet(np.ones(vocab.size), 2).T)
    one = "".join(r.choices("thereinaxé漢\x01", k=300))
    few = pieces.Units(vocab, [one])
    many = pieces.Units(vocab, [one] * (pieces.FEW + 2))
    a, b = pieces.forward(few, table), pieces.forward(many, table)
    assert np.allclose(a, b[: len(a)])
    full = np.concatenate([table, np.stack([table[vocab.unknown(int(c))].sum(axis=0) for c in few.kinds])])
    c, d = pieces.backward(few, full), pieces.backward(many, full)
    assert np.allclose(c, d[: len(c)]) and np.allclose(c[0], a[-1])


def test_op5(spark, tmp_path):
    r = random.Random(7)
    texts = [" ".join("".join(r.choices("thereinaxé漢▁\t", k=r.randint(1, 9))) for _ in range(r.randint(0, 20))) for _ in range(40)]
    texts += [None, "", " ", "\n", "ab" * 30_000, "<s></s><unk>", texts[0]]
    rows = [*enumerate(texts), (0, texts[0]), (None, "null identifier")]
    table(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = queries.op5_sentencepiece(spark, str(tmp_path)).collect()
    vocab = pieces.vocabulary()
    assert len(got) == len(rows) and all(x.exact for x in got)
    for x in got:
        text = texts[x.doc_id] if x.doc_id is not None else "null identifier"
        assert (x.ids is None) == (text is None)
        if text is not None and len(text) < 1000:
            assert x.ids == [i for u in vocab.unit.findall(vocab.spaced(text)) for i in brute(vocab, u)] and x.n_tokens == len(x.ids)
    table(spark, tmp_path, "documents", [], "doc_id long, text string")
    assert queries.op5_sentencepiece(spark, str(tmp_path)).count() == 0
