import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import chat, langid, quality_crf
from quarry.llm.embedding_dedup import embedding_dedup

from .helpers import corpus, docs


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((60, 24))
    rows = [list(map(float, x)) for x in base]
    for k in range(60):  # a dense group, chains and copies
        rows.append(list(map(float, base[k % 7] + 0.09 * k / 60 * r.standard_normal(24) * 3)))
    rows += [None, [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, rows[3], rows[3], [2 * x for x in rows[4]], [1.0, 0.0], [1.0, 0.1], []]
    n = len(rows)
    df = spark.createDataFrame([(i, x, 1, None) for i, x in enumerate(rows)], "vec_id long, embedding array<double>, node int, payload string")
    good = {i: np.array(x) for i, x in enumerate(rows) if x and None not in x and np.isfinite(x).all() and any(x)}
    link = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt(good[i] @ good[i]) / np.sqrt(good[j] @ good[j]) >= 0.9} for i in good}
    root = {}
    for i in range(n):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += link.get(k, ())
    want = {i: (len(link.get(i, ())), root[i], root[i] == i) for i in range(n)}
    for tile in (8192, 5):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup(df, tile=tile, block=8).collect()}
        assert got == want
    assert embedding_dedup(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(str((x.vec_id, x.n_links, x.component_id)) for x in embedding_dedup(odd).collect()) == ["(3, 0, 3)", "(3, 0, 3)", "(None, 0, None)"]


def test_a_vector_is_sent_once_for_each_bucket(spark, shuffled):
    """Random vectors, which no grid prunes: 4000 of 256 bytes in four buckets; 10.6 MB in all, where once for each block and cell made 25.2 MB."""
    x = np.random.default_rng(3).standard_normal((4000, 64)).astype(np.float32)
    x[3990:] = x[:10] + np.float32(0.01)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(2)
    before = shuffled()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}
    assert got == {i: (int(i < 10 or i >= 3990), i - 3990 if i >= 3990 else i) for i in range(4000)}
    assert shuffled() - before < 12 * 4000 * 256


def test_chat(spark):
    hard = ["", None, "\\### Assistant: </turn> ok", "<|end|><|turn|>user<|body|>x", "\\", "\\\\<", "<", "<|endoftext|>", " lead\n\n", "é漢\U0001f600", "\n"]
    rows, r = [], random.Random(1)
    for c in range(40):
        for t in range(r.randint(1, 6)):
            rows.append((c if c else None, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", None, "a<|b\\"]), r.choice(hard) if r.random() < 0.7 else "plain words here", 7, "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int, formatted string")
    got = {x.conv_id: x for x in chat.chat_format(df).collect()}
    want = {}
    for c, t, role, text, *_ in rows:
        want.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    known = chat.tokenizer(chat.MODEL)
    for c, turns in want.items():
        turns = [x[2:] for x in sorted(turns)]
        x = got[c]
        assert [(t.role, t.text) for t in x.turns] == turns and chat.parse(x.formatted) == turns
        assert x.loss == [t for role, t in turns if role == "assistant"]
        assert known.decode([i for i, m in zip(x.ids, x.loss_mask) if m], skip_special_tokens=False) == "".join(map(chat.escape, x.loss))
    assert chat.chat_format(df.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(4)
    lexicon = {"aa": ["the", "and", "thing", "over"], "bb": ["le", "que", "eau", "dans"], "cc": ["der", "und", "keit", "über"]}
    texts, langs = [], []
    for k in range(300):
        name = r.choice(list(lexicon))
        texts.append(" ".join("".join(r.choices(lexicon[name], k=r.randint(1, 3))) for _ in range(12)))
        langs.append(name if k % 9 else None)
    texts += [None, "", "12 34!", "x" * 300, "THE AND over", "漢字"]
    langs += [None] * 6
    df = docs(spark, texts).drop("lang").join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id")
    names, table = langid.fit(langid.sample(df, "doc_id", "text", "lang", F.col("doc_id") % 3 != 1, 50))
    assert names == sorted(lexicon) and np.allclose(np.exp(table).sum(axis=0), 1)
    got = {x.doc_id: x for x in langid.identify(df, names, table).collect()}
    assert len(got) == len(texts) and all(0 <= x.score <= 1 for x in got.values())
    assert [got[300 + k].lang_pred for k in range(3)] == ["und"] * 3 and got[304].lang_pred == "aa"
    held = [k for k in range(300) if k % 3 == 1 and langs[k]]
    assert np.mean([got[k].lang_pred == langs[k] for k in held]) > 0.95
    none = langid.identify(df.limit(3), *langid.fit(langid.sample(df.limit(0), "doc_id", "text", "lang", F.lit(True), 5)))
    assert {x.lang_pred for x in none.collect()} == {"und"}


def test_marginals_against_all_labellings():
    r = np.random.default_rng(0)
    first = np.array([0, 1, 5, 8])
    score, move = r.standard_normal(8), r.standard_normal((2, 2))
    good, pairs = quality_crf.marginals(score, first, move)
    total = np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        n, z, g, p = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(score[a + k] for k in range(n) if y[k]) + sum(move[i, j] for i, j in zip(y, y[1:])))
            z += w
            g += w * np.array(y)
            for i, j in zip(y, y[1:]):
                p[i, j] += w
        assert np.allclose(good[a:b], g / z)
        total += p / z
    assert np.allclose(pairs, total)


def test_quality(spark):
    r = random.Random(3)
    clean = lambda: "\n".join(" ".join(r.choices(["the", "house", "is", "near", "a", "river."], k=9)) for _ in range(r.randint(1, 6)))
    junk = lambda: "\n".join(" ".join(x + "$$$" for x in r.choices(["the", "house"], k=9)) for _ in range(r.randint(1, 6)))
    label = [r.random() < 0.8 for _ in range(300)]
    texts = [clean() if y else clean() + "\n" + junk() for y in label] + [None, "", "\n", "x" * 5000]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(y), 0) for i, y in enumerate(label)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(df, labels, F.col("id") % 5 != 0)
    got = {x.doc_id: x.score for x in quality_crf.score(df, model).collect()}
    assert len(got) == len(texts) and all(0 <= x <= 1 for x in got.values())
    assert np.mean([(got[i] >= 0.3) == y for i, y in enumerate(label) if i % 5 == 0]) > 0.97
    plain = quality_crf.train(df, labels.limit(0), F.lit(True))
    assert {x.score for x in quality_crf.score(df, plain).collect()} == {0.5}
    assert quality_crf.score(df.limit(0), model).count() == 0
    split = quality_crf.line_features(*__import__("quarry.llm.common", fromlist=["packed"]).packed(__import__("pyarrow").table({"id": [1, 2, 3], "text": ["a\n\nb\n", "", "c"]}), "id", "text")[1:])
    assert split[1].tolist() == [1, 0, 1, 0, 0, 1] and split[2].tolist() == [0, 4, 5, 6]
