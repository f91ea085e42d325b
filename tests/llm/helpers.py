import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, id string, fp string"


def docs(spark, texts, ids=None, sources=None):
    ids = ids if ids is not None else range(len(texts))
    sources = sources if sources is not None else ["s"] * len(texts)
    return spark.createDataFrame([(i, t, None, s, None, 1, "x", None) for i, t, s in zip(ids, texts, sources)], SCHEMA)


def corpus(seed=1, n=60):
    """Texts with copies, shared passages, edge cases and odd characters."""
    r = random.Random(seed)
    words = [a + b for a in "abcdefgh" for b in ("", "é", "xy", "漢")]
    passages = [" ".join(r.choices(words, k=r.randint(12, 60))) for _ in range(6)]
    out = [None, "", " ", "\n\t", "a", "a" * 400, "ab" * 300, "é" * 130]
    while len(out) < n:
        t = " ".join(r.choices(words, k=r.randint(0, 80)))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 20)
            t += r.choice([" ", "\n", "  "]) + p[a : r.randint(a, len(p))] + " " + r.choice(words)
        out.append(t)
    return out + r.sample(out, 20)
