import random

from quarry.llm.mixing import mix

from .helpers import docs


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(repeats * sizes[s] for s in full), [s for s in order if s not in full]
        t = {s: repeats * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in open_) for s in order}
        over = {s for s in open_ if t[s] > repeats * sizes[s] + 1e-9}
        if not over:
            return t
        full |= over


def check(spark, texts, sources, **more):
    out = mix(docs(spark, texts, sources=sources), **more)
    got = {r.doc_id: r for r in out.collect()}
    assert got == {r.doc_id: r for r in out.collect()} and len(got) == len(texts)
    size = [len((t or "").split()) for t in texts]
    per = {}
    for s, n in zip(sources, size):
        per[s] = per.get(s, 0) + n
    want = brute_targets(per)
    taken = dict.fromkeys(per, 0)
    for i, s in enumerate(sources):
        r = got[i]
        assert (r.size, r.source_size) == (size[i], per[s]) and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    return taken, want


def test_mix(spark):
    r = random.Random(1)
    for n, names in ((400, ["a", "b", None, "É", "z"]), (300, ["x"]), (500, [f"s{i}" for i in range(23)])):
        sources = [r.choice(names[: r.randint(1, len(names))]) for _ in range(n)]
        texts = [r.choice([None, "", "w " * r.randint(1, 90)]) for _ in range(n)]
        for more in ({}, {"blocks": 2000, "shard_words": 500}):
            taken, want = check(spark, texts, sources, **more)
            slack = 2 if not more else 60
            assert all(abs(taken[s] - want[s]) <= slack for s in want), (taken, want)


def test_mix_edges(spark):
    assert mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mix(docs(spark, [None, ""], sources=[None, "a"])).collect()] == [0, 0]


def test_quotas_by_highest_quotients(spark):
    from quarry.llm.mixing import apportion

    r = random.Random(5)
    for _ in range(4):
        votes, seats = [r.choice([1, 3, r.randint(1, 1000)]) for _ in range(r.randint(1, 30))], r.randint(0, 90)
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "k int, v long, seats long")
        got = {x.k: x.q for x in apportion(df, [], ["k"], "v", "seats", "q").collect()}
        best = sorted(((-v / (2 * j + 1), i) for i, v in enumerate(votes) for j in range(seats)))[:seats]
        assert got == {i: sum(1 for _, k in best if k == i) for i in range(len(votes))}
