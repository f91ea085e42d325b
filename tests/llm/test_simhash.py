import math
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from quarry.llm import simhash
from quarry.llm.common import components
from quarry.llm.simhash import fingerprint, shingle_set, shingles, simhash_dedup

from .helpers import corpus, docs
from .test_dedup import brute_fingerprint

CONTRACT = {"shingle": 3, "distance": 2, "segments": 2, "similarity": None, "repeats": True}


def grouped(n, linked):
    """The smallest member of each one's group."""
    root = list(range(n))
    for j in range(n):
        for i in range(j):
            if root[i] != root[j] and linked(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def test_contract_against_brute_force(spark):
    texts = corpus(4, 40) + ["q r s t u v w x y z " * 40 + str(i) for i in range(30)] + ["A É b", "a É b", "one two", "ONE two ", "long text " * 50_000]
    fps = [brute_fingerprint(t) for t in texts]
    assert [fingerprint(shingles((t or "").encode(), 3)) for t in texts] == fps
    want = grouped(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    for hot in (simhash.HOT, 1):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(docs(spark, texts), hot=hot, **CONTRACT).collect()}
        assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}
    assert simhash_dedup(docs(spark, []), **CONTRACT).count() == 0
    assert simhash_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("distance,segments", [(0, 2), (2, 2), (2, 4), (3, 3), (7, 3), (11, 4)])
def test_matches_are_all_pairs_within_the_distance(spark, distance, segments):
    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, distance + 3))) for b in base for _ in range(14)]
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f, 1, i) for i, f in enumerate(fps)], "node long, fp long, n long, c long")
    want = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= distance}
    for hot in (simhash.HOT, 0):
        assert {(x.a, x.b) for x in simhash.matches(nodes, distance, segments, hot=hot).collect()} == want


def test_verification_rejects_what_a_table_matches(spark):
    # equal in the first segment, far apart in the second: they meet at an address, and the complete distance parts them
    nodes = spark.createDataFrame([(0, 5, 1, 0), (1, 5 | 7 << 40, 1, 1), (2, 5 | 1 << 40, 1, 2)], "node long, fp long, n long, c long")
    parts = simhash.segments_of(2, 2)
    met = simhash.addresses(nodes, parts, True).alias("a").join(simhash.addresses(nodes, parts, False).alias("b"), "address").where("a.node < b.node")
    assert {(x.a, x.b) for x in met.selectExpr("a.node a", "b.node b").collect()} == {(0, 1), (0, 2), (1, 2)}
    assert {(x.a, x.b) for x in simhash.matches(nodes, 2, 2).collect()} == {(0, 2), (1, 2)}


def test_repeated_and_null_identifiers(spark):
    texts = ["one two three four", "one two three four", None, "", "five six seven", "five six seven", "eight"]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_dedup(docs(spark, texts, [4, 4, None, 9, None, None, 1]), **CONTRACT).collect())
    assert got == sorted([("4", "4"), ("4", "4"), ("None", "9"), ("9", "9"), ("None", "None"), ("None", "None"), ("1", "1")])


def edited(r, words, k):
    words = list(words)
    for i in r.sample(range(len(words)), k):
        words[i] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def near_texts():
    """Copies with more and more words changed, a long common line, short and empty texts."""
    r = random.Random(3)
    out = [None, "", " ", "a", "A", "a b", "a b c d e", "a b c d e f"]
    line = [f"line{i}" for i in range(60)]
    for n in (12, 60, 200):
        base = [f"w{r.randrange(5000)}" for _ in range(n)]
        out += [edited(r, base, k) for k in (0, 0, 1, 1, 2, 3, 4, 5, 6, 8) if k < n]
    out += [" ".join([*line, *(f"v{r.randrange(10**6)}" for _ in range(r.randint(3, 40)))]) for _ in range(30)]
    r.shuffle(out)
    return out


def test_similarity_against_brute_force(spark):
    texts = near_texts()
    own = [set(shingle_set((t or "").encode()).tolist()) for t in texts]
    fps = [fingerprint(shingle_set((t or "").encode())) for t in texts]

    def similar(i, j):
        return 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])

    want = grouped(len(texts), lambda i, j: similar(i, j))
    assert len(set(want)) < len(texts) - 15
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash_dedup(docs(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", c) for i, c in enumerate(want)}


@pytest.mark.parametrize("most", [3, 512])
def test_tiles_join_what_leaders_have_not(spark, monkeypatch, most):
    """Without leaders all is left to the tiles, whose groups have many blocks or one; the forest joins what all similar pairs join."""
    monkeypatch.setattr(simhash, "LEADERS", 0)
    monkeypatch.setattr(simhash, "_NODES", most)
    texts = near_texts()
    own = [set(shingle_set((t or "").encode()).tolist()) for t in texts]
    want = grouped(len(texts), lambda i, j: 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]))
    assert {x.doc_id: x.component_id for x in simhash_dedup(docs(spark, texts)).collect()} == dict(enumerate(want))


def test_recall_of_planted_near_copies(spark):
    """Of texts of 150 to 400 words, copies of at most one word in 60 changed: 0.9 of those with similarity 0.8 or more must go."""
    r = random.Random(9)
    texts, own = [], []
    for _ in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(150, 400))]
        texts += [" ".join(base), edited(r, base, max(1, len(base) // r.choice((60, 80, 150))))]
    for t in texts:
        own.append(set(shingle_set(t.encode()).tolist()))
    want = [i + 1 for i in range(0, 120, 2) if 100 * len(own[i] & own[i + 1]) >= 80 * len(own[i] | own[i + 1])]
    got = {x.doc_id for x in simhash_dedup(docs(spark, texts)).collect() if x.doc_id != x.component_id}
    assert len(want) > 40 and got <= set(want) and len(got) >= 0.9 * len(want)


SF = Path("/root/testdata/sf0.1/documents.parquet")


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
def test_all_similar_pairs_of_the_given_table(spark):
    """Every pair of different texts with a similarity of 0.8, found by prefixes of sets in the order of frequency, is linked."""
    rows = {r.text or "": r.doc_id for r in spark.read.parquet(str(SF)).select("doc_id", "text").orderBy("doc_id").collect()}
    texts, ids = list(rows), list(rows.values())
    own = [shingle_set(t.encode()) for t in texts]
    every, place, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    begin, met, pairs = np.cumsum([0, *map(len, own)]), defaultdict(list), set()
    for k, x in enumerate(own):
        at = place[begin[k] : begin[k + 1]]
        for s in sorted(at.tolist(), key=lambda s: (times[s], s))[: len(x) - math.ceil(0.8 * len(x)) + 1]:
            if times[s] > 1:
                pairs |= {(i, k) for i in met[s]}
                met[s].append(k)
    similar = {(i, k) for i, k in pairs if 180 * len(np.intersect1d(own[i], own[k], assume_unique=True)) >= 80 * (len(own[i]) + len(own[k]))}
    root = {i: i for i in range(len(texts))}
    for i, k in sorted(similar):
        a, b = root[i], root[k]
        for j in [j for j in root if root[j] in (a, b)] if a != b else ():
            root[j] = min(a, b)
    least = {}
    for j, r in root.items():
        least[r] = min(ids[j], least.get(r, ids[j]))
    got = {r.doc_id: r.component_id for r in simhash_dedup(docs(spark, texts, ids).repartition(4)).select("doc_id", "component_id").collect()}
    assert len(similar) > 40 and got == {i: least[root[j]] for j, i in enumerate(ids)}


def test_components_in_one_task_and_by_stars(spark):
    r = random.Random(10)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 430)] + [(-5, 7), (7, 7)]
    root = {i: i for e in edges if e[0] != e[1] for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    links = spark.createDataFrame(edges, "a long, b long")
    for local in (1000, -1):
        assert {x.node: x.component for x in components(links, local).collect()} == {i: find(i) for i in root}
        assert components(links.limit(0), local).count() == 0
