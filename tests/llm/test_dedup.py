import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm.exact_dedup import exact_dedup
from quarry.llm import phrase_dedup as phrase_dedup_module
from quarry.llm.phrase_dedup import phrase_dedup
from quarry.llm.suffix_dedup import refine, repeats, suffix_dedup

from .helpers import corpus, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_phrases(rows, n=13):
    first = {}
    for i, t in sorted(rows):
        w = WORD.findall(t)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def brute_bytes(rows, n=100):
    first = {}
    for i, t in sorted(rows):
        b = t.encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], (i, k))
    out = []
    for i, t in rows:
        b, gone = t.encode(), set()
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < (i, k):
                gone |= set(range(k, k + n))
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(b), len(gone), spans, bytes(x for k, x in enumerate(b) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_phrases(spark, seed, small):
    texts = corpus(seed)
    ids = [7 * i % len(texts) for i in range(len(texts))]
    ids[-1] = ids[-2]  # repeated identifiers
    more = {"chunk_bytes": 900, "bucket_bytes": 700, "automaton_phrases": 20, "hot": 3} if small else {}
    out = phrase_dedup(docs(spark, texts, ids), **more)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect())
    assert got == brute_phrases([(i, t or "") for i, t in zip(ids, texts)])
    for r in out.collect():
        assert sum(b - a for a, b in r.spans) == r.n_removed
    assert phrase_dedup(docs(spark, [])).count() == 0


def test_phrases_null_identifier(spark):
    t = " ".join(f"w{i}" for i in range(15))
    got = {r.doc_id: r.n_removed for r in phrase_dedup(docs(spark, [t, t, t], [5, None, 2])).collect()}
    assert got == {2: 0, 5: 15, None: 15}


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_suffixes(spark, seed, small):
    texts = corpus(seed)
    ids = [7 * i % len(texts) for i in range(len(texts))]
    more = {"chunk_bytes": 900, "bucket_bytes": 700, "hot": 3} if small else {}
    out = suffix_dedup(docs(spark, texts, ids), **more)
    got = sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in out.collect())
    assert got == brute_bytes([(i, t or "") for i, t in zip(ids, texts)])
    assert suffix_dedup(docs(spark, [])).count() == 0


def test_suffixes_repeated_identifier(spark):
    t = "".join(f"<{i}>" for i in range(60))
    got = sorted(r.n_bytes - len(r.kept) for r in suffix_dedup(docs(spark, [t, t, t], [4, 4, 9])).collect())
    assert got == [0, 0, len(t)]


def test_exact(spark):
    texts = corpus(3)
    for keep in ("largest", "smallest"):
        for bits in (256, 8):
            got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs(spark, texts), keep=keep, digest_bits=bits, memtable_bytes=500).collect()}
            same = {}
            for i, t in enumerate(texts):
                same.setdefault(t or "", []).append(i)
            want = {}
            for t, of in same.items():
                k = max(of) if keep == "largest" else min(of)
                want |= {i: (k, len(of), i == k, hashlib.sha256(t.encode()).hexdigest()) for i in of}
            assert got == want
    assert exact_dedup(docs(spark, [])).count() == 0
    assert sorted((r.kept, r.group_size) for r in exact_dedup(docs(spark, ["a", "a", None], [None, 3, None])).collect()) == [(False, 2), (True, 1), (True, 2)]


def brute_fingerprint(t, n=3):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_phrases_are_told_apart_by_words(spark, monkeypatch):
    """Where all windows have one hash, still only phrases that are equal word by word go."""
    r = np.random.default_rng(5)
    codes = r.integers(0, 3, 400)
    at = np.arange(400 - 4)
    want = {}
    for number, i in zip(phrase_dedup_module.phrases_of(codes, at, 5), at):
        want.setdefault(tuple(codes[i : i + 5]), set()).add(number)
    assert all(len(x) == 1 for x in want.values()) and len(set.union(*want.values())) == len(want)
    monkeypatch.setattr(phrase_dedup_module, "gram_hashes", lambda x, n, salt=0: np.zeros(max(0, len(x) - n + 1), dtype=np.uint64))
    again = {}
    for number, i in zip(phrase_dedup_module.phrases_of(codes, at, 5), at):
        again.setdefault(tuple(codes[i : i + 5]), set()).add(number)
    assert all(len(x) == 1 for x in again.values()) and len(set.union(*again.values())) == len(want)


def test_automata_locate_every_occurrence():
    codes = np.random.default_rng(6).integers(0, 4, 500)
    codes[100:120] = 70_000 + np.arange(20) * 5000  # letters on both sides of the surrogates
    phrases = np.array([3, 100, 107, 250])
    place, which = phrase_dedup_module.located(codes, phrases, 13)
    want = {(i, k) for i in range(488) for k, p in enumerate(phrases) if np.array_equal(codes[i : i + 13], codes[p : p + 13])}
    assert set(zip(place.tolist(), which.tolist())) == want and {k for _, k in want} == {0, 1, 2, 3}


@pytest.mark.parametrize("block", [1, 50, 1 << 16])
def test_refinement_sorts_suffixes(block):
    r = np.random.default_rng(block)
    for letters, n in ((2, 600), (1, 300), (4, 900), (250, 500)):
        text = np.r_[r.integers(0, letters, n), np.zeros(40, dtype=int)].astype(np.uint8)
        text = np.r_[text, text[100:260], text[:90]]
        body, depth = text.tobytes(), 40
        order, pointer, _ = refine(text, depth, block=block)
        inner = [i for i in order.tolist() if i + depth <= len(body)]
        heads = [body[i : i + depth] for i in inner]
        assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(body)))
        for a, b in zip(inner, inner[1:]):
            assert pointer[a] != pointer[b] or body[a : a + depth] == body[b : b + depth]
        remain = len(body) - np.arange(len(body))
        at, number = repeats(text, remain, depth)
        want = {}
        for i in range(len(body) - depth + 1):
            want.setdefault(body[i : i + depth], []).append(i)
        got = {}
        for i, k in zip(at.tolist(), number.tolist()):
            got.setdefault(k, []).append(i)
        assert sorted(map(sorted, got.values())) == sorted(x for x in want.values() if len(x) > 1)


def test_a_hot_passage_in_differing_surroundings(spark):
    """One passage as long as an anchor in every document: its key is split, and nothing but real repeats goes."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    line = " ".join(["hot"] * 3 + ["passage", "of", "forty", "bytes", "or", "so"])
    texts = [" ".join(r.choices(words, k=25)) + " " + line + " " + " ".join(r.choices(words, k=25)) for _ in range(60)]
    texts += [t for t in texts[:6]] + ["long " + " ".join(r.choices(words, k=30_000)) + " " + texts[3]]
    for hot in (64, 2):
        out = phrase_dedup(docs(spark, texts), chunk_bytes=900, bucket_bytes=2000, hot=hot)
        assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in out.collect()) == brute_phrases(list(enumerate(texts)))
        out = suffix_dedup(docs(spark, texts), chunk_bytes=900, bucket_bytes=2000, hot=hot)
        assert sorted((x.doc_id, x.n_bytes, x.n_bytes - len(x.kept), len(x.spans), bytes(x.kept)) for x in out.collect()) == brute_bytes(list(enumerate(texts)))


def test_exact_very_long_texts(spark):
    long = "long text " * 200_000
    got = {x.doc_id: (x.keep_id, x.group_size) for x in exact_dedup(docs(spark, [long, long + "x", long])).collect()}
    assert got == {0: (2, 2), 1: (1, 1), 2: (2, 2)}
