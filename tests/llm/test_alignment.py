"""Alignment of two tokenizers against brute force: other encoders calls, all pairs of tokens, sets of offsets."""

import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import alignment, queries

from .helpers import SCHEMA, docs

ODD = ["a", "b", "the", "Hello", " ", "  ", "\n", "\t", "'s", "'", "é", "漢字", "▁", "ﬁ", "１", " ", "　", "😀", "<|endoftext|>", "<s>", "\x00", "\x1c", "123", "don't", "…", "\r\n", "a" * 30, " \n ", "x̂", "​", "\x85"]


def nasty(seed, n):
    r = random.Random(seed)
    return [None, "", " ", "  ", "\n", "▁", "a ▁b", *("".join(r.choice(ODD) + r.choice(["", " ", " ", " "]) for _ in range(r.randint(1, 14))) for _ in range(n))]


@pytest.fixture(scope="module")
def spelled():
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    t = alignment.remembered(alignment.BYTE_BPE, alignment.PIECE_BPE).t
    letters = alignment._byte_letters()
    own = {i: bytes(letters[c] for c in x) for x, i in a.get_vocab().items() if all(c in letters for c in x)}

    def of(text):
        """(A ids, their ends, B ids, their ends), or nothing."""
        if not text:
            return None
        x, y, want = a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text), (" " + text).encode()
        p, q = [own[i] for i in x], [t.b_bytes[i] for i in y]
        return (x, np.cumsum([*map(len, p)]).tolist(), y, np.cumsum([*map(len, q)]).tolist()) if b"".join(p) == want == b"".join(q) else None

    return of


def wanted(rows, spelled):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row."""
    links, out, count = [], [], Counter()
    for _, text in rows:
        got, own = spelled(text), []
        if got:
            a, ea, b, eb = got
            sa, sb = [0, *ea], [0, *eb]
            own = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < eb[j] and sb[j] < ea[i]]
        links.append(own)
        count.update(own)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for (i, text), own in zip(rows, links):
        got = spelled(text)
        if not got:
            out.append((i, 0, 0, 0, 0, 0, 0, None))
            continue
        a, ea, b, eb = got
        cuts = sorted(set(ea) & set(eb))
        side = lambda ids, ends, lo, hi: ",".join(str(x) for x, e in zip(ids, ends) if lo < e <= hi)
        groups = ";".join(side(a, ea, lo, hi) + "|" + side(b, eb, lo, hi) for lo, hi in zip([0, *cuts], cuts))
        out.append((i, len(a), len(b), len(cuts), len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), groups))
    return out


def test_against_brute_force(spark, spelled):
    texts = nasty(5, 400)
    texts += texts[20:40]
    rows = [*enumerate(texts), (None, "the house"), (7, "twice"), (7, "twice")]
    out = alignment.align_tokens(docs(spark, [t for _, t in rows], [i for i, _ in rows]), chunk_bytes=2000)
    assert sorted(map(repr, (tuple(x) for x in out.collect()))) == sorted(map(repr, wanted(rows, spelled)))


def test_query(spark, tmp_path, spelled):
    import hashlib

    rows = list(enumerate([*nasty(6, 60), "the river " * 20_000]))
    docs(spark, [t for _, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: tuple(x) for x in queries.op11_token_alignment(spark, str(tmp_path)).collect()}
    small = wanted(rows[:-1], spelled)
    assert len(got) == len(rows)
    for i, n_a, n_b, n_groups, n_links, _, _, groups in small:
        assert got[i][:5] == (i, n_a, n_b, n_groups, n_links)
        assert got[i][7] == (hashlib.sha256(groups.encode()).hexdigest() if groups is not None else "")
    assert got[rows[-1][0]][1] > 20_000


def test_memory_is_bounded(spelled):
    memory = alignment.Memory(alignment.remembered(alignment.BYTE_BPE, alignment.PIECE_BPE).t)
    for k in range(4):
        u = alignment.Units(memory, [f"word{k}x{i} and" for i in range(50)], most=60)
        assert len(memory.ok) <= 60 + 60 and u.good.all() and u.groups()[3] == wanted([(0, f"word{k}x3 and")], spelled)[0][7]


def test_bitset_rank_and_select():
    r = np.random.default_rng(1)
    places = np.unique(r.integers(0, 1000, 300))
    bits = alignment.Bits.of(places, 1100)
    assert bits.select().tolist() == places.tolist()
    at = np.arange(1100)
    assert bits.rank(at).tolist() == np.searchsorted(places, at).tolist()


def test_empty(spark):
    assert alignment.align_tokens(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(x)[1:] for x in alignment.align_tokens(docs(spark, [None, ""])).collect()] == [(0, 0, 0, 0, 0, 0, None)] * 2
