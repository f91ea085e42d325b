import itertools
import random

import numpy as np
import pytest

from quarry.llm.pieces import SPACE, Units, backward, forward, streamed, viterbi, vocabulary
from quarry.llm.sentencepiece_codec import Encoder, decode, sentencepiece_decode, sentencepiece_encode

from .helpers import corpus, docs

TEXTS = [None, "", " ", "   ", "a", "Hello  world\nfoo", "▁x ▁", "<0x0A> <s>", "é漢\t\r\n", "x" * 500, "ab" * 200 + " " * 90, "\U0001f600 ok \U0010ffff", *corpus(9, 30)]


def brute(vocab, unit):
    """Best segmentation of a whole unit by a plain Viterbi."""
    look = {vocab.pieces[i]: int(i) for i in vocab.normal}
    best = [(0.0, [])]
    for t in range(1, len(unit) + 1):
        options = []
        for l in range(min(t, vocab.longest), 0, -1):
            p = unit[t - l : t]
            ids = [look[p]] if p in look else vocab.unknown(ord(p)) if l == 1 else None
            if ids and best[t - l]:
                options.append((best[t - l][0] + sum(vocab.score[i] for i in ids), best[t - l][1] + ids))
        best.append(max(options, key=lambda x: x[0]))
    return best[-1][1]


def test_streaming_viterbi_is_the_whole_one():
    vocab, r = vocabulary(), random.Random(3)
    units = ["".join(r.choices("thereinaxé漢" + SPACE * 2, k=r.randint(1, 62))).lstrip(SPACE) or "a" for _ in range(200)] + [SPACE * 5 + "the", "-" * 40, "there" * 60]
    want = [brute(vocab, u) for u in units]
    assert [streamed(vocab, u) for u in units] == want
    ids, spans = viterbi(vocab, units)
    assert [ids[a:b].tolist() for a, b in spans] == want


@pytest.mark.parametrize("memory", [5, 100_000])
def test_round_trip(memory):
    e = Encoder(memory=memory)
    for k in range(0, len(TEXTS), 7):
        texts = [x for x in TEXTS[k : k + 7] if x is not None]
        ids, begin = e.encode(texts)
        assert decode(e.vocab, ids, begin) == texts


def test_whole_text_equals_units():
    e = Encoder()
    for x in TEXTS[4:20]:
        if x:
            ids, _ = e.encode([x])
            assert ids.tolist() == streamed(e.vocab, e.vocab.spaced(x))


def test_library_decodes_the_same():
    import sentencepiece

    from quarry.llm.pieces import MODEL

    sp, e = sentencepiece.SentencePieceProcessor(model_file=MODEL), Encoder()
    for x in corpus(5, 20):
        if x:
            assert sp.decode(e.encode([x])[0].tolist()) == x


def test_tables(spark):
    df = docs(spark, TEXTS)
    out = sentencepiece_decode(sentencepiece_encode(df, ids="own"), ids="own").collect()
    assert sorted(((r.doc_id, r.decoded) for r in out)) == list(enumerate(TEXTS))
    assert all((r.own is None) == (r.text is None) for r in out)
    assert sentencepiece_decode(sentencepiece_encode(docs(spark, []))).count() == 0


def test_sums_over_all_segmentations():
    vocab = vocabulary()
    look = {vocab.pieces[i]: int(i) for i in vocab.normal}
    table = np.log(np.random.default_rng(0).dirichlet(np.ones(vocab.size), 2).T)
    units = ["the", SPACE + "there", "漢é", "in", "\x01a"]
    u = Units(vocab, units)
    f = forward(u, table)
    b = backward(u, u.rows(table) if not hasattr(u, "kinds") else np.concatenate([table, np.stack([table[vocab.unknown(int(c))].sum(axis=0) for c in u.kinds])]))
    for lane, k in enumerate(u.order):
        x, total = units[k], np.zeros(2)
        for cut in itertools.product([0, 1], repeat=len(x) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(x)]
            p = [x[i:j] for i, j in itertools.pairwise(at)]
            ids = [[look[q]] if q in look else vocab.unknown(ord(q)) if len(q) == 1 else None for q in p]
            if all(ids):
                total += np.exp(table[[i for y in ids for i in y]].sum(axis=0))
        assert np.allclose(f[u.end[lane] + lane], np.log(total))
        assert np.allclose(b[u.start[lane] + lane], np.log(total))
