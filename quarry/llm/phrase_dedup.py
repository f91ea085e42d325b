"""Substring dedup by repeated-phrase automata.

A phrase is a window of so many consecutive words of one document. A window's anchor is the smallest hash of the short word
runs in it, so equal windows have equal anchors, and a document falls into runs of windows of one anchor. Every run whose anchor
recurs anywhere is sent to the shard (bucket) of its anchor. A shard confirms, word by word, the phrases that documents of
different identifiers hold, with the smallest identifier of each; compiles the confirmed ones into Aho-Corasick automata whose
letters are words; and streams all runs that any document sent through them. Every occurrence so located in a document with a
greater identifier is removed. Hashes decide only what meets: nothing is removed that is not equal word by word.

Defined results: words are [^\\x20\\x09-\\x0D]+, unchanged; a null or empty text has none; windows are judged on the input;
repeats in one document, or in rows with the same identifier, do not count; a null identifier comes after all others; a very
long text is whole in its chunk's task, and its runs go to many shards; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import cached_property
from itertools import chain, compress

import numpy as np
from pyspark.sql import DataFrame

from .common import mixed, packed, pieces, sliding_minimum, span_hashes, text_bytes, words_of
from .recurrence import ANSWER, HOT, Runs, answered, chosen, chunked, edges, expanded, gram_hashes, marked, met, opened, recurring, spans

_SECOND = 0x5851F42D4C957F2D


class _Chunk:
    """Words and windows of a chunk's documents, in the order of identifiers."""

    def __init__(self, table, window: int, anchor: int):
        self.table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids, self.body, begin = packed(self.table, "id", "text")
        self.start, self.end, self.first = words_of(self.body, begin)
        self.window, self.anchor = window, anchor
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        n = max(0, len(row) - window + 1)
        self.row, self.ok = row[:n], row[:n] == row[len(row) - n :]  # of the window that begins at each word

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hashes(self.body, self.start, self.end)

    def anchors(self, salt: int = 0) -> np.ndarray:
        """Of the window that begins at each word."""
        if not len(self.row):
            return np.zeros(0, dtype=np.uint64)
        return mixed(sliding_minimum(gram_hashes(self.hash, self.anchor, salt), self.window - self.anchor + 1)) & ~np.uint64(1)

    def named(self) -> np.ndarray:
        """The chunk's anchors; the lowest bit is set if two identifiers have it."""
        x, row = self.anchors()[self.ok], self.row[self.ok]
        if not len(x):
            return x
        once = np.r_[True, (x[1:] != x[:-1]) | (row[1:] != row[:-1])]
        x, own = x[once], self.ids[row[once]]
        order = np.argsort(x, kind="stable")
        x, own = x[order], own[order]
        edge = edges(x)
        return x[edge] | (np.minimum.reduceat(own, edge) != np.maximum.reduceat(own, edge)).astype(np.uint64)

    def runs(self, keys: np.ndarray) -> Runs:
        key, ok = chosen(self.anchors(), self.ok, keys, lambda: self.anchors(_SECOND))
        a, b = spans(key, self.row, ok)
        row = self.row[a]
        return Runs(key[a], row, self.ids[row], a - self.first[row], self.start[a], self.end[b + self.window - 1] if len(b) else b, self.body)


def phrases_of(codes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The number of the phrase of window codes that begins at each place: by hash, and by words where a hash stands for two phrases."""
    key = gram_hashes(mixed(codes.astype(np.uint64) + np.uint64(1)), window)[at]
    order = np.argsort(key, kind="stable")
    edge = np.r_[True, key[order][1:] != key[order][:-1]]
    number = np.empty(len(at), dtype=np.int64)
    number[order] = np.cumsum(edge) - 1
    own, head = at[order], at[order][np.flatnonzero(edge)][np.cumsum(edge) - 1]
    if all(np.array_equal(codes[own + k], codes[head + k]) for k in range(window)):
        return number
    return np.unique(codes[at[:, None] + np.arange(window)], axis=0, return_inverse=True)[1].reshape(-1)


def located(codes: np.ndarray, phrases: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, phrase) of every occurrence in the stream codes of the phrases that begin at the places given: one automaton, a letter a word."""
    import ahocorasick

    known = np.unique(codes[phrases[:, None] + np.arange(window)])
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    letter = np.where(known[at] == codes, at + 1, 0)  # 0: in no phrase
    stream = (letter + np.where(letter >= 0xD800, 0x800, 0)).astype("<u4").tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, p in enumerate(phrases.tolist()):
        automaton.add_word(stream[p : p + window], k)
    automaton.make_automaton()
    hits = np.fromiter(chain.from_iterable(automaton.iter(stream)), dtype=np.int64).reshape(-1, 2)
    return hits[:, 0] - window + 1, hits[:, 1]


def _shard(table, window: int, automaton_phrases: int):
    """Of one shard: for each chunk, the windows (row, first, last) that a smaller identifier has too."""
    texts, places = opened(table)
    number: dict[bytes, int] = {b"": 0}  # a code of its own parts the texts in the stream
    size, codes = np.zeros(len(texts), dtype=np.int64), [0]
    for k, x in enumerate(texts):
        words = x.split()
        size[k] = len(words)
        codes.extend([number.setdefault(w, len(number)) for w in words])
        codes.append(0)
    codes = np.array(codes)
    begin = np.cumsum(size + 1) - size
    least, most = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), np.iinfo(np.int64).min)
    for p in places:
        np.minimum.at(least, p.of, p.id)
        np.maximum.at(most, p.of, p.id)
    windows = size - window + 1
    of = np.repeat(np.arange(len(texts)), windows)
    at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(len(of))
    phrase = phrases_of(codes, at, window)
    n = int(phrase.max(initial=-1)) + 1
    low, high, first = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, dtype=np.int64)
    np.minimum.at(low, phrase, least[of])
    np.maximum.at(high, phrase, most[of])
    first[phrase[::-1]] = at[::-1]
    confirmed = np.flatnonzero(high > low)
    found, bound = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for k in range(0, len(confirmed), automaton_phrases):
        some = confirmed[k : k + automaton_phrases]
        place, which = located(codes, first[some], window)
        found.append(place)
        bound.append(low[some][which])
    found, bound = np.concatenate(found), np.concatenate(bound)
    order = np.argsort(found)
    found, bound = found[order], bound[order]
    # neighbours with one bound are one finding
    new = np.flatnonzero(np.r_[True, (np.diff(found) != 1) | (np.diff(bound) != 0)]) if len(found) else found
    a, b, bound = found[new], found[np.r_[new[1:], len(found)] - 1] if len(new) else found, bound[new]
    text = np.searchsorted(begin, a, side="right") - 1
    a, b = a - begin[text], b - begin[text]
    lower = np.searchsorted(text, np.arange(len(texts)))
    count = np.searchsorted(text, np.arange(len(texts)), side="right") - lower
    out = []
    for p in places:
        place, one = expanded(p.of, lower, count)
        goes = p.id[place] > bound[one]
        place, one = place[goes], one[goes]
        out.append((p.chunk, p.row[place], p.start[place] + a[one], p.start[place] + b[one]))
    return answered(out)


def phrase_dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 13, anchor: int = 5, chunk_bytes: int = 4 << 20, bucket_bytes: int = 2 << 20, automaton_phrases: int = 50_000, hot: int = HOT
) -> DataFrame:
    """One row for each of docs: id, n_words, n_removed, kept (the words that stay, joined by one space), spans (word numbers from, to of what went)."""
    total = text_bytes(docs, text)
    buckets = pieces(total, bucket_bytes)
    chunks = chunked(docs, id, text, pieces(total, chunk_bytes))
    anchors = recurring(chunks, lambda t: _Chunk(t, window, anchor).named(), buckets, hot)
    sent = met(chunks, anchors, lambda t, keys: _Chunk(t, window, anchor).runs(keys), buckets)
    late = sent.groupBy("bucket").applyInArrow(lambda t: _shard(t, window, automaton_phrases), ANSWER)

    def remove(left, right):
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])
        if not left.num_rows:
            return schema.empty_table()
        c = _Chunk(left, window, anchor)
        gone = marked(right, c.first, len(c.start), window)
        out = {"id": c.table.column("id"), "n_words": np.diff(c.first), "n_removed": [], "kept": [], "spans": []}
        lost = np.r_[0, np.cumsum(gone)]
        for r, x in enumerate(c.table.column("text").cast(pa.binary()).to_pylist()):
            a, b = c.first[r], c.first[r + 1]
            words, n = (x or b"").split(), int(lost[b] - lost[a])
            out["n_removed"].append(n)
            out["kept"].append(b" ".join(compress(words, (~gone[a:b]).tolist()) if n else words).decode())
            g = np.diff(np.r_[False, gone[a:b], False].astype(np.int8)) if n else np.zeros(0, dtype=np.int8)
            out["spans"].append(np.stack([np.flatnonzero(g == 1), np.flatnonzero(g == -1)], axis=1).tolist() if n else [])
        return pa.table(out, schema=schema)

    out = chunks.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(remove, "id long, n_words long, n_removed long, kept string, spans array<array<int>>")
    return out.withColumnRenamed("id", id)
