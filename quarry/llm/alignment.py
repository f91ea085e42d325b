"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizers spell out one and the same byte string, a space and the text. A packed bitset for each marks the bytes at which
a token ends. AND of the two yields the shared cuts, which part the tokens into groups; the number of bits set before a cut
(rank, by a directory of popcounts) tells how many tokens of each side lie before it; OR yields the places at which either side
ends, and each such place is one link: the A token and the B token that both reach to it, whose byte ranges overlap.

No token of either vocabulary crosses a single space between two other characters, so a text falls into units there, and
both sides end at each unit's end. Equal units align equally: a chunk of documents aligns each distinct unit once, many laid
end to end in one bitset. Links are counted by id pair in each chunk, the counts of all chunks are summed by pair, and each
chunk is told the sums of its own pairs; the greatest for each B id are no more than the vocabulary has ids.

Defined results: a text that is null or empty, or that one side does not spell exactly (B has no way to write U+2581, and its
normalisation may change a character), has no tokens; strings of special tokens are plain text; a null identifier and repeated
rows are rows like others, all counted; a very long text is whole in its chunk's task; of equally frequent A ids for a B id all
are best; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_bytes, written
from .recurrence import chunked

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how this public byte-level vocabulary parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of units that are encoded together.
_BATCH = 1 << 18
_LITERAL = "▁"
#: Units that a worker remembers, about; a chunk's own come on top.
MEMORY = 250_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Sides A (byte-level) and B (pieces): encoders and the bytes of each id."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        import tiktoken

        with open(byte_bpe, encoding="utf-8") as f:
            file, letters = json.load(f), _byte_letters()
        special = {x["id"] for x in file.get("added_tokens", [])}
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in file["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.a_bytes[i] = b
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        odd = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(len(names))]
        self.b_bytes = [b"" if odd[i] else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_LITERAL, " ").encode() for i, p in enumerate(names)]
        self.parts = not any(_LITERAL in p.lstrip(_LITERAL) for i, p in enumerate(names) if not odd[i])
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes] | None:
        """(A ids, B ids, bytes) of a space and the text; None if either side spells other bytes."""
        own = (" " + text).encode()
        a = self.a.encode_to_numpy(" " + text).astype(np.int64)
        b = np.array(self.b.encode(text), dtype=np.int64)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != own or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != own:
            return None
        return a, b, own


@lru_cache(maxsize=2)
def remembered(byte_bpe: str, piece_bpe: str) -> Memory:
    return Memory(Tokenizers(byte_bpe, piece_bpe))


class Bits:
    """A packed bitset with a directory for rank."""

    def __init__(self, words: np.ndarray):
        self.words, self.before = words, np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, dtype=bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all bits set, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@lru_cache(maxsize=4)
def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 to n - 1, right-aligned over zero bytes, with one column more."""
    width = len(str(n))
    out = np.zeros((n, width + 1), dtype=np.uint8)
    for i in range(n):
        s = str(i).encode()
        out[i, width - len(s) : width] = np.frombuffer(s, dtype=np.uint8)
    return out


class Aligned:
    """Units laid end to end: for each, numbers of tokens and groups, where its links begin, and its groups as text, each ended by a semicolon."""

    def __init__(self, t: Tokenizers, a: np.ndarray, b: np.ndarray, ends: np.ndarray):
        a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        size = int(ends[-1]) + 65  # the place after the last byte has a word, too
        side_a, side_b = Bits.of(a_end, size), Bits.of(b_end, size)
        shared, either = Bits(side_a.words & side_b.words), Bits(side_a.words | side_b.words)
        self.whole = bool((shared.rank(ends + 1) > shared.rank(ends)).all())
        if not self.whole:
            return
        links = either.select()
        self.pairs = (a[side_a.rank(links)] << 32) | b[side_b.rank(links)]
        of = [np.diff(np.r_[0, x.rank(ends + 1)]) for x in (side_a, side_b, shared, either)]
        self.n_a, self.n_b, self.n_groups, self.n_links = of
        cuts = shared.select()
        a_to, b_to = side_a.rank(cuts + 1), side_b.rank(cuts + 1)
        a_group, b_group = shared.rank(a_end), shared.rank(b_end)
        cells = np.empty((len(a) + len(b), max(_digits(len(t.a_size)).shape[1], _digits(len(t.b_size)).shape[1])), dtype=np.uint8)
        for ids, place, table, last in ((a, np.arange(len(a)) + np.r_[0, b_to][a_group], len(t.a_size), b"|"), (b, np.arange(len(b)) + a_to[b_group], len(t.b_size), b";")):
            own, group = _digits(table)[ids], a_group if last == b"|" else b_group
            ended = np.r_[group[1:] != group[:-1], True]
            own[:, -1] = np.where(ended, last[0], b","[0])
            cells[place, cells.shape[1] - own.shape[1] :] = own
            cells[place, : cells.shape[1] - own.shape[1]] = 0
        on = cells != 0
        text, to = cells[on].tobytes(), np.r_[0, np.cumsum(on.sum(axis=1))][np.cumsum(self.n_a + self.n_b)].tolist()
        self.groups = [text[f:e] for f, e in zip([0, *to[:-1]], to)]


class Memory:
    """Units met so far, aligned: a worker keeps them from one chunk to the next, up to so many."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.ok, self.edged = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
        self.groups: list[bytes] = []
        self.counts, self.first = np.zeros((4, 0), dtype=np.int64), np.zeros(0, dtype=np.int64)  # A, B, groups, links; the first link
        self.pairs = np.zeros(0, dtype=np.int64)

    def learn(self) -> None:
        """Aligns the units numbered since the last time."""
        old, t = len(self.ok), self.t
        names = list(itertools.islice(self.number, old, None))
        n = len(names)
        edged = np.fromiter((not x or x[0].isspace() or x[-1].isspace() for x in names), dtype=bool, count=n)
        # units with spaces at an edge, or the letter that stands for a space, are encoded by themselves
        alone = edged | np.fromiter((_LITERAL in x or not t.parts for x in names), dtype=bool, count=n)
        batch = np.cumsum(np.fromiter(map(len, names), dtype=np.int64, count=n) + 1) // _BATCH
        together = np.flatnonzero(~alone)
        todo = [[k] for k in np.flatnonzero(alone).tolist() if names[k]] + [g.tolist() for g in np.split(together, np.flatnonzero(np.diff(batch[together])) + 1) if len(g)]
        ok, groups, counts, first, found, links = np.zeros(n, dtype=bool), [b""] * n, np.zeros((4, n), dtype=np.int64), np.zeros(n, dtype=np.int64), [self.pairs], len(self.pairs)
        while todo:
            some = todo.pop()
            got = t.encoded(" ".join(names[k] for k in some)) if len(some) > 1 or _LITERAL not in names[some[0]] else None
            x = Aligned(t, got[0], got[1], np.cumsum([len(names[k].encode()) + 1 for k in some])) if got else None
            if x is None or not x.whole:
                if len(some) > 1:
                    todo += [some[: len(some) // 2], some[len(some) // 2 :]]
                continue
            ok[some], counts[:, some], first[some] = True, (x.n_a, x.n_b, x.n_groups, x.n_links), links + np.cumsum(x.n_links) - x.n_links
            for k, g in zip(some, x.groups):
                groups[k] = g
            found.append(x.pairs)
            links += len(x.pairs)
        self.ok, self.edged, self.first = (np.concatenate(x) for x in ((self.ok, ok), (self.edged, edged), (self.first, first)))
        self.counts, self.pairs, self.groups = np.concatenate([self.counts, counts], axis=1), np.concatenate(found), self.groups + groups


class Units:
    """The texts of a chunk as numbers of units."""

    def __init__(self, memory: Memory, texts: list[str | None], most: int = MEMORY):
        if len(memory.number) > most:
            memory.forget()
        self.memory, get = memory, memory.number.__getitem__

        def numbers(units: list[str]) -> np.ndarray:
            return np.fromiter(map(get, units), dtype=np.int64, count=len(units))

        rows = [numbers([] if not x else x.split(" ") if memory.t.parts else [x]) for x in texts]
        memory.learn()
        if memory.t.parts:  # a space with another beside it parts nothing
            space = re.compile(r"(?<=\S) (?=\S)")
            for k in np.unique(np.repeat(np.arange(len(rows)), list(map(len, rows)))[memory.edged[np.concatenate([*rows, np.zeros(0, dtype=np.int64)])]]).tolist():
                rows[k] = numbers(space.split(texts[k]))
            memory.learn()
        self.flat, self.begin = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]), np.cumsum([0, *map(len, rows)])
        bad = np.r_[0, np.cumsum(~memory.ok[self.flat])][self.begin]
        self.good = (np.diff(self.begin) > 0) & (bad[1:] == bad[:-1])
        times = np.bincount(self.flat[np.repeat(self.good, np.diff(self.begin))], minlength=len(memory.ok))
        self.used = np.flatnonzero(times)
        #: Of every link of a unit in use: its unit, its pair, and how often the unit occurs.
        n = memory.counts[3][self.used]
        self.unit_of = np.repeat(self.used, n)
        self.pair_of = memory.pairs[np.repeat(memory.first[self.used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.times = times

    def per_row(self, per_unit: np.ndarray) -> np.ndarray:
        """Sums over the units of each text; 0 for a text without tokens."""
        sums = np.r_[0, np.cumsum(per_unit[self.flat])][self.begin]
        return np.where(self.good, sums[1:] - sums[:-1], 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs in order, the number of links of each) over all texts with tokens."""
        pair, which = np.unique(self.pair_of, return_inverse=True)
        n = np.zeros(len(pair), dtype=np.int64)
        np.add.at(n, which, self.times[self.unit_of])
        return pair, n

    def groups(self) -> list[str | None]:
        get, flat = self.memory.groups.__getitem__, self.flat.tolist()
        return [b"".join(map(get, flat[f:t]))[:-1].decode() if ok else None for f, t, ok in zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), self.good.tolist())]


def align_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row for each of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups ("a1,a2|b1;a3|b2,b3", null without tokens)."""
    chunks = chunked(docs, id, text, pieces(text_bytes(docs, text), chunk_bytes))

    def count(table):
        import pyarrow as pa

        pair, n = Units(remembered(byte_bpe, piece_bpe), table.column("text").to_pylist()).pairs()
        return pa.table({"chunk": pa.array(np.full(len(pair), table.column("chunk")[0].as_py()), pa.int32()), "pair": pair, "n": n})

    counted = written(chunks.groupBy("chunk").applyInArrow(count, "chunk int, pair long, n long"), "pairs")
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    totals = written(counted.groupBy("pair").agg(F.sum("n").alias("count")), "totals")
    most = totals.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("most"))  # a row for each id of the vocabulary at most
    totals = totals.join(F.broadcast(most), b_id == F.col("b_id")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = counted.select("chunk", "pair").join(totals, "pair").select("chunk", "pair", "count", "best")

    def align(left, right):
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string())])
        if not left.num_rows:
            return schema.empty_table()
        u = Units(remembered(byte_bpe, piece_bpe), left.column("text").to_pylist())
        right = right.sort_by("pair")
        pair, count, best = (right.column(c).to_numpy() for c in ("pair", "count", "best"))
        at = np.minimum(np.searchsorted(pair, u.pair_of), max(0, len(pair) - 1))
        summed, bests = (np.zeros(len(u.times), dtype=np.int64) for _ in range(2))
        if len(pair):
            np.add.at(summed, u.unit_of, count[at])
            np.add.at(bests, u.unit_of, best[at].astype(np.int64))
        return pa.table([left.column("id").cast(pa.int64()), *(pa.array(u.per_row(x)) for x in (*u.memory.counts, bests, summed)), pa.array(u.groups(), pa.string())], schema=schema)

    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(align, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.withColumnRenamed("id", id)
