"""A fixed public vocabulary of pieces, and dynamic programs over many short strings (units) in lockstep."""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

import numpy as np

from .common import mixed

#: Where the public vocabularies are; a parameter of every operator that uses one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands in units for a literal U+2581 of a text, which is no space and matches no piece.
_LITERAL = "\ud800"
_STEP = np.uint64(0x9E3779B97F4A7C15)
LANES = 63
#: So few lanes are worked one after the other.
FEW = 3


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL) -> Vocabulary:
    return Vocabulary(path)


class Vocabulary:
    """Pieces by id. A piece's log-probability is Zipf's, by its rank: it needs no training and prefers fewer, longer pieces, as the ranks of merges do."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte = np.full(256, -1, dtype=np.int32)
        normal = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        self.normal = np.array(normal, dtype=np.int32)
        self.score = -np.log(np.arange(self.size) + 2.0)
        self.byte_ids = {int(b) for b in self.byte}
        self.longest = max(len(self.pieces[i]) for i in normal)
        inner = {c for i in normal if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece holds a space after other characters: words are no units")
        #: Characters that no longer piece holds part units; so does the space before a word.
        self.alone = "".join(c for c in "\n\r\t" if c not in inner)
        a = re.escape(self.alone)
        self.unit = re.compile(f"[{a}]|{SPACE}*[^{SPACE}{a}]+|{SPACE}+" if self.alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # an open table by the hash's highest bits, and another for keys that collide there
        flat, start, end = flatten([self.pieces[i] for i in normal])
        size = end - start
        h = np.zeros(len(normal), dtype=np.uint64)
        for k in range(self.longest):
            of = size > k
            h[of] = h[of] * _STEP + mixed(flat[start[of] + k].astype(np.uint64) + np.uint64(1))
        assert len(np.unique(h)) == len(h)
        self.key = np.zeros(self.size, dtype=np.uint64)
        self.key[self.normal] = h
        self.first, self.second = np.full(1 << 20, -1, dtype=np.int32), np.full(1 << 20, -1, dtype=np.int32)
        self.first[(h >> np.uint64(44)).astype(np.int64)] = self.normal
        left = self.first[(h >> np.uint64(44)).astype(np.int64)] != self.normal
        at = ((h[left] >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)
        assert len(np.unique(at)) == len(at)
        self.second[at] = self.normal[left]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 where there is none."""
        out = self.first[(h >> np.uint64(44)).astype(np.int64)]
        wrong = np.flatnonzero((out >= 0) & (self.key[out] != h))
        if len(wrong):
            x = h[wrong]
            other = self.second[((x >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)]
            out[wrong] = np.where(self.key[other] == x, other, -1)
        return out

    def spaced(self, text: str) -> str:
        """A text as the pieces spell it: spaces shown, one before the first word."""
        return SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE) if text else ""

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces end to end, where each begins and ends)."""
        own = [bytes([int(p[3:5], 16)]) if i in self.byte_ids else p.replace(SPACE, " ").encode() if k else b"" for i, (p, k) in enumerate(zip(self.pieces, np.isin(np.arange(self.size), self.normal)))]
        return np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum([0, *map(len, own)])

    def unknown(self, c: int) -> list[int]:
        """Byte pieces of a character that is no piece."""
        return [int(self.byte[b]) for b in (SPACE if chr(c) == _LITERAL else chr(c)).encode("utf-8", "surrogatepass")]


def flatten(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points end to end, start, end of each unit)."""
    size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    end = np.cumsum(size)
    return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), end - size, end


class Units:
    """Units laid in lanes, longest first, and the pieces at every place: ids[l - 1][p] is the piece of l characters from p, or -1."""

    def __init__(self, vocab: Vocabulary, units: list[str]):
        self.vocab = vocab
        self.order = np.argsort([-len(u) for u in units], kind="stable")
        self.flat, self.start, self.end = flatten([units[k] for k in self.order])
        self.size = self.end - self.start
        self.ends: dict[int, np.ndarray] = {}
        n, last = len(self.flat), np.repeat(self.end, self.size)
        letters, h = mixed(self.flat.astype(np.uint64) + np.uint64(1)), np.zeros(n, dtype=np.uint64)
        self.ids = []
        for l in range(1, min(vocab.longest, int(self.size.max(initial=0))) + 1):
            h = h[: n - l + 1] * _STEP + letters[l - 1 :]
            own = vocab.lookup(h)
            own[np.arange(n - l + 1) + l > last[: n - l + 1]] = -1
            self.ids.append(own)

    def lanes(self, t: int) -> int:
        """How many units have at least t characters."""
        return int(np.searchsorted(-self.size, -t, side="right"))

    def ending(self, lane: int) -> np.ndarray:
        """Of one lane: row t holds the pieces that end after t + 1 characters, by length."""
        if lane not in self.ends:
            own = np.full((self.size[lane], len(self.ids)), -1, dtype=np.int32)
            for l, ids in enumerate(self.ids):
                own[l:, l] = ids[self.start[lane] : self.end[lane] - l]
            self.ends[lane] = own
        return self.ends[lane]

    def rows(self, table: np.ndarray) -> np.ndarray:
        """Scores of characters that are no piece, by their byte pieces, as rows beside table's; self.ids[0] then has no -1."""
        lone = np.flatnonzero(self.ids[0] < 0) if self.ids else np.zeros(0, dtype=np.int64)
        if not len(lone):
            return table
        kinds, which = np.unique(self.flat[lone], return_inverse=True)
        self.ids[0] = self.ids[0].copy()
        self.ids[0][lone] = len(table) + which
        self.kinds = kinds
        return np.concatenate([table, np.stack([table[self.vocab.unknown(int(c))].sum(axis=0) for c in kinds])])


def forward(u: Units, table: np.ndarray) -> np.ndarray:
    """For every place after so many characters of a unit, the log of the summed probability of all its segmentations, by column of table (log-probabilities by piece). Index: start + characters + lane."""
    table = u.rows(table)
    lane = np.arange(len(u.size))
    out = np.full((len(u.flat) + len(lane), table.shape[1]), -np.inf)
    out[u.start + lane] = 0
    for t in range(1, int(u.size.max(initial=0)) + 1):
        n = u.lanes(t)
        if n <= FEW:  # long units: all pieces that end there at once, lane by lane
            for k in range(n):
                got = u.ending(k)[t - 1][: min(t, len(u.ids))]
                l = np.flatnonzero(got >= 0)
                if len(l):
                    to = u.start[k] + k + t
                    out[to] = np.logaddexp.reduce(out[to - 1 - l] + table[got[l]], axis=0)
            continue
        to = u.start[:n] + lane[:n] + t
        for l, ids in enumerate(u.ids[:t], 1):
            got = ids[u.start[:n] + t - l]
            on = np.flatnonzero(got >= 0)
            if len(on):
                out[to[on]] = np.logaddexp(out[to[on]], out[to[on] - l] + table[got[on]])
    return out


def backward(u: Units, table: np.ndarray) -> np.ndarray:
    """The same for the rest of each unit. u.ids must have come through forward() with as large a table."""
    lane = np.arange(len(u.size))
    out = np.full((len(u.flat) + len(lane), table.shape[1]), -np.inf)
    out[u.end + lane] = 0
    for t in range(int(u.size.max(initial=0)) - 1, -1, -1):
        n = u.lanes(t + 1)
        if n <= FEW:
            for k in range(n):
                at = u.start[k] + t
                got = np.array([ids[at] for ids in u.ids[: u.size[k] - t]])
                l = np.flatnonzero(got >= 0)
                if len(l):
                    out[at + k] = np.logaddexp.reduce(out[at + k + 1 + l] + table[got[l]], axis=0)
            continue
        at = u.start[:n] + t
        for l, ids in enumerate(u.ids, 1):
            ok = np.flatnonzero(t + l <= u.size[:n])
            got = ids[at[ok]]
            on = ok[got >= 0]
            if len(on):
                k = at[on] + lane[on]
                out[k] = np.logaddexp(out[k], out[k + l] + table[ids[at[on]]])
    return out


def streamed(vocab: Vocabulary, unit: str) -> list[int]:
    """Streaming Viterbi over one unit of any length.

    A window holds, for the last boundaries (as many as the longest piece has characters), the best score and the set of
    boundaries on its path since the last commit. A boundary that all of them share is where their paths have converged:
    what lies before it is committed and forgotten."""
    look = {vocab.pieces[i]: int(i) for i in vocab.normal} if not hasattr(vocab, "look") else vocab.look
    vocab.look = look
    score, longest, out = vocab.score, vocab.longest, []
    done, window = 0, {0: (0.0, 1)}  # bit k of a path: boundary done + k

    def commit(path: int, upto: int) -> None:
        at = done
        for k in range(1, upto + 1):
            if path >> k & 1:
                p = unit[at : done + k]
                at = done + k
                out.extend([look[p]] if p in look else vocab.unknown(ord(p)))

    for t in range(1, len(unit) + 1):
        best = None
        for l in range(min(longest, t), 0, -1):
            if (before := window.get(t - l)) is None:
                continue
            i = look.get(unit[t - l : t])
            if i is None and l > 1:
                continue
            s = before[0] + (score[i] if i is not None else sum(score[k] for k in vocab.unknown(ord(unit[t - 1]))))
            if best is None or s > best[0]:
                best = (s, before[1] | 1 << (t - done))
        window[t] = best
        window.pop(t - longest, None)
        shared = -1
        for _, path in window.values() if t < len(unit) else (window[t],):
            shared &= path
        if (k := shared.bit_length() - 1) > 0:
            commit(best[1], k)
            window = {j: (s, path >> k) for j, (s, path) in window.items() if j >= done + k}
            done += k
    return out


def viterbi(vocab: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units end to end, and where each unit's begin and end: the streaming Viterbi of streamed(), with all units of up to LANES characters in lockstep and their paths as the bits of a word."""
    short = [k for k, x in enumerate(units) if len(x) <= LANES]
    found: list = [None] * len(units)
    for k, x in enumerate(units):
        if len(x) > LANES:
            found[k] = np.array(streamed(vocab, x), dtype=np.int32)
    u = Units(vocab, [units[k] for k in short])
    table = u.rows(vocab.score[:, None])[:, 0]
    n, w = len(short), vocab.longest + 1
    score, path = np.full((w, n), -np.inf), np.zeros((w, n), dtype=np.uint64)
    score[0], path[0] = 0, 1
    kept = np.zeros(n, dtype=np.uint64)  # boundaries committed so far
    for t in range(1, int(u.size.max(initial=0)) + 1):
        m, slot = u.lanes(t), t % w
        score[slot, :m] = -np.inf
        at = u.start[:m] + t
        for l in range(min(len(u.ids), t), 0, -1):
            got = u.ids[l - 1][at - l]
            on = np.flatnonzero(got >= 0)
            before = (t - l) % w
            s = score[before, on] + table[got[on]]
            better = s > score[slot, on]
            on, s = on[better], s[better]
            score[slot, on] = s
            path[slot, on] = path[before, on] | np.uint64(1 << t)
        # paths converge on the boundaries that all of the window share; at its end a unit has but one path
        over, shared = u.lanes(t + 1), path[slot, :m].copy()
        for b in range(max(0, t - w + 2), t):
            live = score[b % w, :over] > -np.inf
            shared[:over] &= np.where(live, path[b % w, :over], ~np.uint64(0))
        kept[:m] |= shared
    bits = np.flatnonzero(np.unpackbits(kept.view(np.uint8), bitorder="little"))
    lane, place = bits // 64, bits % 64
    go = place > 0
    lane, place = lane[go], place[go]
    before = np.r_[0, place[:-1]]
    before[np.r_[True, lane[1:] != lane[:-1]]] = 0
    size, at = place - before, u.start[lane] + before
    ids = np.empty(len(lane), dtype=np.int64)
    for l in range(1, len(u.ids) + 1):
        of = size == l
        ids[of] = u.ids[l - 1][at[of]]
    spelled = [np.array(vocab.unknown(int(c)), dtype=np.int32) for c in getattr(u, "kinds", ())]
    count = np.where(ids < vocab.size, 1, 0)
    if spelled:
        odd = np.flatnonzero(count == 0)
        count[odd] = np.array([len(x) for x in spelled])[ids[odd] - vocab.size]
        out = np.repeat(ids, count)
        begin = np.cumsum(count) - count
        for k in odd.tolist():
            out[begin[k] : begin[k] + count[k]] = spelled[ids[k] - vocab.size]
    else:
        out = ids
    per = np.bincount(lane, weights=count, minlength=n).astype(np.int64)
    cuts = np.cumsum(np.r_[0, per])
    ids = out.astype(np.int32)
    lengths = np.zeros(len(units), dtype=np.int64)
    starts = np.zeros(len(units), dtype=np.int64)
    where = np.array(short, dtype=np.int64)[u.order] if n else np.zeros(0, dtype=np.int64)
    lengths[where], starts[where] = per, cuts[:-1]
    extra, at = [], len(ids)
    for k, x in enumerate(found):
        if x is not None:
            starts[k], lengths[k] = at, len(x)
            at += len(x)
            extra.append(x)
    return np.concatenate([ids, *extra]), np.stack([starts, starts + lengths], axis=1)


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The ranges of data, end to end."""
    size = end - begin
    total = np.cumsum(size)
    return data[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)]
