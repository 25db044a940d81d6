"""Evaluation passages leaking into a corpus.

Texts are folded to a stream of letters and digits (markup, case, accents, punctuation, spacing and broken encoding
removed). Following the q-gram lemma, a piece of n characters copied with e edits keeps at least n - q + 1 - q e of its
q-grams, all within a band of diagonals as wide as its insertions. So shared q-grams are counted for each passage in
overlapping regions, a diagonal band over a span of the passage; regions that reach the bound of the edit budget are
kept, and passages whose kept q-grams reach the bound of the share asked for. These are verified: the kept runs are
chained in the order of both texts, the gaps between them aligned in a band, and the words counted that come out of
pieces of at least WORDS words.

Most texts share only common q-grams with a passage. So shared q-grams are counted a passage first, leaving out the
passage's most common ones: of the q-grams that the bound asks for, at least the bound less those left out must be among
the rest. Only the pairs of text and passage that reach this go on to the regions, and no pair that reaches the bound is
lost. Texts are handled many at a time. Passages too short for a region are looked for as whole runs of words.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 6
BAND = 32
SPAN = 64  # characters of the passage in a region
REGION = 14  # q-grams a region must share: 43 copied characters with four edits
WORDS = 5  # words of the shortest piece of copied wording
EDITED = 0.3  # of a piece's q-grams, what is left when every tenth character is edited
WINDOW = 1 << 13
BATCH = 1 << 16  # characters handled at a time
_TAG = re.compile(r"<[^<>]{0,200}>")
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"[Â-ô][\u0080-¿Œ-Ÿˆ˜–-›€™]+")
_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(Q)]


@cache
def _marks() -> re.Pattern:
    """Characters that combine with the one before them, as ranges."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    first = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    last = [c for c, after in zip(codes, [*codes[1:], -2]) if c != after - 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last)) + "]+")


def _mend(m: re.Match) -> str:
    out = bytearray()
    for ch in m[0]:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                return m[0]
            out.append(ord(ch))
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def words_of(text: str) -> list[str]:
    """Words of a text, folded; those of length 0 left out."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _TAG.sub(" ", html.unescape(text))
    if not text.isascii():
        for _ in range(2):  # text may have been broken twice
            text = _BROKEN.sub(_mend, text)
        text = _marks().sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the q-grams."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(Q):
        h += (wide[k : k + n] * wide[k : k + n] + wide[k : k + n]) * np.uint64(_POWERS[k])
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Passage:
    item_id: int
    codes: np.ndarray
    word: np.ndarray  # word number of each character
    sizes: np.ndarray  # characters of each word


class Passages:
    """Index of the q-grams of a bounded set of passages."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items: list[Passage] = []
        self.short: dict[int, dict[str, list[int]]] = {}  # by number of words
        self.share = share
        for i, text in items:
            w = words_of(text or "")
            if len(w) >= WORDS and sum(map(len, w)) >= Q + REGION:
                sizes = np.array([len(x) for x in w])
                self.items.append(Passage(i, codes_of("".join(w)), np.repeat(np.arange(len(w)), sizes), sizes))
            elif w:
                self.short.setdefault(len(w), {}).setdefault(" ".join(w), []).append(i)
        hashes = [grams(p.codes) for p in self.items]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.n_grams = np.array([len(h) for h in hashes], dtype=np.int64)
        self.longest = int(self.n_grams.max()) if hashes else 0
        item = np.repeat(np.arange(len(hashes)), self.n_grams)
        pos = np.concatenate([np.arange(n) for n in self.n_grams]) if hashes else np.zeros(0, dtype=np.int64)
        self.hash, gram, often = np.unique(flat, return_inverse=True, return_counts=True)
        # what is left of the share's q-grams
        self.bound = np.maximum(REGION, np.ceil(share * EDITED * self.n_grams)).astype(np.int64)
        # half of a passage's bound in its most common q-grams takes no part in the first count
        by_item = np.lexsort((-often[gram], item))
        place = np.empty(len(flat), dtype=np.int64)
        place[by_item] = np.arange(len(flat)) - (np.cumsum(self.n_grams) - self.n_grams)[item[by_item]]
        rare = place >= self.bound[item] // 2
        self.first_bound = self.bound - self.bound // 2
        # places by q-gram and item; an entry is those of one item, entries that hold rare places come first in their q-gram
        order = np.lexsort((pos, item, gram))
        self.pos = pos[order]
        g, i, rare = gram[order], item[order], rare[order]
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]))) if len(g) else np.zeros(0, dtype=np.int64)
        n_rare = np.add.reduceat(rare.astype(np.int64), first) if len(g) else first
        entry = np.lexsort((n_rare == 0, g[first]))
        self.entry_item, self.entry_at, self.entry_n, self.entry_rare = i[first][entry], first[entry], np.diff(np.append(first, len(g)))[entry], n_rare[entry]
        self.n_entries = np.bincount(g[first], minlength=len(self.hash))
        self.start = np.append(0, np.cumsum(self.n_entries))
        self.n_rare = np.bincount(g[first], weights=n_rare > 0, minlength=len(self.hash)).astype(np.int64)
        self.sieve = True
        # where the hashes of the same leading bits begin
        self.shift = np.uint64(64 - max(8, (8 * len(self.hash)).bit_length()))
        lead = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64) << self.shift
        lead[-1] = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.lead = np.searchsorted(self.hash, lead).astype(np.int32)
        self.lead[-1] = len(self.hash)
        self.crowd = int(np.diff(self.lead).max(initial=0))
        self.verify = Pieces(self.items) if self.items else None
        self.batch = max(4096, BATCH * 100_000 // max(100_000, len(flat)))  # the more passages, the more hits a character has

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of hashes that a passage has, and their numbers."""
        slot = (h >> self.shift).astype(np.int64)
        k = self.lead[slot]
        ends = self.lead[slot + 1]
        at = np.flatnonzero(k < ends)
        k, ends, h = k[at], ends[at], h[at]
        found, number = [], []
        for _ in range(self.crowd):  # hashes of the same leading bits are few
            same = self.hash[k] == h
            found.append(at[same])
            number.append(k[same])
            more = ~same & (k + 1 < ends)
            at, k, ends, h = at[more], k[more] + 1, ends[more], h[more]
            if not len(at):
                break
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *found]), np.concatenate([none, *number])

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(position of the text, item id, share of its words reproduced) for the passages of which the share is."""
        words = [words_of(t) for t in texts]
        if self.short:
            for k, w in enumerate(words):
                for n, known in self.short.items():
                    for x in {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} & known.keys():
                        yield from ((k, i, 1.0) for i in known[x])
        if not self.items:
            return
        folded = ["".join(w) for w in words]
        pieces, size = [], 0  # (text, position in it, characters)
        for k, t in enumerate(folded):
            for at in range(0, max(1, len(t) - Q + 1), WINDOW):
                part = t[at : at + WINDOW + Q - 1 + 2 * self.longest]
                pieces.append((k, at, part))
                size += len(part) + 256
                if size >= self.batch and at + WINDOW >= len(t) - Q + 1:
                    yield from self._found(pieces, folded)
                    pieces, size = [], 0
        yield from self._found(pieces, folded)

    def _found(self, pieces: list[tuple[int, int, str]], folded: list[str]) -> Iterator[tuple[int, int, float]]:
        kept: dict[tuple[int, int], list] = {}
        batch, size = [], 0
        for n, p in enumerate(pieces):
            batch.append(p)
            size += len(p[2]) + 256
            if size >= self.batch or n == len(pieces) - 1:
                for k, item, pos, d in self._regions(batch, folded):
                    kept.setdefault((k, item), []).append((pos, d))
                batch, size = [], 0
        cands = [(k, item, *(np.concatenate(x) for x in zip(*parts))) for (k, item), parts in kept.items()]
        cands = [x for x in cands if len(kept[x[0], x[1]]) == 1 or len(np.unique(x[2])) >= self.bound[x[1]]]
        if not cands:
            return
        texts = sorted({x[0] for x in cands})
        size = np.array([len(folded[k]) for k in texts])
        codes = codes_of("".join(folded[k] for k in texts))
        of_text = np.searchsorted(texts, [x[0] for x in cands])
        lo = (np.cumsum(size) - size)[of_text]
        item, n = np.array([x[1] for x in cands]), [len(x[2]) for x in cands]
        pos, d = (np.concatenate([x[i] for x in cands]) for i in (2, 3))
        shares = self.verify.shares(item, np.repeat(np.arange(len(cands)), n), pos, d + np.repeat(lo, n), codes, lo, lo + size[of_text], self.share)
        for (k, i, *_), got in zip(cands, shares.tolist()):
            if got >= self.share:
                yield k, self.items[i].item_id, got

    def _sieved(self, piece: np.ndarray, g: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """For each piece and item, whether enough q-grams are shared, by a piece's q-grams g.

        A text of one piece must have the bound's number of the item's places, first without the item's most common ones, and
        of places of its own; a piece of a longer one, as many hits as a region needs.
        """
        n_items = len(self.items)
        size = len(whole) * n_items

        def count(piece: np.ndarray, g: np.ndarray, n: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
            e = _ranges(self.start[g], n)
            return np.bincount(np.repeat(piece * n_items, n) + self.entry_item[e], None if weight is None else weight[e], minlength=size)

        one = whole[piece]
        wanted = np.zeros(size, dtype=bool)
        if not one.all():
            wanted |= count(piece[~one], g[~one], self.n_entries[g[~one]], self.entry_n) >= np.repeat(np.where(whole, np.inf, REGION), n_items)
        piece, g = piece[one], g[one]
        distinct = np.unique(piece * len(self.hash) + g)
        p, h = distinct // len(self.hash), distinct % len(self.hash)
        least = np.where(whole[:, None], self.first_bound, np.inf).ravel()
        hope = count(p, h, self.n_rare[h], self.entry_rare) >= least
        least = np.where(whole[:, None], self.bound, np.inf).ravel()
        some = hope.reshape(-1, n_items).any(axis=1)
        if some.any():
            p, h, piece, g = p[some[p]], h[some[p]], piece[some[piece]], g[some[piece]]
            hope &= count(p, h, self.n_entries[h], self.entry_n) >= least
            wanted |= hope & (count(piece, g, self.n_entries[g], None) >= least)
        return wanted

    def _regions(self, pieces: list[tuple[int, int, str]], folded: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, item, positions in the item, in the text) of the shared q-grams in kept regions, a piece and item at a time."""
        sizes = np.array([len(p[2]) for p in pieces])
        codes = codes_of("".join(p[2] for p in pieces))
        if len(codes) < Q:
            return
        ends = np.cumsum(sizes)
        starts = ends - sizes
        piece = np.repeat(np.arange(len(pieces)), sizes)
        d, g = self.places(grams(codes))
        inside = d + Q <= ends[piece[d]]
        d, g = d[inside], g[inside]
        n_items = len(self.items)
        whole = np.array([len(folded[k]) <= len(t) for k, _, t in pieces])
        bound = np.where(whole[:, None], self.bound, 0).ravel()
        wanted = self._sieved(piece[d], g, whole) if self.sieve else np.ones(len(bound), dtype=bool)
        some = wanted.reshape(-1, n_items).any(axis=1)[piece[d]]
        if not some.any():
            return
        d, g = d[some], g[some]
        n = self.n_entries[g]
        e, d = _ranges(self.start[g], n), np.repeat(d, n)
        pair = piece[d] * n_items + self.entry_item[e]
        ok = wanted[pair]
        pair, d, e = pair[ok], d[ok], e[ok]
        n = self.entry_n[e]
        pair, d, pos = np.repeat(pair, n), np.repeat(d, n), self.pos[_ranges(self.entry_at[e], n)]
        number = (np.cumsum(wanted) - 1)[pair]
        band = d - starts[pair // n_items] - pos + self.longest
        bands, spans = (int(sizes.max()) + self.longest) // BAND + 2, self.longest // SPAN + 2
        space = int(wanted.sum()) * bands * spans
        keep = np.zeros(len(pair), dtype=bool)
        for shift in (0, BAND // 2):
            row = (number * bands + (band + shift) // BAND) * spans
            for slide in (0, SPAN // 2):
                keep |= _counts(row + (pos + slide) // SPAN, space) >= REGION
        pair, pos, d = pair[keep], pos[keep], d[keep]
        # of texts of one piece, those whose kept q-grams reach the bound go on
        go = (np.bincount(pair, minlength=len(bound)) >= bound)[pair]
        pair, pos, d = pair[go], pos[go], d[go]
        seen = np.unique(pair * (self.longest + 1) + pos) // (self.longest + 1)
        go = (np.bincount(seen, minlength=len(bound)) >= bound)[pair]
        pair, pos, d = pair[go], pos[go], d[go]
        order = np.argsort(pair, kind="stable")
        pair, pos, d = pair[order], pos[order], d[order]
        cuts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(pair)]):
            p, item = divmod(int(pair[lo]), n_items)
            k, base, _ = pieces[p]
            yield k, item, pos[lo:hi], d[lo:hi] - starts[p] + base


def _counts(key: np.ndarray, space: int) -> np.ndarray:
    """How often each key occurs; keys are below ``space``."""
    if space <= 16 * len(key) + 200_000:
        return np.bincount(key)[key]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[at]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those of start[1]..."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(total)


class Pieces:
    """Verification of many pairs of text and passage at once."""

    def __init__(self, items: list[Passage]):
        self.items = items
        size = np.array([len(p.codes) for p in items])
        self.size, self.base = size, np.cumsum(size) - size
        self.codes = np.concatenate([p.codes for p in items])
        self.n_words = np.array([len(p.sizes) for p in items])
        self.word_base = np.cumsum(self.n_words) - self.n_words
        self.word = np.concatenate([p.word for p in items])
        sizes = np.concatenate([p.sizes for p in items])
        self.need = np.where(sizes <= 3, sizes, 0.6 * sizes)  # characters of a word that must be there

    def words(self, item: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For groups of stretches [lo, hi) of their items: the words that they cover, and each word's group."""
        size = self.size[item] + 1
        base = np.cumsum(size) - size
        total = int(size.sum())
        cover = np.cumsum(np.bincount(base[group] + lo, minlength=total) - np.bincount(base[group] + hi, minlength=total)) > 0
        owner = np.repeat(np.arange(len(item)), size)
        at = np.arange(total) - base[owner]
        inside = cover & (at < self.size[item][owner])
        owner, at = owner[inside], at[inside]
        n = self.n_words[item]
        first = np.cumsum(n) - n
        count = np.bincount(first[owner] + self.word[self.base[item[owner]] + at], minlength=int(n.sum()))
        of = np.repeat(np.arange(len(item)), n)
        return count >= self.need[_ranges(self.word_base[item], n)], of

    def shares(self, item: np.ndarray, cand: np.ndarray, pos: np.ndarray, d: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float, gap: int = 40) -> np.ndarray:
        """Share of each candidate's passage that its text reproduces in order, in pieces of at least WORDS words; 0 where it
        can't be ``least``. cand, pos and d are the kept q-grams, d in text, whose part [lo, hi) is the candidate's."""
        out = np.zeros(len(item))
        side = max(gap // 2, 3 * Q)  # alignment reaches at most half a gap, or the ends, beyond a run
        # maximal runs of q-grams on one diagonal
        diagonal = d - pos
        order = np.lexsort((pos, diagonal, cand))
        cand, pos, d, diagonal = cand[order], pos[order], d[order], diagonal[order]
        near = (cand[1:] == cand[:-1]) & (diagonal[1:] == diagonal[:-1])
        keep = np.append(True, ~near | (pos[1:] != pos[:-1]))  # windows overlap
        cand, pos, d, diagonal = cand[keep], pos[keep], d[keep], diagonal[keep]
        start = np.flatnonzero(np.append(True, (cand[1:] != cand[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)))
        c, s, t, n = cand[start], pos[start], d[start], np.diff(np.append(start, len(pos))) + Q - 1

        def possible(of: np.ndarray, group: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self.words(of, group, np.maximum(0, s - side), np.minimum(self.size[of][group], s + n + side))

        ok, of = possible(item, c, s, n)
        hope = np.bincount(of[ok], minlength=len(item)) >= least * self.n_words[item]
        live = hope[c]
        c, s, t, n = c[live], s[live], t[live], n[live]
        if not len(c):
            return out
        order = np.lexsort((t, s, c))
        c, s, t, n = c[order], s[order], t[order], n[order]
        live = chained(c, s, t, n)
        c, s, t, n = c[live], s[live], t[live], n[live]
        # pieces: runs that follow each other closely
        a, b = s[1:] - s[:-1] - n[:-1], t[1:] - t[:-1] - n[:-1]
        link = (c[1:] == c[:-1]) & (a <= gap) & (b <= gap) & (np.abs(a - b) <= BAND // 2)
        piece = np.cumsum(np.append(0, ~link))
        of_cand = c[np.append(True, ~link)]
        ok, of = possible(item[of_cand], piece, s, n)
        long = np.bincount(of[ok], minlength=len(of_cand)) >= WORDS
        live = self._hopes(item, of_cand, ok & long[of], of, least)
        live = long & live[of_cand]
        if not live.any():
            return out
        number = np.cumsum(live) - 1
        run = live[piece]
        piece, s, t, n, of_cand = number[piece[run]], s[run], t[run], n[run], of_cand[live]
        item_of = item[of_cand]
        # what lies between the runs of a piece, and beyond its ends up to the next words' q-grams that an edit hid
        first, last = np.append(True, piece[1:] != piece[:-1]), np.append(piece[1:] != piece[:-1], True)
        same = ~last[:-1]
        e, f = (s + n)[:-1][same], (t + n)[:-1][same]
        between = np.stack([piece[1:][same], e, s[1:][same], f, t[1:][same]])
        a, b = s[first], t[first]
        back = np.maximum(0, a - 3 * Q)
        head = np.stack([piece[first], back, a, np.maximum(lo[of_cand], b - (a - back)), b])
        a, b = (s + n)[last], (t + n)[last]
        end = np.minimum(self.size[item_of], a + 3 * Q)
        tail = np.stack([piece[last], a, end, b, np.minimum(hi[of_cand], b + end - a)])
        tasks = np.concatenate([between, head, tail], axis=1)
        tasks = tasks[:, (tasks[2] > tasks[1]) & (tasks[4] > tasks[3])]
        k, at = aligned(self.codes, self.base[item_of[tasks[0]]] + tasks[1], tasks[2] - tasks[1], text, tasks[3], tasks[4] - tasks[3])
        group, x = tasks[0][k], tasks[1][k] + at
        ok, of = self.words(item_of, np.concatenate([piece, group]), np.concatenate([s, x]), np.concatenate([np.minimum(s + n, self.size[item_of][piece]), x + 1]))
        long = np.bincount(of[ok], minlength=len(of_cand)) >= WORDS
        hit = np.unique(self._word_ids(item, of_cand, ok & long[of], of))
        return np.bincount(np.searchsorted(np.cumsum(self.n_words[item]), hit, "right"), minlength=len(item)) / self.n_words[item]

    def _word_ids(self, item: np.ndarray, of_cand: np.ndarray, ok: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The words marked in pieces, as numbers among all candidates' words."""
        n = self.n_words[item]
        return _ranges((np.cumsum(n) - n)[of_cand], n[of_cand])[ok]

    def _hopes(self, item: np.ndarray, of_cand: np.ndarray, ok: np.ndarray, of: np.ndarray, least: float) -> np.ndarray:
        hit = np.unique(self._word_ids(item, of_cand, ok, of))
        got = np.bincount(np.searchsorted(np.cumsum(self.n_words[item]), hit, "right"), minlength=len(item))
        return got >= least * self.n_words[item]


def chained(c: np.ndarray, s: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Marks each candidate's runs that, in the order of both texts, cover most of the item. Runs come by (c, s, t)."""
    out = np.zeros(len(c), dtype=bool)
    cuts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(cuts, len(c)))
    level = np.frexp(size)[1]  # candidates with runs of like number go together
    for k in np.unique(level):
        for rows in np.array_split(np.flatnonzero(level == k), max(1, int(size[level == k].sum()) // 50_000)):
            if len(rows):
                at = _ranges(cuts[rows], size[rows])
                of = np.repeat(np.arange(len(rows)), size[rows])
                place = at - cuts[rows][of]
                out[at] = _chain(of, place, len(rows), int(size[rows].max()), s[at], t[at], n[at])
    return out


def _chain(of: np.ndarray, place: np.ndarray, rows: int, width: int, *stn: np.ndarray) -> np.ndarray:
    s, t, n = (np.zeros((rows, width), dtype=np.int64) for _ in range(3))
    for x, v in zip((s, t, n), stn):
        x[of, place] = v
    real = n > 0
    best, back, all_rows = np.where(real, n, -1).astype(np.float64), np.full((rows, width), -1), np.arange(rows)
    for lo in range(0, width, 32):
        hi = min(lo + 32, width)
        sj, tj = s[:, lo:hi, None], t[:, lo:hi, None]
        si, ti, ni = (x[:, None, : hi - 1] for x in (s, t, n))
        over = np.maximum(0, np.maximum(si + ni - sj, ti + ni - tj))
        # a far jump costs a little, so that a passage found whole isn't pieced together from several places
        cost = over + np.minimum(np.abs((tj - sj) - (ti - si)), 2000) * 0.002
        cost[(si >= sj) | (ti >= tj)] = np.inf
        for j in range(max(1, lo), hi):
            gain = best[:, :j] - cost[:, j - lo, :j]
            k = gain.argmax(axis=1)
            g = gain[all_rows, k]
            up = (g > 0) & real[:, j]
            best[:, j] += np.where(up, g, 0)
            back[:, j] = np.where(up, k, -1)
    chosen = np.zeros((rows, width), dtype=bool)
    j = best.argmax(axis=1)
    going = all_rows
    while len(going):
        chosen[going, j] = True
        j = back[going, j]
        going, j = going[j >= 0], j[j >= 0]
    return chosen[of, place]


def aligned(a: np.ndarray, a_at: np.ndarray, n: np.ndarray, b: np.ndarray, b_at: np.ndarray, m: np.ndarray, band: int = BAND, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Banded alignments with the fewest edits of a[a_at : a_at + n] and b[b_at : b_at + m], many at once: (number of the
    alignment, position from a_at) of the characters that match."""
    if not len(n):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = []
    for some in np.array_split(np.arange(len(n)), max(1, len(n) * int(n.max() + 1) * int(m.max() + 1) // cells)):
        k, at = _aligned(a, a_at[some], n[some], b, b_at[some], m[some], band)
        found.append((some[k], at))
    return tuple(np.concatenate(x) for x in zip(*found))


def _aligned(a: np.ndarray, a_at: np.ndarray, n: np.ndarray, b: np.ndarray, b_at: np.ndarray, m: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    high, wide, count = int(n.max()), int(m.max()), len(n)
    x = a[np.minimum(a_at[:, None] + np.arange(high), len(a) - 1)]
    y = b[np.minimum(b_at[:, None] + np.arange(wide), len(b) - 1)]
    width, big, cols = band + np.abs(n - m)[:, None], np.int16(16_000), np.arange(wide + 1, dtype=np.int16)
    rows = np.empty((high + 1, count, wide + 1), dtype=np.int16)
    rows[0] = np.where(cols <= width, cols, big)
    for i in range(1, high + 1):
        last, row = rows[i - 1], rows[i]
        row[:, 0] = i
        np.minimum(last[:, :-1] + (x[:, i - 1, None] != y), last[:, 1:] + 1, out=row[:, 1:])
        out_of_band = np.abs(cols - i) > width
        row[out_of_band] = big
        np.minimum.accumulate(row - cols, axis=1, out=row)
        row += cols
        row[out_of_band] = big
    i, j, k = n.copy(), m.copy(), np.arange(count)
    found = []
    while len(k):
        here, slant = rows[i, k, j], rows[i - 1, k, j - 1]
        match = (x[k, i - 1] == y[k, j - 1]) & (here == slant)
        found.append((k[match], i[match] - 1))
        swap = ~match & (here == slant + 1)
        up = ~match & ~swap & (here == rows[i - 1, k, j] + 1)
        i = i - (match | swap | up)
        j = j - (match | swap | ~up)
        go = (i > 0) & (j > 0)
        i, j, k = i[go], j[go], k[go]
    return tuple(np.concatenate(z) for z in zip(*found))


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", share: float = 0.4, block_chars: int = 1_000_000) -> DataFrame:
    """(item_id, doc_id, share): documents that reproduce at least ``share`` of a passage's words in its order.

    Passages are sent to every task in blocks of about ``block_chars`` characters, as many blocks as there need be; the
    documents are searched whole and where they lie for each block, without a shuffle. A passage of fewer than WORDS words or
    Q + REGION letters counts where all its words stand together. NULL, empty and wordless texts and passages give no rows;
    rows with the same id count once, with the largest share.
    """
    held = items.where(F.col(item_id).isNotNull() & (F.length(passage) > 0)).select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).alias("p")).distinct()
    chars = held.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("share", pa.float64())])
    texts = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), text)

    def search_in(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Passages(block.value, share)
            for b in batches:
                ids = b.column(0).to_pylist()
                out = [(i, ids[k], s) for k, i, s in index.search(b.column(1).to_pylist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return texts.mapInArrow(run, "item_id bigint, doc_id bigint, share double")

    found = None
    for n in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == n).collect()  # about block_chars characters
        one = search_in(docs.sparkSession.sparkContext.broadcast(sorted((r.i, r.p) for r in rows)))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("item_id", "doc_id").agg(F.max("share").alias("share"))
