"""Verification of one pair of text and passage, written plainly: what the batched form must agree with."""

import numpy as np

from strake.llm.leaks import BAND, WORDS, Passage, Q


def runs(pos: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of q-grams on one diagonal: start in the item, start in the text, characters."""
    diagonal = d - pos
    order = np.lexsort((pos, diagonal))
    pos, d, diagonal = pos[order], d[order], diagonal[order]
    fresh = (pos[1:] != pos[:-1]) | (diagonal[1:] != diagonal[:-1])  # windows overlap
    keep = np.append(True, fresh)
    pos, d, diagonal = pos[keep], d[keep], diagonal[keep]
    start = np.append(True, (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1))
    at = np.flatnonzero(start)
    return pos[at], d[at], np.diff(np.append(at, len(pos))) + Q - 1


def chain(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> list[int]:
    """The runs, in the order of both texts, that cover most of the item."""
    order = np.lexsort((t, s))
    s, t, n = s[order], t[order], n[order]
    best, back = n.astype(np.float64), np.full(len(s), -1)
    for lo in range(0, len(s), 64):
        j = np.arange(lo, min(lo + 64, len(s)))[:, None]
        i = np.arange(j[-1, 0])[None, :]
        # a far jump costs a little, so that a passage found whole isn't pieced together from several places
        cost = np.maximum(0, np.maximum(s[i] + n[i] - s[j], t[i] + n[i] - t[j])) + np.minimum(np.abs((t[j] - s[j]) - (t[i] - s[i])), 2000) * 0.002
        cost[(s[i] >= s[j]) | (t[i] >= t[j])] = np.inf
        for row in range(len(j)):
            m = lo + row
            if m:
                gain = best[:m] - cost[row, :m]
                k = int(gain.argmax())
                if gain[k] > 0:
                    best[m] += gain[k]
                    back[m] = k
    out, j = [], int(best.argmax())
    while j >= 0:
        out.append(int(order[j]))
        j = int(back[j])
    return out[::-1]


def aligned(a: np.ndarray, b: np.ndarray, band: int = BAND) -> list[int]:
    """Positions of a that match in a banded alignment of a and b with the fewest edits."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    a, b = a.tolist(), b.tolist()
    width = band + abs(n - m)
    big = n + m + 1
    rows = [[j if j <= width else big for j in range(m + 1)]]
    for i in range(1, n + 1):
        last, row = rows[-1], [big] * (m + 1)
        lo, hi = max(0, i - width), min(m, i + width)
        if lo == 0:
            row[0] = i
        for j in range(max(1, lo), hi + 1):
            x = last[j - 1] + (a[i - 1] != b[j - 1])
            y = (last[j] if last[j] < row[j - 1] else row[j - 1]) + 1
            row[j] = x if x <= y else y
        rows.append(row)
    out, i, j = [], n, m
    while i and j:
        here = rows[i][j]
        if a[i - 1] == b[j - 1] and here == rows[i - 1][j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif here == rows[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
        elif here == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def reproduced(p: Passage, codes: np.ndarray, pos: np.ndarray, d: np.ndarray, least: float, gap: int = 40) -> float:
    """Share of the passage's words that the text reproduces in order, in pieces of at least WORDS words; 0 where it can't
    be ``least``."""
    s, t, n = runs(pos, d)
    need = np.where(p.sizes <= 3, p.sizes, 0.6 * p.sizes)
    side = max(gap // 2, 3 * Q)  # alignment reaches at most half a gap, or the ends, beyond a run

    def possible(some: list[int]) -> np.ndarray:
        """Words that these runs and the alignment beside them could cover."""
        reach = np.zeros(len(p.codes) + 1, dtype=np.int64)
        np.add.at(reach, np.maximum(0, s[some] - side), 1)
        np.add.at(reach, np.minimum(len(p.codes), s[some] + n[some] + side), -1)
        return np.bincount(p.word, weights=np.cumsum(reach)[:-1] > 0, minlength=len(p.sizes)) >= need

    if possible(list(range(len(s)))).mean() < least:
        return 0.0
    pieces: list[list[int]] = []
    for k in chain(s, t, n):
        if pieces:
            j = pieces[-1][-1]
            a, b = int(s[k] - s[j] - n[j]), int(t[k] - t[j] - n[j])
            if a <= gap and b <= gap and abs(a - b) <= BAND // 2:
                pieces[-1].append(k)
                continue
        pieces.append([k])
    good, could = np.zeros(len(p.sizes), dtype=bool), np.zeros(len(p.sizes), dtype=bool)
    hopes = [possible(piece) for piece in pieces]
    pieces = [piece for piece, x in zip(pieces, hopes) if x.sum() >= WORDS]
    for x in hopes:
        could |= x & (x.sum() >= WORDS)
    if could.mean() < least:
        return 0.0
    for piece in pieces:
        covered = np.zeros(len(p.codes), dtype=bool)
        a, b = int(s[piece[0]]), int(t[piece[0]])
        # the ends, up to the next words' q-grams that an edit hid
        lo = max(0, a - 3 * Q)
        lo_t = max(0, b - (a - lo))
        covered[[lo + x for x in aligned(p.codes[lo:a], codes[lo_t:b])]] = True
        for k in piece:
            x, y = int(s[k]), int(t[k])
            if x > a and y > b:
                covered[[a + z for z in aligned(p.codes[a:x], codes[b:y])]] = True
            a, b = x + int(n[k]), y + int(n[k])
            covered[x:a] = True
        tail = min(len(p.codes), a + 3 * Q)
        covered[[a + z for z in aligned(p.codes[a:tail], codes[b : b + tail - a])]] = True
        words = np.bincount(p.word, weights=covered, minlength=len(p.sizes)) >= need
        if words.sum() >= WORDS:
            good |= words
    return float(good.mean())


