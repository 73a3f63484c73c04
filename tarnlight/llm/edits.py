"""Edit distances of many pairs of short texts at once, as far as a bound needs them.

Myers' bit vectors over a band: bit p of a pair's words stands for the diagonal p - c, and
the band moves down a row with each letter of the shorter text, so a distance of at most
63 edits fits one word whatever the length, and BAND edits eight. Only the diagonal that ends in the last
cell is counted; its values never fall, so a pair beyond its bound leaves at once.
"""

from __future__ import annotations

import numpy as np

#: Edits up to which pairs are compared at once.
BAND = 511
#: Words of a table of letters' places, and pairs, that are worked on at once.
_TABLE, _PAIRS = 1 << 21, 1 << 12
#: Letters after which pairs that are decided leave.
_STRIDE = 8
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


class Letters:
    """Texts as numbers of their letters, laid end to end."""

    def __init__(self, texts: list[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(self.size) - self.size
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        used = np.zeros(int(points.max(initial=0)) + 1, bool)
        used[points] = True
        self.letter = (np.cumsum(used) - 1)[points]
        self.kinds = int(used.sum())


def within(texts: Letters, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether texts x and y (indexes) are at most ``most`` (BAND or less) edits apart, for each pair."""
    size = texts.size
    long, short = np.where(size[x] >= size[y], x, y), np.where(size[x] >= size[y], y, x)
    out = np.zeros(len(x), bool)
    left = np.flatnonzero(size[long] - size[short] <= most)
    left = left[np.lexsort((-size[short[left]], long[left], most[left] >> 6))]
    lo = 0
    while lo < len(left):
        some = left[lo : lo + _PAIRS]
        wide = int(most[some[0]]) // 64 + 1
        some = some[most[some] < 64 * wide]
        first, of = np.unique(long[some], return_inverse=True)
        words = int(size[first].max()) // 64 + 3 + wide
        room = max(1, _TABLE // (words * max(texts.kinds, 1)))
        if len(first) > room:
            some = some[of < room]
            first, of = first[:room], of[: len(some)]
        out[some] = _banded(texts, first, of, short[some], most[some], words, wide)
        lo += len(some)
    return out


def _banded(texts: Letters, patterns: np.ndarray, of: np.ndarray, short: np.ndarray, most: np.ndarray, words: int, wide: int) -> np.ndarray:
    """As within(), of the pairs patterns[of] (the longer ones) and short; bands of ``wide`` words."""
    n = texts.size[patterns]
    row = np.repeat(np.arange(len(patterns)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    letter = texts.letter[texts.at[patterns][row] + place]
    place += 64  # a word of zeros stands before the first row
    table = np.zeros(len(patterns) * texts.kinds * words, np.uint64)
    np.add.at(table, (row * texts.kinds + letter) * words + (place >> 6), _ONE << (place & 63).astype(np.uint64))

    out = np.zeros(len(of), bool)
    order = np.argsort(-texts.size[short], kind="stable")
    of, short, most = of[order], short[order], most[order].astype(np.int64)
    size = texts.size[short]
    apart = n[of] - size
    above = (most - apart) // 2
    last, in_word = (apart + above & 63).astype(np.uint64), apart + above >> 6
    base, begin, from_ = of * (texts.kinds * words), texts.at[short], 64 - above
    low = np.arange(wide)[:, None] * 64  # a word's first bit
    plus = np.where(above >= low + 64, np.uint64(0), _ALL << np.clip(above - low, 0, 63).astype(np.uint64))
    minus, score = np.zeros_like(plus), apart
    j = 0
    while len(order):
        count = np.searchsorted(-size, -np.arange(j, j + _STRIDE), "left")  # pairs with a letter at j
        for k in count.tolist():
            if not k:
                break
            start = from_[:k] + j
            at = base[:k] + texts.letter[begin[:k] + j] * words + (start >> 6)
            bit = (start & 63).astype(np.uint64)
            rest = np.uint64(63) - bit
            p, m, carry = plus[:, :k], minus[:, :k], None
            eq = np.stack([table[at + w] >> bit | (table[at + w + 1] << rest) << _ONE for w in range(wide)])
            same = np.empty_like(eq)
            for w in range(wide):
                sums = (eq[w] & p[w]) + p[w]
                over = sums < p[w]
                if carry is not None:
                    sums += carry
                    over |= sums < carry
                carry = over.astype(np.uint64) if w + 1 < wide else None
                same[w] = (sums ^ p[w]) | eq[w] | m[w]
            up, down = m | ~(same | p), same & p
            own = same[0] if wide == 1 else same[in_word[:k], np.arange(k)]
            score[:k] += 1 - (own >> last[:k] & _ONE).astype(np.int64)
            below = same >> _ONE
            below[:-1] |= same[1:] << np.uint64(63)
            plus[:, :k], minus[:, :k] = down | ~(below | up), below & up
            j += 1
        ended = size <= j
        out[order[ended & (score <= most)]] = True
        stays = ~ended & (score <= most)
        order, size, most, base, begin, from_, last, in_word, score = (v[stays] for v in (order, size, most, base, begin, from_, last, in_word, score))
        plus, minus = plus[:, stays], minus[:, stays]
    return out
