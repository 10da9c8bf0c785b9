"""Which of many texts the matcher of difflib may find similar: exact bounds over whole blocks of texts, by numpy.

A ratio of t or more between x and y needs m >= t * (len x + len y) / 2 matched characters, in blocks of equal text that
lie in the same order on both sides. So:

* at most u = len x + len y - 2 * m characters are left unmatched, in at most u + 1 blocks, and what is at i of x is matched
  at i - (len x - m) to i + (len y - m) of y or not at all; b blocks of m characters hold m - (q - 1) * b runs of q
  characters or more;
* where y has 200 characters or more, the matcher starts from rare characters of y only (its "popular" ones are those met
  more than len y / 100 + 1 times), so each block but one at the very start holds one: with r of them, r + 1 blocks at most;
* the blocks are a common subsequence, so the longest one within that band has m characters or more.

Nothing here is a guess: what is left out cannot reach the threshold.
"""

from __future__ import annotations

import itertools
import math

import numpy as np

#: Lengths of runs in `by_runs`, longest first, and the distances of those looked up in a text.
RUNS = ((12, 3), (9, 2), (7, 1), (5, 1))
#: Texts compared at once and bits of character counts in `by_counts`; pairs at once, and rows a word moves by at least, in `within`.
CHUNK, BITS, PAIRS, STEP, CHECK = 2048, 510, 8192, 3, 16
MIX, FULL = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


class Texts:
    """Texts as one array of code points, with each one's length and counts of characters."""

    def __init__(self, texts: list[str], letters: np.ndarray | None = None):
        self.texts = texts
        self.n = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if letters is None:
            seen = np.zeros(0x110000, bool)
            seen[self.cp] = True
            letters = np.flatnonzero(seen)
        self.letters = letters
        code = np.full(0x110000, len(letters), np.int64)
        code[letters] = np.arange(len(letters))
        self.code = code.astype(np.int32)[self.cp]
        self.counts = np.zeros((len(texts), len(letters)), np.int32)
        rows, width = max(1, 4_000_000 // (len(letters) + 1)), len(letters) + 1
        for s in range(0, len(texts), rows):
            part = slice(s, s + rows)
            at = np.repeat(np.arange(len(self.n[part])) * width, self.n[part]) + self.code[self.start[s] : self.start[min(s + rows, len(texts))]]
            self.counts[part] = np.bincount(at, minlength=len(self.n[part]) * width).reshape(-1, width)[:, :-1]

    def rare(self) -> np.ndarray:
        """Characters the matcher may start from; all, in a text of under 200."""
        most = np.where(self.n < 200, self.n, self.n // 100 + 1)[:, None]
        return np.where(self.counts <= most, self.counts, 0).sum(1)

    def runs(self, k: np.ndarray, size: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in k, place in the text, hash of the `size` characters there), at every `step`th place of texts k."""
        n = self.n[k]
        first = np.cumsum(n) - n
        cp = self.cp[np.repeat(self.start[k] - first, n) + np.arange(n.sum())]
        h, done = cp.astype(np.uint64) * MIX, 1
        while done < size:
            d = min(done, size - done)
            h = (h[:-d] * MIX + h[d:]) * MIX if len(h) > d else h[:0]
            h ^= h >> np.uint64(29)
            done += d
        many = np.maximum(0, (n - size) // step + 1)
        row = np.repeat(np.arange(len(k)), many)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * step
        return row, place, h[first[row] + place] * MIX


    def rows(self, k: np.ndarray) -> np.ndarray:
        """Codes of texts k, one text a column, filled up with a code that no text has."""
        n = self.n[k]
        out = np.full((int(n.max(initial=0)), len(k)), len(self.letters), np.int64)
        col = np.repeat(np.arange(len(k)), n)
        place = np.arange(len(col)) - np.repeat(np.cumsum(n) - n, n)
        out[place, col] = self.code[self.start[k][col] + place]
        return out


def matched(nx: np.ndarray, ny: np.ndarray, t: float) -> np.ndarray:
    """Characters that must be matched between texts of these lengths."""
    return np.ceil(t * (nx + ny) / 2 - 1e-6).astype(np.int64)


def runs_for(y: Texts, t: float) -> np.ndarray:
    """For each text of y the place in RUNS of what to look for in it; -1: runs tell too little of it."""
    out, least, blocks = np.full(len(y.n), -1), y.n * t / (2 - t), y.rare() + 1
    for at, (size, step) in reversed(list(enumerate(RUNS))):
        out[(y.n >= 200) & (least - (size + step - 2) * blocks >= np.maximum(6 * step, least / 8))] = at
    return out


def by_runs(x: Texts, y: Texts, k: np.ndarray, size: int, step: int, t: float):
    """(places in x, texts of y), chunk by chunk: pairs with texts k of y that share enough runs at places that can meet.

    Runs that many texts of x hold are passed over where enough others must be met all the same.
    """
    row, place, h = x.runs(np.arange(len(x.n)), size)
    tail = np.uint64(max(1, len(h).bit_length()))  # the hash's last bits give way to the place, so that one sort of numbers does
    h = np.sort(h >> tail << tail | np.arange(len(h), dtype=np.uint64))
    order = (h & ((np.uint64(1) << tail) - np.uint64(1))).astype(np.int64)
    row, place, h = row[order], place[order], h >> tail
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))[: len(h)]
    who, low, high, h = row[new], place[new], place[np.append(new[1:], len(h))[: len(new)] - 1], h[new]
    bits = np.uint64(64 - min(24, max(12, len(h).bit_length() + 1))) - tail
    first = np.concatenate([[0], np.cumsum(np.bincount((h >> bits).astype(np.int64), minlength=2 ** (64 - int(tail) - int(bits))))]).astype(np.int32)
    blocks, often = y.rare() + 1, 2 + len(x.n) // 50
    # what is at `place` of y can meet what is at low to high of x: low - place <= nx - m and place - high <= ny - m
    low, high = low - (1 - t / 2) * x.n[who], high - t / 2 * x.n[who] + 1e-6
    for part in np.array_split(k, max(1, int(y.n[k].sum()) // 250_000)):
        must = np.ceil((y.n[part] * t / (2 - t) - (size + step - 2) * blocks[part]) / step - 1e-6).astype(np.int64)
        row, place, hy = y.runs(part, size, step)
        hy >>= tail
        slot = (hy >> bits).astype(np.int64)
        many = first[slot + 1] - first[slot]
        usual = np.bincount(row[many > often], minlength=len(part))
        skip = (usual > 0) & (usual <= must - 3)
        keep = (many > 0) & ~(skip[row] & (many > often))
        row, place, hy, slot, many = row[keep], place[keep], hy[keep], slot[keep], many[keep]
        ends, less = np.cumsum(many), np.where(skip, usual, 0)
        least, most = place - t / 2 * y.n[part[row]] + 1e-6, place - (1 - t / 2) * y.n[part[row]]
        for lo, hi in pieces(ends, 1_000_000, row):
            e = many[lo:hi]
            at = np.repeat(first[slot[lo:hi]] - (np.cumsum(e) - e), e) + np.arange(e.sum())
            own = np.repeat(np.arange(lo, hi), e)
            ok = (h[at] == hy[own]) & (low[at] <= least[own]) & (most[own] <= high[at])
            j0 = int(row[lo])
            times = np.bincount((row[own[ok]] - j0) * len(x.n) + who[at[ok]], minlength=1)
            code = np.flatnonzero(times)
            i, j = code % len(x.n), part[code // len(x.n) + j0]
            m = matched(x.n[i], y.n[j], t)
            need = (m - (size + step - 2) * blocks[j]) / step - less[code // len(x.n) + j0]
            ok = (times[code] >= need - 1e-6) & (m <= np.minimum(x.n[i], y.n[j]))
            yield i[ok], j[ok]


def pieces(ends: np.ndarray, most: int, row: np.ndarray):
    """(from, to) of stretches of about `most` hits that end where a row does."""
    lo = 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
        hi = max(hi, lo + 1)
        hi = int(np.searchsorted(row, row[hi - 1], "right"))
        yield lo, hi
        lo = hi


def by_counts(x: Texts, y: Texts, k: np.ndarray, t: float):
    """(places in x, places in a part of k, that part, its rows), chunk by chunk: pairs with texts k of y, in order of length,
    that have enough characters in common.

    A bit says that a character occurs v times or more; the bits in which two texts differ, whichever are looked at, are
    at most the characters left unmatched. So the bits that tell most are multiplied as matrices.
    """
    some = y.counts[k[:: max(1, len(k) // 2000)]]
    bits = sorted(((p * (1 - p), c, v) for c in np.flatnonzero(some.any(0)) for v in range(1, min(int(some[:, c].max()), 400) + 1) if (p := float((some[:, c] >= v).mean())) < 1), reverse=True)[:BITS]
    c, v = np.array([b[1] for b in bits], int), np.array([b[2] for b in bits], np.int32)

    def side(of: Texts, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = (of.counts[at][:, c] >= v).astype(np.float32)
        return b, ((1 - t) * of.n[at] - b.sum(1)) / 2

    xs = np.argsort(x.n, kind="stable")
    bx, ex = side(x, xs)
    bx = np.column_stack([bx, ex, np.ones(len(xs))]).astype(np.float32)
    for s in range(0, len(k), CHUNK):
        part = k[s : s + CHUNK]
        lo = int(np.searchsorted(x.n[xs], math.floor(y.n[part[0]] * t / (2 - t))))
        hi = int(np.searchsorted(x.n[xs], math.ceil(y.n[part[-1]] * (2 - t) / t), "right"))
        by, ey = side(y, part)
        by = np.ascontiguousarray(np.column_stack([by, np.ones(len(part)), ey]).astype(np.float32).T)
        rows = y.rows(part)
        for s2 in range(lo, hi, 512):
            i, j = np.divmod(np.flatnonzero(bx[s2 : min(hi, s2 + 512)] @ by > -0.01), len(part))
            i = xs[s2 + i]
            ok = matched(x.n[i], y.n[part[j]], t) <= np.minimum(x.n[i], y.n[part[j]])
            yield i[ok], j[ok], part, rows


def within(x: Texts, i: np.ndarray, rows: np.ndarray, k: np.ndarray, ny: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, lengths): which of the pairs (text i of x, column k of rows, of ny characters) have a common subsequence of
    as many characters as must be matched, and how long the longest is.

    Bits of words say where its length grows along x, for all pairs at once, row by row; only the band of places that can
    meet is kept, and pairs that have lost too many characters of y go early.
    """
    nx, some = x.n[i], np.unique(i)
    m = matched(nx, ny, t)
    down, up = int((ny - m).max()), int((nx - m).max())
    words = 1 if down + up + STEP <= 64 else (down + up + 127) // 64
    step = 65 - (down + up + 1) if words == 1 else 64
    # at: for each text of x and letter its places, moved by `down`, so that row j needs bits from j on
    letters, last = len(x.letters) + 1, int(ny.max())
    wide = max(int(nx.max()) + down, last + step) // 64 + words + 2
    at = np.zeros((len(some) * letters, wide), np.uint64)
    n = x.n[some]
    own = np.repeat(np.arange(len(some)), n)
    p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    code = x.code[np.repeat(x.start[some], n) + p]
    p += down
    np.bitwise_or.at(at, (own * letters + code, p // 64), np.uint64(1) << (p % 64).astype(np.uint64))
    at[letters - 1 :: letters] = 0
    at = np.ascontiguousarray(at.T)
    base, live = np.searchsorted(some, i) * letters, np.arange(len(k))
    v = [np.full(len(k), FULL) for _ in range(words)]
    got = most = np.zeros(len(k), np.int64)
    first, least = int((ny - m).min()), min(int(nx.min()), int(ny.min()))
    for row in range(0, last, step):
        w, r = row // 64, np.uint64(row % 64)
        masks = [at[w + e] if r == 0 else (at[w + e] >> r) | (at[w + e + 1] << (np.uint64(64) - r)) for e in range(words)]
        for j in range(row, min(last, row + step)):
            c, carry = rows[j].take(k), None
            c += base
            for e in range(words):
                u = masks[e].take(c)
                u &= v[e]
                new = v[e] + u
                if e < words - 1 or carry is not None:
                    over = new < u
                if carry is not None:
                    new += carry
                    over |= new < carry
                carry = over.astype(np.uint64) if e < words - 1 else None
                v[e] ^= u
                v[e] |= new
            if j + 1 < last and ((j + 1) % CHECK or j + 1 < first):
                continue
            # what has been met so far and all that is left of y; right of the middle of the band less of x is left
            most = got + (64 * words - sum(np.bitwise_count(e).astype(np.int64) for e in v))
            if j + 1 > least:
                ok = most + np.maximum(0, ny - j - 1) >= m
            elif words == 1:
                left = np.bitwise_count(~v[0] & np.uint64(2 ** (j + 1 + down - row) - 1)) + got
                ok = (left - (m - ny) > j) | (most - (m - np.minimum(nx, ny)) > j)
            else:
                ok = most - (m - ny) > j
            stay = np.flatnonzero(ok)
            if len(stay) < 0.9 * len(ok) or j + 1 == last:
                live, base, k, nx, ny, m, got, most = (a.take(stay) for a in (live, base, k, nx, ny, m, got, most))
                v = [e.take(stay) for e in v]
                if not len(live):
                    return live, most
        if words == 1:
            got = got + (step - np.bitwise_count(v[0] & np.uint64(2**step - 1)).astype(np.int64))
            v[0] = (v[0] >> np.uint64(step)) | (FULL << np.uint64(64 - step))
        else:
            got = got + (64 - np.bitwise_count(v[0]).astype(np.int64))
            v = [*v[1:], np.full(len(live), FULL)]
    return live, most


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def candidates(x: Texts, y: Texts, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in y, length of the longest common subsequence), by place in x, of pairs that hold all whose
    ratio is t or more; both with y's letters."""
    kind, out = runs_for(y, t), [np.zeros((3, 0), np.int64)]
    fit = (y.n >= math.floor(x.n.min() * t / (2 - t))) & (y.n <= math.ceil(x.n.max() * (2 - t) / t))
    of = lambda which: (k := np.flatnonzero(which & fit))[np.argsort(y.n[k], kind="stable")]
    for i, j, part, rows in by_counts(x, y, of(kind < 0), t):
        for s in range(0, len(i), PAIRS):
            i2, j2 = i[s : s + PAIRS], j[s : s + PAIRS]
            ok, most = within(x, i2, rows, j2, y.n[part[j2]], t)
            out.append(np.stack([i2[ok], part[j2[ok]], most]))
    for at, (size, step) in enumerate(RUNS):
        for i, k in by_runs(x, y, of(kind == at), size, step, t) if len(of(kind == at)) else ():
            if len(i) < 200:  # few: one by one
                out.append(np.stack([i, k, np.array([common_length(x.texts[a], y.texts[b]) for a, b in zip(i, k, strict=True)], np.int64)]))
                continue
            order = np.argsort(i, kind="stable")
            for s in range(0, len(i), PAIRS // 8):
                i2, k2 = i[order[s : s + PAIRS // 8]], k[order[s : s + PAIRS // 8]]
                ok, most = within(x, i2, y.rows(k2), np.arange(len(k2)), y.n[k2], t)
                out.append(np.stack([i2[ok], k2[ok], most]))
    i, k, most = np.concatenate(out, 1)
    order = np.argsort(i, kind="stable")
    return i[order], k[order], most[order]
