"""Ratcliff-Obershelp similarity and the exact candidate keys for it."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from .text import let


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``2 M / (|a| + |b|)`` with matching blocks found longest first; null on a null side."""
    for left, right in pairs:
        yield pd.Series([
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)
        ], dtype="float64")


def best_ratio(ls, rs, threshold: float) -> float:
    """Best ratio over the variants of two names, plain ones (even places) and those of sorted words (odd places) each for themselves."""
    top = 0.0
    for form in (0, 1):
        for a in {x for x in ls[form::2] if x}:
            for b in {x for x in rs[form::2] if x}:
                m = SequenceMatcher(None, a, b)
                if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold:
                    top = max(top, m.ratio())
    return top


def best_ratio_udf(threshold: float):
    """Best ratio over the variants of two names; 0 where every cheap upper bound is below the threshold.

    ``quick_ratio`` bounds the ratio from above, so skipping below the threshold loses nothing.
    """

    def best(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series([best_ratio(ls, rs, threshold) for ls, rs in zip(left, right)], dtype="float64")

    return F.pandas_udf(best, DoubleType())


#: Columns of a matrix of character counts, rows of it that are multiplied at once, the longest text that fits one number of 64 bits, pairs
#: whose bits are followed at once, pairs whose runs of equal characters are held at once, and numbered characters that are counted without sorting them.
COLUMNS, STRIP, BITS, RUN, TABLES, KINDS = 128, 256, 64, 16384, 1024, 1 << 22


class Spellings:
    """Names as places of their spellings: for each order of words the different non-empty texts one after another, and whose each is."""

    def __init__(self, n: int, texts: list[list[str]], owners: list[np.ndarray]):
        self.n, self.texts, self.owners = n, texts, owners
        self.sizes = [np.array([len(x) for x in own], np.int64) for own in texts]
        #: The shortest spelling of each name, in either order; beyond any size for a name without one.
        self.least = np.full(n, 1e6)
        for own, size in zip(owners, self.sizes):
            np.minimum.at(self.least, own, size)

    @classmethod
    def of(cls, variants: list[list[list[str]]]) -> Spellings:
        """From two lists of variants for each name."""
        return cls(len(variants[0]), [[x for xs in own for x in xs] for own in variants], [np.repeat(np.arange(len(own)), [len(xs) for xs in own]) for own in variants])

    def slots(self, order: int) -> np.ndarray:
        """Row by row the places of the names' first texts in this order, of their second ones, and so on; -1 where there is none."""
        own = self.owners[order]
        count = np.bincount(own, minlength=self.n)
        out = np.full((int(count.max(initial=0)), self.n), -1, np.int64)
        out[np.arange(len(own)) - (np.cumsum(count) - count)[own], own] = np.arange(len(own))
        return out


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters of the texts one after another: whose each is, its place there, its code point."""
    sizes = np.array([len(x) for x in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return row, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row], flat


def _numbered(flat: np.ndarray) -> np.ndarray:
    """Code points as places among all that occur."""
    seen = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
    seen[flat] = 1
    return (np.cumsum(seen) - 1)[flat]


def _counts(left: Spellings, right: Spellings) -> tuple[np.ndarray, np.ndarray]:
    """Which numbered characters the names of each side have in any spelling.

    The commonest have columns of their own. Those that share one are added up, so a product of two rows is never less than what any two spellings share.
    """
    tokens = []
    for at, order in ((0, 0), (0, 1), (left.n, 0), (left.n, 1)):
        side = right if at else left
        row, _, flat = _characters(side.texts[order])
        row, flat = np.divmod(np.sort(row << 21 | flat.astype(np.int64)), 1 << 21)
        spot = np.arange(len(row))
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])
        number = spot - np.maximum.accumulate(np.where(first, spot, 0))
        tokens.append((side.owners[order][row] + at, flat, number))
    name, flat, number = (np.concatenate(x) for x in zip(*tokens))
    code = _numbered(flat)
    kind = code * (int(number.max(initial=0)) + 1) + number
    if kind.max(initial=0) > KINDS:
        kind = np.unique(kind, return_inverse=True)[1]
    often = np.bincount(kind)
    kinds = len(often)
    # A name has a numbered character once, in however many spellings.
    own = np.sort(name * kinds + kind)
    name, kind = np.divmod(own[np.diff(own, prepend=-1) > 0], max(kinds, 1))
    rank = np.empty(kinds, np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(kinds)
    alone = COLUMNS * 3 // 4
    column = np.where(rank < alone, rank, alone + rank % (COLUMNS - alone))[kind]
    counts = np.bincount(name * COLUMNS + column, minlength=(left.n + right.n) * COLUMNS).reshape(-1, COLUMNS).astype(np.float32)
    return counts[: left.n], counts[left.n:]


def _coded(left: Spellings, right: Spellings, order: int) -> list[np.ndarray]:
    """A row of character numbers for each text of this order, as far as its 64th one; both sides have the same numbers, and different ones below 0 beyond a text's end."""
    parts = [_characters(side.texts[order]) for side in (left, right)]
    number = _numbered(np.concatenate([flat for _, _, flat in parts]))
    out = []
    for k, (side, (row, place, flat)) in enumerate(zip((left, right), parts)):
        codes = np.full((len(side.texts[order]), min(BITS, int(side.sizes[order].max(initial=0)))), -1 - k, np.int32)
        short = place < BITS
        codes[row[short], place[short]] = number[k * len(parts[0][2]):][: len(flat)][short]
        out.append(codes)
    return out


def _subsequences(ours: np.ndarray, theirs: np.ndarray, la: np.ndarray, lb: np.ndarray, threshold: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that tells for places of texts whether their longest common subsequence leaves room for the threshold.

    It is counted by bits, one character of the right texts after the other for many pairs. Texts of more than 64 characters always may;
    characters that share a number of 256 count as equal, which can only lengthen it. With the ``need`` of a pair, a character can only be matched with one
    that is no more than the left text's length less ``need`` further on, or the right one's less ``need`` further back. Pairs go as soon as the characters that are left cannot make up for those missed.
    """
    spots = np.zeros((len(ours), 257), np.uint64)
    for k in range(ours.shape[1]):
        own = np.flatnonzero(ours[:, k] >= 0)
        spots[own, ours[own, k] % 256] |= np.uint64(1 << k)
    spots, longer = spots.reshape(-1), max(la.max(initial=0), lb.max(initial=0)) > BITS
    # 256: no character, found nowhere.
    codes = np.ascontiguousarray(np.where(theirs >= 0, theirs % 256, 256).T.astype(np.int64))

    def room(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keep = (la[x] > BITS) | (lb[y] > BITS) if longer else np.zeros(len(x), bool)
        short = np.flatnonzero(~keep)
        for at in range(0, len(short), RUN):
            run = short[at: at + RUN]
            i, j = x[run], y[run]
            size, size2 = la[i], lb[j]
            need = np.ceil(threshold / 2 * (size + size2) - 1e-9).astype(np.int64)
            # How many of the right text's characters may be missed.
            spare = size2 - need
            further, back, base = max(int((size - need).max()), 0), max(int(spare.max()), 0), i * 257
            open_ = np.full(len(run), ~np.uint64(0))
            for k, code in enumerate(codes):
                where = np.take(code, j, mode="clip")
                where += base
                hit = np.take(spots, where, mode="clip")
                hit &= open_
                hit &= np.uint64((1 << min(k + further + 1, BITS)) - (1 << max(k - back, 0)))
                more = open_ + hit
                open_ -= hit
                open_ |= more
                if k % 4 == 3 and 5 * k > 2 * len(codes):
                    # Places beyond a text's end are missed by all; they are spare as well.
                    ok = np.flatnonzero(np.bitwise_count(~open_) >= np.minimum(k + 1 - spare, need))
                    if 2 * len(ok) < len(run):
                        run, j, base, need, spare, open_ = (z[ok] for z in (run, j, base, need, spare, open_))
            keep[run] = np.bitwise_count(~open_) >= need
        return keep

    return room


def _matched(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Characters in the matching blocks of pairs of short texts, row by row: what ``SequenceMatcher`` finds, which takes the longest block
    first (of equal ones the first of ``a``, then of ``b``) and goes on to its left and right.
    """
    n, width, height = len(a), a.shape[1], b.shape[1]
    total = np.zeros(n, np.int64)
    if not n or not width or not height:
        return total
    # Length of the run of equal characters that ends at each place of a and each of b.
    runs, last = np.zeros((n, width, height), np.uint8), np.zeros((n, height + 1), np.uint8)
    for k in range(width):
        np.multiply(last[:, :-1] + np.uint8(1), a[:, k, None] == b, out=runs[:, k])
        last[:, 1:] = runs[:, k]
    own, lo, hi, lo2, hi2 = np.arange(n), np.zeros(n, np.int64), la, np.zeros(n, np.int64), lb

    def inside(size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Longest run that may end at each place without leaving the part."""
        at = np.arange(size)
        return np.where(at < hi[:, None], np.maximum(at + 1 - lo[:, None], 0), 0).astype(np.uint8)

    while len(own):
        part = np.minimum(runs[own], inside(width, lo, hi)[:, :, None])
        np.minimum(part, inside(height, lo2, hi2)[:, None, :], out=part)
        part = part.reshape(len(own), -1)
        end = part.argmax(axis=1)
        size = part[np.arange(len(own)), end].astype(np.int64)
        total += np.bincount(own, size, minlength=n).astype(np.int64)
        i, j = np.divmod(end, height)
        rest = [np.concatenate(x) for x in ((own, own), (lo, i + 1), (i + 1 - size, hi), (lo2, j + 1), (j + 1 - size, hi2))]
        go = np.tile(size > 0, 2) & (rest[2] > rest[1]) & (rest[4] > rest[3])
        own, lo, hi, lo2, hi2 = (x[go] for x in rest)
    return total


def _ratios(side_a: tuple, side_b: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ratios of pairs of texts; a side is its texts, their sizes and their rows of numbers."""
    (texts, la, a), (texts2, lb, b) = side_a, side_b
    out = np.zeros(len(x))
    short = (la[x] <= BITS) & (lb[y] <= BITS)
    for k in np.flatnonzero(~short):
        out[k] = SequenceMatcher(None, texts[x[k]], texts2[y[k]]).ratio()
    short = np.flatnonzero(short)
    for at in range(0, len(short), TABLES):
        run = short[at: at + TABLES]
        i, j = x[run], y[run]
        out[run] = 2.0 * _matched(a[i], b[j], la[i], lb[j]) / (la[i] + lb[j])
    return out


def similar_rows(left: Spellings, right: Spellings, threshold: float, turn: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and best ratio of all pairs of two sides' names at or above the threshold, a strip of the left names at a time.

    Matched characters are shared ones, and a common subsequence. The first bound is one matrix product for all spellings of two names, from
    which the share of their lengths is already taken off. The second one is for the pairs of spellings that are left, and only pairs that pass it are compared.

    ``turn`` says of two arrays of places which pairs go (0), are compared as they are (1), or with the right name first (-1).
    """
    if not left.n or not right.n:
        return
    counts, counts2 = _counts(left, right)
    ones = np.ones(max(left.n, right.n))
    a = np.column_stack([counts, -threshold / 2 * left.least, ones[: left.n]]).astype(np.float32)
    b = np.column_stack([counts2, ones[: right.n], -threshold / 2 * right.least]).astype(np.float32).T.copy()
    slack = 1e-3 + 1e-5 * float(max(size.max(initial=0) for side in (left, right) for size in side.sizes))
    orders = []
    for order in (0, 1):
        sides = [(side.texts[order], side.sizes[order], codes) for side, codes in zip((left, right), _coded(left, right, order))]
        orders.append((left.slots(order), right.slots(order), sides, _subsequences(sides[0][2], sides[1][2], sides[0][1], sides[1][1], threshold)))
    for at in range(0, left.n, STRIP):
        i, j = np.divmod(np.flatnonzero(a[at: at + STRIP] @ b >= -slack), right.n)
        i += at
        way = np.ones(len(i), np.int64) if turn is None else turn(i, j)
        i, j, way = i[way != 0], j[way != 0], way[way != 0]
        best = np.zeros(len(i))
        for ours, theirs, (one, two), room in orders:
            for xs in ours:
                for ys in theirs:
                    x, y = xs[i], ys[j]
                    pair = np.flatnonzero((x >= 0) & (y >= 0))
                    pair = pair[room(x[pair], y[pair])]
                    forth, back = pair[way[pair] > 0], pair[way[pair] < 0]
                    best[forth] = np.maximum(best[forth], _ratios(one, two, x[forth], y[forth]))
                    best[back] = np.maximum(best[back], _ratios(two, one, y[back], x[back]))
        keep = best >= threshold
        if keep.any():
            yield i[keep], j[keep], best[keep]


def sorted_words(col: Column) -> Column:
    return F.array_join(F.sort_array(F.filter(F.split(col, r"\s+"), lambda w: w != "")), " ")


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the two lengths."""
    shorter, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return F.when(both > 0, 2.0 * shorter / both).otherwise(1.0)


def edit_bound(a: Column, b: Column, threshold: float) -> Column:
    """Whether the edit distance leaves room for a ratio at the threshold.

    Matched blocks are a common subsequence; what it leaves over is at least the edit distance ``e``, so the ratio is at most
    ``1 - e / (|a| + |b|)``. Spark stops counting at the limit.
    """
    both = F.length(a) + F.length(b)
    return (length_bound(a, b) >= threshold) & (F.call_function("levenshtein", a, b, F.floor((1 - threshold) * both + 1e-9).cast("int")) >= 0)


def numbered_tokens(chars: Column) -> Column:
    """Array elements with their occurrence number, so that a bag becomes a set."""
    return let(chars, lambda cs: F.transform(cs, lambda c, i: F.concat(
        c, F.lit("\x01"), F.size(F.filter(F.slice(cs, F.lit(1), i + 1), lambda d: d == c)).cast("string"))))


def grams(text: Column, q: int | Column) -> Column:
    q = F.lit(q) if isinstance(q, int) else q
    n = F.length(text) - (q - 1)
    spots = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.substring(text, i, q))
