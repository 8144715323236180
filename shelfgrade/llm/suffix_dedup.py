"""Substring dedup over bytes by enhanced suffix arrays of blocks.

Blocks. Every window of ``window`` bytes has an anchor: its smallest run of ``SEED`` bytes by hash, the leftmost of equals. All
neighbouring windows with the same anchor form a phrase. Equal windows have equal anchors, so whatever repeats meets in the block of
one anchor, wherever it stands. Phrases whose anchor occurs once cannot repeat; they are never cut out.

Suffix array. The different phrases of a task's blocks are sorted by all their suffixes that are at least a window long (ranks
doubled from 7 to 28 bytes, then one sort over these ranks); the lengths of common prefixes follow from the same ranks. A
stack scan over them builds the tree of common-prefix intervals. An interval of ``window`` bytes or more whose occurrences have different left
neighbours (or stand where a phrase begins) is a maximal repeat group of its block: its members are all occurrences, not just
neighbours in the array. In each group all but the first occurrence are duplicate spans; a repeat that is longer than a phrase comes as
a chain of overlapping groups of consecutive blocks.

Exact: bytes are compared, not hashes, apart from the identity of whole texts (128 bits of SHA-2) and whole phrases (48 bits of
anchor and 64 of hash). Every window that also starts earlier is a non-first member of its interval's nearest left-diverse relatives, and
nothing else is: members of a group only stand later than its first.

Scale: equal texts are one before anything is cut; a copy loses all its windows without being looked at. Phrases are about thirty times
fewer than bytes and counted with partial sums. A block holds different phrases only. Anchors that occur more than ``most`` times (a
passage in a third of all documents, each time between other words) are split into single windows under their own
hash, which needs no sort. Texts are shuffled once, compressed, by document, so that many copies of a text do not meet.

Defined results: order is by id, null ids last, then by a hash of the text. A null text is empty. Rows that agree in id and text are one document
and share its result. Texts shorter than ``window`` bytes lose nothing. Extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from shelfgrade.llm.common import BYTE_VALUES, BYTES, Powers, mix

WINDOW, SEED = 100, 32
#: Occurrences of an anchor above which its block is split.
MOST = 16_384
#: Bytes that are hashed together, bytes of a block's suffix array, rows of an answer.
_VIEW, _BLOCK, _ROWS = 1 << 18, 1 << 20, 1 << 15
_LOW = np.uint64((1 << 32) - 1)
#: Phrases that a task remembers having sent, and the powers of its second hash.
_SEEN, OTHER = 1 << 20, Powers(0x9FB21C651E98DF25)


# --- cutting ------------------------------------------------------------------------------------

def _least(x: np.ndarray, span: int) -> np.ndarray:
    """Smallest of each run of ``span`` values, by doubling."""
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - span + width], x[span - width:]) if span > width else x


def phrases(buf: np.ndarray, offsets: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """``(document, start, windows, anchor)`` of every phrase of the documents ``buf[offsets[i]:offsets[i + 1]]``."""
    starts, anchors, last = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], -1
    for c in range(0, max(len(buf) - window + 1, 0), _VIEW):
        piece = buf[c: c + _VIEW + window - 1]
        up, down = BYTES.get(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[piece] * up[: len(piece)], out=total[1:])
        grams = mix((total[seed:] - total[:-seed]) * down[: len(piece) - seed + 1])
        # The smaller hash first, then the place further left: equal windows choose alike.
        at = (_least(grams & ~_LOW | np.arange(c, c + len(grams), dtype=np.uint64), window - seed + 1) & _LOW).astype(np.int64)
        new = np.empty(len(at), bool)
        new[0], new[1:] = at[0] != last, at[1:] != at[:-1]
        last = at[-1]
        begin = offsets[(offsets >= c) & (offsets < c + len(at))] - c
        new[begin] = True
        s = np.flatnonzero(new)
        starts.append(s + c)
        anchors.append(grams[at[s] - c])
    start, anchor = np.concatenate(starts), np.concatenate(anchors)
    doc = np.searchsorted(offsets, start, "right") - 1
    stop = np.minimum(np.concatenate([start[1:], [len(buf)]]), offsets[doc + 1] - window + 1) if len(start) else start
    keep = stop > start
    return doc[keep], (start - offsets[doc])[keep], (stop - start)[keep], anchor[keep]


def _raw(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        pack = zstandard.ZstdCompressor(level=3).compress
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([pack(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())], b.schema.names)


def _cut_up(window: int, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = _raw(b.column("body"))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            doc, start, size, anchor = phrases(np.frombuffer(b"".join(texts), np.uint8), offsets, window, seed)
            # Start and number of windows in one number, 48 bits of the anchor: two that are taken for one only make a block larger.
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(doc)), pa.array((anchor >> np.uint64(16)).view(np.int64)), pa.array(start << 16 | size)], ["doc", "anchor", "spot"])

    return run


#: A document: null ids last; equal ids (a hash stands for a null one) are told apart by a hash of the text.
_NAME = ["no_id", "doc", "tie"]
_PLACE = "no_id boolean, doc long, tie int, start int"


class _Wanted:
    """A batch's texts as one run of bytes, and the phrases asked for: ``row``, ``start``, ``size``, ``anchor`` and where they lie.

    Documents of one id share what is wanted; what another one asked for does no harm where it fits and is left out where it does not.
    """

    def __init__(self, b: pa.RecordBatch, window: int):
        texts, want = _raw(b.column("body")), b.column("want")
        sizes = np.array([len(t) for t in texts], np.int64)
        row = np.repeat(np.arange(b.num_rows), want.value_lengths().to_numpy(zero_copy_only=False))
        flat = want.flatten()
        anchor, spot = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("anchor", "spot"))
        fits = (spot >> 16) + (spot & 0xFFFF) + (window - 1) <= sizes[row]
        self.buf, self.row, self.anchor = np.frombuffer(b"".join(texts), np.uint8), row[fits], anchor[fits]
        self.start, self.size = spot[fits] >> 16, spot[fits] & 0xFFFF
        self.at = (np.cumsum(sizes) - sizes)[self.row] + self.start

    def named(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the bytes ``at .. at + length``, from prefix sums over pieces of the bytes."""
        out = np.zeros((2, len(self.at)), np.uint64)
        order, most = np.argsort(self.at, kind="stable"), int(length.max(initial=0))
        for c in range(0, len(self.buf), _VIEW):
            i = order[np.searchsorted(self.at, c, sorter=order): np.searchsorted(self.at, c + _VIEW, sorter=order)]
            if len(i):
                piece, s, n = self.buf[c: c + _VIEW + most], self.at[i] - c, length[i]
                for k, powers in enumerate((BYTES, OTHER)):
                    up, down = powers.get(len(piece) + 1)
                    total = np.zeros(len(piece) + 1, np.uint64)
                    np.cumsum(BYTE_VALUES[piece] * up[: len(piece)], out=total[1:])
                    out[k, i] = mix((total[s + n] - total[s]) * down[s] + n.astype(np.uint64))
        return out[0], out[1]


def _bytes(buf: np.ndarray, at: np.ndarray, length: np.ndarray, there: np.ndarray) -> pa.Array:
    """The bytes ``at .. at + length`` where ``there``, else null."""
    n = np.where(there, length, 0)
    ends = np.cumsum(n)
    data = buf[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    valid = np.packbits(there, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(at), [pa.py_buffer(valid), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _phrases(window: int):
    """The wanted phrases, named by their hashes. Bytes come with the first of equal ones that a task sees."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in it:
            w = _Wanted(b, window)
            length = w.size + (window - 1)
            name, _ = w.named(length)
            names = np.stack([w.anchor.view(np.uint64), name], 1).tobytes()
            new = np.zeros(len(name), bool)
            for i in range(len(name)):
                key = names[16 * i: 16 * i + 16]
                if key not in seen:
                    new[i] = True
                    seen.add(key)
            if len(seen) > _SEEN:
                seen.clear()
            for k in range(0, len(name), _ROWS):
                part = slice(k, k + _ROWS)
                row = pa.array(w.row[part])
                yield pa.RecordBatch.from_arrays([
                    pa.array(w.anchor[part]), pa.array(name[part].view(np.int64)), *(b.column(n).take(row) for n in _NAME),
                    pa.array(w.start[part].astype(np.int32)), pa.array(w.size[part].astype(np.int32)), _bytes(w.buf, w.at[part], length[part], new[part])],
                    ["anchor", "name", *_NAME, "start", "size", "bytes"])

    return run


def _windows(window: int):
    """The single windows of the wanted phrases."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            w = _Wanted(b, window)
            many = w.size
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            w.row, w.start, w.at = np.repeat(w.row, many), np.repeat(w.start, many) + step, np.repeat(w.at, many) + step
            f1, f2 = w.named(np.full(len(w.at), window))
            for k in range(0, len(f1), _ROWS):
                part = slice(k, k + _ROWS)
                row = pa.array(w.row[part])
                yield pa.RecordBatch.from_arrays([pa.array(f1[part].view(np.int64)), pa.array(f2[part].view(np.int64)), *(b.column(n).take(row) for n in _NAME),
                                                  pa.array(w.start[part].astype(np.int32))], ["f1", "f2", *_NAME, "start"])

    return run


# --- suffix array and interval tree ---------------------------------------------------------------

def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], k[1:] != k[:-1]]))
    return rank


def suffix_array(bodies: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """``(body, offset, common)``: all suffixes of at least ``window`` bytes in order, each with its common prefix with the one before."""
    gap, sizes = 7, np.array([len(x) for x in bodies], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + gap)])[:-1]
    buf = np.frombuffer((b"\0" * gap).join(bodies) + b"\0" * gap, np.uint8)
    n = len(buf)
    symbol = buf.astype(np.int64) + 1
    end = np.repeat(first + sizes, sizes + gap)
    place = np.arange(n)
    symbol[place >= end] = 0
    key = symbol.copy()
    for j in range(1, 7):
        key <<= 9
        key[: n - j] |= symbol[j:]
    levels = {7: _ranks(key)}
    levels[7][symbol == 0] = 0
    for h in (7, 14):
        r = levels[h]
        after = np.where(place + h < end, np.concatenate([r[h:], np.zeros(h, np.int64)]), 0)
        levels[2 * h] = np.where(symbol > 0, _ranks(r * (n + 1) + after), 0)
    many = np.maximum(sizes - window + 1, 0)
    body = np.repeat(np.arange(len(bodies)), many)
    offset = np.arange(len(body)) - np.repeat(np.cumsum(many) - many, many)
    at = first[body] + offset
    left = sizes[body] - offset
    steps = [np.where(h < left, levels[28][np.minimum(at + h, n - 1)], 0) for h in range(0, int(sizes.max(initial=0)), 28)]
    # As many ranks in one number as fit.
    bits = int(n + 1).bit_length()
    per = 63 // bits
    keys = []
    for k in range(0, len(steps), per):
        key = np.zeros(len(at), np.int64)
        for x in steps[k: k + per]:
            key = key << bits | x
        keys.append(key)
    order = np.lexsort(keys[::-1]) if keys else np.empty(0, np.int64)
    body, offset, at, left = body[order], offset[order], at[order], left[order]
    common = np.zeros(len(at), np.int64)
    if len(at) < 2:
        return body, offset, common
    a, b, most = at[:-1], at[1:], np.minimum(left[:-1], left[1:])
    # Whole steps of equal rank first; the first unequal one is taken apart in steps of 14, 7 and single bytes. A rank says nothing
    # beyond a suffix's end, so that a step only counts where it lies in both.
    same, alive = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for h in (28,) * len(steps) + (14, 7) + (1,) * 6:
        x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
        fits = same + h <= most
        values = levels[h] if h > 1 else symbol
        equal = fits & (values[x] == values[y])
        if h == 28:
            alive &= equal
            equal = alive
        same = np.where(equal, same + h, same)
    common[1:] = same
    return body, offset, common


def repeat_groups(common: list[int], left: list[int], first: list[int], window: int) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """Maximal repeat groups of a suffix array, from the deepest of each branch outwards: ``(length, from, to, first, covered)``.

    ``common[i]`` is the common prefix of suffixes i - 1 and i, ``left[i]`` the byte before suffix i, or -1 where it differs from
    all others, ``first[i]`` the place of the suffix in reading order. Members are suffixes from..to; ``covered`` are those that no deeper group
    has covered and that are not the group's first. Each suffix is covered once, so the lists add up to no more than the array.
    """
    # An open interval: length, from, left byte (-1: more than one), its first suffix, suffixes not covered yet.
    stack: list[list] = []

    def joined(node: list, other_left: int, other_first: int, pending: list[int]) -> None:
        if node[2] != other_left:
            node[2] = -1
        if first[other_first] < first[node[3]]:
            node[3] = other_first
        # The shorter list goes into the longer one.
        if len(pending) > len(node[4]):
            node[4], pending = pending, node[4]
        node[4].extend(pending)

    for i in range(1, len(common) + 1):
        depth = common[i] if i < len(common) else 0
        leaf = i - 1
        begin, side, best, pending = leaf, left[leaf], leaf, [leaf]
        while stack and stack[-1][0] > depth:
            node = stack.pop()
            joined(node, side, best, pending)
            if node[2] == -1:
                yield node[0], node[1], leaf, node[3], [x for x in node[4] if x != node[3]]
                node[4] = [node[3]]
            begin, side, best, pending = node[1], node[2], node[3], node[4]
        if depth >= window:
            if stack and stack[-1][0] == depth:
                joined(stack[-1], side, best, pending)
            else:
                stack.append([depth, begin, side, best, pending])


def _block(bodies: list[bytes], doc: np.ndarray, start: np.ndarray, window: int):
    """Groups of one block: ``(length, members, first, covered, phrases, offsets)``, where the middle three are places in the last two."""
    if not bodies:
        return
    body, offset, common = suffix_array(bodies, window)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(x) for x in bodies])])[:-1]
    left = np.where(offset > 0, flat[np.maximum(base[body] + offset - 1, 0)].astype(np.int64), -1)
    # Runs of suffixes that share a window. Where all have the same left neighbour, so has each group in it: the runs one byte
    # further left hold the same occurrences and more of the string, and nothing of this run is maximal.
    begin = np.flatnonzero(common < window)
    if not len(begin):
        return
    low, high, size = np.minimum.reduceat(left, begin), np.maximum.reduceat(left, begin), np.diff(np.append(begin, len(common)))
    at = np.flatnonzero(np.repeat((size > 1) & ((low < high) | (low == -1)), size))
    if not len(at):
        return
    body, offset, common, left = body[at], offset[at], common[at], left[at]
    place = (doc[body] << 32) + start[body] + offset
    for length, lo, hi, best, covered in repeat_groups(common.tolist(), left.tolist(), place.tolist(), window):
        yield length, slice(lo, hi + 1), best, covered, body, offset


class _Rows:
    """Whole blocks of sorted rows: equal phrases in a row, first occurrence first."""

    def __init__(self, rows: pa.Table):
        self.rows = rows = rows.combine_chunks()
        names = [rows.column(n).to_numpy() for n in ("anchor", "name")]
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in names], axis=0)])
        #: First row of each phrase; phrase of each row.
        self.first, self.phrase = np.flatnonzero(new), np.cumsum(new) - 1
        self.start, self.size = rows.column("start").to_numpy().astype(np.int64), rows.column("size").to_numpy().astype(np.int64)
        there = rows.column("bytes").is_valid().to_numpy()
        with_bytes = np.minimum.reduceat(np.where(there, np.arange(len(there)), len(there)), self.first)
        anchor = names[0][self.first]
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        many = np.diff(np.append(edge, len(anchor)))
        #: Phrases that share their anchor with another one.
        self.mine = np.flatnonzero(np.repeat(many > 1, many))
        at = self.first[self.mine]
        self.bodies = rows.column("bytes").take(pa.array(with_bytes[self.mine])).to_pylist()
        name = [rows.column(n).to_numpy()[at] for n in _NAME]
        # Numbers of documents in reading order.
        order = np.lexsort(name[::-1])
        differ = np.any([x[order][1:] != x[order][:-1] for x in name], axis=0)
        self.doc = np.empty(len(at), np.int64)
        self.doc[order] = np.cumsum(np.concatenate([[True], differ])[: len(at)])

    def names(self, row: np.ndarray) -> list[pa.Array]:
        return [self.rows.column(n).combine_chunks().take(pa.array(row)) for n in _NAME]


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    """Rows that come sorted by anchor, in whole blocks of about ``_BLOCK`` bytes together."""
    held, size, bare = [], 0, 0
    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column("bytes").nbytes
        bare += b.num_rows
        if size >= _BLOCK or bare >= 4 * _ROWS:
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1]))
            if whole:
                yield _Rows(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
                size, bare = held[0].column("bytes").nbytes, held[0].num_rows
    if held:
        yield _Rows(pa.Table.from_batches(held))


def _solved(window: int):
    """Spans of bytes that go: all of a phrase but in its first occurrence, there what groups with other phrases say."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _blocks(it):
            again = np.ones(r.rows.num_rows, bool)
            again[r.first] = False
            row, start, length = [np.flatnonzero(again)], [r.start[again]], [r.size[again] + (window - 1)]
            found, spans = [], []
            for n, _, _, covered, body, offset in _block(r.bodies, r.doc, r.start[r.first[r.mine]], window):
                found += [(int(body[c]), int(offset[c])) for c in covered]
                spans += [n] * len(covered)
            if found:
                body, offset = np.array(found, np.int64).T
                at = r.first[r.mine[body]]
                row, start, length = [*row, at], [*start, r.start[at] + offset], [*length, np.array(spans, np.int64)]
            row, start, length = np.concatenate(row), np.concatenate(start), np.concatenate(length)
            for k in range(0, len(row), _ROWS):
                part = slice(k, k + _ROWS)
                yield pa.RecordBatch.from_arrays([*r.names(row[part]), pa.array(start[part].astype(np.int32)), pa.array(length[part].astype(np.int32))], [*_NAME, "start", "length"])

    return run


def _groups(window: int):
    """Maximal repeat groups: one row per group and member."""
    kind = pa.schema([("grp", pa.string()), ("length", pa.int32()), ("no_id", pa.bool_()), ("doc", pa.int64()), ("start", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _blocks(it):
            no_id, doc, out = r.rows.column("no_id"), r.rows.column("doc"), []
            edges = np.append(r.first, r.rows.num_rows)

            def rows_of(phrase: int, offset: int, name: str, length: int) -> list[dict]:
                return [{"grp": name, "length": length, "no_id": no_id[i].as_py(), "doc": doc[i].as_py(), "start": int(r.start[i]) + offset} for i in range(int(edges[phrase]), int(edges[phrase + 1]))]

            whole = set()
            for length, members, best, _, body, offset in _block(r.bodies, r.doc, r.start[r.first[r.mine]], window):
                name = xxhash.xxh3_128_hexdigest(r.bodies[body[best]][offset[best]: offset[best] + length])
                for p, o in zip(body[members].tolist(), offset[members].tolist()):
                    if o == 0 and length == len(r.bodies[p]):
                        whole.add(int(r.mine[p]))
                    out += rows_of(int(r.mine[p]), o, name, length)
                    if len(out) >= _ROWS:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out = []
            # A phrase that stands more than once, but in no other one, is a group by itself.
            for p in np.flatnonzero(np.diff(edges) > 1):
                if p not in whole:
                    i = int(edges[p])
                    out += rows_of(p, 0, f"{r.rows.column('anchor')[i].as_py()}:{r.rows.column('name')[i].as_py()}", int(r.size[i]) + window - 1)
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    return run


# --- removal ----------------------------------------------------------------------------------------

def _removed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        texts, found = _raw(b.column("body")), b.column("found")
        sizes = np.array([len(t) for t in texts], np.int64)
        # A byte between texts keeps their spans apart.
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        row = np.repeat(np.arange(len(texts)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = found.flatten()
        start = flat.field("start").to_numpy(zero_copy_only=False) + base[row]
        edges = np.bincount(start, minlength=base[-1] + 1) - np.bincount(start + flat.field("length").to_numpy(zero_copy_only=False), minlength=base[-1] + 1)
        gone = np.cumsum(edges) > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        begin, end = turn[::2], turn[1::2]
        doc = np.searchsorted(base, begin, "right") - 1
        lost = np.bincount(doc, end - begin, len(texts)).astype(np.int64)
        keep = ~gone[: base[-1]]
        keep[base[1:] - 1] = False
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)[keep] if texts else np.empty(0, np.uint8)
        kept = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes - lost)]).astype(np.int64)), pa.py_buffer(data)])
        spans = pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32),
                                         pa.StructArray.from_arrays([pa.array(begin - base[doc]), pa.array(end - begin)], ["start", "length"]))
        doc = pa.array([None if none else d for none, d in zip(b.column("no_id").to_pylist(), b.column("doc").to_pylist())], pa.int64())
        yield pa.RecordBatch.from_arrays([doc, pa.array(sizes), pa.array(lost), kept.cast(pa.binary()), spans], ["doc", "n_bytes", "n_removed", "kept", "spans"])


def _own(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, doc = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    return docs.select(_own(F.col(text_col)).alias("own"), doc.isNull().alias("no_id"), F.coalesce(doc, F.xxhash64(text)).alias("doc"), F.hash(text).alias("tie"), text.cast("binary").alias("body"))


def _wanted(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first document of each text, those with phrases to look up, and the later copies without their texts.

    All readers use all columns of the texts, so that they share one exchange.
    """
    base = _named(docs, id_col, text_col)
    light = base.select("own", "no_id", "doc", F.octet_length("body").cast("long").alias("n_bytes"), F.when(F.octet_length("body") < window, F.col("body")).alias("short"))
    first = light.groupBy("own").agg(F.min(F.struct("no_id", "doc")).alias("first"))
    copies = light.join(first, "own").filter(F.struct("no_id", "doc") != F.col("first")).select("no_id", "doc", "n_bytes", "short")
    owns = first.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_set("own").alias("owns"))
    texts = base.mapInArrow(_packed, base.schema).join(owns, "doc").filter(F.array_contains("owns", F.col("own"))).select("no_id", "doc", "tie", "body")
    cut_up = texts.mapInArrow(_cut_up(window, seed), "doc long, anchor long, spot long")
    repeated = cut_up.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor", (F.col("times") > most).alias("hot"))
    wanted = cut_up.join(repeated, "anchor").groupBy("doc").agg(F.collect_set(F.struct("anchor", "spot", "hot")).alias("want"))
    return texts, texts.join(wanted, "doc").select("no_id", "doc", "tie", "body", "want"), copies


def _asked(rows: DataFrame, hot: bool) -> DataFrame:
    return rows.withColumn("want", F.filter("want", lambda w: w["hot"] == F.lit(hot))).filter(F.size("want") > 0)


def _sorted_phrases(rows: DataFrame, window: int) -> DataFrame:
    kind = f"anchor long, name long, {_PLACE}, size int, bytes binary"
    order = ["anchor", "name", *_NAME, "start"]
    return _asked(rows, False).mapInArrow(_phrases(window), kind).repartition("anchor").sortWithinPartitions(*order)


def _repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """Windows of split anchors that stand more than once, with their first place."""
    each = _asked(rows, True).mapInArrow(_windows(window), f"f1 long, f2 long, {_PLACE}")
    first = each.groupBy("f1", "f2").agg(F.min(F.struct(*_NAME, "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    return each.join(first.drop("times"), ["f1", "f2"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, most: int = MOST) -> DataFrame:
    """``(doc, n_bytes, n_removed, kept, spans)``, one row per input row: bytes covered by a window that also starts earlier go.

    ``spans`` are the maximal removed runs ``(start, length)`` in bytes of the text as it was, ``kept`` the remaining bytes.
    """
    texts, rows, copies = _wanted(docs, id_col, text_col, window, seed, most)
    spans = _sorted_phrases(rows, window).mapInArrow(_solved(window), "no_id boolean, doc long, tie int, start int, length int")
    later = F.struct(*_NAME, "start") != F.col("first")
    spans = spans.union(_repeated_windows(rows, window).filter(later).select(*_NAME, "start", F.lit(window).alias("length")))
    found = spans.groupBy("doc").agg(F.collect_list(F.struct("no_id", "tie", "start", "length")).alias("found"))
    # Documents of one id share a list; each takes its own part.
    mine = F.filter("found", lambda x: (x["no_id"] == F.col("no_id")) & (x["tie"] == F.col("tie")))
    done = texts.join(found, "doc", "left").select("no_id", "doc", "tie", "body", mine.alias("found")).mapInArrow(
        _removed, "doc long, n_bytes long, n_removed long, kept binary, spans array<struct<start: long, length: long>>")
    # A text's copies in later documents lose every window.
    gone = F.when(F.col("short").isNull(), F.col("n_bytes")).otherwise(0)
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))
    return done.union(copies.select(
        F.when(~F.col("no_id"), F.col("doc")).alias("doc"), "n_bytes", gone.alias("n_removed"), F.coalesce("short", F.lit(b"")).alias("kept"),
        F.when(F.col("short").isNull(), span).otherwise(F.filter(span, lambda x: F.lit(False))).alias("spans")))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, most: int = MOST) -> DataFrame:
    """``(grp, length, doc, start)``: every occurrence of every maximal repeat group, in the first document of each text.

    Groups are maximal within the phrases of their block; longer repeats are chains of them.
    """
    _, rows, _ = _wanted(docs, id_col, text_col, window, seed, most)
    member = _sorted_phrases(rows, window).mapInArrow(_groups(window), "grp string, length int, no_id boolean, doc long, start int")
    split = _repeated_windows(rows, window).select(F.concat_ws(":", "f1", "f2").alias("grp"), F.lit(window).alias("length"), "no_id", "doc", "start")
    return member.union(split).distinct().select("grp", "length", F.when(~F.col("no_id"), F.col("doc")).alias("doc"), "start")
