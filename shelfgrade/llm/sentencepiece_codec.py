"""SentencePiece encoding and decoding: Viterbi over a trie of the distinct marked words.

A text's blanks (U+0020) become marks (U+2581), with one mark put in front, and the text is cut into marked
words: a run of marks and the run of other characters after it. No usable piece has a mark after another
character, so the best segmentation of a text is that of its words, one by one. Within an Arrow batch the distinct words
are sorted; walking them in this order is a depth-first walk of their trie, and the forward scores of the prefix
shared with the word before are kept on a stack and not computed again.

Scores: log-probabilities from the piece's rank by Zipf's law, because the public vocabularies hold merge
ranks. Any other scores can be given. A character that is no piece costs 10 more than the rarest piece and becomes its
bytes, so decoding gives every text back exactly. A mark that is part of the text itself also becomes bytes.

Defined results: a null text has null ids; an empty text has none. Lone surrogates do not occur in Spark strings. Very long texts
and words are handled whole: work is linear in length times the longest piece. Repeated texts get equal ids. Extra columns are kept.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat
from math import inf, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from shelfgrade.llm.common import give_back

MARK = "▁"
_WORDS = re.compile(" *[^ ]+| +")
#: Distinct words remembered from batch to batch.
REMEMBERED = 300_000
#: Texts whose words are held at once, and their characters, unless a single text has more: arrays beside the texts hold some 30 bytes for each.
ROWS, CHARS = 256, 1 << 17


@dataclass(frozen=True)
class Pieces:
    """Scored pieces with their ids, the ids of the 256 bytes, and the surface of every id.

    Pieces are kept as they stand in a text, with blanks for marks; a mark in the text itself is no piece.
    """

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    #: The surfaces of all ids one after another as UTF-8, a byte piece as its byte: where each begins, and how long it is.
    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    unknown: float
    #: Where a piece's beginning goes on by a character, and where from if it does not; the pieces that end there, as (length, score, id), shortest
    #: first. A single character that is no piece has the id -1.
    children: list[dict[str, int]]
    fail: list[int]
    ending: list[tuple[tuple[int, float, int], ...]]


def make_pieces(vocabulary: list[tuple[str, str, float]]) -> Pieces:
    """From ``(piece, kind, score)`` by id; kind is ``normal``, ``byte`` or ``control``.

    Not used: pieces with a mark behind another character. Pieces of marks only lie within one word, at its start.
    """
    ids, scores, byte_ids, surfaces = {}, {}, [0] * 256, [b""] * len(vocabulary)
    for i, (piece, kind, score) in enumerate(vocabulary):
        if kind == "byte":
            byte_ids[int(piece[1:-1], 16)] = i
            surfaces[i] = bytes([int(piece[1:-1], 16)])
        elif kind == "normal":
            surface, bare = piece.replace(MARK, " "), piece.lstrip(MARK)
            surfaces[i] = surface.encode()
            if piece and MARK not in bare:
                ids.setdefault(surface, i)
                scores.setdefault(surface, score)
    sizes = np.array([len(x) for x in surfaces], np.int64)
    unknown = min(scores.values(), default=0.0) - 10
    return Pieces(ids, scores, tuple(byte_ids), np.frombuffer(b"".join(surfaces), np.uint8), np.cumsum(sizes) - sizes, sizes, unknown, *_automaton(ids, scores, unknown))


def _automaton(ids: dict[str, int], scores: dict[str, float], unknown: float) -> tuple[list, list, list]:
    """All beginnings of pieces as one tree, each with its longest proper ending that is a beginning, too."""
    children: list[dict[str, int]] = [{}]
    own: list[tuple | None] = [None]
    for piece in ids:
        at = 0
        for ch in piece:
            if ch not in children[at]:
                children[at][ch] = len(children)
                children.append({})
                own.append(None)
            at = children[at][ch]
        own[at] = (len(piece), scores[piece], ids[piece])
    fail, ending = [0] * len(children), [((1, unknown, -1),)] * len(children)
    level = list(children[0].values())
    depth = 1
    while level:
        below = []
        for at in level:
            # A character by itself is always possible.
            shorter = ending[fail[at]] if depth > 1 else () if own[at] else ((1, unknown, -1),)
            ending[at] = (*shorter, own[at]) if own[at] else shorter
            for ch, child in children[at].items():
                f = fail[at]
                while f and ch not in children[f]:
                    f = fail[f]
                fail[child] = children[f].get(ch, 0) if at else 0
                below.append(child)
        level, depth = below, depth + 1
    return children, fail, ending


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """The pieces of a model file. The file's path must be readable on every worker."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) else "normal" for i in range(m.get_piece_size())]
    ranked = sorted((i for i, k in enumerate(kinds) if k == "normal"), key=lambda i: (-m.get_score(i), i))
    zipf = {i: -log(r + 10) for r, i in enumerate(ranked)}
    return make_pieces([(m.id_to_piece(i), k, zipf.get(i, 0.0)) for i, k in enumerate(kinds)])


def encode_words(words: list[str], pieces: Pieces) -> dict[str, list[int]]:
    """Ids of each distinct word.

    Forward state at depth d: the longest ending of the first d characters that begins a piece, the best score of them, and the last piece of
    that. Sorted order visits each trie node once, parents first; a word goes on from the deepest node that it shares with the one
    before. Of equally good pieces the longest is taken.
    """
    out: dict[str, list[int]] = {}
    at, best, back, before = [0], [0.0], [(0, 0.0, 0)], ""
    children, fail, ending = pieces.children, pieces.fail, pieces.ending
    for word in sorted(set(words)):
        same, most = 0, min(len(word), len(before))
        while same < most and word[same] == before[same]:
            same += 1
        del at[same + 1:], best[same + 1:], back[same + 1:]
        state = at[same]
        for ch in word[same:]:
            new = children[state].get(ch)
            while new is None and state:
                state = fail[state]
                new = children[state].get(ch)
            state = new or 0
            top = -inf
            for piece in ending[state]:
                score = best[-piece[0]] + piece[1]
                if score >= top:
                    top, last = score, piece
            at.append(state)
            best.append(top)
            back.append(last)
        ids, end = [], len(word)
        while end:
            n, _, i = back[end]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(pieces.byte_ids[x] for x in reversed(word[end - 1].encode("utf-8", "surrogatepass")))
            end -= n
        ids.reverse()
        out[word] = ids
        before = word
    return out


def encode_text(text: str, pieces: Pieces) -> list[int]:
    """One text; for tests and small uses."""
    words = _WORDS.findall(" " + text) if text else []
    table = encode_words(words, pieces)
    return list(chain.from_iterable(table[w] for w in words))


def joined_bytes(ids: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The surfaces of ids one after another as UTF-8, and where each ends. A byte piece is its byte, so runs of them decode together."""
    size = pieces.sizes[ids]
    ends = np.cumsum(size)
    return pieces.flat[np.repeat(pieces.starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def decode_ids(ids, pieces: Pieces) -> str:
    """The text behind the ids of one text."""
    ids = np.asarray(ids, np.int64)
    return joined_bytes(ids, pieces)[0].tobytes().decode("utf-8", "replace")[1:]


class Memory:
    """The ids of the words that a worker has met, in one flat array. When it is full, the older half goes.

    A key is a word without its blank, as it stands between single blanks; words with other blanks are kept as they are.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.number = pieces, {}
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)

    def _forget(self) -> None:
        cut = len(self.number) // 2
        self.number = {w: i - cut for w, i in self.number.items() if i >= cut}
        self.flat = self.flat[self.starts[cut]:]
        self.starts = self.starts[cut:] - self.starts[cut]

    def _learn(self, words: set[str]) -> None:
        full = {w if w[0] == " " else " " + w: w for w in words}
        table = encode_words(list(full), self.pieces)
        n = len(self.number)
        self.number.update((full[w], n + i) for i, w in enumerate(table))
        sizes = np.fromiter(map(len, table.values()), np.int64, len(table))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(table.values()), np.int32, int(sizes.sum()))])

    def numbers(self, keys: list[str]) -> np.ndarray:
        got = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            words = {keys[i] for i in missing.tolist()}
            if len(self.number) + len(words) > REMEMBERED and self.number:
                self._forget()
                return self.numbers(keys)
            self._learn(words)
            got[missing] = np.fromiter((self.number[keys[i]] for i in missing.tolist()), np.int64, len(missing))
        return got

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a few texts, and the number of each text's."""
        keys: list[str] = []
        words = []
        for t in texts:
            before = len(keys)
            if t:
                if "  " not in t and t[0] != " " and t[-1] != " ":
                    keys += t.split(" ")
                else:
                    keys += [w[1:] if w[0] == " " and w[1:2] not in ("", " ") else w for w in _WORDS.findall(" " + t)]
            words.append(len(keys) - before)
        if not keys:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        number = self.numbers(keys)
        begin = self.starts[number]
        size = self.starts[number + 1] - begin
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))]
        per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        return ids, np.diff(per_text)


def parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in runs of at most ``ROWS`` texts and ``CHARS`` characters; a longer text by itself."""
    part, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if part and (len(part) == ROWS or size + n > CHARS):
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def _per_text(ids: np.ndarray, counts: np.ndarray, texts: list[str | None]) -> list[np.ndarray | None]:
    ends = np.cumsum(counts).tolist()
    return [None if t is None else ids[b - n: b] for t, b, n in zip(texts, ends, counts.tolist())]


def _same(ids: np.ndarray, counts: np.ndarray, texts: list[str | None], pieces: Pieces) -> list[bool]:
    """Whether the ids of each text decode to it; true for null."""
    data, ends = joined_bytes(ids, pieces)
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    # A text begins with the blank that was put in front of it.
    return [t is None or data[a + 1: b].tobytes() == t.encode("utf-8", "surrogatepass") for t, a, b in zip(texts, at, at[1:])]


def encode(text: Column, path: str) -> Column:
    """``array<int>`` of piece ids."""
    @F.pandas_udf("array<int>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = Memory(load(path))
        for s in it:
            out: list[np.ndarray | None] = []
            for part in parts(s.tolist()):
                out += _per_text(*memory.ids(part), part)
            yield pd.Series(out, dtype=object)
        del memory
        give_back()

    return run(text)


def encode_checked(text: Column, path: str) -> Column:
    """Struct ``(ids, round_trip)``: the ids, decoded again in the same task, and whether they give the text back.

    One worker per task does both, so that ids need not go back and forth.
    """
    @F.pandas_udf("ids array<int>, round_trip boolean")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = load(path)
        memory = Memory(pieces)
        for s in it:
            coded, same = [], []
            for part in parts(s.tolist()):
                ids, counts = memory.ids(part)
                coded += _per_text(ids, counts, part)
                same += _same(ids, counts, part, pieces)
            yield pd.DataFrame({"ids": pd.Series(coded, dtype=object), "round_trip": np.array(same, bool)})
        del memory
        give_back()

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text behind piece ids; null for null."""
    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = load(path)
        for s in it:
            yield pd.Series([None if x is None else decode_ids(x, pieces) for x in s], dtype=object)

    return run(ids)
