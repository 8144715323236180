"""Conversation structure repair by dynamic programming over a grammar of role and fault sequences.

Symbols. A row is one of nine symbols: to be deleted (blank or seen before), or the initial of its role (s, u, a, other), whole
or truncated. The cheapest edits depend on the symbols alone.

Transfer matrices. The roles that are wanted, ``(s?(ua)+)?``, are an automaton of four states (nothing yet, after s, after u, after a). A
run of rows is a matrix over min-plus: for each pair of states the least cost and, among the cheapest, the ASCII-least string of edits, kept
as a rope (a tree of shared parts). Rows concatenate as matrices multiply. Of two equally cheap edit strings of the same rows none begins
with the other, since what would follow could only be inserts, which cost; so the order of ropes survives concatenation.

Grammar. Conversations are cut into pieces of at most ``PIECE`` rows; only different pieces are solved, wherever they occur. A batch of them is
compressed by Re-Pair: the most frequent pair of symbols becomes a new one, until none repeats. Each rule has one matrix, made bottom-up from its
two parts, and serves all pieces and conversations in which it occurs.

Scale: symbols come from range partitions by (conversation, turn), so that one conversation may stretch over many tasks. Texts are
shuffled once; each conversation is then streamed: first its pieces, whose matrices give the edits, then its rows, which are edited and hashed
one by one. A digest of a whole conversation can only be taken in order, so a conversation is one task's stream, but never held.

Defined results: a null id, turn, role or text counts as one blank (the id is given back as null, null turns come first and leave no gaps). Rows
of the same turn are ordered by role and text's hash; equal rows are duplicates. Very long texts are streamed like others. Extra columns
are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfgrade.llm.common import BLANKS

#: Rows of a piece, symbols that are compressed together.
PIECE, GRAMMAR = 1024, 1 << 15
#: Fixed values of the edit costs.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
#: State after a role's initial; missing pairs are not allowed.
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
SYMBOLS = "DsuaxSUAX"
LEGAL = {"su", "ua", "au"}


# --- ropes and matrices ---------------------------------------------------------------------------

class Rope:
    """A string as a tree of shared parts."""

    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, len(left) + len(right)

    def __len__(self) -> int:
        return self.size

    def __str__(self) -> str:
        out, open_ = [], [self]
        while open_:
            x = open_.pop()
            if isinstance(x, Rope):
                open_ += [x.right, x.left]
            else:
                out.append(x)
        return "".join(out)


def joined(a, b):
    """Short strings are joined at once, longer ones become a tree."""
    if not len(a):
        return b
    if not len(b):
        return a
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 32 else Rope(a, b)


def before(a, b) -> bool:
    """Whether one rope comes before another in ASCII order; parts that both share are skipped unread."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q:
            continue
        if isinstance(p, Rope) and (len(p) >= len(q) or not isinstance(q, Rope)):
            x += [p.right, p.left]
            y.append(q)
        elif isinstance(q, Rope):
            y += [q.right, q.left]
            x.append(p)
        else:
            k = min(len(p), len(q))
            if p[:k] != q[:k]:
                return p[:k] < q[:k]
            if len(p) > k:
                x.append(p[k:])
            if len(q) > k:
                y.append(q[k:])
    return bool(y) and not x


def better(new: tuple, old: tuple | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and before(new[1], old[1])


def product(a: list, b: list) -> list:
    """Min-plus product; entry ``4 * p + q`` is ``(cost, rope)`` or None."""
    out = [None] * 16
    for p in STATES:
        for q in STATES:
            if x := a[4 * p + q]:
                for r in STATES:
                    if y := b[4 * q + r]:
                        old, cost = out[4 * p + r], x[0] + y[0]
                        if old is None or cost <= old[0]:
                            new = (cost, joined(x[1], y[1]))
                            if better(new, old):
                                out[4 * p + r] = new
    return out


def _inserts() -> list:
    """Any number of inserts; more than three would come back to a state."""
    one = [None] * 16
    for (p, c), q in STEP.items():
        if c in "ua":
            one[4 * p + q] = (INSERT, "I")
    out = [(0, "") if p == q else None for p in STATES for q in STATES]
    power = out
    for _ in range(3):
        power = product(power, one)
        out = [y if y and better(y, x) else x for x, y in zip(out, power)]
    return out


def _row(symbol: str) -> list:
    """One row, with the inserts before it."""
    role, extra = symbol.lower(), CUT_OFF if symbol in "SUAX" else 0
    edits = [None] * 16

    def offer(p: int, q: int, cost: int, edit: str) -> None:
        if better((cost, edit), edits[4 * p + q]):
            edits[4 * p + q] = (cost, edit)

    for p in STATES:
        offer(p, p, DELETE, "D")
        if symbol != "D":
            for c in "sua":
                if (p, c) in STEP:
                    if c == role:
                        offer(p, STEP[p, c], extra, "K")
                    if c != "s":
                        offer(p, STEP[p, c], REROLE + extra, "R")
    return product(INSERTS, edits)


INSERTS = _inserts()
ROWS = [_row(s) for s in SYMBOLS]


# --- grammar --------------------------------------------------------------------------------------

def re_pair(sequences: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules ``(left, right)`` of the symbols from ``len(SYMBOLS)`` on, and the sequences in these symbols."""
    flat = np.concatenate([np.empty(0, np.int64), *[np.array([SYMBOLS.index(c) for c in s] + [-1], np.int64) for s in sequences]])
    rules: list[tuple[int, int]] = []
    while True:
        most = len(SYMBOLS) + len(rules)
        at = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
        # Every other place of a run of equal symbols, so that no two places of a pair overlap.
        same = at[flat[at] == flat[at + 1]]
        run = np.cumsum(np.diff(same, prepend=-2) != 1)
        at = np.setdiff1d(at, same[(np.arange(len(same)) - np.searchsorted(run, run)) % 2 == 1], assume_unique=True)
        pair = flat[at] * most + flat[at + 1]
        pairs, counts = np.unique(pair, return_counts=True)
        if not len(counts) or counts.max() < 2:
            break
        best = pairs[counts.argmax()]
        at = at[pair == best]
        rules.append((int(best) // most, int(best) % most))
        flat[at] = most
        flat = np.delete(flat, at + 1)
    ends = np.flatnonzero(flat == -1)
    return rules, [flat[s:e].tolist() for s, e in zip(np.concatenate([[0], ends[:-1] + 1]).astype(int), ends)]


def solved(sequences: list[str]) -> list[list]:
    """The matrix of each sequence, from one matrix per rule."""
    rules, coded = re_pair(sequences)
    matrices = list(ROWS)
    for left, right in rules:
        matrices.append(product(matrices[left], matrices[right]))
    out = []
    for symbols in coded:
        whole = matrices[symbols[0]]
        for s in symbols[1:]:
            whole = product(whole, matrices[s])
        out.append(whole)
    return out


def cheapest(matrices: list[list]) -> tuple[int, str]:
    """Cost and edits of a conversation, given the matrices of its pieces."""
    at: list = [(0, ""), None, None, None]
    for m in [*matrices, INSERTS]:
        new: list = [None] * 4
        for p in STATES:
            if at[p]:
                for q in STATES:
                    if y := m[4 * p + q]:
                        x = (at[p][0] + y[0], joined(at[p][1], y[1]))
                        if better(x, new[q]):
                            new[q] = x
        at = new
    best = at[START]
    if at[AFTER_A] and better(at[AFTER_A], best):
        best = at[AFTER_A]
    return best[0], str(best[1])


# --- Spark ------------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, text)`` after the damage: rows dropped, emptied, cut, repeated or given the role user by a checksum."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.withColumn("kind", kind).filter("kind <> 0")
            .select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("col"))


def _key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _faults(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, key, fault, initial)`` without texts; of several faults the first counts."""
    seen = F.row_number().over(Window.partitionBy("conv", "role", "key").orderBy(F.asc_nulls_first("turn"))) > 1
    body = F.btrim("text", F.lit(BLANKS))
    kept = rows.select("conv", "turn", "role", _key(F.col("text")).alias("key"), (F.length(body) == 0).alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"))
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("open"), "truncated")
    return kept.withColumn("fault", fault).select("conv", "turn", "role", "key", "fault", F.substring("role", 1, 1).alias("initial"))


_PIECE = ("conv long, piece long, symbols string, n_blank long, n_duplicate long, n_truncated long, n_illegal long, first string, last string, "
          "low long, high long, turns long")


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as pieces, numbered in order over all partitions."""
    kind = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in _PIECE.split(", "))])
    number, piece, symbols, out = TaskContext.get().partitionId() << 32, None, [], []

    def close() -> None:
        nonlocal piece, number
        if piece:
            out.append(piece | {"symbols": "".join(symbols), "piece": number})
            number += 1
        piece = None
        symbols.clear()

    for b in it:
        for conv, turn, fault, initial in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "fault", "initial"))):
            if piece is None or piece["conv"] != conv or len(symbols) >= PIECE:
                close()
                piece = {"conv": conv, "n_blank": 0, "n_duplicate": 0, "n_truncated": 0, "n_illegal": 0, "first": initial, "last": initial, "low": None, "high": None, "turns": 0}
            elif piece["last"] + initial not in LEGAL:
                piece["n_illegal"] += 1
            if fault:
                piece["n_" + fault] += 1
            role = initial if initial in ("s", "u", "a") else "x"
            symbols.append("D" if fault in ("blank", "duplicate") else role.upper() if fault else role)
            piece["last"] = initial
            if turn is not None:
                piece["low"] = turn if piece["low"] is None else piece["low"]
                piece["turns"] += turn != piece["high"]
                piece["high"] = turn
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, kind)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, kind)


def _matrices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different piece with the costs and edits of its matrix."""
    def out(held: list[str]) -> pa.RecordBatch:
        found = solved(held)
        costs = [[x and x[0] for x in m] for m in found]
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array(costs, pa.list_(pa.int64())), pa.array([[x and str(x[1]) for x in m] for m in found], pa.list_(pa.string()))],
                                          ["symbols", "costs", "edits"])

    held, size = [], 0
    for b in it:
        for s in b.column("symbols").to_pylist():
            held.append(s)
            size += len(s)
            if size >= GRAMMAR:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


class _Conversation:
    """One conversation of the stream: pieces first, then rows."""

    def __init__(self, conv):
        self.conv, self.matrices, self.last, self.high = conv, [], None, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low, self.turns, self.plan = None, 0, None

    def piece(self, r: dict) -> None:
        self.matrices.append([None if c is None else (c, e) for c, e in zip(r["costs"], r["edits"])])
        for k in self.counts:
            self.counts[k] += r["n_" + k]
        self.counts["illegal"] += self.last is not None and self.last + r["first"] not in LEGAL
        self.last = r["last"]
        if r["low"] is not None:
            self.low = r["low"] if self.low is None else self.low
            self.turns += r["turns"] - (r["low"] == self.high)
            self.high = r["high"]

    def begin(self) -> None:
        self.cost, self.edits = cheapest(self.matrices) if self.matrices else (0, "")
        self.matrices, self.plan, self.state, self.n = [], iter(self.edits), START, 0
        self.digest = hashlib.sha256()

    def put(self, role: str, text: str) -> tuple[int, str, str]:
        self.digest.update(("\n" * bool(self.n) + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.state = STEP[self.state, role[0]]
        self.n += 1
        return self.n, role, text

    def row(self, role: str | None, text: str | None) -> Iterator[tuple[int, str, str]]:
        """What comes out for a row, and after the last one (``role`` null)."""
        for edit in self.plan:
            wanted = "assistant" if self.state == AFTER_U else "user"
            if edit == "I":
                yield self.put(wanted, "")
            else:
                if edit != "D":
                    yield self.put(role if edit == "K" else wanted, text)
                return

    def summary(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "cost": self.cost, "audit": self.edits, "repaired_sha256": self.digest.hexdigest()}


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, position long, role string, text string"


def _streamed(turns: bool):
    kind = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in (_TURNS if turns else _SUMMARY).split(", "))])
    names = ("costs", "edits", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "first", "last", "low", "high", "turns")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0

        def put(found) -> None:
            nonlocal size
            for position, role, text in found:
                if turns:
                    out.append({"conv_id": now.conv, "position": position, "role": role, "text": text})
                    size += len(text)

        def close() -> None:
            if now:
                if now.plan is None:
                    now.begin()
                put(now.row(None, None))
                if not turns:
                    out.append(now.summary())

        for b in it:
            part, conv = b.column("part").to_pylist(), b.column("conv").to_pylist()
            for i, (p, c) in enumerate(zip(part, conv)):
                if p == 0:
                    # Each conversation begins with one row of this kind.
                    close()
                    now = _Conversation(c)
                elif p == 1:
                    now.piece({n: b.column(n)[i].as_py() for n in names})
                else:
                    if now.plan is None:
                        now.begin()
                    put(now.row(b.column("role")[i].as_py(), b.column("text")[i].as_py()))
                if len(out) >= 4096 or size >= 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out.clear()
                    size = 0
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return run


def _run(rows: DataFrame, turns: bool, damage: bool, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    base = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    left = damaged(base) if damage else base
    order = ["conv", "turn", "role", "key"]
    pieces = _faults(left).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, _PIECE)
    matrices = pieces.select("symbols").distinct().mapInArrow(_matrices, "symbols string, costs array<long>, edits array<string>")
    heads = base.select("conv").distinct().withColumn("part", F.lit(0))
    stream = heads.unionByName(pieces.join(matrices, "symbols").drop("symbols").withColumn("part", F.lit(1)), allowMissingColumns=True)
    stream = stream.unionByName(left.withColumn("key", _key(F.col("text"))).withColumn("part", F.lit(2)), allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "part", "piece", "turn", "role", "key")
    return stream.mapInArrow(_streamed(turns), _TURNS if turns else _SUMMARY)


def repair_summary(rows: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost and edits (Keep, Rerole, Delete, Insert by their initials) of the cheapest
    repair, and the SHA-256 of the repaired ``role:text`` lines. ``damage`` damages the rows first."""
    return _run(rows, False, damage, conv_col, turn_col, role_col, text_col)


def repaired_turns(rows: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, position, role, text)``: the repaired conversations."""
    return _run(rows, True, damage, conv_col, turn_col, role_col, text_col)
