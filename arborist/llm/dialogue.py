"""Repair of conversation structure: cheapest edits by a backward cost-to-go pass and a greedy forward walk.

Edits keep (K), re-role (R) or delete (D) a row or insert (I) an empty one, such that what is left reads
as an optional system turn followed by pairs of user and assistant, or as nothing. The grammar has four
states, so the cost to go before a row is four numbers; going backward they follow from the row and the
four after it, and the walk forward takes the ASCII-least of the edits that lose nothing. Differences
of four small costs are few, hence each step is looked up in a table that fills as cases are met.

A conversation may be longer than a task should hold. Rows are put in order by range, and each range has a
piece of each conversation in it. A piece is a 4 x 4 matrix of least costs; matrices of the conversations
that lie in more than one range (fewer than there are ranges) are multiplied from behind, which gives
every piece the costs at its end; then every piece says where it would leave each state, which gives
every piece its first state; then all pieces are walked at once. Equal rows of one turn are one row with a
count. Only SHA-256 of a conversation's text goes along its pieces one after the other, as it must,
piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import stored

WHITE = " \t\n\x0b\x0c\r"
COST_RENAME, COST_DELETE, COST_INSERT, COST_TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
OPENS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INITIALS = "sua"
BIT_CUT, BIT_GONE = 4, 8
NEVER = 1 << 40
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {(0, 1), (1, 2), (2, 1)}
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

Costs = tuple[int, ...]


def added_state(state: int) -> int:
    """The state after an inserted or renamed turn, whose role the state decides."""
    return ASSISTANT if state == USER else USER


def added_role(state: int) -> bytes:
    return b"assistant" if state == USER else b"user"


def after_inserts(costs: Costs) -> Costs:
    """Costs to go when turns may be inserted first."""
    once = [min(c, COST_INSERT + costs[added_state(s)]) for s, c in enumerate(costs)]
    return tuple(min(c, COST_INSERT + once[added_state(s)]) for s, c in enumerate(once))


AT_END = after_inserts(tuple(0 if s in FINAL else NEVER for s in range(4)))


def edits_of(code: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that use up a row. code: role initial (3: none of s, u, a), BIT_CUT, BIT_GONE."""
    out = [("D", COST_DELETE, state)]
    if not code & BIT_GONE:
        more = COST_TRUNCATED if code & BIT_CUT else 0
        kept = OPENS.get((state, INITIALS[code & 3])) if code & 3 < 3 else None
        out += [("K", more, kept)] if kept is not None else []
        out.append(("R", more + COST_RENAME, added_state(state)))
    return out


@lru_cache(maxsize=1 << 16)
def backward(code: int, after: Costs) -> tuple[Costs, tuple[tuple[str, int, int], ...]]:
    """Costs to go before a row from those after it; and for each state the edits chosen up to this row's own, their cost, the next state."""
    uses = [edits_of(code, s) for s in range(4)]
    before = after_inserts(tuple(min(c + after[t] for _, c, t in uses[s]) for s in range(4)))
    moves = []
    for first in range(4):
        s, text, spent = first, "", 0
        while True:
            tight = [(e, c, t) for e, c, t in uses[s] if c + after[t] == before[s]]
            if COST_INSERT + before[added_state(s)] == before[s]:
                tight.append(("I", COST_INSERT, added_state(s)))
            e, c, s = min(tight)
            text, spent = text + e, spent + c
            if e != "I":
                break
        moves.append((text, spent, s))
    return before, tuple(moves)


def plan(codes: list[int], end: Costs = AT_END) -> tuple[Costs, list[tuple[tuple[str, int, int], ...]]]:
    """Costs to go before the rows, less a constant, and each row's moves; `end`: the costs after them."""
    costs, moves = end, []
    for code in reversed(codes):
        low = min(costs)
        costs, step = backward(code, tuple(c - low for c in costs))
        moves.append(step)
    return costs, moves[::-1]


def trailing(state: int) -> str:
    """The inserts that end a conversation in `state`."""
    out = ""
    while state not in FINAL:
        state, out = added_state(state), out + "I"
    return out


@lru_cache(maxsize=64)
def _row_matrix(code: int) -> tuple[Costs, ...]:
    unit = [tuple(0 if t == to else NEVER for t in range(4)) for to in range(4)]
    cols = [after_inserts(tuple(min(c + u[t] for _, c, t in edits_of(code, s)) for s in range(4))) for u in unit]
    return tuple(tuple(min(NEVER, cols[t][s]) for t in range(4)) for s in range(4))


def cost_matrix(codes: list[int]) -> list[list[int]]:
    """Least cost of going through the rows from each state to each."""
    total = [[0 if s == t else NEVER for t in range(4)] for s in range(4)]
    for code in codes:
        row = _row_matrix(code)
        total = [[min(total[s][m] + row[m][t] for m in range(4)) for t in range(4)] for s in range(4)]
    return total


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after damage by crc32("conv_id:turn") % 20, nulls read as one space.

    0 drops a row (n is 0, so that its conversation stays known), 1 empties its text, 2 removes its
    full stops, exclamation and question marks, 3 repeats it (n is 2), 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("k"))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("n"))


def in_order(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, part, turn, role, text, n, code): distinct rows with counts, in ranges of conversation, turn (nulls first), role and text."""
    order = ["conv_id", "turn", "role", "text"]
    one = rows.groupBy("conv_id", "turn", F.when(F.col("n") > 0, F.col("role")).alias("role"), F.when(F.col("n") > 0, F.col("text")).alias("text"))
    one = stored(one.agg(F.sum("n").cast("long").alias("n")).withColumn("digest", F.sha2("text", 256)), "turns")
    same = one.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("k")).where("k > 1")
    same = same.select(F.col("conv_id").alias("c2"), F.col("role").alias("r2"), F.col("digest").alias("d2"), "first")
    met = one.join(same, one.conv_id.eqNullSafe(same.c2) & (one.role == same.r2) & (one.digest == same.d2), "left")
    again = F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    bare = F.rtrim("text", F.lit(WHITE))
    blank = bare == ""
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(INITIALS) for x in (c, i)]), F.left("role", F.lit(1))), F.lit(3))
    cut = ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    code = initial + F.when(blank | again, BIT_GONE).when(cut, BIT_CUT).otherwise(0)
    coded = met.select(*order, "n", blank.alias("blank"), F.when(F.col("n") > 0, code).otherwise(0).cast("int").alias("code"))
    ranged = coded.repartitionByRange(parts, *order) if parts else coded.repartitionByRange(*order)
    return stored(ranged.withColumn("part", F.spark_partition_id()), "ordered")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one piece at a time, of batches that begin with conv_id and part and are in their order."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _each_piece(rows: DataFrame, work: Callable[[list[tuple]], Iterable[tuple]], fields: list[str], kind: str) -> DataFrame:
    """What `work` makes of each piece, whose rows it gets in order; batches go on by number and size."""
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in _pieces(batches):
            for row in work(piece):
                held.append(row)
                size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
                if size > BATCH_BYTES or len(held) == BATCH_ROWS:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    dealt = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return dealt.select(*fields).mapInArrow(run, kind)


def _codes(piece: list[tuple]) -> list[int]:
    return [r[3] for r in piece if r[2] > 0]


def borders(ordered: DataFrame) -> DataFrame:
    """(c2, p2, last, costs, entry) for the pieces of conversations that lie in several ranges: the costs at a piece's end, its first state."""
    conv = ordered.schema["conv_id"].dataType.simpleString()
    spread = ordered.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(F.col("conv_id").alias("c2"))
    rows = stored(ordered.join(spread, ordered.conv_id.eqNullSafe(spread.c2), "left_semi"), "spread")

    kind = f"conv_id {conv}, part int, matrix array<long>"
    through = _each_piece(rows, lambda p: [(*p[0][:2], [c for line in cost_matrix(_codes(p)) for c in line])], ["conv_id", "part", "n", "code"], kind)

    def from_behind(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces, costs, out = pieces.sort_values("part", ascending=False), AT_END, []
        for m in pieces["matrix"]:
            low = min(costs)
            out.append([c - low for c in costs])
            costs = tuple(min(m[4 * s + t] + out[-1][t] for t in range(4)) for s in range(4))
        return pieces[["conv_id", "part"]].assign(costs=out)

    ends = stored(through.groupBy("conv_id").applyInPandas(from_behind, f"conv_id {conv}, part int, costs array<long>"), "ends")
    ends2 = ends.select(F.col("conv_id").alias("c2"), F.col("part").alias("p2"), "costs")

    def leaves(piece: list[tuple]) -> list[tuple]:
        moves = plan(_codes(piece), tuple(piece[0][4]))[1]
        states = [0, 1, 2, 3]
        for step in moves:
            states = [step[s][2] for s in states]
        return [(*piece[0][:2], piece[0][4], states)]

    kind = f"conv_id {conv}, part int, costs array<long>, leaves array<int>"
    known = rows.join(ends2, rows.conv_id.eqNullSafe(F.col("c2")) & (rows.part == F.col("p2")))
    left = _each_piece(known, leaves, ["conv_id", "part", "n", "code", "costs"], kind)

    def from_front(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces, state, out = pieces.sort_values("part"), START, []
        for to in pieces["leaves"]:
            out.append(state)
            state = int(to[state])
        last = pieces["part"] == pieces["part"].max()
        return pieces[["conv_id", "part", "costs"]].assign(entry=out, last=last).rename(columns={"conv_id": "c2", "part": "p2"})

    return stored(left.groupBy("conv_id").applyInPandas(from_front, f"c2 {conv}, p2 int, costs array<long>, entry int, last boolean"), "borders")


FIELDS = ["conv_id", "part", "turn", "n", "code", "blank", "role", "text", "costs", "entry", "last"]


def _walk(piece: list[tuple]) -> Iterator[tuple[str, tuple | None, int]]:
    """(edits, row, state before) for each row of a piece and what is inserted at its end (row None)."""
    rows = [r for r in piece if r[3] > 0]
    spread = piece[0][9] is not None
    state = piece[0][9] if spread else START
    moves = plan([r[4] for r in rows], tuple(piece[0][8]) if spread else AT_END)[1]
    for row, step in zip(rows, moves):
        edits, _, after = step[state]
        yield edits + "D" * (row[3] - 1), row, state
        state = after
    if not spread or piece[0][10]:
        yield trailing(state), None, state


def _lines(edits: str, row: tuple | None, state: int) -> Iterator[tuple[str, bytes, bytes]]:
    """(edit, role, text) of the turns that edits leave standing."""
    for e in edits:
        if e == "I":
            yield e, added_role(state), b""
            state = added_state(state)
        elif e == "R":
            yield e, added_role(state), row[7]
        elif e == "K":
            yield e, row[6], row[7]


def _summary(piece: list[tuple]) -> list[tuple]:
    """A piece's counts, edits and repaired text; its text's digest instead where it is the whole conversation."""
    blank = duplicate = cut = illegal = cost = turns = 0
    low = high = None
    first = before = -1
    audit, lines = [], []
    for edits, row, state in _walk(piece):
        audit.append(edits)
        lines += [role + b":" + text for _, role, text in _lines(edits, row, state)]
        cost += COST_DELETE * edits.count("D") + COST_INSERT * edits.count("I") + COST_RENAME * edits.count("R")
        if row is None:
            continue
        turn, n, code = row[2:5]
        if turn is not None and turn != high:
            low, high, turns = turn if low is None else low, turn, turns + 1
        if row[5]:
            blank += n
        else:
            duplicate += n if code & BIT_GONE else n - 1
        if code & BIT_CUT:
            cut += 1
            cost += COST_TRUNCATED if "K" in edits or "R" in edits else 0
        initial = code & 3
        illegal += (before >= 0 and (before, initial) not in LEGAL) + n - 1
        first = initial if first < 0 else first
        before = initial
    text = b"\n".join(lines)
    spread = piece[0][9] is not None
    digest = None if spread else hashlib.sha256(text).hexdigest()
    return [(*piece[0][:2], spread, low, high, turns, blank, duplicate, cut, illegal, first, before, cost, "".join(audit), digest, len(lines), text if spread else None)]


class _Whole:
    """One conversation's result from its pieces, which come one after the other."""

    def __init__(self) -> None:
        self.low = self.high = None
        self.turns = self.lines = 0
        self.sums = [0] * 5
        self.last, self.audit, self.digest = -1, [], hashlib.sha256()

    def add(self, r: dict) -> None:
        self.conv_id = r["conv_id"]
        if r["low"] is not None:
            self.turns += r["turns"] - (self.high == r["low"])
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        self.sums = [a + r[c] for a, c in zip(self.sums, ("blank", "duplicate", "truncated", "illegal", "cost"))]
        self.sums[3] += self.last >= 0 and r["first"] >= 0 and (self.last, r["first"]) not in LEGAL
        self.last = r["final"] if r["final"] >= 0 else self.last
        self.audit.append(r["audit"])
        if r["n_lines"]:
            self.digest.update((b"\n" if self.lines else b"") + r["repaired"])
            self.lines += r["n_lines"]

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.sums, "".join(self.audit), self.digest.hexdigest()


def _with_borders(rows: DataFrame, parts: int | None) -> DataFrame:
    typed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("n").cast("long").alias("n"))
    ordered = in_order(typed, parts)
    at = borders(ordered)
    return ordered.join(at, ordered.conv_id.eqNullSafe(at.c2) & (ordered.part == at.p2), "left")


def _as_bytes(known: DataFrame) -> DataFrame:
    return known.withColumns({"role": F.col("role").cast("binary"), "text": F.col("text").cast("binary"), "blank": F.coalesce("blank", F.lit(False))})


def repair(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation in rows (conv_id, turn, role, text, n).

    n is how often a row is there; a row with n 0 only makes its conversation known, and one without
    other rows has zeros, an empty audit and the digest of nothing. Rows go by turn (nulls first), within a
    turn by role and text; a null conv_id is a conversation like any other; blank texts, repeated rows
    and cut-off texts are the faults counted, each row by its first; texts of any length are compared
    and hashed whole. Roles other than by initials s, u and a cannot be kept. An empty table gives no
    rows. parts: how many ranges (by default what Spark chooses); the result does not depend on it.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    known = _as_bytes(_with_borders(rows, parts))
    kind = (
        f"conv_id {conv}, part int, spread boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
        "first int, final int, cost long, audit string, digest string, n_lines long, repaired binary"
    )
    pieces = stored(_each_piece(known, _summary, FIELDS, kind), "pieces")
    out = f"conv_id {conv}, {COUNTS}"
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    whole = pieces.where("not spread").select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))

    schema = to_arrow_schema(StructType.fromDDL(out))

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for r in b.to_pylist():
                if now is not None and r["conv_id"] != now.conv_id:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), schema.types)], schema=schema)
                    now = None
                now = now or _Whole()
                now.add(r)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), schema.types)], schema=schema)

    spread = pieces.where("spread").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(spread.mapInArrow(join_pieces, out))


def repaired_turns(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, part, position, edit, role, text): the turns left after repair(), in order of part and position; inserted ones have edit I."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def turns(piece: list[tuple]) -> Iterator[tuple]:
        position = 0
        for edits, row, state in _walk(piece):
            for edit, role, text in _lines(edits, row, state):
                yield *piece[0][:2], position, edit, role.decode("utf-8", "replace"), text.decode("utf-8", "replace")
                position += 1

    return _each_piece(_as_bytes(_with_borders(rows, parts)), turns, FIELDS, f"conv_id {conv}, part int, position long, edit string, role string, text string")
