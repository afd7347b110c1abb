"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``, by survivor-coalescence Viterbi.

Rows of all conversations are dealt by range of (conversation, turn), so that a conversation of any size is a few
neighbouring parts, each in order and each in one task. Over a part run at most four survivors, one for each state that
the roles so far can be in (nothing, after s, after u, after a). What they chose stands in a tree of back pointers with
counts of references: a survivor that loses gives up its branch, and as soon as all survivors share an ancestor, the
edits up to it are emitted and forgotten, so that only what is unresolved takes memory. Of equal costs the least
complete suffix since the shared ancestor wins: survivors are compared by their order, which decides as the suffixes
themselves would, since each of them has an edit for every row and so none is the beginning of another.

Conversations inside one part are settled at once. Of those that may go on in another part, and of those with much
text, a part first tells the cost and the order of the best way from every state to every state (32 numbers); parts are
then chained, and the rows, which were written, are run through once more from the known state to the known state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from trackloom.llm.arrow_text import byte_slices
from trackloom.operators.shared import materialise

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Characters of text of one conversation that a task holds before it writes the rows for the second run.
HELD = 8 << 20
#: Characters of repaired text in one row between the second run and the hash.
PIECE = 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that a new or renamed row takes after a state, and the state after it.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: (state, initial) that may be kept, and the state after it.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: By how much the rest may at most cost more from the first state than from the second: what the second does, the first
#: does too after at most two insertions, or by deleting a system's row that only the start may keep.
LAG = {
    **{(START, SYSTEM): 0, (START, USER): 2, (START, ASSISTANT): 0, (SYSTEM, START): 4, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4},
    **{(USER, START): 5, (USER, SYSTEM): 2, (USER, ASSISTANT): 2, (ASSISTANT, START): 3, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 2},
}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60


def steps_of(initial: str, forced: bool, truncated: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest (cost, edits) of one row between two states; of equal costs the least edits.

    A row that must go changes no state, and insertions before a deleted row are never better than those after it.
    """
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(4):
        offers = [(state, (DELETE, "D"))]
        if not forced:
            at = state
            for n in range(3):
                if (at, initial) in KEPT:
                    offers.append((KEPT[at, initial], (KEEP + truncated + n * INSERT, "I" * n + "K")))
                offers.append((NEXT[at][0], (REROLE + truncated + n * INSERT, "I" * n + "R")))
                at = NEXT[at][0]
        for end, way in offers:
            out[state, end] = min(out.get((state, end), way), way)
    return out


def endings() -> dict[int, tuple[int, str]]:
    """(cost, edits) after the last row from each state: roles must be none, or end with an assistant's."""
    out = {}
    for state in range(4):
        at, n = state, 0
        while at not in (START, ASSISTANT):
            at, n = NEXT[at][0], n + 1
        out[state] = (n * INSERT, "I" * n)
    return out


ENDINGS = endings()


class Ways:
    """Costs and order of the best ways from ``starts`` to every state, row by row, without the edits."""

    tables: dict[tuple, dict] = {}

    def __init__(self, starts=range(4)):
        # for each start: state to (cost, place in the order of edits)
        self.ways = {s: {s: (0, 0)} for s in starts}

    @classmethod
    def table(cls, initial: str, forced: bool, truncated: bool) -> dict:
        key = (initial if initial in ("s", "u", "a") else "", forced, truncated)
        if key not in cls.tables:
            cls.tables[key] = steps_of(*key)
        return cls.tables[key]

    @staticmethod
    def step(ways: dict[int, tuple[int, int]], table: dict) -> dict[int, tuple[int, int, int, str]]:
        """State to (cost, place, state before, edits) after one row; ties by place, then by the row's edits."""
        best: dict[int, tuple[int, int, str, int]] = {}
        for (a, b), (cost, edits) in table.items():
            if a in ways:
                offer = (ways[a][0] + cost, ways[a][1], edits, a)
                if b not in best or offer < best[b]:
                    best[b] = offer
        order = sorted(best, key=lambda b: best[b][1:3])
        return {b: (best[b][0], place, best[b][3], best[b][2]) for place, b in enumerate(order)}

    def feed(self, initial: str, forced: bool, truncated: bool, copies: int) -> None:
        for start, ways in self.ways.items():
            if not forced:
                ways = {b: x[:2] for b, x in self.step(ways, self.table(initial, False, truncated)).items()}
            gone = copies if forced else copies - 1
            self.ways[start] = {b: (cost + gone * DELETE, place) for b, (cost, place) in ways.items()} if gone else ways

    def numbers(self) -> list[int]:
        flat = [self.ways[s].get(e, (NEVER, 0)) for s in range(4) for e in range(4)]
        return [x[0] for x in flat] + [x[1] for x in flat]


class Node:
    """One row's edits on a way; ``refs`` counts the later nodes (``after``) and survivors that lead here."""

    __slots__ = ("parent", "state", "edits", "row", "refs", "after")

    def __init__(self, parent, state, edits, row):
        self.parent, self.state, self.edits, self.row, self.refs, self.after = parent, state, edits, row, 1, set()
        if parent is not None:
            parent.refs += 1
            parent.after.add(self)


class Survivors:
    """The run of one part from a known state. :meth:`feed` and :meth:`close` give the rows that are settled by then.

    A settled row is (edits, items): its edits' initials and the (role, text) that stay or are put in.
    """

    def __init__(self, start: int = START):
        self.root = Node(None, start, "", None)
        self.tips, self.ways = {start: self.root}, {start: (0, 0)}

    def feed(self, role: str, text: str, forced: bool, truncated: bool, copies: int) -> list[tuple[str, list]]:
        gone = "D" * (copies if forced else copies - 1)
        # a row that must go is no choice: it prolongs every survivor's way alike
        table = {(s, s): (0, "") for s in self.ways} if forced else Ways.table(role[:1], False, truncated)
        found = Ways.step(self.ways, table)
        # a survivor that another one undercuts whatever comes would keep the ways from ever meeting
        found = {b: x for b, x in found.items() if not any(a != b and y[0] + LAG[a, b] < x[0] for a, y in found.items())}
        tips = {end: Node(self.tips[before], end, edits + gone, (role, text)) for end, (_, _, before, edits) in found.items()}
        for node in self.tips.values():
            self.release(node)
        self.tips, self.ways = tips, {s: (x[0] + len(gone) * DELETE, x[1]) for s, x in found.items()}
        return self.settled()

    def release(self, node: Node) -> None:
        """A survivor leaves; the branch that nothing else leads to goes with it."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node.parent.after.remove(node)
            node.parent.refs -= 1
            node = node.parent

    def settled(self) -> list[tuple[str, list]]:
        """Rows from the root to the ancestor that all survivors share, which becomes the root."""
        out = []
        while self.root.refs == 1 and self.root.after:
            (node,) = self.root.after
            out.append(told(self.root.state, node.edits, node.row))
            node.parent = None
            self.root = node
        return out

    def close(self, end: int | None = None) -> tuple[int, list[tuple[str, list]]]:
        """Cost and last rows of the way to ``end``, or to the best ending with its insertions."""
        finish = ENDINGS if end is None else {end: (0, "")}
        end = min(finish.keys() & self.ways.keys(), key=lambda s: (self.ways[s][0] + finish[s][0], self.ways[s][1], finish[s][1]))
        for state in [s for s in self.tips if s != end]:
            self.release(self.tips.pop(state))
        return self.ways[end][0] + finish[end][0], [*self.settled(), told(end, finish[end][1], None)]


def told(state: int, edits: str, row: tuple[str, str] | None) -> tuple[str, list]:
    """``edits`` and the (role, text) that they leave of a row after ``state``."""
    items = []
    for x in edits:
        if x in "IR":
            state, role = NEXT[state]
            items.append((role, row[1] if x == "R" else ""))
        elif x == "K":
            items.append(row)
    return edits, items


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults by the CRC of ``conv_id:turn``, and ``copies``: 0, 1 or 2.

    Nulls of any of the four count as one space. 0 of 20 drops a row, 1 empties its text, 2 takes ``[.!?]`` out of it,
    3 repeats it and 4 makes its role user.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(fault.isin(0, 1), "").when(fault == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies")
    )


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``, and ``seen``: whether role and text stand in an earlier turn of the conversation.

    Equal rows of one turn become one before they move; texts meet by digest.
    """
    keys = ["conv_id", "role", "digest"]
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = rows.groupBy(*keys, "turn").agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    turns = rows.where("copies > 0").groupBy(*keys).agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = turns.where("n > 1").select(*[F.col(c).alias(f"r_{c}") for c in keys], F.col("first.turn").alias("r_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("r_conv_id")) & (F.col("role") == F.col("r_role")) & (F.col("digest") == F.col("r_digest"))
    seen = F.col("r_digest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("r_turn"))
    return rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "copies", seen.alias("seen"))


WHITE = " \t\n\v\f\r"


class Report:
    """Counts of the rows of one part of a conversation, in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.turn = self.low = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, seen: bool, copies: int) -> tuple[bool, bool]:
        """Whether the row must go, and whether it is cut off."""
        visible = text.strip(WHITE)
        blank, cut = not visible, visible[-1:] not in ".!?"
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies if seen else copies - 1
            self.truncated += cut and not seen
        self.illegal += copies - 1 + (self.last is not None and self.last + role[:1] not in LEGAL)
        self.first = role[:1] if self.first is None else self.first
        self.last = role[:1]
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.turn = turn
        return blank or seen, cut


PART = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("at", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("role", "text")],
        *[T.StructField(c, T.BooleanType()) for c in ("forced", "cut")],
        *[T.StructField(c, T.LongType()) for c in ("copies", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")],
        *[T.StructField(c, T.StringType()) for c in ("first", "last")],
        T.StructField("ways", T.ArrayType(T.LongType())),
        T.StructField("cost", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")],
    ]
)


def line(item: tuple[str, str]) -> bytes:
    return f"\n{item[0]}:{item[1]}".encode()


def settle(rows: list[tuple]) -> dict:
    """Cost, audit and hash of a whole conversation of ``rows`` (role, text, forced, cut, copies)."""
    run, audit, sha, some = Survivors(), [], hashlib.sha256(), False

    def take(settled):
        nonlocal some
        for edits, items in settled:
            audit.append(edits)
            for item in items:
                sha.update(line(item)[not some :])
                some = True

    for row in rows:
        take(run.feed(*row))
    cost, rest = run.close()
    take(rest)
    return {"cost": cost, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}


def part_rows(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[dict]:
    """The first run over a sorted part: a row for each conversation, and the rows of those that need the second run."""
    part = TaskContext.get().partitionId()
    now, rows, size, at, ways, report, first = None, [], 0, 0, None, None, True

    def spilled():
        nonlocal rows, size, at, ways
        ways = ways or Ways()
        for role, text, forced, cut, copies in rows:
            ways.feed(role[:1], forced, cut, copies)
            yield {"conv_id": now[0], "part": part, "at": at, "role": role, "text": text, "forced": forced, "cut": cut, "copies": copies}
            at += 1
        rows, size = [], 0

    def ended(edge: bool):
        if edge or ways:
            yield from spilled()
            if not at:  # a part of dropped rows alone may still be the one that closes the conversation
                yield {"conv_id": now[0], "part": part, "at": 0, "role": "", "text": "", "forced": True, "cut": False, "copies": 0}
        found = {"ways": ways.numbers()} if ways else settle(rows)
        yield {"conv_id": now[0], "part": part, "blank": report.blank, "duplicate": report.duplicate, "truncated": report.truncated, "illegal": report.illegal} | {
            "turns": report.turns, "low": report.low, "high": report.turn, "first": report.first, "last": report.last, **found
        }

    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text", "seen", "copies")]
        for a, b in byte_slices(columns[3], held):
            for conv, turn, role, text, seen, copies in zip(*(c.slice(a, b - a).to_pylist() for c in columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield from ended(first)
                        first = False
                    now, rows, size, at, ways, report = (conv,), [], 0, 0, None, Report()
                if not copies:
                    continue
                forced, cut = report.add(turn, role, text, seen, copies)
                rows.append((role, "" if forced else text, forced, cut, copies))
                size += len(text)
                if size > held or len(rows) > held >> 8:
                    yield from spilled()
    if now is not None:
        yield from ended(True)


def batched(rows: Iterator[dict], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``most`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row.values() if isinstance(x, (str, bytes)))
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def chained(parts: pd.DataFrame) -> pd.DataFrame:
    """Totals of a conversation from its parts (numbers and first and last roles alone), and each part's states.

    A conversation has a part in as many tasks as it was dealt to at most.
    """
    parts = parts.sort_values("part").reset_index(drop=True)
    best, back = {START: (0, 0)}, []
    for ways in parts["ways"]:
        found: dict[int, tuple[int, int, int, int]] = {}
        for s, (cost, place) in best.items():
            for e in range(4):
                if ways[4 * s + e] < NEVER:
                    offer = (cost + int(ways[4 * s + e]), place, int(ways[16 + 4 * s + e]), s)
                    found[e] = min(found.get(e, offer), offer)
        order = sorted(found, key=lambda e: found[e][1:3])
        back.append({e: found[e][3] for e in found})
        best = {e: (found[e][0], i) for i, e in enumerate(order)}
    end = min(best, key=lambda s: (best[s][0] + ENDINGS[s][0], best[s][1], ENDINGS[s][1]))
    cost, states = best[end][0] + ENDINGS[end][0], [end]
    for step in reversed(back):
        states.append(step[states[-1]])
    states.reverse()
    turned = parts.dropna(subset=["low"])
    shared = sum(a == b for a, b in zip(turned["high"][:-1], turned["low"][1:], strict=True))
    gaps = int(turned["high"].iloc[-1]) - int(turned["low"].iloc[0]) + 1 - int(turned["turns"].sum()) + shared if len(turned) else 0
    roles = parts.dropna(subset=["first"])
    illegal = int(parts["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(roles["last"][:-1], roles["first"][1:], strict=True))
    sums = parts[["blank", "duplicate", "truncated"]].sum()
    return pd.DataFrame(
        [
            (p, states[i], states[i + 1], i + 1 == len(parts), i == 0, gaps, int(sums["blank"]), int(sums["duplicate"]), int(sums["truncated"]), illegal, cost)
            for i, p in enumerate(parts["part"])
        ],
        columns=["part", "enter", "leave", "closes", "leads", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"],
    )


def repaired_pieces(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The second run: rows of parts in order, with the states around each part, to pieces of the repaired text."""
    now, run, audit, text, n, size, last = None, None, [], [], 0, 0, None

    def piece():
        nonlocal audit, text, n, size
        row = {"conv_id": now[0], "part": now[1], "piece": n, "audit": "".join(audit), "text": b"".join(text)}
        audit, text, n, size = [], [], n + 1, 0
        return row

    def take(settled):
        nonlocal size
        for edits, items in settled:
            audit.append(edits)
            text.extend(map(line, items))
            size += len(edits) + sum(len(x[1]) for x in items)

    def closed():
        take(run.close(last)[1])
        if closes:
            take([told(last, ENDINGS[last][1], None)])
        return piece()

    def rows():
        nonlocal now, run, last, n, closes
        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "part", "enter", "leave", "closes", "role", "text", "forced", "cut", "copies")]
            for a, b in byte_slices(columns[6], PIECE):
                for conv, part, enter, leave, end, *row in zip(*(c.slice(a, b - a).to_pylist() for c in columns), strict=True):
                    if now != (conv, part):
                        if now is not None:
                            yield closed()
                        now, run, last, closes, n = (conv, part), Survivors(enter), leave, end, 0
                    if row[-1]:
                        take(run.feed(*row))
                    if size > PIECE:
                        yield piece()
        if now is not None:
            yield closed()

    closes = False
    schema = pa.schema([("conv_id", kind), ("part", pa.int32()), ("piece", pa.int64()), ("audit", pa.string()), ("text", pa.binary())])
    yield from batched(rows(), schema, PIECE)


def hashed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Pieces in order to the audit and the hash of each conversation."""

    def rows():
        now, audit, sha, some = None, [], None, False
        for batch in batches:
            for conv, edits, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "text")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield {"conv_id": now[0], "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                    now, audit, sha, some = (conv,), [], hashlib.sha256(), False
                audit.append(edits)
                if text:
                    sha.update(text if some else text[1:])
                    some = True
        if now is not None:
            yield {"conv_id": now[0], "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    yield from batched(rows(), pa.schema([("conv_id", kind), ("audit", pa.string()), ("repaired_sha256", pa.string())]), PIECE)


def repair(rows: DataFrame, held: int = HELD) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text; optionally copies, 0 for a row that is gone).

    gaps, blank, duplicate, truncated, illegal, cost (longs), audit (initials of the edits) and repaired_sha256 (repaired
    ``role:text``, joined by newlines). Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty row 2,
    a row that stays though it is cut off 1 more; blank rows and rows whose role and text came before must go. Rows are
    taken by turn, nulls first, then by role and text. Null roles and texts count as one space; rows without conv_id are
    a conversation too. A conversation without rows has zeros, no audit and the hash of nothing; an empty table gives an
    empty result. Further columns don't matter. ``held``: characters of a conversation that a task keeps in memory.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = marked(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.col("copies").cast("long").alias("copies")))
    rows = materialise(rows, "turns")
    id_field = rows.schema["conv_id"]
    out = T.StructType([id_field, *PART])
    kind = to_arrow_type(id_field.dataType)
    schema = to_arrow_schema(out)

    def first_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(part_rows(batches, held), schema, PIECE)

    order: list[Column] = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    # a prefix of the text is enough to part the rows of one turn, and keeps the order
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    found = materialise(dealt.mapInArrow(first_run, out), "parts")

    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps")
    whole = found.where("at IS NULL AND ways IS NULL").select("conv_id", gaps, *counts[1:], "audit", "repaired_sha256")

    parts = found.where("ways IS NOT NULL").select("conv_id", "part", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last", "ways")
    told = T.StructType(
        [id_field, T.StructField("part", T.IntegerType()), *[T.StructField(c, T.IntegerType()) for c in ("enter", "leave")], *[T.StructField(c, T.BooleanType()) for c in ("closes", "leads")]]
        + [T.StructField(c, T.LongType()) for c in counts]
    )

    def chain(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        got = chained(group)
        got.insert(0, "conv_id", pd.Series([key[0]] * len(got), dtype=group["conv_id"].dtype))
        return got

    chains = materialise(parts.groupBy("conv_id").applyInPandas(chain, told), "chains")
    same = F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.part") == F.col("r.part"))
    second = found.where("at IS NOT NULL").select("conv_id", "part", "at", "role", "text", "forced", "cut", "copies").alias("r")
    second = second.join(chains.alias("c"), same).select("r.*", "c.enter", "c.leave", "c.closes")
    second = second.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
    pieces = second.mapInArrow(lambda b: repaired_pieces(b, kind), T.StructType([id_field, *[T.StructField(*x) for x in (("part", T.IntegerType()), ("piece", T.LongType()), ("audit", T.StringType()), ("text", T.BinaryType()))]]))
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    ends = pieces.mapInArrow(lambda b: hashed(b, kind), T.StructType([id_field, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]))
    totals = chains.where("leads").select("conv_id", *counts).alias("t")
    long_ones = totals.join(ends.alias("e"), F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")), "left").select(
        "t.*", F.coalesce("e.audit", F.lit("")).alias("audit"), F.coalesce("e.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )
    return whole.unionByName(long_ones)
