"""Conversation structure repair by error-correcting Earley parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. The
grammar below says so with left-recursive productions that end in a terminal,
so every chart item starts at column 0 and a column holds one item a
nonterminal, however long the conversation. Error productions give terminals
more ways than their own row: another row's role changed, or a row inserted;
and any item may delete a row. An item keeps the least (cost, audit) that leads
to it. The audit of the least item that completes the conversation in the last
column is the repair.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import small_batches

#: nonterminal: right-hand sides, each a nonterminal or none, then a terminal (the first letter of a role).
GRAMMAR = {
    "Lead": [(None, "s")],
    "Open": [(None, "u"), ("Lead", "u"), ("Turns", "u")],
    "Turns": [("Open", "a")],
}
#: What a conversation may consist of: nothing, or turns.
COMPLETE = (None, "Turns")
#: Roles that error productions may give a row or an inserted row.
MADE = {"u": "user", "a": "assistant"}
#: Cost of each edit, and what a truncated row that stays costs besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a row, the first that holds.
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3


def _predicted() -> dict:
    """For each completed nonterminal (None: the empty prefix) the items after it: (terminal that is due, nonterminal that this completes)."""
    after: dict = {None: []}
    for left, rights in GRAMMAR.items():
        after.setdefault(left, [])
        for before, terminal in rights:
            after.setdefault(before, []).append((terminal, left))
    return after


PREDICTED = _predicted()
NAMES = list(PREDICTED)


def _inserted() -> dict:
    """For each nonterminal what it becomes by inserted rows alone: (letters, nonterminal), shortest first, without coming back."""
    out = {}
    for start in NAMES:
        ways, seen = [("", start)], {start}
        for made, at in ways:
            for terminal, left in PREDICTED[at]:
                if terminal in MADE and left not in seen:
                    seen.add(left)
                    ways.append((made + terminal, left))
        out[start] = ways
    return out


#: Going round by insertions alone only adds cost, so a way visits each nonterminal once.
INSERTED = _inserted()


#: How an item comes from one of the column before: its nonterminal and the letters, one byte in ``Chart.back``.
STEPS = [(name, "I" * n + edit) for name in NAMES for n in range(1 + max(len(m) for ways in INSERTED.values() for m, _ in ways)) for edit in "DKR"]
STEP_OF = {step: i for i, step in enumerate(STEPS)}


@dataclass
class Item:
    """A chart item: what the best way to it costs, where its audit ranks in its column, and the repaired text so far."""

    cost: int
    rank: int
    digest: object  # running SHA-256 of the repaired rows
    empty: bool  # no repaired row so far


@dataclass
class Chart:
    """The newest column; of those before, how each item came from the column before it: a byte a nonterminal and row."""

    column: dict = field(default_factory=lambda: {None: Item(0, 0, hashlib.sha256(), True)})
    back: bytearray = field(default_factory=bytearray)

    def _best(self, ways: list) -> None:
        """``ways``: (cost, rank before, letters, item before, roles and texts written, item after). The least of each item after stays.

        Ways end in the letter of the row just read and inserted letters come
        before it, so of two ways none begins with the other: the rank of the
        column before and the new letters decide between their audits.
        """
        least: dict = {}
        for way in ways:
            old = least.get(way[5])
            if old is None or way[:3] < old[:3]:
                least[way[5]] = way
        order = sorted(least.values(), key=lambda w: (w[1], w[2]))
        column = {}
        for rank, (cost, _, _, before, written, after) in enumerate(order):
            old = self.column[before]
            digest, empty = old.digest, old.empty
            if written:
                digest = digest.copy()
                for row in written:
                    digest.update(row if empty else b"\n" + row)
                    empty = False
            column[after] = Item(cost, rank, digest, empty)
        came = {w[5]: STEP_OF[w[3], w[2]] for w in order}
        self.back += bytes(came.get(name, 255) for name in NAMES)
        self.column = column

    def read(self, role: str, text: str, fault: int) -> None:
        """One row: every item deletes it, or scans it as the terminal that it waits for, after insertions or none."""
        ways, initial, body = [], role[:1], None
        may_stay = fault in (NONE, CUT)
        extra = TRUNCATED if fault == CUT else 0
        for name, item in self.column.items():
            for made, at in INSERTED[name]:
                letters, cost = "I" * len(made), item.cost + INSERT * len(made)
                rows = [f"{MADE[t]}:".encode() for t in made]
                ways.append((cost + DELETE, item.rank, letters + "D", name, rows, at))
                if not may_stay:
                    continue
                if body is None:
                    body = f":{text}".encode("utf-8", "surrogatepass")
                for terminal, left in PREDICTED[at]:
                    if terminal == initial:
                        ways.append((cost + KEEP + extra, item.rank, letters + "K", name, [*rows, role.encode("utf-8", "surrogatepass") + body], left))
                    if terminal in MADE:
                        ways.append((cost + REROLE + extra, item.rank, letters + "R", name, [*rows, MADE[terminal].encode() + body], left))
        self._best(ways)

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired conversation) of the least item that completes it, after insertions or none."""
        ends = []
        for name, item in self.column.items():
            for made, at in INSERTED[name]:
                if at in COMPLETE:
                    ends.append((item.cost + INSERT * len(made), item.rank, "I" * len(made), name, made))
        cost, _, letters, name, made = min(ends)
        item = self.column[name]
        digest, empty = item.digest.copy(), item.empty
        for t in made:
            digest.update((b"" if empty else b"\n") + f"{MADE[t]}:".encode())
            empty = False
        audit = bytearray(letters.encode())
        for column in range(len(self.back) - len(NAMES), -1, -len(NAMES)):
            name, own = STEPS[self.back[column + NAMES.index(name)]]
            audit += own[::-1].encode()  # from the end to the beginning
        return cost, audit[::-1].decode(), digest.hexdigest()


def repair_rows(rows) -> tuple[int, str, str]:
    """(cost, audit, SHA-256) of a conversation's rows (role, text, fault)."""
    chart = Chart()
    for role, text, fault in rows:
        chart.read(role, text, fault)
    return chart.end()


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, here): rows with faults put in by crc32(``conv_id:turn``) modulo 20.

    0 drops the row (it stays with ``here`` false, so that its conversation is
    known), 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it,
    4 makes its role user. Nulls are one blank; a null turn or conversation
    stays null in its own column.
    """
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(string("conv_id"), F.lit(":"), string("turn"))) % 20
    role = F.when(fate == 4, "user").otherwise(string("role"))
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(string("text"), "[.!?]", "")).otherwise(string("text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (fate != 0).alias("here"), fate.alias("_f"))
    return rows.withColumn("_k", F.explode(F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_f", "_k")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    ``turns`` has conv_id, turn, role, text and ``here`` (false: the row only
    tells that its conversation is there). Rows go by turn, nulls first, rows of
    one turn by role and text. A row's fault is the first of: blank text,
    role and text of an earlier row, last visible character not ``.``, ``!`` or
    ``?``. Null roles and texts are one blank; a row of an empty role is never kept
    as it is. Rows without a conv_id make one
    conversation; one without rows has zeros and an empty audit; an empty table
    gives an empty one. Other columns are left aside.

    One shuffle by conversation; windows and order use spillable sorts. A
    conversation passes its task as a stream of rows, a column of the chart at
    a time with running digests, since a digest of the whole can't be divided:
    its texts are never held together. What stays of a row is a few letters.
    """
    spark = turns.sparkSession
    kind = dict(turns.dtypes)["conv_id"]
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), string("role"), string("text"), F.coalesce(F.col("here"), F.lit(False)).alias("here")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "here", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    last = F.regexp_extract("text", _LAST, 1)
    fault = F.when(last == "", BLANK).when(again > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(NONE)
    rows = rows.select("conv_id", "turn", "role", "text", "here", fault.alias("fault"))
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "fault")
    small_batches(spark)
    fields = [f.split() for f in RESULT.split(", ")]

    def run(batches):
        def lines():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        done, ids = [], []

        def batch():
            out = [pa.array(list(c), {"long": pa.int64(), "string": pa.string()}[t]) for c, (_, t) in zip(zip(*done), fields)]
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow_kind), *out], ["conv_id", *(n for n, _ in fields)])

        for conv, own in itertools.groupby(lines(), key=lambda r: r[0]):
            chart, count, illegal, before = Chart(), [0, 0, 0, 0], 0, None
            low = high = seen = None
            distinct = 0
            for _, turn, role, text, here, fault in own:
                if not here:
                    continue
                if turn is not None and turn != seen:
                    distinct, seen, low, high = distinct + 1, turn, turn if low is None else low, turn
                count[fault] += 1
                if before is not None and before + role[:1] not in ("su", "ua", "au"):
                    illegal += 1
                before = role[:1]
                chart.read(role, text, fault)
            gaps = 0 if low is None else high - low + 1 - distinct
            ids.append(conv)
            done.append((gaps, count[BLANK], count[DUPLICATE], count[CUT], illegal, *chart.end()))
            if len(done) >= 2000:
                yield batch()
                done, ids = [], []
        if done:
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(turns.schema["conv_id"].dataType)
    return rows.mapInArrow(run, f"conv_id {kind}, {RESULT}")
