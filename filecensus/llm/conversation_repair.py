"""Cheapest edits that give a conversation the form: perhaps system, then user and assistant in turns.

Survivor-coalescence Viterbi: rows go by in order, and for each state the roles may be in only
the cheapest way there survives.  The survivors are leaves of a tree of edits whose nodes know
their children; a branch goes when its last survivor does, and once all survivors share an
ancestor the edits up to it are settled, handed on and forgotten.  Ties are decided by the whole
edit texts, settled or not: each survivor has its rank among them, which the next rank and
the few edits behind it decide anew, as no text of a survivor is the beginning of another's.

A conversation is one stream through one task: only what the survivors disagree on is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
REROLE = INSERT = TRUNCATED = 3
DELETE = 4
ROWS_OUT = 4096

# What the roles emitted so far end in.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = {"u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "s": {NOTHING: SYSTEM}}
ROLES = {"u": "user", "a": "assistant"}
COMPLETE = (NOTHING, ASSISTANT)
LEGAL = ("su", "ua", "au")
#: IMITATION[x][y]: what it costs at most to go on from x as one could from y.
IMITATION = [[0, 0, 3, 0], [6, 0, 3, 6], [7, 3, 0, 3], [4, 0, 3, 0]]


class _Node:
    """The edits of one row (inserts, then the row's own) behind those of its parent."""

    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent, edits):
        self.parent, self.edits, self.children = parent, edits, []
        if parent is not None:
            parent.children.append(self)


class Survivors:
    """The cheapest ways through the rows so far; ``step`` and ``finish`` return the edits that became settled.

    An edit is (letter, role, text, cost, row): letters are Keep, Rerole, Delete and Insert, ``row`` what the caller
    gave with the row (None for an insert).
    """

    def __init__(self):
        self.base = _Node(None, ())
        self.leaves = {NOTHING: (0, 0, self.base)}  # state: cost, rank, node

    def _with_inserts(self) -> list[tuple]:
        """Every survivor with up to two inserts behind it: (state, cost, rank, letters, node, inserted roles)."""
        ways = []
        for state, (cost, rank, node) in self.leaves.items():
            ways.append((state, cost, rank, "", node, ()))
            for first in "ua":
                if (one := FOLLOW[first].get(state)) is not None:
                    ways.append((one, cost + INSERT, rank, "I", node, (first,)))
                    second = "a" if first == "u" else "u"
                    ways.append((FOLLOW[second][one], cost + 2 * INSERT, rank, "II", node, (first, second)))
        return ways

    def step(self, role: str, text: str, must_go: bool, truncated: bool, row=None) -> list[tuple]:
        initial, extra = role[:1], TRUNCATED if truncated else 0
        best: dict[int, tuple] = {}

        def offer(state, cost, rank, letters, node, inserted, own):
            old = best.get(state)
            if old is None or (cost, rank, letters) < old[:3]:
                best[state] = (cost, rank, letters, node, inserted, own)

        for state, cost, rank, letters, node, inserted in self._with_inserts():
            offer(state, cost + DELETE, rank, letters + "D", node, inserted, ("D", None, None, DELETE, row))
            if must_go:
                continue
            if (kept := FOLLOW.get(initial, {}).get(state)) is not None:
                offer(kept, cost + extra, rank, letters + "K", node, inserted, ("K", role, text, extra, row))
            for new, name in ROLES.items():
                if (after := FOLLOW[new].get(state)) is not None:
                    paid = REROLE + extra
                    offer(after, cost + paid, rank, letters + "R", node, inserted, ("R", name, text, paid, row))
        alive = {
            state: way for state, way in best.items()
            if all(way[0] <= other[0] + IMITATION[x][state] for x, other in best.items())
        }
        ranks = {key: n for n, key in enumerate(sorted({way[1:3] for way in alive.values()}))}
        old = [node for _, _, node in self.leaves.values()]
        self.leaves = {
            state: (cost, ranks[rank, letters], _Node(node, (*map(_inserted, inserted), own)))
            for state, (cost, rank, letters, node, inserted, own) in alive.items()
        }
        for node in old:
            self._drop(node)
        return self._settled()

    def _drop(self, node: _Node) -> None:
        while node is not self.base and not node.children:
            parent = node.parent
            parent.children.remove(node)
            node = parent

    def _settled(self) -> list[tuple]:
        """Edits up to the last ancestor that all survivors share, but not beyond a survivor itself."""
        done = []
        while len(self.base.children) == 1:
            self.base = self.base.children[0]
            self.base.parent = None
            done += self.base.edits
        return done

    def finish(self) -> list[tuple]:
        """The edits still open, on the cheapest way to a complete form."""
        state, cost, rank, letters, node, inserted = min(
            (way for way in self._with_inserts() if way[0] in COMPLETE), key=lambda way: way[1:4]
        )
        done = [*map(_inserted, inserted)][::-1]
        while node is not self.base:
            done += node.edits[::-1]
            node = node.parent
        return done[::-1]


def _inserted(initial: str) -> tuple:
    return "I", ROLES[initial], "", INSERT, None


def key_text(conv_id: Column, turn: Column) -> Column:
    """``conv_id:turn``, a null as one space."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.concat(part(conv_id), F.lit(":"), part(turn))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults planted by the crc32 of their key, modulo 20.

    0 drops a row (it stays with ``dropped`` set), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes
    it the user's.  A null role or text is one space.  ``copy`` tells the copies of a row apart.
    """
    fate = F.crc32(key_text(F.col("conv_id"), F.col("turn")).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fate == 0).alias("dropped"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` to rows in order of turn (nulls first): blank, duplicate, truncated or null; the first that holds.

    Rows of one turn stand by role and text.  Rows are dealt by conversation once, here, and stay so.
    """
    order = [F.col("turn").asc_nulls_first(), "copy"]
    same = W.partitionBy("conv_id", "dropped", "role", "text").orderBy(*order)
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    return rows.repartition("conv_id").select(
        "*",
        F.when(stripped == "", "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated")
        .alias("fault"),
    )


EDITS = "turn long, fault string, illegal boolean, edit string, role string, text string, cost int"


def repair(rows: DataFrame) -> DataFrame:
    """Edits of every conversation, one row each, in order: (conv_id, turn, fault, illegal, edit, role, text, cost).

    ``rows`` has (conv_id, turn, role, text, dropped, fault), as ``with_faults`` gives them.  ``edit`` is K, R, D or
    I; role and text are those of the repaired row (null if deleted), and the rows that have them are the repaired
    conversation; a row with an empty role cannot be kept as it is.  ``illegal`` says that the row's role may not follow the one before.  The cost is the least that gives role
    initials ``(s?(ua)+)?``, the edits are the least in ASCII order among those.  A conversation without rows has one row without
    edit.  Null ids are one conversation; a repeated row is a duplicate; other columns are not read.  An empty table gives none.

    Sorted inside partitions by conversation and turn, which spills; a task holds one batch, and of a conversation the rows its
    survivors disagree on.  A conversation needs its rows in order, so a very long one is one stream.
    """
    own = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "dropped", "fault")
    again = F.coalesce(F.col("fault") == "duplicate", F.lit(False))  # of equal rows, the one that is no duplicate comes first
    ordered = ordered.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", again)
    return ordered.mapInArrow(_repaired, f"conv_id {own}, {EDITS}")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    survivors = conv = schema = before = None
    had_rows = False

    def hand_on(edits: list[tuple]) -> None:
        for letter, role, text, cost, row in edits:
            out.append((conv, *(row or (None, None, None)), letter, role, text, cost))

    def close() -> None:
        if had_rows:
            hand_on(survivors.finish())
        else:
            out.append((conv, None, None, None, None, None, None, None))

    for batch in batches:
        schema = schema or _edit_schema(batch.schema.field(0).type)
        for key, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if survivors is None or key != conv:
                if survivors is not None:
                    close()
                survivors, conv, before, had_rows = Survivors(), key, None, False
            if dropped:
                continue
            had_rows = True
            illegal = before is not None and before + role[:1] not in LEGAL
            before = role[:1]
            hand_on(survivors.step(role, text, fault in ("blank", "duplicate"), fault == "truncated", (turn, fault, illegal)))
            if len(out) >= ROWS_OUT:
                yield _batch(out, schema)
                out.clear()
    if survivors is not None:
        close()
        if out:
            yield _batch(out, schema)


def _edit_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("conv_id", key), ("turn", pa.int64()), ("fault", pa.string()), ("illegal", pa.bool_()), ("edit", pa.string()),
         ("role", pa.string()), ("text", pa.string()), ("cost", pa.int32())]
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summaries(edits: DataFrame) -> DataFrame:
    """One row per conversation of the edits ``repair`` gives, which must follow it directly: counts, ``audit`` and ``repaired_sha256``.

    ``gaps`` are the turns missing between the first and the last, ``audit`` the letters of the edits, the hash that
    of the repaired rows as ``role:text`` in lines.  The edits come in order, so each conversation runs through one hash object.
    """
    own = edits.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return edits.mapInArrow(_summarised, f"conv_id {own}, {counts}, audit string, repaired_sha256 string")


class _Summary:
    def __init__(self):
        self.first = self.turn = None
        self.turns = self.illegal = self.cost = self.written = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.letters: list[str] = []
        self.digest = hashlib.sha256()

    def add(self, turn, fault, illegal, edit, role, text, cost) -> None:
        if edit is None:
            return
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if fault:
            self.faults[fault] += 1
        self.illegal += bool(illegal)
        self.cost += cost
        self.letters.append(edit)
        if edit != "D":
            self.digest.update(("\n" * (self.written > 0) + f"{role}:{text}").encode())
            self.written += 1

    def row(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest()


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv = summary = schema = None
    for batch in batches:
        key = batch.schema.field(0)
        schema = schema or pa.schema(
            [("conv_id", key.type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
        )
        done = []
        for own, *edit in zip(*(c.to_pylist() for c in batch.columns)):
            if summary is None or own != conv:
                if summary is not None:
                    done.append((conv, *summary.row()))
                conv, summary = own, _Summary()
            summary.add(*edit)
        if done:
            yield _batch(done, schema)
    if summary is not None:
        yield _batch([(conv, *summary.row())], schema)
