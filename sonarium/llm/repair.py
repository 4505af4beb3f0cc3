"""Repair of conversation structure at least cost, by layers of bitsets.

What a conversation may still need is kept, for each place between its turns, as a word of sixteen layers: layer c has a bit
for each grammar state from which the rest can be brought to an accepted end at a cost of exactly base + c. A word follows
from the one after the turn by shifts alone, as in matching with errors: a turn that stays moves bits between states of a layer,
a new role moves them three layers up, a deletion four. The lowest layer that has the start state gives the cost, and the
bits lead forward to the least of the cheapest audits.

Sixteen layers are enough: from any state any other's rest can be had for ten more at most (two insertions, and the deletion of
one system turn), so the four states' least costs at a place differ by ten at most, and each step adds four at most to each.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from tempfile import SpooledTemporaryFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.llm.arrow import map_rows
from sonarium.llm.storage import partitions

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = "blank", "duplicate", "truncated"
#: What counts as blank.
SPACES = " \t\n\x0b\x0c\r"

#: Grammar states: nothing said, a system turn said, a user's turn said, an assistant's turn said. The first and the last accept.
START, SYSTEM, USER, ASSISTANT = range(4)
_FIRST, _WORD = 0x1111111111111111, (1 << 64) - 1
#: (state, initial) -> state
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_SAID = {"u": "user", "a": "assistant"}

#: Bytes of a conversation's texts that a task holds in memory; more go to a file of its own until the conversation is done.
HOLD_BYTES = 16 << 20


def _before(word: int, initial: str) -> int:
    """The states from which a turn leads to a state in the word, layer by layer."""
    if initial == "u":
        after = word >> USER & _FIRST
        return after | after << SYSTEM | after << ASSISTANT
    if initial == "a":
        return (word >> ASSISTANT & _FIRST) << USER
    return word >> SYSTEM & _FIRST if initial == "s" else 0


def _with_insertions(word: int) -> int:
    for _ in range(2):  # a third one in a row would lead back to where two begin
        word |= (_before(word, "u") | _before(word, "a")) << 4 * INSERT
    return word & _WORD


def cost_layers(initials: str, faults: list[int]) -> tuple[array, array]:
    """A word of layers, and its base, for each place between turns. faults: 0 none, 1 blank or duplicate, 2 truncated."""
    words, bases = array("Q", bytes(8 * (len(initials) + 1))), array("q", bytes(8 * (len(initials) + 1)))
    word, base = _with_insertions(1 << START | 1 << ASSISTANT), 0
    words[-1] = word
    for i in range(len(initials) - 1, -1, -1):
        made = word << 4 * DELETE
        if faults[i] != 1:
            more = 4 * TRUNCATED if faults[i] else 0
            made |= _before(word, initials[i]) << more | (_before(word, "u") | _before(word, "a")) << 4 * REROLE + more
        word = _with_insertions(made & _WORD)
        while not word & 15:
            word, base = word >> 4, base + 1
        words[i], bases[i] = word, base
    return words, bases


def least_audit(initials: str, faults: list[int]) -> tuple[int, list[tuple[str, str]]]:
    """The cost, and the edits as (initial, role initial after it; empty for a deletion): of the cheapest, the ASCII-least."""
    words, bases = cost_layers(initials, faults)

    def reaches(place: int, state: int, cost: int) -> bool:
        layer = cost - bases[place]
        return 0 <= layer < 16 and bool(words[place] >> 4 * layer + state & 1)

    cost = left = next(c for c in range(bases[0], bases[0] + 16) if reaches(0, START, c))
    at, state, edits = 0, START, []
    while at < len(initials) or left:
        options = []
        if at < len(initials):
            options.append(("D", "", DELETE, at + 1, state))
        options += [("I", x, INSERT, at, _NEXT.get((state, x))) for x in "au"]
        if at < len(initials) and faults[at] != 1:
            more = TRUNCATED if faults[at] else 0
            options.append(("K", initials[at], more, at + 1, _NEXT.get((state, initials[at]))))
            options += [("R", x, REROLE + more, at + 1, _NEXT.get((state, x))) for x in "au"]
        edit, said, spent, at, state = next(o for o in options if o[4] is not None and reaches(o[3], o[4], left - o[2]))
        left -= spent
        edits.append((edit, said))
    return cost, edits


class _Conversation:
    """Turns that have arrived: their numbers in memory, their texts there too while they are short."""

    def __init__(self, conv_id: object):
        self.conv_id, self.initials, self.faults = conv_id, [], []
        self.turns: list[int | None] = []
        self.texts = SpooledTemporaryFile(max_size=HOLD_BYTES)  # noqa: SIM115  closed by its reader
        self.sizes = array("q")

    def add(self, row: dict) -> None:
        self.turns.append(row["turn"])
        self.initials.append(row["role"][:1] or " ")
        self.faults.append(row["fault"])
        for x in (row["role"], row["text"]):
            raw = x.encode()
            self.texts.write(raw)
            self.sizes.append(len(raw))

    def edits(self) -> Iterator[tuple]:
        """A row for each edit; for a conversation without turns one row without any."""
        with self.texts as texts:
            kinds = [0 if x is None else 2 if x == TRUNCATED_FAULT else 1 for x in self.faults]
            cost, edits = least_audit("".join(self.initials), kinds)
            texts.seek(0)
            at = 0
            for step, (edit, said) in enumerate(edits):
                was = turn = fault = None
                text = ""
                if edit != "I":
                    was, text = (texts.read(self.sizes[2 * at + i]).decode() for i in (0, 1))
                    turn, fault = self.turns[at], self.faults[at]
                    at += 1
                role = was if edit == "K" else _SAID.get(said)
                yield self.conv_id, step, edit, role, text, turn, was, fault, cost
            if not edits:
                yield self.conv_id, None, None, None, None, None, None, None, 0


def flawed(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, fault in each conversation's order, a conversation in one partition.

    Turns are ordered by turn (null first), role and text. Null roles and texts are one space. fault is the first of blank
    (nothing but spaces), duplicate (role and text seen earlier) and truncated (the last character that is no space isn't one of
    .!?), or null. Rows where `there` is false only say that a conversation exists; they come last, with a null text."""
    there = F.lit(True) if there is None else there
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    held = rows.select("conv_id", F.when(there, F.col("turn").cast("long")).alias("turn"), F.when(there, role).alias("role"), F.when(there, text).alias("text"))
    held = held.repartition(partitions(rows.sparkSession), "conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", BLANK_FAULT).when(seen > 1, DUPLICATE_FAULT).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED_FAULT)
    order = [F.col("conv_id"), F.col("text").isNull(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("seen")]
    return held.withColumn("seen", seen).withColumn("fault", fault).sortWithinPartitions(*order).drop("seen")


def repaired_turns(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """The cheapest repair of each conversation (conv_id, turn, role, text), so that its roles read system? (user assistant)+, or nothing.

    A row for each edit, in order: step, edit (Keep, Rerole, Delete, Insert, by their initials), the role and the text after
    it (a deleted turn's text as it was), the input's turn, role before and fault (see flawed()), and the conversation's cost.
    A turn of a role with another initial than s, u or a cannot stay as it is. A conversation without turns has one row
    without an edit; null conv_ids are one conversation; rows alike are duplicates; an empty table gives none; columns of other names
    take no part. A conversation is read in order by one task, which holds some bytes for a turn and at most 16 MB of texts."""

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        held: _Conversation | None = None
        for row in _rows(batches):
            if held is None or held.conv_id != row["conv_id"]:
                if held is not None:
                    yield from sized(held)
                held = _Conversation(row["conv_id"])
            if row["text"] is not None:
                held.add(row)
        if held is not None:
            yield from sized(held)

    def sized(held: _Conversation) -> Iterator[tuple[tuple, int]]:
        return ((x, 128 + len(x[4] or "")) for x in held.edits())

    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, step BIGINT, edit STRING, role STRING, text STRING, turn BIGINT, role_before STRING, fault STRING, cost BIGINT"
    return map_rows(flawed(rows, there), edits, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            yield from batch.slice(i, 1024).to_pylist()


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with planted damage by crc32("conv_id:turn") % 20, a null one space: 0 marks the row as dropped (there is false),
    1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes its role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    held = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), times.alias("time")).drop("time")


class _Digest:
    """What repair_digests() says of a conversation, gathered row by row."""

    def __init__(self, conv_id: object):
        self.conv_id, self.cost, self.audit = conv_id, 0, []
        self.faults = dict.fromkeys((BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT), 0)
        self.low = self.high = self.last_turn = None
        self.distinct = self.illegal = self.kept = 0
        self.last_role: str | None = None
        self.sha = hashlib.sha256()

    def add(self, row: dict) -> None:
        if row["edit"] is None:
            return
        self.cost = row["cost"]
        self.audit.append(row["edit"])
        if row["edit"] != "I":
            if row["fault"]:
                self.faults[row["fault"]] += 1
            turn, initial = row["turn"], row["role_before"][:1]
            if turn is not None:  # turns ascend
                self.low = turn if self.low is None else self.low
                self.distinct += turn != self.high
                self.high = turn
            self.illegal += self.last_role is not None and self.last_role + initial not in ("su", "ua", "au")
            self.last_role = initial
        if row["edit"] != "D":
            self.sha.update(f"{chr(10) if self.kept else ''}{row['role']}:{row['text']}".encode())
            self.kept += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def repair_digests(edits: DataFrame) -> DataFrame:
    """One row per conversation from the rows of repaired_turns(), as they come: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple[tuple, int]]:
        held: _Digest | None = None
        for row in _rows(batches):
            if held is None or held.conv_id != row["conv_id"]:
                if held is not None:
                    yield held.row(), 256 + len(held.audit)
                held = _Digest(row["conv_id"])
            held.add(row)
        if held is not None:
            yield held.row(), 256 + len(held.audit)

    counts = ", ".join(f"{c} BIGINT" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return map_rows(edits, digests, f"conv_id {dict(edits.dtypes)['conv_id']}, {counts}, audit STRING, repaired_sha256 STRING")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """The digests of the repair of all conversations, damaged before; one whose rows are all dropped has zeros and no audit."""
    return repair_digests(repaired_turns(damaged(rows), F.col("there")))
