"""Repair of the structure of conversations by the cheapest edits, found once for every shared prefix of signatures.

A conversation's signature has a letter a turn, from the turn's role and fault. Signatures are sorted over
the whole table; a task walks its share as a prefix tree, keeps the layers of the dynamic program of the
path it stands on, and goes on from where the next signature parts from the last. Equal signatures share an
answer. What is held is a letter and a layer for each turn of one conversation; texts never meet but in the
running hash of their conversation, and pass through in order.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, small_batches, written

#: Roles by initial (the last stands for all others), and faults; a letter is 'a' + 4 * fault + role.
ROLES, FAULTS = "sua", ("none", "truncated", "blank", "duplicate")
#: Costs of the edits, and of a truncated turn that stays. Fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Pairs of initials that may follow each other.
NEXT = frozenset({"su", "ua", "au"})
_LEGAL = frozenset((ROLES.index(a), ROLES.index(b)) for a, b in NEXT)
#: States: nothing yet, behind a system turn, behind a user's, behind an assistant's. A turn of these roles leads from a state to another.
START, SYSTEM, USER, ASSISTANT = range(4)
_STEPS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: What an inserted or renamed turn is in each state.
_GIVEN = {s: (role, to) for (s, role), to in _STEPS.items() if role}
_FAR = 1 << 60


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with known faults, by the checksum of conversation and turn: dropped, emptied, without ends of sentences, twice, or a user's. Nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(part(conv), F.lit(":"), part(turn)), "UTF-8")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), part(role).alias("role"), part(text).alias("text"), kind.alias("kind")).filter("kind <> 0")
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.explode(copies).alias("copy")).drop("copy")


class Tree:
    """The dynamic program along a path of the prefix tree.

    A layer holds, for each state, the least cost of getting there with the path's turns done and any turns inserted
    behind them. Edits of equal cost are told apart when an answer is traced.
    """

    def __init__(self):
        self.path, self.layers, self.shared = "", array("q", self._closed([0, _FAR, _FAR, _FAR])), 0

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        for _ in range(2):  # two insertions lead from any state to any that has a way
            for state, (_, to) in _GIVEN.items():
                costs[to] = min(costs[to], costs[state] + INSERT)
        return costs

    @staticmethod
    def edits(letter: str, state: int) -> list[tuple[str, int, int]]:
        """Edits of a turn in a state: name, cost and the state behind."""
        fault, role = divmod(ord(letter) - 97, 4)
        out = [("D", DELETE, state)]
        if fault < 2:
            extra = TRUNCATED * fault
            if (state, role) in _STEPS:
                out.append(("K", extra, _STEPS[state, role]))
            out.append(("R", REROLE + extra, _GIVEN[state][1]))
        return out

    def _layer(self, k: int) -> list[int]:
        return self.layers[4 * k : 4 * k + 4].tolist()

    def extend(self, signature: str) -> None:
        """Moves to a signature: layers of the common prefix stay."""
        common = 0
        for x, y in zip(self.path, signature):
            if x != y:
                break
            common += 1
        del self.layers[4 * (common + 1) :]
        for letter in signature[common:]:
            costs, found = self._layer(len(self.layers) // 4 - 1), [_FAR] * 4
            for state, cost in enumerate(costs):
                if cost < _FAR:
                    for _, price, to in self.edits(letter, state):
                        found[to] = min(found[to], cost + price)
            self.layers.extend(self._closed(found))
        self.path, self.shared = signature, self.shared + common

    def answer(self) -> tuple[int, str]:
        """Least cost of the path's edits, and of those that have it the first in order of letters.

        A step is on a cheapest way if it makes up the difference of its ends' costs. States from which such steps lead
        to the end are marked from there; then the least letter that stays on marked states is taken, step by step.
        """
        n, last = len(self.path), self._layer(len(self.path))
        best = min(last[START], last[ASSISTANT])
        marks, behind, costs_behind = bytearray(n + 1), 0, []
        for k in range(n, -1, -1):
            costs, own = self._layer(k), 0
            for state, cost in enumerate(costs):
                if cost < _FAR and (cost == best and state in (START, ASSISTANT) if k == n else any(behind >> to & 1 and cost + price == costs_behind[to] for _, price, to in self.edits(self.path[k], state))):
                    own |= 1 << state
            for _ in range(2):
                for state, (_, to) in _GIVEN.items():
                    if own >> to & 1 and costs[state] + INSERT == costs[to]:
                        own |= 1 << state
            marks[k], behind, costs_behind = own, own, costs
        out, state, k = [], START, 0
        while True:
            costs = self._layer(k)
            steps = [("I", k, to) for to in (_GIVEN[state][1],) if marks[k] >> to & 1 and costs[state] + INSERT == costs[to]]
            if k < n:
                after = self._layer(k + 1)
                steps += [(name, k + 1, to) for name, price, to in self.edits(self.path[k], state) if marks[k + 1] >> to & 1 and costs[state] + price == after[to]]
            if not steps:
                return best, "".join(out)
            name, k, state = min(steps)
            out.append(name)


def counted(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and neighbours that may not follow each other."""
    faults = [(ord(x) - 97) // 4 for x in signature]
    roles = [(ord(x) - 97) % 4 for x in signature]
    return faults.count(2), faults.count(3), faults.count(1), sum(p not in _LEGAL for p in zip(roles, roles[1:], strict=False))


class Script:
    """Carries out a conversation's edits, a letter each, as its turns pass: gives (edit, role, text) of the turns that stay or come in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _given(self) -> str:
        role, self.state = _GIVEN[self.state]
        return ("system", "user", "assistant")[role]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._given(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _STEPS[self.state, ROLES.index(role[0])]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._given(), text


def _told(turns: DataFrame) -> DataFrame:
    """Turns (`conv`, `turn`, `role`, `text`) with a 128-bit hash of the text, null roles and texts as one space."""
    rows = turns.select("conv", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.withColumn("h", F.md5(F.encode("text", "UTF-8")))


def _in_order(*first: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv", *first, "turn", "role", "h")]


def signatures(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Of each conversation of `convs` (`conv`): its turns' letters in order as `signature`, and `gaps`, the numbers missing between its turns.

    Turns that are alike are counted before any shuffle of them. Letters are put together by ranges of
    conversation and turn, so a long conversation's are several tasks' work.
    """
    rows = _told(turns)
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    role = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    fault = F.when(body == "", 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    alike = rows.select("conv", "turn", "role", "h", role.alias("r"), fault.alias("f")).groupBy("conv", "turn", "role", "h").agg(F.count(F.lit(1)).cast("int").alias("n"), F.first("r").alias("r"), F.first("f").alias("f"))
    seen = F.row_number().over(Window.partitionBy("conv", "role", "h").orderBy(F.col("turn").asc_nulls_first())) > 1
    letter = lambda f: F.char(97 + 4 * f + F.col("r"))
    later = letter(F.when(F.col("f") == 2, 2).otherwise(3))
    letters = F.when(F.col("seen"), F.repeat(later, F.col("n"))).otherwise(F.concat(letter(F.col("f")), F.repeat(later, F.col("n") - 1)))
    own = alike.withColumn("seen", seen).select("conv", "turn", "role", "h", letters.alias("letters"))
    own = own.repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order()).select("conv", "letters")
    kind = turns.schema["conv"].dataType
    out = T.StructType([T.StructField("conv", kind), T.StructField("part", T.LongType()), T.StructField("letters", T.StringType())])

    def joined(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        for batch in batches(batches_):
            keys, texts, parts = [], [], []
            for key, some in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), lambda x: x[0]):
                keys.append(key), texts.append("".join(x[1] for x in some)), parts.append(part)
                part += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(parts, pa.int64()), pa.array(texts, pa.string())], names=out.names)

    numbers = alike.select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    union = own.mapInArrow(joined, out).unionByName(numbers, True).unionByName(convs.select("conv").distinct(), True)
    parts = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "letters"))))
    return union.groupBy("conv").agg(F.array_join(F.transform(parts, lambda x: x["letters"]), "").alias("signature"), F.coalesce(F.max("gaps"), F.lit(0)).alias("gaps"))


_FIGURES = ("blank", "duplicate", "truncated", "illegal", "cost")


def plans(found: DataFrame) -> DataFrame:
    """`signatures` with the counts of faults, `illegal` neighbours, and the cheapest edits: `cost` and `audit`, a letter each."""
    own = found.select("signature", "conv", "gaps").repartitionByRange("signature", F.col("conv").asc_nulls_first()).sortWithinPartitions("signature")
    out = T.StructType([T.StructField("conv", found.schema["conv"].dataType), *(T.StructField(n, T.LongType()) for n in ("gaps", *_FIGURES)), T.StructField("audit", T.StringType())])

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, last, answer = Tree(), None, ()
        for batch in batches(rows):
            answers = []
            for signature in batch.column(0).to_pylist():
                if signature != last:
                    tree.extend(signature)
                    last, answer = signature, (*counted(signature), *tree.answer())
                answers.append(answer)
            columns = [pa.array([a[k] for a in answers], pa.int64() if k < len(_FIGURES) else pa.string()) for k in range(len(_FIGURES) + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *columns], names=out.names)

    return own.mapInArrow(work, out)


def _passing(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan, then its turns in order, as one sorted stream a task."""
    rows = _told(turns).withColumn("kind", F.lit(1)).unionByName(planned.withColumn("kind", F.lit(0)), True)
    return rows.repartition("conv").sortWithinPartitions(*_in_order("kind")).select("conv", "kind", "role", "text", "audit", "gaps", *_FIGURES)


def repaired(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired conversations: `conv`, `place` (from 0), `edit` (K kept, R with another role, I put in), `role`, `text`."""
    out = T.StructType([T.StructField("conv", turns.schema["conv"].dataType), T.StructField("place", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("edit", "role", "text"))])

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, conv, place = None, None, 0
        for batch in batches(rows):
            found = []

            def add(turns_: Iterator[tuple[str, str, str]], found: list = found) -> None:
                nonlocal place
                for turn in turns_:
                    found.append((conv, place, *turn))
                    place += 1

            for key, kind, role, text, audit in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if kind == 0:
                    if script:
                        add(script.inserted())
                    script, conv, place = Script(audit), key, 0
                else:
                    add(script.turn(role, text))
            yield _frame(found, out, batch.schema.field(0).type)
        if script:
            last = [(conv, place + k, *turn) for k, turn in enumerate(script.inserted())]
            yield _frame(last, out, batch.schema.field(0).type)

    small_batches(turns.sparkSession)
    return _passing(turns, planned).mapInArrow(work, out)


def _frame(rows: list[tuple], schema: T.StructType, key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, *(pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema.fields[1:])]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=schema.names)


def digests(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """`planned` with `repaired_sha256`, of the repaired turns as `role:text` lines. A conversation's turns pass one task in order, as a hash needs."""
    out = T.StructType([*planned.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    names = planned.columns

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, told, digest, first = None, None, None, True

        def add(turns_: Iterator[tuple[str, str, str]]) -> None:
            nonlocal first
            for _, role, text in turns_:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        for batch in batches(rows):
            found = []
            plan = [batch.column(n).to_pylist() for n in names]
            for k, (kind, role, text) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("kind", "role", "text")), strict=True)):
                if kind == 0:
                    if script:
                        add(script.inserted())
                        found.append((*told, digest.hexdigest()))
                    told = tuple(column[k] for column in plan)
                    script, digest, first = Script(told[names.index("audit")]), hashlib.sha256(), True
                else:
                    add(script.turn(role, text))
            yield _frame(found, out, batch.schema.field(0).type)
        if script:
            add(script.inserted())
            yield _frame([(*told, digest.hexdigest())], out, batch.schema.field(0).type)

    small_batches(turns.sparkSession)
    return _passing(turns, planned).mapInArrow(work, out)


def repair(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """Diagnoses and repairs conversations (`conv`, `turn`, `role`, `text`); one row a conversation of `convs`, by default those with turns.

    Turns are taken by number, nulls first, then by role and text. Null roles and texts are one space; a
    null conversation is one of its own; repeated turns are duplicates. A conversation without turns has
    zeros, an empty audit and the hash of nothing. An empty table gives no rows. Long texts pass whole;
    of a long conversation a task holds its letters and costs, never its texts. Other columns are left
    out, whatever their names.
    """
    found = written(signatures(turns, turns if convs is None else convs), "signatures")
    return digests(turns, written(plans(found), "plans"))
