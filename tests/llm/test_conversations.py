"""Repair of conversations against a plain version: all edit scripts of short ones, strings kept whole of longer ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from collatio.llm import conversations

_R = random.Random(12)
SCHEMA = "conv_id long, turn long, role string, text string, signature string, kind int, conv string"
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """Least (cost, edits, roles) over all scripts: the best string for each role behind the turns so far."""
    best = {"": (0, "", ())}

    def better(found, state, value):
        if state not in found or value[:2] < found[state][:2]:
            found[state] = value

    def put_in(found):
        for _ in range(4):
            for state, (cost, edits, kept) in list(found.items()):
                new = "a" if state == "u" else "u"
                better(found, new, (cost + 3, edits + "I", (*kept, (NAMES[new], ""))))
        return found

    put_in(best)
    for role, text, fault in turns:
        found = {}
        for state, (cost, edits, kept) in best.items():
            better(found, state, (cost + 4, edits + "D", kept))
            if fault in (None, "truncated"):
                extra, new = 3 * (fault is not None), "a" if state == "u" else "u"
                better(found, new, (cost + 3 + extra, edits + "R", (*kept, (NAMES[new], text))))
                if role[:1] == new or (role[:1] == "s" and state == ""):
                    better(found, role[:1], (cost + extra, edits + "K", (*kept, (role, text))))
        best = put_in(found)
    return min(best[s][:3] for s in ("", "a") if s in best)


def plain(original):
    rows = damaged(original)
    out = []
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        turns, seen, faults = [], set(), Counter()
        for _, _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            turns.append((role, text, fault))
        numbers = {r[1] for r in own} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, kept = cheapest(turns)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return out


def conversation(conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "same.", "same.", "É. ", "tail.\t", " "]
    return [(conv, _R.choice([k, k, k, k + 1, None]), _R.choice(roles), _R.choice(texts)) for k in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = [r for k in range(60) for r in conversation(k, _R.randint(1, 9))] + conversation(None, 6)
    out += [(500, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(400)]
    out += conversation(501, 300)
    out += [(502, 3, "user", "again.")] * 50 + [(503, k, "user", "x" * 50_000 + ".") for k in range(6)]
    out += [(600 + k, t, r, f"text {k}.") for k in range(30) for t, r in enumerate(("system", "user", "assistant"))]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "c") for r in rows], SCHEMA).repartition(5)


def repaired(df):
    found = conversations.repair(conversations.damaged(df), df.select(F.col("conv_id").alias("conv")))
    return [(r.conv, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()]


def test_repair(spark, rows):
    assert Counter(repaired(frame(spark, rows))) == Counter(plain(rows))
    assert repaired(frame(spark, [])) == []


def test_parts_of_long_conversations(spark, rows):
    """Letters of one conversation that are several tasks' work come together in order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert Counter(repaired(frame(spark, rows))) == Counter(plain(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns(spark, rows):
    turns = conversations.damaged(frame(spark, rows))
    planned = conversations.plans(conversations.signatures(turns, turns))
    found = sorted(((r.conv is not None, r.conv or 0, r.place), r.edit, r.role, r.text) for r in conversations.repaired(turns, planned).collect())
    expected = {r[0]: r for r in plain(rows)}
    for conv, own in groupby(found, lambda r: r[0][:2]):
        own = list(own)
        _, _, _, _, _, _, _, audit, digest = expected[conv[1] if conv[0] else None]
        assert [r[0][2] for r in own] == list(range(len(own)))
        assert "".join(r[1] for r in own) == audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in own).encode()).hexdigest() == digest


def test_layers_are_shared():
    """Signatures in order: layers are made once for each prefix, and answers are those of a tree of their own."""
    some = sorted({"".join(_R.choices("abcdefghijklmnop", k=_R.randint(0, 12))) for _ in range(3000)})
    tree = conversations.Tree()
    for s in some:
        tree.extend(s)
        alone = conversations.Tree()
        alone.extend(s)
        assert tree.answer() == alone.answer()
        roles, faults = "suao", (None, "truncated", "blank", "duplicate")
        cost, audit, _ = cheapest([(roles[(ord(x) - 97) % 4], "t", faults[(ord(x) - 97) // 4]) for x in s])
        assert tree.answer() == (cost, audit)
    prefixes = {s[:k] for s in some for k in range(1, len(s) + 1)}
    assert sum(map(len, some)) - tree.shared == len(prefixes)
