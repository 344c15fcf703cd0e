"""Column helpers for the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once a row.

    A column used inside a lambda is otherwise computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def non_empty(parts: Column) -> Column:
    return F.array_remove(parts, "")


def code_points(parts: Column) -> Column:
    return F.length(F.array_join(parts, ""))


#: Matches that are placed in one go; more are placed in chunks, as a growing array is copied with each element.
CHUNK = 128


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value), in code points, end exclusive."""
    kind = "array<struct<start:int,end:int,value:string>>"

    def place(found: Column, gaps: Column, begin: Column) -> Column:
        """Matches behind the gaps before them, from a place on."""

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, i))
            value = F.get(found, i)
            end = start + F.length(value)
            return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(start.alias("start"), end.alias("end"), value.alias("value"))).alias("found"))

        none = F.struct(begin.alias("at"), F.array().cast(kind).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), none, step, lambda acc: acc["found"])

    def chunked(found: Column, gaps: Column) -> Column:
        part = lambda x, k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK))
        lengths = lambda x: F.length(F.array_join(x, ""))
        numbers = F.sequence(F.lit(0), ((F.size(found) - 1) / CHUNK).cast("int"))

        def step(acc: Column, k: Column) -> Column:
            return F.struct((acc["at"] + lengths(part(found, k)) + lengths(part(gaps, k))).alias("at"), F.array_append(acc["begins"], acc["at"]).alias("begins"))

        begins = F.aggregate(numbers, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")), step, lambda acc: acc["begins"])
        return F.flatten(F.transform(begins, lambda begin, k: place(part(found, k), part(gaps, k), begin)))

    def placed(found: Column, gaps: Column) -> Column:
        return F.when(F.size(found) <= CHUNK, place(found, gaps, F.lit(0))).otherwise(chunked(found, gaps))

    found = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: let(F.split(text, pattern, -1), lambda gaps: placed(m, gaps)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """`text` with each of the spans (structs with `start` and `end` in code points, by start) replaced by `mark`; spans that overlap or touch inside of one another as one.

    Spans are merged by the largest end before each, and the text is cut at every `CHUNK` of them first, as finding a
    place in a text takes as long as what lies before it.
    """
    part = lambda x, k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK))
    chunks = lambda x: F.sequence(F.lit(0), ((F.size(x) - 1) / CHUNK).cast("int"))

    def merged(spans: Column, ends: Column, tops: Column) -> Column:
        """Spans as `start` and `end` without overlaps; tops: the largest end of each chunk and those before it."""
        in_chunk = lambda k: F.slice(ends, (k / CHUNK).cast("int") * CHUNK + 1, k % CHUNK)
        before = lambda k: F.greatest(F.get(tops, (k / CHUNK).cast("int") - 1), F.array_max(in_chunk(k)), F.lit(0))
        firsts = F.filter(F.transform(spans, lambda x, k: F.struct(x["start"].alias("start"), before(k).alias("before"))), lambda x: (x["start"] >= x["before"]))
        last = F.element_at(tops, -1)
        return let(firsts, lambda f: F.transform(f, lambda x, k: F.struct(x["start"].alias("start"), F.coalesce(F.get(f, k + 1)["before"], last).alias("end"))))

    def rewritten(found: Column) -> Column:
        def chunk(k: Column) -> Column:
            base = F.when(k == 0, 0).otherwise(F.get(found, k * CHUNK)["start"])
            till = F.coalesce(F.get(found, (k + 1) * CHUNK)["start"], F.length(text))
            return let(F.struct(base.alias("base"), F.substring(text, base + 1, till - base).alias("text")), lambda cut: pieces(cut, part(found, k)))

        return F.array_join(F.transform(chunks(found), chunk), "")

    def pieces(cut: Column, own: Column) -> Column:
        behind = lambda k: F.coalesce(F.when(k > 0, F.get(own, k - 1)["end"]), cut["base"])
        gap = lambda x, k: F.substring(cut["text"], behind(k) - cut["base"] + 1, x["start"] - behind(k))
        rest = F.substring(cut["text"], F.element_at(own, -1)["end"] - cut["base"] + 1, F.length(cut["text"]))
        return let(own, lambda own_: F.concat(F.array_join(F.transform(own_, lambda x, k: F.concat(gap(x, k), F.lit(mark))), ""), rest))

    def of(spans: Column) -> Column:
        ends = F.transform(spans, lambda x: x["end"])
        tops = lambda ends: F.transform(chunks(ends), lambda k: F.array_max(part(ends, k)))
        running = lambda tops: F.transform(tops, lambda x, k: F.array_max(F.slice(tops, 1, k + 1)))
        return let(ends, lambda ends_: let(tops(ends_), lambda t: let(running(t), lambda r: let(merged(spans, ends_, r), rewritten))))

    return F.when(F.size(spans) > 0, let(spans, of)).otherwise(text)
