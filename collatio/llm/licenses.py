"""License scans: phrases in place, and an exact set-similarity join of text blocks with templates.

Templates and blocks become sets of template words in one global order, rarest in the corpus first. A
block that holds at least `threshold` of a template's words must hold one of the template's first few
(prefix filter), have enough words (length filter) and leave room for them behind and before the place
where both meet (positional filter); what passes is counted exactly. Then a window of the block little
longer than the template must hold as much of it, and the words that name the licence in their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .native import let, non_empty

#: Separators of words; A-Z are word characters here, as letters are lower-cased besides.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices by which texts state their licence. Label, notice, the words that name the licence (each stands
#: at most one other word behind the one before), and words that near these mean another licence.
NOTICES = (
    ("mit", "released under the mit license", "mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated documentation", ""),
    ("apache", "licensed under the apache license version 2 0", "apache license", ""),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license", "lesser library affero"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license", "lesser library affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "binary forms", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "by nc", "sa nd"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution", "noncommercial sharealike noderivatives noderivs"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software", ""),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation", ""),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license", ""),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license", ""),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "by nc sa", ""),
    ("cc-by-sa", "licensed under cc by sa 4 0", "by sa", "nc"),
    ("cc-by", "licensed under cc by 4 0", "cc by", "nc sa nd"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial", "sharealike noderivatives noderivs"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike", "noncommercial"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "noncommercial sharealike", ""),
    ("cc0", "licensed under cc0 1 0 universal public domain dedication", "cc0 1 0", ""),
)
TEMPLATES = tuple((label, notice) for label, notice, _, _ in NOTICES)
#: Words of a window between an excluded one and the last that names the licence.
NEAR = 3
#: What a window may be longer than the template: a share of its words, and so many words at least.
SLACK, LEAST_SLACK = 0.25, 4


def room(notice: str) -> int:
    """Words of a window."""
    n = len(notice.split())
    return n + max(LEAST_SLACK, math.ceil(SLACK * n))


WIDEST = max(room(t) for _, t in TEMPLATES)
VOCABULARY = tuple(sorted({w for _, notice, names, other in NOTICES for w in f"{notice} {names} {other}".split()}))
#: A word of each notice without which no window names its licence ("by" is in most texts).
ANCHORS = tuple(sorted({max(names.split(), key=lambda w: (w != "by", len(w))) for _, _, names, _ in NOTICES}))


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. The one other capital that lower-cases to an ASCII letter is kept out."""
    return non_empty(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("�"))), SEPARATORS))


def phrase_columns(words: Column) -> list[Column]:
    """`n_base`, `first_word`, `last_word` and `base` (labels) of the phrases in a list of words."""
    pattern = f"(?<= )({'|'.join(p for p, _ in PHRASES)})(?= )"
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    labels = F.create_map(*(F.lit(x) for pair in PHRASES for x in pair))

    def of(joined: Column) -> Column:
        def both(found: Column, gaps: Column) -> Column:
            first = spaces(F.get(gaps, F.lit(0))) - 1
            last = F.size(words) - (spaces(F.element_at(gaps, -1)) - 1) - spaces(F.element_at(found, -1)) - 1
            return F.struct(F.size(found).cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"), F.array_sort(F.array_distinct(F.transform(found, lambda p: F.element_at(labels, p)))).alias("labels"))

        return F.when(joined.rlike(pattern), let(F.regexp_extract_all(joined, F.lit(pattern), 1), lambda m: let(F.split(joined, pattern, -1), lambda g: both(m, g))))

    found = F.when(F.array_contains(words, "license"), let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), of))
    return [F.coalesce(found["n"], F.lit(0).cast("long")).alias("n_base"), found["first"].alias("first_word"), found["last"].alias("last_word"), F.coalesce(found["labels"], F.array().cast("array<string>")).alias("base")]


def template_matches(blocks: DataFrame, threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Every pair of a block (`row`, `block`, `tokens`: its distinct template words) and a template of which
    it holds at least `threshold` of the words: `row`, `block`, `label`, `template` and `score`.

    What reaches the driver and what is broadcast are the templates and one count for each of their words.
    """
    spark = blocks.sparkSession
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counts = dict(blocks.select(F.explode("tokens").alias("w")).groupBy("w").count().collect())
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    sets = [sorted(order[w] for w in set(t.split())) for _, t in templates]
    need = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    prefixes = [(s[at], k, at, len(s), need[k]) for k, s in enumerate(sets) for at in range(len(s) - need[k] + 1)]
    prefix = F.broadcast(spark.createDataFrame(prefixes, "rank int, template int, at int, size int, need int"))
    ranks = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    tokens = F.array(*(F.array(*map(F.lit, s)) for s in sets))
    names = F.array(*(F.lit(name) for name, _ in templates))
    own = blocks.select("row", "block", F.sort_array(F.array_compact(F.transform("tokens", lambda w: F.element_at(ranks, w)))).alias("own"))
    firsts = F.array(*(F.lit(r) for r in sorted({p[0] for p in prefixes})))
    own = own.filter((F.size("own") >= min(need)) & F.arrays_overlap("own", firsts))
    pairs = own.select("row", "block", "own", F.posexplode("own").alias("place", "rank")).join(prefix, "rank")
    behind = F.least(F.col("size") - F.col("at"), F.size("own") - F.col("place"))
    pairs = pairs.filter((F.size("own") >= F.col("need")) & (behind + F.least("at", "place") >= F.col("need")))
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("own", F.get(tokens, F.col("template"))))).filter("overlap >= need")
    return pairs.select("row", "block", F.get(names, F.col("template")).alias("label"), "template", (F.col("overlap") / F.col("size")).alias("score")).distinct()


def near_anchors(words: Column) -> Column:
    """The parts of a list of words in which a window can name a licence: `own`, structs of word `w` and place `p`, template
    words alone, and `till`, the place before which a window must begin to be whole.

    Words are dealt to cells of `WIDEST`; a cell with an anchor gives a part of itself and its neighbours,
    so each window around an anchor is whole in one, and all parts are at most three times the text. A window that begins
    in the last cell may be cut before a word that speaks against it; where it has an anchor, the next part has it whole.
    """

    def parts(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, k: F.when(w.isin(*ANCHORS), k)), lambda k: k.isNotNull())
        cells = F.array_distinct(F.transform(at, lambda k: (k / WIDEST).cast("int")))

        def part(c: Column) -> Column:
            begin = F.greatest((c - 1) * WIDEST, F.lit(0))
            own = F.slice(words, begin + 1, (c + 2) * WIDEST - begin)
            placed = F.filter(F.transform(own, lambda w, k: F.struct(w.alias("w"), (k + begin).alias("p"))), lambda x: x["w"].isin(*VOCABULARY))
            return F.struct(((c + 1) * WIDEST).alias("till"), placed.alias("own"))

        return F.transform(cells, part)

    none = F.array().cast("array<struct<till:int,own:array<struct<w:string,p:int>>>>")
    return let(words, lambda words: F.when(F.arrays_overlap(words, F.array(*map(F.lit, ANCHORS))), parts(words)).otherwise(none))


def window_score(own: Column, till: Column, template: Column, threshold: float) -> Column:
    """The largest share of a template's words in a window of a block (structs of word `w` and place `p`)
    that begins before `till` and names the licence; 0 if it is under `threshold`."""
    per = lambda of: F.get(F.array(*(of(*notice) for notice in NOTICES)), template)
    listed = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    words = per(lambda _, t, names, other: listed(sorted(set(t.split()))))
    names = per(lambda _, t, names, other: listed(names.split()))
    others = per(lambda _, t, names, other: listed(other.split()))
    length = per(lambda _, t, names, other: F.lit(room(t)))
    need = per(lambda _, t, names, other: F.lit(math.ceil(threshold * len(set(t.split())) - 1e-9)))

    def named(window: Column) -> Column:
        def step(acc: Column, name: Column) -> Column:
            at = F.transform(F.filter(window, lambda x: x["w"] == name), lambda x: x["p"])
            return F.when(acc.isNull(), at).otherwise(F.filter(at, lambda p: F.exists(acc, lambda q: (p > q) & (p <= q + 2))))

        against = F.transform(F.filter(window, lambda x: F.array_contains(others, x["w"])), lambda x: x["p"])
        last = lambda acc: F.filter(acc, lambda p: ~F.exists(against, lambda q: F.abs(p - q) <= NEAR))
        return F.aggregate(names, F.lit(None).cast("array<int>"), step, lambda acc: F.size(last(acc)) > 0)

    def score(window: Column) -> Column:
        found = F.size(F.array_distinct(F.filter(F.transform(window, lambda x: x["w"]), lambda w: F.array_contains(words, w))))
        return F.when(found >= need, F.when(named(window), found / F.size(words))).otherwise(0.0)

    def of(seq: Column) -> Column:
        window = lambda x, k: F.filter(F.slice(seq, k + 1, length), lambda y: y["p"] < x["p"] + length)
        return F.array_max(F.transform(seq, lambda x, k: F.when((x["p"] < till) & F.array_contains(words, x["w"]), let(window(x, k), score))))

    return F.coalesce(let(F.filter(own, lambda x: F.array_contains(words, x["w"]) | F.array_contains(others, x["w"])), of), F.lit(0.0))


def scan(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of phrases, labels of phrases and of templates, best score.

    Text blocks are runs of lines without a blank line between them. `score` is 1 where a phrase stands,
    else the largest share of a template's words that a window of a block holds, if any reaches `threshold`
    and names the licence, else 0.
    Null texts have no words. Repeated rows are scanned each. An empty table gives no rows; a very long text is
    scanned whole, in parts around the words that name a licence. Of scores that tie, one stands. Other
    columns are left out, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("__text"), words_of(text).alias("__words"))
    blank = r"\n[\x20\x09\x0B-\x0D]*\n"
    blocks = F.flatten(F.transform(F.split("__text", blank), lambda b: near_anchors(words_of(b))))
    blocks = F.when(F.col("__text").rlike(blank), blocks).otherwise(near_anchors(F.col("__words")))
    rows = rows.select(id_col, F.monotonically_increasing_id().alias("__row"), F.size("__words").cast("long").alias("n_words"), *phrase_columns(F.col("__words")), blocks.alias("__blocks"))
    rows = written(rows, "licenses")
    each = rows.select(F.col("__row").alias("row"), F.posexplode("__blocks").alias("block", "part")).select("row", "block", "part.own", "part.till")
    found = template_matches(each.select("row", "block", F.array_distinct(F.transform("own", lambda x: x["w"])).alias("tokens")), threshold)
    found = found.select("row", "block", "label", "template").join(each, ["row", "block"]).withColumn("score", window_score(F.col("own"), F.col("till"), F.col("template"), threshold)).filter("score > 0")
    found = found.groupBy(F.col("row").alias("__row")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    base, more = F.col("base"), F.coalesce("more", F.array().cast("array<string>"))
    return rows.join(found, "__row", "left").select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
