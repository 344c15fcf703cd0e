"""Line-first quality rules: lines that fail go, then documents that lost too much of their text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded
from .native import code_points, let, non_empty

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Phrases of lines that sites repeat, in four languages.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "accept all cookies", "cookie policy", "we use cookies", "enable javascript", "privacy policy", "terms of use", "terms of service", "click here", "read more", "sign up", "subscribe to", "log in to", "share on", "lorem ipsum",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "mentions légales", "cliquez ici", "lire la suite", "partager sur",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "jetzt abonnieren", "teilen auf",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "haga clic aquí", "leer más", "compartir en",
)
#: Marks that menus put between their entries.
BARS = ("|", "»", "›", "·", "•")
#: What parts the words of phrases, and the phrases with their words parted by two spaces, so that neighbours share none.
_BETWEEN = r"[^\p{L}\p{N}]+"
_PHRASES = "|".join(f" {p.replace(' ', '  ')} " for p in BOILERPLATE)
#: A cheap look that lines with a phrase pass: the phrases by their first letters, white space of any kind between words.
_FIRST = {c: [p[1:].replace(" ", _BETWEEN) for p in BOILERPLATE if p[0] == c] for c in sorted({p[0] for p in BOILERPLATE})}
_LOOK = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in _FIRST.items())


@dataclass(frozen=True)
class Rules:
    """Thresholds: shares of a line's words or characters, and of a document's."""

    min_words: int = 20
    window: int = 8
    max_repeated_percent: int = 30
    max_bars: float = 0.15
    max_symbols: float = 0.1
    max_shouts: float = 0.3
    unpunctuated_words: int = 15
    max_stutter: float = 0.3
    max_boilerplate: float = 0.3
    max_lost: float = 0.5


def word_list(text: Column) -> Column:
    return non_empty(F.split(text, SPACES))


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of `window` words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        def repeats(order: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
            return F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1))

        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = F.sort_array(F.transform(let(order, repeats), lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        counted = F.aggregate(places, none, lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(counted)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, window))))
    return F.when(F.size(words) > window, let(windows, covered)).otherwise(0).cast("long")


def boilerplate(line: Column, n: Column, rules: Rules) -> Column:
    """Whether phrases make up too much of a line of `n` words; they count between word boundaries only."""

    def share(low: Column) -> Column:
        parted = F.concat(F.lit("  "), F.regexp_replace(low, _BETWEEN, "  "), F.lit("  "))
        found = F.array_join(F.regexp_extract_all(parted, F.lit(_PHRASES), 0), "")
        return F.size(non_empty(F.split(found, " "))) > rules.max_boilerplate * n

    low = F.lower(line)
    return F.when(low.rlike(_LOOK), share(low)).otherwise(False)


def line_fails(line: Column, rules: Rules) -> Column:
    """Navigation (bars between words), punctuation (symbols, shouts, long lines with none), words said over and over, and boilerplate."""

    def of(words: Column) -> Column:
        n, chars = F.size(words), code_points(words)
        bars = F.size(F.filter(words, lambda w: w.isin(*BARS)))
        symbols = chars - F.length(F.regexp_replace(line, f"{SYMBOLS}|{SPACES}", ""))
        shouts = F.size(F.filter(words, lambda w: w.endswith("!!")))
        again = F.size(F.filter(words, lambda w, k: w == F.get(words, k - 1)))
        return (bars > rules.max_bars * n) | (symbols > rules.max_symbols * chars) | (shouts > rules.max_shouts * n) | ((n >= rules.unpunctuated_words) & ~line.rlike("[.,;:!?]")) | (again > rules.max_stutter * n) | boilerplate(line, n, rules)

    return let(word_list(line), of)


def assess(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with the base figures, `clean_text` (the text without the lines that fail; blank lines stay),
    `lost` (share of the text's characters in lines that go), `base_failed` and `kept`; `prefix` goes before each name.

    Everything is computed within a row, without a shuffle, and once: the figures come out of a generator,
    behind which filters of the caller stay. A null text counts as empty: no words, and so not kept. Texts of
    any length are judged whole. Repeated rows are judged alike; an empty table gives no rows. Columns of
    `docs` stay as they are, whatever their names; one whose name clashes with a figure is replaced unless
    `prefix` sets the figures apart.
    """
    own, names, _ = shielded(docs)
    text = F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))
    own = own.withColumn("words", word_list(text)).withColumn("all_lines", F.split(text, "\n"))
    own = own.withColumn("good", F.filter("all_lines", lambda x: ~x.rlike(WORD) | ~line_fails(x, rules)))
    lines = F.filter("all_lines", lambda x: x.rlike(WORD))
    figures = {
        "n_words": F.size("words").cast("long"),
        "word_chars": code_points(F.col("words")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("words"), rules.window),
        "clean_text": F.array_join("good", "\n"),
        "lost": 1 - F.length(F.regexp_replace(F.array_join("good", ""), SPACES, "")) / F.greatest(code_points(F.col("words")), F.lit(1)),
    }
    own = own.withColumns(figures)
    own = own.select(*names.values(), F.inline(F.array(F.struct(*figures))))
    own = own.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeated_percent * F.col("n_words")))
    own = own.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= rules.max_lost))
    told = [*figures, "base_failed", "kept"]
    return own.select(*(F.col(names[c]).alias(c) for c in docs.columns if c not in {f"{prefix}{f}" for f in told}), *(F.col(f).alias(f"{prefix}{f}") for f in told))


def cleaned(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """`docs` without the documents that the rules reject, and without failed lines in the others.

    Columns stay, whatever their names; the cases are those of `assess`.
    """
    own, names, back = shielded(docs)
    judged = assess(own, rules, names[text_col]).filter("kept")
    return back(judged.withColumn(names[text_col], F.col("clean_text")))


#: The query's rows in DuckDB SQL. re_ and lines: a text's words and lines; rep: words inside repeated windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM many) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM w),
lw AS (SELECT doc_id, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
lf AS (SELECT doc_id, length(array_to_string(ws, '')) AS chars,
  len(list_filter(ws, lambda x: list_contains([{bars}], x))) > 0.15 * len(ws)
  OR length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > 0.1 * length(array_to_string(ws, ''))
  OR len(list_filter(ws, lambda x: suffix(x, '!!'))) > 0.3 * len(ws)
  OR (len(ws) >= 15 AND NOT regexp_matches(line, '[.,;:!?]'))
  OR len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) > 0.3 * len(ws)
  OR len(list_filter(string_split(array_to_string(regexp_extract_all('  ' || regexp_replace(lower(line), '{between}', '  ', 'g') || '  ', '{phrases}'), ''), ' '), lambda x: x <> '')) > 0.3 * len(ws) AS fails FROM lw),
lost AS (SELECT doc_id, coalesce(sum(chars) FILTER (WHERE fails), 0) AS gone FROM lf GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(gone, 0) AS gone
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND gone / greatest(word_chars, 1) <= 0.5 AS kept FROM b
""".replace("{bars}", ", ".join(f"'{b}'" for b in BARS)).replace("{between}", _BETWEEN).replace("{phrases}", _PHRASES)
