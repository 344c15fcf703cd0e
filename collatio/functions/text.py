"""Scalar functions over text, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Phrases by which an output is taken for a refusal.
REFUSALS = ("can't provide", "cannot provide", "unable to provide", "can't quote", "cannot quote", "copyright")
WHITE = r"\p{IsWhite_Space}"
_WORD = r"[\p{IsAlphabetic}\p{N}]+(?:['’][\p{IsAlphabetic}\p{N}]+)*"


@pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC. Only texts that are not plain ASCII are sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def unify_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_technical(text: Column) -> Column:
    """CRLF and lone CR to LF, then NFC."""
    return nfc(unify_lines(text))


def words(text: Column) -> Column:
    """Runs of letters and numbers; an apostrophe of either kind counts inside a word, and becomes the straight one."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), 0), lambda w: F.replace(w, F.lit("’"), F.lit("'")))


def space_tokens(text: Column) -> Column:
    """Runs of characters that are no Unicode white space."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda x: x != "")


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def looks_like_refusal(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for phrase in REFUSALS:
        found = found | low.contains(phrase)
    return found


def contains_contiguous(haystack: Column, needle: Column) -> Column:
    """Whether a shorter, non-empty list of words stands in another without gaps. Words are letters and numbers; a control character marks their ends."""
    mark = lambda x: F.concat(F.lit("\x1f"), F.array_join(x, "\x1f"), F.lit("\x1f"))
    return (F.size(needle) > 0) & (F.size(haystack) > F.size(needle)) & mark(haystack).contains(mark(needle))


def rate(errors: Column, length: Column) -> Column:
    """Errors by length; without a length, 1 if there are errors."""
    return F.when(length == 0, (errors > 0).cast("double")).otherwise(errors / length)


def ref_label(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    """`Book c:v`, or `Book c:v-e` where the end differs."""
    last = F.coalesce(end, start)
    return F.concat(book, F.lit(" "), chapter, F.lit(":"), start, F.when(last == start, "").otherwise(F.concat(F.lit("-"), last)))


def word_distance(left: Column, right: Column) -> Column:
    """Edit distance over lists of tokens, JVM-side: distinct tokens become characters of the private planes."""

    def coded(tokens: Column, names: Column) -> Column:
        code = lambda t: F.decode(F.unhex(F.lpad(F.hex((F.array_position(names, t) + 0xF0000).cast("long")), 8, "0")), "UTF-32")
        return F.array_join(F.transform(tokens, code), "")

    bound = F.transform(F.array(F.struct(left.alias("l"), right.alias("r"), F.array_union(left, right).alias("n"))), lambda x: F.levenshtein(coded(x["l"], x["n"]), coded(x["r"], x["n"])))
    return F.get(bound, F.lit(0))


def percent(value: Column) -> Column:
    return F.format_string("%.2f%%", 100 * value)


def euros(nano: Column) -> Column:
    """Nano-euros as `EUR x.yyyyyy`, truncated to micro-euros."""
    nano = nano.cast("decimal(20,0)")
    whole = F.floor(nano / F.lit(1_000_000_000).cast("decimal(20,0)"))
    micro = F.floor((nano % F.lit(1_000_000_000).cast("decimal(20,0)")) / 1000)
    return F.concat(F.lit("EUR "), whole.cast("string"), F.lit("."), F.lpad(micro.cast("long").cast("string"), 6, "0"))


def escape_table(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    out = json
    for raw, safe in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def truncate_error(text: Column) -> Column:
    return F.left(text, F.lit(1000))
