"""Secret scans with corpus-wide ownership frequency.

Candidates are found by pattern. A value that many owners or repositories hold is a copied example;
one that few hold is specific to its owner and looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, written
from .native import matches, replaced

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What stands between the characters of a key: white space, escaped line ends, and marks of quotes, comments, diffs and strings.
_GAP = r"""(?:[\s"',>#*|+]|\\++[nrt]?|-(?!----[^-]))"""
_EDGE = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_HEADERS = rf"(?:{_GAP}*+(?:Proc-Type:\x20?4,ENCRYPTED|DEK-Info:\x20?[A-Z0-9-]++,[0-9A-Fa-f]++|(?:Version|Comment|MessageID|Hash|Charset):(?:[^\n\\-]++|-(?!----))*+))*+"
#: A private key from BEGIN to END or, where END is missing, to the end of what looks like its body: long runs of
#: base64, and a short one behind them that is padded or ends its line. Loops are possessive, as Java's others recurse.
PEM = (
    rf"-----BEGIN {_EDGE}{_HEADERS}"
    rf"(?:(?:[A-Za-z0-9/=;:&<()]++|{_GAP})*+-----END {_EDGE}"
    rf"""|(?:(?:{_GAP}*+[A-Za-z0-9+/]{{24,}}+={{0,2}}+)++(?:{_GAP}++[A-Za-z0-9+/]{{1,23}}+(?:={{1,2}}+|(?=[\r\n\\"']|\z)))?+)?+)"""
)
#: How vendors' keys begin and how long they are at least.
VENDOR = "|".join((
    r"gh[pousr]_[A-Za-z0-9]{36,}", r"github_pat_[A-Za-z0-9_]{22,}", r"glpat-[A-Za-z0-9_-]{20,}", r"xox[baprs]-[A-Za-z0-9-]{10,}", r"xapp-[A-Za-z0-9-]{20,}", r"AIza[A-Za-z0-9_-]{35}", r"ya29\.[A-Za-z0-9_-]{20,}",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", r"sk-(?:proj|ant|svcacct|admin|or)-[A-Za-z0-9_-]{16,}", r"sk-[A-Za-z0-9]{32,}", r"ASIA[A-Z0-9]{16,}", r"hf_[A-Za-z0-9]{30,}", r"npm_[A-Za-z0-9]{36,}", r"pypi-[A-Za-z0-9_-]{50,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", r"dop_v1_[0-9a-f]{40,}", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
))
#: A bearer token holds a digit and a letter; what stands for one in instructions mostly does not.
BEARER = r"[Bb]earer\x20+(?=[A-Za-z+/_.=~-]{0,400}[0-9])(?=[0-9+/_.=~-]{0,400}[A-Za-z])[A-Za-z0-9+/_.=~-]{16,}"
#: Kinds of the base in their order, then the method's own, which are kept where owner-specific.
PATTERNS = (
    ("assign", ASSIGN),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
    ("vendor", VENDOR),
    ("pem", PEM),
    ("url", r"(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[^/\s:@]*+:[^/\s:@]{3,}+@"),
    ("bearer", BEARER),
)
BASE = 3
MIN_ASSIGNED = 6

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _found(text: Column, kind: int, pattern: str) -> Column:
    found = matches(text, pattern)
    if kind == 0:  # matched as it stands, then dropped if what is assigned is short
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= MIN_ASSIGNED)
        value = lambda x: F.regexp_extract(x["value"], ASSIGN, 1)
    elif pattern == PEM:  # the body tells keys apart; a line without one counts as itself
        body = lambda x: F.regexp_replace(x["value"], rf"-----(?:BEGIN|END) {_EDGE}|\\+[nrt]?|[^A-Za-z0-9+/=]", "")
        value = lambda x: F.when(body(x) == "", x["value"]).otherwise(body(x))
    else:
        value = lambda x: x["value"]
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.sha2(value(x), 256).alias("value")))


def spans_text(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined, by start and then kind."""
    kinds = F.array(*(F.lit(k) for k, _ in PATTERNS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "source", max_owners: int = 3, max_repositories: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: `base` and `spans` (arrays of start, kind, end, and `copied` for spans whose
    value more than `max_owners` owners or `max_repositories` repositories hold).

    Base spans always stay; the method's own are kept unless copied. Null texts have no spans. Null
    owners count as one owner. Repeated rows are scanned each. `keep` names further columns to carry.
    The tables have one column for owners and repositories, `source`, so by default both thresholds look at
    it and the lower one decides; give two columns where there are two. Texts of any length are scanned whole, an
    empty table gives no rows, and columns that are not kept are left out, whatever their names.
    Only candidates are shuffled, as hashes, counted on the map side first; rows without candidates are not.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    all_found = F.sort_array(F.concat(*(_found(text, k, p) for k, (_, p) in enumerate(PATTERNS))))
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), *(F.col(c) for c in keep), own(owner_col).alias("__owner"), own(repository_col).alias("__repository"), all_found.alias("__found"), F.monotonically_increasing_id().alias("__row"))
    rows = written(rows, "secrets")
    each = rows.filter(F.size("__found") > 0).select("__row", "__owner", "__repository", F.explode("__found").alias("s")).select("__row", "__owner", "__repository", "s.*")
    owned = each.select("value", "__owner", "__repository").distinct()
    many = owned.groupBy("value").agg(F.countDistinct("__owner").alias("owners"), F.countDistinct("__repository").alias("repositories"))
    many = many.filter((F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)).select("value", F.lit(True).alias("copied"))
    judged = each.join(many, "value", "left").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", F.coalesce("copied", F.lit(False)).alias("copied")))).alias("__judged"))
    kept = [id_col, *keep]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,copied:boolean>>")
    found = rows.filter(F.size("__found") > 0).join(judged, "__row").select(*kept, "__judged")
    found = found.unionByName(rows.filter(F.size("__found") == 0).select(*kept, none.alias("__judged")))
    return found.select(*kept, F.filter("__judged", lambda x: x["kind"] < BASE).alias("base"), F.filter("__judged", lambda x: (x["kind"] < BASE) | ~x["copied"]).alias("spans"))


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns of `scan`."""
    found = scan(docs, id_col)
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    live = F.size(F.filter("spans", lambda x: ~x["copied"])).cast("long")
    return found.select(id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), live.alias("n_live"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "source", mark: str = "[secret]") -> DataFrame:
    """`docs` with each span of its text replaced by `mark`; all rows and columns stay. Null texts stay null, an empty table empty.

    Spans that overlap are replaced as one. Copied examples of the method's own kinds are no spans and stay.
    """
    own, names, back = shielded(docs)
    found = scan(own, names[id_col], names[text_col], names[owner_col], names[repository_col], keep=tuple(n for c, n in names.items() if c != id_col))
    text = F.col(names[text_col])
    return back(found.withColumn(names[text_col], replaced(text, F.col("spans"), mark)))
