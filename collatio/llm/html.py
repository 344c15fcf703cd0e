"""Main text of web pages: the best-scoring contiguous region of words and tags.

Words score by what they stand in, positive unless the elements, classes and links around them speak
against it; tags score negative. The weights are fitted on labelled pages. One linear scan finds the
contiguous run with the largest sum, which is the content; within it, blocks go whose own words weigh
against them more than their standing in the region weighs for them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled
from .common import batches, small_batches, utf8

#: Elements whose text is never shown as prose, what may stand in head (anything else ends it), and kinds of elements.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "textarea", "select", "title", "object", "canvas", "audio", "video")
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title", "head", "html"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = re.compile(rf"({'|'.join(RAW)})\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>\"']*)")
_MARK, _BRACKET = re.compile("[<>\"']"), re.compile("[<>]")
#: Fixed value: places of a weight that count. Weights are summed as whole numbers, so that what opens and closes leaves no trace.
DIGITS = 10_000
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


@dataclass(slots=True)
class Event:
    """A tag, or a run of text between tags."""

    kind: str  # the tag's name; "" for text
    text: str = ""
    inside: tuple[str, ...] = ()  # features of the elements around a text, where weights are not known yet
    apart: bool = False  # in a form, the head, or something hidden
    breaks: bool = False  # ends a block
    speaks: float | None = None  # the sum of the weights of the features around a text
    home: "Element | None" = None  # the innermost element around a text


@dataclass(slots=True, eq=False)
class Element:
    name: str
    features: tuple[str, ...]
    around: "Element | None"
    begin: int  # of the events that it holds
    apart: str = ""  # why what it holds is apart: "element", "form" or not
    end: int | None = None


def tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Marked-up parts of a page: begin, end, kind ("", data, raw, tag or end), name and what stands behind it.

    Time is linear on any markup: what ends a part is looked for once, and where quotes lead is remembered.
    """
    at, size, last, data_ends, leads = 0, len(html), html.rfind(">"), True, {}

    def closing(place: int) -> int:
        """The first bracket outside of quotes; a quote without an end stops there."""
        passed = []
        while True:
            m = _MARK.search(html, place)
            found = m.start() if m else size
            if found in leads:
                found = leads[found]
                break
            if not m or m[0] in "<>":
                break
            passed.append(found)
            behind = html.find(m[0], found + 1)
            if behind < 0:
                break
            place = behind + 1
        leads.update(dict.fromkeys(passed, found))
        return found

    while (begin := html.find("<", at)) >= 0:
        at = begin + 1
        if html.startswith("!--", at):
            end = html.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            yield begin, at, "", "", ""
            continue
        if begin > last:
            continue
        if html[at] in "!?":
            if data_ends and html[at : at + 8].upper() == "![CDATA[":
                end = html.find("]]>", begin + 9)
                if end >= 0:
                    at = end + 3
                    yield begin, at, "data", "", html[begin + 9 : end]
                    continue
                data_ends = False
            at = html.find(">", begin + 2) + 1
            if not at:
                return
            yield begin, at, "", "", ""
        elif m := _RAW.match(html, at):
            name = m[1].lower()
            end = _RAW_END[name].search(html, html.find(">", m.end()) + 1)
            at = end.end() if end else size
            yield begin, at, "raw", name, ""
        elif m := _NAME.match(html, at):
            end = closing(m.end())
            if end == size or html[end] != ">":
                other = _BRACKET.search(html, m.end())
                if not other or other[0] != ">":
                    continue
                end = other.start()
            at = end + 1
            yield begin, at, "end" if m[1] else "tag", m[2].lower(), html[m.end() : end]


@lru_cache(4096)
def _features(name: str, rest: str) -> tuple[tuple[str, ...], bool]:
    """What an element tells of the words in it (its name, its role, the words of its class and id), and whether it is hidden."""
    if not rest.strip():
        return (name,), False
    values = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(rest)}
    words = re.findall("[a-z]+", f"{values.get('class', '')} {values.get('id', '')}")
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
    return (name, *(f".{w}" for w in dict.fromkeys(words)), *(f"@{w}" for w in values.get("role", "").split())), hidden


def page_events(html: str, weights: "Weights | None" = None) -> list[Event]:
    """A page's tags and texts. A form is apart, unless it holds an article or most of the page's words."""
    out, wide = _scan(html, set(), weights)
    return _scan(html, wide, weights)[0] if wide else out


def _scan(html: str, wide: set[int], weights: "Weights | None") -> tuple[list[Event], set[int]]:
    """Events, with the forms of `wide` (numbers in order) not apart, and the forms that hold an article or
    most words. A form within a form is part of it. With weights, texts carry the sum of those around them."""
    out: list[Event] = []
    forms, main, words = 0, set(), Counter()  # words by form, 0 outside
    stack: list[Element] = []
    held: Counter = Counter()  # open elements by name, and those that are apart by why
    around: dict[str, int] = {}  # features of the open elements, with how many have them
    inside: tuple[str, ...] | None = ()  # the same as a tuple, once asked for
    total = clean = at = 0  # the sum of their weights; how many of the outermost elements have lost their classes

    def text(raw: str) -> None:
        nonlocal inside
        if raw:
            if raw.strip():
                end_head()
            if not held["why", "element"]:
                words[forms if held["form"] else 0] += len(raw.split())
            if weights is None and inside is None:
                inside = tuple(around)
            out.append(Event("", raw, inside if weights is None else (), apart(), speaks=None if weights is None else total / DIGITS, home=stack[-1] if stack else None))

    def apart() -> bool:
        return held["why", "element"] + held["why", "form"] > 0

    def count(features: tuple[str, ...], by: int) -> None:
        nonlocal inside, total
        for f in features:
            n = around.get(f, 0) + by
            if n == max(by, 0) and weights is not None:  # the first comes or the last goes
                total += by * weights.whole(f)
            if n:
                around[f] = n
            else:
                del around[f]
        inside = None

    def pop(to: int) -> None:
        nonlocal clean
        for x in stack[to:]:
            held[x.name] -= 1
            held["why", x.apart] -= 1
            count(x.features, -1)
            x.end = len(out)
        del stack[to:]
        clean = min(clean, to)

    def end_head() -> None:
        if stack and stack[-1].name == "head":
            pop(len(stack) - 1)

    for begin, end, kind, name, rest in tokens(html):
        text(html[at:begin])
        at = end
        if kind == "data":
            text(rest.replace("&", "&amp;"))
        elif kind == "raw":
            if name not in HEAD:
                end_head()
            out.append(Event(name, "", (), True, True))
        elif kind == "end":
            out.append(Event(name, "", (), apart(), name not in INLINE))
            if held[name]:
                k = len(stack) - 1
                while stack[k].name != name:  # each element passed is closed, so passed once
                    k -= 1
                pop(k)
        elif kind == "tag":
            if name not in HEAD:
                end_head()
            if name in ("article", "main") and held["form"] and not held["why", "element"]:
                main.add(forms)
            if name in ("article", "main"):  # the classes of what holds an article tell nothing of it
                for x in stack[clean:]:
                    count(tuple(f for f in x.features if f[0] == "."), -1)
                    x.features = tuple(f for f in x.features if f[0] != ".")
                clean = len(stack)
            if name not in INLINE and stack and stack[-1].name == "p" and name not in VOID:
                pop(len(stack) - 1)
            if name in ("li", "tr", "td", "th", "option", "dt", "dd") and stack and stack[-1].name == name:
                pop(len(stack) - 1)
            if name not in VOID and not rest.endswith("/"):
                features, hidden = _features(name, rest)
                why = "element" if hidden or name == "head" else ""
                if name == "form":
                    forms += not held["form"]
                    why = why or ("" if forms in wide else "form")
                if name in ("html", "body"):
                    features = ()
                stack.append(Element(name, features, stack[-1] if stack else None, len(out), why))
                held[name] += 1
                held["why", why] += 1
                count(features, 1)
            out.append(Event(name, "", (), apart(), name not in INLINE))
    text(html[at:])
    return out, main | {k for k, n in words.items() if k and 2 * n > sum(words.values())}


@dataclass
class Weights:
    """Log odds of a word being content, by what it stands in; what tags weigh; and what standing in the region weighs."""

    base: float = 1.0
    features: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -0.5
    region: float = 1.0
    most: float = 4.0

    def whole(self, feature: str) -> int:
        return round(self.features.get(feature, 0.0) * DIGITS)

    def odds(self, e: Event, n: int) -> float:
        return self.base + self.features.get(_length(n), 0.0) + (sum(map(self.whole, e.inside)) / DIGITS if e.speaks is None else e.speaks)

    def of(self, e: Event) -> float:
        if e.kind:
            return 0.0 if e.apart else self.tags.get(e.kind, self.other)
        n = 0 if e.apart else len(e.text.split())
        return n * max(-self.most, min(self.most, self.odds(e, n))) if n else 0.0


def _length(n: int) -> str:
    return "#few" if n < 4 else "#some" if n < 12 else "#many"


def fit(pages: list[str]) -> Weights:
    """Weights from pages whose content stands between [[ and ]].

    A text's features get their weights by logistic regression over texts, each counting as often as the
    root of its words; a tag's weight is how often it stands outside of the content. `region` is what sorts
    the blocks of the scan's regions best into content and others.
    """
    texts, tags = [], Counter()
    for page in pages:
        content = False
        for e in page_events(page.replace("[[", "<content-begins/>").replace("]]", "<content-ends/>")):
            if e.kind.startswith("content-"):
                content = e.kind == "content-begins"
            elif e.kind:
                tags[e.kind, content] += 1
            elif not e.apart and e.text.strip():
                n = len(e.text.split())
                texts.append(((*e.inside, _length(n)), content, math.sqrt(n)))
    names = {f: k for k, f in enumerate(sorted({f for x, _, _ in texts for f in x}), 1)}
    x = np.zeros((len(texts), len(names) + 1))
    x[:, 0] = 1
    for row, (found, _, _) in enumerate(texts):
        x[row, [names[f] for f in found]] = 1
    y, w = np.array([t[1] for t in texts], float), np.array([t[2] for t in texts])
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    ridge[0] = 1e-3
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    odds = lambda k: math.log((tags[k, True] + 0.5) / (tags[k, False] + 0.5))
    weights = Weights(float(beta[0]), {f: round(float(beta[k]), 4) for f, k in names.items()}, {k: max(-3.0, min(-0.05, (odds(k) - 3) / 4)) for k, _ in tags})
    blocks = []  # of the regions: log odds a word, words of content, other words
    for page in pages:
        content, block = False, [0.0, 0, 0]
        own = page_events(page.replace("[[", "<content-begins/>").replace("]]", "<content-ends/>"))
        begin, end = best_region([0.0 if e.kind.startswith("content-") else weights.of(e) for e in own])
        for at, e in enumerate(own):
            content = e.kind == "content-begins" or (content and e.kind != "content-ends")
            if not begin <= at < end:
                continue
            if e.apart or e.breaks:
                if block[1] + block[2]:
                    blocks.append((block[0] / (block[1] + block[2]), block[1], block[2]))
                block = [0.0, 0, 0]
            elif not e.kind and (words := len(e.text.split())):
                block[0] += words * weights.odds(e, words)
                block[2 - content] += words
    wrong = lambda shift: sum(good if odds + shift <= 0 else bad for odds, good, bad in blocks)
    weights.region = min((k / 4 for k in range(25)), key=lambda shift: (wrong(shift), -shift))
    return weights


@cache
def fitted() -> Weights:
    return fit(labelled.pages(160, 11))


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, the first and shortest of those; empty if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def widened(own: list[Event], begin: int, end: int, weights: Weights) -> tuple[int, int]:
    """The region up to the first and last text that weighs for content in the innermost element around all of
    the region, if that element weighs for content itself: short ends that a break cut off from the scan's run."""
    texts = [e for e in own[begin:end] if not e.kind and not e.apart and e.text.strip()]
    if not texts:
        return begin, end
    homes, home = set(), texts[0].home
    while home:
        homes.add(id(home))
        home = home.around
    home = texts[-1].home
    while home and (id(home) not in homes or sum(map(weights.whole, home.features)) <= DIGITS):
        home = home.around
    if not home:
        return begin, end
    good = []
    for k in range(home.begin, len(own) if home.end is None else home.end):
        e = own[k]
        if not begin <= k < end and not e.kind and not e.apart:
            words = len(e.text.split())
            if words and weights.odds(e, words) > 0:
                good.append(k)
    return min([begin, *good]), max([end, *(k + 1 for k in good)])


def main_text(html: str, weights: Weights | None = None) -> str:
    """A page's content: blocks of the best region, white space inside a block as one space, joined by one space.

    The scan says where the content begins and ends. Blocks between others of the content go if their
    words speak against them.
    """
    weights = weights or fitted()
    own = page_events(html, weights)
    begin, end = best_region([weights.of(e) for e in own])
    begin, end = widened(own, begin, end, weights)
    if begin < end:  # words at either edge are part of the block they stand in
        while begin and not own[begin - 1].breaks and not own[begin - 1].apart:
            begin -= 1
        while end < len(own) and not own[end].breaks and not own[end].apart:
            end += 1
    blocks: list[tuple[bool, str]] = []
    block: list[str] = []
    odds = 0.0
    for e in [*own[begin:end], Event("", apart=True)]:
        if e.apart or e.breaks:
            if block:
                blocks.append((odds > 0, "".join(block)))
            block, odds = [], 0.0
        elif not e.kind:
            words = len(e.text.split())
            block.append(unescape(e.text))
            odds += words * (weights.odds(e, words) + weights.region) if words else 0.0
    good = [k for k, (keep, _) in enumerate(blocks) if keep]
    first, last = (good[0], good[-1]) if good else (0, -1)
    return " ".join(" ".join(text for k, (keep, text) in enumerate(blocks) if keep or not first < k < last).split())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: `text`, its main text (empty if none), and `n_chars`, its code points.

    A null page counts as empty; a null id or `keep` column stays null. Repeated rows are extracted each, an
    empty table gives no rows. Pages of any length and any markup are read whole, in time linear in their length.
    Of runs that score alike the first is taken. `keep` names further columns to carry; all others are left
    out, whatever their names.
    """
    kept = [id_col, *keep]
    out = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    weights = fitted()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = [main_text(x.decode("utf-8", "replace"), weights) for x in utf8(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=out.names)

    small_batches(pages.sparkSession)
    return pages.select(*(F.col(c) for c in kept), F.col(html_col).cast("string").alias("__html")).mapInArrow(run, out)
