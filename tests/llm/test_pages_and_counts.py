"""Page extraction on labelled and made-up pages; token counts that follow edits, against counting anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from collatio.llm import html, labelled, tokencount

PAGES = [
    ("<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><div class='ad'>Buy it now</div><article><h1>The river rose again</h1><p>After three days of rain the <b>river</b> rose above its banks.</p><p>People moved their things to the upper floors and waited for help.<br>It came in the morning.</p></article><footer>&copy; The paper</footer></body></html>", "The river rose again After three days of rain the river rose above its banks. People moved their things to the upper floors and waited for help. It came in the morning."),
    ("<body><div id=cookie-notice>We use cookies</div><article><header><h1>Title&amp;more</h1></header><p>One <b>bo</b>ld  word\nand &eacute;&#233;.<script>x('</p>')</script></p><div class='ad'>Buy</div><p>Two.</p></article><section id=comments><p>I like this a lot, and I write long comments here.</p></section></body>", "Title&more One bold word and éé. Two."),
    ("", ""), (None, ""), ("<nav>only <a href=x>menu</a></nav>", ""), ("plain words without tags", "plain words without tags"),
    ("<p>unclosed <b>tags <p>go on <i>here", "unclosed tags go on here"),
    ("<div class='page menu-open'><div class=sidebar><p>side words here</p></div><main><p>Main &lt;text&gt; here, of some length.</p></main><form><p>Your name, your mail</p></form></div>", "Main <text> here, of some length."),
    ("<!-- <p>hidden</p> --><p>seen</p><style>p{}</style><noscript>no</noscript>", "seen"),
]


def test_pages(spark):
    pages = spark.createDataFrame([(k, f"u{k}", h, "t", 1) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    found = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert found == {k: (t, len(t)) for k, (_, t) in enumerate(PAGES)}
    assert html.extract(pages.limit(0)).collect() == []


def plain_main_text(page: str, weights: html.Weights) -> str:
    """The definition, over all runs of events: the best sum, the first and shortest of those; then blocks by their words."""
    from html import unescape

    events = html.page_events(page)
    scores = [weights.of(e) for e in events]
    sums = [0.0]
    for s in scores:
        sums.append(sums[-1] + s)
    n = len(events)
    best = max((sums[j] - sums[i] for i in range(n + 1) for j in range(i, n + 1)), default=0.0)
    if best <= 0:
        return ""
    begin, end = min(((i, j) for i in range(n) for j in range(i + 1, n + 1) if abs(sums[j] - sums[i] - best) < 1e-9), key=lambda x: (x[1], -x[0]))
    begin, end = html.widened(events, begin, end, weights)
    while begin and not (events[begin - 1].breaks or events[begin - 1].apart):
        begin -= 1
    while end < n and not (events[end].breaks or events[end].apart):
        end += 1
    blocks: list[list[html.Event]] = [[]]
    for e in events[begin:end]:
        if e.breaks or e.apart:
            blocks.append([])
        elif not e.kind:
            blocks[-1].append(e)
    blocks = [b for b in blocks if b]
    size = lambda e: len(e.text.split())
    good = [sum(size(e) * (weights.odds(e, size(e)) + weights.region) for e in b if size(e)) > 0 for b in blocks]
    kept = [b for k, b in enumerate(blocks) if good[k] or not any(good[:k]) or not any(good[k:])]
    return " ".join(" ".join("".join(unescape(e.text) for e in b) for b in kept).split())


def labelled_content(page: str) -> list[str]:
    import re

    return re.sub("<[^>]*>", " ", " ".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))).split()


def test_main_text_against_all_runs():
    weights = html.fitted()
    for page in [*labelled.pages(25, 3), *(p or "" for p, _ in PAGES)]:
        page = page.replace("[[", "").replace("]]", "")
        assert html.main_text(page) == plain_main_text(page, weights)


def test_held_out_labelled_pages(monkeypatch):
    """Weights fitted without a quarter of the parts, on pages of that quarter; and what the scan does for it."""
    from collections import Counter

    weights = html.fit(labelled.pages(160, 11, lambda k: k % 4))

    def measured() -> tuple[float, float]:
        got = want = both = 0
        for page in labelled.pages(60, 5, lambda k: not k % 4):
            a, b = Counter(html.main_text(page.replace("[[", "").replace("]]", ""), weights).split()), Counter(labelled_content(page))
            got, want, both = got + a.total(), want + b.total(), both + (a & b).total()
        return both / got, both / want

    precision, recall = measured()
    assert precision > 0.85 and recall > 0.97
    monkeypatch.setattr(html, "best_region", lambda scores: (0, len(scores)))
    assert measured()[0] < precision - 0.08


def test_the_scan_decides(monkeypatch):
    page = PAGES[0][0]
    text = html.main_text(page)
    monkeypatch.setattr(html, "best_region", lambda scores: (0, len(scores)))
    assert html.main_text(page) != text


def test_head_and_wrapping_forms_do_not_hide_the_page():
    body = "<p>The river rose above its banks after three days of rain.</p>"
    text = "The river rose above its banks after three days of rain."
    assert html.main_text(f"<html><head><title>t</title><meta charset=utf-8><body>{body}</body></html>") == text
    assert html.main_text(f"<head><link href=x><script>a()</script><div>{body}</div>") == text
    assert html.main_text("<head><title>t</title>Plain words of a page") == "Plain words of a page"
    assert html.main_text(f"<body><form action=x><nav><a href=/>Home</a></nav><div>{body}</div></form></body>") == text
    assert html.main_text(f"<body><form><div class=menu><article>{body}</article></div></form><p>Other words of this page, which are more than those that the article has, by far.</p></body>").startswith(text)
    assert html.main_text(f"<body><div>{body}</div><form><p>Your name, your mail</p></form></body>") == text


def test_best_region():
    for seed in range(300):
        r = random.Random(seed)
        scores = [r.randint(-4, 4) for _ in range(r.randint(0, 20))]
        a, b = html.best_region(scores)
        assert sum(scores[a:b]) == max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)] or [0])


@pytest.mark.parametrize("part", ["<a \"'", "<p ", "<div>", "<!--", "<script><", "<![CDATA[", "<title ", "<script ", "<!", "<a<", "<a ' <b \" ", "<article class=x>", "<div class='a b c'><p>x ", "</div ", "<form><article>", "<li><td>"])
def test_odd_markup_takes_linear_time(part):
    """Eight times the markup takes about eight times as long."""
    import time

    def seconds(n: int) -> float:
        begin = time.time()
        html.main_text(part * n + "<")
        return time.time() - begin

    seconds(100)
    small, large = min(seconds(4_000) for _ in range(3)), seconds(32_000)
    assert large < 24 * max(small, 0.02)


def test_quotes_lead_where_the_pattern_says():
    """The tags of made-up markup are those of the definition as one pattern."""
    import re

    pattern = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>\"']*)(?P<rest>(?>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)|[^<>]*)>")
    r = random.Random(4)
    for _ in range(20_000):
        page = "".join(r.choices(["<b", "<q", "</b", "<", ">", '"', "'", " ", "x", "/", "="], k=r.randint(0, 25)))
        assert [(b, e, n, rest) for b, e, _, n, rest in html.tokens(page)] == [(m.start(), m.end(), m["name"], m["rest"]) for m in pattern.finditer(page)]


@pytest.mark.parametrize("n", [0, 100, 600, 2_000])
def test_many_class_words_ahead(n):
    """Class words that are closed again, or still open, change nothing of what is told apart."""
    body = "<article><p>The river rose above its banks after three days of rain.</p></article><div class=sidebar><p>Side words that are many enough to look like those of a text.</p></div><section id=comments><p>I like this a lot, and I write long comments here.</p></section>"
    text = "The river rose above its banks after three days of rain."
    words = [f"q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(n)]
    assert html.main_text("".join(f"<div class={w}></div>" for w in words) + body) == text
    assert html.main_text("".join(f"<div class={w}>" for w in words) + body) == text


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return tokencount.Counter.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


ALPHABET = ["a", "b ", " ", "  ", "\n", "'s", "é", " ", "!", "12", " x", "\x1c", "　"]


def test_edits_match_counting_anew(counter, monkeypatch):
    monkeypatch.setattr(tokencount, "LEAF", 4)
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choices(ALPHABET, k=r.randint(0, 60)))
        tree, edits, at = tokencount.Tree.of(*counter.leaves(text)), [], 0
        for _ in range(r.randint(0, 4)):
            a = r.randint(at, len(text))
            b = r.randint(a, min(len(text), a + r.choice([0, 1, 5, 30])))
            edits.append((a, b, "".join(r.choices(ALPHABET, k=r.randint(0, 5)))))
            at = b
            if at >= len(text):
                break
        expected = text
        for a, b, new in reversed(edits):
            expected = expected[:a] + new + expected[b:]
        found, _ = tokencount.edit(text, tree, list(edits), counter)
        assert found == expected
        assert tree.total == len(counter.encoding.encode_ordinary(expected))
        rebuilt = tokencount.Tree.of(tree.chars[0], tree.tokens[0])
        assert (rebuilt.chars, rebuilt.tokens) == (tree.chars, tree.tokens)


def test_counts(spark, counter):
    import public_tokenizers

    texts = [None, "", "mail me@example.org now", "4111111111111111", "word " * 5000 + "me@example.org" + " word" * 5000, "  \n me@example.org\n"]
    docs = spark.createDataFrame([(k % 4, t, "x", 5) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string, leaf_chars int")
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    from collatio.llm.native import matches
    from collatio.llm.queries import PERSONAL

    edits = F.transform(matches(F.col("text"), PERSONAL), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("[removed]").alias("value")))
    for r in tokencount.edited(tokencount.counted(docs, *args), edits, *args).collect():
        assert r.n_tokens == len(counter.encoding.encode_ordinary(r.text))
        assert "@" not in r.text
        assert r.n_reencoded <= len(r.text)
        assert (r.n_edits == 0) == (r.n_reencoded == 0)
    assert tokencount.counted(docs.limit(0), *args).collect() == []
