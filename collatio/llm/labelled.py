"""Labelled web pages, from which the weights of the main-text extraction are fitted.

Layouts are put together from written parts: `<w5>` stands for about five words, `<l4>` for about four
list items with links. What is content is known by the part, and marked off by [[ and ]].
"""

from __future__ import annotations

import random
import re

#: Parts that are not content, by where they stand: before the content, behind it, or within it.
BEFORE = (
    "<nav><ul><l6></ul></nav>", "<div class='menu'><ul><l7></ul></div>", "<ul id='main-menu' class='nav navbar-nav'><l6></ul>", "<header><a href='/'><w2></a><nav><l5></nav></header>", "<div id='header'><a href='/'><w2></a><p><w5></p></div>",
    "<header class='site-header'><h1><a href='/'><w2></a></h1><p class='tagline'><w6></p></header>", "<div class='topbar'><span><w4></span> <a href='/in'><w2></a></div>", "<div class='masthead'><p><w4></p></div>",
    "<div class='breadcrumbs'><a href='/'><w1></a> &gt; <a href='/a'><w1></a></div>", "<ol class='breadcrumb'><l3></ol>", "<table><tr><td><a href='/x'><w1></a></td><td><a href='/y'><w1></a></td><td><a href='/z'><w2></a></td></tr></table>",
    "<div class='ad'><w12></div>", "<div class='advert banner-ad'><p><w15></p></div>", "<div id='ads'><a href='/buy'><w8></a></div>", "<div class='sponsor'><p><w10></p></div>", "<div class='promo promotion'><w9></div>", "<div class='adsense advertisement'><p><w14></p></div>",
    "<div class='cookie-notice'><p><w18></p><button><w1></button></div>", "<div id='cookie-banner' role='dialog'><p><w20></p><a href='/p'><w2></a></div>", "<div class='consent gdpr'><p><w16></p></div>", "<div class='notice'><p><w14></p></div>", "<div class='alert' role='alert'><p><w10></p></div>", "<div class='cookies'><w12></div>",
    "<div class='popup modal'><p><w12></p></div>", "<dialog><p><w8></p></dialog>", "<div class='overlay'><p><w9></p></div>", "<a class='skip-link screen-reader-text' href='#m'><w3></a>", "<div role='navigation'><l5></div>", "<div role='banner'><p><w5></p></div>", "<div role='search'><p><w3></p></div>", "<div class='search'><w3></div>",
    "<menu><l4></menu>", "<div class='toolbar'><l4></div>", "<div class='login signup'><p><w4></p></div>", "<div><a href='/1'><w1></a> | <a href='/2'><w1></a> | <a href='/3'><w2></a> | <a href='/4'><w1></a></div>",
)
BEHIND = (
    "<footer><p><w10></p></footer>", "<footer>&copy; <w8></footer>", "<div id='footer'><p><w9></p><l4></div>", "<div class='foot'><w7></div>", "<footer class='site-footer' role='contentinfo'><ul><l5></ul><p>&copy; <w4></p></footer>", "<div class='footer-links'><a href='/p'><w1></a> <a href='/t'><w1></a></div>", "<div class='copyright'><p>&copy; <w8></p></div>",
    "<aside><h4><w1></h4><ul><l5></ul></aside>", "<aside class='sidebar'><p><w25></p><l3></aside>", "<div class='sidebar'><h3><w2></h3><ul><l6></ul></div>", "<div id='side-bar' class='widget'><p><w12></p></div>", "<div class='widget widget-recent'><ul><l5></ul></div>", "<div role='complementary'><p><w14></p><l3></div>",
    "<div class='related'><h3><w2></h3><ul><l4></ul></div>", "<section class='related-posts'><h2><w2></h2><p><a href='/r'><w7></a></p><p><a href='/s'><w6></a></p></section>", "<div class='recommended recommendations'><l5></div>", "<div class='trending'><l4></div>", "<div class='pagination pager'><a href='/1'>1</a><a href='/2'>2</a></div>",
    "<section id='comments'><h3><w1></h3><p><w25></p><p><w30></p></section>", "<div class='comments'><div class='comment'><p><w30></p></div><div class='comment'><p><w12></p></div></div>", "<ol class='commentlist comment-list'><li class='comment'><p><w24></p></li><li class='comment reply'><p><w18></p></li></ol>", "<div id='disqus_thread'><p><w10></p></div>", "<div id='respond' class='replies'><p><w8></p></div>", "<div class='comment-section'><div class='comment-body'><p><w28></p></div></div>",
    "<div class='newsletter'><p><w10></p></div>", "<div class='subscribe subscription'><h4><w2></h4><p><w9></p></div>", "<div class='share sharing'><l4></div>", "<div class='social social-links'><a href='/f'><w1></a><a href='/g'><w1></a></div>", "<div><a href='/p'><w1></a> <a href='/t'><w1></a> <a href='/c'><w2></a></div>", "<div class='disclaimer legal'><p><w14></p></div>", "<div class='tags'><l5></div>",
)
WITHIN = (
    "<div class='ad'><w9></div>", "<div class='advert'><p><w12></p></div>", "<div class='advertisement'><w8></div>", "<div class='share'><l3></div>", "<div class='social-share sharing'><a href='/f'><w1></a></div>", "<aside><p><w12></p></aside>", "<aside class='related'><p><a href='/r'><w6></a></p></aside>", "<div class='newsletter signup'><p><w9></p></div>", "<div class='promo'><p><w10></p></div>", "<nav><l3></nav>",
    "<div class='related'><ul><l3></ul></div>", "<div class='comments'><p><w14></p></div>", "<section class='comments' id='comments'><p><w20></p></section>", "<div class='sponsored sponsor'><w8></div>", "<footer><p><w6></p></footer>", "<div class='cookie-notice notice'><p><w10></p></div>", "<button><w2></button>", "<div class='subscribe'><w8></div>", "<div class='sidebar widget'><p><w10></p></div>", "<div class='banner'><w6></div>",
)
#: What holds the content: what stands before it and behind it.
HOLDERS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div id='content'>", "</div>"), ("<div class='post'>", "</div>"), ("<div class='content'><div class='entry-content'>", "</div></div>"), ("<div>", "</div>"), ("", ""), ("<table><tr><td>", "</td></tr></table>"), ("<div class='page'><section>", "</section></div>"),
    ("<article class='post'><header>", "</article>"), ("<article><header>", "</article>"), ("<div role='main'>", "</div>"), ("<div class='container'><div class='row'><div class='col'>", "</div></div></div>"), ("<div id='main'><div class='article-body'>", "</div></div>"), ("<main id='main' class='site-main'>", "</main>"), ("<section class='story'>", "</section>"), ("<div class='text'>", "</div>"),
)
#: Content.
CONTENT = (
    "<p><w40></p>", "<p><w25> <b><w2></b> <w12></p>", "<p><w15> <a href='/e'><w2></a> <w20></p>", "<p><w60></p>", "<p><w8></p>", "<h2><w4></h2>", "<ul><li><w12></li><li><w9></li></ul>", "<blockquote><w14></blockquote>", "<p><w18><br><w16></p>", "<h3><w3></h3>", "<ol><li><w14></li><li><w11></li></ol>", "<div><w30></div>", "<pre><w16></pre>", "<p><em><w6></em> <w22></p>", "<figure><figcaption><w9></figcaption></figure>", "<table><tr><th><w1></th><td><w6></td></tr></table>", "<dl><dt><w1></dt><dd><w9></dd></dl>",
)


def _filled(part: str, r: random.Random) -> str:
    word = lambda: "".join(r.choice("etaoinsrhldcumfpgwybv") for _ in range(r.randint(1, 9)))
    words = lambda n: " ".join(word() for _ in range(max(1, round(n * r.uniform(0.6, 1.5)))))
    links = lambda n: "".join(f"<li><a href='/{word()}'>{words(1.4)}</a></li>" for _ in range(max(2, round(n * r.uniform(0.7, 1.4)))))
    return re.sub(r"<([wl])(\d+)>", lambda m: words(int(m[2])) + ("." if int(m[2]) > 8 else "") if m[1] == "w" else links(int(m[2])), part)


def pages(n: int, seed: int, used=lambda k: True) -> list[str]:
    """`n` pages; of each list of parts those are used whose number passes. Half of the pages have a part in their content that is none."""
    r = random.Random(seed)
    some = lambda parts: [p for k, p in enumerate(parts) if used(k)]
    before, behind, within, holders = map(some, (BEFORE, BEHIND, WITHIN, HOLDERS))
    found = []
    for k in range(n):
        opened, closed = holders[k % len(holders)]
        blocks = [f"[[{r.choice(CONTENT)}]]" for _ in range(r.randint(3, 12))]
        title = "[[<h1><w6></h1>]]" + ("</header>" if opened.endswith("<header>") else "")
        if r.random() < 0.5:
            blocks.insert(r.randint(1, len(blocks)), r.choice(within))
        top, end = r.sample(before, r.randint(1, 4)), r.sample(behind, r.randint(1, 4))
        body = "".join([*top, opened, title, *blocks, closed, *end]).replace("]][[", "")
        found.append(f"<html><head><title><w5></title></head><body>{_filled(body, r)}</body></html>" if k % 4 else _filled(body, r))
    return found
