"""DuckDB SQL for the queries of this folder that SQL can express over whole tables."""

from __future__ import annotations

import math

from .licenses import NEAR, NOTICES, PHRASES, room
from .quality import ORACLE as QUALITY

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({of}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Strings of 200 bytes (400 hex digits) by their digest; those that start twice, merged to spans, and what is left.
SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, md5(substring(h, (2 * k + 1)::BIGINT, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM d)),
twice AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 200, true)::INT AS new FROM w SEMI JOIN twice USING (g)),
s AS (SELECT doc_id, n, min(k) AS s, max(k) + 200 AS e FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM r) GROUP BY doc_id, n),
gone AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM s GROUP BY doc_id),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b, s AS place FROM s UNION ALL SELECT doc_id, max(e), NULL, max(e) FROM s GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, (2 * a + 1)::BIGINT, (2 * (coalesce(b, length(h) // 2) - a))::BIGINT), '' ORDER BY place) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Windows of items against the windows of as many words of documents.
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(of=_LOWER)} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS.format(of=_LOWER)} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, item_id, k, n FROM dw JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _licenses(threshold: float = 0.8) -> str:
    """Phrases by word; and for each template the windows of blocks that hold enough of its words, the naming ones in order."""
    lists = lambda words: "[" + ", ".join(map(_quoted, words)) + "]"
    templates = ",\n".join(
        f"({k}, {_quoted(name)}, {lists(sorted(set(t.split())))}, {lists(names.split())}::VARCHAR[], {lists(other.split())}::VARCHAR[], {room(t)}, {math.ceil(threshold * len(set(t.split())) - 1e-9)})"
        for k, (name, t, names, other) in enumerate(NOTICES)
    )
    phrases = ", ".join(f"({lists(p.split())}, {_quoted(name)})" for p, name in PHRASES)
    follow = lambda k: f"CASE WHEN len(names) < {k} THEN c{k - 1} ELSE list_filter(held, lambda x: x.w = names[{k}] AND len(list_filter(c{k - 1}, lambda y: x.p > y.p AND x.p <= y.p + 2)) > 0) END AS c{k}"
    return rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(of=_LOWER)} AS ws, {_LOWER} AS low FROM documents),
phrase(pw, label) AS (VALUES {phrases}),
placed AS (SELECT doc_id, label, k - 1 AS p FROM (SELECT doc_id, ws, pw, label, unnest(list_filter(range(1, len(ws) + 1), lambda k: ws[k] = pw[1])) AS k FROM d, phrase WHERE list_contains(ws, 'license')) WHERE ws[k:k + len(pw) - 1] = pw),
base AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM placed GROUP BY doc_id),
t(k, label, tw, names, other, room, need) AS (VALUES {templates}),
b AS (SELECT doc_id, row_number() OVER () AS block, {_WORDS.format(of="part")} AS ws FROM (SELECT doc_id, unnest(string_split_regex(low, '\n[\x20\x09\x0B-\x0D]*\n')) AS part FROM d)),
m AS (SELECT doc_id, label, tw, names, other, room, need, list_filter(list_transform(range(1, len(ws) + 1), lambda i: {{'w': ws[i], 'p': i}}), lambda x: list_contains(tw, x.w) OR list_contains(other, x.w)) AS seq FROM b, t WHERE len(list_intersect(ws, tw)) >= need),
win AS (SELECT doc_id, label, tw, names, other, need, list_filter(seq, lambda y: y.p >= x.p AND y.p < x.p + room) AS held FROM (SELECT *, unnest(list_filter(seq, lambda x: list_contains(tw, x.w))) AS x FROM m)),
c1 AS (SELECT *, CASE WHEN len(names) = 0 THEN held ELSE list_filter(held, lambda x: x.w = names[1]) END AS c1, len(list_distinct(list_filter(list_transform(held, lambda x: x.w), lambda w: list_contains(tw, w)))) AS found FROM win),
c2 AS (SELECT *, {follow(2)} FROM c1 WHERE found >= need), c3 AS (SELECT *, {follow(3)} FROM c2), c4 AS (SELECT *, {follow(4)} FROM c3),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(found / len(tw)) AS best FROM c4 WHERE len(list_filter(c4, lambda x: len(list_filter(held, lambda y: list_contains(other, y.w) AND abs(y.p - x.p) <= {NEAR})) = 0)) > 0 GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


def _repair() -> str:
    """The damage by checksums bit by bit; then the cheapest edits as a fold over turns: cost and letters of the best way into each state."""
    ws = r"[\x20\x09-\x0D]"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20"
    way = lambda state, letter, cost: f"{{'c': s.{state}.c + {cost}, 'a': s.{state}.a || '{letter}'}}"
    when = lambda test, value: f"CASE WHEN {test} THEN {value} END"
    extra = "(CASE WHEN x.f = 1 THEN 3 ELSE 0 END)"
    best = lambda *ways: f"list_min([{', '.join(ways)}])"
    stays = "x.f < 2"
    kept = lambda role, *states: [when(f"{stays} AND x.r = '{role}'", way(k, "K", extra)) for k in states]
    named = lambda *states: [when(stays, way(k, "R", f"(3 + {extra})")) for k in states]
    n = {"p": best(way("p", "D", 4)), "q": best(way("q", "D", 4), *kept("s", "p")), "u": best(way("u", "D", 4), *kept("u", "p", "q", "a"), *named("p", "q", "a")), "a": best(way("a", "D", 4), *kept("a", "u"), *named("u"))}
    more = lambda of: f"{{'c': ({of}).c + 3, 'a': ({of}).a || 'I'}}"
    closed = lambda p, q, u, a: {"p": p, "q": q, "u": (to := best(u, more(p), more(q), more(a))), "a": best(a, more(to))}
    struct = lambda states, rest: "{" + ", ".join([*(f"'{k}': {v}" for k, v in states.items()), rest]) + "}"
    far, zero = "{'c': 1000000000::BIGINT, 'a': ''}", "{'c': 0::BIGINT, 'a': ''}"
    first = struct({"p": zero, "q": far, "u": "{'c': 3::BIGINT, 'a': 'I'}", "a": "{'c': 6::BIGINT, 'a': 'II'}"}, "'r': '', 'f': 0, 'role': '', 'text': ''")
    blank = struct(dict.fromkeys("pqua", far), "'r': role[1:1], 'f': f, 'role': role, 'text': text")
    given = "CASE WHEN z.k = 'u' THEN 'assistant' ELSE 'user' END"
    return f"""
WITH dk AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} AS k FROM conversations),
dm AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM dk WHERE k <> 0),
ft AS (SELECT *, regexp_replace(text, '{ws}+$', '') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM dm),
fl AS (SELECT *, CASE WHEN body = '' THEN 2 WHEN nth > 1 THEN 3 WHEN body[-1:] NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS f FROM ft),
cv AS (SELECT conv_id, list({blank} ORDER BY turn NULLS FIRST, role, md5(text), copy) AS ev, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 2) AS blank, count(*) FILTER (WHERE f = 3) AS dup, count(*) FILTER (WHERE f = 1) AS cut FROM fl GROUP BY 1),
dp AS (SELECT *, list_reduce(list_prepend({first}, ev), lambda s, x: {struct(closed(*n.values()), "'r': x.r, 'f': x.f, 'role': x.role, 'text': x.text")}) AS s FROM cv),
an AS (SELECT *, list_min([s.p, s.a]) AS best, len(list_filter(range(1, len(ev)), lambda k: ev[k].r || ev[k + 1].r NOT IN ('su', 'ua', 'au'))) AS illegal FROM dp),
rp AS (SELECT *, list_reduce(list_prepend({{'e': '', 'i': 0::BIGINT, 'k': 'p', 'o': []::VARCHAR[]}}, list_transform(list_filter(string_split(best.a, ''), lambda e: e <> ''), lambda e: {{'e': e, 'i': 0::BIGINT, 'k': '', 'o': []::VARCHAR[]}})), lambda z, x: {{'e': x.e, 'i': z.i + (x.e <> 'I')::BIGINT,
  'k': CASE WHEN x.e = 'D' THEN z.k WHEN x.e = 'K' THEN CASE ev[z.i + 1].r WHEN 's' THEN 'q' ELSE ev[z.i + 1].r END WHEN z.k = 'u' THEN 'a' ELSE 'u' END,
  'o': CASE x.e WHEN 'D' THEN z.o WHEN 'I' THEN list_append(z.o, {given} || ':') WHEN 'K' THEN list_append(z.o, ev[z.i + 1].role || ':' || ev[z.i + 1].text) ELSE list_append(z.o, {given} || ':' || ev[z.i + 1].text) END}}).o AS o FROM an)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate, coalesce(cut, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rp ON rp.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLES: dict[str, str] = {"op2_suffix_dedup": SUFFIX, "op6_quality_rules": QUALITY, "op7_benchmark_decontamination": CONTAMINATION, "op9_license_scans": _licenses(), "op12_conversation_repair": _repair()}
