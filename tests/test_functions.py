"""Scalar functions on unit vectors."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from collatio.functions import digests, providers, text
from collatio.functions.align import difference, forward


def one(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("v"))).collect()]


def test_normalize(spark):
    decomposed = "Cafe\u0301\r\nb\rc"
    assert one(spark, [decomposed, "plain", None], text.normalize_technical) == [unicodedata.normalize("NFC", "Caf\u00e9\nb\nc"), "plain", None]


def test_words(spark):
    found = one(spark, ["don't stop", "don\u2019t 'quoted' rock'n'roll'", "", "A1 \u00e9t\u00e9 -- 2nd"], text.words)
    assert found == [["don't", "stop"], ["don't", "quoted", "rock'n'roll"], [], ["A1", "\u00e9t\u00e9", "2nd"]]


def test_space_tokens_and_trim(spark):
    assert one(spark, ["  a\u00a0b\tc\n", ""], text.space_tokens) == [["a", "b", "c"], []]
    assert one(spark, ["\u00a0 a b \n"], text.trim_unicode) == ["a b"]


def test_refusals(spark):
    assert one(spark, ["I CANNOT provide it", "I can\u2019t quote", "can't quote", "a Copyright note", "fine"], text.looks_like_refusal) == [True, False, True, True, False]


def test_labels(spark):
    rows = spark.createDataFrame([("Acts", 1, 2, None), ("Acts", 1, 2, 2), ("Acts", 1, 2, 4)], "b string, c int, s int, e int")
    assert [r[0] for r in rows.select(text.ref_label(*(F.col(k) for k in "bcse"))).collect()] == ["Acts 1:2", "Acts 1:2", "Acts 1:2-4"]


def test_money_and_escapes(spark):
    assert one(spark, [0, 1_234_567_890, 999], text.euros, "long") == ["EUR 0.000000", "EUR 1.234567", "EUR 0.000000"]
    assert one(spark, ["a|b<&>"], text.escape_html) == ["a|b&lt;&amp;&gt;"]
    assert one(spark, ["a|b"], text.escape_table) == ["a\\|b"]
    assert one(spark, ["</script>&"], text.script_safe) == ["\\u003c/script\\u003e\\u0026"]
    assert one(spark, [0.12345], text.percent, "double") == ["12.35%"] or one(spark, [0.12345], text.percent, "double") == ["12.34%"]


def test_rate(spark):
    rows = spark.createDataFrame([(0, 0), (3, 0), (1, 4)], "e int, n int")
    assert [r[0] for r in rows.select(text.rate(F.col("e"), F.col("n"))).collect()] == [0.0, 1.0, 0.25]


def traceback(want, got):
    """Counts by walking back over the full table of costs."""
    cost = [[max(i, j) if not i or not j else 0 for j in range(len(got) + 1)] for i in range(len(want) + 1)]
    for i in range(1, len(want) + 1):
        for j in range(1, len(got) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (want[i - 1] != got[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, n, mask = len(want), len(got), [0, 0, 0], 0
    while i or j:
        if i and j and want[i - 1] == got[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
            mask |= 1 << j
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            n[2] += 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            n[1] += 1
        else:
            j -= 1
            n[0] += 1
    return (*n, mask)


def test_alignment():
    assert forward(list("ABC"), ["A", "changed", "C", "extra"])[:3] == (1, 0, 1)
    r = random.Random(4)
    for _ in range(3000):
        a, b = (r.choices("abcd", k=r.randint(0, 9)) for _ in "ab")
        assert forward(a, b) == traceback(a, b)


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [("one two three", "one four three more", "one [-two][+four] three [+more]"), ("one two", "", "[-one] [-two]"), ("", "one", "[+one]"), ("one two", "one", "one [-two]")],
)
def test_difference(left, right, expected):
    assert difference(left, right) == expected


def test_word_distance(spark):
    r = random.Random(6)
    pairs = [([*map(str, r.choices(range(6), k=r.randint(0, 8)))], [*map(str, r.choices(range(6), k=r.randint(0, 8)))]) for _ in range(60)] + [("a b c".split(), "a x c d".split())]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a array<string>, b array<string>").orderBy("k")
    found = [x[0] for x in rows.select(text.word_distance(F.col("a"), F.col("b"))).collect()]
    assert found == [sum(forward(a, b)[:3]) for a, b in pairs]
    assert found[-1] == 2


def test_contiguous(spark):
    rows = spark.createDataFrame([("a b c".split(), "b c".split()), ("a b c".split(), "a b c".split()), ("ab c d".split(), "b c".split()), (["a"], [])], "h array<string>, n array<string>")
    assert [r[0] for r in rows.select(text.contains_contiguous(F.col("h"), F.col("n"))).collect()] == [True, False, False, False]


def test_digests(spark):
    import hashlib

    rows = spark.createDataFrame([(1, "x"), (0, "y")], "o int, v string")
    assert digests.ordered_digest(rows, F.to_json(F.struct("v")), F.col("o"), lines=True).first()[0] == hashlib.sha256(b'{"v":"y"}\n{"v":"x"}\n').hexdigest()
    assert digests.ordered_digest(rows, F.to_json(F.struct("v")), F.col("o")).first()[0] == hashlib.sha256(b'[{"v":"y"},{"v":"x"}]').hexdigest()
    assert rows.select(digests.deterministic_key("s", "p", F.col("v"))).first()[0] == hashlib.sha256(b"s\0p\0x").hexdigest()


def test_provider_answers(spark):
    assert one(spark, ['{"output":[{"content":[{"type":"output_text","text":"a"},{"type":"x","text":"no"}]},{"content":[{"type":"refusal","refusal":"b"}]}]}', '{"content":[{"type":"text","text":"a"}]}', "{}"], providers.answer_text) == ["ab", "a", None]
    u = one(spark, ['{"usage":{"input_tokens":1,"cache_read_input_tokens":2,"output_tokens":3},"stop_reason":"max_tokens"}', "{}"], providers.usage)
    assert (int(u[0].input_tokens), int(u[0].output_tokens), u[0].truncated, u[0].refusal) == (3, 3, True, False)
    assert (u[1].input_tokens, u[1].truncated) == (None, False)
