"""Word alignment: operation counts, matched output words, and an annotated difference.

Ties on the optimal path go, from the end, to match, substitution, deletion, insertion. What a cell's
predecessor is depends on neighbouring costs only, so counts are carried forward in two rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def shared_end(left: list, right: list) -> int:
    """Equal words at the end of both, which every path here matches."""
    n = 0
    while n < min(len(left), len(right)) and left[-1 - n] == right[-1 - n]:
        n += 1
    return n


def forward(expected: list, actual: list) -> tuple[int, int, int, int]:
    """(insertions, deletions, substitutions, mask of matched output words)."""
    if same := shared_end(expected, actual):
        n, d, s, mask = forward(expected[:-same], actual[:-same])
        return n, d, s, mask | ((1 << same) - 1) << (len(actual) - same)
    row = [(j, j, 0, 0, 0) for j in range(len(actual) + 1)]  # cost, insertions, deletions, substitutions, matches
    for i, want in enumerate(expected, 1):
        above, row = row, [(i, 0, i, 0, 0)]
        for j, got in enumerate(actual, 1):
            diagonal, up, left = above[j - 1], above[j], row[j - 1]
            if want == got:
                c, n, d, s, m = diagonal
                row.append((c, n, d, s, m | 1 << (j - 1)))
                continue
            best = 1 + min(diagonal[0], up[0], left[0])
            if best == diagonal[0] + 1:
                _, n, d, s, m = diagonal
                row.append((best, n, d, s + 1, m))
            elif best == up[0] + 1:
                _, n, d, s, m = up
                row.append((best, n, d + 1, s, m))
            else:
                _, n, d, s, m = left
                row.append((best, n + 1, d, s, m))
    return row[-1][1:]


_COUNTS = T.StructType([T.StructField(n, T.ArrayType(T.LongType()) if n == "distances" else T.LongType()) for n in ("insertions", "deletions", "substitutions", "distances", "unmatched", "explained")])


@pandas_udf(_COUNTS)
def align(expected: pd.Series, actual: pd.Series, others: pd.Series) -> pd.DataFrame:
    """Counts against the expected words; distance to each other list; output words that the expected text does
    not explain, and how many of those one of the others does. A null expected list gives nulls."""
    out = []
    for want, got, rest in zip(expected, actual, others, strict=True):
        if want is None:
            out.append((None,) * 6)
            continue
        got = list(got)
        n, d, s, mask = forward(list(want), got)
        distances, union = [], 0
        for other in rest:
            a, b, c, m = forward(list(other), got)
            distances.append(a + b + c)
            union |= m
        missed = ~mask & ((1 << len(got)) - 1)
        out.append((n, d, s, distances, missed.bit_count(), (missed & union).bit_count()))
    names = ["insertions", "deletions", "substitutions", "distances", "unmatched", "explained"]
    frame = pd.DataFrame(out, columns=names)
    for name in names:
        if name != "distances":
            frame[name] = frame[name].astype("Int64")
    return frame


def difference(expected: str, output: str) -> str:
    """White-space tokens with `[-gone]`, `[+new]`; equal tokens at the path's end always match."""
    left, right = expected.split(), output.split()
    same = shared_end(left, right)
    tail = left[len(left) - same :]
    left, right = left[: len(left) - same], right[: len(right) - same]
    cost = [list(range(len(right) + 1))]
    for i, a in enumerate(left, 1):
        row = [i]
        for j, b in enumerate(right, 1):
            row.append(min(cost[i - 1][j - 1] + (a != b), cost[i - 1][j] + 1, row[j - 1] + 1))
        cost.append(row)
    i, j, out = len(left), len(right), []
    while i or j:
        if i and j and left[i - 1] == right[j - 1]:
            i, j = i - 1, j - 1
            out.append(left[i])
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(f"[-{left[i]}][+{right[j]}]")
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(f"[-{left[i]}]")
        else:
            j -= 1
            out.append(f"[+{right[j]}]")
    return " ".join([*reversed(out), *tail])


@pandas_udf(T.StringType())
def word_diff(expected: pd.Series, output: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else difference(a, b) for a, b in zip(expected, output, strict=True)])


class _Runs:
    """Every run of words in a list, as an automaton whose states know the first place where their runs end."""

    def __init__(self, text: list):
        self.next: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [-1]
        last = 0
        for at, word in enumerate(text):
            now, p = self._state(self.length[last] + 1, at, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            elif self.length[q := self.next[p][word]] == self.length[p] + 1:
                self.link[now] = q
            else:
                copy = self._state(self.length[p] + 1, self.ends[q], dict(self.next[q]))
                self.link[copy] = self.link[q]
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                self.link[q] = self.link[now] = copy
            last = now

    def _state(self, length: int, end: int, steps: dict) -> int:
        self.next.append(steps)
        self.link.append(0)
        self.length.append(length)
        self.ends.append(end)
        return len(self.next) - 1

    def longest(self, other: list) -> tuple[int, int, int]:
        """Where the longest common run begins in `other` and in the list, and its length: the first in `other`, then in the list."""
        best, state, n = (0, 0, 0), 0, 0
        for at, word in enumerate(other):
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            if n > best[2]:
                best = (at - n + 1, self.ends[state] - n + 1, n)
        return best


def common_runs(left: list, right: list) -> list[tuple[int, int, int]]:
    """The longest common run, then those to its left and right, and so on: (begin left, begin right, length) in order."""
    out, open_ = [], [(0, len(left), 0, len(right))]
    while open_:
        a, b, c, d = open_.pop()
        if a == b or c == d:
            continue
        i, j, n = _Runs(right[c:d]).longest(left[a:b])
        if n:
            out.append((a + i, c + j, n))
            open_ += [(a, a + i, c, c + j), (a + i + n, b, c + j + n, d)]
    return sorted(out)


def changed_words(expected: str, output: str) -> tuple[list[tuple[str, bool]], list[tuple[str, bool]]]:
    """White-space tokens of both, each with whether it stands outside of the common runs. For display; scores go by edits."""
    left, right = expected.split(), output.split()
    same: tuple[set[int], set[int]] = (set(), set())
    for i, j, n in common_runs(left, right):
        same[0].update(range(i, i + n))
        same[1].update(range(j, j + n))
    return [(w, k not in same[0]) for k, w in enumerate(left)], [(w, k not in same[1]) for k, w in enumerate(right)]


_SIDE = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("changed", T.BooleanType())]))


@pandas_udf(T.StructType([T.StructField("expected", _SIDE), T.StructField("output", _SIDE)]))
def display_alignment(expected: pd.Series, output: pd.Series) -> pd.DataFrame:
    """Both texts' tokens with marks for what changed; null where either is."""
    sides = [(None, None) if a is None or b is None else changed_words(a, b) for a, b in zip(expected, output, strict=True)]
    named = lambda side: None if side is None else [{"word": w, "changed": c} for w, c in side]
    return pd.DataFrame({"expected": [named(a) for a, _ in sides], "output": [named(b) for _, b in sides]})
