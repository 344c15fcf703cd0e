"""Token counts that follow edits.

A document keeps the pre-token segments of its text in leaves, and over the leaves a tree of sums
(characters and tokens). An edit finds its leaves by descending the tree; only these, and neighbours
as far as the cuts beside the edit need context, are encoded again, and the sums above are updated.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, small_batches, utf8

#: Unicode's white space. No pre-token goes from other characters on to white space, so a text may be cut there.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_SPACE = re.compile(f"[{SPACE}]")
#: Segments of a leaf, and segments whose counts a worker remembers (about 110 bytes each).
LEAF, MEMORY = 64, 700_000


class Counter:
    """Tokens of segments by a byte-level tokenizer's ranks."""

    held: dict[str, "Counter"] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding, self.known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Counter":
        if path not in cls.held:
            cls.held[path] = cls(path, pattern)
        return cls.held[path]

    def leaves(self, text: str, wanted: int = 0) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf of a text; in `wanted` leaves, where they would have from half to twice the usual segments."""
        segments, known = _SEGMENT.findall(text), self.known
        if len(known) > MEMORY:
            known.clear()
        for s in set(segments).difference(known):
            known[s] = len(self.encoding.encode_ordinary(s))
        if not segments:
            return [], []
        if wanted and wanted * LEAF <= 2 * len(segments) <= 4 * wanted * LEAF:
            starts = np.arange(wanted) * len(segments) // wanted
        else:
            starts = np.arange(0, len(segments), LEAF)
        chars = np.add.reduceat(np.fromiter(map(len, segments), np.int64, len(segments)), starts)
        tokens = np.add.reduceat(np.fromiter(map(known.__getitem__, segments), np.int64, len(segments)), starts)
        return chars.tolist(), tokens.tolist()


@dataclass
class Tree:
    """Sums over leaves: level 0 has the leaves, the last level has one node."""

    chars: list[list[int]]
    tokens: list[list[int]]

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> "Tree":
        self = cls([list(chars)], [list(tokens)])
        for levels in (self.chars, self.tokens):
            while len(levels[-1]) > 1:
                below = levels[-1]
                levels.append([sum(below[k : k + 2]) for k in range(0, len(below), 2)])
        return self

    @classmethod
    def opened(cls, leaves: int, chars: np.ndarray, tokens: np.ndarray) -> "Tree":
        """A tree from its nodes, level after level, as `nodes` gives them."""
        sizes = [leaves]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // 2))
        cut = np.cumsum(sizes)[:-1]
        return cls(*([x.tolist() for x in np.split(values, cut)] for values in (chars, tokens)))

    def nodes(self) -> tuple[int, list[int], list[int]]:
        """How many leaves, and the nodes of both sums from the leaves up."""
        return len(self.chars[0]), [x for level in self.chars for x in level], [x for level in self.tokens for x in level]

    @property
    def total(self) -> int:
        return sum(self.tokens[-1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins; the last one for the text's end."""
        k = begin = 0
        for level in range(len(self.chars) - 1, 0, -1):
            k *= 2
            below = self.chars[level - 1]
            if k + 1 < len(below) and place >= begin + below[k]:
                begin += below[k]
                k += 1
        return k, begin

    def replace(self, first: int, end: int, chars: list[int], tokens: list[int]) -> None:
        """New leaves in the place of some. As many new ones change the sums above them only; else later nodes move."""
        for levels, new in ((self.chars, chars), (self.tokens, tokens)):
            same = len(new) == end - first
            levels[0][first:end] = new
            lo, hi = first, end if same else len(levels[0])
            for level in range(1, 64):
                if len(levels[level - 1]) <= 1:
                    del levels[level:]
                    break
                below, lo, hi = levels[level - 1], lo // 2, -(-hi // 2)
                if level == len(levels):
                    levels.append([])
                hi = min(hi, -(-len(below) // 2)) if same else -(-len(below) // 2)
                levels[level][lo : hi if same else None] = [sum(below[2 * k : 2 * k + 2]) for k in range(lo, hi)]


def edit(text: str, tree: Tree, edits: list[tuple[int, int, str]], counter: Counter) -> tuple[str, int]:
    """Applies edits (start, end, new text; sorted, in characters of `text`, not overlapping) from the last
    to the first. Returns the new text and how many characters were encoded again; the tree is changed."""
    again = 0
    while edits:
        start, stop, _ = edits[-1]
        if not tree.chars[0]:
            first, begin, end, till = 0, 0, 0, 0
        else:
            first, begin = tree.leaf_at(start)
            last, till = tree.leaf_at(max(start, stop - 1))
            end, till = last + 1, till + tree.chars[0][last]
        own = [edits.pop()]
        while edits and edits[-1][1] > begin:  # further edits of the same leaves
            own.append(edits.pop())
            if own[-1][0] < begin:
                first, begin = tree.leaf_at(own[-1][0])
        new = text[begin:till]
        for a, b, put in own:
            new = new[: a - begin] + put + new[b - begin :]
        while first and not (new and _SPACE.match(new) and not _SPACE.match(text[begin - 1])):  # context before
            first -= 1
            begin -= tree.chars[0][first]
            new = text[begin : begin + tree.chars[0][first]] + new
        while end < len(tree.chars[0]) and (not new or _SPACE.match(new[-1]) or not _SPACE.match(text[till])):  # and behind
            new += text[till : till + tree.chars[0][end]]
            till += tree.chars[0][end]
            end += 1
        while edits and edits[-1][1] > begin:  # edits in the leaves that came in as context
            a, b, put = edits.pop()
            if a < begin:
                first, at = tree.leaf_at(a)
                new, begin = text[at:begin] + new, at
            new = new[: a - begin] + put + new[b - begin :]
            while first and not (new and _SPACE.match(new) and not _SPACE.match(text[begin - 1])):
                first -= 1
                begin -= tree.chars[0][first]
                new = text[begin : begin + tree.chars[0][first]] + new
        tree.replace(first, end, *counter.leaves(new, end - first))
        text = text[:begin] + new + text[till:]
        again += len(new)
    return text, again


_STATE = "text string, leaves int, node_chars array<int>, node_tokens array<int>, n_tokens long"
_TYPES = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())


def counted(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's state: `text`, its tree (how many leaves, and the characters and tokens of all nodes, level after level) and `n_tokens`.

    A null text counts as empty: no leaves, no tokens. Repeated rows have a state each, an empty table gives no
    rows, and texts of any length are counted whole. Other columns are left out, whatever their names.
    """
    out = T.StructType([docs.schema[id_col], *T._parse_datatype_string(_STATE).fields])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer, pattern)
        for batch in batches(rows):
            texts = [t.decode("utf-8", "replace") for t in utf8(batch.column(1))]
            found = [Tree.of(*counter.leaves(t)) for t in texts]
            columns = zip(*((t, *tree.nodes(), tree.total) for t, tree in zip(texts, found, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True))], names=out.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(count, out)


def edited(state: DataFrame, edits: Column, tokenizer: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The state after `edits` (array of start, end, value: sorted, not overlapping, in characters), with
    `n_before`, `n_edits` and `n_reencoded` (characters encoded again).

    Null or no edits leave a state as it is: such rows pass without being opened. Repeated rows are edited
    each, an empty table gives no rows. Further columns of `state` are left out, whatever their names.
    """
    out = T.StructType([state.schema[id_col], *T._parse_datatype_string(f"{_STATE}, n_before long, n_edits long, n_reencoded long").fields])

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer, pattern)
        for batch in batches(rows):
            n_edits = batch.column(6).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows_, found = np.flatnonzero(n_edits), []
            again = np.zeros(batch.num_rows, np.int64)
            for r in rows_.tolist():
                text, leaves, chars, tokens, _, own = (batch.column(c)[r] for c in range(1, 7))
                tree = Tree.opened(leaves.as_py(), chars.values.to_numpy(), tokens.values.to_numpy())
                text, again[r] = edit(text.as_py(), tree, [(e["start"], e["end"], e["value"]) for e in own.as_py()], counter)
                found.append((text, *tree.nodes(), tree.total))
            place = np.arange(batch.num_rows)
            place[rows_] = batch.num_rows + np.arange(len(rows_))
            new = list(zip(*found, strict=True)) or [()] * len(_TYPES)
            columns = [pa.concat_arrays([batch.column(k + 1), pa.array(x, t)]).take(pa.array(place)) for k, (x, t) in enumerate(zip(new, _TYPES, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(5), pa.array(n_edits), pa.array(again)], names=out.names)

    small_batches(state.sparkSession)
    return state.select(id_col, "text", "leaves", "node_chars", "node_tokens", "n_tokens", edits.alias("edits")).mapInArrow(apply, out)
