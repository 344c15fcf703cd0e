"""Alignment of two tokenizers over the same texts: groups between common token ends, and links within them.

A batch's texts are laid end to end, once as tokens of A and once as tokens of B. Where both end, groups
are cut; cumulated cuts give each token's group, and their differences at the documents' ends each
document's own figures. Only pairs of ids and their counts are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, small_batches, utf8, written
from .packing import byte_letters

#: Chunks whose ids a worker remembers, and their bytes; beyond either it starts anew.
MEMORY_PARTS, MEMORY_BYTES = 600_000, 16_000_000
#: Pairs of a group that are spelled out; in larger groups equal ids are counted first.
SMALL_GROUP = 64
#: Rows of the table of frequent pairs at most; they take some 16 MB.
HEAD = 1 << 19


class ByteLevel:
    """Ids of a byte-level tokenizer (file of the `tokenizers` library), special tokens in texts being plain text.

    Where the file is a plain byte pair model whose ids are in the order of its merges, the faster of two
    libraries encodes it; they give the same ids, and tokens spell every text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        told = json.loads(self.tokenizer.to_str())
        model, letters = told["model"], {c: b for b, c in enumerate(byte_letters())}
        special = {x["content"] for x in told["added_tokens"]}
        self.words = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.words[k] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.fast = self._plain(told, model, special)

    def _plain(self, told: dict, model: dict, special: set[str]):
        cut = told["pre_tokenizer"] or {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not told["normalizer"]
        if not usual or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [model["vocab"]["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        ranks = {w: k for k, w in enumerate(self.words) if w and w.decode("utf-8", "replace") not in special}
        #: Fixed value: the split of byte-level tokenizers.
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("a", pat_str=split, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """Ids of a `sentencepiece` model, by way of remembered ids of chunks.

    A chunk is a run of spaces and what follows up to the next. Where no piece has a space behind
    another character, pieces never reach over a chunk's end, and chunks are encoded by themselves.
    """

    CHUNK = re.compile(" *[^ ]+| +")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        #: The mark for a space, and bytes as pieces.
        self.words = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.size = 0

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Ids of a text with the space before it that the model adds, and whether its tokens spell it."""
        if not self.apart:
            ids = self.model.encode(text)
            return np.array(ids, np.uint32), self.spell(ids) == (" " + text).encode()
        if self.size > MEMORY_BYTES or len(self.known) > MEMORY_PARTS:
            self.known, self.odd, self.size = {}, set(), 0
        parts = self.CHUNK.findall(" " + text)
        try:
            ids = b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            self._learn(list(set(parts).difference(self.known)))
            ids = b"".join(map(self.known.__getitem__, parts))
        found = np.frombuffer(ids, "<u4")
        return found, not self.odd or self.odd.isdisjoint(parts) or self.spell(found.tolist()) == (" " + text).encode()

    def _learn(self, parts: list[str]) -> None:
        self.size += sum(map(len, parts))
        for part, ids in zip(parts, self.model.encode([p[1:] for p in parts], num_threads=1), strict=True):
            ids = ids if part != " " else [self.space]
            self.known[part] = np.array(ids, "<u4").tobytes()
            if self.spell(ids) != part.encode():
                self.odd.add(part)


class Aligner:
    """Both tokenizers with the lengths and decimal forms of their tokens."""

    held: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.sizes = [np.array([len(w) for w in x.words], np.int64) for x in (self.a, self.b)]
        self.width = len(self.b.words)
        decimal = [[str(k).encode() + end for k in range(len(x.words))] for x, ends in ((self.a, b",|"), (self.b, b",;")) for end in (ends[:1], ends[1:])]
        self.forms = [f for part in decimal for f in part]
        self.bases = np.cumsum([0, *(len(part) for part in decimal)])

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Aligner":
        """The one of this worker, which later tasks use again."""
        if (a_path, b_path) not in cls.held:
            cls.held[a_path, b_path] = cls(a_path, b_path)
        return cls.held[a_path, b_path]

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by A and B; none of a text that is empty or that tokens do not spell."""
        plain = text.decode()
        b, spelt = self.b.encode(plain) if plain else (None, False)
        if not spelt:
            return None
        a = self.a.encode(" " + plain)
        if not self.a.fast and b"".join(map(self.a.words.__getitem__, a.tolist())) != b" " + text:
            return None
        return a, b

    def align(self, texts: list[bytes]) -> dict[str, list]:
        """Figures of each text, and its pairs of linked ids (a * width + b) with the number of their links."""
        found = [self.tokens(t) for t in texts]
        own = [k for k, x in enumerate(found) if x is not None]
        out = {"n_a": [0] * len(texts), "n_b": [0] * len(texts), "n_groups": [0] * len(texts), "n_links": [0] * len(texts), "groups_sha256": [""] * len(texts), "pairs": [[]] * len(texts), "links": [[]] * len(texts)}
        if not own:
            return out
        sides = [np.concatenate([found[k][side] for k in own]).astype(np.int64) for side in (0, 1)]
        counts = [np.array([len(found[k][side]) for k in own]) for side in (0, 1)]
        ends = [np.cumsum(s[ids]) for s, ids in zip(self.sizes, sides, strict=True)]
        bounds = np.cumsum([0, *(len(texts[k]) + 1 for k in own)])
        cut = (np.bincount(ends[0], minlength=bounds[-1] + 1) > 0) & (np.bincount(ends[1], minlength=bounds[-1] + 1) > 0)
        before = np.cumsum(cut)  # cuts up to each place
        group = [before[e - 1] for e in ends]
        n = before[-1]
        size = [np.bincount(g, minlength=n) for g in group]
        of_doc = before[bounds]  # groups before each document
        links = np.concatenate([[0], np.cumsum(size[0] * size[1])])
        first = [np.concatenate([[0], np.cumsum(s)]) for s in size]
        digests = self._digests(sides, group, first, counts)
        pairs, times, places = self._pairs(sides, group, size, first, of_doc)
        for i, k in enumerate(own):
            at, to = of_doc[i], of_doc[i + 1]
            out["n_a"][k], out["n_b"][k], out["n_groups"][k], out["n_links"][k] = int(counts[0][i]), int(counts[1][i]), int(to - at), int(links[to] - links[at])
            out["groups_sha256"][k] = digests[i]
            out["pairs"][k], out["links"][k] = pairs[places[i] : places[i + 1]], times[places[i] : places[i + 1]]
        return out

    def _digests(self, sides, group, first, counts) -> list[str]:
        """SHA-256 of each document's groups as text: the tokens of both sides in the order of groups, each with the mark behind it."""
        places, codes = [], []
        for side in (0, 1):
            last = np.append(group[side][1:] != group[side][:-1], True)
            codes.append(sides[side] + self.bases[2 * side + last.astype(np.int64)])
            places.append(np.arange(len(sides[side])) + first[1 - side][group[side] + side])
        order = np.empty(len(places[0]) + len(places[1]), np.int64)
        for place, code in zip(places, codes, strict=True):
            order[place] = code
        forms, out, at = self.forms, [], 0
        for n in (counts[0] + counts[1]).tolist():
            out.append(hashlib.sha256(b"".join([forms[c] for c in order[at : at + n].tolist()])[:-1]).hexdigest())
            at += n
        return out

    def _pairs(self, sides, group, size, first, of_doc):
        """Distinct pairs of each document in order, how many links they have, and where each document's begin."""
        product, doc = size[0] * size[1], np.repeat(np.arange(len(of_doc) - 1), np.diff(of_doc))
        small = product <= SMALL_GROUP
        n = np.where(small, product, 0)
        g = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        a, b = sides[0][first[0][g] + nth // size[1][g]], sides[1][first[1][g] + nth % size[1][g]]
        span = len(self.a.words) * self.width
        keys = doc[g] * span + a * self.width + b
        keys.sort()
        weights = np.ones(len(keys), np.int64)
        if not small.all():
            more, times = [keys], [weights]
            for k in np.flatnonzero(~small).tolist():
                (x, nx), (y, ny) = (np.unique(sides[s][first[s][k] : first[s][k + 1]], return_counts=True) for s in (0, 1))
                more.append((doc[k] * span + x[:, None] * self.width + y).ravel())
                times.append((nx[:, None] * ny).ravel())
            keys, weights = np.concatenate(more), np.concatenate(times)
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], weights[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        times = np.add.reduceat(weights, begin) if len(begin) else weights
        keys = keys[begin]
        return (keys % span).astype(np.int32), times, np.searchsorted(keys, np.arange(len(of_doc)) * span)


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its figures and digest, `pairs` (a * width + b, distinct, in order) and `links`, how many each has.

    `row` tells rows apart within one run of the tasks, so the result must be written before use.
    """
    out = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in _FIGURES)]
        + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.IntegerType())), T.StructField("links", T.ArrayType(T.LongType()))]
    )
    types = {"pairs": pa.list_(pa.int32()), "links": pa.list_(pa.int64()), "groups_sha256": pa.string()}

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner.of(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches(rows):
            found = aligner.align(utf8(batch.column(1)))
            columns = [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), *(pa.array(v, types.get(n, pa.int64())) for n, v in found.items())]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(work, out)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """Of each linked pair of ids (over `linked` rows): `pair`, `count`, the documents that link it, and `best`, if no pair of its A id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    own = Window.partitionBy(F.floor(F.col("pair") / width))  # an A id has at most `width` pairs
    return counts.withColumn("best", F.col("count") == F.max("count").over(own))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligns tokenizers A (byte level) and B (pieces) over each document; one row per document.

    `n_best` and `count_sum` take each link by its pair's count over all documents. Texts that are null or
    empty, or that the tokens do not spell, have no tokens: zeros and an empty digest. Repeated rows, also
    with the same or a null id, count each; a tie for the best counts for all. An empty table gives no rows.
    Other columns are left out, whatever their names. A very long text is worked through whole; it takes
    memory for its tokens and its distinct pairs.

    The counts of frequent pairs, `HEAD` of them at most, are broadcast; documents' other pairs are joined with
    theirs by a shuffle. A bound on counts, from a histogram, parts the two.
    """
    width = len(Aligner.of(a_path, b_path).b.words)
    first = written(linked(docs, a_path, b_path, id_col, text_col), "linked")
    counts = written(pair_counts(first, width), "pair-counts")
    level = F.floor(F.log2("count")).cast("int")
    histogram = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)  # a row a power of two
    held, bound = 0, 64
    for k, n in histogram:
        if held + n > HEAD:
            break
        held, bound = held + n, k
    entries = first.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.links").alias("links"))
    head = counts.filter(level >= bound)
    sums = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    found = sums(entries.join(F.broadcast(head), "pair"))
    if any(k < bound for k, _ in histogram):
        rare = entries.join(F.broadcast(head.select("pair")), "pair", "left_anti")
        found = sums(rare.join(counts.filter(level < bound).hint("merge"), "pair")).unionByName(found).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return first.drop("pairs", "links").join(found, "row", "left").select(F.col("id").alias(id_col), *_FIGURES, zero("n_best"), zero("count_sum"), "groups_sha256")
