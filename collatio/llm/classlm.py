"""Class-based n-gram scores: exchange clustering, class transitions and word emissions.

Words have to be known to every task that meets them, and their number grows with the corpus. So texts
are first written as blocks of some hundred thousand tokens, numbered by the block's own words. Each
block tells the buckets of its words (by hash) how often it holds them, and learns each word's place in
its bucket and its count. From then on block and buckets speak of places. What a task holds is a block
or a bucket, never the vocabulary; only sums over classes, whose number is fixed, go to all tasks.

A round of the exchange moves every word at once to the class that fits best what stands before and
behind it, by the class transitions so far. As words that move together can make things worse, each
assignment's likelihood is taken, and the best assignment is the one kept.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, discard, small_batches, utf8, written

#: Tokens of a block, and words (counted once a block) of a bucket.
BLOCK, BUCKET = 400_000, 600_000
#: Words whose classes are weighed at once.
ROWS = 16_384
END = b"\n"  # no word, as words hold no white space
_BLOCK = "block long, held array<boolean>, lens array<int>, last int, seq binary, hashes binary, train binary, n_words long"
_LOG = logging.getLogger(__name__)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2**63-1, in as many bytes as the largest needs, byte by byte apart, compressed."""
    from zstandard import ZstdCompressor

    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.int32 if data[0] < 4 else np.int64)


def _pack_rising(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0))


def _unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.int64)


class _Builder:
    def __init__(self):
        self.ids, self.held, self.seqs, self.known, self.tokens = [], [], [], {END: 0}, 0

    def add(self, doc_id: object, held: bool, text: bytes) -> None:
        words, known = text.lower().split(), self.known
        words.append(END)
        for w in set(words).difference(known):
            known[w] = len(known)
        self.ids.append(doc_id), self.held.append(held)
        self.seqs.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.tokens += len(words)

    def row(self, block: int) -> tuple:
        """Words are numbered by their hash's order, so a bucket's words are neighbours."""
        from xxhash import xxh3_64_intdigest

        hashes = np.fromiter(map(xxh3_64_intdigest, self.known), np.uint64, len(self.known))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        lens = np.array([len(s) for s in self.seqs])
        seq = place[np.concatenate(self.seqs)]
        train = np.bincount(seq[np.repeat(~np.array(self.held), lens)], minlength=len(order))
        return block, self.ids, self.held, lens.tolist(), int(place[0]), _pack(seq), hashes[order].tobytes(), _pack(train), len(order)


def blocks_of(docs: DataFrame, fold: int, id_col: str, text_col: str, size: int = BLOCK) -> DataFrame:
    """Blocks of tokenised documents; those whose crc32 of the id modulo `fold` is 0 are held out (a null id is taken as an empty text)."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % fold == 0
    fields = T._parse_datatype_string(_BLOCK).fields
    out = T.StructType([fields[0], T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *fields[1:]])

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, builder = TaskContext.get().partitionId() << 32, 0, _Builder()
        id_type = None

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(builder.row(first + made), types, strict=True)], names=out.names)

        for batch in batches(rows):
            id_type = batch.schema.field(0).type
            for doc_id, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                builder.add(doc_id, own, text)
                if builder.tokens >= size:
                    yield flush()
                    made, builder = made + 1, _Builder()
        if builder.ids:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), held.alias("held"), F.col(text_col).cast("string").alias(text_col)).mapInArrow(build, out)


def _slices(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the buckets that hold the words."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    values, at = np.unique(bucket, return_index=True)
    return list(zip(values.tolist(), at.tolist(), [*at[1:].tolist(), len(hashes)], strict=True))


def _rows(columns: list[tuple], types: tuple, names: list[str]) -> pa.Table:
    columns = list(zip(*columns, strict=True)) or [()] * len(types)
    return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)


def _each(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows of a batch, one at a time, as a block is large."""
    for r in range(batch.num_rows):
        yield {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}


def _ask(bits: int):
    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for row in _each(batch):
                hashes, train = np.frombuffer(row["hashes"], np.uint64), _unpack(row["train"])
                made = [(b, row["block"], hashes[i:j].tobytes(), _pack(train[i:j])) for b, i, j in _slices(hashes, bits)]
                yield from _rows(made, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), ["bucket", "block", "hashes", "train"]).to_batches(max_chunksize=256)

    return ask


_COUNTS = "block long, bucket long, places binary, counts binary, n long, v long, top array<struct<c:long,h:long,place:int>>"


def _count(most: int):
    """A bucket's words: the place of each sent one among the distinct ones by hash, and its count."""
    top_type = pa.list_(pa.struct([("c", pa.int64()), ("h", pa.int64()), ("place", pa.int32())]))
    types, names = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), top_type), ["block", "bucket", "places", "counts", "n", "v", "top"]

    def count(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        distinct, place = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([_unpack(x) for x in table["train"].to_pylist()]))
        bucket, made, at = table["bucket"][0].as_py(), [], 0
        best = np.lexsort((distinct, -total))[:most]
        top = [{"c": int(total[k]), "h": int(distinct[k].view(np.int64)), "place": int(k)} for k in best if total[k]]
        for block, h in zip(table["block"].to_pylist(), sent, strict=True):
            own = place[at : at + len(h)]
            made.append((block, bucket, _pack_rising(own), _pack(total[own]), int(total.sum()) if not at else 0, int((total > 0).sum()) if not at else 0, top if not at else []))
            at += len(h)
        return _rows(made, types, names)

    return count


_LINKED = "last int, seq binary, buckets array<long>, places array<binary>, counts binary"


def _link(own: pa.Table, answers: pa.Table) -> pa.Table:
    """A block with what the buckets answered: their numbers in order, the places of its words there, and counts."""
    order = np.argsort(answers["bucket"].to_numpy()).tolist()
    answered = lambda name: [answers[name][k].as_py() for k in order]
    columns = {"buckets": pa.array([answered("bucket")], pa.list_(pa.int64())), "places": pa.array([answered("places")], pa.list_(pa.binary())), "counts": pa.array([_pack(np.concatenate([_unpack(x) for x in answered("counts")]))], pa.binary())}
    for name, column in columns.items():
        own = own.append_column(name, column)
    return own


def _bigrams(seq: np.ndarray, lens: np.ndarray, use: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(word before, word) of each token of the documents to use; before the first word stands the end."""
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[np.cumsum(lens) - lens] = end
    mask = np.repeat(use, lens)
    return before[mask], seq[mask]


def _contexts(row: dict, cls: np.ndarray, k: int) -> list[tuple]:
    """What a block sends: for each bucket, how often which class stands behind and before each word; for bucket -1, transitions."""
    lens, held = np.array(row["lens"]), np.array(row["held"])
    a, b = _bigrams(_unpack(row["seq"]).astype(np.int32), lens, ~held, row["last"])
    ca, cb = cls[a], cls[b]
    seen = np.concatenate([a.astype(np.int64) * 2 * k + cb, b.astype(np.int64) * 2 * k + k + ca])
    del a, b
    seen.sort()
    first = np.flatnonzero(np.diff(seen, prepend=-1))
    cells, n = seen[first], np.diff(first, append=len(seen))
    made, at = [(-1, row["block"], b"", b"", np.bincount(ca * k + cb, minlength=k * k).astype(np.int64).tobytes())], 0
    for bucket, packed in zip(row["buckets"], row["places"], strict=True):
        end = at + len(_unpack(packed))
        lo, hi = np.searchsorted(cells, (at * 2 * k, end * 2 * k))
        made.append((bucket, row["block"], packed, _pack_rising(cells[lo:hi] - at * 2 * k), _pack(n[lo:hi])))
        at = end
    return made


_SENT = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
_SENT_NAMES = ["bucket", "block", "places", "cells", "n"]
_SENT_SQL = "bucket long, block long, places binary, cells binary, n binary"


def _best(cells: np.ndarray, n: np.ndarray, words: int, k: int, logs: np.ndarray, log_size: np.ndarray) -> np.ndarray:
    """The class that fits each word best, from how often (`n`) its contexts (`cells`, rising) are seen; `k` for words without any."""
    best = np.full(words, k, np.uint8)
    for lo in range(0, words, ROWS):
        i, j = np.searchsorted(cells, (lo * 2 * k, (lo + ROWS) * 2 * k))
        fits = np.zeros((min(ROWS, words - lo), 2 * k))
        fits.ravel()[cells[i:j] - lo * 2 * k] = n[i:j]
        behind, before = fits[:, :k], fits[:, k:]
        times = before.sum(axis=1)
        score = behind @ logs.T + before @ logs - times[:, None] * log_size[None, :]
        best[lo : lo + ROWS] = np.where(times > 0, np.argmax(score, axis=1), k)
    return best


def _assign(k: int, logs: np.ndarray, log_size: np.ndarray):
    """A bucket moves each of its words to the class that fits best."""

    def assign(table: pa.Table) -> pa.Table:
        places = [_unpack_rising(x) for x in table["places"].to_pylist()]
        words = 1 + max(int(p[-1]) for p in places)
        cells, n = [], []
        for k_, own in enumerate(places):
            row, column = np.divmod(_unpack_rising(table["cells"][k_].as_py()), 2 * k)
            cells.append(own[row] * 2 * k + column)
            n.append(_unpack(table["n"][k_].as_py()))
        cells, n = np.concatenate(cells), np.concatenate(n).astype(np.int64)
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], n[order]
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        best = _best(cells[first], np.add.reduceat(n, first) if len(first) else n, words, k, logs, log_size)
        bucket = table["bucket"][0].as_py()
        made = [(block, bucket, best[own].tobytes()) for block, own in zip(table["block"].to_pylist(), places, strict=True)]
        return _rows(made, (pa.int64(), pa.int64(), pa.binary()), ["block", "bucket", "cls"])

    return assign


def _joined(table: pa.Table) -> np.ndarray:
    """A block's classes in the order of its words."""
    order = np.argsort(table["bucket"].to_numpy())
    return np.frombuffer(b"".join(table["cls"][int(k)].as_py() for k in order), np.uint8)


def _seeded(row: dict, seeds: dict[int, list[tuple[int, int]]], k: int) -> np.ndarray:
    """The first classes of a block's words: one for each of the most frequent, the last for all others."""
    cls = []
    for bucket, packed in zip(row["buckets"], row["places"], strict=True):
        own = _unpack_rising(packed)
        part = np.full(len(own), k - 1, np.int64)
        for place, c in seeds.get(bucket, ()):
            at = int(np.searchsorted(own, place))
            if at < len(own) and own[at] == place:
                part[at] = c
        cls.append(part)
    return np.concatenate(cls)


def _transitions(sent: DataFrame, column: str, k: int) -> np.ndarray:
    """The sum of the blocks' transition counts: first in 64 groups of blocks, then of those."""

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches(rows):
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    rows = sent.select(F.col(column).alias("n")).mapInArrow(add, "n binary").repartition(64).mapInArrow(add, "n binary").collect()
    return sum((np.frombuffer(r[0], np.int64) for r in rows), np.zeros(k * k, np.int64)).reshape(k, k)


def likelihood(transitions: np.ndarray) -> float:
    """The part of the training log likelihood that depends on the classes, in nats."""
    log = lambda x: float(np.sum(x * np.log(np.maximum(x, 1))))
    return log(transitions) - log(transitions.sum(axis=0)) - log(transitions.sum(axis=1))


def scores(docs: DataFrame, classes: int = 32, rounds: int = 3, weight: float = 0.9, fold: int = 10, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`.

    The model is learnt from the documents that are not held out. A word seen there has P(w | before) =
    weight * (1 - u) * P(class of w | class before) * P(w | class of w) + (1 - weight) * the smoothed unigram
    of `base_score`; all others share u, the unigram's probability of an unseen word, so the sum over words
    is one. Behind an unseen word, classes come by their overall frequency. Words are told apart
    by a 64-bit hash; counts have 64 bits. Null texts count as empty (one end token); a null id is held out.
    Repeated rows are scored each. An empty table gives no rows; with nothing to learn from, every token is
    equally likely. A text of any length stands in one block. Columns but the id and the text are left out,
    whatever their names. The likelihood of each round goes to this module's log.
    """
    k = classes
    blocks = written(blocks_of(docs, fold, id_col, text_col, block), "blocks")
    n_blocks, words = (x or 0 for x in blocks.agg(F.count(F.lit(1)), F.sum("n_words")).first())
    bits = max(6, int(np.ceil(np.log2(max(1, words / BUCKET)))))
    # As many partitions as keep a task at some blocks or buckets, where the session's number would not.
    dealt = lambda df, key, n: df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
    by_block = lambda df: dealt(df, "block", n_blocks // 8).groupBy("block")
    by_bucket = lambda df: dealt(df, "bucket", 1 << bits).groupBy("bucket")
    asked = blocks.select("block", "hashes", "train").mapInArrow(_ask(bits), "bucket long, block long, hashes binary, train binary")
    counts = written(by_bucket(asked).applyInArrow(_count(k - 1), _COUNTS), "counts")
    n_train, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.sum("v")).first())
    top = counts.select("bucket", F.explode("top").alias("t")).select("bucket", "t.*").orderBy(F.desc("c"), "h").limit(k - 1).collect()
    seeds: dict[int, list[tuple[int, int]]] = {}
    for c, r in enumerate(top):
        seeds.setdefault(r["bucket"], []).append((r["place"], c))
    kept = blocks.select("block", "ids", "held", "lens", "last", "seq")
    fields = [*kept.schema.fields, *T._parse_datatype_string(_LINKED).fields[2:]]
    linked = written(by_block(kept).cogroup(by_block(counts.select("block", "bucket", "places", "counts"))).applyInArrow(_link, T.StructType(fields)), "linked")
    discard(blocks, counts)

    def first_round(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for row in _each(batch):
                yield from _rows(_contexts(row, _seeded(row, seeds, k), k), _SENT, _SENT_NAMES).to_batches(max_chunksize=256)

    def next_round(own: pa.Table, answers: pa.Table) -> pa.Table:
        return _rows(_contexts(next(_each(own)), _joined(answers).astype(np.int64), k), _SENT, _SENT_NAMES)

    def settle(own: pa.Table, answers: pa.Table) -> pa.Table:
        row, cls = next(_each(own.select(["held", "lens", "last", "seq"]))), _joined(answers)
        a, b = _bigrams(_unpack(row["seq"]), np.array(row["lens"]), ~np.array(row["held"]), row["last"])
        m = np.bincount(cls[a].astype(np.int64) * k + cls[b], minlength=k * k).astype(np.int64)
        return own.append_column("cls", pa.array([cls.tobytes()], pa.binary())).append_column("m", pa.array([m.tobytes()], pa.binary()))

    inner = linked.select("block", "held", "lens", "last", "seq", "buckets", "places")
    final = linked.select("block", "ids", "held", "lens", "last", "seq", "counts")
    settled_type = T.StructType([*final.schema.fields, *T._parse_datatype_string("cls binary, m binary").fields])
    settling = lambda by: written(by_block(final).cogroup(by_block(by)).applyInArrow(settle, settled_type), "settled")
    answers, best, most = None, None, 0.0
    for turn in range(rounds):
        sent = inner.mapInArrow(first_round, _SENT_SQL) if answers is None else by_block(inner).cogroup(by_block(answers)).applyInArrow(next_round, _SENT_SQL)
        sent = written(sent, "contexts")
        transitions = _transitions(sent.filter("bucket = -1"), "n", k)
        logs, log_size, _ = _model(transitions, k)
        _LOG.info("assignment %d: log likelihood %.1f", turn, likelihood(transitions))
        if answers is not None and (best is None or likelihood(transitions) > most):
            best, most, worse = answers, likelihood(transitions), best
        else:
            worse = answers
        answers = written(by_bucket(sent.filter("bucket >= 0")).applyInArrow(_assign(k, logs, log_size), "block long, bucket long, cls binary"), "classes")
        discard(sent, *([worse] if worse else []))
    settled = settling(answers)
    transitions = _transitions(settled, "m", k)
    _LOG.info("assignment %d: log likelihood %.1f", rounds, likelihood(transitions))
    if best is not None and most > likelihood(transitions):
        discard(settled)
        settled = settling(best)
        transitions = _transitions(settled, "m", k)
    discard(linked, answers, *([best] if best else []))
    logs, log_size, share = _model(transitions, k)
    follow = np.vstack([np.exp(logs), share])  # behind an unseen word: by frequency
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = 0.1 / (n_train + 0.1 * (distinct + 1))
        for batch in batches(rows):
            for r, row in enumerate(_each(batch.select([n for n in batch.schema.names if n != "ids"]))):
                seq, lens, held = _unpack(row["seq"]), np.array(row["lens"]), np.array(row["held"])
                cls, total = np.frombuffer(row["cls"], np.uint8).astype(np.int64), _unpack(row["counts"])
                unigram = (total + 0.1) / (n_train + 0.1 * (distinct + 1))
                emitted = np.where(cls < k, total / np.exp(log_size)[np.minimum(cls, k - 1)], 0.0)
                before, word = _bigrams(seq, lens, np.ones(len(lens), bool), row["last"])
                p = weight * (1 - unseen) * follow[cls[before], np.minimum(cls[word], k - 1)] * emitted[word] + (1 - weight) * unigram[word]
                p = np.where(total[word] > 0, p, unseen)
                starts = np.cumsum(lens) - lens
                add = lambda x, s=starts: pa.array(np.add.reduceat(x, s))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[r].values, pa.array(held), pa.array(lens.astype(np.int64)), add((total > 0)[seq].astype(np.int64)), pa.array(np.full(len(lens), n_train, np.int64)), add(np.log10(unigram)[seq]), add(np.log10(p))], names=out.names)

    return settled.select("ids", "held", "lens", "last", "seq", "cls", "counts").mapInArrow(score, out)


def _model(transitions: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of a class behind a class (smoothed), log size of each class, and each class's share."""
    size = transitions.sum(axis=0)
    share = (size + 0.1) / (size.sum() + 0.1 * k)
    logs = np.log((transitions + share[None, :]) / (transitions.sum(axis=1, keepdims=True) + 1))
    return logs, np.log(np.maximum(size, 1)), share
