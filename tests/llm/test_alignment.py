"""Alignment of tokenizers against a plain version: the libraries' own ids, groups by sets of ends, all pairs spelled out."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from collatio.llm import crossalign

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_R = random.Random(5)
_ALPHABET = ["the", "Étoile", "zu", " ", "  ", "\n", "\t", ".", ",", "'s", "12", "世界", "😀", "x̂", "<|endoftext|>", "<s>", "</s>", "<0x0A>", " ", "　", "=" * 70, "b" * 40, "\x00", "́"]
TEXTS = [None, "", " ", "  ", "a", "a ", "a▁b", "▁", "<|endoftext|>", "one two three", "one two three", "é" * 90, "=" * 2000, "ab" * 700 + " x", "word " * 3000, " \n \n", "﻿x"] + ["".join(_R.choices(_ALPHABET, k=_R.randint(1, 50))) for _ in range(150)]


def plain(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    letter = {chr(k if k in visible else next(hidden)): k for k in range(256)}
    found, docs = [], Counter()
    for _, text in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelt = [[bytes(letter[c] for c in a.id_to_token(k)) for k in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in ids[1] for p in [b.id_to_piece(k)]]]
        if not text or any(b"".join(x) != b" " + text.encode() for x in spelt):
            found.append(None)
            continue
        ends = []
        for words in spelt:
            at, own = 0, []
            for w in words:
                at += len(w)
                own.append(at)
            ends.append(own)
        cuts, groups, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for c in cuts:
            group = []
            for s in (0, 1):
                to = at[s]
                while to < len(ends[s]) and ends[s][to] <= c:
                    to += 1
                group.append(ids[s][at[s] : to])
                at[s] = to
            groups.append(group)
        links = [(x, y) for p, q in groups for x in p for y in q]
        docs.update(set(links))
        found.append((ids, groups, links))
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for (key, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        (x, y), groups, links = f
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((key, len(x), len(y), len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def listed(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


@pytest.fixture(scope="module")
def rows():
    return [(k if k % 11 else None, t) for k, t in enumerate(TEXTS)] + [(5, TEXTS[20])] * 3


@pytest.fixture(scope="module")
def expected(rows):
    return plain(rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1, "p") for i, t in rows], "doc_id long, text string, row string, id int, pairs string").repartition(3)


def test_alignment(spark, rows, expected):
    assert Counter(listed(crossalign.align(frame(spark, rows), A, B))) == Counter(expected)
    assert crossalign.align(frame(spark, []), A, B).collect() == []


@pytest.mark.parametrize("head", [0, 40])
def test_rare_pairs_are_joined(spark, rows, expected, monkeypatch, head):
    """The counts that are not broadcast give the same."""
    monkeypatch.setattr(crossalign, "HEAD", head)
    assert Counter(listed(crossalign.align(frame(spark, rows), A, B))) == Counter(expected)


def test_large_groups(monkeypatch):
    """Groups whose equal ids are counted first give the same pairs."""
    texts = [t.encode() for t in TEXTS if t]
    aligner = crossalign.Aligner.of(A, B)
    whole = aligner.align(texts)
    monkeypatch.setattr(crossalign, "SMALL_GROUP", 1)
    again = aligner.align(texts)
    assert [list(x) for x in whole["pairs"]] == [list(x) for x in again["pairs"]] and [list(x) for x in whole["links"]] == [list(x) for x in again["links"]]


def test_remembered_chunks_start_anew(monkeypatch):
    texts = [t.encode() for t in TEXTS if t]
    monkeypatch.setattr(crossalign, "MEMORY_PARTS", 3)
    small, usual = crossalign.Aligner(A, B), crossalign.Aligner.of(A, B)
    assert small.align(texts)["groups_sha256"] == usual.align(texts)["groups_sha256"]
