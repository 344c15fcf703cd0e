"""Plain single-machine versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from xxhash import xxh64_intdigest

SP = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pieces(text: str | None, tokenizer, capacity: int = 2048) -> list[tuple]:
    ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
    return [(k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]


def repeats(texts: list[str | None], width: int = 200) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    own = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + width] for t in own for i in range(len(t) - width + 1))
    out = []
    for t in own:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def quality(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = re.findall(SP, text)
    lines = [x for x in text.split("\n") if re.search(SP, x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    many = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(many)


def contamination(text: str | None, items: list[tuple[object, str | None]]) -> tuple:
    """(n_words, n_hit, n_items, items_sha256)."""
    words, hit, found = re.findall(ALNUM, lower(text or "")), set(), set()
    for item, t in items:
        own = re.findall(ALNUM, lower(t or ""))
        for k in range(max(1, len(own) - 9) if own else 0):
            window = own[k : k + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found)))


def secrets(text: str | None) -> tuple:
    """(n_assign, n_access, n_hex, base_sha256)."""
    text, spans = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)))


def licenses(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels)."""
    words, places, labels = re.findall(ALNUM, lower(text or "")), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        own = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_windows(text: str, notices, room, near: int, threshold: float) -> set:
    """Labels of the notices of which a window of a block holds enough, and that it names; every place of every block is tried."""
    labels = set()
    for block in re.split(r"\n[\x20\x09\x0B-\x0D]*\n", text):
        words = re.findall(ALNUM, lower(block))
        for label, notice, names, other in notices:
            own = set(notice.split())
            for i in range(len(words)):
                window = words[i : i + room(notice)]
                if words[i] not in own or len(own & set(window)) < threshold * len(own) - 1e-9:
                    continue
                ends = None
                for name in names.split():
                    ends = [k for k, w in enumerate(window) if w == name and (ends is None or any(0 < k - e <= 2 for e in ends))]
                against = [k for k, w in enumerate(window) if w in other.split()]
                if any(all(abs(k - e) > near for k in against) for e in ends):
                    labels.add(label)
    return labels


def simhash(text: str | None) -> int:
    words = re.findall(SP, lower(text or ""))
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list, prints: list[int], most: int = 4) -> list:
    parent = list(range(len(ids)))

    def find(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    least: dict = {}
    for k, x in enumerate(ids):
        if x is not None:
            r = find(k)
            least[r] = min(x, least.get(r, x))
    return [least.get(find(k)) for k in range(len(ids))]


def class_scores(texts: list[str | None], held: list[bool], hashes, classes: int, rounds: int, weight: float) -> list[float]:
    """Scores of the class model, word by word over plain lists: exchange from the most frequent words' classes, the likeliest assignment kept."""
    import math

    docs = [re.findall(SP, lower(t or "")) + ["\n"] for t in texts]
    train = [d for d, h in zip(docs, held, strict=True) if not h]
    counts = Counter(w for d in train for w in d)
    n, v = sum(counts.values()), len(counts)
    order = sorted(counts, key=lambda w: (-counts[w], hashes(w)))[: classes - 1]
    cls = {w: order.index(w) if w in order else classes - 1 for w in counts}
    pairs = Counter((a, b) for d in train for a, b in zip(["\n", *d], d, strict=False))

    def table(cls):
        found = [[0] * classes for _ in range(classes)]
        for (a, b), m in pairs.items():
            found[cls[a]][cls[b]] += m
        size = [sum(row[c] for row in found) for c in range(classes)]
        share = [(s + 0.1) / (sum(size) + 0.1 * classes) for s in size]
        logs = [[math.log((found[a][b] + share[b]) / (sum(found[a]) + 1)) for b in range(classes)] for a in range(classes)]
        ln = lambda x: x * math.log(x) if x else 0.0
        fit = sum(ln(x) for row in found for x in row) - sum(map(ln, size)) - sum(ln(sum(row)) for row in found)
        return size, share, logs, fit

    tried = []
    for _ in range(rounds):
        size, _, logs, _ = table(cls)
        scores = {w: [-counts[w] * math.log(max(size[c], 1)) for c in range(classes)] for w in counts}
        for (a, b), m in pairs.items():
            for c in range(classes):
                scores[a][c] += m * logs[c][cls[b]]
                scores[b][c] += m * logs[cls[a]][c]
        cls = {w: max(range(classes), key=lambda c: (round(scores[w][c], 9), -c)) for w in counts}
        tried.append((table(cls)[3], -len(tried), cls))
    cls = max(tried, key=lambda x: (x[0], x[1]))[2]
    size, share, logs, _ = table(cls)
    unseen, found = 0.1 / (n + 0.1 * (v + 1)), []
    for d in docs:
        total = 0.0
        for a, b in zip(["\n", *d], d, strict=False):
            if not counts[b]:
                total += math.log10(unseen)
                continue
            follow = math.exp(logs[cls[a]][cls[b]]) if a in cls else share[cls[b]]
            total += math.log10(weight * (1 - unseen) * follow * counts[b] / size[cls[b]] + (1 - weight) * (counts[b] + 0.1) / (n + 0.1 * (v + 1)))
        found.append(total)
    return found
