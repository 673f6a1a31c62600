"""Brute-force versions of the corpus operators, on plain rows ``(doc_id, text)``."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict

import xxhash

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc is None, doc))
    out = Counter()
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, m in enumerate(members):
            out[(m[2], members[0][2], len(members), k == 0, sha(norm))] += 1
    return out


def lines(rows, width=3):
    """Rows with unique ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        held = (text or "").split("\n")
        gone = set()
        for p in range(len(held) - width + 1):
            window = tuple(held[p : p + width])
            if window in seen:
                gone |= set(range(p, p + width))
            seen.add(window)
        left = "\n".join(x for p, x in enumerate(held) if p not in gone)
        spans = sum(p - 1 not in gone for p in gone)
        out[doc] = (len(held), len(gone), spans, left)
    return out


def licences(rows, phrases):
    out = []
    for doc, text in rows:
        held, at = words(text), []
        for label, phrase in phrases:
            size = len(phrase)
            at += [(p, label) for p in range(len(held) - size + 1) if held[p : p + size] == phrase]
        places = [p for p, _ in at]
        labels = ",".join(sorted({label for _, label in at}))
        out.append(
            (doc, len(held), len(at), min(places, default=None), max(places, default=None), labels)
        )
    return out


def licence_labels(text, templates, slack):
    """Labels of all templates whose phrases stand near enough to their places."""
    held, found = words(text), set()

    def places(phrase):
        return [p for p in range(len(held) - len(phrase) + 1) if held[p : p + len(phrase)] == phrase]

    for label, phrases in templates:
        (first, phrase), *others = phrases
        for start in places(phrase):
            wanted = [(start + place - first, other) for place, other in others]
            if all(any(abs(p - at) <= slack for p in places(other)) for at, other in wanted):
                found.add(label)
    return ",".join(sorted(found))


def contamination(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        held = words(text)
        size = min(width, len(held))
        for p in range(len(held) - size + 1 if held else 0):
            windows[tuple(held[p : p + size])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        held, hit, named = words(text), set(), set()
        for size in sizes:
            for p in range(len(held) - size + 1):
                found = windows.get(tuple(held[p : p + size]))
                if found:
                    hit |= set(range(p, p + size))
                    named |= found
        out.append((doc, len(held), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)))
    return out


def repeats(rows, length=50):
    """Rows with unique ids."""
    first: dict[bytes, int] = {}
    out = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first.setdefault(data[p : p + length], doc) < doc:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = bytes(gone).count(b"\0\1") + (gone[:1] == b"\1")
        out[doc] = (len(data), sum(gone), spans, sha(left))
    return out


def simhash(text, size=3):
    held = TOKEN.findall((text or "").translate(FOLD))
    if not held:
        return 0
    grams = [" ".join(held[p : p + size]) for p in range(max(1, len(held) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict):
    """fingerprint -> group number, linking those within three bits."""
    todo, group, number = set(prints), {}, 0
    while todo:
        edge = [todo.pop()]
        number += 1
        while edge:
            at = edge.pop()
            group[at] = number
            near = {p for p in todo if (p ^ at).bit_count() <= 3}
            todo -= near
            edge += near
    return group


def base_scores(rows, modulus=7, held=2):
    def tokens(text):
        return [*TOKEN.findall((text or "").translate(FOLD)), ""]

    def out_of(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % modulus == held

    counts = Counter(t for doc, text in rows if not out_of(doc) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [
        (
            doc,
            out_of(doc),
            len(tokens(text)),
            sum(counts[t] > 0 for t in tokens(text)),
            n,
            sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(text)),
        )
        for doc, text in rows
    ]


# --- repeats, curve packing, spelling ---------------------------------------


def repeated(text, doc):
    """The words, the end of one document in ten replaced by a repeat."""
    held = TOKEN.findall(text or "")
    n = len(held)
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        held = [w if i < a else held[a + (i - a) % p] for i, w in enumerate(held)]
    return held


def stretches(held, least=6, times=4):
    """``start, length, period`` of every run, period by period."""
    n, found = len(held), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and held[j] == held[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rows):
    out = Counter()
    for doc, text in rows:
        held = repeated(text, doc)
        runs = stretches(held)
        gone = {i for a, size, q in runs for i in range(a + q, a + size)}
        best = (None,) * 4
        if runs:
            start, size, q = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
            best = (start, size, q, 1000 * size // q)
        listed = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
        left = " ".join(w for i, w in enumerate(held) if i not in gone)
        out[(doc, len(runs), *best, sha(listed), sha(left))] += 1
    return out


LETTER_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def vocabulary(rows, length=6, times=5, modulus=199):
    counts = Counter()
    for doc, text in rows:
        for run in LETTER_RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % modulus == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= times and len(w) >= length}


def variants(words, ratio=5):
    """``word -> n, n_near, form, form_n, root`` by trying every edit of every word."""
    letters = sorted({c for w in words for c in w})
    form, rows = {}, {}
    for w, n in words.items():
        near = {w[:i] + w[i + 1 :] for i in range(len(w))}
        near |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near = (near & words.keys()) - {w}
        best = min(near, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] < ratio * n:
            best = None
        form[w] = best
        rows[w] = (n, len(near), best, words.get(best))
    out = {}
    for w, row in rows.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (*row, root)
    return out


# --- context mixing ---------------------------------------------------------


class ContextMixing:
    """Codes a text bit by bit, with the contexts' counts taken from the training texts."""

    BITS = {1: 8, 2: 12, 3: 14, 4: 15}

    def __init__(self, training, mixers):
        self.mixers = mixers
        self.follow = defaultdict(Counter)
        for text in training:
            for before, symbol in self.symbols(text):
                for order in self.BITS:
                    self.follow[order, self.cell(before, order)][symbol] += 1

    @staticmethod
    def symbols(text):
        whole = b"\xff" * 4 + (text or "").translate(FOLD).encode() + b"\xff"
        return [(whole[i - 4 : i], whole[i]) for i in range(4, len(whole))]

    def cell(self, before, order):
        number = int.from_bytes(before[4 - order :], "big")
        if self.BITS[order] == 8 * order:
            return number
        return (number * 0x9E3779B97F4A7C15 % 2**64) >> (64 - self.BITS[order])

    @staticmethod
    def kind(byte):
        if byte == 255:
            return 0
        if byte >= 192:
            return 7
        if byte >= 128:
            return 6
        c = chr(byte)
        if c in " \t\n\r\x0b\f":
            return 1
        if c in "aeiou":
            return 2
        return 3 if "a" <= c <= "z" else 4 if "0" <= c <= "9" else 5

    def score(self, text):
        totals = [0.0, 0.0]
        for before, symbol in self.symbols(text):
            counts = [self.follow[o, self.cell(before, o)] for o in self.BITS]
            low, width, node = 0, 256, 1
            for depth in range(8):
                half = width // 2
                turn = symbol >= low + half
                odds = []
                for c in counts:
                    zero = sum(n for b, n in c.items() if low <= b < low + half) + 0.4
                    one = sum(n for b, n in c.items() if low + half <= b < low + width) + 0.4
                    odds.append(max(-12, min(12, math.log(one / zero))))
                for k, gate in enumerate((node, self.kind(before[-1]) * 8 + depth)):
                    mixer = self.mixers[k]
                    mixed = sum(w * x for w, x in zip(mixer.weights[gate], odds, strict=True))
                    mixed = max(-12, min(12, mixed))
                    bucket = round((max(-8, min(8, mixed)) + 8) * 2)
                    p = (1 / (1 + math.exp(-mixed)) + mixer.table[node][bucket]) / 2
                    p = max(1e-6, min(1 - 1e-6, p))
                    totals[k] += math.log(p if turn else 1 - p)
                node = 2 * node + turn
                low, width = low + half * turn, half
        top = max(totals)
        return (top + math.log(sum(math.exp(t - top) for t in totals) / 2)) / math.log(10)
