"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 q)`` words that no
neighbouring word extends. The dictionary names, for each power of two ``w``, the factor of ``w`` words
at every place, so that equal factors of one document have equal names: those of ``2 w`` words
are pairs of names. Factors that stand once are left out of all longer ones. The successor of a
factor is its next occurrence. Where it lies at most ``2 w`` words on, successors at one distance
from places side by side are an arithmetic progression, which proposes that distance as
a period of the words it covers; long enough ones are extended to both sides and deduplicated.

Every run is found: let ``w`` be the power of two with ``q <= w < 2 q``. A factor of ``w`` words inside the run
covers a whole period, so it recurs exactly ``q`` words on, and the progression of these covers the run,
whose ``4 q`` words are more than ``w + q``. A proposed multiple of ``q`` covers the same
stretch and goes when stretches are deduplicated.

Documents are read in slabs of words; names hold the document's number, and an end mark that
occurs once follows every document, so nothing is found across two. Work is done in place,
without a shuffle; a slab has at most ``SLAB`` words, or one document.

Defined results: a null or empty text has no words and no runs. A null ``doc_id`` has no checksum and
its words are left as they are. Rows are read one by one, so repeated rows repeat; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import paired

LEAST = 6
TIMES = 4
SLAB = 1 << 20
"""Words read together."""


# --- planted repeats --------------------------------------------------------


def with_repeats(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words, of which one document in ten has its end replaced by a repeat.

    Which one, from where and how long follows from the checksum of its id.
    """
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


# --- the dictionary ---------------------------------------------------------


def _factors(names: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per power of two its length, and the places and successors of all factors that recur."""
    at, key, width = np.arange(len(names)), names, 1
    while len(at):
        order = np.argsort(key, kind="stable")  # equal factors side by side, by place
        same = key[order[1:]] == key[order[:-1]]
        place = at[order]
        yield width, place[:-1][same], place[1:][same]
        recurs = np.zeros(len(at), dtype=bool)
        recurs[1:] = same
        recurs[:-1] |= same
        group = np.cumsum(np.r_[True, ~same]) if len(at) else recurs
        name = np.full(len(names), -1)
        name[place[recurs]] = group[recurs]
        at = np.flatnonzero(name[: max(0, len(names) - width)] >= 0)
        at = at[name[at + width] >= 0]
        key = name[at] * (len(names) + 1) + name[at + width]
        width *= 2


def _progressions(
    place: np.ndarray, successor: np.ndarray, width: int, least: int, times: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(period, start, stop)`` of the words that progressions of near successors cover."""
    step = successor - place
    near = step <= 2 * width
    place, step = place[near], step[near]
    order = np.lexsort((place, step))
    place, step = place[order], step[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (step[1:] != step[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(place))[1:] - 1
    period, start = step[first], place[first]
    stop = place[last] + period + width
    long = stop - start >= np.maximum(least, times * period)
    return period[long], start[long], stop[long]


def _extended(names: np.ndarray, period: int, start: int, stop: int) -> tuple[int, int]:
    """The longest stretch around ``start..stop`` that keeps the period."""
    width = 1
    while start:
        low = max(0, start - width)
        differ = np.flatnonzero(names[low:start] != names[low + period : start + period])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, width = low, 2 * width
    width = 1
    while stop < len(names):
        high = min(len(names), stop + width)
        differ = np.flatnonzero(names[stop:high] != names[stop - period : high - period])
        if len(differ):
            stop += int(differ[0])
            break
        stop, width = high, 2 * width
    return start, stop


def find_runs(names: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """``start, length, period`` of every run, by start and then period.

    ``names`` are numbers from 0, equal where words are.
    """
    least_period: dict[tuple[int, int], int] = {}
    found: dict[int, list[tuple[int, int]]] = {}
    for width, place, successor in _factors(names):
        for period, start, stop in zip(
            *(c.tolist() for c in _progressions(place, successor, width, least, times)), strict=True
        ):
            held = found.setdefault(period, [])
            if held and held[-1][0] <= start and stop <= held[-1][1]:
                continue  # this one was extended before
            run = _extended(names, period, start, stop)
            held.append(run)
            least_period[run] = min(period, least_period.get(run, period))
    runs = sorted((a, q, b) for (a, b), q in least_period.items())
    return np.array([(a, b - a, q) for a, q, b in runs], dtype=np.int64).reshape(-1, 3)


# --- documents --------------------------------------------------------------


@dataclass
class Repeats:
    """What one document's runs are, and its words without their repeats."""

    runs: list[tuple[int, int, int]]
    collapsed: bytes

    def best(self) -> tuple[int, int, int, int] | tuple[None, ...]:
        """Start, length, period and exponent of the run that repeats most often."""
        if not self.runs:
            return (None,) * 4
        start, length, period = min(self.runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        return start, length, period, 1000 * length // period

    def listed(self) -> bytes:
        return b"".join(b"%d,%d,%d\n" % r for r in self.runs)


def read_slab(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[Repeats]:
    """The runs of each list of words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1  # an end mark behind every document
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    flat = np.empty(len(doc), dtype=object)
    flat[:] = [w for t in texts for w in (*t, None)]
    codes, _ = pd.factorize(flat)
    ends = first + sizes
    codes[ends] = codes.max(initial=-1) + 1
    names = codes * len(texts) + doc
    runs = find_runs(names, least, times)
    owner = doc[runs[:, 0]]
    drop = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(drop) > 0
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, words in enumerate(texts):
        own = runs[cuts[k] : cuts[k + 1]]
        if len(own):
            left = gone[first[k] : ends[k]].tolist()
            words = [w for w, g in zip(words, left, strict=True) if not g]
        held = [(a - int(first[k]), size, q) for a, size, q in own.tolist()]
        out.append(Repeats(held, b" ".join(words)))
    return out


def _slabs(
    batches: Iterator[pa.RecordBatch], repeats: bool, size: int
) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """Ids and words of at most ``size`` words together, or of one document."""
    for batch in batches:
        for ids, texts in paired(iter([batch])):
            words: list[list[bytes]] = []
            low, total = 0, 0
            for k, (doc, text) in enumerate(zip(ids.to_pylist(), texts, strict=True)):
                own = with_repeats(text.split(), doc) if repeats else text.split()
                if words and total + len(own) > size:
                    yield ids[low:k], words
                    words, low, total = [], k, 0
                words.append(own)
                total += len(own)
            if words:
                yield ids[low:], words


def periodic_runs(
    docs: DataFrame,
    repeats: bool = False,
    least: int = LEAST,
    times: int = TIMES,
    size: int = SLAB,
) -> DataFrame:
    """``doc_id, runs, n_runs, start, length, period, exponent_milli, collapsed`` per document.

    ``runs`` lists all runs as ``start,length,period`` lines by start and period, the four numbers are of the one with most
    repetitions, and ``collapsed`` is the text with one period of each run, words joined by one
    blank. With ``repeats`` the words are first changed by ``with_repeats``.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    numbers = ["start", "length", "period", "exponent_milli"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in _slabs(batches, repeats, size):
            found = read_slab(words, least, times)
            best = list(zip(*(r.best() for r in found), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([r.listed() for r in found], pa.binary()),
                    pa.array([len(r.runs) for r in found], pa.int64()),
                    *[pa.array(c, pa.int64()) for c in best],
                    pa.array([r.collapsed for r in found], pa.binary()),
                ],
                ["doc_id", "runs", "n_runs", *numbers, "collapsed"],
            )

    schema = ", ".join(f"{n} long" for n in ["n_runs", *numbers])
    return docs.select("doc_id", "text").mapInArrow(
        read, f"doc_id {id_type}, runs binary, {schema}, collapsed binary"
    )


def digest(found: DataFrame) -> DataFrame:
    """``periodic_runs`` with the lists and texts as checksums."""
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2("runs", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
