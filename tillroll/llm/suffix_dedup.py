"""Removal of repeated 50-byte strings by interval expansion on a Burrows-Wheeler transform.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller ``doc_id``. Strings are judged on the input.

1. *Anchors.* A string of 50 bytes holds 31 cores of 20 bytes; the one of least hash
   (the first of equals) is its anchor. Equal strings have equal anchors at the same
   place, and about one byte in sixteen is an anchor. A first pass finds the anchors that
   stand in more than one document, in blocks of hashes, and leaves a filter of fixed size.
2. *Windows.* A second pass emits, for each anchor that passes the filter, the 80 bytes
   around it: all strings that can have it as anchor. A window whose equal stands in a smaller
   document read before by the same task is covered as a whole, so of many copies few
   are emitted. A window that a document repeats is emitted once per document and slab, with its
   places; places at most 50 bytes apart are one run, so a run of one byte is one row. Windows meet in
   buckets by anchor. An anchor of more than ``HOT`` documents
   would make a bucket too large: its windows are cut to their 31 strings, each of which
   goes to the bucket of its own hash.
3. *Intervals.* A bucket's windows, aligned at their anchors, are transformed column by
   column from the right. The order by the suffix from column ``k`` is the stable partition,
   by the byte in column ``k``, of the order from ``k + 1``: one backward extension of all
   intervals at once. The common prefix of neighbours grows by one, from the minimum
   over the rows between them before, and stops at 50. Rows between two smaller values form the
   interval of one string; it is removed from the rows above its least document.
4. *Spans* go back to their documents, which lose the bytes.

The filter only saves work: what passes it wrongly finds no equal string.

Defined results: a null or empty text, and any of under 50 bytes, loses nothing. A null
``doc_id`` is neither smaller nor larger than any, so its row loses nothing and removes
nothing. Equal ids remove nothing from each other; rows that are the same in id and text lose
the same bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tillroll.llm.common import body, stage_table, texts_of
from tillroll.operators.numbering import number_rows

LENGTH = 50
CORE = 20
SIDE = LENGTH - CORE
WINDOW = LENGTH + SIDE
PAD = 0xFF  # in no UTF-8 text
HOT = 1 << 18
FILTER_BITS, HOT_BITS = 27, 23
BLOCK_BYTES = 16 << 20
"""Text per block of anchor hashes, at most on average."""

SLAB = 1 << 20
"""Bytes of text whose anchors are found at once."""

FLUSH = 1 << 19
"""Anchors that a task holds at most before it lets them go."""

BUNDLE = 1 << 16
"""Windows that travel as one row per bucket."""

REMEMBERED = 1 << 18
"""Windows that a task remembers at most; more of them save some equal ones a way."""


# --- anchors ----------------------------------------------------------------


def _mix(x: np.ndarray, factor: int, shift: int) -> np.ndarray:
    x = x * np.uint64(factor)
    return x ^ (x >> np.uint64(shift))


def _eights(raw: bytes, offset: int, count: int) -> np.ndarray:
    """Eight bytes from every place, as numbers."""
    return np.ndarray((count,), dtype="<u8", buffer=raw, offset=offset, strides=(1,))


@dataclass
class Part:
    """A piece of a text, long enough for the windows of the strings that start in it at
    ``low..high``; ``offset`` is its place in the text."""

    text: int
    offset: int
    data: bytes
    low: int
    high: int


def parts(texts: list[bytes], size: int | None = None) -> Iterator[list[Part]]:
    """All strings of all texts, as pieces of about ``size`` bytes in all. A text of under
    ``LENGTH`` bytes has none; a long text is cut, and every string starts in one piece."""
    size = size or SLAB
    held: list[Part] = []
    total = 0
    for number, text in enumerate(texts):
        strings = len(text) - LENGTH + 1
        for start in range(0, max(0, strings), size):
            stop = min(start + size, strings)
            low, high = max(0, start - WINDOW), min(len(text), stop + LENGTH + WINDOW)
            held.append(Part(number, low, text[low:high], start - low, stop - low))
            total += high - low
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def anchors(held: list[Part]) -> tuple[np.ndarray, ...]:
    """``(buffer, hash, text number, place in the text, place in the buffer)`` of all anchors."""
    gap = bytes([PAD]) * SIDE
    raw = gap + b"".join(p.data + gap for p in held) + bytes(64)
    count = len(raw) - 64
    hashes = _mix(_eights(raw, 0, count), 0x9E3779B97F4A7C15, 29)
    hashes = _mix(hashes + _eights(raw, 8, count), 0xBF58476D1CE4E5B9, 31)
    hashes = _mix(hashes + _eights(raw, CORE - 8, count), 0x94D049BB133111EB, 30)
    # least hash by its upper half, and the first of equals: the place stands in the lower half
    half = np.uint64(32)
    least = (hashes >> half << half) | np.arange(count, dtype=np.uint64)
    width, cores = 1, SIDE + 1
    while width * 2 <= cores:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < cores:
        least = np.minimum(least[: width - cores], least[cores - width :])
    sizes = np.array([len(p.data) for p in held], dtype=np.int64)
    offsets = SIDE + np.cumsum(sizes + SIDE) - sizes - SIDE
    starts = np.zeros(len(least) + 1, dtype=np.int64)
    np.add.at(starts, offsets + [p.low for p in held], 1)
    np.add.at(starts, offsets + [p.high for p in held], -1)
    inside = np.cumsum(starts[:-1]) > 0
    chosen = np.zeros(count, dtype=bool)
    chosen[(least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    piece = np.searchsorted(offsets, at, side="right") - 1
    text = np.array([p.text for p in held], dtype=np.int64)[piece]
    place = at - offsets[piece] + np.array([p.offset for p in held], dtype=np.int64)[piece]
    # anchors have small hashes; mixed once more they fill the range again
    return np.frombuffer(raw, dtype=np.uint8), _mix(hashes[at], 0xA24BAED4963EE407, 32), text, place, at


# --- the filter -------------------------------------------------------------


def _within(rest: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits, inside its block of ``2 ** inner``, of a hash of which 40 bits are left."""
    first = rest >> np.uint64(40 - inner)
    second = _mix(rest, 0xD6E8FEB86659FD93, 32) & np.uint64((1 << inner) - 1)
    return first.astype(np.int64), second.astype(np.int64)


def _bitmap(rest: np.ndarray, inner: int) -> bytes:
    held = np.zeros(1 << inner, dtype=bool)
    for place in _within(rest, inner):
        held[place] = True
    return np.packbits(held).tobytes()


def _passing(hashes: np.ndarray, held: np.ndarray, bits: int, size: int) -> np.ndarray:
    """Which hashes have both their bits in a filter of ``2 ** size`` bits in ``2 ** bits`` blocks."""
    passing = np.ones(len(hashes), dtype=bool)
    block = (hashes >> np.uint64(64 - bits) << np.uint64(size - bits)).astype(np.int64)
    for place in _within(_rest(hashes, bits), size - bits):
        bit = block | place
        passing &= (held[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
    return passing


def _rest(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits of a hash behind those that name its block."""
    return hashes << np.uint64(bits) >> np.uint64(24)


def repeated_anchors(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filters of fixed size: anchors of several documents, and those of over ``HOT``.

    Hashes travel in ``2 ** bits`` blocks, each a fixed share of the hash
    space, with the number of documents where a task saw several.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = texts_of(batch)
            for held in parts(texts):
                _, hashes, text, _, _ = anchors(held)
                kept.append(_documents_per_hash(hashes, text))
                if sum(len(h) for h, _ in kept) > FLUSH:
                    yield _by_block(*_summed(kept), bits)
                    kept = []
        if kept:
            yield _by_block(*_summed(kept), bits)

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        both = zip(rows["hashes"], rows["seen"], strict=True)
        hashes, total = _summed([_unpacked(held, seen) for held, seen in both])
        held = _bitmap(hashes[total > 1], FILTER_BITS - bits)
        hot = _bitmap(hashes[total > HOT], HOT_BITS - bits)
        return pd.DataFrame({"block": [key[0]], "held": [held], "hot": [hot]})

    named = docs.where("doc_id IS NOT NULL").select("text")
    rows = (
        named.mapInArrow(collect, "block int, hashes binary, seen binary")
        .groupBy("block")
        .applyInPandas(meet, "block int, held binary, hot binary")
        .collect()
    )
    filters = []
    for name, size in (("held", FILTER_BITS), ("hot", HOT_BITS)):
        filled = np.zeros((1 << bits, 1 << (size - bits - 3)), dtype=np.uint8)
        for r in rows:
            filled[r["block"]] = np.frombuffer(r[name], dtype=np.uint8)
        filters.append(filled.reshape(-1))
    return filters[0], filters[1]


def _documents_per_hash(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, with the number of texts it stands in."""
    order = np.argsort(hashes, kind="stable")  # texts stay in order within a hash
    hashes, text = hashes[order], text[order]
    new_hash = np.ones(len(hashes), dtype=bool)
    new_hash[1:] = hashes[1:] != hashes[:-1]
    new_text = new_hash.copy()
    new_text[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(new_hash)
    seen = np.add.reduceat(new_text, first, dtype=np.int64) if len(first) else first
    return hashes[first], seen


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of all parts once, in order, with the sum of its counts."""
    hashes = np.concatenate([h for h, _ in parts])
    seen = np.concatenate([s for _, s in parts])
    order = np.argsort(hashes)
    hashes, seen = hashes[order], seen[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(new)
    return hashes[first], np.add.reduceat(seen, first) if len(first) else seen


def _by_block(hashes: np.ndarray, seen: np.ndarray, bits: int) -> pa.RecordBatch:
    """``block, hashes, seen``: the hashes of each block, and their counts where over one."""
    bounds = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    cut = [*np.searchsorted(hashes, bounds).tolist(), len(hashes)]
    rows = []
    for block, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
        if j > i:
            several = np.flatnonzero(seen[i:j] > 1)
            counts = np.stack([several, seen[i:j][several]]).astype(np.int64)
            rows.append((block, _packed(hashes[i:j], bits), counts.tobytes()))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    types = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "hashes", "seen"]
    )


def _packed(hashes: np.ndarray, bits: int) -> bytes:
    """The 40 bits of each hash behind its block's, which name it well enough for a filter."""
    rest = _rest(hashes, bits)
    upper, lower = rest >> np.uint64(8), rest & np.uint64(0xFF)
    return upper.astype("<u4").tobytes() + lower.astype(np.uint8).tobytes()


def _unpacked(held: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = len(held) // 5
    upper = np.frombuffer(held, dtype="<u4", count=size).astype(np.uint64)
    hashes = upper << np.uint64(8) | np.frombuffer(held, dtype=np.uint8, offset=4 * size)
    several, number = np.frombuffer(counts, dtype=np.int64).reshape(2, -1)
    seen = np.ones(len(hashes), dtype=np.int64)
    seen[several] = number
    return hashes, seen


# --- windows ----------------------------------------------------------------


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of start, those that touch as one."""
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.r_[first[1:], len(starts)] - 1] if len(starts) else ends


@dataclass
class Windows:
    """Windows of several texts: where each is cut from the buffer, the number of its text,
    its first byte's first and last place in the text (negative where it reaches over the start),
    and its key. Between the two places it stands at least once in every ``LENGTH`` bytes, so a string
    covered in one of them is covered from the first place to the last."""

    start: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray


def _around(hashes, text, place, at) -> Windows:
    """The window of each anchor."""
    return Windows(at - SIDE, text, place - SIDE, place - SIDE, hashes)


def _runs(raw: bytes, own: Windows, width: int, names: np.ndarray) -> tuple[Windows, np.ndarray]:
    """Each different window of each document once, or, where its places lie further apart, once for
    each run of places; and which rows are the first of their window. ``names`` has the
    number of each text's document."""
    if not len(own.start):
        return own, np.zeros(0, dtype=bool)
    number: dict[tuple[int, bytes], int] = {}
    each = zip(names[own.text].tolist(), own.start.tolist(), strict=True)
    kind = np.array([number.setdefault((n, raw[s : s + width]), len(number)) for n, s in each])
    order = np.lexsort((own.first, kind))
    line = (kind[order] << 33) + SIDE  # one line for all windows
    starts, stops = _merged(line + own.first[order], line + own.last[order] + LENGTH)
    kind_of = starts >> 33
    source = order[np.searchsorted(kind[order], kind_of)]
    line = (kind_of << 33) + SIDE
    fresh = np.r_[True, kind_of[1:] != kind_of[:-1]]
    first, last = starts - line, stops - line - LENGTH
    return Windows(own.start[source], own.text[source], first, last, own.key[source]), fresh


def _strings(buffer: np.ndarray, own: Windows) -> Windows:
    """Every string of each window, by itself; only strings inside their text."""
    steps = np.arange(SIDE + 1)
    start = (own.start[:, None] + steps).ravel()
    first = (own.first[:, None] + steps).ravel()
    last = (own.last[:, None] + steps).ravel()
    text = np.repeat(own.text, SIDE + 1)
    inside = (buffer[start] != PAD) & (buffer[start + LENGTH - 1] != PAD)
    start, first, last, text = start[inside], first[inside], last[inside], text[inside]
    raw = buffer.tobytes()
    digests = [hashlib.blake2b(raw[s : s + LENGTH], digest_size=8).digest() for s in start.tolist()]
    key = np.frombuffer(b"".join(digests), dtype="<u8").astype(np.uint64)
    return Windows(start, text, first, last, key)


def _emitted(cut: list[bytes], docs: np.ndarray, least: dict[bytes, int]) -> np.ndarray:
    """Which windows go on: those without an equal in a smaller document so far.

    ``least`` holds the smallest document of each window that the task remembers.
    """
    out = np.zeros(len(cut), dtype=bool)
    for i in np.argsort(docs, kind="stable").tolist():
        doc = int(docs[i])
        if doc <= least.get(cut[i], doc):
            least[cut[i]] = doc
            out[i] = True
    return out


@dataclass
class Rows:
    """Windows to compare, all of one width, with the first and last place of their first byte in their
    text; or, with width 0 and no windows, spans that are covered already. A window is empty where it
    is the same as the one before, of the same document at other places."""

    width: int
    windows: list[bytes]
    bucket: np.ndarray
    numbers: np.ndarray  # five rows: doc_id, version, start, stop, and 1 where a window is given


def _bundled(held: list[Rows]) -> pa.RecordBatch:
    """``bucket, width, windows, numbers``: one row per bucket, packed, as windows travel far
    smaller together than alone."""
    pack = zstandard.ZstdCompressor(level=1).compress
    out = []
    for width in {r.width for r in held}:
        own = [r for r in held if r.width == width]
        cut = [w for r in own for w in r.windows]
        bucket = np.concatenate([r.bucket for r in own])
        numbers = np.concatenate([r.numbers for r in own], axis=1)
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        for at in np.split(order, first[1:]):
            joined = b"".join([cut[i] for i in at.tolist()]) if width else b""
            packed = pack(np.ascontiguousarray(numbers[:, at]).tobytes())
            out.append((int(bucket[at[0]]), width, pack(joined), packed))
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "width", "windows", "numbers"])


def windows(docs: DataFrame, bits: int, buckets: int, shared) -> DataFrame:
    """``bucket, width, windows, numbers``: bundles of windows to compare, and of spans."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        held: list[Rows] = []
        total = 0
        for batch in batches:
            for rows in found(batch, least):
                held.append(rows)
                total += len(rows.bucket)
                if total >= BUNDLE:
                    yield _bundled(held)
                    held, total = [], 0
        if held:
            yield _bundled(held)

    def found(batch: pa.RecordBatch, least: dict[bytes, int]) -> Iterator[Rows]:
        held, hot = shared.value
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        versions = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = texts_of(batch)
        known: dict[tuple[int, int], int] = {}
        pairs = zip(ids.tolist(), versions.tolist(), strict=True)
        names = np.array([known.setdefault(p, len(known)) for p in pairs], dtype=np.int64)
        for pieces in parts(texts):
            buffer, *own = anchors(pieces)
            raw = buffer.tobytes()
            passing = _passing(own[0], held, bits, FILTER_BITS)
            own = [c[passing] for c in own]
            is_hot = _passing(own[0], hot, bits, HOT_BITS)
            plain = _around(*[c[~is_hot] for c in own])
            several, _ = _runs(raw, _around(*[c[is_hot] for c in own]), WINDOW, names)
            single = _strings(buffer, several)
            for width, each in ((WINDOW, plain), (LENGTH, single)):
                if len(least) > REMEMBERED:
                    least.clear()
                runs = _runs(raw, each, width, names)
                yield from compared(raw, *runs, width, ids, versions, least)

    def compared(
        raw: bytes, own: Windows, fresh: np.ndarray, width: int, ids, versions, least
    ) -> Iterator[Rows]:
        cut = [raw[s : s + width] for s in own.start.tolist()]
        doc, version = ids[own.text], versions[own.text]
        go = np.zeros(len(cut), dtype=bool)
        if len(cut):
            own_cut = [cut[i] for i in np.flatnonzero(fresh).tolist()]
            go = _emitted(own_cut, doc[fresh], least)[np.cumsum(fresh) - 1]
        if go.any():
            at = np.flatnonzero(go)
            bucket = (own.key[at] % np.uint64(buckets)).astype(np.int64)
            numbers = np.stack([doc[at], version[at], own.first[at], own.last[at], fresh[at]])
            yield Rows(width, [cut[i] if fresh[i] else b"" for i in at.tolist()], bucket, numbers)
        if not go.all():
            at = np.flatnonzero(~go)
            at = at[np.lexsort((own.first[at], own.text[at]))]
            lead, tail = np.array([_pads(cut[i]) for i in at.tolist()]).T
            place = (own.text[at].astype(np.int64) << 40) + own.first[at]  # one line for all texts
            run = own.last[at] - own.first[at]
            starts, stops = _merged(place + lead, place + run + width - tail)
            text = starts >> 40
            line = text << 40
            spans = [ids[text], versions[text], starts - line, stops - line]
            numbers = np.stack([*spans, np.zeros_like(line)])
            yield Rows(0, [], starts % buckets, numbers)

    named = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), _version().alias("version"), "text"
    )
    return named.mapInArrow(emit, "bucket int, width int, windows binary, numbers binary")


def _version():
    """Tells the texts of one ``doc_id`` apart, should it have several."""
    return F.hash(body())


def _pads(window: bytes) -> tuple[int, int]:
    """Bytes before and behind the text in a window that reaches over its ends."""
    if window[0] != PAD and window[-1] != PAD:
        return 0, 0
    pad = bytes([PAD])
    return len(window) - len(window.lstrip(pad)), len(window) - len(window.rstrip(pad))


# --- intervals --------------------------------------------------------------


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low..high]``, both ends included, for many ranges."""
    table = [values]
    span = int((high - low).max(initial=0)) + 1
    while (2 << (len(table) - 1)) <= span:
        half = 1 << (len(table) - 1)
        last = table[-1].copy()
        last[:-half] = np.minimum(table[-1][:-half], table[-1][half:])
        table.append(last)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    flat, n = np.concatenate(table), len(values)
    return np.minimum(flat[level * n + low], flat[level * n + high + 1 - (1 << level)])


def covered_starts(window: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every row and each of its strings of ``length`` bytes: is it in a smaller document too?

    ``window`` holds one row of bytes per window, aligned. Strings are compared
    at equal columns only. Strings with a pad byte never count.
    """
    rows, columns = window.shape
    strings = columns - length + 1
    out = np.zeros((rows, strings), dtype=bool)
    order = np.arange(rows)
    common = np.zeros(rows, dtype=np.uint8)  # with the row before, up to ``length``
    by_column = np.ascontiguousarray(window.T)
    for k in range(columns - 1, -1, -1):
        byte = by_column[k][order]
        moved = np.argsort(byte, kind="stable")
        sorted_byte = byte[moved]
        same = np.flatnonzero(sorted_byte[1:] == sorted_byte[:-1]) + 1
        grown = np.zeros(rows, dtype=np.uint8)
        if len(same):
            between = _range_minimum(common, moved[same - 1] + 1, moved[same])
            grown[same] = np.minimum(between + 1, length)
        order, common = order[moved], grown
        if k < strings and rows:
            first = np.flatnonzero(common < length)
            sizes = np.diff(np.r_[first, rows])
            own = doc[order]
            least = np.repeat(np.minimum.reduceat(own, first), sizes)
            out[order, k] = least < own
    pad = window == PAD
    lead, tail = np.argmin(pad, axis=1), np.argmin(pad[:, ::-1], axis=1)
    k = np.arange(strings)
    return out & (k >= lead[:, None]) & (k + length <= columns - tail[:, None])


def _spans(covered: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, stop)`` of the runs of covered strings, in bytes of the window."""
    edge = np.zeros((len(covered), 1), dtype=np.int8)
    steps = np.diff(np.hstack([edge, covered.astype(np.int8), edge]), axis=1)
    row, start = np.nonzero(steps == 1)
    return row, start, np.nonzero(steps == -1)[1] - 1 + length


def compare_bucket(table: pa.Table) -> pa.Table:
    """The covered spans of one bucket's windows, and the spans it was given."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = table.select(["width", "windows", "numbers"]).to_pylist()
    found = [np.zeros((4, 0), dtype=np.int64)]
    for width in sorted({r["width"] for r in rows}):
        own = [r for r in rows if r["width"] == width]
        packed = [np.frombuffer(unpack(r["numbers"]), dtype=np.int64) for r in own]
        numbers = np.concatenate([n.reshape(5, -1) for n in packed], axis=1)
        if not width:
            found.append(numbers[:4])
            continue
        held = np.frombuffer(b"".join(unpack(r["windows"]) for r in own), dtype=np.uint8)
        doc, version, first, last, fresh = numbers
        given = np.flatnonzero(fresh)
        window, a, b = _spans(covered_starts(held.reshape(-1, width), doc[given]), LENGTH)
        times = np.diff(np.r_[given, len(fresh)])[window]  # rows of the span's window
        row = np.repeat(given[window] - np.cumsum(times) + times, times) + np.arange(times.sum())
        a, b = np.repeat(a, times), np.repeat(b, times)
        found.append(np.stack([doc[row], version[row], first[row] + a, last[row] + b]))
    doc, version, start, stop = np.concatenate(found, axis=1)
    names = ["doc_id", "version", "start", "stop"]
    return pa.table([doc, version.astype(np.int32), start, stop], names=names)


# --- the whole --------------------------------------------------------------


def covered_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, version, spans``: per document that loses bytes its spans, not merged."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(16, math.ceil(total / BLOCK_BYTES))
    bits = min(HOT_BITS - 3, (blocks - 1).bit_length())
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * partitions, 4 * blocks)
    shared = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, bits))
    spans = (
        windows(docs, bits, buckets, shared)
        .groupBy("bucket")
        .applyInArrow(compare_bucket, "doc_id long, version int, start long, stop long")
    )
    return spans.groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")
    )


def _packed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, version, packed``: the texts as they travel to their spans."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = pa.array([packed(t) for t in texts_of(batch)], pa.binary())
            columns = [batch.column(0), batch.column(1), texts]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "packed"])

    rows = docs.select("doc_id", _version().alias("version"), "text")
    return rows.mapInArrow(pack, f"doc_id {id_type}, version int, packed binary")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans``: what is left of each text, in bytes.

    Ids that are no whole numbers are compared by their rank, and come back as they were.
    """
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        return _with_number_ids(docs)
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    ranked = stage_table(number_rows(ids, ["doc_id"], "_rank"), "ranks")
    numbered = docs.select("doc_id", "text").join(ranked, "doc_id", "left")
    left = _with_number_ids(numbered.select(F.col("_rank").alias("doc_id"), "text"))
    named = ranked.select(F.col("doc_id").alias("_id"), "_rank")
    return left.join(named, left["doc_id"] == named["_rank"], "left").select(
        F.col("_id").alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans"
    )


def _with_number_ids(docs: DataFrame) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = covered_spans(docs).withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    rows = _packed_texts(docs)
    same = (rows["doc_id"] == spans["_id"]) & (rows["version"] == spans["_version"])
    joined = rows.join(spans, same, "left").select(
        "doc_id",
        "packed",
        F.col("spans.start").alias("starts"),
        F.col("spans.stop").alias("stops"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [unpack(t) for t in batch.column(1).to_pylist()]
            out: list[tuple[bytes, int, int]] = []
            lists = (batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for text, starts, stops in zip(texts, *lists, strict=True):
                if not starts:
                    out.append((text, 0, 0))
                    continue
                a, b = np.array(starts), np.array(stops)
                order = np.argsort(a, kind="stable")
                a, b = _merged(a[order], b[order])
                ends = [0, *b.tolist()]
                left = b"".join(text[i:j] for i, j in zip(ends, [*a.tolist(), len(text)], strict=True))
                out.append((left, len(text) - len(left), len(a)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([o[0] for o in out], pa.binary()),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.int64()),
                ],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    schema = f"doc_id {id_type}, kept binary, n_bytes long, n_removed long, n_spans long"
    return joined.mapInArrow(cut, schema)
