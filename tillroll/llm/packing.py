"""Best-fit packing of documents into sequences by swap-based local search.

A document is its token ids and one end id. Only one longer than a sequence is cut: its
first piece is what is left over, all others fill a sequence each. The other pieces are
dealt by hash to groups of bounded size. A group starts from best-fit decreasing and then
improves its underfull sequences: it moves pieces, and exchanges one for one and two for one
between two of them, whenever that increases the sum of squared fills, until sequences
become empty and no exchange helps. The emptiest sequences of each group are opened again
and packed once more in far fewer groups, up to one group, so that what the groups leave over
does not add up.

Defined results: a null or empty text is a document of the end id alone. Rows
are packed one by one, so repeated rows are packed repeatedly. No documents give no sequences.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import paired, stage_table
from tillroll.llm.token_count import encoder, vocabulary_path

CAPACITY = 1024
END_ID = 2
PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
GROUP = 32_768
"""Pieces packed together in one task, on average."""

REOPENED = 8
"""Sequences per group that the next round packs again, at most one in eight but one at least.
They hold at most half a group's pieces, and each round has at most half the groups."""


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


# --- one group --------------------------------------------------------------


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes where least room is left over."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    held = 0  # bit r is set while some bin has room r
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = held >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                held ^= 1 << left
        else:
            left, chosen = capacity, len(bins)
            bins.append([])
        bins[chosen].append(item)
        room[left - size].append(chosen)
        held |= 1 << (left - size)
    return bins


class _Kinds:
    """The lengths in a bin: each once, and the sums of two of its items, as bits of a number."""

    def __init__(self, sizes: tuple[int, ...]) -> None:
        times = Counter(sizes)
        self.one = sum(1 << size for size in times)
        self.two = 0
        for size, n in times.items():
            others = self.one if n > 1 else self.one ^ (1 << size)
            self.two |= others << size


def _bits(number: int) -> Iterator[int]:
    while number:
        low = number & -number
        yield low.bit_length() - 1
        number ^= low


def _above(number: int, most: int) -> int:
    """The bits 1 to ``most`` places above those of a number."""
    found, reach = number << 1, 1
    while reach < most:
        step = min(reach, most - reach)
        found |= found << step
        reach += step
    return found


def _two(sizes: Sequence[int], total: int) -> tuple[int, int]:
    """Two items' lengths of the given sum."""
    times = Counter(sizes)
    return next((k, total - k) for k in times if times[total - k] > (2 * k == total))


class _Underfull:
    """The bins that are neither full nor empty, by room and by the lengths they hold.

    All of a room's bins are asked at once, through the union of their lengths, so the
    search meets every pair of bins without a step for each. Bins of equal lengths are one entry.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fills = [sum(sizes[i] for i in b) for b in bins]
        self._kinds: dict[tuple[int, ...], _Kinds] = {}
        self._held: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self._union: dict[int, tuple[int, int, int, int]] = {}
        for b in range(len(bins)):
            self._add(b)

    def _lengths(self, b: int) -> tuple[int, ...]:
        return tuple(sorted(self.sizes[i] for i in self.bins[b]))

    def kinds(self, lengths: tuple[int, ...]) -> _Kinds:
        if lengths not in self._kinds:
            self._kinds[lengths] = _Kinds(lengths)
        return self._kinds[lengths]

    def _add(self, b: int) -> None:
        room = self.capacity - self.fills[b]
        if 0 < room < self.capacity:
            self._held.setdefault(room, {}).setdefault(self._lengths(b), []).append(b)
            self._union.pop(room, None)

    def _remove(self, b: int) -> None:
        room = self.capacity - self.fills[b]
        if 0 < room < self.capacity:
            lengths = self._lengths(b)
            self._held[room][lengths].remove(b)
            if not self._held[room][lengths]:
                del self._held[room][lengths]
            if not self._held[room]:
                del self._held[room]
            self._union.pop(room, None)

    def entries(self, room: int, without: int) -> Iterator[tuple[_Kinds, int]]:
        """The different lengths among a room's other bins, each with one of its bins."""
        for lengths, held in self._held.get(room, {}).items():
            other = next((b for b in held if b != without), None)
            if other is not None:
                yield self.kinds(lengths), other

    def union(self, room: int, without: int) -> tuple[int, int, int, int]:
        """What the room's other bins hold together, and all that is at most ``room`` more."""
        own = self.capacity - self.fills[without] == room
        if not own and room in self._union:
            return self._union[room]
        one = two = 0
        for kinds, _ in self.entries(room, without):
            one, two = one | kinds.one, two | kinds.two
        found = (one, two, _above(one, room), _above(two, room))
        if not own:
            self._union[room] = found
        return found

    def exchange(self, source: int) -> bool:
        """One exchange from a bin to one at least as full, if there is any: to the fullest bin
        that gains, and what fills it most.

        One or two items go, and none, one or two come back: a whole item moves, or the difference of
        lengths in the two bins. Whatever is moved so grows the sum of squared fills.
        """
        most = self.capacity - self.fills[source]
        own = self.kinds(self._lengths(source))
        both = own.one | own.two
        for room in sorted(r for r in self._held if r <= most):
            one, two, above_one, above_two = self.union(room, source)
            small = (2 << room) - 2
            if not one or not (own.one & small or both & above_one or own.one & above_two):
                continue
            for moved in range(room, 0, -1):
                if _fits(own, one, two, moved):
                    kinds, target = next(
                        e for e in self.entries(room, source) if _fits(own, e[0].one, e[0].two, moved)
                    )
                    self._apply(source, target, own, kinds, moved)
                    return True
        return False

    def _apply(self, source: int, target: int, own: _Kinds, other: _Kinds, moved: int) -> None:
        """Move items so that ``moved`` more are in the target."""
        mine = [self.sizes[i] for i in self.bins[source]]
        theirs = [self.sizes[j] for j in self.bins[target]]
        if own.one >> moved & 1:
            out, back = (moved,), ()
        elif own.one & (other.one << moved):
            size = next(_bits(own.one & (other.one << moved)))
            out, back = (size,), (size - moved,)
        elif own.two & (other.one << moved):
            total = next(_bits(own.two & (other.one << moved)))
            out, back = _two(mine, total), (total - moved,)
        else:
            size = next(_bits(own.one & (other.two << moved)))
            out, back = (size,), _two(theirs, size - moved)
        self._remove(source)
        self._remove(target)
        going = [self._take(source, size) for size in out]
        coming = [self._take(target, size) for size in back]
        self.bins[source] += coming
        self.bins[target] += going
        self.fills[source] -= moved
        self.fills[target] += moved
        self._add(source)
        self._add(target)

    def _take(self, b: int, size: int) -> int:
        at = next(k for k, i in enumerate(self.bins[b]) if self.sizes[i] == size)
        return self.bins[b].pop(at)


def _fits(own: _Kinds, one: int, two: int, moved: int) -> bool:
    return bool(own.one >> moved & 1 or (own.one | own.two) & (one << moved) or own.one & (two << moved))


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over the underfull bins, the emptiest first, until no exchange between any
    two of them helps; empty bins go.

    Every step increases the sum of squared fills, so the search ends.
    """
    bins = [list(b) for b in bins]
    held = _Underfull(bins, sizes, capacity)
    improved = True
    while improved:
        improved = False
        underfull = [b for b, f in enumerate(held.fills) if 0 < f < capacity]
        for source in sorted(underfull, key=lambda b: held.fills[b]):
            while 0 < held.fills[source] < capacity and held.exchange(source):
                improved = True
    return [b for b in bins if b]


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items by bin, fullest bin first."""
    bins = improve(best_fit(sizes, capacity), sizes, capacity)
    return sorted(bins, key=lambda b: -sum(sizes[i] for i in b))


# --- all documents ----------------------------------------------------------


def pieces(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Every document's pieces, numbered, and ``with_ids`` with their token ids.

    A piece that fills a sequence has that sequence's number already.
    """
    path = path or vocabulary_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        number = TaskContext.get().partitionId() << 40
        for ids, texts in paired(batches):
            rows, tokens_of = [], []
            for doc, text in zip(ids.to_pylist(), texts, strict=True):
                tokens = np.append(encode(text.decode()), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(tokens), capacity)):
                    own = tokens[start : start + length]
                    whole = -1 - number if length == capacity else None
                    rows.append((doc, k, start, length, zlib.crc32(own.tobytes()), number, whole))
                    number += 1
                    if with_ids:
                        tokens_of.append(own.astype(np.int32))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [ids.type, pa.int32(), *[pa.int64()] * 5]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            if with_ids:
                arrays.append(pa.array(tokens_of, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [*PIECE, "number", "sequence_id", *["ids"] * with_ids]
    numbers = "piece int, start long, length long, ids_crc32 long, number long, sequence_id long"
    tokens = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, {numbers}{tokens}")


def place(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The staged ``pieces`` with the sequence and the offset of each, without ids."""
    columns = [*PIECE, "number", "sequence_id", "offset"]
    whole = cut.where("sequence_id IS NOT NULL").withColumn("offset", F.lit(0).cast("long"))
    done = [whole.select(*columns)]
    rest, level, groups = cut.where("sequence_id IS NULL"), 0, None
    while True:
        held = max(1, math.ceil(rest.count() / group))
        groups = held if groups is None else min(held, math.ceil(groups / 2))
        loose = rest.select(*PIECE, "number")
        packed = stage_table(_pack_groups(loose, groups, level, capacity), "packed")
        if groups == 1:
            return _union([*done, packed.select(*columns)])
        done.append(packed.where("NOT reopened").select(*columns))
        rest, level = packed.where("reopened"), level + 1


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group: int = GROUP,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    cut = stage_table(pieces(docs, path, capacity, end_id), "pieces")
    return place(cut, capacity, group).select(*PIECE, "sequence_id", "offset")


def sequences(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group: int = GROUP,
) -> DataFrame:
    """``sequence_id, ids, doc_ids, lengths``: the packed token ids, at most ``capacity`` each,
    and the documents whose pieces follow each other in them."""
    cut = stage_table(pieces(docs, path, capacity, end_id, with_ids=True), "pieces")
    placed = place(cut, capacity, group).select("number", "sequence_id", "offset")
    parts = F.array_sort(F.collect_list(F.struct("offset", "number", "ids", "doc_id")))
    held = (
        cut.drop("sequence_id").join(placed, "number").groupBy("sequence_id").agg(parts.alias("parts"))
    )
    return held.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.transform("parts.ids", F.size).alias("lengths"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *more = frames
    for frame in more:
        first = first.unionByName(frame)
    return first


def _pack_groups(loose: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """Pack each group in one task; the emptiest bins of it are marked to be reopened."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "number"], ignore_index=True)
        bins = pack_group(rows["length"].tolist(), capacity)
        base = (level << 58) | (int(key[0]) << 24)
        out = rows.assign(sequence_id=0, offset=0, reopened=False)
        first_open = len(bins) - min(REOPENED, max(1, len(bins) // 8))
        where, at, again = [0] * len(rows), [0] * len(rows), [False] * len(rows)
        for b, items in enumerate(bins):
            place = 0
            for item in items:
                where[item], at[item] = base | b, place
                again[item] = b >= first_open
                place += int(rows["length"].iat[item])
        return out.assign(sequence_id=where, offset=at, reopened=again).drop(columns="bucket")

    bucket = F.pmod(F.xxhash64(*loose.columns), F.lit(groups))
    kinds = {f.name: f.dataType.simpleString() for f in loose.schema}
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items())
    return (
        loose.withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInPandas(one, f"{schema}, sequence_id long, offset long, reopened boolean")
    )
