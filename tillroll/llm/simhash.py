"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A fingerprint has 64 bits; a bit is set if it is set in over half the hashes of the
document's word shingles. Two fingerprints that differ in at most three bits are linked.

Candidate search. The 64 bits are cut into three segments of at most 22 bits. Three errors
leave at most one error in two of the three segments (two segments of two errors each would be
four). Each segment is a word of the (23, 12) Golay code, a perfect code: every word is within
three bits of exactly one codeword. A segment gives the codeword index of itself, and the
indices of all words one bit away from it: one to six different ones. Words that differ in at
most one bit find each other's own index among those. Per pair of segments a fingerprint is
therefore entered once with the near indices of the first segment and its own index of the
second, and once the other way round; two linked fingerprints meet in a key of 24 bits. The
join verifies the distance of what meets, so only links leave it.

Equal fingerprints are one node, whatever their number of rows. A fingerprint has at most 43,744 others
within three bits, which bounds the links per node whatever the input. The components come from
minimum labels with pointer jumping, one staged table per round.

Defined results: a null or empty text has no words and fingerprint zero, which is
linked like any other. A null ``doc_id`` is never a component's
smallest unless all are null, when the component is null. Repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted
from tillroll.llm.common import Rounds, fresh_name, stage_table, texts_of

SHINGLE = 3
SEED = 42
DISTANCE = 3
SLAB = 1 << 16
"""Hashes whose bits are counted at once."""

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width, from the lowest bit
PAIRS = ((0, 1), (0, 2), (1, 2))

# Fixed value: generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101


# --- fingerprints -----------------------------------------------------------


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in slabs; the words stand in one buffer with single
    blanks between them, so a shingle is a slice of it."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([digest(joined, SEED)], dtype=np.uint64)
        return
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1]
    ends = ends[size - 1 :]
    for low in range(0, len(starts), SLAB):
        own = zip(starts[low : low + SLAB].tolist(), ends[low : low + SLAB].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in own], dtype=np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The 64 bits as an unsigned number; zero for a text without words."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, size):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big") if total else 0


def fingerprinted(docs: DataFrame, columns: Sequence[str], name: str, size: int) -> DataFrame:
    """``columns`` of every row with its signed 64-bit fingerprint as ``name``."""
    needed = list(dict.fromkeys((*columns, "text")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t, size) for t in texts_of(batch)], dtype=np.uint64)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(own.view(np.int64))], [*columns, name])

    schema = docs.select(*map(quoted, columns)).withColumn(name, F.lit(0).cast("long")).schema
    return docs.select(*map(quoted, needed)).mapInArrow(add, schema)


# --- the Golay code ---------------------------------------------------------


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of the upper 12 bits, and the error of at most three bits per syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    upper = np.array([remainder(high << 11) for high in range(1 << 12)], dtype=np.int64)
    errors = np.zeros(1 << 11, dtype=np.int64)
    single = [1 << bit for bit in range(23)]
    for i, a in enumerate(single):
        errors[remainder(a)] = a
        for j, b in enumerate(single[:i]):
            errors[remainder(a | b)] = a | b
            for c in single[:j]:
                errors[remainder(a | b | c)] = a | b | c
    return upper, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    upper, errors = golay_tables()
    syndrome = upper[words >> 11] ^ (words & 0x7FF)
    return (words ^ errors[syndrome]) >> 11


def near_indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, index)``: the different codeword indices of each word and of the
    words one bit away in its lower ``width`` bits."""
    flips = np.array([0, *(1 << bit for bit in range(width))], dtype=np.int64)
    found = np.sort(codeword_index(words[:, None] ^ flips), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, places = np.nonzero(new)
    return rows, found[rows, places]


def search_keys(prints: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of signed fingerprints: near indices of the pair's first segment with the
    own index of its second, or the other way round."""
    bits = prints.view(np.uint64)
    parts = [
        ((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        for low, width in SEGMENTS
    ]
    rows, keys = [], []
    for number, (a, b) in enumerate(PAIRS):
        near, own = (a, b) if first else (b, a)
        row, index = near_indices(parts[near], SEGMENTS[near][1])
        other = codeword_index(parts[own])[row]
        one, two = (index, other) if first else (other, index)
        rows.append(row)
        keys.append(number << 24 | one << 12 | two)
    return np.concatenate(rows), np.concatenate(keys)


# --- links and components ---------------------------------------------------


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``low, high``: all pairs of different fingerprints within ``distance`` bits.

    ``prints`` holds each fingerprint once, as ``print``.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the segments leave one error each in two of three for up to three bits")

    def keyed(first: bool, name: str) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                rows, keys = search_keys(own, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int32)), pa.array(own[rows])], ["key", name]
                )

        return prints.select("print").mapInArrow(emit, f"key int, {name} long")

    near = F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= distance
    met = keyed(True, "low").join(keyed(False, "high"), "key")
    return met.where((F.col("low") < F.col("high")) & near).select("low", "high").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the staged ``edges``: the smallest node it reaches.

    Each round takes the smallest root among a node and its neighbours and then the
    root's own root, until none changes.
    """
    both = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).unionAll(
        edges.select(F.col("high").alias("node"), F.col("low").alias("other"))
    )
    both = stage_table(both.repartition("other"), "edges")
    rounds = Rounds(edges.sparkSession, "roots")
    roots = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
    roots = rounds.stage(roots)
    while True:
        known = roots.select(F.col("node").alias("other"), F.col("root").alias("seen"))
        near = both.join(known, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        hooked = roots.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "seen").alias("root")
        )
        parents = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = hooked.join(parents, "root").select(
            "node", F.least("root", "above").alias("root"), "old"
        )
        held = rounds.stage(jumped)
        roots = held.select("node", "root")
        if held.where("root != old").isEmpty():
            return roots


def grouped(rows: DataFrame, name: str, order: Sequence[Column], distance: int) -> DataFrame:
    """``print, best``: per fingerprint the least ``order`` of its component's rows.

    ``rows`` is a staged table with the fingerprint ``name`` and the columns in ``order``.
    """
    nodes = rows.groupBy(quoted(name).alias("print")).agg(F.min(F.struct(*order)).alias("best"))
    nodes = stage_table(nodes, "nodes")
    roots = components(stage_table(links(nodes, distance), "links"))
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", F.coalesce("root", "print").alias("root"), "best"
    )
    least = rooted.groupBy("root").agg(F.min("best").alias("best"))
    return rooted.select("print", "root").join(least, "root").select("print", "best")


def _order() -> list[Column]:
    return [F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id")]


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document."""
    rows = stage_table(fingerprinted(docs, ["doc_id"], "print", size), "fingerprints")
    best = grouped(rows, "print", _order(), distance)
    return rows.join(best, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, that of its smallest ``doc_id``, with the columns of ``docs``.

    The rows are numbered as they are staged, and the kept numbers, one per component, are semi-joined:
    a number is one row, so no key is hot.
    """
    name, number = fresh_name(docs, "print"), fresh_name(docs, "row_number")
    marked = fingerprinted(docs, docs.columns, name, size)
    rows = stage_table(marked.withColumn(number, F.monotonically_increasing_id()), "fingerprints")
    best = grouped(rows, name, [*_order(), quoted(number).alias("number")], distance)
    kept = best.select(F.col("best.number").alias(number)).distinct()
    return rows.join(kept, number, "left_semi").select(*map(quoted, docs.columns))
