"""Packing of documents along a space-filling curve.

A document's vector holds the roots of its token ids' shares, hashed to ``FEATURES`` dimensions, and
is projected at random to ``DIMENSIONS`` numbers. Their quantiles over all documents are
a grid of 256 steps a dimension, and a document's place on the Hilbert curve through that grid, with a
hash of its row behind it, is its key. The keys' quantiles cut the curve into slices; documents are
sorted by key within their slice, and the token ids of all slices, one behind the
other, are cut every ``capacity`` ids. So similar documents share a sequence, and every sequence is full
but the end of the curve, which is cut to powers of two.

Texts are read once. What travels are token ids, two bytes each, in rows of at most ``BLOCK`` ids: once to a
staged table and once to their slice. The row's hash behind the curve's key spreads copies over slices. The driver
holds the grid, the slices' bounds and their sizes: at most ``SLICES`` numbers each.

The ids are those of the library ``tokenizers``. White space separates words for this vocabulary and
is dropped, so each different word between blanks is encoded once and its ids are remembered.

Defined results: a null or empty text is a document of the end id alone. Rows are packed one by one, so
repeated rows are packed repeatedly. No documents give no sequences.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillroll.llm.common import paired, stage_table

CAPACITY = 4096
END_ID = 2
DIMENSIONS, GRID_BITS = 4, 8
FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
SEED = 12
BLOCK = 1 << 16
"""Token ids in a row."""

SLICE = 1 << 22
"""Token ids in a slice of the curve, on average, until there are ``SLICES``."""

SLICES = 8192
REMEMBERED = 1 << 19
"""Words whose ids a worker remembers."""

READ_TOGETHER = 1 << 21
"""Bytes of text whose unknown words are encoded together."""

LONG_WORD = 256
PART = 1 << 16
SPECIAL = b"<|"  # how the vocabulary's special strings begin
DIGIT = re.compile("[0-9]")
END = b"\0"
# The vocabulary's pre-tokenizer on lower-case words of ASCII and of Latin letters to U+017F.
LATIN = re.compile("[!-~ß-öø-ſ]+")
LATIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_AXES = [f"axis{k}" for k in range(DIMENSIONS)]


def vocabulary_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


# --- token ids --------------------------------------------------------------


class WordMerges:
    """The vocabulary's merges as ``tiktoken`` runs them, for words of Latin letters and ASCII marks.

    Such a word's pieces are known without the library: it is composed already, and letters, digits and
    marks are told apart by range. The end of a piece is the byte ``END`` there, which is merged
    with the byte before it first. The file's merge order is checked to be its id order, on which both
    libraries agree.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves
        other = [b for b in range(256) if b not in plain]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        self.ends = np.zeros(len(vocabulary), dtype=bool)
        ranks = {}
        for token, number in vocabulary.items():
            body = token.removesuffix(suffix)
            self.ends[number] = body != token
            ranks[bytes(shown[c] for c in body) + END * (body != token)] = number
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [vocabulary[m] for m in made] != list(range(512, 512 + len(made))):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        self._encoding = tiktoken.Encoding(
            path, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}
        )

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that ``LATIN`` matches, in lower case, and where each word's end."""
        pieces = [LATIN_PIECE.findall(w) for w in words]
        text = "".join([p + "\0" for ps in pieces for p in ps])
        ids = np.array(self._encoding.encode_ordinary(text), dtype=np.int64)
        ends = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
        return ids, ends[np.cumsum([len(ps) for ps in pieces], dtype=np.int64)]


class WordEncoder:
    """Ids of a vocabulary that drops white space and case, word by word.

    Only words that the worker does not remember are encoded, all words of Latin letters and ASCII
    marks by ``WordMerges`` and the others by the library. A text that may hold a special string keeps its
    case, and its words of that kind go to the library too.
    """

    def __init__(self, path: str) -> None:
        self._library = Tokenizer.from_file(path)
        self._latin = WordMerges(path)
        self._known: dict[bytes, bytes] = {}
        self.kind = np.dtype("<u2" if self._library.get_vocab_size() <= 1 << 16 else "<u4")

    def __call__(self, text: bytes) -> np.ndarray:
        return next(self.every([text]))

    def every(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        held: list[list[bytes]] = []
        total = 0
        for text in texts:
            held.append((text if SPECIAL in text else text.lower()).split())
            total += len(text)
            if total > READ_TOGETHER:
                yield from self._read(held)
                held, total = [], 0
        yield from self._read(held)

    def _read(self, lists: list[list[bytes]]) -> Iterator[np.ndarray]:
        new = set().union(*lists).difference(self._known)
        long = {w: self._long(w.decode()) for w in new if len(w) > LONG_WORD}
        self._learn([w for w in new if len(w) <= LONG_WORD])
        known = ChainMap(self._known, long) if long else self._known
        for words in lists:
            yield np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=self.kind)
        if len(self._known) > REMEMBERED:  # the first words seen are the frequent ones
            self._known = dict(islice(self._known.items(), REMEMBERED // 2))

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode().lower() for w in words]
        latin = [LATIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        ids, ends = self._latin(list(compress(texts, latin)))
        raw, ends = ids.astype(self.kind).tobytes(), (ends * self.kind.itemsize).tolist()
        cuts = zip([0, *ends], ends, strict=False)
        self._known |= zip(compress(words, latin), [raw[a:b] for a, b in cuts], strict=True)
        other = [w for w, known in zip(words, latin, strict=True) if not known]
        self._known |= {w: self._ids(w.decode()) for w in other}

    def _ids(self, text: str) -> bytes:
        ids = self._library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.kind).tobytes()

    def _long(self, word: str) -> bytes:
        """A word of any length, in parts: an ASCII digit is a token's whole text, so a part may
        end before one."""
        out, low = [], 0
        while len(word) - low > PART:
            digit = DIGIT.search(word, low + PART)
            high = digit.start() if digit else len(word)
            out.append(self._ids(word[low:high]))
            low = high
        return b"".join([*out, self._ids(word[low:])])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process and file."""
    return WordEncoder(path)


# --- vectors and the curve --------------------------------------------------


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    """Random directions of the hashed dimensions."""
    return np.random.default_rng(SEED).standard_normal((FEATURES, DIMENSIONS))


def project(ids: np.ndarray) -> np.ndarray:
    """The projection of the hashed vector of one document's ids, which are not empty.

    A document of fewer ids than there are dimensions has them sorted, so that its cost is its length.
    """
    mixed = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    hashed = (mixed >> np.uint32(32 - FEATURE_BITS)).astype(np.uint16)
    if len(ids) < FEATURES:
        hashed.sort(kind="stable")
        ends = np.flatnonzero(np.r_[hashed[1:] != hashed[:-1], True])
        held, times = hashed[ends], np.diff(ends, prepend=-1)
    else:
        counts = np.bincount(hashed, minlength=FEATURES)
        held = np.flatnonzero(counts)
        times = counts[held]
    return np.sqrt(times / len(ids)) @ projection()[held]


def hilbert(cells: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of grid cells, by Gray code from the top bit down.

    In each step the cube of the remaining bits is mirrored and its axes are exchanged, as the
    sub-cube entered asks for; what is left is the Gray code of the place.
    """
    x = cells.T.astype(np.int64)
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in range(n):
            on = (x[axis] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(on, below, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turned = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turned
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(n):
            place = (place << 1) | ((x[axis] >> bit) & 1)
    return place


def curve_key(grid: list[list[float]]):
    """A column function: the key of a document on the curve through the grid."""
    edges = [np.array(e) for e in grid]

    @F.pandas_udf("long")
    def key(number: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        axes = (a, b, c, d)
        cells = [np.searchsorted(e, x.to_numpy(), "right") for e, x in zip(edges, axes, strict=True)]
        spread = number.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own = hilbert(np.stack(cells, axis=1)) << 31
        return pd.Series(own | (spread >> np.uint64(33)).astype(np.int64))

    return key


def slice_of(bounds: list[int]):
    """A column function: the slice of a key."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), "right").astype(np.int32))

    return place


# --- all documents ----------------------------------------------------------


def token_blocks(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``number, doc_id, start, doc_tokens, size, ids, axis0..``: every document's ids in rows of
    at most ``BLOCK``, and its projection."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        number = TaskContext.get().partitionId() << 40
        for ids, texts in paired(batches):
            rows, axes, place = [], [], []
            for k, own in enumerate(encode.every(texts)):
                tokens = np.append(own, encode.kind.type(end_id))
                vector = project(tokens)
                for low in range(0, len(tokens), BLOCK):
                    block = tokens[low : low + BLOCK]
                    rows.append((number, low, len(tokens), len(block), block.tobytes()))
                    axes.append(vector)
                    place.append(k)
                number += 1
            numbers = list(zip(*rows, strict=True)) or [()] * 5
            vectors = np.array(axes).reshape(-1, DIMENSIONS)
            kinds = [*[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(place, pa.int64())),
                    *[pa.array(c, t) for c, t in zip(numbers, kinds, strict=True)],
                    *[pa.array(v) for v in vectors.T],
                ],
                ["doc_id", "number", "start", "doc_tokens", "size", "ids", *_AXES],
            )

    axes = ", ".join(f"{a} double" for a in _AXES)
    schema = f"number long, start long, doc_tokens long, size long, ids binary, {axes}"
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {id_type}, {schema}")


def _quantiles(column: str, steps: int) -> Column:
    """The inner bounds of ``steps`` parts of equal size."""
    shares = [k / steps for k in range(1, steps)] or [0.5]
    return F.percentile_approx(column, shares, 20 * steps)


def along_curve(blocks: DataFrame, slices: int | None = None) -> tuple[DataFrame, list[int]]:
    """The staged blocks with their ``key`` and ``slice``, and the ids before each slice and in all."""
    first = blocks.where("start = 0")
    grid = first.agg(*[_quantiles(a, 1 << GRID_BITS).alias(a) for a in _AXES]).first()
    held = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    if not held["rows"]:
        return blocks.select("*", F.lit(0).cast("long").alias("key"), F.lit(0).alias("slice")), [0]
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = slices or min(SLICES, held["rows"], max(least, math.ceil(held["n"] / SLICE)))
    key = curve_key([grid[a] for a in _AXES])("number", *_AXES)
    keyed = blocks.withColumn("key", key)
    bounds = keyed.agg(_quantiles("key", slices).alias("bounds")).first()["bounds"] if slices > 1 else []
    placed = keyed.withColumn("slice", slice_of(bounds)("key"))
    sizes = dict(placed.groupBy("slice").agg(F.sum("size")).collect())
    before = np.cumsum([0, *(sizes.get(k, 0) for k in range(slices))])
    return placed, before.tolist()


def cut_points(total: int, capacity: int) -> list[int]:
    """Where the last sequences end that are not full: powers of two, the largest first."""
    rest, at, out = total % capacity, total - total % capacity, []
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def cut_row(low: int, size: int, total: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """``(from, length, sequence_id, offset)`` of the pieces of the ids at ``low``."""
    full = total - total % capacity
    out, at, high = [], low, low + size
    while at < min(high, full):
        stop = min(high, (at // capacity + 1) * capacity)
        out.append((at - low, stop - at, at // capacity, at % capacity))
        at = stop
    if at < high:
        ends = cut_points(total, capacity)
        starts = [full, *ends]
        for k, end in enumerate(ends):
            if at < min(high, end):
                stop = min(high, end)
                out.append((at - low, stop - at, full // capacity + k, at - starts[k]))
                at = stop
    return out


def curve_pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slices: int | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece, and
    ``with_ids`` its ``ids``. Sequences follow the curve by number."""
    blocks = stage_table(token_blocks(docs, path or vocabulary_path(), end_id), "token-blocks")
    placed, before = along_curve(blocks, slices)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, at = before[-1], -1, 0
        for batch in batches:
            rows, tokens, place = [], [], []
            names = ["slice", "size", "start", "doc_tokens", "ids"]
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            for k, (part, size, start, whole, raw) in enumerate(zip(*columns, strict=True)):
                if part != now:
                    now, at = part, before[part]
                own = np.frombuffer(raw, dtype=f"<u{len(raw) // size}").astype("<u4")
                for low, length, sequence, offset in cut_row(at, size, total, capacity):
                    piece = own[low : low + length]
                    crc = zlib.crc32(piece.tobytes())
                    rows.append((start + low, length, crc, whole, sequence, offset))
                    place.append(k)
                    if with_ids:
                        tokens.append(piece.astype(np.int32))
                at += size
            numbers = list(zip(*rows, strict=True)) or [()] * 6
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            arrays = [ids.take(pa.array(place, pa.int64())), *[pa.array(c, pa.int64()) for c in numbers]]
            if with_ids:
                arrays.append(pa.array(tokens, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [*PIECE, *["ids"] * with_ids])

    held = placed.select("slice", "key", "number", "start", "size", "doc_tokens", "ids", "doc_id")
    sorted_ = held.repartition(max(1, len(before) - 1), "slice").sortWithinPartitions(
        "slice", "key", "number", "start"
    )
    longs = ", ".join(f"{n} long" for n in PIECE[1:])
    return sorted_.mapInArrow(cut, f"doc_id {id_type}, {longs}" + ", ids array<int>" * with_ids)


def curve_sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids, doc_ids, lengths``: the packed token ids, at most ``capacity`` each."""
    pieces = curve_pack(docs, path, capacity, with_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts")
    return (
        pieces.groupBy("sequence_id")
        .agg(parts)
        .select(
            "sequence_id",
            F.flatten("parts.ids").alias("ids"),
            F.col("parts.doc_id").alias("doc_ids"),
            F.transform("parts.ids", F.size).alias("lengths"),
        )
    )
