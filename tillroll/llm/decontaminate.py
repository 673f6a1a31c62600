"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ten consecutive words of every benchmark item; an item
of fewer words is one window. For each window length there is a shift table from blocks
of two words: how far the search may move on because no window can end here. A block in no window
moves it by nearly a whole window, so most words of a clean document are
never looked up. Where the shift is zero, the bucket of that last block gives
the windows to test; their first word is compared, then all words.

The benchmark is a stated set of queries. It is read in blocks of items of at most
``BLOCK_BYTES`` on average, each of which is broadcast and run against all
documents. Behind every ``RESIDENT`` blocks the state is staged and their tables are dropped, so no task
and no driver holds more of them, however large the benchmark is.

Defined results: a null or empty text has no words and no hit; an item without words has no
window. A null ``item_id`` is named by the empty text. Items that
share an id count once. Rows are searched one by one, so repeated rows repeat.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Rounds, texts_of

WIDTH = 10
BLOCK_BYTES = 8 << 20
RESIDENT = 4
"""Blocks of the benchmark that are held at once."""

# One byte of a word, A-Z in lower case, or a blank for all that stands between words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Search:
    """Shift tables and buckets for windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], length: int) -> None:
        self.length = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list]] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                block = b" ".join(window[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            last = b" ".join(window[length - self.block :])
            by_first = self.buckets.setdefault(last, {})
            by_first.setdefault(window[0], []).append((list(window), items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """``(start, items)`` of every occurrence of a window."""
        shift, default, length = self.shift.get, self.default, self.length
        at, stop, pair = length - 1, len(words), self.block == 2
        while at < stop:
            block = words[at - 1] + b" " + words[at] if pair else words[at]
            step = shift(block, default)
            if step:
                at += step
                continue
            start = at - length + 1
            for window, items in self.buckets[block].get(words[start], ()):
                if words[start : at + 1] == window:
                    yield start, items
            at += 1


def searches(items: Sequence[tuple[str, bytes]], width: int = WIDTH) -> list[Search]:
    """One search per window length that occurs."""
    windows: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        length = min(width, len(words))
        if length:
            for start in range(len(words) - length + 1):
                windows[length][tuple(words[start : start + length])].add(item)
    return [Search(found, length) for length, found in sorted(windows.items())]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def hits(words: list[bytes], found: list[Search]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word spans inside occurrences, and the items they come from."""
    spans, items = [], set()
    for search in found:
        for start, named in search.find(words):
            spans.append((start, start + search.length))
            items |= named
    return _merge(spans), items


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    held = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(held / block_bytes))


def _block(benchmark: DataFrame, block: int, blocks: int, width: int):
    """The searches of one block of items, as a broadcast variable."""
    own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    named = own.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    items = [(r[0], (r[1] or "").encode()) for r in named.toLocalIterator()]
    return benchmark.sparkSession.sparkContext.broadcast(searches(items, width))


def _over_blocks(
    state: DataFrame, benchmark: DataFrame, blocks: int, width: int, step: Callable
) -> DataFrame:
    """``step(state, tables, block)`` for every block, staged behind every ``RESIDENT`` of them."""
    rounds, held = Rounds(state.sparkSession, "contamination"), []
    for block in range(blocks):
        held.append(_block(benchmark, block, blocks, width))
        state = step(state, held[-1], block)
        if len(held) == RESIDENT and block < blocks - 1:
            state = rounds.stage(state)
            for tables in held:
                tables.destroy()
            held = []
    return state


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, n_words, spans, items``: the hit word spans ``[start, end)`` and item names.

    Every block of the benchmark adds to the spans and items of each document;
    the last one leaves the text out.
    """
    blocks = benchmark_blocks(benchmark, block_bytes)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = "spans array<array<int>>, items array<string>"
    none = {"spans": F.array().cast("array<array<int>>"), "items": F.array().cast("array<string>")}

    def add(state: DataFrame, found, block: int) -> DataFrame:
        last = block == blocks - 1
        schema = f"doc_id {id_type}, {'n_words long' if last else 'text string'}, {held}"
        return state.mapInArrow(_scan(found, last), schema)

    state = docs.select("doc_id", "text").withColumns(none)
    return _over_blocks(state, benchmark, blocks, width, add)


def _scan(found, last: bool):
    lists = {"spans": pa.list_(pa.list_(pa.int32())), "items": pa.list_(pa.string())}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [batch.column(i).to_pylist() for i in (2, 3)]
            counts, spans, items = [], [], []
            for text, old, named in zip(texts_of(batch), *before, strict=True):
                words = words_of(text)
                own, more = hits(words, found.value)
                counts.append(len(words))
                spans.append(_merge([*map(tuple, old), *own]))
                items.append(sorted({*named, *more}))
            middle = pa.array(counts, pa.int64()) if last else batch.column(1)
            names = ["doc_id", "n_words" if last else "text", *lists]
            columns = [
                batch.column(0),
                middle,
                pa.array(spans, lists["spans"]),
                pa.array(items, lists["items"]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return scan


def digest(found: DataFrame) -> DataFrame:
    """The hits of each document as counts and a hash of its items."""
    lengths = F.transform("spans", lambda s: s[1] - s[0])
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, whole."""
    blocks = benchmark_blocks(benchmark, block_bytes)

    def clean(state: DataFrame, found, block: int) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                free = [not hits(words_of(t), found.value)[0] for t in texts_of(batch)]
                yield batch.filter(pa.array(free, pa.bool_()))

        return state.mapInArrow(keep, state.schema)

    return _over_blocks(docs, benchmark, blocks, width, clean)
