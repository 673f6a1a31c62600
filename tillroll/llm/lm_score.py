"""Language-model scores by online logistic context mixing.

Texts are read as bytes, A-Z in lower case, with one end symbol. A byte is eight binary
decisions down a tree. Each of four predictors hashes the last 1, 2, 3 or 4 bytes to a
context and gives, for the node of the tree, the odds of a one among all bytes that
followed that context in the training documents. A mixer adds the predictors' log odds with
weights that a gate selects, and an adaptive table then corrects the mixed probability by what came of
equal ones. There are two such mixers, gated by the tree node and by the
kind of the last byte. While a document is coded the two are mixed in turn by how well
each has coded it so far; that running mixture is the mean of the two codes' probabilities, so a
text's total needs no loop over its bytes.

All of it comes from all training documents, of any length. Spark sums their byte 5-grams, from
which the contexts' counts follow, and their words for the base score. The weights are refined online
over the 5-grams, each as often as it occurs: every task codes its own block by block, and behind
every block the weights move against the coding error. A decision is coded by the odds that its own occurrence
left out would give, so that weights fit texts that were not counted. The tasks' weights are averaged by what
each gate has seen, for ``ROUNDS`` rounds; a last pass sums the tables. Tasks send sums of a fixed size. The
contexts of three and four bytes grow with the number of different 5-grams, up to ``GROWTH`` times.

Base score: words between blanks and one end word, each with ``log10((c + 1) / (N + V + 1))``.
At most ``TOP`` of the most frequent words, of at most ``LONGEST`` bytes each, are looked up in a
broadcast table; all others are summed per document and joined to the counts.

Defined results: a null or empty text is the end symbol alone. A null ``doc_id`` trains and is
not held out. Repeated rows count, and are scored, repeatedly. Without training documents N and V
are 0 and all odds are even.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import paired, stage_table

MODULUS, HELD = 7, 2
TOP = 1 << 17
LONGEST = 256
CONTEXT_BITS = {1: 8, 2: 12, 3: 14, 4: 15}
"""Bytes of context of each predictor, and bits of its hash; one byte is taken as it is."""

GROWN_FROM, GROWTH = 1 << 22, 4
"""Different 5-grams beyond which each eightfold doubles the contexts of three and four bytes, and
their largest multiple: the tables are broadcast."""

ORDERS = tuple(CONTEXT_BITS)
REACH = max(ORDERS)
END = b"\xff"  # in no UTF-8 text
START = END * REACH
SLAB = 1 << 20
FLUSH = 1 << 18
ROWS = 1024
ROUNDS = 2
BLOCK = 512
"""Different 5-grams coded between two moves of the weights."""

RATE = 0.1
PRIOR = 0.4
TABLE_PRIOR = 64
BUCKETS = 33

# Tree nodes of each byte, from the root, and the turns taken there.
_DEPTH = np.arange(8)
NODES = (1 << _DEPTH) + (np.arange(256)[:, None] >> (8 - _DEPTH))
TURNS = (np.arange(256)[:, None] >> (7 - _DEPTH)) & 1


def held_out(doc_id: object, modulus: int = MODULUS, held: int = HELD) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == held


def words_of(text: bytes) -> list[bytes]:
    """The words in lower case and the end word, which is empty."""
    return [*text.lower().split(), b""]


# --- byte n-grams -----------------------------------------------------------


def grams(texts: list[bytes], size: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every symbol with the ``REACH`` bytes before it, as a number, and the number of its text.

    In pieces of about ``size`` symbols, which may end within a text.
    """
    held: list[tuple[int, bytes]] = []
    total = 0
    for number, text in enumerate(texts):
        whole = START + text.lower() + END
        for low in range(0, len(whole) - REACH, size):
            held.append((number, whole[low : low + size + REACH]))
            total += len(held[-1][1])
            if total >= size:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b"".join(p for _, p in held), dtype=np.uint8).astype(np.uint64)
    every = np.zeros(len(b) - REACH, dtype=np.uint64)
    for k in range(REACH + 1):
        every <<= np.uint64(8)
        every |= b[k : len(every) + k]
    sizes = np.array([len(p) for _, p in held], dtype=np.int64)
    real = np.ones(len(b), dtype=bool)
    for k in range(1, REACH + 1):
        real[np.cumsum(sizes) - k] = False  # they reach into the next piece
    text = np.repeat([n for n, _ in held], sizes - REACH)
    return every[real[: len(every)]], text


def context_bits(distinct: int) -> dict[int, int]:
    """Bits of each order's contexts for a number of different 5-grams."""
    more = 0
    while (1 << more) < GROWTH and distinct > GROWN_FROM * 8**more:
        more += 1
    return {order: bits + (more if order > 2 else 0) for order, bits in CONTEXT_BITS.items()}


def contexts(gram: np.ndarray, bits_of: dict[int, int]) -> np.ndarray:
    """The context cell of each order, one column per predictor."""
    before = gram >> np.uint64(8)
    columns = []
    for order, bits in bits_of.items():
        own = before & np.uint64((1 << 8 * order) - 1)
        if bits < 8 * order:
            own = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        columns.append(own.astype(np.int64))
    return np.stack(columns, axis=1)


def _symbol(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64(255)).astype(np.int64)


# --- counts over all training documents -------------------------------------


def count_table(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """``word, gram, n``: counts of words (``gram`` null) and byte n-grams (``word`` null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        seen = pd.Series(dtype=np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            n, g = len(words), len(seen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*words.keys(), *[None] * g], pa.binary()),
                    pa.array([*[None] * n, *seen.index.tolist()], pa.int64()),
                    pa.array([*words.values(), *seen.tolist()], pa.int64()),
                ],
                ["word", "gram", "n"],
            )

        for ids, every in paired(batches):
            both = zip(ids.to_pylist(), every, strict=True)
            texts = [t for i, t in both if not held_out(i, modulus, held)]
            for t in texts:
                words.update(words_of(t))
                if len(words) > FLUSH:
                    yield from out()
                    words.clear()
                    seen = seen.iloc[:0]
            for gram, _ in grams(texts):
                codes, unique = pd.factorize(gram)
                own = pd.Series(np.bincount(codes, minlength=len(unique)), unique.astype(np.int64))
                seen = seen.add(own, fill_value=0).astype(np.int64) if len(seen) else own
                if len(seen) > FLUSH:
                    yield from out()
                    words.clear()
                    seen = seen.iloc[:0]
        if words or len(seen):
            yield from out()

    partial = docs.select("doc_id", "text").mapInArrow(count, "word binary, gram long, n long")
    return partial.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def context_counts(rows: DataFrame, bits_of: dict[int, int]) -> list[np.ndarray]:
    """Per order the symbols that followed each context, from 5-grams: tables of a given size."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            cell = contexts(gram, bits_of) * 256 + _symbol(gram)[:, None]
            order = np.broadcast_to(np.array(ORDERS), cell.shape)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(order.ravel(), pa.int32()),
                    pa.array(cell.ravel(), pa.int32()),
                    pa.array(np.repeat(n, len(ORDERS)), pa.int64()),
                ],
                ["order", "cell", "n"],
            )

    summed = rows.mapInArrow(cells, "order int, cell int, n long").groupBy("order", "cell")
    table = summed.agg(F.sum("n").alias("n")).toArrow()
    order, cell, n = (table.column(c).to_numpy() for c in ("order", "cell", "n"))
    out = []
    for k, bits in bits_of.items():
        counts = np.zeros((1 << bits, 256), dtype=np.float32)
        counts.reshape(-1)[cell[order == k]] = n[order == k]
        out.append(counts)
    return out


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Of a one at each tree node, per context."""
    out = np.zeros(counts.shape, dtype=np.float16)
    for low in range(0, len(counts), 4096):
        part = counts[low : low + 4096].astype(np.float64)
        for depth in range(8):
            turned = part.reshape(len(part), 1 << depth, 2, -1).sum(axis=3) + PRIOR
            odds = np.log(turned[:, :, 1] / turned[:, :, 0])
            out[low : low + 4096, 1 << depth : 2 << depth] = np.clip(odds, -12, 12)
    return out


# --- mixers -----------------------------------------------------------------


def _squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _kind(byte: np.ndarray) -> np.ndarray:
    """Eight kinds of a byte: end, blank, vowel, other letter, digit, mark, two beyond ASCII."""
    table = np.full(256, 5)
    table[97:123], table[48:58] = 3, 4
    table[list(b"aeiou")], table[list(b" \t\n\r\x0b\f")] = 2, 1
    table[128:192], table[192:] = 6, 7
    table[255] = 0
    return table[byte]


@dataclass
class Mixer:
    """Gated weights over the predictors, and the adaptive table behind them."""

    weights: np.ndarray
    table: np.ndarray

    @staticmethod
    def fresh(gates: int) -> Mixer:
        start = _squash(np.linspace(-8, 8, BUCKETS))
        return Mixer(np.full((gates, len(ORDERS)), 0.3), np.tile(start, (256, 1)))

    def mix(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("...k,...k->...", self.weights[gate], odds), -12, 12)

    @staticmethod
    def bucket(mixed: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(mixed, -8, 8) + 8) * (BUCKETS - 1) / 16).astype(np.int64)

    def predict(self, odds: np.ndarray, gate: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The probability of a one."""
        mixed = self.mix(odds, gate)
        return 0.5 * (_squash(mixed) + self.table[node, self.bucket(mixed)])


def _gates(gram: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """What selects each mixer's weights, per symbol and tree level."""
    last = _symbol(gram >> np.uint64(8))
    return [node, _kind(last)[:, None] * 8 + _DEPTH]


def fresh_mixers() -> list[Mixer]:
    return [Mixer.fresh(256), Mixer.fresh(64)]


class Refiner:
    """Moves a task's weights behind every block, and sums its tables."""

    def __init__(self, sums: list[np.ndarray], bits_of: dict[int, int], mixers: list[Mixer]) -> None:
        self.sums, self.bits_of, self.mixers = sums, bits_of, mixers
        self.seen = [np.zeros(len(m.weights)) for m in mixers]
        self.power = [np.zeros(m.weights.shape) for m in mixers]
        self.tables = [np.zeros((2, m.table.size)) for m in mixers]

    def _decisions(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, turn and the predictors' log odds without the decision's own occurrence."""
        symbol = _symbol(gram)
        turn = TURNS[symbol].astype(np.float64)
        cell = contexts(gram, self.bits_of)
        low = (symbol[:, None] >> (8 - _DEPTH)) << (8 - _DEPTH)
        half = 1 << (7 - _DEPTH)
        odds = np.empty((*turn.shape, len(ORDERS)))
        for k, sums in enumerate(self.sums):
            a, b, c = (sums[cell[:, k, None], low + w * half] for w in (0, 1, 2))
            one, zero = c - b - turn + PRIOR, b - a - (1 - turn) + PRIOR
            odds[..., k] = np.clip(np.log(one / zero), -12, 12)
        return NODES[symbol], turn, odds

    def refine(self, gram: np.ndarray, times: np.ndarray) -> None:
        """One block, coded with the weights so far, then learned from."""
        node, turn, odds = self._decisions(gram)
        flat, times = odds.reshape(-1, len(ORDERS)), np.repeat(times, 8)
        for k, (mixer, gate) in enumerate(zip(self.mixers, _gates(gram, node), strict=True)):
            gate = gate.ravel()
            miss = (turn.ravel() - _squash(mixer.mix(flat, gate))) * times
            gates = len(mixer.weights)
            seen = np.bincount(gate, weights=times, minlength=gates)
            moves = [np.bincount(gate, weights=miss * flat[:, j], minlength=gates) for j in range(len(ORDERS))]
            mean = np.stack(moves, axis=1) / np.maximum(seen, 1)[:, None]
            self.power[k] += mean**2
            mixer.weights += RATE * mean / np.sqrt(self.power[k] + 1e-9)
            self.seen[k] += seen

    def tally(self, gram: np.ndarray, times: np.ndarray) -> None:
        """How often each table entry was met, and how often a one came of it."""
        node, turn, odds = self._decisions(gram)
        times = np.repeat(times, 8)
        for table, mixer, gate in zip(self.tables, self.mixers, _gates(gram, node), strict=True):
            cell = (node * BUCKETS + mixer.bucket(mixer.mix(odds, gate))).ravel()
            table[0] += np.bincount(cell, weights=times, minlength=table.shape[1])
            table[1] += np.bincount(cell, weights=times * turn.ravel(), minlength=table.shape[1])


class Model:
    """All tables of a trained model."""

    def __init__(self, counts: list[np.ndarray], bits_of: dict[int, int]) -> None:
        self.bits_of = bits_of
        self.odds = [log_odds(c) for c in counts]
        self.mixers = fresh_mixers()

    def _decisions(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Per symbol and tree level: the predictors' log odds, the node, and the two gates."""
        node = NODES[_symbol(gram)]
        cell = contexts(gram, self.bits_of)
        odds = np.empty((*node.shape, len(ORDERS)), dtype=np.float32)
        for k, table in enumerate(self.odds):
            odds[..., k] = table[cell[:, k, None], node]
        return odds, node, _gates(gram, node)

    def symbol_codes(self, gram: np.ndarray) -> np.ndarray:
        """ln of each symbol's probability behind its context, one column per mixer."""
        odds, node, gates = self._decisions(gram)
        turn = TURNS[_symbol(gram)] == 1
        columns = []
        for mixer, gate in zip(self.mixers, gates, strict=True):
            one = np.clip(mixer.predict(odds, gate, node), 1e-6, 1 - 1e-6)
            columns.append(np.log(np.where(turn, one, 1 - one)).sum(axis=1))
        return np.stack(columns, axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text. An n-gram's code is the same wherever
        it stands, so the different ones of a piece are coded once."""
        total = np.zeros((len(texts), 2))
        for gram, text in grams(texts):
            codes, unique = pd.factorize(gram)
            per = [self.symbol_codes(unique[a : a + 65_536]) for a in range(0, len(unique), 65_536)]
            own = np.concatenate(per)
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            for k in range(2):
                total[text[first], k] += np.add.reduceat(own[codes, k], first)
        return (np.logaddexp(total[:, 0], total[:, 1]) - math.log(2)) / math.log(10)


def _sums(counts: np.ndarray) -> np.ndarray:
    """Counts summed along the symbols, in four bytes each while they fit."""
    total = counts.sum(axis=1, dtype=np.float64).max(initial=0)
    kind = np.uint32 if total < 1 << 32 else np.float64
    out = np.zeros((len(counts), 257), dtype=kind)
    for low in range(0, len(counts), 4096):
        out[low : low + 4096, 1:] = np.cumsum(counts[low : low + 4096], axis=1, dtype=np.float64)
    return out


def _over_blocks(batches: Iterator[pa.RecordBatch], step) -> None:
    for batch in batches:
        gram = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        times = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        for low in range(0, len(gram), BLOCK):
            step(gram[low : low + BLOCK], times[low : low + BLOCK])


def _refined(rows: DataFrame, shared, bits_of: dict[int, int], mixers: list[Mixer]) -> list[np.ndarray]:
    """Each mixer's weights behind one round over all 5-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refiner = Refiner(shared.value, bits_of, mixers)
        _over_blocks(batches, refiner.refine)
        for k, mixer in enumerate(refiner.mixers):
            seen = np.repeat(refiner.seen[k], len(ORDERS))
            place = np.flatnonzero(seen)
            columns = [np.full(len(place), k, np.int32), place.astype(np.int32), mixer.weights.ravel()[place], seen[place]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["mixer", "place", "weight", "seen"])

    parts = rows.mapInArrow(run, "mixer int, place int, weight double, seen double")
    merged = parts.groupBy("mixer", "place").agg(
        (F.sum(F.col("weight") * F.col("seen")) / F.sum("seen")).alias("weight")
    )
    out = [m.weights.copy() for m in mixers]
    for r in merged.collect():  # at most one row per weight
        out[r["mixer"]].reshape(-1)[r["place"]] = r["weight"]
    return out


def _tallied(rows: DataFrame, shared, bits_of: dict[int, int], mixers: list[Mixer]) -> list[np.ndarray]:
    """Each mixer's adaptive table from all 5-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refiner = Refiner(shared.value, bits_of, mixers)
        _over_blocks(batches, refiner.tally)
        for k, (met, ones) in enumerate(refiner.tables):
            place = np.flatnonzero(met)
            columns = [np.full(len(place), k, np.int32), place.astype(np.int32), met[place], ones[place]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["mixer", "place", "met", "ones"])

    parts = rows.mapInArrow(run, "mixer int, place int, met double, ones double")
    merged = parts.groupBy("mixer", "place").agg(F.sum("met").alias("met"), F.sum("ones").alias("ones"))
    out = [m.table.copy() for m in mixers]
    for r in merged.collect():  # at most one row per table entry
        flat = out[r["mixer"]].reshape(-1)
        flat[r["place"]] = (r["ones"] + TABLE_PRIOR * flat[r["place"]]) / (r["met"] + TABLE_PRIOR)
    return out


def fit(counted: DataFrame) -> Model:
    """A model of the staged counts of all training documents."""
    rows = counted.where("gram IS NOT NULL").select("gram", "n")
    bits_of = context_bits(rows.count())
    counts = context_counts(rows, bits_of)
    model = Model(counts, bits_of)
    shared = counted.sparkSession.sparkContext.broadcast([_sums(c) for c in counts])
    del counts
    for _ in range(ROUNDS):
        refined = _refined(rows, shared, bits_of, model.mixers)
        for mixer, weights in zip(model.mixers, refined, strict=True):
            mixer.weights = weights
    for mixer, table in zip(model.mixers, _tallied(rows, shared, bits_of, model.mixers), strict=True):
        mixer.table = table
    shared.destroy()
    return model


# --- scoring ----------------------------------------------------------------


def lm_scores(
    docs: DataFrame, modulus: int = MODULUS, held: int = HELD, top: int = TOP
) -> DataFrame:
    """Per document its base score, the model's score and its bits per byte."""
    spark = docs.sparkSession
    counted = stage_table(count_table(docs, modulus, held), "lm-counts")
    words = counted.where("word IS NOT NULL").select("word", "n")
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    whole = math.log10(n + v + 1)
    short = words.where(F.octet_length("word") <= LONGEST)
    known = {w: math.log10(c + 1) - whole for w, c in _frequent(short, top).items()}
    shared = spark.sparkContext.broadcast((known, fit(counted)))
    parts = stage_table(_parts(docs, shared, modulus, held), "lm-parts")
    seen = F.coalesce("n", F.lit(0))
    rare = (
        parts.where("word IS NOT NULL")
        .select("row", "word", "times")
        .join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * (F.log10(seen + 1) - whole)).alias("rare_score"),
            F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    rows = parts.where("word IS NULL").drop("word", "times")
    score = F.col("score")
    return rows.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
        (-score / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def _frequent(words: DataFrame, top: int) -> dict[bytes, int]:
    """The counts of the most frequent words, at most ``top``.

    They are those above a count that a histogram of counts gives, eight steps per doubling;
    words of equal count are in or out together. All others are joined.
    """
    step = F.floor(F.log2("n") * 8)
    histogram = words.groupBy(step.alias("step")).count().collect()
    held, lowest = 0, None
    for r in sorted(histogram, key=lambda r: -r["step"]):
        held += r["count"]
        if held > top:
            break
        lowest = r["step"]
    if lowest is None:
        return {}
    return {bytes(r["word"]): r["n"] for r in words.where(step >= lowest).collect()}


def _parts(docs: DataFrame, shared, modulus: int, held: int) -> DataFrame:
    """One row per document with its score and what its frequent words give, and one per
    document and other word."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = "row doc_id held_out n_tokens n_known n_bytes base_score score word times".split()
    kinds = f"long {id_type} boolean long long long double double binary long".split()
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, model = shared.value
        row = TaskContext.get().partitionId() << 40
        for ids, texts in paired(batches):
            every = ids.to_pylist()
            types = [ids.type if n == "doc_id" else arrow[k] for n, k in zip(names, kinds, strict=True)]
            scores = model.scores(texts).tolist()
            for low in range(0, len(texts), ROWS):
                docs_out, rare_out = [], []
                part = slice(low, low + ROWS)
                for doc, text, own in zip(every[part], texts[part], scores[part], strict=True):
                    words = words_of(text)
                    codes = list(map(code.get, words))
                    held_codes = [c for c in codes if c is not None]
                    docs_out.append(
                        (row, doc, held_out(doc, modulus, held), len(words), len(held_codes),
                         len(text), math.fsum(held_codes), own, None, None)
                    )
                    if len(held_codes) < len(words):
                        rest = Counter(
                            w for w, c in zip(words, codes, strict=True) if c is None
                        )
                        rare_out.extend((row, w, t) for w, t in rest.items())
                    row += 1
                yield _batch(docs_out, names, types)
                blank = [None] * 7
                yield _batch([(r, *blank, w, t) for r, w, t in rare_out], names, types)

    schema = ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True))
    return docs.select("doc_id", "text").mapInArrow(score, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)
