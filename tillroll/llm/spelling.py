"""Spelling variants of words by a relational trie frontier.

1. *Words.* Each task counts the runs of letters of its texts, in lower case, and Spark sums the counts.
   What stands often enough is the vocabulary.
2. *Trie.* The edges ``node, letter, child`` of all prefixes are a distributed table, with those of the
   words read backwards beside them. A node is the hash of its prefix. An edge also carries a mask of 64 bits, in
   which the hash of every suffix below it sets one.
3. *Frontier.* A state is a word, the letters of it still to be read, a node, and an edit made.
   A word without an edit is at the nodes of its own prefixes, so the first states come from one join of these
   with their nodes' edges: another letter read in place of the word's, or one more. Then,
   level by level, each state's next letter is joined to the edges of its node. States whose remaining
   letters are not in an edge's mask end early. One without remaining letters at a word's end is a
   neighbour; both words are compared, as nodes are hashes. A letter left out is the pair seen
   from the longer word.
4. *Forms.* A word's form is its most frequent neighbour, if that is frequent enough; roots follow
   forms by doubling.

Of two neighbours' common prefix and suffix one holds half the shorter word, so edits
are tried in the second half only, forwards and backwards: the first nodes, through which all words
pass, are never joined. Words of over ``DEPTH`` letters, whose levels would be as many joins, meet by the hashes of what is left
after deleting one letter, and are compared.

No join is left to Spark's estimate of a side: that is of the files, in which words that repeat take next to nothing, and an
explode does not raise it. A level's states are sent to all tasks up to ``SENT`` rows; else both sides are shuffled.

Defined results: a null or empty text has no words. A null ``doc_id`` has no checksum, so none of its
runs loses a letter. Repeated rows count repeatedly. Without words there are no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Rounds, paired, stage_table

LEAST_LENGTH, LEAST_TIMES, RATIO = 6, 5, 5
MODULUS = 199
"""One run in so many loses a letter."""

DEPTH = 65
FLUSH = 1 << 18
SENT = 1 << 16
"""States sent to all tasks at most; they are of words of ``DEPTH`` letters, so some 20 MB."""
LETTERS = re.compile("[a-zÀ-ÿ]+")
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASE = 1_000_003


# --- words ------------------------------------------------------------------


def counted_words(
    docs: DataFrame, length: int = LEAST_LENGTH, times: int = LEAST_TIMES, modulus: int | None = None
) -> DataFrame:
    """``word, n``: the letter runs of at least ``length`` letters that stand ``times`` times.

    With a ``modulus`` a run whose checksum behind its document's id it divides loses one letter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            held = {w: n for w, n in seen.items() if n}
            seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )

        for ids, texts in paired(batches):
            for doc, text in zip(ids.to_pylist(), texts, strict=True):
                before = zlib.crc32(f"{doc}:".encode())
                lost = modulus and doc is not None
                for runs in _runs(text, length):
                    seen.update(runs)
                    if lost:
                        for run in runs:
                            h = zlib.crc32(run.encode(), before)
                            if not h % modulus:
                                at = h % len(run)
                                seen[run] -= 1
                                seen[run[:at] + run[at + 1 :]] += len(run) > length
                    if len(seen) > FLUSH:
                        yield from out()
        yield from out()

    partial = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _runs(text: bytes, length: int, size: int = 1 << 20) -> Iterator[list[str]]:
    """The runs of at least ``length`` letters, some at a time."""
    held: list[str] = []
    for found in LETTERS.finditer(text.lower().decode()):
        if found.end() - found.start() >= length:
            held.append(found.group())
            if len(held) == size:
                yield held
                held = []
    yield held


# --- the trie ---------------------------------------------------------------


def _node(side: Column, prefix: Column) -> Column:
    return F.xxhash64(side, prefix)


def _place(suffix: str) -> str:
    """The bit of a suffix in a mask."""
    return f"CAST(shiftrightunsigned(xxhash64({suffix}), 58) AS INT)"


def _sided(words: DataFrame) -> DataFrame:
    """``word, side, spelt``: every word forwards (0) and backwards (1)."""
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("spelt")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("spelt")),
    )
    return words.select("word", F.inline(both))


def trie(words: DataFrame, least: int) -> DataFrame:
    """``node, letter, child, mask, below``: the edges behind prefixes of at least ``least`` letters."""
    at = F.explode(F.sequence(F.lit(least), F.char_length("spelt") - 1)).alias("at")
    prefixes = _sided(words.where(F.char_length("word") > least)).select("side", "spelt", at)
    spelt, depth = F.col("spelt"), F.col("at")
    return (
        prefixes.select(
            _node(F.col("side"), F.substring(spelt, F.lit(1), depth)).alias("node"),
            F.substring(spelt, depth + 1, F.lit(1)).alias("letter"),
            _node(F.col("side"), F.substring(spelt, F.lit(1), depth + 1)).alias("child"),
            F.expr(f"shiftleft(1L, {_place('substring(spelt, at + 2)')})").alias("bit"),
        )
        .groupBy("node", "letter", "child")
        .agg(F.bit_or("bit").alias("mask"), F.count("*").alias("below"))
    )


def _possible() -> Column:
    """Whether the mask of an edge holds the remaining letters."""
    return F.expr(f"(shiftrightunsigned(mask, {_place('rest')}) & 1) = 1")


def first_states(words: DataFrame, edges: DataFrame) -> DataFrame:
    """``word, rest, node``: all states behind their one edit, in the second half of the word."""
    half = F.floor(F.char_length("word") / 2).cast("int")
    low = F.when(F.col("side") == 0, half).otherwise(F.char_length("word") - half)
    at = F.explode(F.sequence(low, F.char_length("spelt"))).alias("at")
    own = _sided(words).select("word", "side", "spelt", at)
    spelt, depth = F.col("spelt"), F.col("at")
    own = own.select(
        "word",
        _node(F.col("side"), F.substring(spelt, F.lit(1), depth)).alias("node"),
        F.expr("substring(spelt, at + 1)").alias("rest"),
    )
    read = F.substring("rest", 1, 1)
    # the lesser of two words of equal length finds the pair
    other = F.when((read != "") & (F.col("letter") > read), F.expr("substring(rest, 2)"))
    more = F.when(F.col("letter") != read, F.col("rest"))  # behind equal letters, not before them
    return (
        own.hint("merge")
        .join(edges.drop("below"), "node")
        .select("word", F.col("child").alias("node"), "mask", F.explode(F.array(other, more)).alias("rest"))
        .where(F.col("rest").isNotNull() & _possible())
        .select("word", "rest", "node")
    )


def neighbours(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``word, n, other, other_n``: the pairs of the staged ``word, n`` one edit apart, both ways."""
    size = words.agg(F.min(F.char_length("word")), F.max(F.char_length("word"))).first()
    if size[0] is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n"))
    short = words.where(F.char_length("word") <= depth)
    edges = stage_table(trie(short, max(1, size[0] // 2)), "trie")
    ends = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    ends = short.select(F.col("word").alias("other"), ends).select(
        "other",
        _node(F.col("side"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.reverse("other"))).alias("node"),
    )
    rounds = Rounds(words.sparkSession, "states")
    states = rounds.stage(first_states(short, edges))
    found = []
    while n := states.count():
        how = "broadcast" if n <= SENT else "merge"
        done = states.where("rest = ''").hint(how).join(ends, "node").select("word", "other")
        found.append(stage_table(done.where(F.levenshtein("word", "other") == 1), "pairs"))
        letter = F.substring("rest", 1, 1).alias("letter")
        moved = states.where("rest != ''").select("word", "node", letter, F.expr("substring(rest, 2)").alias("rest"))
        step = moved.hint(how).join(edges.drop("below"), ["node", "letter"]).where(_possible())
        states = rounds.stage(step.select("word", "rest", F.col("child").alias("node")))
    rounds.clear()
    if size[1] > depth:
        found.append(long_neighbours(words.where(F.char_length("word") >= depth)))
    pairs = found[0] if found else words.select("word", F.col("word").alias("other")).limit(0)
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    least, greatest = F.least("word", "other"), F.greatest("word", "other")
    pairs = pairs.select(least.alias("word"), greatest.alias("other")).distinct()
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    named = both.join(known.hint("merge"), "other").join(words.hint("merge"), "word")
    return named.select("word", "n", "other", "other_n")


# --- long words -------------------------------------------------------------


def _powers(n: int, prime: int, base: int = BASE) -> np.ndarray:
    out = np.ones(1, dtype=np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def deletion_keys(word: str) -> np.ndarray:
    """Hashes of the word and of all that is left of it after deleting one letter."""
    letters = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    halves = []
    for prime in PRIMES:
        before = np.concatenate([[0], np.cumsum(letters * _powers(len(letters), prime) % prime)])
        behind = (before[-1] - before[1:]) % prime * pow(BASE, -1, prime)
        halves.append(np.append((before[:-1] + behind) % prime, before[-1] % prime))
    return np.unique(halves[0] << 31 | halves[1])


def long_neighbours(words: DataFrame) -> DataFrame:
    """``word, other``: the pairs one edit apart of words of any length."""
    named = stage_table(words.select(F.monotonically_increasing_id().alias("id"), "word"), "long-words")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = deletion_keys(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.full(len(keys), number))], ["key", "id"]
                )

    keys = stage_table(named.mapInArrow(keyed, "key long, id long"), "deletions")
    met = keys.hint("merge").join(keys.select("key", F.col("id").alias("other_id")), "key")
    pairs = met.where("id < other_id").select("id", "other_id").distinct()
    others = named.select(F.col("id").alias("other_id"), F.col("word").alias("other"))
    apart = F.udf(lambda a, b: one_edit(a, b), "boolean")("word", "other")
    met = pairs.join(named.hint("merge"), "id").join(others.hint("merge"), "other_id")
    return met.where(apart).select("word", "other")


def one_edit(a: str, b: str) -> bool:
    """Whether one letter inserted, deleted or replaced makes one word the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the length of the common prefix
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) >= len(b)) :] == b[low + (len(b) >= len(a)) :]


# --- forms ------------------------------------------------------------------


def spelling_variants(
    docs: DataFrame,
    length: int = LEAST_LENGTH,
    times: int = LEAST_TIMES,
    ratio: int = RATIO,
    modulus: int | None = None,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` per word of the vocabulary."""
    words = stage_table(counted_words(docs, length, times, modulus), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    frequent = -F.col("best.n") >= ratio * F.col("n")
    held = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("best.word")).alias("form"),
        F.when(frequent, -F.col("best.n")).alias("form_n"),
    )
    held = stage_table(held, "forms")
    roots = held.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    return held.join(followed(roots).hint("merge"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def followed(roots: DataFrame) -> DataFrame:
    """``word, root`` with each root's own root in its place, until none has one."""
    rounds = Rounds(roots.sparkSession, "roots")
    while True:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        held = rounds.stage(roots.join(above.hint("merge"), "root", "left").select("word", "root", "above"))
        roots = held.select("word", F.coalesce("above", "root").alias("root"))
        if held.where("above IS NOT NULL").isEmpty():
            return roots
