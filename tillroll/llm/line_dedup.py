"""Line deduplication by overlapping three-line windows, in native expressions only.

A document's lines are split at ``\\n``; its windows are the runs of three
consecutive lines, one starting at every line but the last two. Of all windows
with the same lines, the first by ``(doc_id, position)`` stays; the lines that
any later one covers are removed. Covered positions are merged, so overlapping
windows remove a longer run once. Windows are judged on the input, not on what is left.

Defined results: a null text is the empty text, which has one empty line. Texts of
under three lines have no window and lose nothing. A null ``doc_id`` comes
first. Rows that are the same in id and text count as one occurrence
and lose the same lines; different texts under one id are ordered by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import body, text_hash

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, version, pos, w1, w2``: two hashes of every window, of its lines' 64-bit hashes."""
    hashes = F.transform(_lines(body()), lambda line: F.xxhash64(line))
    starts = F.sequence(F.lit(0), F.size("hashes") - F.lit(width))
    lines = docs.select("doc_id", text_hash().alias("version"), hashes.alias("hashes"))
    window = F.slice(F.col("hashes"), F.col("pos") + 1, F.lit(width))
    return (
        lines.where(F.size("hashes") >= width)
        .select("doc_id", "version", "hashes", F.explode(starts).alias("pos"))
        .select(
            "doc_id",
            "version",
            "pos",
            F.xxhash64(window).alias("w1"),
            F.xxhash64(F.lit(1), window).alias("w2"),
        )
    )


def covered_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, version, removed``: per document that loses lines, their positions.

    Repeated windows are found by a grouped count, combined before its shuffle,
    so a window that a third of the documents hold meets no task as a whole; in
    the join behind it adaptive execution splits such a window.
    """
    windows = line_windows(docs, width)
    place = F.struct("doc_id", "version", "pos")
    repeated = (
        windows.groupBy("w1", "w2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("w1", "w2", "first")
    )
    later = windows.join(repeated, ["w1", "w2"]).where(place != F.col("first"))
    spread = F.flatten(
        F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + F.lit(width - 1)))
    )
    return later.groupBy("doc_id", "version").agg(
        F.array_sort(F.array_distinct(spread)).alias("removed")
    )


def line_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, n_spans`` with the text that is left."""
    covered = covered_lines(docs, width).withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    rows = docs.select("doc_id", body().alias("text"), text_hash().alias("version"))
    joined = rows.join(
        covered,
        rows["doc_id"].eqNullSafe(covered["_id"]) & (rows["version"] == covered["_version"]),
        "left",
    ).select("doc_id", "text", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    lines = _lines(F.col("text"))
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.transform(F.array_except(places, F.col("removed")), lambda i: lines[i])
    behind = F.transform(F.col("removed"), lambda i: i + 1)
    kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        "doc_id",
        kept.alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.size(F.array_except(F.col("removed"), behind)).cast("long").alias("n_spans"),
    )
