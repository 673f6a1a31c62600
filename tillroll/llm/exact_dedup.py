"""Exact deduplication by a content sort, in native expressions only.

Rows are range-partitioned by sampled splitters over their normalised content,
sorted within each range (Spark's external sort), and each row is compared in full with the
one before it. A content that holds more than a range's fair share of the rows is
dealt to several slots first; its run heads, one per slot, are compared in full
in the same way.

Defined results: a null text is the empty text; empty texts are equal to each other
and to texts of blanks alone. Of equal texts the one with most code points stays, then the
smallest ``doc_id`` (a null id comes last). Of rows that are the same in id
and text exactly one stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted
from tillroll.llm.common import body, stage_table

# The characters that do not count, [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")

PREFIX = 24
"""Leading characters in a splitter. Equal contents share them, and the hash
behind them keeps the many contents that begin alike apart."""

HOT_SHARE = 4
"""A content with over 1/(HOT_SHARE x partitions) of the rows is dealt to slots."""


def normalised(text: Column) -> Column:
    """The text without any blank."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _hot(docs: DataFrame, partitions: int) -> DataFrame:
    """Contents over a fair share, and the slots for each: at most
    ``HOT_SHARE x partitions`` rows, whatever the input."""
    fair = max(1, docs.count() // (HOT_SHARE * partitions))
    counts = docs.select(F.xxhash64(normalised(body())).alias("hash")).groupBy("hash").count()
    slots = F.ceil(F.col("count") / fair).cast("int").alias("slots")
    return counts.where(F.col("count") > fair).select("hash", slots)


def placed(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row as ``row`` with what it is compared by, in the range of its content and slot."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = dict.fromkeys((*columns, "doc_id", "text"))
    keyed = docs.select(
        F.struct(*[quoted(c) for c in needed]).alias("row"),
        normalised(body()).alias("norm"),
        F.monotonically_increasing_id().alias("place"),
    ).select(
        "row", "place", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("hash")
    )
    # by the row's place, as all rows of a hot content may have one id
    slot = F.when(F.col("slots").isNotNull(), F.pmod(F.xxhash64("row.doc_id", "place"), F.col("slots")))
    return (
        keyed.join(F.broadcast(_hot(docs, partitions)), "hash", "left")
        .withColumn("slot", slot)
        .drop("slots", "place")
        .repartitionByRange("prefix", "hash", "slot")
        .withColumn("norm", normalised(body(F.col("row.text"))))
        .withColumn("points", F.char_length(body(F.col("row.text"))))
    )


def mark(docs: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Every row as ``row`` (a struct of ``columns``) with ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256``, the hash of the normalised text."""
    # clustered as the ranges are, so neither window shuffles again
    best = [F.col("points").desc(), F.col("row.doc_id").asc_nulls_last()]
    key = ["prefix", "hash", "slot"]
    content = Window.partitionBy(*key).orderBy("norm", *best)
    is_head = ~F.lag("norm").over(content).eqNullSafe(F.col("norm"))
    run = Window.partitionBy(*key, "run")
    marked = (
        placed(docs, columns)
        .withColumn("head", is_head)
        .withColumn("run", F.sum(F.col("head").cast("long")).over(content))
        .select(
            F.struct(*[F.col("row")[c].alias(c) for c in columns]).alias("row"),
            F.col("row.doc_id").alias("id"),
            *key,
            "run",
            "points",
            "head",
            F.sha2("norm", 256).alias("sha"),
            F.when(F.col("head") & F.col("slot").isNotNull(), F.col("norm")).alias("norm"),
        )
        .withColumn("size", F.count("*").over(run))
        .withColumn("first", F.max(F.when(F.col("head"), F.struct("id"))).over(run)["id"])
    )
    staged = stage_table(marked.drop("prefix"), "exact-dedup")
    across = _across_slots(staged)
    return staged.join(F.broadcast(across), ["hash", "slot", "run"], "left").select(
        "row",
        F.when(F.col("whole").isNull(), F.col("first")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"),
        (F.col("head") & F.coalesce("leads", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _across_slots(staged: DataFrame) -> DataFrame:
    """Run heads of hot contents, compared across their slots: one row per hot
    content and slot, a fixed multiple of the number of partitions."""
    heads = staged.where(F.col("head") & F.col("slot").isNotNull())
    best = [F.col("points").desc(), F.col("id").asc_nulls_last(), F.col("slot")]
    content = Window.partitionBy("hash").orderBy("norm", *best)
    group = Window.partitionBy("hash", "group")
    return (
        heads.select("hash", "slot", "run", "norm", "points", "id", "size")
        .withColumn("leads", ~F.lag("norm").over(content).eqNullSafe(F.col("norm")))
        .withColumn("group", F.sum(F.col("leads").cast("long")).over(content))
        .select(
            "hash",
            "slot",
            "run",
            "leads",
            F.sum("size").over(group).alias("whole"),
            F.max(F.when(F.col("leads"), F.struct("id"))).over(group)["id"].alias("best"),
        )
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: which row of its equals stays."""
    return mark(docs).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return mark(docs, docs.columns).where("kept").select("row.*")
