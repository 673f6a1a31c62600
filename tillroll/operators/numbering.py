"""Dense row numbers without sending all rows to one task."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted
from tillroll.session import stage_table
from tillroll.markers import names, publish, read_markers

SLICE_BYTES = 256 << 20
MOST_SLICES = 100_000

_ROW_BITS = (1 << 33) - 1
"""Low bits of monotonically_increasing_id: the row's place in its partition."""


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "id",
    start: int = 1,
    slices: int | None = None,
) -> DataFrame:
    """Number all rows ``start, start + 1, ...`` in ``order_by`` order.

    ``order_by`` has to be unique up to rows that are equal throughout. Rows
    are range-partitioned and sorted, staged with their slice and their place
    in it, and each slice is shifted by the sizes of the slices before it. The
    staged table pins the placement: a task that is run again cannot number
    its rows differently. Only one row per slice is broadcast.

    ``slices`` is the number of sort tasks. By default there are as many as shuffle
    partitions, and more where the planner's estimate of the input gives
    one over ``SLICE_BYTES``.
    """
    spark = df.sparkSession
    if slices is None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # an estimate of a join may be far too large; a slice is broadcast as one row
        slices = max(parts, min(-(-size // SLICE_BYTES), MOST_SLICES))
    order = list(map(quoted, order_by))
    placed = stage_table(
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "_slice": F.spark_partition_id(),
                "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
            }
        ),
        "numbered",
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_slice")
        .agg(F.count("*").alias("_rows"))
        .select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )
    number = quoted("_shift") + quoted("_place") + F.lit(start).cast("bigint")
    return (
        placed.join(F.broadcast(shifts), "_slice")
        .withColumn(name, number)
        .drop("_slice", "_place", "_shift")
    )


def max_id(df: DataFrame, key: str) -> DataFrame:
    """The largest id, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(quoted(key)), F.lit(0)).cast("bigint").alias("max_id"))


def assign_ids(
    existing: DataFrame, new: DataFrame, key: str, order_by: Sequence[str]
) -> DataFrame:
    """Number a batch of new rows from the largest existing id + 1 on.

    The largest id is read once, here: evaluated lazily, the same batch would
    get other ids after it has been appended. One writer at a time may assign.
    """
    highest = max_id(existing, key).first()["max_id"]
    return number_rows(new, order_by, name=key, start=highest + 1)


# --- several writers --------------------------------------------------------


def reserve_ids(
    spark: SparkSession, ledger: str, size: int, batch: str, first: int = 1
) -> tuple[int, int]:
    """Reserve ``size`` ids behind all reserved ones; returns the first and the last.

    The ledger is a folder with one numbered marker per range. A writer reads the last one and
    tries to create the next; only one can, and the others go on behind it, so ranges are disjoint
    and leave no gap, in whatever order their rows are written. A batch that is in the
    ledger gets its range again. ``first`` counts for an empty ledger.
    """
    while True:
        held = names(spark, ledger)
        last = first - 1
        if held:
            rows = read_markers(spark, ledger).select(F.from_json("value", _RANGE).alias("r")).select("r.*")
            own = rows.where(F.col("batch") == batch).select("low", "high").first()
            if own is not None:
                if own.high - own.low + 1 != size:
                    raise ValueError(f"batch {batch} has reserved {own.high - own.low + 1} ids, not {size}")
                return own.low, own.high
            last = max(last, rows.agg(F.max("high")).first()[0])
        number = int(held[-1]) + 1 if held else 0
        taken = {"batch": batch, "low": last + 1, "high": last + size}
        if publish(spark, f"{ledger}/{number:019d}", json.dumps(taken)):
            return last + 1, last + size


_RANGE = "batch string, low bigint, high bigint"


def assign_reserved_ids(
    existing: DataFrame, new: DataFrame, key: str, order_by: Sequence[str], ledger: str, batch: str
) -> DataFrame:
    """Number a batch of new rows with ids no other writer gets, dense within the batch.

    An empty ledger starts behind the largest existing id. The batch is staged first, so that the rows
    counted are the rows numbered. Repeated, it gets the same ids.
    """
    spark = new.sparkSession
    rows = stage_table(new, "batch")
    size = rows.count()
    if not size:
        return number_rows(rows, order_by, name=key)
    behind = max_id(existing, key).first()["max_id"] + 1
    low, _ = reserve_ids(spark, ledger, size, batch, behind)
    return number_rows(rows, order_by, name=key, start=low)
