"""Processing order, and running values over it that one hot key cannot pin to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import sequence_order
from ..sources.scratch import staged


def with_order(records: DataFrame) -> DataFrame:
    """Adds `turn`: batch, shard, sequence, position. Shards of a batch are processed one after the other.

    Records delivered twice in a batch may share a turn; strictly() tells them apart.
    """
    return records.withColumn("turn", F.struct("batch_id", "shard_id", *sequence_order(F.col("sequence_number")), "position"))


def strictly(ordered: DataFrame, *ties: str, name: str = "ordered") -> DataFrame:
    """ordered with turns that no two rows share: equal ones are in the order of `ties`, then by a written row number."""
    numbered = ordered.withColumn("turn", F.struct("turn.*", *ties, F.monotonically_increasing_id().alias("row")))
    return staged(numbered, name)


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], block: str = "block", name: str = "ranges") -> DataFrame:
    """rows, written in ranges of (keys, order), with `block`: the number of a row's range, which never falls along the order.

    Ranges are of about one size whatever the keys are, so a key that has most rows spans most of them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(parts, *keys, *order).withColumn(block, F.spark_partition_id()), name)


def previous_max(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, ranged: bool = False) -> DataFrame:
    """Adds `out`: the greatest `value` of the rows of the same keys that come earlier, null for the first.

    A range's rows are scanned for themselves and joined with the greatest value of earlier ranges, one row each. Rows
    that are `ranged` are in_ranges() of at least these rows.
    """
    ranged = rows if ranged else in_ranges(rows, keys, order, "block")
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranged.groupBy(*keys, "block").agg(F.max(value).alias("of_block")).withColumn("of_earlier", F.max("of_block").over(earlier)).drop("of_block")
    inside = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("of_inside", F.max(value).over(inside))
    return own.join(blocks, [*keys, "block"]).withColumn(out, F.greatest("of_earlier", "of_inside")).drop("of_earlier", "of_inside", "block")


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` up to and with each row of the same keys, in ranges like previous_max."""
    ranged = in_ranges(rows, keys, order, "block")
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranged.groupBy(*keys, "block").agg(F.sum(value).alias("of_block")).withColumn("base", F.coalesce(F.sum("of_block").over(earlier), F.lit(0))).drop("of_block")
    inside = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("inside", F.sum(value).over(inside))
    return own.join(blocks, [*keys, "block"]).withColumn(out, F.col("base") + F.col("inside")).drop("base", "inside", "block")


def islands(rows: DataFrame, keys: list[str], time: str, tie: str, gap: int, out: str = "island") -> DataFrame:
    """Adds `out`: a number that rises whenever more than `gap` lies between a row and the one before it.

    Rows are compared inside their range, and a range's first row of a key with the last one of the range before it, so
    neither a key with very many rows nor one of its days is one task's.
    """
    ranged = in_ranges(rows, keys, [time, tie], "block")
    inside = Window.partitionBy(*keys, "block").orderBy(time, tie)
    starts = F.coalesce((F.col(time) - F.lag(time).over(inside) > gap).cast("long"), F.lit(0))
    own = ranged.withColumn("starts", starts).withColumn("inside", F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    per = own.groupBy(*keys, "block").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.sum("starts").alias("n"))
    along = Window.partitionBy(*keys).orderBy("block")
    opens = F.coalesce((F.col("first") - F.lag("last").over(along) > gap).cast("long"), F.lit(0))
    per = per.withColumn("opens", opens).withColumn("base", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(per.select(*keys, "block", "base"), [*keys, "block"]).withColumn(out, F.col("base") + F.col("inside")).drop("base", "inside", "starts", "block")
