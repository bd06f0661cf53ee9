"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder, staged  # noqa: F401

#: The white space that the contracts name: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that their names can't clash with an operator's own."""
    return F.struct(*map(named, df.columns)).alias(name)


def hash_share(n_rows: int, most: int, *key: Column | str, seed: str = "sample") -> Column:
    """Whether a row is one of about `most` of n_rows, the same ones in each run: those with the least hashes of their key.

    The bound is a place in the whole range of 64-bit hashes, so the share can be as small as most / n_rows ever gets.
    """
    if n_rows <= most:
        return F.lit(True)
    return F.xxhash64(F.lit(seed), *key) < F.lit(-(2**63) + (2**64 * most) // n_rows)


_held: dict[object, object] = {}


def held_by_worker(key: object, make: Callable[[], object]) -> object:
    """What make() gives, once for each Python worker, so that look-up tables serve all its tasks.

    A worker holds those of one operator at a time: what another one asks for takes their place, and memory doesn't add
    up over the stages of a job.
    """
    if key not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Returns what this process has freed to the system; else a worker that is kept for later tasks holds its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, a function for mapInArrow, that gives back freed memory when a partition is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocked(df: DataFrame, key: str, unit: str, size: str, most: int | Column) -> DataFrame:
    """Deals each group of `key` into tiles: blocks of about `most` rows by a hash of `unit`, one tile for each pair of blocks.

    A group of n rows has b = ceil(n / most) blocks and b(b+1)/2 tiles; every pair of its rows meets in one tile, or in
    a diagonal tile if both rows are of one block. Adds tile_a <= tile_b, and block (the row's own). Groups of one block
    keep one row for each row. `size` names the column with n.
    """
    b = F.greatest(F.ceil(F.col(size) / (most if isinstance(most, Column) else F.lit(most))), F.lit(1)).cast("int")
    df = df.withColumn("n_blocks", b).withColumn("block", F.pmod(F.xxhash64(unit), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return (
        df.withColumn("other", other)
        .withColumn("tile_a", F.least("block", "other"))
        .withColumn("tile_b", F.greatest("block", "other"))
        .drop("other", "n_blocks")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal `keys` of a partition that is sorted by them, one table each; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is None or first != last
        starts = np.flatnonzero(new)
        last = tuple(c[-1] for c in columns)
        if not len(starts):
            held.append(batch)
            continue
        if starts[0] > 0:
            held.append(batch.slice(0, starts[0]))
        if held:
            yield pa.Table.from_batches(held)
        ends = [*starts[1:], batch.num_rows]
        for a, z in zip(starts[:-1], ends[:-1], strict=True):
            yield pa.Table.from_batches([batch.slice(a, z - a)])
        held = [batch.slice(starts[-1], ends[-1] - starts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each of n nodes' component, for the edges a[i] - b[i]."""
    root = np.arange(n)
    while True:
        lower = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], lower)
        np.minimum.at(root, root[b], lower)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            return root


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): one row (node, component) for each node of an edge, component its least node.

    Alternating large-star and small-star rounds; every round is a grouped minimum, which combines before the shuffle,
    and a join back, which adaptive execution can split when a node has very many neighbours. Lineage is cut in each
    round by checkpoint(). Loops and repeated edges are harmless. Nothing but a row count and a hash reaches the driver.
    """
    now = checkpointed(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join reads two plain sides: then Spark can split the rows of a node with very many neighbours.
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = checkpointed(star.select("e.u", "e.v").where("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def prefix_sums(df: DataFrame, group: str, order: list[Column], value: str, total: int, seed: str) -> DataFrame:
    """Adds `before`: the sum of `value` over the rows of the same `group` that precede in a pseudorandom order.

    The rows of a group are dealt into buckets by the leading part of a hash of `order`; sums run inside a bucket, and
    over the buckets' totals. So a group with a third of all rows is spread over many tasks. `total` is the number of
    rows of df; a group has as many buckets as rows in a bucket at most, the root of it.
    """
    n = max(1, math.ceil(math.sqrt(total)))
    draw = F.xxhash64(F.lit(seed), *order)
    dealt = df.withColumn("draw", draw).withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 20), F.lit(n)))
    inner = Window.partitionBy(group, "bucket").orderBy("draw", *order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    outer = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        dealt.groupBy(group, "bucket").agg(F.sum(value).alias("in_bucket"))
        .withColumn("base", F.coalesce(F.sum("in_bucket").over(outer), F.lit(0)))
        .select(F.col(group).alias("base_group"), F.col("bucket").alias("base_bucket"), "base")
    )
    return (
        own.join(base.hint("merge"), F.col(group).eqNullSafe(F.col("base_group")) & (F.col("bucket") == F.col("base_bucket")))
        .withColumn("before", F.col("base") + F.col("inside"))
        .drop("base", "inside", "bucket", "draw", "base_group", "base_bucket")
    )
