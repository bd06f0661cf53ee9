"""Reconciliation, coverage, skew, checkpoints, rates, percentiles and hash chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_total


def reconcile(expected: DataFrame, actual: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """One row (key, status) for each key of either side: MATCH, MISSING, EXTRA or MISMATCH."""
    left = expected.select(key, F.lit(True).alias("in_expected"), F.struct(*compare).alias("e"))
    right = actual.select(key, F.lit(True).alias("in_actual"), F.struct(*compare).alias("a"))
    status = F.when(F.col("in_actual").isNull(), "MISSING").when(F.col("in_expected").isNull(), "EXTRA").when(F.col("e").eqNullSafe(F.col("a")), "MATCH").otherwise("MISMATCH")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def _comparable(rows: DataFrame) -> DataFrame:
    """rows with maps, which can be neither hashed nor compared, as JSON in the order of their keys."""
    maps = [f.name for f in rows.schema.fields if f.dataType.typeName() == "map"]
    return rows.withColumns({c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) for c in maps})


def table_digests(rows: DataFrame, key: list[str], ranges: int) -> DataFrame:
    """One row (range, n, digest) for each range of key hashes: how many rows it has, and the sum of their hashes.

    The digest doesn't depend on the order of rows, and combines before the shuffle, so two exports of any size are
    compared by `ranges` rows.
    """
    rows = _comparable(rows)
    # A null leaves a hash as it is, so each column is hashed with whether it is null.
    whole = F.xxhash64(*[x for c in sorted(rows.columns) for x in (F.isnull(c), F.col(c))])
    return rows.groupBy(F.pmod(F.xxhash64(*key), F.lit(ranges)).alias("range")).agg(F.count("*").alias("n"), F.sum(whole.cast("decimal(38,0)")).alias("digest"))


def differing(expected: DataFrame, actual: DataFrame, key: list[str], ranges: int = 4096) -> DataFrame:
    """Keys that one of two tables of the same columns has alone, or with other values: (key, status) as reconcile() names it.

    Digests say which ranges of keys differ, and only the rows of these are joined. Keys are unique in each table. If so
    many rows differ that most ranges do, this is a join of the whole tables.
    """
    expected, actual = _comparable(expected), _comparable(actual)
    both = table_digests(expected, key, ranges).join(table_digests(actual, key, ranges).withColumnsRenamed({"n": "m", "digest": "other"}), "range", "full_outer")
    off = both.where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("digest").eqNullSafe(F.col("other")))).select("range")
    some = lambda rows: rows.withColumn("range", F.pmod(F.xxhash64(*key), F.lit(ranges))).join(F.broadcast(off), "range", "left_semi").drop("range")  # noqa: E731 - a row for each range at most
    rest = [c for c in expected.columns if c not in key]
    left, right = some(expected).select(*key, F.struct(*rest).alias("e")), some(actual).select(*key, F.struct(*rest).alias("a"))
    status = F.when(F.col("a").isNull(), "MISSING").when(F.col("e").isNull(), "EXTRA").otherwise("MISMATCH")
    return left.join(right, key, "full_outer").where(~F.col("e").eqNullSafe(F.col("a"))).select(*key, status.alias("status"))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: (key, side), side being left or right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionAll(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of non-negative integers, by Euclid's steps; 92 are enough for any 64-bit integers."""
    start = F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(s["x"] % F.when(s["y"] == 0, F.lit(1).cast("bigint")).otherwise(s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]


def key_skew(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many rows the hottest key has, of how many, and that share as a reduced fraction. No rows fail."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("hottest_count"), F.sum("n").alias("total"))
    total = F.when(F.col("total").isNotNull(), F.col("total")).otherwise(F.raise_error("skew of no keys"))
    divisor = gcd(F.col("hottest_count"), total)
    ratio = F.concat((F.col("hottest_count") / divisor).cast("bigint").cast("string"), F.lit("/"), (total / divisor).cast("bigint").cast("string"))
    # A whole number has no denominator.
    return counts.select("hottest_count", "total", F.when(F.col("hottest_count") == total, "1").otherwise(ratio).alias("hottest_ratio"))


def checkpoint(records: DataFrame, keys: list[str], sequence: str, failed: str) -> DataFrame:
    """For each of keys the greatest sequence below the least failed one: null if the first failed, the last if none did."""
    least = F.min(F.when(F.col(failed), F.col(sequence))).alias("least_failed")
    per = records.groupBy(*keys).agg(least)
    below = records.join(per, keys).where(F.col("least_failed").isNull() | (F.col(sequence) < F.col("least_failed")))
    done = below.groupBy(*keys).agg(F.max(sequence).alias("checkpoint"))
    return per.join(done, keys, "left").select(*keys, "checkpoint")


def replay_keys(generation: str, event_ids: DataFrame, verified: bool) -> DataFrame:
    """Distinct keys generation:event_id; replay needs verified integrity."""
    if not verified:
        raise ValueError("replay needs verified raw objects")
    return event_ids.select(F.concat_ws(":", F.lit(generation), "event_id").alias("replay_key")).distinct()


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of integers, exactly: each value's count, summed along the values of its keys."""
    return nearest_rank_of_counts(rows.groupBy(*keys, value).agg(F.count("*").alias("n")), keys, value, "n", ranks)


def nearest_rank_of_counts(counts: DataFrame, keys: list[str], value: str, n: str, ranks: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles from counts `n` of each value, such as a histogram whose increments add up.

    Counts are summed in ranges of the values, so that very many of one key are not one task's.
    """
    each = counts.groupBy(*keys, value).agg(F.sum(n).alias("n"))
    per = running_total(each, keys, [value], "n", "upto")
    per = per.join(each.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
    return per.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(p)), F.col(value))).alias(r) for r, p in ranks.items()], F.max(value).alias("max"))


def chain_faults(rows: DataFrame, run: list[str], ordinal: str, previous: str, own: str, content: Column) -> DataFrame:
    """Rows of a hash chain that break it: an ordinal out of turn, another predecessor's hash, or a wrong hash of their own."""
    along = Window.partitionBy(*run).orderBy(ordinal)
    expected = F.lag(own, 1, "GENESIS").over(along)
    checked = rows.withColumn("turn_ok", F.col(ordinal) == F.row_number().over(along)).withColumn("previous_ok", F.col(previous) == expected).withColumn("own_ok", F.col(own) == F.sha2(content, 256))
    return checked.where("NOT (turn_ok AND previous_ok AND own_ok)")


def _chaining(run: list[str], content: str, names: list[str]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, ""
        for batch in batches:
            before, after = [], []
            for key, text in zip(zip(*[batch.column(c).to_pylist() for c in run], strict=True), batch.column(content).to_pylist(), strict=True):
                before.append(own if key == last else "GENESIS")
                last, own = key, hashlib.sha256(f"{before[-1]}\n{text}".encode()).hexdigest()
                after.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [*names, "previous_sha256", "entry_sha256"])

    return fold


def chained(entries: DataFrame, run: list[str], ordinal: str, content: str) -> DataFrame:
    """Journal rows of entries (run, ordinal, content): each with the hash of the one before it and its own hash.

    An entry's hash covers its predecessor's, so a run is one chain and its hashes are made one after the other: a task
    goes through its runs in order and keeps one hash, whatever a run's length. The first entry of a run follows GENESIS.
    """
    rows = entries.select(*run, ordinal, content)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*run).sortWithinPartitions(*run, ordinal).mapInArrow(_chaining(run, content, rows.columns), f"{kinds}, previous_sha256 string, entry_sha256 string")


def shared_processes(journal: DataFrame, run: list[str], phase: str, process: str) -> DataFrame:
    """Processes (run, process) that served more than one phase of a run: a restart has to be another process."""
    return journal.groupBy(*run, process).agg(F.count_distinct(phase).alias("phases")).where("phases > 1")


def prefixed(values: DataFrame, column: str, prefix: str) -> DataFrame:
    return values.agg(F.count_if(F.lower(column).startswith(prefix.lower())).alias("n"))


def decision(errors: Column, gaps: Column) -> Column:
    """Any error leaves a decision open; any gap refuses it."""
    return F.when(F.size(errors) > 0, "INDETERMINATE").when(F.size(gaps) > 0, "NO_GO").otherwise("ADMITTED")


def findings(*arrays: Column) -> Column:
    """The distinct findings of several arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*arrays))))
