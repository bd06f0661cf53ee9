"""Batches of stream records, journals, documents and file inventories as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import BATCH
from ..operators.decode import json_errors
from ..operators.ordering import running_total


def _present(column: str, what: str):
    value = F.col(column)
    return F.when(value.isNotNull() & (value != ""), value).otherwise(F.raise_error(f"{what} must be a non-empty string"))


def records_of(batches: DataFrame) -> DataFrame:
    """Transport records of batches (batch_id, Records): one row for each record, its shard from its event id.

    A batch without a list of records, or a record without one of its coordinates, fails the query. The shard is what
    stands before the last colon of the event id.
    """
    listed = F.when(F.col("Records").isNotNull(), F.col("Records")).otherwise(F.raise_error("Records must be a list"))
    rows = batches.select("batch_id", F.posexplode(listed).alias("position", "r"))
    event_id = _present("r.eventID", "eventID")
    data = F.when(F.col("r.kinesis.data").isNotNull(), F.col("r.kinesis.data")).otherwise(F.raise_error("data must be a string"))
    return rows.select(
        "batch_id", F.col("position").cast("bigint").alias("position"), _present("r.eventSourceARN", "eventSourceARN").alias("event_source_arn"),
        F.regexp_replace(event_id, r":[^:]*\z", "").alias("shard_id"), _present("r.kinesis.sequenceNumber", "sequenceNumber").alias("sequence_number"),
        _present("r.kinesis.partitionKey", "partitionKey").alias("partition_key"), data.alias("transport_text"),
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Batch files, one JSON object each; batches are numbered in the order of their paths, which are ranked in ranges."""
    rows = spark.read.schema(BATCH).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_path").alias("file"))
    files = rows.select(F.lit(1).alias("one"), "file").distinct()
    numbered = running_total(files, [], ["file"], "one", "place")
    return rows.join(numbered.select("file", (F.col("place") - 1).cast("bigint").alias("batch_id")), "file").select("batch_id", "Records")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A JSON lines journal."""
    return spark.read.schema("boundary string, detail map<string,string>, ordinal bigint, phase string, previous_sha256 string, process_id bigint, run_id string, entry_sha256 string").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents (path, document VARIANT, error): unreadable ones have no document and say why.

    `error` is INVALID_UTF8, INVALID_JSON (text after the value included) or DUPLICATE_JSON_KEY (at any depth), else null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    checked = files.withColumn("error", F.arrow_udf(json_errors, "string")("content"))
    text = F.when(F.col("error").isNull(), F.decode("content", "utf-8"))
    return checked.select("path", F.try_parse_json(text).alias("document"), "error")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", "^file:/*", "/")
    return files.select(F.replace(base, F.lit(root.rstrip("/") + "/"), F.lit("")).alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
