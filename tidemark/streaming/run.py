"""Applies a folder of batch files to state tables and prints what they hold: python -m tidemark.streaming.run BATCHES STATE."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import LIVE, STATE
from ..operators import quality
from ..sources.records import read_batches, read_journal, records_of
from ..sources.store import StateTables
from .stream import apply_batch


def run_batches(spark: SparkSession, batches: str, state: str, generation: str = LIVE) -> StateTables:
    """Applies all records of the batch files, in the order of the files, as one batch of the state tables."""
    store = StateTables(spark, state, generation)
    apply_batch(store, records_of(read_batches(spark, batches)))
    return store


def export(store: StateTables, path: str, journal: str | None = None) -> None:
    """Writes every table, the archive, the channel and the failures as JSON lines, one folder each, rows in key order.

    With the path of a journal its rows are exported too, and in `journal_faults` what breaks its chain.
    """
    for name, rows in exported(store, journal).items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def journal_faults(journal: DataFrame) -> DataFrame:
    """(run_id, ordinal, fault): entries out of turn, off the chain or of another hash, and processes that served two phases."""
    content = F.concat("previous_sha256", F.lit("\n"), "boundary")
    broken = quality.chain_faults(journal, ["run_id"], "ordinal", "previous_sha256", "entry_sha256", content).select("run_id", "ordinal", F.lit("chain").alias("fault"))
    shared = quality.shared_processes(journal.where("phase IS NOT NULL"), ["run_id"], "phase", "process_id").select("run_id", F.lit(None).cast("bigint").alias("ordinal"), F.lit("process").alias("fault"))
    return broken.unionAll(shared)


def exported(store: StateTables, journal: str | None = None) -> dict[str, DataFrame]:
    """All of a state, by name, rows in the order of their columns; bodies in base64."""
    tables = store.load() | {"channel": store.published()}
    if journal:
        rows = read_journal(store.spark, journal)
        tables |= {"journal": rows.withColumn("detail", F.to_json("detail")), "journal_faults": journal_faults(rows)}
    tables["archive"] = tables["archive"].withColumn("body", F.base64("body")).withColumn("metadata", F.to_json("metadata"))
    return {n: t.orderBy(*t.columns) for n, t in sorted(tables.items())}


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("batches")
    parser.add_argument("state")
    parser.add_argument("--generation", default=LIVE)
    parser.add_argument("--export")
    args = parser.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = run_batches(spark, args.batches, args.state, args.generation)
    if args.export:
        export(store, args.export)
    print(json.dumps({n: store.table(n).count() for n in STATE if n != "failure_destination"}, sort_keys=True))
    spark.stop()


if __name__ == "__main__":
    main()
