"""Operator 4: lines that repeat across documents [DataFrame functions only].

Hashes of the lines' keys are range-partitioned with the documents of a key in descending order, so a hash that a third
of all documents hold spans many tasks. First occurrences stream off each sorted run; their counts meet per hash. What
comes back is not text but one bitmap for each document that loses lines.

Defined results: a null text is one empty line; a row without doc_id is no document and loses nothing; rows that repeat
a doc_id count as one document, and each loses its own lines; an empty table gives an empty table; other columns of the
input are not read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, partitions, staged, whole_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row (doc_id, text_hash, pos, h1, h2) for each line whose key has at least min_chars code points."""
    lines = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    )
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def repeated_keys(keyed: DataFrame, min_docs: int = 5, slices: int = 64) -> DataFrame:
    """One row (h1, h2, n_docs, keeper) for each key of keyed lines in at least min_docs documents; keeper is the largest doc_id.

    A hash is range-partitioned together with one of `slices` slices of its documents, so that the documents of a hot
    hash are split. In each sorted run a document's first line is where its doc_id differs from the line before.
    """
    sliced = keyed.select("doc_id", "pos", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).alias("slice"))
    ranged = sliced.repartitionByRange(partitions(keyed.sparkSession), "h1", "h2", "slice")
    run = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc("doc_id"), "pos")
    first = F.lag("doc_id").over(run).eqNullSafe(F.col("doc_id"))
    occurrences = ranged.withColumn("again", first).where("not again")
    return occurrences.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row (doc_id, text_hash, dropped, n_dropped) for each document that loses lines.

    `dropped` is a sparse bitmap, word -> 64 bits: bit i of word w is set if line 64 w + i goes. A word that is absent
    stands for 64 lines that stay, so a document with few dropped lines has a few words whatever its length.
    """
    # Lines are cut and hashed once; the range sample, the ranges and the join read hashes and not texts.
    keyed = staged(keyed_lines(docs, min_chars), "keyed-lines")
    keys = staged(repeated_keys(keyed, min_docs), "repeated-lines")
    gone = keyed.join(keys, ["h1", "h2"]).where("doc_id < keeper")
    words = gone.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("pos", F.lit(64)).cast("int"))).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"), F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped")
    )


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The array of lines without those that the bitmap drops; all of them where it is null."""
    bit = lambda i: F.call_function("getbit", F.coalesce(F.element_at(dropped, F.expr("int(0)") + F.floor(i / 64).cast("int")), F.lit(0).cast("bigint")), F.pmod(i, F.lit(64)))
    return F.when(dropped.isNull(), lines).otherwise(F.filter(lines, lambda x, i: bit(i) == 0))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with text replaced by the lines that stay, and n_lines and n_dropped beside it."""
    maps = keep_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "map_doc", "text_hash": "map_hash", "n_dropped": "map_n"})
    own = docs.select(whole_row(docs)).withColumn("hash", F.xxhash64("row.text"))
    both = own.join(maps, (F.col("row.doc_id") == F.col("map_doc")) & (F.col("hash") == F.col("map_hash")), "left")
    lines = lines_of(F.col("row.text"))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(kept_lines(lines, F.col("dropped")), "\n"))
    added = {"text": text, "n_lines": F.size(lines).cast("bigint"), "n_dropped": F.coalesce("map_n", F.lit(0)).cast("bigint")}
    return both.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])
