"""Stream records from the table `events`, natively, with the disorder and repetition that a real stream has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_event
from ..functions.contract import CONTRACT_VERSION, REQUIRED_KEYS

ARN = "arn:example:stream/events"
COPY_STEP, BATCH_ROWS = 10_000_000_000, 4096
#: How far a shard's clock is ahead whose clock is wrong.
FAR_MS = 189_000_000_000_000

#: The same records as decoded() gives, in DuckDB SQL.
RECORDS_SQL = f"""
src AS (SELECT event_id AS id, user_id AS uid, event_type, epoch_us(ts) // 1000 AS at_ms, CAST(round(value * 100) AS BIGINT) AS cents, props FROM events),
copies AS (
  SELECT *, 0 AS copy FROM src UNION ALL SELECT *, 1 FROM src WHERE id % 50 = 0
  UNION ALL SELECT *, 2 FROM src WHERE id % 70 = 0 UNION ALL SELECT *, 3 FROM src WHERE id % 90 = 0),
moved AS (SELECT *, copy * {COPY_STEP} + id AS seq, at_ms + CASE WHEN copy = 3 THEN 604800001 ELSE 0 END AS ingest_time_ms FROM copies),
rec AS (
  SELECT seq, seq // {BATCH_ROWS} AS batch_id, 'shard-' || (uid % 4) AS shard_id, CAST(seq AS VARCHAR) AS sequence_number, 'evt-' || id AS event_id, 'u-' || uid AS user_id, event_type,
    ingest_time_ms - CASE WHEN id % 103 = 0 THEN -60001 WHEN id % 107 = 0 THEN 604800001 WHEN id % 13 = 0 THEN 1200000 WHEN id % 29 = 0 THEN 5400000 ELSE 0 END AS event_time_ms,
    ingest_time_ms, 'u-' || uid AS envelope_key, CASE WHEN id % 101 = 0 THEN 'other' ELSE 'u-' || uid END AS partition_key,
    'p-' || (id % 7 + CASE WHEN copy = 2 THEN 1 ELSE 0 END) AS page_id, CASE WHEN event_type = 'purchase' THEN cents END AS value_cents, id % 97 = 0 AS has_email
  FROM moved),
texts AS (
  SELECT *, '"event_id":"' || event_id || '","event_time_ms":' || event_time_ms || ',"event_type":"' || event_type || '",' AS head,
    '"partition_key":"' || envelope_key || '","payload":{{' || CASE WHEN has_email THEN '"email":"x",' ELSE '' END || '"page_id":"' || page_id || '"' || coalesce(',"value_cents":' || value_cents, '')
    || '}},"schema_version":"{CONTRACT_VERSION}","source":"web","user_id":"' || user_id || '"}}' AS tail FROM rec),
canon AS (SELECT *, '{{' || head || '"ingest_time_ms":' || ingest_time_ms || ',' || tail AS canonical, '{{' || head || tail AS semantic, sha256('{ARN}') AS source_hash FROM texts),
adm AS (
  SELECT *, CASE WHEN has_email THEN 'PRIVACY_VIOLATION' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'INVALID_SCHEMA' WHEN partition_key <> envelope_key THEN 'PARTITION_MISMATCH'
    WHEN event_time_ms - ingest_time_ms > 60000 THEN 'FUTURE_CLOCK' WHEN ingest_time_ms - event_time_ms > 604800000 THEN 'TOO_OLD' END AS rejected FROM canon),
dig AS (
  SELECT *, CASE WHEN rejected IS NULL THEN sha256(semantic) ELSE sha256(canonical) END AS digest FROM adm),
keyed AS (
  SELECT *, CASE WHEN rejected IS NULL THEN 'raw/schema=1.0.0/date=' || strftime(make_timestamp(ingest_time_ms * 1000), '%Y-%m-%d') || '/event_id=' || event_id || '/' || digest || '.json'
    ELSE 'rejected/source=' || source_hash || '/shard=' || shard_id || '/sequence=' || sequence_number || '/transport=' || sha256(base64(encode(canonical))) || '.bin' END AS raw_key FROM dig)"""


def decoded(spark: SparkSession, sf_dir: str, far: bool = False) -> DataFrame:
    """The table as decoded records: events of five types in four shards, some late, some rejected, some delivered again.

    Copies come after all originals: identical ones, changed ones, and ones after the dedupe horizon. With `far` some events
    come by a fifth shard whose clock is some thousands of years ahead.
    """
    # A file of one row group is one task's; what follows is cheap to deal and dear to compute.
    src = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = src.select(F.col("event_id").alias("id"), F.col("user_id").alias("uid"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    due = F.array(F.lit(0), *[F.when(F.col("id") % n == 0, F.lit(c)) for c, n in ((1, 50), (2, 70), (3, 90))])
    rows = src.withColumn("copy", F.explode(F.filter(due, lambda x: x.isNotNull()))).withColumn("seq", F.col("copy").cast("bigint") * COPY_STEP + F.col("id"))
    ident = F.col("id")
    lag = F.when(ident % 103 == 0, -60001).when(ident % 107 == 0, 604800001).when(ident % 13 == 0, 1200000).when(ident % 29 == 0, 5400000).otherwise(0)
    away = (ident % 500 == 7) if far else F.lit(False)
    ingest = F.col("at_ms") + F.when(F.col("copy") == 3, 604800001).otherwise(0) + F.when(away, F.lit(FAR_MS)).otherwise(0)
    user = F.concat(F.lit("u-"), F.col("uid").cast("string"))
    rows = rows.select(
        F.expr(f"seq div {BATCH_ROWS}").alias("batch_id"), F.lit(0).cast("bigint").alias("position"), F.lit(ARN).alias("event_source_arn"),
        F.when(away, "shard-far").otherwise(F.concat(F.lit("shard-"), (F.col("uid") % 4).cast("string"))).alias("shard_id"), F.col("seq").cast("string").alias("sequence_number"),
        F.when(ident % 101 == 0, "other").otherwise(user).alias("partition_key"), (ident % 97 == 0).alias("has_email"),
        F.lit(None).cast("string").alias("failure"), F.lit("decoded").alias("representation"), F.lit(False).alias("float"),
        F.lit(CONTRACT_VERSION).alias("schema_version"), F.concat(F.lit("evt-"), ident.cast("string")).alias("event_id"), F.lit("web").alias("source"), user.alias("user_id"),
        "event_type", user.alias("envelope_key"), (ingest - lag).alias("event_time_ms"), ingest.alias("ingest_time_ms"), F.lit(None).cast("string").alias("campaign_id"),
        F.concat(F.lit("p-"), (ident % 7 + F.when(F.col("copy") == 2, 1).otherwise(0)).cast("string")).alias("page_id"),
        F.when(F.col("event_type") == "purchase", F.col("cents")).alias("value_cents"),
    )
    extra = F.when(F.col("has_email"), F.lit('"email":"x"'))
    keys = F.array_compact(F.array(F.when(F.col("has_email"), F.lit("email")), F.lit("page_id"), F.when(F.col("value_cents").isNotNull(), F.lit("value_cents"))))
    rows = rows.withColumn("root_keys", F.array(*map(F.lit, REQUIRED_KEYS))).withColumn("payload_keys", keys)
    rows = rows.withColumn("canonical", canonical_event(True, extra)).withColumn("semantic", canonical_event(False, extra)).drop("has_email")
    return rows.withColumn("body", F.encode("canonical", "utf-8")).withColumn("transport_text", F.regexp_replace(F.base64("body"), "[\\r\\n]", ""))


#: RECORDS_SQL with the shard whose clock is wrong.
FAR_SQL = RECORDS_SQL.replace("ELSE 0 END AS ingest_time_ms", f"ELSE 0 END + CASE WHEN id % 500 = 7 THEN {FAR_MS} ELSE 0 END AS ingest_time_ms", 1).replace("'shard-' || (uid % 4) AS shard_id", "CASE WHEN id % 500 = 7 THEN 'shard-far' ELSE 'shard-' || (uid % 4) END AS shard_id", 1)


def in_increments(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """decoded() with the wrong clock, as three deliveries: shard 0's originals and the first half of the others', the second
    half of the others', and all copies. So shard 0 is idle in the second one, and what is repeated is so over batches."""
    rows, seq = decoded(spark, sf_dir, far=True), F.col("sequence_number").cast("bigint")
    half = rows.agg((F.max(seq % COPY_STEP) / 2).cast("bigint")).first()[0] or 0
    first = (seq <= half) | (F.col("shard_id") == "shard-0")
    return [rows.where((seq < COPY_STEP) & first), rows.where((seq < COPY_STEP) & ~first), rows.where(seq >= COPY_STEP)]


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decoded() with every third event's records twice, under the same batch, shard, sequence and position."""
    rows = decoded(spark, sf_dir)
    again = F.explode(F.sequence(F.lit(0), (F.col("sequence_number").cast("bigint") % COPY_STEP % 3 == 0).cast("int"))).alias("again")
    return rows.select("*", again).drop("again")


def transported(spark: SparkSession, sf_dir: str, one_in: int = 1) -> DataFrame:
    """The table as transport records: what decoded() holds, as texts, of which those with id % 11 from 1 to 8 are broken.

    `spaced` ones are JSON with blanks and keys out of order, which is no fault. Only ids that `one_in` divides are broken:
    with 73 that is one record in a hundred.
    """
    rows = decoded(spark, sf_dir)
    ident = F.col("sequence_number").cast("bigint") % COPY_STEP
    which = F.when(ident % one_in == 0, ident % 11).otherwise(0)
    whole = F.col("canonical")
    rest = F.substring(whole, F.lit(2), F.length(whole))
    texts = {
        3: F.concat(F.lit('{"event_id":"x",'), rest), 4: F.substring(whole, F.lit(1), F.length(whole) - 1), 5: F.concat(whole, F.lit(" x")),
        6: F.concat(F.lit("["), whole, F.lit("]")), 7: F.replace(whole, F.lit('"payload":{'), F.lit('"payload":{"ratio":1.5,')), 8: F.concat(F.lit('{ "schema_version" : "1.0.0", '), F.replace(rest, F.lit(f'"schema_version":"{CONTRACT_VERSION}",'), F.lit(""))),
    }
    text = whole
    for k, v in texts.items():
        text = F.when(which == k, v).otherwise(text)
    body = F.when(which == 2, F.concat(F.encode(whole, "utf-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(text, "utf-8"))
    plain = F.regexp_replace(F.base64(body), "[\\r\\n]", "")
    return rows.select("batch_id", "position", "event_source_arn", "shard_id", "sequence_number", "partition_key", F.when(which == 1, F.concat(F.lit("*"), plain)).otherwise(plain).alias("transport_text"))


#: What transported() gives after decoding and admission, over the records of RECORDS_SQL.
FAULT_SQL = """, f AS (
  SELECT *, seq % 10000000000 % 11 AS k FROM keyed),
b AS (
  SELECT *, CASE k WHEN 1 THEN encode('*' || base64(encode(canonical))) WHEN 2 THEN encode(canonical) || '\\xFF'::BLOB WHEN 3 THEN encode('{"event_id":"x",' || substr(canonical, 2)) WHEN 4 THEN encode(left(canonical, length(canonical) - 1))
    WHEN 5 THEN encode(canonical || ' x') WHEN 6 THEN encode('[' || canonical || ']') WHEN 7 THEN encode(replace(canonical, '"payload":{', '"payload":{"ratio":1.5,'))
    WHEN 8 THEN encode('{ "schema_version" : "1.0.0", ' || replace(substr(canonical, 2), '"schema_version":"1.0.0",', '')) ELSE encode(canonical) END AS body FROM f),
d AS (
  SELECT *, CASE k WHEN 1 THEN 'CORRUPT_BASE64' WHEN 2 THEN 'INVALID_UTF8' WHEN 3 THEN 'DUPLICATE_JSON_KEY' WHEN 4 THEN 'INVALID_JSON' WHEN 5 THEN 'INVALID_JSON' WHEN 6 THEN 'NON_OBJECT_JSON' WHEN 7 THEN 'INVALID_SCHEMA' ELSE rejected END AS why FROM b)
SELECT sequence_number, coalesce(why, 'ADMITTED') AS disposition, CASE WHEN k = 1 THEN 'transport_text' ELSE 'decoded' END AS representation, sha256(body) AS body_sha256,
  CASE WHEN why IS NULL THEN sha256(semantic) ELSE sha256(body) END AS digest FROM d"""

#: The same with one broken record in a hundred.
RARE_FAULT_SQL = FAULT_SQL.replace("seq % 10000000000 % 11 AS k", "CASE WHEN seq % 10000000000 % 73 = 0 THEN seq % 10000000000 % 11 ELSE 0 END AS k", 1)
