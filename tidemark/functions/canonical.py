"""Canonical JSON, digests, stable ids and archive keys as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contract import CONTRACT_VERSION, DEDUPE_HORIZON_MS, INACTIVITY_GAP_MS

#: Control characters whose escape Spark writes with an upper-case digit.
UPPER_ESCAPE = r"[\x0b\x0e\x0f\x1a-\x1f]"


def json_string(text: Column) -> Column:
    """A JSON string literal: raw Unicode, short escapes, lower-case \\u00xx for other control characters.

    Spark's own form has these escapes in upper case, so such characters are cut out and written for themselves. Text
    without anything to escape is only quoted.
    """

    def bare(value: Column) -> Column:
        json = F.to_json(F.struct(value.alias("v")))
        return F.substring(json, F.lit(7), F.length(json) - 8)

    escape = lambda x: F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(x)), 2, "0")))
    parts = F.transform(F.split(text, f"(?={UPPER_ESCAPE})|(?<={UPPER_ESCAPE})"), lambda x: F.when(x.rlike(f"^{UPPER_ESCAPE}"), escape(x)).otherwise(bare(x)))
    inner = F.when(text.rlike(r'^[^"\\\x00-\x1f]*\z'), text).when(text.rlike(UPPER_ESCAPE), F.array_join(parts, "")).otherwise(bare(text))
    return F.when(text.isNotNull(), F.concat(F.lit('"'), inner, F.lit('"')))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _json_part(part: Column | str) -> Column:
    return F.lit('"' + part + '"') if isinstance(part, str) else part


def json_array(*parts: Column | str) -> Column:
    """A JSON array of parts that are JSON already; a plain str is a literal without characters to escape."""
    between = [x for p in parts for x in (F.lit(","), _json_part(p))][1:]
    return F.concat(F.lit("["), *between, F.lit("]"))


def stable_id(*parts: Column | str) -> Column:
    return sha256(json_array(CONTRACT_VERSION, *parts))


def token(*parts: Column | str) -> Column:
    """The first 36 characters of a stable id."""
    return F.substring(stable_id(*parts), 1, 36)


def json_ids(ids: Column) -> Column:
    """An array of ids as canonical JSON, ids in code point order."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ids), json_string), ","), F.lit("]"))


def session_id(generation: Column, user: Column, ids: Column) -> Column:
    return stable_id(json_string(generation), json_string(user), json_ids(ids))


def component_id(generation: Column, user: Column, ids: Column) -> Column:
    return stable_id("component", json_string(generation), json_string(user), json_ids(ids))


def canonical_event(ingest: bool = True, payload_extra: Column | None = None) -> Column:
    """The envelope in canonical JSON from its typed columns; without ingest_time_ms, what the event digest covers."""
    member = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    inner = [member("campaign_id", json_string(F.col("campaign_id"))), payload_extra, member("page_id", json_string(F.col("page_id"))), member("value_cents", F.col("value_cents").cast("string"))]
    payload = F.concat(F.lit("{"), F.concat_ws(",", *[x for x in inner if x is not None]), F.lit("}"))
    fields = {
        "event_id": json_string(F.col("event_id")), "event_time_ms": F.col("event_time_ms").cast("string"), "event_type": json_string(F.col("event_type")),
        "ingest_time_ms": F.col("ingest_time_ms").cast("string") if ingest else None, "partition_key": json_string(F.col("envelope_key")), "payload": payload,
        "schema_version": json_string(F.col("schema_version")), "source": json_string(F.col("source")), "user_id": json_string(F.col("user_id")),
    }
    return F.concat(F.lit("{"), F.concat_ws(",", *[member(k, v) for k, v in fields.items() if v is not None]), F.lit("}"))


def percent_encoded(text: Column) -> Column:
    """Percent encoding that leaves letters, digits, - _ . and ~ as they are."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def valid_raw_key() -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("ingest_time_ms div 86400000").cast("int")).cast("string")
    return F.concat(F.lit(f"raw/schema={CONTRACT_VERSION}/date="), day, F.lit("/event_id="), F.col("event_id"), F.lit("/"), F.col("digest"), F.lit(".json"))


def rejected_raw_key() -> Column:
    return F.concat(
        F.lit("rejected/source="), sha256(F.col("event_source_arn")), F.lit("/shard="), percent_encoded(F.col("shard_id")),
        F.lit("/sequence="), percent_encoded(F.col("sequence_number")), F.lit("/transport="), sha256(F.col("transport_text")), F.lit(".bin"),
    )


def sortable(number: Column) -> Column:
    """A number as twenty digits, which sort as text."""
    return F.lpad(number.cast("string"), 20, "0")


def is_closed(watermark: Column, end: Column) -> Column:
    return watermark > end + INACTIVITY_GAP_MS


def identity_disposition(digest: Column, first_digest: Column, ingest: Column, first_ingest: Column) -> Column:
    """For an event whose identity is known: expiry is judged first."""
    return F.when(ingest - first_ingest > DEDUPE_HORIZON_MS, "EXPIRED_IDENTITY").when(digest == first_digest, "IDENTICAL_DUPLICATE").otherwise("IDENTITY_CONFLICT")


def sequence_order(sequence: Column) -> list[Column]:
    """Sort keys: sequences of ASCII digits by their number, of any length, before others in code point order."""
    digits = sequence.rlike(r"^[0-9]+\z")
    bare = F.regexp_replace(sequence, r"^0+(?=[0-9])", "")
    return [
        F.when(digits, 0).otherwise(1).alias("seq_class"),
        F.when(digits, F.length(bare)).otherwise(0).alias("seq_length"),
        F.when(digits, bare).otherwise(sequence).alias("seq_text"),
    ]
