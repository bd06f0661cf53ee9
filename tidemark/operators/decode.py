"""Transport text to typed columns.

A text that is canonical base64 of exactly the canonical form of an envelope, which is what producers send, is decoded
natively: parsed with the contract's types and written again, it must come out byte for byte. So it is strict base64 and
UTF-8, repeats no key and holds no float. All else is decoded strictly, and told why not, by one Arrow function. It gets
native rows as nulls and gives nulls for them: two plans, one for each kind of row, would parse each text once more for the
filter of either.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_event
from ..functions.contract import DECODED, ENVELOPE, PAYLOAD_KEYS, REQUIRED_KEYS

FIELDS = [x.split() for x in DECODED.split(", ")]
STRINGS = ("schema_version", "event_id", "source", "user_id", "event_type")


class _Repeated(Exception):
    pass


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Repeated
    return out


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def _long(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def decoded(text: str | None) -> dict:
    """One transport text as the fields of DECODED.

    `failure` is CORRUPT_BASE64, INVALID_UTF8, DUPLICATE_JSON_KEY, INVALID_JSON or NON_OBJECT_JSON, or null. A null text
    and one that isn't ASCII are corrupt; JSON nested too deep, or a number too long to read, is invalid. Objects with a
    float, or text that has no UTF-8 form, have `float` set and no canonical form.
    """
    plain = text or ""
    out: dict = {"representation": "decoded"}
    try:
        if text is None:
            raise ValueError("no text")
        out["body"] = raw = base64.b64decode(text, validate=True)
    except ValueError:
        return out | {"failure": "CORRUPT_BASE64", "body": plain.encode("utf-8", "replace"), "representation": "transport_text"}
    seen_float = False

    def parse_float(x: str) -> float:
        nonlocal seen_float
        seen_float = True
        return 0.0

    try:
        value = json.loads(raw.decode("utf-8"), object_pairs_hook=_once, parse_float=parse_float, parse_constant=parse_float)
    except UnicodeDecodeError:
        return out | {"failure": "INVALID_UTF8"}
    except _Repeated:
        return out | {"failure": "DUPLICATE_JSON_KEY"}
    except (ValueError, RecursionError):
        return out | {"failure": "INVALID_JSON"}
    if not isinstance(value, dict):
        return out | {"failure": "NON_OBJECT_JSON"}
    dumped = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    canonical = dumped(value)
    try:
        canonical.encode("utf-8")
    except UnicodeEncodeError:
        seen_float = True
    if seen_float:
        return out | {"float": True}
    payload = value.get("payload")
    inner = payload if isinstance(payload, dict) else {}
    out |= {"float": False, "canonical": canonical, "semantic": dumped({k: v for k, v in value.items() if k != "ingest_time_ms"}), "root_keys": sorted(value)}
    out |= {"payload_keys": sorted(inner) if isinstance(payload, dict) else None} | {k: _text(value.get(k)) for k in STRINGS}
    out |= {"envelope_key": _text(value.get("partition_key")), "event_time_ms": _long(value.get("event_time_ms")), "ingest_time_ms": _long(value.get("ingest_time_ms"))}
    return out | {"campaign_id": _text(inner.get("campaign_id")), "page_id": _text(inner.get("page_id")), "value_cents": _long(inner.get("value_cents"))}


def _column(texts: pa.Array, native: pa.Array) -> pa.Array:
    """The texts that are not native, decoded, at their places among nulls: native rows cost no Python object."""
    rest = pc.indices_nonzero(pc.invert(native))
    rows = [decoded(x) for x in texts.take(rest).to_pylist()]
    place = np.full(len(texts), len(rows))
    place[rest.to_numpy()] = np.arange(len(rows))
    at = pa.array(place, mask=place == len(rows))
    kind = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
    fields = [(n, kind[t]) for n, t in FIELDS]
    return pa.StructArray.from_arrays([pa.array([r.get(n) for r in rows], t).take(at) for n, t in fields], names=[n for n, _ in fields])


def json_errors(contents: pa.Array) -> pa.Array:
    """What is wrong with each document, null for strict JSON that repeats no key."""

    def error(raw: bytes | None) -> str | None:
        try:
            json.loads((raw or b"").decode("utf-8"), object_pairs_hook=_once)
        except UnicodeDecodeError:
            return "INVALID_UTF8"
        except _Repeated:
            return "DUPLICATE_JSON_KEY"
        except (ValueError, RecursionError):
            return "INVALID_JSON"
        return None

    return pa.array([error(x) for x in contents.to_pylist()], pa.string())


#: Base64 in its canonical alphabet and length; what it decodes to is compared again below.
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def _natively(records: DataFrame) -> tuple[DataFrame, list[str]]:
    """records with the columns of the native path, and `native`: whether they hold."""
    own = {n: n for n, _ in FIELDS if n not in ("failure", "body", "representation", "float", "canonical", "semantic", "root_keys", "payload_keys", "envelope_key", *PAYLOAD_KEYS)}
    own |= {"envelope_key": "partition_key"} | {k: f"payload.{k}" for k in PAYLOAD_KEYS}
    plain = F.when(F.col("transport_text").rlike(BASE64), F.try_to_binary("transport_text", F.lit("base64")))
    rows = records.select(F.struct(*records.columns).alias("r"), plain.alias("n_body")).select("r", "n_body", F.try_validate_utf8(F.col("n_body").cast("string")).alias("n_text"))
    rows = rows.withColumn("e", F.from_json("n_text", ENVELOPE)).select("r", "n_body", "n_text", *[F.col(f"e.{v}").alias(k) for k, v in own.items()])
    rows = rows.withColumn("canonical", canonical_event(True))
    again = F.regexp_replace(F.base64("n_body"), "[\\r\\n]", "") == F.col("r.transport_text")
    native = F.coalesce((F.col("canonical") == F.col("n_text")) & again, F.lit(False))
    return rows.withColumn("native", native), list(own)


def decode(records: DataFrame) -> DataFrame:
    """records with the columns of DECODED added."""
    rows, own = _natively(records)
    rows = rows.withColumn("d", F.arrow_udf(_column, DECODED)(F.when(~F.col("native"), F.col("r.transport_text")), "native"))
    keys = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in PAYLOAD_KEYS]))
    native: dict[str, Column] = {c: F.col(c) for c in [*own, "canonical"]}
    native |= {"body": F.col("n_body"), "representation": F.lit("decoded"), "float": F.lit(False), "semantic": canonical_event(False), "root_keys": F.array(*map(F.lit, REQUIRED_KEYS)), "payload_keys": keys}
    out = [F.when(F.col("native"), native[n]).otherwise(F.col(f"d.{n}")).alias(n) if n in native else F.col(f"d.{n}").alias(n) for n, _ in FIELDS]
    return rows.select("r.*", *out)
