"""Hash chain and embedded records.

H0 is the hash of the original, H1 of the sanitized bytes, and the record with both
goes into the file; H2 is the hash of what is handed out.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .udf import arrow_udf
from . import containers as K


def record_json(fields: dict[str, Column]) -> Column:
    """JSON of a record with sorted keys and ", " and ": " between; version is a number."""
    def text(c: Column) -> Column:
        escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), escaped, F.lit('"'))

    parts = [F.concat(F.lit(f'"{k}": '), fields[k].cast("string") if k == "version" else text(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def record_fields(h0: Column, h1: Column, stamp: Column, artifact_id: Column, operation: Column, before: Column, after: Column) -> dict[str, Column]:
    return {"version": F.lit(1), "artifact_id": artifact_id, "parent_hash": h0, "artifact_hash": h1, "timestamp": stamp, "operation": operation, "algorithm": F.lit("SHA-256"), "previous_status": before, "current_status": after}


def missing_fields(record: Column) -> Column:
    """Required fields that a JSON record lacks, sorted; null for what is no JSON object."""
    return F.array_sort(F.array_except(F.array(*[F.lit(f) for f in C.PROVENANCE_FIELDS]), F.json_object_keys(record)))


@arrow_udf("binary")
def embed(content: pd.Series, record: pd.Series, jpeg_marker: pd.Series, png_marker: pd.Series) -> pd.Series:
    out = []
    for data, rec, jm, pm in zip(content, record, jpeg_marker, png_marker, strict=True):
        kind = K.sniff(data)
        out.append(K.insert_comment(data, (jm + rec).encode()) if kind == "JPEG" else K.insert_text(data, pm.encode(), rec.encode()) if kind == "PNG" else None)
    return pd.Series(out)


def extract(data: bytes, jpeg_marker: str = C.JPEG_MARKER, png_marker: str = C.PNG_MARKER) -> tuple[dict | None, bytes | None]:
    """The embedded record, if it is a JSON object, and the bytes without it."""
    if K.sniff(data) == "JPEG":
        body = K.extract_comment(data)
        if body is None or not body.startswith(jpeg_marker.encode()):
            return None, None
        body, rest = body[len(jpeg_marker.encode()) :], K.strip_comment(data)
    elif K.sniff(data) == "PNG":
        body = K.extract_text(data, png_marker.encode())
        if body is None:
            return None, None
        rest = K.strip_text(data, png_marker.encode())
    else:
        return None, None
    try:
        found = json.loads(body.decode())
    except ValueError:
        return None, None
    return (found, rest) if isinstance(found, dict) else (None, None)


def verify_bytes(data: bytes, jpeg_marker: str = C.JPEG_MARKER, png_marker: str = C.PNG_MARKER) -> dict:
    out = {"provenance_found": False, "valid": False, "reasons": ["NOT_FOUND"], "container_hash": hashlib.sha256(data).hexdigest(), "artifact_hash": None, "recorded_artifact_hash": None, "recorded_parent_hash": None, "hash_match": None, "drift": []}
    record, rest = extract(data, jpeg_marker, png_marker)
    if record is None:
        return out
    out |= {"provenance_found": True, "reasons": [], "recorded_artifact_hash": record.get("artifact_hash"), "recorded_parent_hash": record.get("parent_hash")}
    missing = sorted(set(C.PROVENANCE_FIELDS) - set(record))
    if missing:
        out["reasons"].append("MISSING:" + ",".join(missing))
        return out
    if record["algorithm"] != "SHA-256":
        out["reasons"].append("ALGORITHM")
    out["artifact_hash"] = hashlib.sha256(rest).hexdigest()
    out["hash_match"] = out["artifact_hash"] == record["artifact_hash"]
    if not out["hash_match"]:
        out["reasons"].append("HASH")
    if not record["parent_hash"]:
        out["reasons"].append("PARENT")
    found = K.scan_metadata(data)
    out["drift"] = [f for f in C.DRIFT_FLAGS if found[f]]
    if out["drift"]:
        out["reasons"].append("DRIFT")
    out["valid"] = not out["reasons"]
    if out["valid"]:
        out["reasons"] = ["INTACT"]
    return out


VERIFY_TYPE = "struct<provenance_found:boolean,valid:boolean,reasons:array<string>,container_hash:string,artifact_hash:string,recorded_artifact_hash:string,recorded_parent_hash:string,hash_match:boolean,drift:array<string>>"


@arrow_udf(VERIFY_TYPE)
def verify(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([verify_bytes(x) for x in content])


def sanitize(files: DataFrame, content: str = "content", caption: str | None = None, stamp: Column | None = None, status: Column | None = None) -> DataFrame:
    """files with H0, the clean file with its record inside, H1, H2, safe name and redacted caption."""
    from .redact import redact_caption, safe_filename

    when = stamp if stamp is not None else F.current_timestamp()
    out = files.withColumn("h0", F.sha2(F.col(content), 256)).withColumn("_clean", K.stripped(F.col(content)))
    out = out.withColumn("h1", F.sha2("_clean", 256))
    fields = record_fields(F.col("h0"), F.col("h1"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.substring("h1", 1, 32), F.lit("sanitized"), status if status is not None else F.lit("unsafe"), F.lit("sanitized"))
    out = out.withColumn("record", record_json(fields))
    out = out.withColumn("sanitized", embed(F.col("_clean"), F.col("record"), F.lit(C.JPEG_MARKER), F.lit(C.PNG_MARKER)))
    ext = F.when(F.substring("_clean", 1, 2) == F.unhex(F.lit("FFD8")), "jpg").otherwise("png")
    out = out.withColumn("h2", F.sha2("sanitized", 256)).withColumn("safe_name", safe_filename(F.col("h1"), when, ext)).drop("_clean")
    return out.withColumn("safe_caption", redact_caption(F.col(caption))) if caption else out


def tamper(data: bytes) -> bytes:
    """A changed copy: bytes after a JPEG, another text chunk in a PNG."""
    if K.sniff(data) == "JPEG":
        return data + b"\x00TAMPERED" * 28
    return K.insert_text(data, b"Tampered", b"yes")
