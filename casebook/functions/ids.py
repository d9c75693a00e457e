"""Deterministic ids, canonical JSON and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sha(x: Column, n: int) -> Column:
    return F.substring(F.sha2(x, 256), 1, n)


def article_uid(url: Column) -> Column:
    return _sha(url, 24)


def evidence_uid(incident: Column, uid: Column) -> Column:
    return _sha(F.concat(incident, F.lit("|"), uid), 24)


def incident_id(anchor_uid: Column) -> Column:
    return F.concat(F.lit("INCIDENT_"), F.upper(F.substring(F.sha1(F.concat(F.lit("INCIDENT|"), anchor_uid)), 1, 12)))


def entity_id(kind: Column, name: Column) -> Column:
    return F.substring(F.sha1(F.concat(kind, F.lit("|"), name)), 1, 20)


def record_uid(output_id: Column, output_hash: Column) -> Column:
    return _sha(F.concat_ws("|", F.lit("D4"), output_id, output_hash), 24)


def content_hash(title: Column, summary: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in (title, summary, url)]), 256)


def salted_hash(salt: str, x: Column) -> Column:
    return _sha(F.concat(F.lit(salt), x), 24)


def canonical_json(*names: str) -> Column:
    """JSON of flat columns of strings, integers and booleans: keys sorted, nulls kept, no spaces, other than ASCII escaped in lower-case hex."""
    text = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})
    # \\uXXXX escapes come in upper case: each is cut out and put back in lower case
    parts, escapes = F.split(text, r"\\u[0-9A-F]{4}"), F.regexp_extract_all(text, F.lit(r"(\\u[0-9A-F]{4})"), 1)
    lower = F.array_append(F.transform(escapes, lambda e: F.lower(e)), F.lit(""))
    return F.array_join(F.zip_with(parts, lower, lambda p, e: F.concat(p, e)), "")


def output_hash(*names: str) -> Column:
    return F.sha2(canonical_json(*names), 256)
