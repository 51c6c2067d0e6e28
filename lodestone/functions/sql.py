"""The library's functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestone.functions import ranking, security, text


def _penalties() -> str:
    return "CASE status " + " ".join(f"WHEN '{name}' THEN {x}D" for name, x in ranking.STATUS.items()) + " ELSE 1.0D END"


def _findings(line: str) -> str:
    """An array of names of the secrets in a line."""
    quoted = lambda p: p.replace("\\", "\\\\").replace("'", "\\'")
    each = ", ".join(f"CASE WHEN contains({line}, '{quoted(security.HOLDS[n])}') AND {line} RLIKE '{quoted(security.pattern(n))}' THEN '{n}' END" for n in security.SECRETS)
    return f"array_compact(array({each}))"


def definitions() -> dict[str, str]:
    """The functions by name: their arguments, what they return and how."""
    days = "(unix_micros(CAST(now AS TIMESTAMP)) - unix_micros(try_to_timestamp(stamp))) / 86400000000.0D"
    decay = f"CASE WHEN try_to_timestamp(stamp) IS NULL THEN 0.0D ELSE greatest(0.0D, least(1.0D, 1 - {days} / {ranking.RECENCY_DAYS}D)) END"
    share = f"CASE WHEN work_type = 'architecture_decision' THEN {ranking.RECENCY_WEIGHT / 2}D ELSE {ranking.RECENCY_WEIGHT}D END"
    space = text.SPACE.replace("\\", "\\\\")
    norm = f"regexp_replace(regexp_replace(lower(t), '{space}+', ' '), '^{space}+|{space}+$', '')"
    fold = "aggregate(filter(split(t, ''), c -> c <> ''), 2166136261L, (h, c) -> ((h ^ CAST(ascii(c) AS BIGINT)) * 16777619L) & 4294967295L)"
    units = "length(t) + length(regexp_replace(t, '[^\\\\x{10000}-\\\\x{10FFFF}]', ''))"
    lines = "posexplode(split(t, '\\\\r?\\\\n'))"
    return {
        "status_penalty": f"(status STRING) RETURNS DOUBLE RETURN {_penalties()}",
        "recency_boost": f"(stamp STRING, work_type STRING, now STRING) RETURNS DOUBLE RETURN 1 + ({share}) * ({decay})",
        "doc_score": f"(bm25 DOUBLE, overlaps BOOLEAN, stamp STRING, work_type STRING, status STRING, now STRING) RETURNS DOUBLE RETURN bm25 * CASE WHEN overlaps THEN {ranking.FILE_BOOST}D ELSE 1.0D END * recency_boost(stamp, work_type, now) * status_penalty(status)",
        "est_tokens": f"(t STRING) RETURNS BIGINT RETURN CAST(ceil(({units}) / {text.CHARS_PER_TOKEN}D) AS BIGINT)",
        "norm_text": f"(t STRING) RETURNS STRING RETURN {norm}",
        "fnv1a32": f"(t STRING) RETURNS STRING RETURN lpad(lower(hex({fold})), 8, '0')",
        "secrets_in": f"(line STRING) RETURNS ARRAY<STRING> RETURN {_findings('line')}",
        "scan_secrets": f"(t STRING) RETURNS TABLE(name STRING, line INT) RETURN SELECT f.name, l.pos + 1 FROM (SELECT {lines} AS (pos, value)) AS l, LATERAL (SELECT explode({_findings('l.value')}) AS name) AS f",
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions for the session; returns their names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
