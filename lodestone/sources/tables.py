"""The corpus of memory documents, read from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import few

# Kinds of work.
WORK_TYPES = ("implementation", "implementation_decision", "bug_fix", "refactor", "investigation", "architecture_decision", "test_update", "documentation")
NOW = "2024-07-01T00:00:00.000Z"
#: Labels, three small numbers each, that are sent to the documents; more are joined by a shuffle.
LABELS = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stat(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A hash of the tables' files: paths, sizes and times of change. No column is read."""
    found = None
    for name in names:
        part = table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        found = part if found is None else found.unionByName(part)
    line = F.concat_ws("|", "file_path", "file_size", "file_modification_time")
    row = found.distinct().agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(line)).alias("x"), F.sum(F.xxhash64(line).cast("decimal(38,0)")).alias("s")).first()
    return "|".join(map(str, row))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with title, tags, files, status, work type, ISO text
    created_at, actor and supersedes (the document before with the same text)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("labelled"))
    docs = table(spark, sf_dir, "documents").join(few(labels, LABELS), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 0, "superseded").when(F.col("labelled"), "completed")
    kinds = F.array(*map(F.lit, WORK_TYPES))
    created = F.date_format(F.timestamp_add("HOUR", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("content"),
        F.array("lang").alias("tags"),
        F.array(F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit(".md"))).alias("files"),
        status.alias("status"),
        F.element_at(kinds, (F.pmod("doc_id", F.lit(8)) + 1).cast("int")).alias("work_type"),
        created.alias("created_at"),
        F.col("source").alias("actor"),
    )


#: The same as SQL for the checks.
CORPUS_SQL = """corpus AS (
  SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS content, d.lang AS tag,
    'src/' || d.lang || '/' || d.source || '.md' AS file,
    CASE WHEN l.toxic = 1 THEN 'deprecated' WHEN l.quality = 0 THEN 'superseded' WHEN l.doc_id IS NOT NULL THEN 'completed' END AS status,
    ['implementation','implementation_decision','bug_fix','refactor','investigation','architecture_decision','test_update','documentation'][(d.doc_id % 8)::INT + 1] AS work_type,
    strftime(TIMESTAMP '2024-01-01' + to_hours(d.doc_id::INT), '%Y-%m-%dT%H:%M:%S.000Z') AS created_at,
    d.source AS actor
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def supersedes(docs: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(newer, older): each document and the one before it, by id, with the same
    text. Copies are paired within ranges of `width` ids, so a large group of
    them is many windows; the first of a range takes the last of the range
    before that has copies."""
    from pyspark.sql import Window

    within = Window.partitionBy("digest", "part").orderBy("id")
    rows = docs.select("id", F.sha2("content", 256).alias("digest"), F.floor(F.col("id") / F.lit(width)).alias("part"))
    rows = rows.withColumn("older", F.lag("id").over(within))
    ends = rows.groupBy("digest", "part").agg(F.min("id").alias("newer"), F.max("id").alias("last"))
    ends = ends.withColumn("older", F.lag("last").over(Window.partitionBy("digest").orderBy("part")))
    pairs = rows.select(F.col("id").alias("newer"), "older").union(ends.select("newer", "older"))
    return pairs.where("older is not null")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log: ts (ISO text), op, source, returned id."""
    e = table(spark, sf_dir, "events")
    sources = F.array(F.lit("cli"), F.lit("mcp"), F.lit("hook"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.col("event_type").alias("op"),
        F.element_at(sources, (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("source"),
        F.get_json_object("props", "$.k").cast("long").alias("returned_id"),
    )


LOG_SQL = """log AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type AS op, ['cli','mcp','hook'][(user_id % 3)::INT + 1] AS source,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS returned_id FROM events)"""
