"""Lists, duplicates, stale records, usage and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.search import active


def listed(docs: DataFrame, tag: str | None = None, file: str | None = None, since: str | None = None) -> DataFrame:
    if tag:
        docs = docs.where(F.array_contains("tags", tag))
    if file:
        docs = docs.where(F.array_contains("files", file))
    return docs.where(F.col("created_at") >= since) if since else docs


def duplicate_clusters(docs: DataFrame, key: Column) -> DataFrame:
    """(slug, n, newest, oldest) of active records that share a slug."""
    rows = docs.where(active(F.col("status"))).select(key.alias("slug"), F.struct("created_at", "id").alias("x"))
    return rows.groupBy("slug").agg(F.count("*").alias("n"), F.max("x").alias("new"), F.min("x").alias("old")).where("n > 1").select("slug", "n", F.col("new.id").alias("newest"), F.col("old.id").alias("oldest"))


def supersede_pairs(docs: DataFrame, key: Column) -> DataFrame:
    """(old, new): every older record of a cluster and the newest. The newest
    comes from an aggregate and a join, so a large cluster isn't one task."""
    rows = docs.where(active(F.col("status"))).select(key.alias("slug"), "id", F.struct("created_at", "id").alias("x"))
    newest = rows.groupBy("slug").agg(F.max("x").alias("new"))
    return rows.join(newest, "slug").where("id <> new.id").select(F.col("id").alias("old"), F.col("new.id").alias("new"))


def apply_supersede(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """docs with status, supersedes and superseded_by after linking (old, new)."""
    olds = pairs.select(F.col("old").alias("id"), F.col("new").alias("superseded_by"))
    news = pairs.groupBy(F.col("new").alias("id")).agg(F.count("*").alias("supersedes"))
    out = docs.join(olds, "id", "left").join(news, "id", "left")
    return out.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("supersedes", F.coalesce("supersedes", F.lit(0)))


def link_supersede(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """docs (with array columns supersedes and superseded_by, or without them)
    after linking (old, new): ids are added to the lists once, so doing it again
    changes nothing. A record lists as many ids as it has direct links."""
    listed = lambda key, value: pairs.where(F.col("old") != F.col("new")).groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias(f"more_{value}"))
    out = docs.join(listed("old", "new"), "id", "left").join(listed("new", "old"), "id", "left")
    kind = docs.schema["id"].dataType.simpleString()
    empty = F.array().cast(f"array<{kind}>")
    had = lambda name: F.coalesce(F.col(name), empty) if name in docs.columns else empty
    merged = lambda name, more: F.array_union(had(name), F.coalesce(F.col(more), empty))
    status = F.when(F.col("more_new").isNotNull(), "superseded").otherwise(F.col("status"))
    out = out.withColumn("status", status).withColumn("superseded_by", merged("superseded_by", "more_new")).withColumn("supersedes", merged("supersedes", "more_old"))
    return out.drop("more_new", "more_old")


def with_titles(hits_: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits (returned_id, hits) with titles; "(unknown)" where the record is gone."""
    titles = docs.select(F.col("id").alias("returned_id"), "title")
    return hits_.join(titles, "returned_id", "left").withColumn("title", F.coalesce("title", F.lit("(unknown)")))


def default_queries(docs: DataFrame, n: int = 5) -> DataFrame:
    """The titles of the n newest active records, as queries to measure with."""
    live = docs.where(active(F.col("status")) & (F.col("title") != ""))
    return live.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("id", F.col("title").alias("query"))


def summaries(docs: DataFrame) -> DataFrame:
    """Records as search results without a score; the snippet is the purpose, which is the first line of the content."""
    purpose = F.coalesce(text.first_line(F.col("content")), F.lit(""))
    return docs.select("id", "title", F.lit(0.0).alias("score"), purpose.alias("snippet"), F.coalesce("status", F.lit("completed")).alias("status"), "created_at", F.get("files", F.lit(0)).alias("path"))


def access_rows(entries: DataFrame, store_query: bool = True, most: int = 280) -> DataFrame:
    """Rows for the access log (ts, op, query, result_count, returned_ids,
    source): queries lose secrets and what is over `most` characters, or aren't kept."""
    from lodestone.functions import security

    kept = F.when(F.col("query") != "", F.substring(security.redact(F.col("query")), 1, most)) if store_query else F.lit(None).cast("string")
    return entries.select("ts", "op", kept.alias("query"), "result_count", F.to_json("returned_ids").alias("returned_ids"), "source")


def log_access(entries: DataFrame, path: str, **options) -> bool:
    """Append to the access log; a log that can't be written never fails a read."""
    try:
        access_rows(entries, **options).write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001
        return False


def stale(docs: DataFrame, cutoff: str) -> DataFrame:
    return docs.where((F.col("status") == "completed") & (F.col("created_at") < cutoff))


def usage(log: DataFrame) -> DataFrame:
    """(op, source, reads): by operation, by source and in all, in one pass."""
    return log.groupingSets([[F.col("op")], [F.col("source")], []], "op", "source").agg(F.count("*").alias("reads"))


def hits(log: DataFrame) -> DataFrame:
    return log.where("returned_id is not null").groupBy("returned_id").agg(F.count("*").alias("hits"))


def parsed_log(log: DataFrame) -> DataFrame:
    """A log whose returned_ids are JSON text, with ids, their array, and
    malformed, whether the text is no JSON array. A malformed row has no ids."""
    ids = F.from_json("returned_ids", "array<string>")
    broken = F.col("returned_ids").isNotNull() & (F.try_parse_json("returned_ids").isNull() | ~F.trim("returned_ids").startswith("["))
    return log.withColumn("malformed", F.coalesce(broken, F.lit(False))).withColumn("ids", F.when(~F.col("malformed"), F.coalesce(ids, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


def hits_json(log: DataFrame) -> DataFrame:
    """(returned_id, hits) of a log whose returned_ids are JSON text; malformed rows are skipped."""
    return parsed_log(log).select(F.explode("ids").alias("returned_id")).groupBy("returned_id").agg(F.count("*").alias("hits"))


def never_referenced(docs: DataFrame, log: DataFrame) -> DataFrame:
    return docs.join(log.select(F.col("returned_id").alias("id")), "id", "left_anti")


def ratio(reads: Column, writes: Column) -> Column:
    return F.when((reads == 0) & (writes == 0), "0:0").when(writes == 0, F.concat(reads.cast("string"), F.lit(":0"))).otherwise(F.format_string("%.2f:1", reads / writes))


def recent(docs: DataFrame, n: int, tags: list[str] | None = None) -> DataFrame:
    if tags:
        docs = docs.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return docs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def digest(docs: DataFrame, n: int = 3) -> DataFrame:
    """The n newest active records and how many more there are."""
    live = docs.where(active(F.col("status")))
    top = live.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("id", "created_at")
    more = live.agg(F.greatest(F.lit(0), F.count("*") - n).alias("more"))
    return top.withColumn("k", F.lit(1)).join(more.withColumn("k", F.lit(1)), "k").drop("k")


def health(docs: DataFrame, log: DataFrame, recent_since: str) -> DataFrame:
    """One row: records, active, superseded, stale drafts, writes and reads lately."""
    d = docs.agg(F.count("*").alias("records"), F.sum(active(F.col("status")).cast("int")).alias("active"), F.sum((F.col("status") == "superseded").cast("int")).alias("superseded"), F.sum((F.col("created_at") >= recent_since).cast("int")).alias("recent_writes")).withColumn("k", F.lit(1))
    r = log.agg(F.count("*").alias("reads"), F.countDistinct("returned_id").alias("referenced")).withColumn("k", F.lit(1))
    return d.join(r, "k").drop("k").withColumn("ratio", ratio(F.col("reads"), F.col("recent_writes")))


def learned(records: DataFrame, known: DataFrame) -> DataFrame:
    """New lines that records (id, learned) teach: those whose entry id isn't known (entry)."""
    each = records.select("id", F.posexplode("learned").alias("at", "line")).withColumn("entry", F.concat_ws("#", "id", "at"))
    return each.join(known, "entry", "left_anti").select("id", "entry", "line")

