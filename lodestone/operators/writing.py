"""Writing records: validated, gated for secrets, rendered and serialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import security, text
from lodestone.sources import markdown

# Markers of an entry in a memory document.
OPEN, CLOSE, START, END = "<!-- entry id={} -->", "<!-- /entry -->", "<!-- entries:start -->", "<!-- entries:end -->"


def front_text(values: dict[str, Column]) -> Column:
    """Frontmatter lines of keys and values in their order; null and empty
    values are left out. Texts are quoted as JSON, which is YAML too."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in values.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"))


def quoted(value: Column) -> Column:
    """A text as JSON; null where it is null or empty."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value != "", F.substring(whole, F.lit(6), F.length(whole) - 6))


def listed(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.to_json(values))


def prepare(rows: DataFrame) -> DataFrame:
    """rows (title, created_at, actor, work_type, status, tags, files, urls,
    supersedes, sections, suffix) with id, path, body, raw and errors."""
    slug = text.slug(F.col("title"))
    ident = text.footprint_id(F.col("created_at"), slug, F.col("suffix"))
    files = F.transform("files", lambda f: F.translate(text.trim(f), "\\", "/"))
    errors = F.array_compact(F.array(F.when(F.exists("files", lambda f: (text.trim(f) == "") | markdown.bad_path(f)), F.lit("files_touched must stay in the project")), F.when(F.exists("urls", markdown.bad_url), F.lit("related.urls must be http or https")), F.when(F.col("actor").isNull(), F.lit("actor is missing"))))
    out = rows.withColumn("id", ident).withColumn("files", files).withColumn("errors", errors).withColumn("body", markdown.render(F.col("title"), F.col("sections")))
    out = out.withColumn("path", F.concat(F.translate(F.substring("created_at", 1, 7), "-", "/"), F.lit("/"), F.substring("created_at", 1, 10), F.lit("_"), slug, F.lit("_"), F.col("suffix"), F.lit(".md")))
    related = F.to_json(F.struct(F.when(F.size("urls") > 0, F.col("urls")).alias("urls"), F.when(F.size("supersedes") > 0, F.array_distinct("supersedes")).alias("supersedes")))
    front = front_text(
        {
            "schema_version": F.lit("1"),
            "id": F.col("id"),
            "created_at": quoted(F.col("created_at")),
            "actor": quoted(F.col("actor")),
            "work_type": F.coalesce("work_type", F.lit("implementation")),
            "status": F.coalesce("status", F.lit("completed")),
            "related": F.when((F.size("urls") > 0) | (F.size("supersedes") > 0), related),
            "files_touched": listed(F.col("files")),
            "tags": listed(F.col("tags")),
        }
    )
    return out.withColumn("raw", F.concat(front, F.lit("\n"), F.col("body")))


def write_records(rows: DataFrame, folder: str, allow_secret: bool = False) -> tuple[DataFrame, DataFrame]:
    """Append the records that are valid and hold no secret in their body to a
    table at `folder`, a part for each month; returns (written, quarantine)."""
    ready = prepare(rows)
    clean, blocked = security.gate(ready.where(F.size("errors") == 0), "body", allow_secret)
    written = clean.select("id", "path", "raw", F.substring("created_at", 1, 7).alias("month"))
    written.repartition("month").write.mode("append").partitionBy("month").parquet(folder)
    wrong = ready.where(F.size("errors") > 0).select("id", "errors")
    return written.drop("month"), wrong.union(blocked.select("id", F.transform("findings", lambda n: F.concat(F.lit("secret: "), n))))


def append_entries(memory: DataFrame, entries: DataFrame) -> DataFrame:
    """memory (id, body) after new entries (id, entry, lines) are put before the
    end marker, or at the end with markers of their own. Entries that the body
    has already are skipped, so doing it again changes nothing; the rest of
    the body stays as it is."""
    known = F.regexp_extract_all("body", F.lit(r"<!-- entry id=(\S+) -->"), F.lit(1))
    had = memory.select("id", F.explode(known).alias("entry"))
    open_ = F.concat(F.lit(OPEN.split("{}")[0]), F.col("entry"), F.lit(OPEN.split("{}")[1]))
    block = F.concat_ws("\n", open_, F.array_join("lines", "\n"), F.lit(CLOSE))
    new = entries.join(had, ["id", "entry"], "left_anti").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", block.alias("block")))), lambda x: x["block"]), "\n").alias("new"))
    at = F.instr("body", END)
    before = F.substring(F.col("body"), F.lit(1), at - 1)
    closed = F.concat(before, F.when(before.endswith("\n"), "").otherwise("\n"), F.col("new"), F.lit("\n"), F.substring(F.col("body"), at, F.length("body")))
    fresh = F.concat(F.col("body"), F.when(F.col("body").endswith("\n"), "").otherwise("\n"), F.lit(f"\n{START}\n"), F.col("new"), F.lit(f"\n{END}\n"))
    body = F.when(F.col("new").isNull(), F.col("body")).when(at > 0, closed).otherwise(fresh)
    return memory.join(new, "id", "left").withColumn("changed", F.col("new").isNotNull()).withColumn("body", body).drop("new")


def memory_rows(memory: DataFrame) -> DataFrame:
    """Memory documents (id, title, body, tags) as documents of the corpus: title,
    body and tags are searched, and there is no status, time or file."""
    content = F.array_join(F.filter(F.array(F.col("title"), F.col("body"), F.array_join("tags", " ")), lambda x: x.isNotNull() & (x != "")), "\n\n")
    none = F.lit(None).cast("string")
    return memory.select("id", "title", content.alias("content"), "tags", F.array().cast("array<string>").alias("files"), none.alias("status"), none.alias("work_type"), none.alias("created_at"))
