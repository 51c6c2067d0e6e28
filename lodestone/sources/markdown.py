"""Markdown records with YAML frontmatter: scan, parse, validate, render."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import trim
from lodestone.sources.shared import exists

# Fixed values.
HEADINGS = ("purpose", "decisions", "rejected options", "implementation notes", "commands run", "memory learned", "future agent guidance")
STATUSES = ("draft", "completed", "superseded", "deprecated")
SECTIONS = "purpose string, decisions array<string>, rejected array<struct<option:string,reason:string>>, notes string, commands array<string>, learned array<string>, guidance string"


def scan(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All .md files below a folder: path, modified, size, content hash, raw text; none if it doesn't exist."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, hash string, raw string, doc_type string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return files.select("path", "modificationTime", "length", F.sha1("content").alias("hash"), F.decode("content", "UTF-8").alias("raw"), F.lit(kind).alias("doc_type"))


def sources(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Files of several kinds (kind -> folder) in one table: footprints, then memory, by path."""
    found = None
    for kind, folder in folders.items():
        part = scan(spark, folder, kind)
        found = part if found is None else found.unionByName(part)
    return found.orderBy("doc_type", "path")


def source_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row: files and latest change, none of a folder that doesn't exist; contents are not read."""
    if not exists(spark, folder):
        return spark.createDataFrame([(0, None)], "files long, latest timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return files.select("modificationTime").agg(F.count("*").alias("files"), F.max("modificationTime").alias("latest"))


FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"


def split_front(raw: Column) -> tuple[Column, Column]:
    """Frontmatter text ('' without one) and body."""
    there = raw.rlike(FRONT)
    return F.when(there, F.regexp_extract(raw, FRONT, 1)).otherwise(""), F.when(there, F.regexp_extract(raw, FRONT, 2)).otherwise(raw)


def frontmatter(docs: DataFrame, text: str) -> DataFrame:
    """docs with front, a map of the frontmatter's keys to JSON or plain text,
    and front_error. YAML has no built-in; dates and yes/no stay text."""
    import yaml

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        class Core(yaml.SafeLoader):
            """YAML 1.2 core: only null, true/false, numbers."""

        Core.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
        for frame in frames:
            maps, errors = [], []
            for t in frame[text]:
                try:
                    got = yaml.load(t or "", Core) or {}
                    if not isinstance(got, dict):
                        got = {}
                    maps.append({str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in got.items() if v is not None})
                    errors.append(None)
                except yaml.YAMLError as e:
                    maps.append({})
                    errors.append(str(e)[:200])
            yield frame.assign(front=maps, front_error=errors)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(parse, f"{fields}, front map<string,string>, front_error string")


def validate(front: Column) -> Column:
    """What is wrong with a record's frontmatter, as texts; none if it is valid."""
    from .tables import WORK_TYPES

    missing = [F.when(front[k].isNull(), F.lit(f"{k} is missing")) for k in ("id", "created_at", "actor", "work_type", "status")]
    checks = [
        F.when(F.coalesce(front["schema_version"], F.lit("")) != "1", F.lit("schema_version must be 1")),
        F.when(front["status"].isNotNull() & ~front["status"].isin(*STATUSES), F.lit("unknown status")),
        F.when(front["work_type"].isNotNull() & ~front["work_type"].isin(*WORK_TYPES), F.lit("unknown work_type")),
    ]
    return F.array_compact(F.array(*missing, *checks))


def bad_path(path: Column) -> Column:
    """Whether a touched file is absolute or climbs out of the project."""
    p = F.translate(path, "\\", "/")
    return p.rlike("^(/|[A-Za-z]:)") | F.array_contains(F.split(p, "/"), "..")


def bad_url(url: Column) -> Column:
    return ~F.lower(url).rlike("^https?://")


def sections(body: Column) -> Column:
    """The seven sections of a body as a struct. Headings inside ``` fences
    don't count, names ignore case, and of a repeated name the last one holds."""
    lines = F.split(body, r"\r?\n")
    start = F.struct(F.lit(False).alias("fence"), F.lit("").alias("name"), F.expr("cast(map() as map<string,string>)").alias("found"))

    def step(state: Column, line: Column) -> Column:
        mark = trim(line).startswith("```")
        head = ~mark & ~state["fence"] & line.rlike(r"^##\s+\S")
        name = F.when(head, F.lower(trim(F.regexp_extract(line, r"^##\s+(.+?)\s*$", 1)))).otherwise(state["name"])
        old = F.map_filter(state["found"], lambda k, _: k != name)
        text = F.when(head, F.lit("")).otherwise(F.concat(F.coalesce(F.try_element_at(state["found"], name), F.lit("")), line, F.lit("\n")))
        found = F.when(name == "", state["found"]).otherwise(F.map_concat(old, F.create_map(name, text)))
        return F.struct((state["fence"] != mark).alias("fence"), name.alias("name"), found.alias("found"))

    found = F.aggregate(lines, start, step, lambda s: s["found"])
    prose = lambda k: trim(F.try_element_at(found, F.lit(k)))
    cut = lambda t: F.filter(F.transform(F.split(t, r"\r?\n"), trim), lambda x: x != "")
    items = lambda k: F.filter(F.transform(F.filter(cut(F.try_element_at(found, F.lit(k))), lambda x: x.startswith("- ")), lambda x: trim(F.substring(x, F.lit(3), F.length(x)))), lambda x: x != "")
    options = F.filter(F.transform(F.split(F.try_element_at(found, F.lit("rejected options")), r"(?m)^###\s+"), trim), lambda x: x != "")
    rejected = F.transform(options, lambda x: F.struct(trim(F.split_part(x, F.lit("\n"), F.lit(1))).alias("option"), trim(F.when(F.instr(x, "\n") > 0, F.substring(x, F.instr(x, "\n") + 1, F.length(x))).otherwise("")).alias("reason")))
    commands = F.try_element_at(found, F.lit("commands run"))
    fence = r"(?s)```(?:bash|sh)?\r?\n(.*?)```"
    commands = cut(F.when(commands.rlike(fence), F.regexp_extract(commands, fence, 1)).otherwise(commands))
    return F.struct(prose("purpose").alias("purpose"), items("decisions").alias("decisions"), rejected.alias("rejected"), prose("implementation notes").alias("notes"), commands.alias("commands"), items("memory learned").alias("learned"), prose("future agent guidance").alias("guidance"))


def render(title: Column, s: Column) -> Column:
    """A body from its sections: those that aren't empty, in their order."""
    prose = lambda head, x: F.when(trim(x) != "", F.concat(F.lit(f"## {head}\n\n"), trim(x)))
    bullets = lambda head, x: F.when(F.size(x) > 0, F.concat(F.lit(f"## {head}\n\n"), F.array_join(F.transform(x, lambda i: F.concat(F.lit("- "), i)), "\n")))
    rejected = F.when(F.size(s["rejected"]) > 0, F.concat(F.lit("## Rejected options\n\n"), F.array_join(F.transform(s["rejected"], lambda r: F.concat(F.lit("### "), r["option"], F.lit("\n\n"), trim(r["reason"]))), "\n\n")))
    commands = F.when(F.size(s["commands"]) > 0, F.concat(F.lit("## Commands run\n\n```bash\n"), F.array_join(s["commands"], "\n"), F.lit("\n```")))
    return F.concat(
        F.concat_ws("\n\n", F.concat(F.lit("# "), title), prose("Purpose", s["purpose"]), bullets("Decisions", s["decisions"]), rejected, prose("Implementation notes", s["notes"]), commands, bullets("Memory learned", s["learned"]), prose("Future agent guidance", s["guidance"])),
        F.lit("\n"),
    )


def flatten(title: Column, s: Column, tags: Column, files: Column) -> Column:
    """The searchable text of a record; commands are left out, and title, tags
    and files count again here besides their own columns."""
    rejected = F.array_join(F.transform(s["rejected"], lambda r: F.concat(r["option"], F.lit(": "), r["reason"])), "\n")
    parts = F.array(title, s["purpose"], F.array_join(s["decisions"], "\n"), rejected, s["notes"], F.array_join(s["learned"], "\n"), s["guidance"], F.array_join(tags, " "), F.array_join(files, " "))
    return F.array_join(F.filter(F.transform(parts, trim), lambda x: x.isNotNull() & (x != "")), "\n\n")


def validate_memory(front: Column) -> Column:
    """What is wrong with a memory document's frontmatter: it needs schema version 1 and an id."""
    version = F.when(~front["schema_version"].eqNullSafe(F.lit("1")), F.lit("schema_version must be 1"))
    return F.array_compact(F.array(version, F.when(F.coalesce(front["id"], F.lit("")) == "", F.lit("id is missing"))))


def corpus(spark: SparkSession, footprints: str, memory: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, supersedes, memory, quarantine) of two folders, as the engine
    takes them: documents with their text put together from all sections, the
    sections, decisions and rejected options; (newer, older) as either of the
    two records it; memory documents (id, title, body, tags, path)."""
    good, bad = records(spark, footprints)
    texts, bad_texts = records(spark, memory, "memory")
    front = F.col("front")
    listed = lambda name: F.coalesce(F.from_json(front[name], "array<string>"), F.array().cast("array<string>"))
    chain = lambda name: F.coalesce(F.from_json(F.get_json_object(front["related"], f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
    below = lambda folder: F.regexp_replace("path", f"^.*?\\Q{folder.split('://')[-1].rstrip('/')}\\E/", "")
    docs = good.withColumn("tags", listed("tags")).withColumn("files", listed("files_touched"))
    docs = docs.select(
        "id",
        "title",
        flatten(F.col("title"), F.col("sections"), F.col("tags"), F.col("files")).alias("content"),
        "tags",
        "files",
        *[front[name].alias(name) for name in ("status", "work_type", "created_at", "updated_at", "actor")],
        below(footprints).alias("path"),
        "sections",
        F.coalesce("sections.decisions", F.array().cast("array<string>")).alias("decisions"),
        F.col("sections.rejected").alias("rejected"),
    )
    newer = good.select(F.col("id").alias("newer"), F.explode(chain("supersedes")).alias("older"))
    older = good.select(F.explode(chain("superseded_by")).alias("newer"), F.col("id").alias("older"))
    remembered = texts.select("id", "title", "body", listed("tags").alias("tags"), below(memory).alias("path"))
    return docs, newer.unionByName(older).distinct(), remembered, bad.unionByName(bad_texts)


def records(spark: SparkSession, folder: str, kind: str = "footprint") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): parsed records below a folder, and those that can't
    be read, are invalid or repeat an id (the newest is kept)."""
    from pyspark.sql import Window

    raw = scan(spark, folder, kind)
    front, body = split_front(F.col("raw"))
    parsed = frontmatter(raw.withColumn("front_text", front).withColumn("body", body), "front_text")
    listed = lambda name: F.coalesce(F.from_json(F.col("front")[name], "array<string>"), F.array().cast("array<string>"))
    urls = F.coalesce(F.from_json(F.get_json_object(F.col("front")["related"], "$.urls"), "array<string>"), F.array().cast("array<string>"))
    places = F.array_compact(F.array(F.when(F.exists(listed("files_touched"), bad_path), F.lit("files_touched must stay in the project")), F.when(F.exists(urls, bad_url), F.lit("related.urls must be http or https"))))
    wrong = F.concat(validate(F.col("front")), places) if kind == "footprint" else validate_memory(F.col("front"))
    parsed = parsed.withColumn("errors", F.concat(wrong, F.array_compact(F.array("front_error")))).withColumn("id", F.col("front")["id"])
    again = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("modificationTime"), "path")) > 1
    parsed = parsed.withColumn("errors", F.when(F.col("id").isNotNull() & again, F.concat("errors", F.array(F.lit("duplicate id")))).otherwise(F.col("errors")))
    from lodestone.functions.text import title

    good = parsed.where(F.size("errors") == 0).withColumn("title", title(F.col("body")))
    if kind == "footprint":
        good = good.withColumn("sections", sections(F.col("body")))
    return good, parsed.where(F.size("errors") > 0).select("path", "id", "errors")
