"""Contexts: what is said of each result, why it was chosen, and how much fits a budget.

Records come as (id, title, path, sections), results as (id, rank, ...). A
context holds a handful of results, so its text is put together in one row;
which results those are is decided before, on the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import estimate_tokens, first_line, trim
from lodestone.operators.search import budget_prefix
from lodestone.sources.shared import few, save

# The texts of results, without the product's name.
HEADER, GRAPH_HEADER = "Relevant context:", "Relevant context (graph-aware):"
TOOL_HEADER = "Relevant context (token counts are approximate):"
NOTE = "(Token counts are approximate — estimated, not tokenizer-exact.)"
NOTHING = "No relevant context found."


def estimate_header(text: str) -> int:
    return -(-2 * len(text) // 7)  # ceil(n / 3.5)


#: Tokens of what stands before and after the blocks.
FRAME = estimate_header(f"{HEADER}\n\n") + estimate_header(f"\n\n{NOTE}")
#: The kinds of bridges, the strongest first.
ORDER = ("supersedes", "file", "decision", "concept", "tag")


def statement(title: Column, s: Column) -> Column:
    """What a record says in a line: its first decision, else what to avoid, else its guidance, else its title."""
    option = F.get(s["rejected"], F.lit(0))["option"]
    avoid = F.when(F.size(s["rejected"]) > 0, F.concat(F.lit("Avoid "), option, F.lit(" for "), title, F.lit(".")))
    return F.coalesce(F.get(s["decisions"], F.lit(0)), avoid, first_line(s["guidance"]), title)


def reason(s: Column) -> Column:
    """Why: what was rejected beside a decision, the rejected option's reason, or the purpose of a record that has neither guidance."""
    first = F.get(s["rejected"], F.lit(0))
    beside = F.when(F.size(s["rejected"]) > 0, F.concat(first["option"], F.lit(" was rejected — "), first["reason"]))
    guided = F.coalesce(trim(s["guidance"]), F.lit("")) != ""
    return F.when(F.size(s["decisions"]) > 0, beside).when(F.size(s["rejected"]) > 0, first["reason"]).when(guided, F.lit(None)).otherwise(first_line(s["purpose"]))


def memory_statement(title: Column, body: Column) -> Column:
    """The first bullet of a memory document, else its title."""
    lines = F.transform(F.split(body, r"\r?\n"), trim)
    return F.coalesce(trim(F.substring(F.get(F.filter(lines, lambda x: x.startswith("- ")), F.lit(0)), 3, 1 << 30)), title)


def gist(title: Column, s: Column) -> Column:
    """Title and the first line of what says most."""
    line = first_line(F.coalesce(F.get(s["decisions"], F.lit(0)), s["guidance"], s["purpose"]))
    return F.when(line.isNull(), title).otherwise(F.concat(title, F.lit(": "), line))


def strongest(via: Column) -> Column:
    """Of bridges (kind, label) the one of the strongest kind, the first of equals."""
    kinds = F.array(*map(F.lit, ORDER))
    place = lambda x: F.when(F.array_contains(kinds, x["kind"]), F.array_position(kinds, x["kind"])).otherwise(len(ORDER) + 1)
    ranked = F.transform(via, lambda x, i: F.struct(place(x).alias("place"), i.alias("i"), x.alias("bridge")))
    return F.array_min(F.transform(ranked, lambda x: F.struct(x["place"], x["i"])))["i"]


def why_selected(query: Column, origin: Column, via: Column) -> Column:
    """In words, from where a result came and over which bridge."""
    bridge = F.get(via, strongest(via))
    kind, label = bridge["kind"], bridge["label"]
    shares = lambda what, mark="": F.concat(F.lit(f"shares {what} {mark}"), label, F.lit(f"{mark} with a matched memory"))
    return (
        F.when(origin == "fts", F.concat(F.lit('matched "'), query, F.lit('"')))
        .when(kind == "supersedes", "supersedes / superseded by a matched memory")
        .when(kind == "file", shares("file"))
        .when(kind == "decision", "shares a decision with a matched memory")
        .when(kind == "concept", shares("concept", '"'))
        .when(kind == "tag", shares("tag", '"'))
        .otherwise("graph-related to a matched memory")
    )


def capped(values: Column, most: int) -> Column:
    """The first `most` different values that aren't blank, trimmed, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, trim), lambda x: x.isNotNull() & (x != ""))), 1, most)


def via_reason(via: Column, most: int = 3) -> Column:
    """The kinds of bridges in their order, with at most `most` labels of each,
    as "supersedes link; shared file a, b; shared tag c"."""
    kinds = F.array_distinct(F.transform(via, lambda x: x["kind"]))
    labels = lambda kind: F.slice(F.array_distinct(F.filter(F.transform(F.filter(via, lambda x: x["kind"] == kind), lambda x: x["label"]), lambda x: x != "")), 1, most)
    part = lambda kind: F.when(kind == "supersedes", "supersedes link").otherwise(F.concat_ws(" ", F.lit("shared"), kind, F.nullif(F.array_join(labels(kind), ", "), F.lit(""))))
    return F.array_join(F.transform(kinds, part), "; ")


def over(results: DataFrame, least: float) -> DataFrame:
    """Results of a score of at least `least`."""
    return results.where(F.col("score") >= least)


def anchored(related: DataFrame, bridges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Related documents (id) of which some bridge (id, seed) leads from a seed (id) that is still there."""
    kept = bridges.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi").select("id").distinct()
    return related.join(kept, "id", "left_semi")


def _recorded(results: DataFrame, records: DataFrame) -> DataFrame:
    """results, a handful, with their records; all records are looked through but none of the others moves."""
    results = save(results, "results")
    records = records.join(few(results.select("id").distinct()), "id", "left_semi")
    return results.join(records.select("id", F.col("title").alias("own"), "path", "sections"), "id", "left")


def _block() -> Column:
    """The block of a result joined to its record (rank, id, title, own, path, sections)."""
    said = F.when(F.col("own").isNotNull(), statement(F.col("own"), F.col("sections"))).otherwise(F.coalesce("title", F.col("id").cast("string")))
    why = F.when(F.col("own").isNotNull(), reason(F.col("sections")))
    return F.concat_ws("\n", F.concat(F.col("rank").cast("string"), F.lit(". "), said), F.concat(F.lit("   Reason: "), why), F.concat(F.lit("   Source: "), F.coalesce("path", F.lit(""))))


def fitting(results: DataFrame, records: DataFrame, budget: int, blank: int | None = None) -> DataFrame:
    """(rank, id, block): the first results whose blocks fit the budget. The
    block of a result is its statement, its reason and its source; a result
    without a record shows its title. With `blank`, blocks are a snippet and
    a source, and a blank line between two costs that many tokens."""
    rows = _recorded(results, records)
    if blank is None:
        block = _block()
        cost, header = estimate_tokens(F.concat(F.col("block"), F.lit("\n\n"))), FRAME
    else:
        said = F.when(trim(F.col("snippet")) != "", trim(F.col("snippet"))).otherwise(F.col("title"))
        block = F.concat(F.col("rank").cast("string"), F.lit(". "), said, F.lit("\n   Source: "), F.coalesce("path", F.lit("")))
        cost, header = estimate_tokens(F.col("block")) + blank, estimate_header(TOOL_HEADER)
    return budget_prefix(rows.select("rank", "id", block.alias("block")), cost, budget, header).select("rank", "id", "block", "used")


def rendered(blocks: DataFrame, footer: bool = True) -> DataFrame:
    """One row: the context's text, and how many results it holds."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n")
    whole = F.concat(F.lit(f"{HEADER}\n\n"), body, F.lit(f"\n\n{NOTE}" if footer else ""))
    return blocks.agg(F.count("*").alias("results"), F.when(F.count("*") == 0, F.lit(f"{HEADER}\n\n{NOTHING}")).otherwise(whole).alias("text"))


def rendered_many(results: DataFrame, records: DataFrame, budget: int) -> DataFrame:
    """(query_id, results, text): for each query the context that rendered()
    gives of its results (query_id, rank, id, title)."""
    rows = _recorded(results, records)
    kept = budget_prefix(rows.select("query_id", "rank", _block().alias("block")), estimate_tokens(F.concat(F.col("block"), F.lit("\n\n"))), budget, FRAME, "query_id")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n")  # a handful a query
    return kept.groupBy("query_id").agg(F.count("*").alias("results"), F.concat(F.lit(f"{HEADER}\n\n"), body, F.lit(f"\n\n{NOTE}")).alias("text"))


def graph_sections(ranked: DataFrame, records: DataFrame, query: str, budget: int, limit: int = 8) -> DataFrame:
    """(place, section, lines, used): the sections of a context of keyword and
    graph results (id, rank, origin, via) that fit the budget, in their order;
    the first one always stays. At most `limit` results and a fixed number of
    lines a section take part."""
    top = ranked.where(F.col("rank") <= limit).join(records.select("id", "title", "path", "files", "sections"), "id", "left")
    said = F.coalesce(statement(F.col("title"), F.col("sections")), F.col("id").cast("string"))
    why = why_selected(F.lit(query), F.col("origin"), F.col("via"))
    head = F.concat_ws("\n", F.concat(F.col("rank").cast("string"), F.lit(". "), said), F.concat(F.lit("   Why selected: "), why), F.concat(F.lit("   Source: "), F.col("path")))
    labelled = lambda kind: F.transform(F.filter("via", lambda x: x["kind"] == kind), lambda x: x["label"])
    from_ = F.concat(F.lit(" (from "), F.col("title"), F.lit(")"))
    each = top.select(
        "rank",
        head.alias("head"),
        F.transform(F.col("sections.decisions"), lambda d: F.concat(F.coalesce(first_line(d), d), from_)).alias("decisions"),
        F.transform(F.col("sections.rejected"), lambda r: F.concat(r["option"], F.lit(" — "), r["reason"], from_)).alias("rejected"),
        F.when(F.col("origin") == "graph", labelled("file")).alias("shared"),
        "files",
        F.when(F.col("origin") == "graph", labelled("concept")).alias("concepts"),
    )
    none = F.array().cast("array<string>")
    listed = lambda name: F.flatten(F.transform("all", lambda x: F.coalesce(x[name], none)))
    bullets = lambda values: F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda x: F.concat(F.lit("- "), x)), "\n"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("rank", "head", "decisions", "rejected", "shared", "files", "concepts"))).alias("all"))
    concepts = capped(listed("concepts"), 10)
    parts = [
        ("Relevant Memories", F.array_join(F.transform("all", lambda x: x["head"]), "\n")),
        ("Related Decisions", bullets(capped(listed("decisions"), 6))),
        ("Rejected Alternatives", bullets(capped(listed("rejected"), 6))),
        ("Related Files", bullets(capped(F.concat(listed("shared"), listed("files")), 8))),
        ("Related Concepts", F.when(F.size(concepts) > 0, F.concat(F.lit("- "), F.array_join(concepts, ", ")))),
    ]
    rows = one.where(F.size("all") > 0).select(F.posexplode(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(name).alias("section"), c.alias("lines"))) for name, c in parts]))).alias("at", "x"))
    rows = rows.select((F.col("at") + 1).alias("rank"), "x.*")
    block = F.concat(F.col("section"), F.lit(":\n"), F.col("lines"), F.lit("\n\n"))
    kept = budget_prefix(rows, estimate_tokens(block), budget, estimate_header(GRAPH_HEADER))
    return kept.select(F.col("rank").alias("place"), "section", "lines", "used")


def with_bridges(related: DataFrame, bridges: DataFrame) -> DataFrame:
    """related (id, ...) with via, its bridges (kind, label) in the order of kinds and labels."""
    label = F.regexp_replace("bridge", "^[^:]*:", "")
    via = bridges.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("kind", label.alias("label")))).alias("via"))
    return related.join(via, "id", "left")


def top_ranks(results: DataFrame, limit: int) -> DataFrame:
    """The best results by score, then id, with rank from 1."""
    best = results.orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
