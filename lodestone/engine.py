"""What a user calls: a corpus with its stored index and graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ranking, security, text
from lodestone.operators import contexts, graph, housekeeping, incremental, writing
from lodestone.operators.search import LIMIT, first_ranks
from lodestone.sources import markdown, tables
from lodestone.sources.shared import exists, few, save


class Engine:
    """docs: a corpus as sources.tables.documents() gives it, or, with sections
    and decisions of its own, sources.markdown.corpus(); supersedes: (newer,
    older), found by equal texts if not given; memory: documents (id, tags) that
    the graph joins by their tags alone, and that are searched too where they
    have a title and a body and ids are text. The index and the graph lie below
    `base`, and are built or brought up to date by refresh(); reads use what is stored."""

    def __init__(self, spark: SparkSession, docs: DataFrame, supersedes: DataFrame | None = None, base: str | None = None, now: str = tables.NOW, stem: bool = True, memory: DataFrame | None = None):
        self.spark, self.docs, self.now, self.memory = spark, docs, now, memory
        self.pairs = tables.supersedes(docs) if supersedes is None else supersedes
        self.index = incremental.Index(spark, f"{base}/index" if base else None, ("title", "tags", "files", "content"), stem)
        self.graph = incremental.Graph(spark, f"{base}/graph" if base else None, "graph")

    @classmethod
    def open(cls, spark: SparkSession, footprints: str, memory: str, base: str | None = None, **options) -> Engine:
        """An engine over two folders of Markdown records; what can't be read is left out (sources.markdown.corpus)."""
        docs, pairs, remembered, _ = markdown.corpus(spark, footprints, memory)
        return cls(spark, docs, pairs, base, memory=remembered, **options)

    def searched(self) -> DataFrame:
        """What the index holds: the documents, then memory documents with what each says."""
        if self.memory is None or not {"title", "body"} <= {*self.memory.columns}:
            return self.docs
        rows = writing.memory_rows(self.memory).join(self.memory.select("id", contexts.memory_statement(F.col("title"), F.col("body")).alias("says"), *([F.col("path")] if "path" in self.memory.columns else [])), "id")
        return self.docs.unionByName(rows, allowMissingColumns=True)

    def refresh(self) -> dict[str, str]:
        """The status of index and graph before, after which both are fresh."""
        return {"index": self.index.ensure(self.searched()), "graph": self.graph.ensure(self.docs, self.pairs, self.memory)}

    def search(self, query: str, limit: int = LIMIT, **filters) -> DataFrame:
        return self.index.search(query, self.now, limit, **filters)

    def search_shown(self, query: str, limit: int = LIMIT, **filters) -> DataFrame:
        """What search() finds, with a snippet of each content."""
        found = save(self.search(query, limit, **filters), "found")
        contents = self.searched().select("id", "content").join(found.select("id"), "id", "left_semi")
        return found.join(self.index.snippets(contents, query), "id").orderBy(F.desc("score"), "id")

    def records(self) -> DataFrame:
        """(id, title, path, files, sections) of what is searched."""
        return records_of(self.index.read("shown"))

    def _nodes(self, hits: DataFrame) -> DataFrame:
        """hits (id, ...) with the nodes of their documents for ids."""
        refs = self.graph.read("docs").select(F.col("ref").alias("id"), F.col("id").alias("node"))
        named = hits.withColumn("id", F.col("id").cast("string")).join(refs, "id", "left")
        return named.withColumn("id", F.coalesce("node", graph.node("footprint", F.col("id")))).drop("node")

    def related_to_file(self, path: str, limit: int = LIMIT) -> DataFrame:
        found = graph.rank(graph.related_to_file(self.graph.read("edges"), path), self.index.read("shown"), self.now)
        return found.orderBy(F.desc("score"), "id").limit(limit)

    def related_by_text(self, path: str, limit: int = LIMIT, **options) -> DataFrame:
        """(id, pass, score): what touches a file, names it, or touches a file beside it, without the graph."""
        return self.index.related_to_file(path, self.now, limit, **options)

    def explain(self, start: str, end: str, depth: int = 6) -> list[tuple[str, str | None]]:
        """The shortest way between two documents, memory documents or nodes, given by id; empty if there is none."""
        at = self.graph.resolve([start, end])
        return graph.explain(self.graph.read("edges"), at[start], at[end], depth)

    def hybrid(self, query: str, limit: int = LIMIT, least: float = 0.0, fail_open: bool = False, **budget) -> DataFrame:
        """(id, rank, origin, score, via): keyword matches, then what the graph
        relates to them, with the bridges. All matches are expanded; then those
        below `least` go, and what no bridge from one that stays leads to. With
        fail_open an error of the graph leaves the keyword matches."""
        hits = self.search(query, limit, exclude_superseded=True)
        seeds = save(contexts.top_ranks(self._named(hits.select("id", "score"), fail_open), limit), "seeds")
        kept = contexts.over(seeds, least)
        none = F.array().cast("array<struct<kind:string,label:string>>")
        found = kept.select("id", "rank", F.lit("fts").alias("origin"), "score", none.alias("via"))
        try:
            related = save(self._related(seeds, kept, limit, budget), "related")
        except Exception:
            if fail_open:
                return found
            raise
        n = kept.count()
        return found.unionByName(related.select("id", (F.col("rank") + n).alias("rank"), F.lit("graph").alias("origin"), "score", F.coalesce("via", none).alias("via")))

    def _named(self, hits: DataFrame, fail_open: bool) -> DataFrame:
        try:
            return self._nodes(hits)
        except Exception:
            if fail_open:  # without a graph all are taken for footprints
                return hits.withColumn("id", graph.node("footprint", F.col("id").cast("string")))
            raise

    def _related(self, seeds: DataFrame, kept: DataFrame, limit: int, budget: dict) -> DataFrame:
        """(id, score, rank, via): the best that all seeds lead to, of which those stay that some kept seed leads to."""
        ids = [r["id"] for r in seeds.orderBy("rank").collect()]  # at most `limit`
        bridges = graph.expand_budgeted(self.graph.read("edges"), ids, **budget)
        weights = F.create_map(*[x for k, w in ranking.BRIDGE.items() for x in (F.lit(k), F.lit(w))])
        points = bridges.groupBy("id").agg(F.sum(weights[F.col("kind")] * F.col("weight")).alias("points"), F.count("*").alias("bridges"), F.min("distance").alias("distance"))
        ranked = contexts.top_ranks(graph.rank(points, self.index.read("shown"), self.now, True).select("id", "score"), limit)
        anchored = contexts.top_ranks(contexts.anchored(ranked, bridges, kept).drop("rank"), limit)
        return contexts.with_bridges(anchored, bridges)

    def context(self, query: str, budget: int = 1600, least: float = 0.0, limit: int = LIMIT, fail_open: bool = False) -> str | None:
        """Keyword and graph results as text within a budget of tokens, None if
        nothing reaches `least`. With fail_open an error of the graph leaves keyword results."""
        found = self.hybrid(query, limit, least, fail_open)
        records = self._named(self.records(), fail_open)
        parts = contexts.graph_sections(found, records, query, budget, limit).orderBy("place").collect()  # five at most
        return "\n\n".join([contexts.GRAPH_HEADER, *(f"{r['section']}:\n{r['lines']}" for r in parts)]) if parts else None

    def keyword_context(self, query: str, budget: int = 1600, least: float = 0.0, limit: int = LIMIT) -> str | None:
        """Keyword results alone as text within a budget of tokens, None if nothing reaches `least`."""
        hits = contexts.over(self.search(query, limit, exclude_superseded=True), least)
        blocks = contexts.fitting(contexts.top_ranks(hits, limit), self.records(), budget)
        row = contexts.rendered(blocks).first()  # one row
        return row["text"] if row["results"] else None

    def hook_context(self, query: str, budget: int = 1600, least: float = 0.0, graph_first: bool = True) -> str | None:
        """What is shown unasked: the graph's context, where that fails or has
        nothing the keywords', else nothing."""
        if not query.strip():
            return None
        if graph_first:
            try:
                if (found := self.context(query, budget, least)) is not None:
                    return found
            except Exception:  # noqa: BLE001  a graph that can't be read never costs the keyword results
                pass
        return self.keyword_context(query, budget, least)

    def add(self, rows: DataFrame, folder: str, allow_secret: bool = False) -> tuple[DataFrame, DataFrame]:
        return writing.write_records(rows, folder, allow_secret)

    # --- lists and upkeep

    def list(self, tag: str | None = None, file: str | None = None, since: str | None = None) -> DataFrame:
        return housekeeping.listed(self.index.read("shown"), tag, file, since).orderBy(F.desc("created_at"), "id")

    def list_recent(self, limit: int = LIMIT, tags: list[str] | None = None) -> DataFrame:
        return housekeeping.recent(self.index.read("shown"), limit, tags)

    def show(self, ident) -> DataFrame:
        """The document of an id, whole."""
        return self.docs.where(F.col("id") == F.lit(ident))

    def digest(self, n: int = 3) -> DataFrame:
        return housekeeping.digest(self.index.read("shown"), n)

    def supersede(self, pairs: DataFrame) -> DataFrame:
        """The documents after linking (old, new); they are the engine's from
        now on, and the next refresh indexes what changed."""
        links = pairs.select(F.col("new").alias("newer"), F.col("old").alias("older"))
        self.docs = save(housekeeping.link_supersede(self.docs, pairs), "superseded")
        self.pairs = save(self.pairs.unionByName(links).distinct(), "pairs")
        return self.docs

    def gc(self, cutoff: str, auto_supersede: bool = False) -> dict[str, DataFrame]:
        """clusters of active records with one title, the pairs (old, new) that
        would resolve them, and records without a change since the cutoff.
        With auto_supersede the pairs are linked."""
        shown, key = self.index.read("shown"), text.slug(F.col("title"))
        pairs = housekeeping.supersede_pairs(shown, key)
        found = {"clusters": housekeeping.duplicate_clusters(shown, key), "pairs": pairs, "stale": housekeeping.stale(shown, cutoff)}
        if auto_supersede:
            found["pairs"] = save(pairs, "pairs")
            self.supersede(found["pairs"])
        return found

    def memory_update(self, records: DataFrame, memory: DataFrame, into: str, since: str | None = None) -> DataFrame:
        """memory (id, body) after what records (id, created_at, learned) have
        learnt since then is appended to the document `into`, an entry for each
        record that isn't there yet."""
        if since:
            records = records.where(F.col("created_at") >= since)
        lines = F.transform("learned", lambda x: F.concat(F.lit("- "), x))
        entries = records.where(F.size("learned") > 0).select(F.lit(into).alias("id"), F.col("id").cast("string").alias("entry"), lines.alias("lines"))
        return writing.append_entries(memory, entries)

    def scan_secrets(self, paths: list[str]) -> DataFrame:
        """(path, line, name) of the secrets in files; those that are gone are left out."""
        there = [p for p in paths if exists(self.spark, p)]
        if not there:
            return self.spark.createDataFrame([], "path string, line int, name string")
        texts = self.spark.read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
        return security.scan(texts, "path", "value")

    def bench(self, queries: DataFrame, budget: int = 1600, limit: int = LIMIT, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, tokens, baseline, reduction) of the rendered context of
        each query (query_id, query) against the whole corpus, and their
        averages in one row; all queries read the postings together. With
        digits, scores are rounded before they are ranked."""
        found = self.index.search_many(queries, self.now, None, exclude_superseded=True)
        if digits is not None:
            found = found.withColumn("score", F.round(F.col("score") * 10.0**digits) / 10.0**digits)
        found = save(first_ranks(found.select("query_id", "id", "score"), limit), "found")
        titles = self.index.read("shown").select("id", "title").join(few(found.select("id").distinct()), "id", "left_semi")
        found = found.join(titles, "id")
        texts = contexts.rendered_many(found, self.records(), budget)
        whole = self.docs.agg(F.ceil((F.sum(text.utf16_length(F.col("content"))) + 2 * (F.count("*") - 1)) / 3.5).alias("baseline")).first()["baseline"] or 0
        empty = contexts.estimate_header(f"{contexts.HEADER}\n\n{contexts.NOTHING}")
        less = lambda tokens: F.when(F.lit(whole) > 0, (F.lit(whole) - tokens) / F.lit(whole) * 100).otherwise(0.0)
        each = queries.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce(text.estimate_tokens(F.col("text")), F.lit(empty)).cast("long").alias("tokens"))
        each = save(each.select("query_id", "tokens", F.lit(whole).cast("long").alias("baseline"), less(F.col("tokens")).alias("reduction")), "bench")
        one = each.agg(F.count("*").alias("queries"), F.floor(F.avg("tokens") + 0.5).alias("tokens")).select("queries", "tokens", F.lit(whole).cast("long").alias("baseline"), less(F.col("tokens")).alias("reduction"))
        return each, one

    def graph_stats(self, n: int = 5) -> dict[str, DataFrame]:
        """Nodes by kind, edges by relation, the documents with most edges, and the latest time in the sources."""
        edges = self.graph.read("edges")
        top = graph.degrees(edges).where(F.col("id").startswith("footprint:") | F.col("id").startswith("memory:")).orderBy(F.desc("degree"), "id").limit(n)
        return {
            "nodes": self.graph.read("nodes").groupBy("kind").agg(F.count("*").alias("n")),
            "edges": edges.groupBy("rel").agg(F.count("*").alias("n")),
            "top": top,
            "built_at": self.spark.createDataFrame([(self.graph.state["built_at"],)], "built_at string"),
        }

    def stats(self, log: DataFrame) -> DataFrame:
        """The records read most, with their titles."""
        return housekeeping.with_titles(housekeeping.hits(log), self.index.read("shown")).orderBy(F.desc("hits"), "returned_id")

    def health(self, log: DataFrame, since: str) -> DataFrame:
        return housekeeping.health(self.index.read("shown"), log, since)


def records_of(docs: DataFrame) -> DataFrame:
    """(id, title, path, files, sections): documents without sections decided
    their title; a memory document guides by what it says."""
    none = F.array().cast("array<string>")
    options = F.array().cast("array<struct<option:string,reason:string>>")
    said = F.when(F.col("title") != "", F.array("title")).otherwise(none)
    of = lambda name, value: value.alias(name)
    sections = F.struct(of("purpose", F.lit("")), of("decisions", said), of("rejected", options), of("guidance", F.lit("")))
    if "sections" in docs.columns:
        own = lambda name, empty: F.coalesce(F.col(f"sections.{name}"), empty)
        sections = F.struct(of("purpose", own("purpose", F.lit(""))), of("decisions", own("decisions", none)), of("rejected", own("rejected", options)), of("guidance", own("guidance", F.lit(""))))
    if "says" in docs.columns:
        plain = F.struct(of("purpose", F.lit("")), of("decisions", none), of("rejected", options), of("guidance", F.col("says")))
        sections = F.when(F.col("says").isNotNull(), plain).otherwise(sections)
    path = F.col("path") if "path" in docs.columns else F.get("files", F.lit(0))
    return docs.select("id", "title", path.alias("path"), "files", sections.alias("sections"))
