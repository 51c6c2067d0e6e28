"""More registered queries: stored indexes and graphs, contexts, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine, records_of
from lodestone.functions import security, text
from lodestone.operators import contexts, graph, housekeeping, incremental, search, writing
from lodestone.plans import queries as q
from lodestone.plans.queries import ACTIVE, CORPUS_SQL, EDGES_ONLY, EDGES_SQL, FULL, LOG_SQL, RANKED, TALKS_SQL, TERMS, WORDS_SQL, bm25_sql, corpus, query, six, talks
from lodestone.sources import tables
from lodestone.sources.shared import save
from lodestone.sources.tables import NOW, table

# --- stored index


@query(f"WITH {bm25_sql(TERMS)} SELECT id, round({FULL}, 6) AS score, coalesce(status, 'completed') AS status FROM matched ORDER BY score DESC, id LIMIT 8")
def search_stored_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = incremental.Index(spark)
    index.ensure(corpus(spark, sf))
    found = index.search(" ".join(TERMS), NOW, limit=None)
    return found.select("id", six("score", "score"), "status").orderBy(F.desc("score"), "id").limit(8)


PHRASE = "(SELECT count(*) FROM (SELECT unnest(range(1, dl)) AS i) WHERE toks[i] = 'of' AND toks[i + 1] = 'the')"


@query(
    f"WITH {WORDS_SQL}, counted AS (SELECT *, {PHRASE} AS tf FROM lens), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum((tf > 0)::INT) AS df FROM counted) "
    "SELECT id, round(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS bm25 FROM counted, stats WHERE tf > 0"
)
def fts_phrase_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase through the postings of a stored index."""
    index = incremental.Index(spark)
    index.build(corpus(spark, sf).where("id >= 0"))
    return search.indexed_bm25(index.read("packed"), index.read("lengths"), search.compile_query("of_the")).select("id", six("bm25", "bm25"))


@query(f"WITH {CORPUS_SQL} SELECT coalesce(max(created_at), '1970-01-01T00:00:00.000Z') AS built_at FROM corpus")
def index_built_at(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.built_at(corpus(spark, sf))


WAS = "SELECT d.doc_id AS id, sha1(CASE WHEN l.quality = 1 THEN d.text ELSE d.text || '#' END) AS hash, length(d.text) + (l.quality = 0)::INT AS size, d.doc_id % 3 AS mtime FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@query(
    f"WITH was AS ({WAS}), now AS (SELECT doc_id AS id, sha1(text) AS hash, length(text) AS size, 0 AS mtime FROM documents) "
    "SELECT coalesce(was.id, now.id) AS id, CASE WHEN was.id IS NULL THEN 'added' WHEN now.id IS NULL THEN 'removed' WHEN was.size = now.size AND was.mtime = now.mtime THEN 'same' WHEN was.hash <> now.hash THEN 'changed' ELSE 'same' END AS change FROM was FULL JOIN now ON was.id = now.id"
)
def manifest_stat_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and times first; contents are hashed only where those differ."""
    docs = corpus(spark, sf).select("id", "content")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    was = docs.join(labels, "id").select("id", F.when(F.col("quality") == 1, F.col("content")).otherwise(F.concat("content", F.lit("#"))).alias("content"))
    old = incremental.manifest(was).withColumn("mtime", (F.col("id") % 3).cast("long"))
    new = docs.select("id", F.length("content").alias("size"), F.lit(0).cast("long").alias("mtime"))
    return incremental.diff_stat(old, new, docs)


# --- graph


def _budget_sql(seeds: str, most_nodes: int = 40, most_edges: int = 80) -> str:
    """CTEs after seeds (pos, id): what is walked within the budgets, in order."""
    rels = "('TOUCHES_FILE', 'HAS_TAG', 'HAS_DECISION', 'MENTIONS')"
    kind = "CASE e.rel WHEN 'TOUCHES_FILE' THEN 'file' WHEN 'HAS_TAG' THEN 'tag' WHEN 'HAS_DECISION' THEN 'decision' ELSE 'concept' END"
    return f"""mine AS (SELECT s.pos, s.id AS seed, e.dst AS bridge, e.rel, {kind} AS kind, e.weight AS w FROM {seeds} s JOIN edges e ON e.src = s.id AND e.rel IN {rels}),
      events AS (SELECT s.pos, 0 AS step, '' AS bridge, e.dst AS id, s.id AS seed, 'supersedes' AS kind, e.weight FROM {seeds} s JOIN edges e ON e.src = s.id AND e.rel = 'SUPERSEDES'
        UNION ALL SELECT s.pos, 0, '', e.src, s.id, 'supersedes', e.weight FROM {seeds} s JOIN edges e ON e.dst = s.id AND e.rel = 'SUPERSEDES'
        UNION ALL SELECT pos, 1, bridge, NULL, seed, kind, w FROM mine
        UNION ALL SELECT m.pos, 1, m.bridge, e.src, m.seed, m.kind, least(m.w, e.weight) FROM mine m JOIN edges e ON e.dst = m.bridge AND e.rel = m.rel WHERE e.src <> m.seed),
      walked AS (SELECT *, row_number() OVER (ORDER BY pos, step, bridge, id NULLS FIRST, kind) AS n FROM events ORDER BY n LIMIT {most_edges}),
      firsts AS (SELECT id, min(pos) AS pos, row_number() OVER (ORDER BY min(n)) AS place FROM walked WHERE id IS NOT NULL GROUP BY id),
      bridges AS (SELECT w.id, w.seed, w.kind, w.bridge, w.weight, 1 AS distance FROM walked w JOIN firsts f ON w.id = f.id AND f.place <= {most_nodes} WHERE w.id NOT IN (SELECT id FROM {seeds})
        AND (SELECT count(*) FROM firsts x WHERE x.pos < w.pos) < {most_nodes})"""


@query(f"WITH {EDGES_SQL}, seeds AS (SELECT * FROM (VALUES (0, 'footprint:5'), (1, 'footprint:11'), (2, 'footprint:7')) t(pos, id)), {_budget_sql('seeds')} SELECT id, seed, kind, bridge, weight::DOUBLE AS weight, distance::INT AS distance FROM bridges")
def graph_expand_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    """What leads from three documents to others, within 40 documents and 80 edges."""
    return graph.expand_budgeted(save(q.edges(spark, sf), "edges"), ["footprint:5", "footprint:11", "footprint:7"])


@query(
    f"WITH {EDGES_SQL}, touch AS (SELECT DISTINCT src AS id FROM edges WHERE rel = 'TOUCHES_FILE' AND dst = 'file:{q.FILE}'), {q._hop_sql('touch', 'h1', 1)}, "
    f"either AS (SELECT id, 1.0::DOUBLE AS points, 1 AS bridges, 0 AS distance FROM touch UNION ALL SELECT id, points, bridges, distance FROM h1 WHERE id NOT IN (SELECT id FROM touch)) {RANKED.format('either')}"
)
def graph_related_to_file(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.related_to_file(save(q.edges(spark, sf), "edges"), q.FILE)
    return graph.rank(found, corpus(spark, sf), NOW).select("id", F.col("distance").cast("int").alias("distance"), "bridges", six("score", "score"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, rel, weight FROM edges")
def graph_incremental_equals_full(spark: SparkSession, sf: str) -> DataFrame:
    """A stored graph of the labelled documents, some with another title, after an update to all of them."""
    docs = corpus(spark, sf)
    was = docs.where("status is not null").withColumn("title", F.when(F.col("status") == "completed", F.col("title")).otherwise(F.lit("another title")))
    stored = incremental.Graph(spark, None, "graph")
    stored.build(was, tables.supersedes(was))
    stored.update(docs, tables.supersedes(docs))
    return stored.read("edges").select("src", "dst", "rel", "weight")


TALK_TAGS_SQL = "talk_tags AS (SELECT DISTINCT 'memory:' || conv_id AS src, 'tag:' || lower(role) AS dst FROM conversations WHERE trim(role) <> '')"
REJECTED_SQL = (
    "refused AS (SELECT doc_id AS id, source AS option FROM documents WHERE doc_id % 5 = 0), "
    "refusals AS (SELECT 'footprint:' || id AS src, 'rejected_option:' || id || '#0' AS dst, 'REJECTED' AS rel, 1.0::DOUBLE AS weight FROM refused)"
)


@query(
    f"WITH {EDGES_SQL}, {TALK_TAGS_SQL}, {REJECTED_SQL} SELECT src, dst, rel, weight FROM edges WHERE rel <> 'MENTIONS' UNION ALL SELECT src, dst, 'HAS_TAG', 1.0::DOUBLE FROM talk_tags UNION ALL SELECT src, dst, rel, weight FROM refusals"
)
def graph_memory_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """A stored graph with memory documents, tagged by the roles in a conversation, and
    with rejected options, here the source; after an update to it. Concepts aside."""
    option = F.struct(F.col("source").alias("option"), F.lit("").alias("reason"))
    refused = table(spark, sf, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.array(option).alias("rejected"))
    docs = corpus(spark, sf).join(refused, "id", "left")
    memory = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_set("role")).alias("tags"))
    stored = incremental.Graph(spark, None, "graph")
    stored.build(docs.where("id % 7 > 0"), tables.supersedes(docs), memory.withColumn("tags", F.slice("tags", 1, 1)))
    stored.update(docs, tables.supersedes(docs), memory)
    return stored.read("edges").where("rel <> 'MENTIONS'").select("src", "dst", "rel", "weight")


@query(f"WITH {EDGES_SQL}, hit AS (SELECT 'footprint:' || id AS id FROM corpus WHERE id % 10 = 0) SELECT DISTINCT src, dst FROM edges WHERE rel = 'SUPERSEDES' AND (src IN (SELECT id FROM hit) OR dst IN (SELECT id FROM hit))")
def graph_supersede_closure(spark: SparkSession, sf: str) -> DataFrame:
    affected = corpus(spark, sf).where("id % 10 = 0").select(graph.node("footprint", F.col("id").cast("string")).alias("id"))
    return graph.superseding(q.edges(spark, sf), affected).select("src", "dst")


@query(f"WITH {CORPUS_SQL} SELECT 'footprint:' || id AS id, 'footprint' AS kind, title AS label, id::VARCHAR AS ref, file AS file_path, status, work_type, created_at, actor FROM corpus")
def graph_document_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.document_nodes(corpus(spark, sf)).select("id", "kind", "label", "ref", *[f"data.{c}" for c in ("file_path", "status", "work_type", "created_at", "actor")])


@query(f"WITH {EDGES_SQL} SELECT src, dst, rel, CASE WHEN rel = 'HAS_TAG' AND split_part(src, ':', 2)::BIGINT % 3 = 0 THEN 2.0 ELSE weight END::DOUBLE AS weight, CASE WHEN rel = 'HAS_TAG' AND split_part(src, ':', 2)::BIGINT % 3 = 0 THEN 'later' ELSE src END AS owner FROM edges")
def graph_edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Tag edges of every third document are written again with another weight and owner."""
    old = q.edges(spark, sf).withColumn("owner", F.col("src"))
    new = old.where((F.col("rel") == "HAS_TAG") & (F.split_part("src", F.lit(":"), F.lit(2)).cast("long") % 3 == 0)).withColumn("weight", F.lit(2.0)).withColumn("owner", F.lit("later"))
    return graph.upsert_edges(old, new)


@query(
    f"WITH {CORPUS_SQL}, old AS (SELECT 'footprint:' || id AS id, 'footprint' AS kind, title AS label FROM corpus UNION SELECT DISTINCT 'tag:' || tag, 'tag', tag FROM corpus) "
    "SELECT id, kind, CASE WHEN kind = 'footprint' THEN 'new ' || label ELSE label END AS label FROM old"
)
def graph_node_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents take the new label, tags keep the first."""
    docs = corpus(spark, sf)
    tags = docs.select(F.explode("tags").alias("label")).distinct().select(graph.node("tag", F.col("label")).alias("id"), F.lit("tag").alias("kind"), "label", F.lit(None).cast("string").alias("ref"))
    old = graph.document_nodes(docs).drop("data").unionByName(tags)
    new = old.withColumn("label", F.concat(F.lit("new "), F.coalesce("label", F.lit(""))))
    return graph.upsert_nodes(old, new).select("id", "kind", "label")


# --- contexts


SECTIONS_SQL = f"""{CORPUS_SQL}, parts AS (SELECT *, CASE WHEN id % 4 = 0 AND title <> '' THEN title END AS decision, id % 4 IN (0, 1) AS rejects, CASE WHEN id % 4 = 2 THEN actor ELSE '' END AS guidance, CASE WHEN id % 4 = 3 THEN tag ELSE '' END AS purpose FROM corpus),
  said AS (SELECT *, coalesce(decision, CASE WHEN rejects THEN 'Avoid ' || actor || ' for ' || title || '.' END, nullif(guidance, ''), title) AS statement,
    CASE WHEN decision IS NOT NULL THEN CASE WHEN rejects THEN actor || ' was rejected — ' || tag END WHEN rejects THEN tag WHEN guidance <> '' THEN NULL ELSE nullif(purpose, '') END AS reason FROM parts)"""


def _records(docs: DataFrame) -> DataFrame:
    """Records whose sections differ by id: decisions, rejected options, guidance or a purpose."""
    k = F.col("id") % 4
    none = F.array().cast("array<string>")
    option = F.struct(F.col("actor").alias("option"), F.col("tags")[0].alias("reason"))
    sections = F.struct(
        F.when(k == 3, F.col("tags")[0]).otherwise("").alias("purpose"),
        F.when((k == 0) & (F.col("title") != ""), F.array("title")).otherwise(none).alias("decisions"),
        F.when(k < 2, F.array(option)).otherwise(F.array().cast("array<struct<option:string,reason:string>>")).alias("rejected"),
        F.when(k == 2, F.col("actor")).otherwise("").alias("guidance"),
    )
    return docs.select("id", "title", F.col("files")[0].alias("path"), "files", sections.alias("sections"))


@query(f"WITH {SECTIONS_SQL} SELECT id, statement, reason, CASE WHEN coalesce(decision, nullif(guidance, ''), nullif(purpose, '')) IS NULL THEN title ELSE title || ': ' || coalesce(decision, nullif(guidance, ''), nullif(purpose, '')) END AS gist FROM said WHERE trim(title, ' ' || chr(9) || chr(13)) = title")
def context_statements(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(corpus(spark, sf)).where(F.regexp_replace("title", r"^[ \t\r]+|[ \t\r]+$", "") == F.col("title"))
    s = F.struct(F.nullif(F.col("sections.purpose"), F.lit("")).alias("purpose"), "sections.decisions", "sections.rejected", F.nullif(F.col("sections.guidance"), F.lit("")).alias("guidance"))
    return rows.select("id", contexts.statement(F.col("title"), s).alias("statement"), contexts.reason(s).alias("reason"), contexts.gist(F.col("title"), s).alias("gist"))


TOP = f"top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round({FULL}, 6) AS score FROM matched ORDER BY score DESC, id LIMIT 8))"


def _top(spark: SparkSession, sf: str, limit: int = 8, **filters) -> DataFrame:
    found = q.indexed(spark, sf).search(" ".join(TERMS), NOW, limit=None, **filters).select("id", "title", six("score", "score"))
    return contexts.top_ranks(found, limit)


BLOCK = "rank || '. ' || statement || coalesce(chr(10) || '   Reason: ' || reason, '') || chr(10) || '   Source: ' || file"


@query(
    f"WITH {bm25_sql(TERMS)}, {SECTIONS_SQL[len(CORPUS_SQL) + 2 :]}, {TOP}, blocks AS (SELECT t.rank, {BLOCK} AS block FROM top t JOIN said s ON s.id = t.id), "
    "spent AS (SELECT *, 6 + 19 + sum(ceil((length(block) + 2) / 3.5)::BIGINT) OVER (ORDER BY rank) AS used FROM blocks), kept AS (SELECT * FROM spent WHERE used <= 1600 OR rank = 1) "
    "SELECT count(*) AS results, 'Relevant context:' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '(Token counts are approximate — estimated, not tokenizer-exact.)' AS text FROM kept"
)
def context_rendered(spark: SparkSession, sf: str) -> DataFrame:
    """The best matches as a context of at most 1600 tokens."""
    return contexts.rendered(contexts.fitting(_top(spark, sf), _records(corpus(spark, sf)), 1600))


@query(
    f"WITH {bm25_sql(TERMS)}, {TOP}, blocks AS (SELECT t.rank, t.id, t.rank || '. ' || trim(left(content, 60), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '   Source: ' || file AS block FROM top t JOIN corpus c ON c.id = t.id), "
    "spent AS (SELECT *, 14 + sum(2 + ceil(length(block) / 3.5)::BIGINT) OVER (ORDER BY rank) AS used FROM blocks) SELECT rank::INT AS rank, id, block FROM spent WHERE used <= 120 OR rank = 1"
)
def context_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets and sources of the best matches in at most 120 tokens."""
    docs = corpus(spark, sf)
    results = docs.select("id", F.left(F.col("content"), F.lit(60)).alias("snippet")).join(F.broadcast(save(_top(spark, sf), "top")), "id")  # eight rows
    trimmed = contexts.fitting(results, _records(docs), 120, blank=2)
    return trimmed.select("rank", "id", "block")


HIT = f"lower(strip_accents(said[i])) IN ({', '.join(repr(t) for t in TERMS)})"
SNIPPET_SQL = rf"""parts AS (SELECT c.id, t.rank, regexp_extract_all(content, '[\p{{L}}\p{{N}}]+') AS said, regexp_split_to_array(content, '[\p{{L}}\p{{N}}]+') AS gaps FROM top t JOIN corpus c ON c.id = t.id),
  places AS (SELECT *, len(said) AS n, unnest(range(1, len(said) + 1)) AS i FROM parts), hits AS (SELECT id, n, i - 1 AS place, lower(strip_accents(said[i])) AS word FROM places WHERE {HIT}),
  begins AS (SELECT id, i - 1 AS place FROM places WHERE i = 1 OR regexp_matches(gaps[i], '[.:][ \t\n\r]+$')),
  asked AS (SELECT id, n, place, place AS hit, 0 AS extra, 0 AS kind FROM hits UNION ALL
    SELECT h.id, n, max(b.place), h.place, CASE max(b.place) WHEN 0 THEN 120 ELSE 100 END, 1 FROM hits h JOIN begins b ON b.id = h.id AND b.place <= h.place WHERE n > 12 GROUP BY h.id, n, h.place HAVING max(b.place) < h.place),
  worth AS (SELECT a.*, max(a.extra) + 999 * count(DISTINCT h.word) + count(*) AS worth, max(h.place) AS last FROM asked a JOIN hits h ON h.id = a.id AND h.place BETWEEN a.place AND a.place + 11 GROUP BY ALL),
  best AS (SELECT id, n, CASE kind WHEN 0 THEN greatest(0, least(place - (11 - last + place) // 2, n - 12)) ELSE place END AS f FROM worth QUALIFY row_number() OVER (PARTITION BY id ORDER BY worth DESC, hit, kind) = 1),
  spelt AS (SELECT id, rank, f, n, gaps, i, CASE WHEN {HIT} THEN '[' || said[i] || ']' ELSE said[i] END || CASE WHEN i < least(f + 12, n) THEN gaps[i + 1] ELSE '' END AS word FROM places JOIN best USING (id, n) WHERE i > f AND i <= f + 12)
  SELECT id, rank::INT AS rank, CASE WHEN f > 0 THEN ' … ' ELSE gaps[1] END || string_agg(word, '' ORDER BY i) || CASE WHEN f + 12 < n THEN ' … ' ELSE gaps[n + 1] END AS snippet FROM spelt GROUP BY id, rank, f, n, gaps"""


@query(f"WITH {bm25_sql(TERMS)}, {TOP}, {SNIPPET_SQL}")
def search_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The best matches with their snippets, hits from the stored postings."""
    found = save(_top(spark, sf), "top")
    contents = corpus(spark, sf).select("id", "content").join(found.select("id"), "id", "left_semi")
    return found.select("id", F.col("rank").cast("int").alias("rank")).join(q.indexed(spark, sf).snippets(contents, " ".join(TERMS)), "id")


@query(f"WITH {bm25_sql(TERMS)}, {TOP} SELECT id, rank::INT AS rank, score FROM top WHERE score >= 5.0")
def hook_min_score(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that are good enough to be shown unasked."""
    return contexts.over(_top(spark, sf), 5.0).select("id", "rank", "score")


@query(
    f"WITH {bm25_sql(TERMS)}, {EDGES_ONLY}, hits AS (SELECT id AS doc, round({FULL}, 6) AS score FROM matched WHERE {ACTIVE} ORDER BY score DESC, doc LIMIT 8), seeds AS (SELECT row_number() OVER (ORDER BY score DESC, 'footprint:' || doc) - 1 AS pos, 'footprint:' || doc AS id, score FROM hits), "
    f"{_budget_sql('seeds')} SELECT DISTINCT id FROM bridges WHERE seed IN (SELECT id FROM seeds WHERE score >= 5.0)"
)
def hook_anchored_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Related documents that a match which is good enough leads to."""
    hits = _top(spark, sf, exclude_superseded=True)
    seeds = save(contexts.top_ranks(hits.select(graph.node("footprint", F.col("id").cast("string")).alias("id"), "score"), 8), "seeds")
    bridges = graph.expand_budgeted(save(q.edges(spark, sf), "edges"), [r["id"] for r in seeds.orderBy("rank").collect()])  # eight seeds
    return contexts.anchored(bridges.select("id").distinct(), bridges, contexts.over(seeds, 5.0))


@query()
def graph_context_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of a context of matches and related documents, from a stored index and graph."""
    engine = Engine(spark, corpus(spark, sf), stem=False)
    engine.refresh()
    found = engine.hybrid(" ".join(TERMS))
    records = records_of(engine.index.read("shown")).withColumn("id", graph.node("footprint", F.col("id").cast("string")))
    return contexts.graph_sections(found, records, " ".join(TERMS), 20_000)


# --- usage, lists, writing


@query(f"WITH {CORPUS_SQL}, {LOG_SQL}, hits AS (SELECT returned_id, count(*) AS hits FROM log WHERE returned_id IS NOT NULL GROUP BY returned_id) SELECT h.returned_id, h.hits, coalesce(c.title, '(unknown)') AS title FROM hits h LEFT JOIN corpus c ON c.id = h.returned_id ORDER BY h.hits DESC, h.returned_id LIMIT 20")
def usage_top_titles(spark: SparkSession, sf: str) -> DataFrame:
    top = housekeeping.hits(tables.events_log(spark, sf)).orderBy(F.desc("hits"), "returned_id").limit(20)
    return housekeeping.with_titles(top, corpus(spark, sf)).select("returned_id", "hits", "title")


@query(f"WITH {CORPUS_SQL} SELECT id, title AS query FROM corpus WHERE {ACTIVE} AND title <> '' ORDER BY created_at DESC, id DESC LIMIT 5")
def bench_default_queries(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.default_queries(corpus(spark, sf))


@query(f"WITH {CORPUS_SQL} SELECT id, title, 0.0::DOUBLE AS score, coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '')[1], '') AS snippet, coalesce(status, 'completed') AS status, created_at, file AS path FROM corpus WHERE tag = 'de'")
def list_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.summaries(housekeeping.listed(corpus(spark, sf), tag="de"))


TALK_ROWS = "SELECT id::VARCHAR AS id, 'Talk ' || id AS title, 'Talk ' || id || chr(10) || chr(10) || coalesce(nullif(notes, '') || chr(10) || chr(10), '') || 'talk' AS content FROM talks"


def _memory(spark: SparkSession, sf: str) -> DataFrame:
    rows = talks(spark, sf).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Talk "), F.col("id").cast("string")).alias("title"), F.col("notes").alias("body"), F.array(F.lit("talk")).alias("tags"))
    return writing.memory_rows(rows)


@query(f"WITH {TALKS_SQL} {TALK_ROWS}")
def memory_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _memory(spark, sf).select("id", "title", "content")


@query(f"WITH {CORPUS_SQL}, {TALKS_SQL} SELECT 'footprint' AS doc_type, id::VARCHAR AS id, title FROM corpus UNION ALL SELECT 'memory', id::VARCHAR, 'Talk ' || id FROM talks")
def all_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Both kinds of documents in one table."""
    docs = corpus(spark, sf).select(F.lit("footprint").alias("doc_type"), F.col("id").cast("string").alias("id"), "title")
    return docs.unionByName(_memory(spark, sf).select(F.lit("memory").alias("doc_type"), "id", "title"))


def _redacted(column: str) -> str:
    for n in security.SECRETS:
        column = f"regexp_replace({column}, '{security.oracle_pattern(n)}', '[REDACTED:{n}]', 'g')"
    return column


@query(f"SELECT page_id::VARCHAR AS ts, CASE WHEN html <> '' THEN left({_redacted('html')}, 280) END AS query, page_id % 5 AS result_count FROM pages")
def access_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages stand for queries: secrets go, then what is over 280 characters."""
    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("ts"), F.lit("search").alias("op"), F.col("html").alias("query"), (F.col("page_id") % 5).alias("result_count"), F.array(F.lit("a")).alias("returned_ids"), F.lit("cli").alias("source"))
    return housekeeping.access_rows(p).select("ts", "query", "result_count")


@query(
    f"WITH {q.PARTS_SQL}, new AS (SELECT *, first_value(id) OVER (PARTITION BY slug ORDER BY created_at DESC, id DESC) AS newest FROM parts), pairs AS (SELECT id AS old, newest AS new FROM new WHERE id <> newest) "
    "SELECT p.id, CASE WHEN o.old IS NOT NULL THEN 'superseded' ELSE 'completed' END AS status, coalesce(o.new::VARCHAR, '') AS superseded_by, coalesce(n.ids, '') AS supersedes FROM parts p LEFT JOIN pairs o ON o.old = p.id "
    "LEFT JOIN (SELECT new, string_agg(old::VARCHAR, ',' ORDER BY old) AS ids FROM pairs GROUP BY new) n ON n.new = p.id"
)
def supersede_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links as lists of ids, made twice to show that the second time changes nothing."""
    docs = q.parts(spark, sf)
    pairs = housekeeping.supersede_pairs(docs, text.slug(F.col("p_name"), ascii_only=True))
    twice = housekeeping.link_supersede(housekeeping.link_supersede(docs, pairs), pairs)
    joined = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)
    return twice.select("id", "status", joined("superseded_by"), joined("supersedes"))


def _to_write(spark: SparkSession, sf: str) -> DataFrame:
    flat = F.transform("decisions", lambda d: F.regexp_replace(d, r"\s+", " "))
    none = F.array().cast("array<string>")
    sections = F.struct(F.lit("").alias("purpose"), flat.alias("decisions"), F.array().cast("array<struct<option:string,reason:string>>").alias("rejected"), F.lit("").alias("notes"), none.alias("commands"), none.alias("learned"), F.lit("").alias("guidance"))
    i = F.col("id").cast("string")
    files = F.when(F.col("id") % 3 == 0, F.array(F.lit("../x.md"))).otherwise(F.array(F.concat(F.lit("talks\\"), i, F.lit(".md"))))
    return talks(spark, sf).select(F.concat(F.lit("Talk "), i).alias("title"), F.lit("2024-02-03T00:00:00.000Z").alias("created_at"), F.lit("talker").alias("actor"), F.lit(None).cast("string").alias("work_type"), F.lit(None).cast("string").alias("status"), F.array(F.lit("talk")).alias("tags"), files.alias("files"), none.alias("urls"), none.alias("supersedes"), sections.alias("sections"), i.alias("suffix"))


BODY_SQL = "'# Talk ' || id || chr(10) || CASE WHEN len(said) > 0 THEN chr(10) || '## Decisions' || chr(10) || chr(10) || array_to_string(list_transform(said, lambda x: '- ' || regexp_replace(x, '\\s+', ' ', 'g')), chr(10)) || chr(10) ELSE '' END"
RAW_SQL = """'---' || chr(10) || 'schema_version: 1' || chr(10) || 'id: fp_20240203_talk_' || id || '_' || id || chr(10) || 'created_at: "2024-02-03T00:00:00.000Z"' || chr(10) || 'actor: "talker"' || chr(10) ||
  'work_type: implementation' || chr(10) || 'status: completed' || chr(10) || 'files_touched: ["talks/' || id || '.md"]' || chr(10) || 'tags: ["talk"]' || chr(10) || '---' || chr(10) || chr(10) || body"""
SECRET_SQL = " OR ".join(f"regexp_matches(body, '{security.oracle_pattern(n)}')" for n in security.SECRETS)


@query(f"WITH {TALKS_SQL}, bodies AS (SELECT id, {BODY_SQL} AS body FROM talks), ok AS (SELECT * FROM bodies WHERE id % 3 <> 0 AND NOT ({SECRET_SQL})) SELECT 'fp_20240203_talk_' || id || '_' || id AS id, '2024/02/2024-02-03_talk-' || id || '_' || id || '.md' AS path, {RAW_SQL} AS raw FROM ok")
def records_written(spark: SparkSession, sf: str) -> DataFrame:
    """Records that are valid and hold no secret, as the files that they become."""
    ready = writing.prepare(_to_write(spark, sf))
    clean, _ = security.gate(ready.where(F.size("errors") == 0), "body")
    return clean.select("id", "path", "raw")


@query(f"WITH {TALKS_SQL}, bodies AS (SELECT id, {BODY_SQL} AS body FROM talks) SELECT 'fp_20240203_talk_' || id || '_' || id AS id, CASE WHEN id % 3 = 0 THEN 'invalid' ELSE 'secret' END AS why FROM bodies WHERE id % 3 = 0 OR ({SECRET_SQL})")
def records_quarantined(spark: SparkSession, sf: str) -> DataFrame:
    ready = writing.prepare(_to_write(spark, sf))
    _, blocked = security.gate(ready.where(F.size("errors") == 0), "body")
    return ready.where(F.size("errors") > 0).select("id", F.lit("invalid").alias("why")).union(blocked.select("id", F.lit("secret")))


A = "'<!-- entry id=a -->' || chr(10) || 'A' || chr(10) || '<!-- /entry -->' || chr(10)"
B = "'<!-- entry id=b -->' || chr(10) || 'B' || chr(10) || quality || chr(10) || '<!-- /entry -->' || chr(10)"


@query(
    f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'head' || chr(10) || '<!-- entries:start -->' || chr(10) || {A} || {B} || '<!-- entries:end -->' || chr(10) || 'tail' ELSE 'head' || chr(10) || chr(10) || '<!-- entries:start -->' || chr(10) || {A} || {B} || '<!-- entries:end -->' || chr(10) END AS body FROM labels"
)
def memory_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two entries for each body; half of the bodies hold the first already. Appended twice, as the second time must change nothing."""
    labels = table(spark, sf, "labels")
    had = "head\n<!-- entries:start -->\n<!-- entry id=a -->\nA\n<!-- /entry -->\n<!-- entries:end -->\ntail"
    memory = labels.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, had).otherwise("head").alias("body"))
    a = labels.select(F.col("doc_id").alias("id"), F.lit("a").alias("entry"), F.array(F.lit("A")).alias("lines"))
    b = labels.select(F.col("doc_id").alias("id"), F.lit("b").alias("entry"), F.array(F.lit("B"), F.col("quality").cast("string")).alias("lines"))
    once = writing.append_entries(memory, a.unionByName(b)).drop("changed")
    return writing.append_entries(once, a.unionByName(b)).select("id", "body")


@query(
    "SELECT p_partkey AS id, regexp_matches(p_name || CASE WHEN p_partkey % 3 = 0 THEN '.md' ELSE '' END, '[/\\\\]|\\.[A-Za-z0-9]+$') AS is_file, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' ,, '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts, "
    "trim(split_part(p_name || ' : ' || p_brand, ':', 1)) AS option, p_brand AS reason FROM part WHERE p_name NOT LIKE '%:%'"
)
def options_parsed(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_name not like '%:%'")
    parsed = text.parse_rejected(F.concat("p_name", F.lit(" : "), "p_brand"))
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ".md").otherwise(""))
    return p.select(F.col("p_partkey").alias("id"), text.looks_like_file(name).alias("is_file"), F.array_join(text.split_csv(F.regexp_replace("p_name", " ", " ,, ")), "|").alias("parts"), parsed["option"].alias("option"), parsed["reason"].alias("reason"))


@query(f"WITH {bm25_sql(TERMS)}, {TOP} SELECT rank::INT AS rank, '{{\"id\":' || id || ',\"rank\":' || rank || '}}' AS json FROM top")
def search_json(spark: SparkSession, sf: str) -> DataFrame:
    """Results as JSON lines."""
    return _top(spark, sf).select("rank", F.to_json(F.struct("id", "rank")).alias("json"))


