"""Registered queries on what keeps up with its sources: edits, the node
store, streams, many queries at once, JSON logs and SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import security, sql
from lodestone.operators import housekeeping, incremental, search
from lodestone.plans.queries import ACTIVE, BOOST, CORPUS_SQL, EDGES_SQL, FNV, NORM, PENALTY, WORDS_SQL, corpus, query, six
from lodestone.sources import tables
from lodestone.sources.tables import NOW, table
from lodestone.streaming import usage as stream

# --- edits


@query("SELECT 'index' AS stored, 'stale: content' AS state, doc_id::VARCHAR AS id FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT 'graph', 'stale: content', doc_id::VARCHAR FROM documents WHERE doc_id % 10 = 3")
def engine_sees_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth document is edited, count and times stay: what the status says, and which documents the new word and the new tag find."""
    docs = corpus(spark, sf)
    engine = Engine(spark, docs, stem=False)
    engine.refresh()
    hit = F.col("id") % 10 == 3
    engine.docs = docs.withColumn("content", F.when(hit, F.concat("content", F.lit(" zebraquagga"))).otherwise(F.col("content"))).withColumn("tags", F.when(hit, F.array_append("tags", F.lit("Edited"))).otherwise(F.col("tags")))
    state = engine.refresh()
    words = engine.search("zebraquagga", None).select(F.lit("index").alias("stored"), F.lit(state["index"]).alias("state"), F.col("id").cast("string").alias("id"))
    tagged = engine.graph.read("edges").where("dst = 'tag:edited'").select(F.lit("graph").alias("stored"), F.lit(state["graph"]).alias("state"), F.regexp_replace("src", "^footprint:", "").alias("id"))
    return words.unionByName(tagged)


@query(f"WITH {WORDS_SQL}, each AS (SELECT id, unnest(toks) AS term FROM words WHERE id % 9 <> 4) SELECT term, count(DISTINCT id) AS df FROM each GROUP BY term")
def index_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies after single documents came, changed and went, without a look at the rest of the corpus."""
    docs = corpus(spark, sf)
    index = incremental.Index(spark)
    index.build(docs.where("id % 9 <> 2").withColumn("content", F.when(F.col("id") % 9 == 1, F.lit("other words")).otherwise(F.col("content"))))
    index.upsert(docs.where("id % 9 in (1, 2)"), docs.where("id % 9 = 4").select("id"))
    return index.read("postings").groupBy("term").agg(F.count_distinct("id").alias("df"))


# --- the node store


def _stored_graph(spark: SparkSession, sf: str) -> incremental.Graph:
    """A graph of the documents with an even id, after an update to all of them."""
    docs = corpus(spark, sf)
    some = docs.where("id % 2 = 0")
    stored = incremental.Graph(spark, None, "graph")
    stored.build(some, tables.supersedes(some))
    stored.update(docs, tables.supersedes(docs))
    return stored


@query(
    f"WITH {CORPUS_SQL}, said AS (SELECT 'decision:' || {FNV.format(NORM.format('title'))} AS id, trim(title, ' ' || chr(9) || chr(13)) AS label, id % 2 AS late, id::VARCHAR AS writer FROM corpus WHERE {NORM.format('title')} <> ''), "
    "tags AS (SELECT DISTINCT 'tag:' || lower(tag) AS id, tag AS label FROM corpus), files AS (SELECT DISTINCT 'file:' || file AS id, file AS label FROM corpus), who AS (SELECT DISTINCT 'actor:' || lower(actor) AS id, actor AS label FROM corpus) "
    "SELECT 'footprint:' || id AS id, 'footprint' AS kind, title AS label, id::VARCHAR AS ref FROM corpus UNION ALL SELECT id, 'decision', arg_min(label, (late, writer)), NULL FROM said GROUP BY id "
    "UNION ALL SELECT id, 'tag', label, label FROM tags UNION ALL SELECT id, 'file', label, label FROM files UNION ALL SELECT id, 'actor', label, label FROM who"
)
def graph_nodes_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The stored nodes, concepts aside: documents' own, and of what they share the first label."""
    return _stored_graph(spark, sf).read("nodes").where("kind <> 'concept'").select("id", "kind", "label", "ref")


@query(f"WITH {EDGES_SQL} SELECT dst AS id, count(*) AS refs FROM edges WHERE rel <> 'SUPERSEDES' GROUP BY dst")
def graph_shared_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many edges lead to each node that documents share, as the updates counted."""
    return _stored_graph(spark, sf)._shared().where("refs > 0").select("id", "refs")


# --- streams

SESSIONS_SQL = (
    "g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"
)


@query(f"WITH {SESSIONS_SQL} SELECT user_id, min(ts) AS start, count(*) AS reads FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR")
def stream_usage_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that a stream over the event files has closed."""
    return stream.closed(spark, sf, "events*.parquet", stream.sessions)[0]


@query(
    "WITH h AS (SELECT ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS returned_id FROM events) SELECT date_trunc('hour', ts) AS start, returned_id, count(*) AS hits FROM h WHERE returned_id IS NOT NULL GROUP BY 1, 2 "
    "HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM h WHERE returned_id IS NOT NULL) - INTERVAL 1 HOUR"
)
def stream_usage_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly hits of each record that a stream over the event files has closed."""
    return stream.closed(spark, sf, "events*.parquet", stream.hits)[0]


# --- many queries at once

ASKED_SQL = f"""{WORDS_SQL}, asked AS (SELECT item_id AS query_id, unnest(list_filter(list_transform(regexp_split_to_array(translate(left(text, 60), '_', ' '), '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: w <> '')) AS term FROM benchmark),
  wanted AS (SELECT query_id, term, count(*) AS times FROM asked GROUP BY ALL), posted AS (SELECT id, unnest(toks) AS term FROM lens), tfs AS (SELECT id, term, count(*) AS tf FROM posted WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM lens),
  found AS (SELECT w.query_id, t.id, sum(w.times * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM wanted w JOIN tfs t USING (term) JOIN dfs USING (term) JOIN lens l ON l.id = t.id, totals GROUP BY w.query_id, t.id),
  scored AS (SELECT f.query_id, c.id, c.title, c.file, round(bm25 * {BOOST} * {PENALTY}, 6) AS score FROM found f JOIN corpus c ON c.id = f.id WHERE {ACTIVE}),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 8)"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.translate(F.left("text", F.lit(60)), "_", " ").alias("query"))


@query(f"WITH {ASKED_SQL} SELECT query_id, rank::INT AS rank, id, score FROM best")
def search_many_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best matches of every item of `benchmark`; the postings are read once for all of them."""
    index = incremental.Index(spark)
    index.ensure(corpus(spark, sf))
    found = search.many_bm25(index.read("packed"), index.read("lengths"), search.asked_words(_asked(spark, sf)), (index.state["count"], index.state["words"]))
    ranked = search.ranked_many(found.join(index.read("shown"), "id"), NOW, None, exclude_superseded=True).withColumn("score", six("score", "score"))
    return search.first_ranks(ranked, 8).select("query_id", "rank", "id", "score")


TOKENS_SQL = "ceil(({0}) / 3.5)::BIGINT"
BENCH_SQL = f"""{ASKED_SQL}, blocks AS (SELECT query_id, rank, rank || '. ' || title || chr(10) || '   Source: ' || file AS block FROM best),
  spent AS (SELECT *, 6 + 19 + sum({TOKENS_SQL.format("length(block) + 2")}) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM blocks), kept AS (SELECT * FROM spent WHERE used <= 400 OR rank = 1),
  texts AS (SELECT query_id, {TOKENS_SQL.format("19 + sum(length(block)) + 2 * (count(*) - 1) + 66")} AS tokens FROM kept GROUP BY query_id),
  whole AS (SELECT {TOKENS_SQL.format("sum(length(content)) + 2 * (count(*) - 1)")} AS baseline FROM corpus),
  each AS (SELECT item_id AS query_id, coalesce(tokens, {-(-2 * 45 // 7)}) AS tokens, baseline, (baseline - coalesce(tokens, {-(-2 * 45 // 7)})) / baseline::DOUBLE * 100 AS reduction FROM benchmark b LEFT JOIN texts t ON t.query_id = b.item_id, whole)"""


@query(f"WITH {BENCH_SQL}, one AS (SELECT count(*) AS queries, floor(avg(tokens) + 0.5)::BIGINT AS tokens, any_value(baseline) AS baseline FROM each) SELECT queries, tokens, baseline::BIGINT AS baseline, round((baseline - tokens) / baseline::DOUBLE * 100, 6) AS reduction FROM one")
def bench_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of rendered contexts against the whole corpus, on average over every item of `benchmark`."""
    engine = Engine(spark, corpus(spark, sf), stem=False)
    engine.index.columns = ("content",)
    engine.index.ensure(engine.docs)
    return engine.bench(_asked(spark, sf), budget=400, digits=6)[1].select("queries", F.col("tokens").cast("long").alias("tokens"), "baseline", six("reduction", "reduction"))


# --- JSON logs, SQL functions


@query(
    "WITH log AS (SELECT CASE WHEN event_id % 7 = 0 THEN '[' || user_id ELSE '[' || user_id || ',\"' || event_type || '\"]' END AS returned_ids FROM events), ids AS (SELECT unnest(json_extract_string(returned_ids, '$[*]')) AS returned_id FROM log WHERE json_valid(returned_ids)) "
    "SELECT returned_id, count(*) AS hits FROM ids GROUP BY 1 UNION ALL SELECT '(malformed)', count(*) FROM log WHERE NOT json_valid(returned_ids)"
)
def usage_hits_json(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a log whose ids are JSON text, of which every seventh is cut off; those are counted apart."""
    e = table(spark, sf, "events")
    whole = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(',"'), "event_type", F.lit('"]'))
    log = e.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("["), F.col("user_id").cast("string"))).otherwise(whole).alias("returned_ids"))
    broken = housekeeping.parsed_log(log).agg(F.count_if("malformed").alias("hits")).select(F.lit("(malformed)").alias("returned_id"), "hits")
    return housekeeping.hits_json(log).unionByName(broken)


@query(
    f"WITH {CORPUS_SQL} SELECT id, {PENALTY} AS penalty, round({BOOST}, 6) AS boost, ceil(length(content) / 3.5)::BIGINT AS tokens, {FNV.format(NORM.format('title'))} AS decision, round(2.5 * 1.5 * {BOOST} * {PENALTY}, 6) AS score FROM corpus WHERE {NORM.format('title')} <> ''"
)
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Penalty, boost, tokens, decision and score of every document, in SQL alone."""
    sql.register(spark)
    corpus(spark, sf).createOrReplaceTempView("lodestone_corpus")
    rounded = lambda x: f"round(CAST({x} AS DOUBLE) * 1e6D) / 1e6D"
    return spark.sql(
        f"SELECT id, status_penalty(status) AS penalty, {rounded(f'recency_boost(created_at, work_type, {NOW!r})')} AS boost, est_tokens(content) AS tokens, fnv1a32(norm_text(title)) AS decision, "
        f"{rounded(f'doc_score(2.5D, true, created_at, work_type, status, {NOW!r})')} AS score FROM lodestone_corpus WHERE norm_text(title) <> ''"
    )


LINES_SQL = "l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS value, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1)::INT AS line FROM documents)"


@query(f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, line FROM l WHERE regexp_matches(value, '{security.oracle_pattern(n)}')" for n in security.SECRETS))
def sql_scan_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """The secrets of every document by a table function in SQL."""
    sql.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("lodestone_documents")
    return spark.sql("SELECT doc_id, s.name, s.line FROM lodestone_documents, LATERAL scan_secrets(text) AS s")
