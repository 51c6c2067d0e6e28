"""The registered queries over the driver tables, with SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ranking, security, text
from lodestone.operators import graph, housekeeping, incremental, search
from lodestone.sources import markdown, tables
from lodestone.sources.shared import save
from lodestone.sources.tables import CORPUS_SQL, LOG_SQL, NOW, table
from lodestone.streaming import usage as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def long(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long").alias(name) if name else c.cast("long")


def six(c: Column | str, name: str) -> Column:
    """Six decimals. The double itself is scaled and rounded, as DuckDB does;
    round(c, 6) would round its shortest decimal, which differs at halves."""
    c = c if isinstance(c, Column) else F.col(c)
    return (F.round(c.cast("double") * F.lit(1e6)) / F.lit(1e6)).alias(name)


corpus = tables.documents
TERMS = ["oui", "clown", "als"]
_KEPT: dict = {}


def indexed(spark: SparkSession, sf: str) -> incremental.Index:
    """The stored index of a folder's corpus: built when it is first asked for
    in an application, and brought up to date when the files have changed."""
    index, seen = _KEPT.get((spark.sparkContext.applicationId, sf)) or (incremental.Index(spark), None)
    now = tables.stat(spark, sf, "documents", "labels")
    if now != seen:
        index.ensure(corpus(spark, sf))
    _KEPT[spark.sparkContext.applicationId, sf] = index, now
    return index


TOKENS = r"list_filter(regexp_split_to_array(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
TOKENS_OF = TOKENS.format("content")
WORDS_SQL = f"{CORPUS_SQL}, words AS (SELECT *, {TOKENS_OF} AS toks FROM corpus), lens AS (SELECT *, len(toks) AS dl FROM words)"
AGE = "date_diff('millisecond', CAST(replace(replace(created_at, 'T', ' '), 'Z', '') AS TIMESTAMP), TIMESTAMP '2024-07-01') / 86400000.0"
DECAY = f"greatest(0.0, least(1.0, 1 - ({AGE}) / 180.0))"
BOOST = f"(1 + (CASE WHEN work_type = 'architecture_decision' THEN 0.075 ELSE 0.15 END)::DOUBLE * {DECAY})"
PENALTY = "(CASE status WHEN 'draft' THEN 0.5 WHEN 'completed' THEN 1.0 WHEN 'superseded' THEN 0.15 WHEN 'deprecated' THEN 0.1 ELSE 1.0 END)::DOUBLE"


def bm25_sql(terms: list[str]) -> str:
    tf = lambda t: f"len(list_filter(toks, lambda t: t = '{t}'))"
    columns = ", ".join(f"{tf(t)} AS tf{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
    parts = " + ".join(f"(CASE WHEN tf{i} > 0 THEN greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END)" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"{WORDS_SQL}, counted AS (SELECT *, {columns} FROM lens), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM counted), matched AS (SELECT counted.*, {parts} AS bm25 FROM counted, stats WHERE {some})"


# --- full text


@query(f"WITH {WORDS_SQL} SELECT count(*) AS docs, sum(dl)::BIGINT AS tokens, round(avg(dl), 6) AS avgdl FROM lens")
def fts_tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    dl = corpus(spark, sf).select(F.size(text.tokens(F.col("content"))).alias("dl"))
    return dl.agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"), six(F.avg("dl"), "avgdl"))


@query(f"WITH {WORDS_SQL}, each AS (SELECT id, unnest(toks) AS term FROM words) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM each GROUP BY term")
def fts_term_df(spark: SparkSession, sf: str) -> DataFrame:
    return search.term_stats(corpus(spark, sf))


@query(f"WITH {WORDS_SQL} SELECT id, dl::BIGINT AS dl FROM lens")
def fts_doc_length(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("id", long(F.size(text.tokens(F.col("content"))), "dl"))


@query(f"WITH {bm25_sql(TERMS)} SELECT id, round(bm25, 6) AS bm25 FROM matched")
def fts_bm25_multiterm(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(corpus(spark, sf), search.compile_query(" ".join(TERMS))).select("id", six("bm25", "bm25"))


@query(f"WITH {bm25_sql(TERMS)} SELECT id, round(bm25, 6) AS bm25 FROM matched")
def fts_bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    index = incremental.Index(spark)
    index.build(corpus(spark, sf))
    return search.indexed_bm25(index.read("packed"), index.read("lengths"), [[t] for t in TERMS]).select("id", six("bm25", "bm25"))


@query(f"WITH {bm25_sql(['idiot'])} SELECT id, round(bm25, 6) AS bm25 FROM matched ORDER BY bm25 DESC, id LIMIT 8")
def fts_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = search.bm25(corpus(spark, sf), [["idiot"]]).select("id", six("bm25", "bm25"))
    return found.orderBy(F.desc("bm25"), "id").limit(8)


@query(
    f"WITH {WORDS_SQL} SELECT id, (SELECT count(*) FROM (SELECT unnest(range(1, dl)) AS i) WHERE toks[i] = 'of' AND toks[i + 1] = 'the')::BIGINT AS times FROM lens "
    "WHERE times > 0"
)
def fts_phrase(spark: SparkSession, sf: str) -> DataFrame:
    times = search.frequency(text.tokens(F.col("content")), ["of", "the"])
    return corpus(spark, sf).select("id", long(times, "times")).where("times > 0")


@query()
def fts_stemmed_topk(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.functions.stem import porter

    index = save(search.postings(corpus(spark, sf), stem=True), "postings")
    lengths = index.groupBy("id").agg(F.count("*").alias("dl"))
    found = search.indexed_bm25(index, lengths, [[porter(t)] for t in ("losers", "idiots")])
    return found.select("id", six("bm25", "bm25")).orderBy(F.desc("bm25"), "id").limit(8)


@query()
def fts_snippet(spark: SparkSession, sf: str) -> DataFrame:
    words = text.tokens(F.col("content"))
    found = corpus(spark, sf).withColumn("words", words).where(F.array_contains("words", "idiot"))
    return found.select("id", search.snippet(F.col("words"), ["idiot"]).alias("snippet"))


FULL = f"bm25 * {BOOST} * {PENALTY}"


def _search(name: str, where: str, files: list[str] | None = None, **options) -> None:
    boost = " * 1.5" if files else ""
    sql = f"WITH {bm25_sql(TERMS)} SELECT id, round({FULL}{boost}, 6) AS score, coalesce(status, 'completed') AS status FROM matched {where} ORDER BY score DESC, id LIMIT 8"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = indexed(spark, sf).search(" ".join(TERMS), NOW, limit=None, files=files, **options)
        return found.select("id", six("score", "score"), "status").orderBy(F.desc("score"), "id").limit(8)

    run.__name__ = name
    query(sql)(run)


_search("search_topk", "")
_search("search_tag_filter", "WHERE tag = 'en'", tags=["en"])
_search("search_file_filter", "WHERE file IN ('src/en/src1.md', 'src/fr/src3.md', 'src/de/src0.md')", files=["src/en/src1.md", "src/fr/src3.md", "src/de/src0.md"])
_search("search_exclude_superseded", "WHERE status IS NULL OR status NOT IN ('superseded', 'deprecated')", exclude_superseded=True)


@query(f"WITH {CORPUS_SQL} SELECT id, round({DECAY}, 6) AS decay, round({BOOST}, 6) AS boost, {PENALTY} AS penalty FROM corpus")
def rank_components(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(NOW)
    return corpus(spark, sf).select(
        "id", six(ranking.recency_decay(F.col("created_at"), now), "decay"), six(ranking.recency_boost(F.col("created_at"), F.col("work_type"), now), "boost"), ranking.status_penalty(F.col("status")).alias("penalty")
    )


FILE = "src/en/src7.md"
NEAR = f"SELECT id, 3 AS pass, 4.0 AS hit, 1.0 AS boost FROM corpus WHERE file <> '{FILE}' AND regexp_extract(file, '^(.*)/[^/]*$', 1) = 'src/en'"


def _related_sql(near: bool) -> str:
    passes = f"SELECT id, 1 AS pass, 10.0 AS hit, 1.5 AS boost FROM corpus WHERE file = '{FILE}' UNION ALL SELECT id, 2, bm25, CASE WHEN file = '{FILE}' THEN 1.5 ELSE 1.0 END FROM matched"
    if near:
        passes += f" UNION ALL {NEAR}"
    return f"WITH {bm25_sql(['src7'])}, passes AS ({passes}), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pass) AS r FROM passes) SELECT c.id, b.pass::INT AS pass, round(b.hit * b.boost * {BOOST} * {PENALTY}, 6) AS score FROM corpus c JOIN best b ON c.id = b.id AND b.r = 1"


@query(_related_sql(True))
def related_to_file(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf).related_to_file(FILE, NOW, limit=None).select("id", "pass", six("score", "score"))


@query(_related_sql(False))
def related_no_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf).related_to_file(FILE, NOW, limit=None, include_neighbours=False).select("id", "pass", six("score", "score"))


# --- records


TALKS_SQL = """talks AS (SELECT conv_id AS id, string_agg(CASE WHEN role = 'system' THEN text END, chr(10) ORDER BY turn) AS purpose,
  list(text ORDER BY turn) FILTER (WHERE role = 'user') AS said, string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) || chr(10) ORDER BY turn) AS notes FROM conversations GROUP BY conv_id)"""


def talks(spark: SparkSession, sf: str) -> DataFrame:
    """Records made of conversations: system turns are the purpose, user turns
    decisions, assistant turns notes. A record has the turns of its own
    conversation only."""
    c = table(spark, sf, "conversations")
    turns = lambda role: F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"])
    rows = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.select("id", F.array_join(turns("system"), "\n").alias("purpose"), turns("user").alias("decisions"), F.array_join(turns("assistant"), "\n\n").alias("notes"))


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    t = talks(spark, sf)
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    s = F.struct(
        flat(F.col("purpose")).alias("purpose"), F.transform("decisions", flat).alias("decisions"), F.expr("cast(array() as array<struct<option:string,reason:string>>)").alias("rejected"), flat(F.col("notes")).alias("notes"), F.expr("cast(array() as array<string>)").alias("commands"), F.expr("cast(array() as array<string>)").alias("learned"), F.lit("").alias("guidance")
    )
    return t.select("id", s.alias("s"))


@query()
def sections_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Render and parse again; `same` says that the sections came back."""
    rows = _sections(spark, sf).select("id", "s", markdown.render(F.concat(F.lit("Talk "), F.col("id").cast("string")), F.col("s")).alias("body"))
    back = rows.withColumn("back", markdown.sections(F.col("body")))
    same = (F.coalesce("back.purpose", F.lit("")) == text.trim(F.col("s.purpose"))) & (F.size(F.coalesce("back.decisions", F.array())) == F.size(F.filter("s.decisions", lambda d: text.trim(d) != "")))
    return back.select("id", text.title(F.col("body")).alias("title"), long(F.size(F.coalesce("back.decisions", F.array())), "decisions"), same.alias("same"))


@query(
    f"WITH {TALKS_SQL} SELECT id, coalesce(nullif(trim(regexp_replace(purpose, '\\s+', ' ', 'g')), ''), '') AS purpose, len(coalesce(said, []))::BIGINT AS decisions, length(coalesce(notes, ''))::BIGINT AS notes_chars FROM talks"
)
def record_sections(spark: SparkSession, sf: str) -> DataFrame:
    return talks(spark, sf).select("id", text.trim(F.regexp_replace("purpose", r"\s+", " ")).alias("purpose"), long(F.size("decisions"), "decisions"), long(F.length("notes"), "notes_chars"))


SAID_SQL = "list_filter(list_transform(coalesce(said, []), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"WITH {TALKS_SQL} SELECT id, 'Talk ' || id AS title, len({SAID_SQL})::BIGINT AS decisions, array_to_string({SAID_SQL}, '|') AS said FROM talks")
def sections_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions parsed from rendered bodies by the section reader."""
    rows = _sections(spark, sf).select("id", markdown.render(F.concat(F.lit("Talk "), F.col("id").cast("string")), F.col("s")).alias("body"))
    said = F.coalesce(markdown.sections(F.col("body"))["decisions"], F.array().cast("array<string>"))
    return rows.select("id", text.title(F.col("body")).alias("title"), long(F.size(said), "decisions"), F.array_join(said, "|").alias("said"))


@query(f"WITH {CORPUS_SQL} SELECT id, title || chr(10) || chr(10) || content || chr(10) || chr(10) || tag || chr(10) || chr(10) || file AS flat FROM corpus WHERE title <> ''")
def doc_flatten(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.filter(F.array("title", "content", F.array_join("tags", " "), F.array_join("files", " ")), lambda x: x != "")
    return corpus(spark, sf).where("title <> ''").select("id", F.array_join(parts, "\n\n").alias("flat"))


@query(f"WITH {CORPUS_SQL} SELECT id, tag, created_at FROM corpus WHERE tag = 'fr' AND file = 'src/fr/src4.md' AND created_at >= '2024-01-05'")
def list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    found = housekeeping.listed(corpus(spark, sf), "fr", "src/fr/src4.md", "2024-01-05")
    return found.select("id", F.col("tags")[0].alias("tag"), "created_at")


@query(f"WITH {CORPUS_SQL} SELECT id, created_at FROM corpus WHERE tag IN ('en', 'es') ORDER BY created_at DESC, id DESC LIMIT 8")
def list_recent(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.recent(corpus(spark, sf), 8, ["en", "es"]).select("id", "created_at")


ACTIVE = "(status IS NULL OR status NOT IN ('superseded', 'deprecated'))"


@query(f"WITH {CORPUS_SQL}, live AS (SELECT * FROM corpus WHERE {ACTIVE}) SELECT id, created_at, greatest(0, (SELECT count(*) FROM live) - 3)::BIGINT AS more FROM live ORDER BY created_at DESC, id DESC LIMIT 3")
def recent_digest(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.digest(corpus(spark, sf)).select("id", "created_at", long("more", "more"))


@query(f"WITH {CORPUS_SQL} SELECT id, title, status FROM corpus WHERE id = 42")
def show_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).where("id = 42").select("id", "title", "status")


# --- graph


NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
FNV = "lpad(lower(to_hex(list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT))), 8, '0')"
SAME_SQL = "same AS (SELECT id AS newer, lag(id) OVER (PARTITION BY content ORDER BY id) AS older FROM corpus)"
CONCEPTS_SQL = f"concepts AS (SELECT DISTINCT id, word FROM (SELECT id, unnest(regexp_split_to_array({NORM.format('title')}, '[^a-z0-9]+')) AS word FROM corpus) WHERE length(word) >= 3 AND word NOT IN ({STOP}))"
EDGES_SQL = f"""{CORPUS_SQL}, {SAME_SQL}, {CONCEPTS_SQL}, edges AS (
  SELECT 'footprint:' || id AS src, 'file:' || file AS dst, 'TOUCHES_FILE' AS rel, 1.0::DOUBLE AS weight FROM corpus
  UNION ALL SELECT 'footprint:' || id, 'tag:' || {NORM.format('tag')}, 'HAS_TAG', 1.0 FROM corpus
  UNION ALL SELECT 'footprint:' || id, 'decision:' || {FNV.format(NORM.format('title'))}, 'HAS_DECISION', 1.0 FROM corpus WHERE {NORM.format('title')} <> ''
  UNION ALL SELECT 'footprint:' || id, 'concept:' || word, 'MENTIONS', 0.6 FROM concepts
  UNION ALL SELECT 'footprint:' || id, 'actor:' || {NORM.format('actor')}, 'AUTHORED_BY', 1.0 FROM corpus
  UNION ALL SELECT 'footprint:' || newer, 'footprint:' || older, 'SUPERSEDES', 3.0 FROM same WHERE older IS NOT NULL)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    return graph.edges(docs, tables.supersedes(docs))


@query(f"WITH {EDGES_SQL} SELECT src, dst, rel, weight FROM edges")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


@query(f"WITH {EDGES_SQL}, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT split_part(id, ':', 1) AS kind, count(*) AS n FROM ids GROUP BY 1")
def graph_node_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes(edges(spark, sf), corpus(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT rel, count(*) AS n, round(sum(weight), 6) AS weight FROM edges GROUP BY rel")
def graph_edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).groupBy("rel").agg(F.count("*").alias("n"), six(F.sum("weight"), "weight"))


@query(f"WITH {EDGES_SQL}, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, count(*) AS degree FROM ends WHERE id LIKE 'footprint:%' GROUP BY id ORDER BY degree DESC, id LIMIT 5")
def graph_top_connected(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(edges(spark, sf)).where(F.col("id").startswith("footprint:")).orderBy(F.desc("degree"), "id").limit(5)


@query(f"WITH {CORPUS_SQL}, {CONCEPTS_SQL} SELECT word AS concept, count(*) AS docs FROM concepts GROUP BY word")
def graph_concepts(spark: SparkSession, sf: str) -> DataFrame:
    words = corpus(spark, sf).select("id", F.explode(F.array_distinct(text.significant_tokens(F.col("title")))).alias("concept"))
    return words.groupBy("concept").agg(F.count("*").alias("docs"))


@query(f"WITH {CORPUS_SQL} SELECT id, {FNV.format(NORM.format('title'))} AS decision FROM corpus WHERE {NORM.format('title')} <> ''")
def fnv_decision_ids(spark: SparkSession, sf: str) -> DataFrame:
    said = text.normalise(F.col("title"))
    return corpus(spark, sf).where(said != "").select("id", text.fnv1a32(said).alias("decision"))


@query(f"WITH {EDGES_SQL}, s AS (SELECT src, dst FROM edges WHERE rel = 'SUPERSEDES') SELECT src AS a, dst AS b FROM s UNION SELECT dst, src FROM s")
def graph_supersedes_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    s = edges(spark, sf).where("rel = 'SUPERSEDES'")
    return s.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(s.select("dst", "src")).distinct()


@query(f"WITH {EDGES_SQL}, kept AS (SELECT * FROM edges WHERE rel <> 'TOUCHES_FILE'), ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT id FROM ids WHERE id NOT IN (SELECT src FROM kept UNION SELECT dst FROM kept)")
def graph_orphans(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.orphans(graph.nodes(e, corpus(spark, sf)), e.where("rel <> 'TOUCHES_FILE'")).select("id")


BRIDGE_W = "CASE e1.rel WHEN 'TOUCHES_FILE' THEN 1.0 WHEN 'HAS_TAG' THEN 0.5 WHEN 'HAS_DECISION' THEN 0.9 ELSE 0.7 END"


def _hop_sql(frontier: str, name: str, d: int) -> str:
    return f"""{name} AS (SELECT id, sum(points::DECIMAL(18,6))::DOUBLE AS points, count(*) AS bridges, {d} AS distance FROM (
    SELECT e2.src AS id, ({BRIDGE_W})::DOUBLE * least(e1.weight, e2.weight) AS points FROM {frontier} f JOIN edges e1 ON e1.src = f.id AND e1.rel IN ('TOUCHES_FILE','HAS_TAG','HAS_DECISION','MENTIONS')
      JOIN edges e2 ON e2.dst = e1.dst AND e2.rel = e1.rel AND e2.src <> e1.src
    UNION ALL SELECT e.dst, 1.5 * e.weight FROM {frontier} f JOIN edges e ON e.src = f.id AND e.rel = 'SUPERSEDES'
    UNION ALL SELECT e.src, 1.5 * e.weight FROM {frontier} f JOIN edges e ON e.dst = f.id AND e.rel = 'SUPERSEDES') GROUP BY id)"""


GRAPH_SCORE = f"points * power(0.5, greatest(0, distance - 1)) * {BOOST} * {PENALTY}"
RANKED = f"SELECT x.id, x.distance::INT AS distance, x.bridges::BIGINT AS bridges, round({GRAPH_SCORE}, 6) AS score FROM {{0}} x JOIN corpus c ON x.id = 'footprint:' || c.id"


@query(f"WITH {EDGES_SQL}, seed AS (SELECT 'footprint:5' AS id), {_hop_sql('seed', 'h1', 1)} {RANKED.format('h1')} WHERE x.id <> 'footprint:5'")
def graph_expand_1hop(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("footprint:5",)], "id string")
    found = graph.expand(save(edges(spark, sf), "edges"), seeds, 1)
    return graph.rank(found, corpus(spark, sf), NOW).select("id", "distance", "bridges", six("score", "score"))


@query(
    f"WITH {EDGES_SQL}, seed AS (SELECT 'footprint:5' AS id), {_hop_sql('seed', 'h1', 1)}, next AS (SELECT id FROM h1 WHERE id <> 'footprint:5'), {_hop_sql('next', 'h2', 2)}, "
    f"either AS (SELECT id, sum(points::DECIMAL(18,6))::DOUBLE AS points, sum(bridges) AS bridges, min(distance) AS distance FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE id <> 'footprint:5' GROUP BY id) {RANKED.format('either')}"
)
def graph_expand_2hop(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("footprint:5",)], "id string")
    found = graph.expand(save(edges(spark, sf), "edges"), seeds, 2)
    return graph.rank(found, corpus(spark, sf), NOW).select("id", "distance", "bridges", six("score", "score"))


@query(
    f"WITH RECURSIVE {EDGES_SQL}, either AS (SELECT src AS a, dst AS b FROM edges WHERE rel <> 'AUTHORED_BY' UNION SELECT dst, src FROM edges WHERE rel <> 'AUTHORED_BY'), "
    "way AS (SELECT 'footprint:5' AS id, 0 AS d UNION SELECT b, d + 1 FROM way JOIN either ON a = id WHERE d < 4) SELECT id, min(d)::INT AS distance FROM way GROUP BY id"
)
def graph_distances(spark: SparkSession, sf: str) -> DataFrame:
    return graph.distances(save(edges(spark, sf), "edges"), "footprint:5", 4).select("id", "distance")


@query(
    f"WITH RECURSIVE {EDGES_SQL}, either AS (SELECT src AS a, dst AS b, rel FROM edges WHERE rel <> 'AUTHORED_BY' UNION SELECT dst, src, rel FROM edges WHERE rel <> 'AUTHORED_BY'), "
    "way AS (SELECT 'footprint:5' AS id, 0 AS d UNION SELECT b, d + 1 FROM way JOIN either ON a = id WHERE d < 4), near AS (SELECT id, min(d) AS d FROM way GROUP BY id), "
    "best AS (SELECT n.id, n.d, min({'a': e.a, 'rel': e.rel}) AS x FROM near n JOIN either e ON e.b = n.id JOIN near m ON m.id = e.a AND m.d = n.d - 1 GROUP BY ALL), "
    "back AS (SELECT goal, goal AS id FROM (VALUES ('footprint:8'), ('footprint:9')) t(goal) UNION ALL SELECT goal, x.a FROM back JOIN best USING (id)) "
    "SELECT goal, n.d::BIGINT AS step, n.id, b.x.rel AS rel FROM back JOIN near n USING (id) LEFT JOIN best b ON b.id = n.id"
)
def graph_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    """The ways from a document to two others, searched from both ends."""
    known = save(edges(spark, sf), "edges")
    found = [(goal, i, *step) for goal in ("footprint:8", "footprint:9") for i, step in enumerate(graph.explain(known, "footprint:5", goal, 4))]
    return spark.createDataFrame(found, "goal string, step long, id string, rel string")


TOP_SQL = f"{bm25_sql(TERMS)}, seeds AS (SELECT id, round({FULL}, 6) AS score FROM matched WHERE {ACTIVE} ORDER BY score DESC, id LIMIT 8)"
EDGES_ONLY = EDGES_SQL[len(CORPUS_SQL) + 2 :]


@query(
    f"WITH {TOP_SQL}, {EDGES_ONLY}, seed AS (SELECT 'footprint:' || id AS id FROM seeds), {_hop_sql('seed', 'h1', 1)}, "
    f"related AS ({RANKED.format('h1')} WHERE x.id NOT IN (SELECT id FROM seed) AND {ACTIVE}), top AS (SELECT * FROM related ORDER BY score DESC, id LIMIT 8) "
    "SELECT 'footprint:' || id AS id, 'fts' AS origin, score FROM seeds UNION ALL SELECT id, 'graph', score FROM top"
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword matches first, then what the graph relates to them."""
    docs = corpus(spark, sf)
    seeds = indexed(spark, sf).search(" ".join(TERMS), NOW, limit=None, exclude_superseded=True)
    seeds = save(seeds.select(graph.node("footprint", F.col("id").cast("string")).alias("id"), "id", six("score", "score")).toDF("id", "doc", "score").orderBy(F.desc("score"), "doc").limit(8).drop("doc"), "seeds")
    found = graph.rank(graph.expand(save(edges(spark, sf), "edges"), seeds.select("id"), 1), docs, NOW, exclude_superseded=True)
    related = found.select("id", six("score", "score")).orderBy(F.desc("score"), "id").limit(8)
    return seeds.withColumn("origin", F.lit("fts")).select("id", "origin", "score").union(related.select("id", F.lit("graph"), "score"))


# --- contexts


@query(f"WITH {CORPUS_SQL} SELECT id, ceil(length(content) / 3.5)::BIGINT AS tokens FROM corpus")
def context_estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("id", text.estimate_tokens(F.col("content")).alias("tokens"))


@query(
    f"WITH {bm25_sql(TERMS)}, ranked AS (SELECT id, tag, content, row_number() OVER (PARTITION BY tag ORDER BY round({FULL}, 6) DESC, id) AS rank FROM matched), "
    "spent AS (SELECT *, ceil(length(content) / 3.5)::BIGINT AS cost, 10 + sum(ceil(length(content) / 3.5)::BIGINT) OVER (PARTITION BY tag ORDER BY rank) AS used FROM ranked) "
    "SELECT tag, id, rank::INT AS rank, used::BIGINT AS used FROM spent WHERE used <= 1600 OR rank = 1"
)
def context_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The best matches of each language that fit a budget of tokens."""
    from pyspark.sql import Window

    docs = corpus(spark, sf).withColumn("tokens", text.estimate_tokens(F.col("content"))).drop("content")
    found = docs.join(indexed(spark, sf).match([[t] for t in TERMS]), "id")
    score = ranking.score(F.col("bm25"), F.col("files"), [], F.col("created_at"), F.col("work_type"), F.col("status"), F.lit(NOW))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("score"), "id"))
    # each match costs a token at least, so no later rank than the budget fits; Spark keeps as many a group before it shuffles
    ranked = found.select("id", F.col("tags")[0].alias("tag"), "tokens", six(score, "score")).withColumn("rank", rank).where("rank <= 1600")
    return search.budget_prefix(ranked, F.col("tokens"), 1600, 10, "tag").select("tag", "id", "rank", long("used", "used"))


@query(
    f"WITH {bm25_sql(TERMS)}, whole AS (SELECT sum(ceil(length(content) / 3.5)::BIGINT) AS all_tokens FROM corpus), top AS (SELECT title FROM matched ORDER BY round({FULL}, 6) DESC, id LIMIT 8), "
    "got AS (SELECT sum(ceil(length(title) / 3.5)::BIGINT) AS tokens FROM top) SELECT all_tokens::BIGINT AS all_tokens, tokens::BIGINT AS tokens, round(100.0 * (1 - tokens / all_tokens), 6) AS reduction FROM whole, got"
)
def bench_token_reduction(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    whole = docs.agg(F.sum(text.estimate_tokens(F.col("content"))).alias("all_tokens")).withColumn("k", F.lit(1))
    top = indexed(spark, sf).search(" ".join(TERMS), NOW, limit=None).select("id", "title", six("score", "score")).orderBy(F.desc("score"), "id").limit(8)
    got = top.agg(F.sum(text.estimate_tokens(F.col("title"))).alias("tokens")).withColumn("k", F.lit(1))
    return whole.join(got, "k").select("all_tokens", "tokens", six(100.0 * (1 - F.col("tokens") / F.col("all_tokens")), "reduction"))


# --- upkeep


OLD_SQL = f"{CORPUS_SQL}, was AS (SELECT d.doc_id AS id, sha1(CASE WHEN l.quality = 1 THEN d.text ELSE d.text || '#' END) AS hash FROM documents d JOIN labels l ON d.doc_id = l.doc_id), now AS (SELECT id, sha1(content) AS hash FROM corpus)"


@query(f"WITH {OLD_SQL} SELECT coalesce(was.id, now.id) AS id, CASE WHEN was.id IS NULL THEN 'added' WHEN now.id IS NULL THEN 'removed' WHEN was.hash <> now.hash THEN 'changed' ELSE 'same' END AS change FROM was FULL JOIN now ON was.id = now.id")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Against an earlier state in which only labelled documents were there and poor ones read otherwise."""
    docs = corpus(spark, sf)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    was = docs.join(labels, "id").select("id", F.when(F.col("quality") == 1, F.col("content")).otherwise(F.concat("content", F.lit("#"))).alias("content"))
    return incremental.diff(incremental.manifest(was), incremental.manifest(docs))


LEVEL = "SELECT floor(pos / 1000)::BIGINT AS pos, sha1(string_agg(line, ',' ORDER BY pos, line)) AS line FROM {0} GROUP BY 1"


@query(
    f"WITH {CORPUS_SQL}, l0 AS (SELECT id AS pos, id || ':' || sha1(content) AS line FROM corpus), l1 AS ({LEVEL.format('l0')}), l2 AS ({LEVEL.format('l1')}), l3 AS ({LEVEL.format('l2')}) "
    "SELECT sha1(string_agg(line, ',' ORDER BY pos, line)) AS corpus_hash FROM l3"
)
def corpus_hash(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.corpus_hash(incremental.manifest(corpus(spark, sf)))


@query(
    f"WITH {CORPUS_SQL} SELECT actor, CASE WHEN count(*) <> count(status) THEN 'stale: count' WHEN max(created_at) > max(CASE WHEN status IS NOT NULL THEN created_at END) THEN 'stale: mtime' ELSE 'fresh' END AS state FROM corpus GROUP BY actor"
)
def freshness_status(spark: SparkSession, sf: str) -> DataFrame:
    """Per source, an index of the labelled documents against all of them."""
    kept = F.when(F.col("status").isNotNull(), F.col("created_at"))
    g = corpus(spark, sf).groupBy("actor").agg(F.count("status").alias("was"), F.count("*").alias("n"), F.max(kept).alias("old"), F.max("created_at").alias("new"))
    return g.select("actor", incremental.freshness(F.lit(incremental.SCHEMA_VERSION), F.col("was"), F.col("n"), F.col("old"), F.col("new")).alias("state"))


@query(f"WITH {WORDS_SQL}, each AS (SELECT id, unnest(toks) AS term FROM words) SELECT term, count(*) AS cf FROM each GROUP BY term")
def incremental_equals_full(spark: SparkSession, sf: str) -> DataFrame:
    """Postings after a build of the labelled documents and an update to all of them."""
    docs = corpus(spark, sf)
    index = incremental.Index(spark)
    index.build(docs.where("status is not null").withColumn("content", F.when(F.col("status") == "completed", F.col("content")).otherwise(F.lit("other words"))))
    index.update(docs)
    return index.read("postings").groupBy("term").agg(F.count("*").alias("cf"))


# --- usage and order


@query(f"WITH {LOG_SQL} SELECT op, source, count(*) AS reads FROM log GROUP BY GROUPING SETS ((op), (source), ())")
def usage_by_op_and_source(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.usage(tables.events_log(spark, sf))


@query(f"WITH {LOG_SQL} SELECT returned_id, count(*) AS hits FROM log WHERE returned_id IS NOT NULL GROUP BY returned_id")
def usage_hits(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.hits(tables.events_log(spark, sf))


@query(f"WITH {CORPUS_SQL}, {LOG_SQL} SELECT id FROM corpus WHERE id NOT IN (SELECT returned_id FROM log WHERE returned_id IS NOT NULL)")
def usage_never_referenced(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.never_referenced(corpus(spark, sf), tables.events_log(spark, sf)).select("id")


@query(f"WITH {LOG_SQL} SELECT op, count(*) AS reads FROM log WHERE ts >= '2024-01-15T00:00:00' GROUP BY op")
def usage_since(spark: SparkSession, sf: str) -> DataFrame:
    return tables.events_log(spark, sf).where("ts >= '2024-01-15T00:00:00'").groupBy("op").agg(F.count("*").alias("reads"))


@query(f"WITH {LOG_SQL} SELECT source, CASE WHEN count(*) FILTER (WHERE op = 'purchase') = 0 THEN count(*) || ':0' ELSE printf('%.2f:1', count(*) FILTER (WHERE op <> 'purchase') / count(*) FILTER (WHERE op = 'purchase')) END AS ratio FROM log GROUP BY source")
def usage_read_write_ratio(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.events_log(spark, sf).groupBy("source").agg(F.sum((F.col("op") != "purchase").cast("int")).alias("r"), F.sum((F.col("op") == "purchase").cast("int")).alias("w"))
    return log.select("source", housekeeping.ratio(F.col("r"), F.col("w")).alias("ratio"))


SLUG = "CASE WHEN trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'untitled' ELSE trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') END"
PARTS_SQL = f"parts AS (SELECT p_partkey AS id, {SLUG.format('p_name')} AS slug, strftime(DATE '2024-01-01' + (p_size)::INT, '%Y-%m-%d') AS created_at FROM part)"


def parts(spark: SparkSession, sf: str) -> DataFrame:
    created = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", created.alias("created_at"), F.lit("completed").alias("status"))


@query(f"WITH {PARTS_SQL} SELECT slug, count(*) AS n, arg_max(id, struct_pack(created_at := created_at, id := id)) AS newest, arg_min(id, struct_pack(created_at := created_at, id := id)) AS oldest FROM parts GROUP BY slug HAVING count(*) > 1")
def gc_duplicate_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.duplicate_clusters(parts(spark, sf), text.slug(F.col("p_name"), ascii_only=True))


@query(f"WITH {PARTS_SQL}, new AS (SELECT *, first_value(id) OVER (PARTITION BY slug ORDER BY created_at DESC, id DESC) AS newest FROM parts) SELECT id AS old, newest AS new FROM new WHERE id <> newest")
def gc_supersede_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.supersede_pairs(parts(spark, sf), text.slug(F.col("p_name"), ascii_only=True))


@query(
    f"WITH {PARTS_SQL}, new AS (SELECT *, first_value(id) OVER (PARTITION BY slug ORDER BY created_at DESC, id DESC) AS newest, count(*) OVER (PARTITION BY slug) - 1 AS older FROM parts) "
    "SELECT id, CASE WHEN id <> newest THEN 'superseded' ELSE 'completed' END AS status, (CASE WHEN id <> newest THEN newest END) AS superseded_by, (CASE WHEN id = newest THEN older ELSE 0 END)::BIGINT AS supersedes FROM new"
)
def supersede_apply(spark: SparkSession, sf: str) -> DataFrame:
    docs = parts(spark, sf)
    pairs = housekeeping.supersede_pairs(docs, text.slug(F.col("p_name"), ascii_only=True))
    return housekeeping.apply_supersede(docs, pairs).select("id", "status", "superseded_by", long("supersedes", "supersedes"))


@query(f"WITH {CORPUS_SQL} SELECT id FROM corpus WHERE status = 'completed' AND created_at < '2024-01-20'")
def gc_stale(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.stale(corpus(spark, sf), "2024-01-20").select("id")


@query(
    "WITH lines AS (SELECT conv_id::VARCHAR AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS pos, text FROM conversations WHERE role = 'user') "
    "SELECT id, id || '#' || pos AS entry, text AS line FROM lines WHERE id || '#' || pos NOT IN (SELECT doc_id || '#0' FROM labels)"
)
def memory_update_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all records that no label's record has as its first entry."""
    records = talks(spark, sf).select(F.col("id").cast("string").alias("id"), F.col("decisions").alias("learned"))
    known = table(spark, sf, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("entry"))
    return housekeeping.learned(records, known)


HEALTH = "SELECT count(*) AS records, sum(({0})::INT)::BIGINT AS active, sum((coalesce(status = 'superseded', false))::INT)::BIGINT AS superseded, sum((created_at >= '2024-01-20')::INT)::BIGINT AS recent_writes FROM corpus"


@query(f"WITH {CORPUS_SQL}, {LOG_SQL}, d AS ({HEALTH.format(ACTIVE)}), r AS (SELECT count(*) AS reads, count(DISTINCT returned_id) AS referenced FROM log) SELECT records, active, superseded, recent_writes, reads, referenced, CASE WHEN recent_writes = 0 THEN reads || ':0' ELSE printf('%.2f:1', reads / recent_writes) END AS ratio FROM d, r")
def health_report(spark: SparkSession, sf: str) -> DataFrame:
    return housekeeping.health(corpus(spark, sf), tables.events_log(spark, sf), "2024-01-20")


# --- secrets and names


def _secret_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").union(table(spark, sf, "pages").select("page_id", "html"))


TEXTS_SQL = "texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT page_id, html FROM pages)"
LINES_SQL = f"{TEXTS_SQL}, split AS (SELECT id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM texts), lines AS (SELECT id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM split)"


def _pattern_sql(select: str) -> str:
    rows = " UNION ALL ".join(f"SELECT id, pos, '{n}' AS name FROM lines WHERE regexp_matches(line, '{security.oracle_pattern(n)}')" for n in security.SECRETS)
    return f"WITH {LINES_SQL}, found AS ({rows}) {select}"


@query(_pattern_sql("SELECT n.name, count(f.id) AS lines FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in security.SECRETS) + "]) AS name) n LEFT JOIN found f ON f.name = n.name GROUP BY n.name"))
def secret_scan_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = security.scan(_secret_texts(spark, sf), "id", "text").groupBy("name").agg(F.count("*").alias("lines"))
    names = spark.createDataFrame([(n,) for n in security.SECRETS], "name string")
    return names.join(found, "name", "left").select("name", F.coalesce("lines", F.lit(0).cast("long")).alias("lines"))


def _redact_sql() -> str:
    t = "text"
    for n in security.SECRETS:
        t = f"regexp_replace({t}, '{security.oracle_pattern(n)}', '[REDACTED:{n}]', 'g')"
    return f"WITH {TEXTS_SQL} SELECT id, sha1({t}) AS redacted FROM texts"


@query(_redact_sql())
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    return _secret_texts(spark, sf).select("id", F.sha1(security.redact(F.col("text"))).alias("redacted"))


@query(
    f"WITH {LINES_SQL}, toks AS (SELECT id, pos, unnest(regexp_split_to_array(line, '[\\s\"''`(),;]+')) AS tok FROM lines), long AS (SELECT DISTINCT id, pos, tok FROM toks WHERE length(tok) >= 32), "
    "chars AS (SELECT id, pos, tok, unnest(string_split(tok, '')) AS c FROM long), share AS (SELECT id, pos, tok, c, count(*) / length(tok) AS p FROM chars GROUP BY id, pos, tok, c), "
    "bits AS (SELECT id, pos, tok, -sum(p * log2(p)) AS h FROM share GROUP BY id, pos, tok) SELECT DISTINCT id, pos::INT AS line FROM bits WHERE h >= 3.5"
)
def entropy_scan(spark: SparkSession, sf: str) -> DataFrame:
    return security.scan_entropy(_secret_texts(spark, sf), "id", "text", min_entropy=3.5).distinct()


@query()
def redact_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties, nested under a key that is hidden and one that isn't."""
    e = table(spark, sf, "events")
    doc = F.concat(F.lit('{"Api-Key": "'), F.col("user_id").cast("string"), F.lit('", "in": ['), "props", F.lit("]}"))
    return e.select("event_id", security.redact_keys(doc).alias("clean"))


@query(f"SELECT p_partkey AS id, {SLUG.format('p_name')} AS slug, 'fp_20240101_' || replace({SLUG.format('p_name')}, '-', '_') || '_' || p_partkey AS footprint_id FROM part")
def make_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = text.slug(F.col("p_name"), ascii_only=True)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), s.alias("slug"), text.footprint_id(F.lit("2024-01-01T00:00:00Z"), s, F.col("p_partkey").cast("string")).alias("footprint_id"))


@query("SELECT page_id, url, NOT regexp_matches(lower(url), '^https?://') AS bad FROM pages")
def validate_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", markdown.bad_url(F.col("url")).alias("bad"))


@query(f"WITH {CORPUS_SQL}, v AS (SELECT id, (CASE WHEN id % 3 = 0 THEN '/' WHEN id % 3 = 1 THEN '../' ELSE '' END) || file AS path FROM corpus) SELECT id, path, regexp_matches(path, '^(/|[A-Za-z]:)') OR list_contains(string_split(path, '/'), '..') AS bad FROM v")
def validate_paths(spark: SparkSession, sf: str) -> DataFrame:
    lead = F.when(F.col("id") % 3 == 0, "/").when(F.col("id") % 3 == 1, "../").otherwise("")
    rows = corpus(spark, sf).select("id", F.concat(lead, F.col("files")[0]).alias("path"))
    return rows.withColumn("bad", markdown.bad_path(F.col("path")))


@query("SELECT o_orderkey, (o_custkey % 10) || '.' || (o_orderkey % 7) AS a, (o_orderkey % 10) || '.' || (o_custkey % 7) || '.1' AS b, [o_custkey % 10, o_orderkey % 7, 0] > [o_orderkey % 10, o_custkey % 7, 1] AS newer FROM orders")
def version_compare(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    s = lambda c: c.cast("string")
    rows = o.select("o_orderkey", F.concat_ws(".", s(F.col("o_custkey") % 10), s(F.col("o_orderkey") % 7)).alias("a"), F.concat_ws(".", s(F.col("o_orderkey") % 10), s(F.col("o_custkey") % 7), F.lit("1")).alias("b"))
    return rows.withColumn("newer", text.is_newer(F.col("a"), F.col("b")))


# --- streams


@query("SELECT date_trunc('hour', ts) AS start, event_type AS op, count(*) AS reads FROM events GROUP BY 1, 2")
def stream_usage_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts kept by a stream over the event files."""
    return stream.run(spark, sf, "events*.parquet")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS op, count(*) AS reads FROM events GROUP BY 1, 2")
def usage_windows(spark: SparkSession, sf: str) -> DataFrame:
    return stream.windowed(table(spark, sf, "events"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS reads FROM s GROUP BY user_id, k"
)
def usage_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return stream.sessions(table(spark, sf, "events"))
