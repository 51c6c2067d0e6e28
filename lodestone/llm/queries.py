"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, hard_negatives, language_id, line_dedup, merkle, mixing, packing, pii, repeats, simhash, token_counts, top_k, toxicity
from .common import read


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"), span=200, keep=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, mod n; a null doc_id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(remainder(3) != 1))
    found = toxicity.score(docs, model, threshold=0.7)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] != pii.LEARNT)
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[of(kind) for kind in pii.KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), block=16, period=1024)
    return found.select("doc_id", "source", "mix_slot", "mix_rank")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(remainder(4) != 2))
    return language_id.identify(docs, model).withColumn("held_out", remainder(4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.Manifest(read(spark, sf_dir, "documents"), "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], more, tampered).proofs()
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(read(spark, sf_dir, "documents"), least=20, documents=3)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_packing": op2_packing,
    "op3_repeats": op3_repeats,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_top_k": op8_top_k,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle": op12_merkle,
    "op13_line_dedup": op13_line_dedup,
}

GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

def written(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


#: crc32 of a decimal number, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda acc, c: list_reduce(list_prepend(xor(acc, c), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"

#: The other operators rest on byte pairs, XXH64, suffixes or learnt models, which SQL cannot express.
SQL: dict[str, str] = {
    "op1_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE {GOOD}),
      u AS (SELECT vec_id, e FROM v WHERE list_inner_product(e, e) > 0),
      links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
      reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
      low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
      SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, low.component_id, e.vec_id = low.component_id AS kept FROM embeddings e JOIN low ON low.a = e.vec_id""",
    "op8_top_k": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE {GOOD}),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
      r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
      SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_hard_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE label IS NOT NULL AND {GOOD}),
      s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
      p AS (SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
      r AS (SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.n <= 5)
      SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3""",
    "op12_merkle": f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, sha256({written("doc_id")} || {written("source")} || {written("lang")} || {written("n_chars")} || {written("text")}) AS leaf,
        CASE WHEN {CRC32} % 7 = 0 THEN sha256({written("doc_id")} || {written("source")} || {written("lang")} || {written("(n_chars + 1)")} || {written("text")}) END AS tampered FROM documents),
      placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
      nodes AS (SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
        UNION ALL SELECT lang, any_value(level) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, pos // 2),
      subroots AS (SELECT lang, level AS height, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
      upper AS (SELECT 0 AS level, pos, n, node FROM subroots
        UNION ALL SELECT any_value(level) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY pos // 2),
      root AS (SELECT level AS height, node FROM upper WHERE n = 1),
      steps AS (SELECT p.doc_id, h.level, s.node, s.pos < p.pos >> h.level AS before FROM placed p JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) h ON h.lang IS NOT DISTINCT FROM p.lang
          LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = h.level AND s.pos = xor(p.pos >> h.level, 1)
        UNION ALL SELECT p.doc_id, r.height + h.level, s.node, s.pos < r.pos >> h.level FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) h ON true
          LEFT JOIN upper s ON s.level = h.level AND s.pos = xor(r.pos >> h.level, 1)),
      paths AS (SELECT doc_id, list({{'node': node, 'before': before}} ORDER BY level) AS path, coalesce(string_agg(node, '' ORDER BY level), '') AS proof FROM steps GROUP BY doc_id),
      folded AS (SELECT p.doc_id, 0 AS k, coalesce(p.tampered, p.leaf) AS node, coalesce(w.path, []) AS path FROM placed p LEFT JOIN paths w ON w.doc_id = p.doc_id
        UNION ALL SELECT doc_id, k + 1, sha256(CASE WHEN path[k + 1].node IS NULL THEN node WHEN path[k + 1].before THEN path[k + 1].node || node ELSE node || path[k + 1].node END), path FROM folded WHERE k < len(path))
      SELECT p.doc_id, p.leaf, r.node AS subroot, root.node AS root, sha256(coalesce(w.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = root.node AS verified
        FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN root ON true JOIN folded f ON f.doc_id = p.doc_id AND f.k = len(f.path) LEFT JOIN paths w ON w.doc_id = p.doc_id""",
    "op13_line_dedup": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
      k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
      r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
      j AS (SELECT k.doc_id, k.n, k.line, r.key IS NOT NULL AND k.doc_id <> r.top AS gone FROM k LEFT JOIN r ON r.key = k.key)
      SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
}
