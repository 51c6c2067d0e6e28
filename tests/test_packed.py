"""Packed postings, and what reads them, against a row for each word."""

from pyspark.sql import functions as F

from lodestone.operators import incremental, search
from lodestone.sources import tables

QUERIES = ["of_the", "the_of_the", "a", "of the", "the_the of_the the", "nowhere_at", "x1_a"]


def corpus(spark):
    bodies = [None, "", "...", "the of the of the", "of\nThe a. A the the", "Élan of THE a a", " ".join(["of the a b"] * 60), "b a of", "x1 a x1 b"]
    rows = [(i, f"the title {i % 3}", ["of", "the"], b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "id long, title string, tags array<string>, content string")


def test_packed_postings_are_the_postings(spark, monkeypatch):
    docs = corpus(spark)
    monkeypatch.setattr(search, "AT_ONCE", 7)
    for stem in (False, True):
        for columns in (("content",), ("title", "tags", "content")):
            packed = search.packed(docs, stem, columns)
            assert packed.groupBy("id", "term").count().where("count > 1").isEmpty()
            rows = lambda df: sorted(map(tuple, df.select("id", "pos", "term").collect()))
            assert rows(search.unpacked(packed)) == rows(search.postings(docs, stem, columns))
            n = {r["id"]: r["n"] for r in search.unpacked(packed).groupBy("id").agg(F.count("*").alias("n")).collect()}
            assert {r["id"]: r["n"] for r in docs.select("id", search.length(docs, columns).alias("n")).where("n > 0").collect()} == n
    assert search.packed(docs.limit(0)).collect() == []


def test_phrases_and_many_queries(spark):
    docs = corpus(spark)
    index = incremental.Index(spark)
    index.build(docs.select("id", "content"))
    lengths, totals = index.read("lengths"), (index.state["count"], index.state["words"])
    found = lambda df, *keys: {tuple(r[k] for k in keys): round(r["bm25"], 9) for r in df.collect()}
    want = {}
    for n, query in enumerate(QUERIES):
        phrases = search.compile_query(query)
        plain = found(search.indexed_bm25(search.postings(docs), lengths, phrases, totals), "id")
        assert found(search.indexed_bm25(index.read("packed"), lengths, phrases, totals), "id") == plain
        want |= {(n, *k): x for k, x in plain.items()}
    asked = search.asked_words(spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string"))
    assert found(search.many_bm25(index.read("packed"), lengths, asked, totals), "query_id", "id") == want


def test_no_word_is_shuffled_and_texts_stay(spark, tmp_path):
    """What a build reads of a corpus has no exchange: labels go to the documents, and postings are written where they are read."""
    spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = search.packed(tables.documents(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
