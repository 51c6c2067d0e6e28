"""Edges of a document come from its own row."""

from lodestone.operators import graph

DOCS = "id long, title string, tags array<string>, files array<string>, actor string"
ROWS = [(1, "Alpha beta alpha the", ["One", " one", "", None], ["a.md", "a.md", None], "Me"), (2, None, None, None, None), (3, "  ", [], [], " ")]


def test_edges_need_no_shuffle(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    pairs = spark.createDataFrame([(3, 1), (3, 1)], "newer long, older long")
    plan = graph.edges(docs, pairs.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "rel" in plan and "hashpartitioning(src" not in plan
    found = sorted(map(str, (tuple(r) for r in graph.edges(docs, pairs).collect())))
    want = [
        ("footprint:1", "file:a.md", "TOUCHES_FILE", 1.0), ("footprint:1", None, "TOUCHES_FILE", 1.0), ("footprint:1", "tag:one", "HAS_TAG", 1.0),
        ("footprint:1", graph_decision(spark), "HAS_DECISION", 1.0), ("footprint:1", "concept:alpha", "MENTIONS", 0.6), ("footprint:1", "concept:beta", "MENTIONS", 0.6),
        ("footprint:1", "actor:me", "AUTHORED_BY", 1.0), ("footprint:3", "footprint:1", "SUPERSEDES", 3.0),
    ]
    assert found == sorted(map(str, want))


def graph_decision(spark) -> str:
    from pyspark.sql import functions as F

    from lodestone.functions import text

    return spark.range(1).select(graph.node("decision", text.fnv1a32(F.lit("alpha beta alpha the"))).alias("d")).first()["d"]
