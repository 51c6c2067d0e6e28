"""Stored tables: freshness by content, segments, the node store, corrupt tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators import graph, incremental, stored
from lodestone.sources import tables

DOC = "id long, title string, content string, tags array<string>, files array<string>, status string, work_type string, created_at string, actor string"
NOW = "2024-07-01T00:00:00.000Z"


def doc(i, title, content, tags=(), files=(), day=1, actor="ann", status="completed"):
    return (i, title, content, list(tags), list(files), status, "bug_fix", f"2024-06-{day:02}T00:00:00.000Z", actor)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    return {i: doc(i, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=12)), [rng.choice(["One", "two", "Three x"])], [f"src/{rng.choice(words)}.md"], 1 + i % 28, rng.choice(["Ann", "bob"])) for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.values()), DOC)


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_an_edit_is_seen_and_a_touch_is_not(spark, tmp_path):
    rows = corpus(60)
    memory = spark.createDataFrame([("m1", ["one"])], "id string, tags array<string>")
    base = f"file://{tmp_path}/store"
    engine = Engine(spark, frame(spark, rows), base=base, memory=memory)
    assert engine.refresh() == {"index": "missing", "graph": "missing"} and engine.refresh() == {"index": "fresh", "graph": "fresh"}
    rows[7] = (*rows[7][:2], rows[7][2] + " zebra", *rows[7][3:])  # same count, same times
    memory = memory.union(spark.createDataFrame([("m2", ["two"])], "id string, tags array<string>"))
    engine = Engine(spark, frame(spark, rows), base=base, memory=memory)
    assert engine.refresh() == {"index": "stale: content", "graph": "stale: count"}
    assert [r["id"] for r in engine.search("zebra").collect()] == [7]
    assert engine.graph.read("edges").where("src = 'memory:m2'").count() == 1
    assert engine.explain("m2", "tag:two")[-1] == ("tag:two", "HAS_TAG")  # ids of memory documents resolve
    before = engine.index.version
    assert engine.refresh() == {"index": "fresh", "graph": "fresh"} and engine.index.version == before
    pairs = spark.createDataFrame([(1, 2)], "newer long, older long")  # nothing but a new SUPERSEDES
    engine = Engine(spark, frame(spark, rows), pairs, base=base, memory=memory)
    assert engine.refresh() == {"index": "fresh", "graph": "stale: content"}
    assert engine.graph.read("edges").where("rel = 'SUPERSEDES'").select("src", "dst").collect() == [("footprint:1", "footprint:2")]


def test_size_and_time_before_content(spark):
    rows = [(i, f"text {i}", 6, 100, "2024") for i in range(20)]
    schema = "id long, content string, size long, mtime long, created_at string"
    index = incremental.Index(spark)
    index.build(spark.createDataFrame(rows, schema))
    touched = [(i, t, s, m + (i == 3), c) for i, t, s, m, c in rows]
    assert index.ensure(spark.createDataFrame(touched, schema)) == "fresh" and index.version == 1
    edited = [(i, "other" if i == 4 else t, s, m, c) for i, t, s, m, c in rows]
    trusted = spark.createDataFrame(edited, schema)
    assert index.ensure(trusted) == "fresh"  # same size and time: trusted
    assert index.ensure(trusted, trust=False) == "stale: content"
    assert index.read("postings").where("term = 'other'").count() == 1


def test_corrupt_tables_are_missing(spark, tmp_path):
    rows = corpus(30)
    base = f"{tmp_path}/index"
    index = incremental.Index(spark, f"file://{base}")
    index.build(frame(spark, rows))
    for table in ("postings", "pointer"):
        for d, _, files in os.walk(f"{base}/{table}"):
            for f in files:
                if f.endswith(".parquet"):
                    with open(f"{d}/{f}", "wb") as out:
                        out.write(b"not a table")
                elif f.endswith(".crc"):
                    os.remove(f"{d}/{f}")
        again = incremental.Index(spark, f"file://{base}")
        assert again.state is None and again.ensure(frame(spark, rows)) == "missing"
        assert incremental.Index(spark, f"file://{base}").ensure(frame(spark, rows)) == "fresh"
        assert again.read("manifest").count() == 30


@pytest.mark.parametrize("seed", [1])
def test_random_changes_equal_a_build(spark, monkeypatch, seed):
    monkeypatch.setattr(stored, "PER_RANGE", 4)
    rng, rows = random.Random(seed), corpus(40, seed)
    words = "alpha beta gamma new words here".split()
    index, store = incremental.Index(spark, None, ("title", "content")), incremental.Graph(spark, None, "graph")
    memory = {"m0": ("m0", ["One"])}
    for step in range(3):
        if step:
            for i in rng.sample(sorted(rows), 3):
                del rows[i]
            for i in rng.sample(sorted(rows), 3):
                rows[i] = doc(i, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=8)), ["two", "fresh"], ["src/new.md"], actor=rng.choice(["bob", "cat"]))
            rows[100 + step] = doc(100 + step, "added", "alpha beta", ["only here"])
            memory[f"m{step}"] = (f"m{step}", ["fresh"])
            memory.pop(f"m{step - 2}", None)
        docs = frame(spark, rows)
        remembered = spark.createDataFrame(list(memory.values()), "id string, tags array<string>")
        index.ensure(docs)
        store.update(docs, tables.supersedes(docs), remembered)
    whole, plain = incremental.Index(spark, None, ("title", "content")), incremental.Graph(spark, None, "graph")
    whole.build(docs)
    plain.build(docs, tables.supersedes(docs), remembered)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    for name in ("postings", "lengths", "manifest", "shown"):
        assert same(index.read(name), whole.read(name)), name
    assert (index.state["count"], index.state["words"]) == (whole.state["count"], whole.state["words"])
    assert same(store.read("edges"), plain.read("edges"))
    assert same(store.read("nodes").select("id", "kind", "ref", "data"), plain.read("nodes"))
    refs = lambda g: g._shared().where("refs > 0").select("id", "refs")
    assert same(refs(store), refs(plain))
    if index.state["bits"] == whole.state["bits"]:
        assert index.state["root"] == whole.state["root"] and same(index._tree(), whole._tree())


def test_what_is_written_grows_with_the_change(spark, tmp_path):
    rows = corpus(3000)
    base = f"{tmp_path}/index"
    index = incremental.Index(spark, f"file://{base}")
    index.build(frame(spark, rows))
    built = size_of(base)
    for k in range(2):
        rows[k] = doc(k, "changed", "one other text")
        before = size_of(base)
        index.update(frame(spark, rows))
        assert size_of(base) - before < built / 8
    assert len(index.state["segments"]) == 3 and index.read("manifest").count() == 3000
    for k in range(2, 5):  # single segments are merged, the large one stays
        index.upsert(frame(spark, {k: doc(k, "changed", "one other text")}))
    assert "1" in index.state["segments"] and len(index.state["segments"]) <= 3
    assert sorted(r["id"] for r in index.search("other", NOW, None).collect()) == [0, 1, 2, 3, 4]
    index.upsert(frame(spark, {}), spark.createDataFrame([(0,), (9999,)], "id long"))
    assert sorted(r["id"] for r in index.search("other", NOW, None).collect()) == [1, 2, 3, 4] and index.state["count"] == 2999


def test_labels_and_counts_of_shared_nodes(spark):
    none = spark.createDataFrame([], "newer long, older long")
    rows = {1: doc(1, "First Title", "c", ["Team A"], ["a.md"]), 2: doc(2, "first title", "c", ["team a"], ["a.md"])}
    store = incremental.Graph(spark, None, "graph")
    store.build(frame(spark, rows), none)
    node = lambda i: {r["id"]: r for r in store.read("nodes").collect()}.get(i)
    assert (node("tag:team a")["label"], node("tag:team a")["ref"]) == ("Team A", "team a")
    assert node("footprint:1")["data"]["actor"] == "ann" and node("footprint:1")["ref"] == "1"
    rows[1] = doc(1, "First Title", "c", ["other"], ["a.md"])
    store.update(frame(spark, rows), none)
    assert node("tag:team a")["label"] == "Team A" and node("tag:other")["label"] == "other"  # the first label stays while someone leads there
    rows[2] = doc(2, "first title", "c", [], ["a.md"])
    store.update(frame(spark, rows), none)
    assert node("tag:team a") is None and store._shared().where("id = 'file:a.md'").first()["refs"] == 2
    del rows[1], rows[2]
    rows[3] = doc(3, "", "c", actor="")
    store.update(frame(spark, rows), none)
    assert [r["id"] for r in store.read("nodes").collect()] == ["footprint:3"]


def test_trees_differ_where_rows_do(spark):
    rows = spark.range(5000).select(F.col("id").alias("key"), F.sha1(F.col("id").cast("string")).alias("hash"), stored.range_of(F.col("id"), 10).alias("range"))
    other = rows.withColumn("hash", F.when(F.col("key").isin(17, 4000), F.lit("x")).otherwise(F.col("hash"))).where("key <> 99")
    want = {r["range"] for r in rows.where("key in (17, 99, 4000)").collect()}
    got = stored.differing(stored.hash_tree(rows, 10), stored.hash_tree(other, 10), 10)
    assert {r["range"] for r in got.collect()} == want
    assert stored.differing(stored.hash_tree(rows, 10), stored.hash_tree(rows, 10), 10).count() == 0
    assert graph.SHARED[-1] == "AUTHORED_BY"
