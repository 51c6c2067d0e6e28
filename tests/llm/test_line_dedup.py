import random
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import line_dedup
from lodestone.llm.line_dedup import Cuckoo, LineIndex

SCHEMA = "doc_id long, text string, n_lines string, key int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=20, documents=3):
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(UPPER)
    order = lambda i: (i is not None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < documents or max(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    pool = [f"This is Shared line number {k} of the pool" for k in range(40)] + ["short", "", "ä" * 20, "ä" * 19, "É" * 25, "é" * 25, "nineteen characters", "exactly twenty chars"]
    rows = []
    for i in range(n):
        lines = [rng.choice([str.upper, str.lower, str])(f"{rng.choice(['', ' ', chr(9), chr(13), chr(11)])}{rng.choice(pool)}{rng.choice(['', chr(13), '  '])}") for _ in range(rng.randint(0, 12))]
        lines += [f"A line of document {i} alone, which stays"] * rng.randint(0, 2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "x " * 40_000 + "\n" + pool[0]), (None, pool[1] + "\n" + pool[2]), (None, pool[2]), (-4, pool[3]), (7, pool[4] + "\nrow with the id of another\n" + pool[5])]
    return rows + [rows[3]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 5) for r in rows], SCHEMA).repartition(6)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def test_equals_brute_force(spark):
    rows = corpus()
    want = plain(rows)
    assert sum(r[2] for r in want) > 100
    for batches in (1, 2, 5):
        assert found(line_dedup.dedup(frame(spark, rows), batches=batches)) == want
    assert found(line_dedup.dedup(frame(spark, rows), least=5, documents=2)) == plain(rows, 5, 2)
    assert found(line_dedup.dedup(frame(spark, []))) == []


def test_filters_decide(spark, monkeypatch):
    """A filter that knows nothing would start each batch's counts from nothing."""
    rows = corpus(2)
    with monkeypatch.context() as m:
        m.setattr(LineIndex, "_probe", lambda self, found: found.withColumn("known", F.lit(False)))
        assert found(line_dedup.dedup(frame(spark, rows), batches=4)) != plain(rows)
        m.setattr(LineIndex, "_probe", lambda self, found: found.withColumn("known", F.lit(True)))  # wrong about new keys: the exact counts say so
        assert found(line_dedup.dedup(frame(spark, rows), batches=4)) == plain(rows)


def test_documents_leave_and_come_back(spark):
    rows = [r for r in corpus(3, 60) if r[0] != 7 or "row with" not in r[1]][:-1]
    index = LineIndex(spark, capacity=30)  # many shards, which split on the way
    index.add(frame(spark, rows[:20]))
    index.add(frame(spark, rows[20:]))
    assert index.shards > 1 and found(index.kept(frame(spark, rows))) == plain(rows)
    gone = {r[0] for r in rows[10:45]} | {None}
    index.remove(spark.createDataFrame([(i,) for i in gone] + [(99_999,)], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    assert found(index.kept(frame(spark, left))) == plain(left)
    live = {bytes(r.key) for r in index.counts().collect()}
    assert index.keys == len(live) == index.filters.agg(F.sum("n")).first()[0]
    index.add(frame(spark, [r for r in rows if r[0] in gone]))
    assert found(index.kept(frame(spark, rows))) == plain(rows)
    index.remove(spark.createDataFrame([(r[0],) for r in rows], "doc_id long"))
    assert index.keys == 0 and index.counts().collect() == [] and not np.frombuffer(b"".join(bytes(r.slots) for r in index.filters.collect()), np.uint16).any()


def test_cuckoo():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 7800, np.uint64))  # 95 % of the slots
    f = Cuckoo()
    for part in np.array_split(keys, 7):
        f.add(part)
    f = Cuckoo(*f.row())
    assert f.has(keys).all()
    assert f.has(rng.integers(0, 1 << 63, 100_000, np.uint64)).mean() < 0.001
    f.remove(keys[:4000])
    assert f.has(keys[4000:]).all() and f.has(keys[:4000]).mean() < 0.01
    f.remove(keys[4000:])
    assert not f.slots.any() and not f.overflow
    same = keys[:1] + (np.arange(12, dtype=np.uint64) << np.uint64(40))  # one print in two buckets: eight find a slot
    f.add(same)
    assert f.has(same).all() and len(f.overflow) == 4
    f.remove(same)
    assert not f.slots.any() and not f.overflow


def test_digest_of_the_kept_text(spark):
    rows = corpus(5, 30)
    got = {(r.doc_id, r.s) for r in line_dedup.dedup(frame(spark, rows)).select("doc_id", F.sha2("kept_text", 256).alias("s")).collect()}
    assert got == {(i, sha256(t.encode()).hexdigest()) for i, _, _, t in plain(rows)}
