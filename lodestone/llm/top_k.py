"""Exact top-k inner products by the three-phase uniform threshold.

A vector's dimensions are cut into `lists` groups; a candidate's score is the
sum of its partial scores in the groups, and each group is a list of all
candidates by partial score. Phase 1 gathers the heads of the lists, `heads`
candidates a list and query, and looks up what the other lists give those few;
the k-th best sum is a lower bound of the answer. Who beats it must reach the
bound divided by the number of lists in at least one list, so that is the
uniform cutoff. Phase 2 collects the entries that reach it and leaves out those
that could not beat the bound if each list that they missed gave the cutoff.
Phase 3 computes the whole scores of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .vectors import matrix, packed, rows_by_length

#: Query vectors that are broadcast at a time, and the most bytes that they may take.
BLOCK, BLOCK_BYTES = 16_384, 64 << 20
#: Numbers up to this size multiply and add exactly as doubles.
EXACT = 1 << 20


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; beyond a long they stop at its ends."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT and a.shape[1] <= 4096:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), which stops at the ends of a long."""
    return np.clip(np.floor(scale * v), -(2.0**62), 2.0**62).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, lists: int = 2, heads: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id,
    embedding) the k rows of vectors with the largest integer inner products
    of floor(scale * x), ties to the smaller vec_id, the row of the same
    vec_id left out. Integers and scores that a long can't hold stop at its
    ends. Vectors that are null, empty or hold null or non-finite
    numbers, and rows without vec_id, take no part; where lengths differ, the
    missing numbers are zero. Other columns are ignored. Equal vectors are
    searched once: a class is known by its k + 1 smallest ids."""
    spark = vectors.sparkSession

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = packed(batch.num_rows, ((rows, _integers(v, scale)) for rows, v in rows_by_length(batch.column(1))))
            yield pa.record_batch([batch.column(0), pa.array([x.rstrip(b"\0") if x else x for x in out], pa.binary())], ["vec_id", "vec"])

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def out():
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.list_(pa.int64()))], ["vec", "ids"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = seen.setdefault(v, [])
                ids.append(i)
                if len(ids) > 4 * k + 8:
                    ids[:] = sorted(ids)[: k + 1]
            if len(seen) > 100_000:
                yield out()
                seen.clear()
        yield out()

    def ints(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null").mapInArrow(unpack, "vec_id long, vec binary").where("vec is not null")

    classes = ints(vectors).mapInArrow(smallest, "vec binary, ids array<long>").groupBy("vec")
    # at most k + 1 ids for each task that saw the vector
    classes = classes.agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.slice(F.array_sort("ids"), 1, k + 1)))), 1, k + 1).alias("ids"))
    classes = save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    asked = save(ints(queries).join(classes.select("vec", "cid"), "vec", "left").select(F.col("vec_id").alias("query_id"), "vec", "cid"), "queries")
    asked_vecs = save(asked.select("vec").distinct().withColumn("qid", F.monotonically_increasing_id()), "asked")

    width = max((r[0] or 0 for r in (classes.agg(F.max(F.length("vec"))).first(), asked_vecs.agg(F.max(F.length("vec"))).first())), default=0)
    width = max(8, -(-width // 8) * 8)
    block = max(1, min(BLOCK, BLOCK_BYTES // width))

    def rows_of(column: pa.Array) -> np.ndarray:
        return matrix(pa.array([(x or b"").ljust(width, b"\0") for x in column.to_pylist()], pa.binary()), "<i8")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = rows_of(batch.column("a")), rows_of(batch.column("b"))
            if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT:
                score = np.einsum("ij,ij->i", a, b)
            else:
                score = np.array([int(_scores(x[None], y[None])[0, 0]) for x, y in zip(a, b, strict=True)], np.int64)
            yield pa.record_batch([batch.column("qid"), batch.column("cid"), pa.array(score)], ["qid", "cid", "score"])

    def whole_scores(pairs: DataFrame, asked: DataFrame, of: DataFrame) -> DataFrame:
        """(qid, cid, score) of pairs (qid, cid)."""
        both = pairs.join(asked.select("qid", F.col("vec").alias("a")), "qid").join(of.select("cid", F.col("vec").alias("b")), "cid")
        return both.select("qid", "cid", "a", "b").mapInArrow(resolve, "qid long, cid long, score long")

    parts = np.array_split(np.arange(width // 8), min(lists, width // 8))
    m, most = len(parts), k + 1
    found = None
    blocks = max(1, -(-asked_vecs.count() // max(1, block // 2)))
    numbered = asked_vecs.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    for (at,) in sorted(numbered.select("block").distinct().collect()):
        # a block holds about half of BLOCK query vectors
        table = numbered.where(F.col("block") == at).select("qid", "vec").toArrow()
        q = spark.sparkContext.broadcast((table["qid"].to_numpy(), rows_of(table["vec"])))

        def partial(batch: pa.RecordBatch, qv: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """cids of some candidates and their partial scores by list and query."""
            v, cid = rows_of(batch.column("vec")), batch.column("cid").to_numpy()
            step = max(16, 2_000_000 // (m * len(qv)))
            for a in range(0, len(v), step):
                yield cid[a : a + step], np.stack([_scores(qv[:, p], v[a : a + step][:, p]) for p in parts])

        def gather(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
            qid, qv = q.value
            best, who = np.zeros((m, len(qid), 0), np.int64), np.zeros((m, len(qid), 0), np.int64)
            for batch in batches:
                for cid, part in partial(batch, qv):
                    t, w = np.concatenate([best, part], axis=2), np.concatenate([who, np.broadcast_to(cid, part.shape)], axis=2)
                    top = np.argpartition(-t, min(heads, t.shape[2]) - 1, axis=2)[:, :, :heads]
                    best, who = np.take_along_axis(t, top, axis=2), np.take_along_axis(w, top, axis=2)
            n = best.shape[2]
            if n:
                yield pa.record_batch([pa.array(np.tile(np.repeat(qid, n), m)), pa.array(np.repeat(np.arange(m, dtype=np.int32), n * len(qid))), pa.array(who.ravel()), pa.array(best.ravel())], ["qid", "list", "cid", "part"])

        # phase 1: the heads of the lists, at most `heads` a task, list and query, then of all tasks
        local = classes.select("cid", "vec").mapInArrow(gather, "qid long, list int, cid long, part long")
        place = F.row_number().over(Window.partitionBy("qid", "list").orderBy(F.desc("part"), "cid"))
        seen = save(local.withColumn("n", place).where(F.col("n") <= max(heads, most)).select("qid", "cid").distinct(), "heads")
        sums = whole_scores(seen, numbered, classes)
        best = sums.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("n") == most)
        safe = {r["qid"]: r["score"] for r in best.select("qid", "score").collect()}  # one row for each query of the block
        # without k + 1 candidates there is no bound and all entries are collected
        bounds = np.array([safe.get(i, -np.inf) for i in table["qid"].to_pylist()], float)
        bounds -= 1e-9 * np.abs(np.where(np.isfinite(bounds), bounds, 0))  # for rounding beyond 53 bits
        cut = spark.sparkContext.broadcast((bounds, bounds / m))

        def entries(batches: Iterator[pa.RecordBatch], q=q, cut=cut) -> Iterator[pa.RecordBatch]:
            (qid, qv), (bounds, cutoff) = q.value, cut.value
            for batch in batches:
                for cid, part in partial(batch, qv):
                    reached = part >= cutoff[None, :, None]
                    i, j = np.nonzero(reached.any(axis=0))
                    could = np.where(reached[:, i, j], part[:, i, j].astype(float), cutoff[i]).sum(axis=0)
                    kept = ~(could < bounds[i] - 1e-9 * np.abs(could))
                    yield pa.record_batch([pa.array(qid[i[kept]]), pa.array(cid[j[kept]])], ["qid", "cid"])

        left = classes.select("cid", "vec").mapInArrow(entries, "qid long, cid long")
        found = left if found is None else found.union(left)

    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    scored = whole_scores(found, asked_vecs, classes).join(classes.select("cid", "ids"), "cid")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0]))
    best = save(scored.withColumn("n", rank).where(F.col("n") <= most).select("qid", "score", "ids"), "best")
    each = asked.join(asked_vecs, "vec").select("query_id", "qid").join(best, "qid")
    each = each.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.distinct().withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
