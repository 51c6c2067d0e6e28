"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label, and each positive
asks for the best rows of other labels within a window of scores. The windows
of an anchor overlap, so they are not searched one by one: their upper limits,
downwards, split the scores into disjoint slots, and a row of another label
falls into one slot. Each task keeps the first k of every slot of what it has
read, tasks' lists meet by anchor and slot, and merging the slots from the
lowest upwards gives, after each slot, the first k below its limit: the answer
of that window, once rows under its lower limit are off. Anchors are sent to
the tasks in blocks of a bounded size; all other rows stay where they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .vectors import rows_by_length

#: The most bytes that the anchors of a block take, and the most scores that a task holds at a time.
BLOCK_BYTES, HELD = 32 << 20, 2_000_000
LONG = 1 << 63
#: A score that nothing reaches from below, and an id that every id precedes or equals.
LOWEST, LAST = -LONG, LONG - 1
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def inner_products(a: np.ndarray, b: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers held as doubles, exactly; where
    lengths differ the missing numbers are zero. One beyond a long is an error
    among the pairs that `other` marks, and 0 elsewhere."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(n, 1) <= 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = np.where(other, whole(a).astype(object) @ whole(b).astype(object).T, 0)
    if exact.size and max(exact.max(), -exact.min()) >= LONG:
        raise ValueError("an inner product does not fit a long")
    return exact.astype(np.int64)


class First:
    """The first k entries of each of n groups, by score downwards, then by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.group, self.score, self.ident = (np.zeros(0, np.int64) for _ in range(3))
        # the last entry of a full group: what doesn't precede it can't enter
        self.last_score, self.last_ident = np.full(n, LOWEST), np.full(n, LAST)

    def open_to(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> np.ndarray:
        at = self.last_score[group]
        return (score > at) | ((score == at) & (ident < self.last_ident[group]))

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.ident, ident])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        place = np.arange(len(g)) - np.repeat(new, np.diff(np.r_[new, len(g)]))
        kept = place < self.k
        self.group, self.score, self.ident = g[kept], s[kept], i[kept]
        full = place == self.k - 1
        self.last_score[g[full]], self.last_ident[g[full]] = s[full], i[full]


def _chunks(batches: Iterator[pa.RecordBatch], anchors: list, asked: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors' numbers, ids and labels of some rows, and the scores of each
    anchor with each of another id; asked: the anchors' ids."""
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for rows, v in rows_by_length(batch.column(2)):
            v = np.floor(scale * v)
            for which, q in anchors:
                step = max(16, HELD // len(which))
                for at in range(0, len(v), step):
                    part = rows[at : at + step]
                    yield which, ids[part], labels[part], inner_products(q, v[at : at + step], asked[which, None] != ids[None, part])


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label (whole numbers); anchors are the rows for
    which `anchor` holds. A score is the integer inner product of
    floor(scale * x); higher ones come first, ties by the smaller vec_id. An
    anchor's positives are its first rows of the same label, at most
    `positives`; for each, the result has the first rows of other labels, at most `negatives`, with low * positive_score <= 100 *
    negative_score <= high * positive_score, and none if none is in the window.

    Rows whose vec_id, label or vector is null, and vectors that are empty or
    hold null or non-finite numbers, take no part. Where lengths differ, the
    missing numbers are zero. Rows that come again count again, as anchors and
    as candidates, but never for an anchor of the same vec_id. An empty table, or one without anchors, gives an empty
    result; other columns are not read. A product beyond a long is an error."""
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null")
    asked = rows.where(anchor).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    total = asked.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 16), F.lit(0))).first()[0]
    blocks = -(-total // (BLOCK_BYTES // 2))  # by hash: a block holds about half of what it may
    found = None
    for block in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == block).toArrow()
        own = _mined(rows, table, positives, negatives, low, high, scale)
        if own is not None:
            own = save(own, "mined")
            found = own if found is None else found.unionByName(own)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def _mined(rows: DataFrame, table: pa.Table, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame | None:
    """The result for the anchors of one block."""
    spark = rows.sparkSession
    by_length = [(at, np.floor(scale * v)) for at, v in rows_by_length(table["embedding"])] if table.num_rows else []
    if not by_length:
        return None
    ids, labels, n = table["vec_id"].to_numpy(), table["label"].to_numpy(), table.num_rows
    sent = spark.sparkContext.broadcast((by_length, ids, labels))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, ids, labels = sent.value
        best = First(n, positives)
        for which, own, label, score in _chunks(batches, anchors, ids, scale):
            fits = (label[None, :] == labels[which, None]) & (own[None, :] != ids[which, None])
            fits &= best.open_to(which[:, None], score, own[None, :])
            i, j = np.nonzero(fits)
            best.add(which[i], score[i, j], own[j])
        yield pa.record_batch([pa.array(best.group), pa.array(best.ident), pa.array(best.score)], ["anchor", "vec_id", "score"])

    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
    first = rows.mapInArrow(same, "anchor long, vec_id long, score long").withColumn("place", place).where(F.col("place") <= positives)
    chosen = first.orderBy("anchor", "place").toArrow()  # at most `positives` for each anchor of the block
    if not chosen.num_rows:
        return None
    # slots of an anchor: the upper limits downwards; a slot ends above the next limit or, the last, at its own lower limit
    who, where, score = (chosen[c].to_numpy() for c in ("anchor", "place", "score"))
    uppers, lowers = np.full((n, positives), LOWEST), np.full((n, positives), LAST)
    lows = np.array([-(-low * int(s) // 100) for s in score], np.int64)
    uppers[who, where - 1], lowers[who, where - 1] = [high * int(s) // 100 for s in score], lows
    limits = spark.sparkContext.broadcast((uppers, lowers))

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, ids, labels = sent.value
        uppers, lowers = limits.value
        best = First(n * positives, negatives)
        for which, own, label, score in _chunks(batches, anchors, ids, scale):
            slot = np.full(score.shape, -1, np.int64)
            for k in range(positives):
                slot += score <= uppers[which, k, None]
            i, j = np.nonzero((slot >= 0) & (label[None, :] != labels[which, None]) & (own[None, :] != ids[which, None]))
            at, s = slot[i, j], score[i, j]
            reached = s >= lowers[which[i], at]  # lower limits fall with the slots, so none of a higher slot is lower
            i, j, at, s = i[reached], j[reached], at[reached], s[reached]
            group = which[i] * positives + at
            enters = best.open_to(group, s, own[j])
            best.add(group[enters], s[enters], own[j][enters])
        yield pa.record_batch([pa.array(best.group // positives), pa.array((best.group % positives).astype(np.int32)), pa.array(best.ident), pa.array(best.score)], ["anchor", "slot", "vec_id", "score"])

    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
    slots = rows.mapInArrow(other, "anchor long, slot int, vec_id long, score long").withColumn("place", place).where(F.col("place") <= negatives)
    entry = F.struct((-F.col("score")).alias("down"), "vec_id", "slot")
    slots = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # at most positives * negatives
    # from the lowest slot upwards: after each, the first k of it and of all below
    none = F.array().cast("array<array<struct<down:bigint,vec_id:bigint,slot:int>>>")
    lowest_first = F.sequence(F.lit(positives - 1), F.lit(0))
    merged = F.aggregate(lowest_first, none, lambda below, k: F.concat(F.array(F.slice(F.array_sort(F.concat(F.filter("entries", lambda e: e["slot"] == k), F.coalesce(F.get(below, F.lit(0)), F.array().cast("array<struct<down:bigint,vec_id:bigint,slot:int>>")))), 1, negatives)), below))
    suffixes = slots.select("anchor", merged.alias("firsts"))
    wanted = spark.createDataFrame(pa.table({"anchor": who, "anchor_id": ids[who], "at": where - 1, "positive_id": chosen["vec_id"], "positive_score": score, "least": lows}))
    inside = F.filter(F.get("firsts", F.col("at").cast("int")), lambda e: -e["down"] >= F.col("least"))
    rows_of = wanted.join(suffixes, "anchor").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("n", "e"))
    return rows_of.select("anchor_id", "positive_id", (F.col("n") + 1).alias("rank"), F.col("e.vec_id").alias("negative_id"), "positive_score", (-F.col("e.down")).alias("negative_score"))
