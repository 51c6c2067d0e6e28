"""Near-duplicate embeddings by p-stable hashing for the Euclidean distance.

Vectors of length one are projected on Gaussian directions, shifted and cut
into cells of width `width`; `hashes` cells make a bucket, and `tables` tables
of buckets are kept. For the distance at cosine 0.9 one cell agrees with
probability 0.82, ten with 0.14, and at least one of 24 tables does with 0.97;
nearer pairs meet more surely. Pairs that meet are checked by exact cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_blocks, save, spread, whole_groups
from .vectors import matrix, packed, rows_by_length


def signatures(v: np.ndarray, hashes: int, tables: int, width: float, seed: int) -> np.ndarray:
    """The bucket (32 bits) of each row of unit vectors in each table."""
    rng = np.random.default_rng([seed, v.shape[1]])
    directions, shifts = rng.standard_normal((v.shape[1], hashes * tables)), rng.uniform(0, width, hashes * tables)
    mixers = rng.integers(1, 1 << 63, hashes * tables, np.uint64) | np.uint64(1)
    cells = np.floor((v @ directions + shifts) / width).astype(np.int64).view(np.uint64) * mixers
    h = cells.reshape(len(v), tables, hashes).sum(axis=2) + np.uint64(v.shape[1])
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int32)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _whole(rows: list[bytes], n: int) -> np.ndarray:
    """Rows of n numbers in single or double precision."""
    return np.stack([np.frombuffer(x, "f4" if len(x) == 4 * n else "f8").astype(float) for x in rows])


def _linked(v: np.ndarray, n: np.ndarray, sigs: np.ndarray, table: int, mine: np.ndarray, crossing: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a group: for each row the number of vectors that it links with and
    that it meets here first, and a root such that equal roots are connected."""
    near = np.empty((len(v), len(v)), bool)
    counted = np.zeros(len(v), np.int64)
    for at in range(0, len(v), 512):
        part = slice(at, at + 512)
        close = v[part] @ v.T >= cosine
        if crossing:
            close &= mine[part, None] != mine[None, :]
        else:
            close[np.arange(len(close)), np.arange(at, at + len(close))] = False
        near[part] = close
        if close.any():
            first = close.copy()
            for t in range(table):
                first &= sigs[part, t, None] != sigs[None, :, t]
            counted[part] = first @ n
    roots = np.arange(len(v))
    left = near.any(axis=1)
    for i in np.flatnonzero(left):
        if left[i]:
            front, left[i] = np.array([i]), False
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & left)
                left[front] = False
                roots[front] = i
    return counted, roots


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, hashes: int = 10, tables: int = 24, width: float = 2.0, seed: int = 11, limit: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of embeddings.

    n_links counts the other vectors (rows) with a cosine of at least
    `cosine`, component_id is the smallest vec_id that links reach, kept says
    whether that is the row's own. Vectors that are null, empty, zero or hold
    null or non-finite numbers, and those of different length, don't link.
    Equal vectors are one class while links are searched and each other's
    links in the result. A null vec_id names no component; rows that share a
    vec_id are vectors of their own with one name; an empty table gives an empty
    result; other columns are ignored. Buckets of over `limit` classes are worked off in pairs of blocks,
    and no task makes a row for each pair."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(rows[some], v[some] + 0.0) for rows, v in rows_by_length(batch.column(1)) if (some := v.any(axis=1)).any()]
            yield pa.record_batch([batch.column(0), pa.array(packed(batch.num_rows, found), pa.binary())], ["vec_id", "vec"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("vec").to_pylist()], int)
            for size in np.unique(sizes):
                for at in range(0, len(rows := np.flatnonzero(sizes == size)), 4096):
                    part = batch.take(pa.array(rows[at : at + 4096]))
                    sigs = signatures(_unit(matrix(part.column("vec"), "f8")), hashes, tables, width, seed)
                    # a key has the table and the length beside the bucket, so only vectors of one length meet
                    keys = sigs.astype(np.int64) | np.arange(tables) << 32 | np.int64(size // 8) << 40
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
                    yield pa.record_batch([*part.columns, pa.array(packed(len(sigs), [(np.arange(len(sigs)), sigs)]), pa.binary()), lists], [*part.schema.names, "sigs", "keys"])

    order = ["key", "block_a", "block_b"]

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors in single precision where that loses nothing."""
        for batch in batches:
            rows = [np.frombuffer(x, "f8") for x in batch.column("vec").to_pylist()]
            with np.errstate(over="ignore"):
                short = [s.tobytes() if (s := v.astype("f4")).astype(float).tobytes() == v.tobytes() else v.tobytes() for v in rows]
            yield pa.record_batch([batch.column("cid"), batch.column("n"), pa.array(short, pa.binary()), batch.column("sigs")], ["cid", "n", "short", "sigs"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, order):
            cids, keys, a, b, mine, n = (table[c].to_numpy() for c in ("cid", "key", "block_a", "block_b", "mine", "n"))
            vecs, own = table["short"].combine_chunks(), table["sigs"].combine_chunks()
            out = []
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cids)], strict=True):
                if end - at > 1:
                    counted, roots = _linked(_unit(_whole(vecs.slice(at, end - at).to_pylist(), int(keys[at] >> 40))), n[at:end], matrix(own.slice(at, end - at), "i4"), int(keys[at] >> 32) & 255, mine[at:end], bool(a[at] != b[at]), cosine)
                    here = cids[at:end]
                    some = (counted > 0) | (roots != np.arange(len(roots)))
                    out.append((here[some], here[roots[some]], counted[some]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["cid", "root", "links"])

    vectors = save(embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(unpack, "vec_id long, vec binary"), "vectors")
    classes = vectors.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = spread(classes).mapInArrow(signed, "vec binary, low long, n long, sigs binary, keys array<long>")
    classes = save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # buckets are counted and cut by ids alone; vectors join what is left
    keyed = classes.select("cid", F.explode("keys").alias("key"))
    groups = save(in_blocks(keyed, "key", F.col("cid"), limit), "groups")
    groups = groups.join(classes.mapInArrow(shortened, "cid long, n long, short binary, sigs binary"), "cid").repartition(*order).sortWithinPartitions(*order)
    found = save(groups.mapInArrow(verify, "cid long, root long, links long"), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("root").alias("a"), F.col("cid").alias("b"))).select(F.col("node").alias("cid"), "root")
    of = save(classes.join(links, "cid", "left").join(roots, "cid", "left").select("vec", "n", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")), "roots")
    lowest = of.groupBy("root").agg(F.min("low").alias("lowest"))
    of = of.join(lowest, "root").select("vec", (F.col("n") - 1 + F.col("links")).alias("links"), "lowest")
    alone = vectors.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = vectors.join(of, "vec").select("vec_id", F.col("links").alias("n_links"), F.col("lowest").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
