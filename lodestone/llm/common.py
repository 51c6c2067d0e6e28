"""Helpers the operators share: tables in the cluster's shared folder, groups
of sorted rows, bounded blocks of a bucket, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests in
    local mode, a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _LOCAL[0]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def discard_path(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    if "/lodestone-" in folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a saved table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard_path(df.sparkSession, folder)


_HELD: dict = {"owner": None, "what": None}


def remembered(owner: tuple, make):
    """What the owner keeps in this worker process from task to task. A worker
    outlives its operator, so the next owner takes the place of the last."""
    if _HELD["owner"] != owner:
        _HELD.update(owner=None, what=None)
        _HELD.update(owner=owner, what=make())
    return _HELD["what"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to spark.sql.shuffle.partitions tasks, for steps that make
    many rows of each; small tables are otherwise read by one or two."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def starts_of(columns: list[np.ndarray]) -> np.ndarray:
    """First row of each run of equal values."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by integer keys, tables of whole groups with each
    group's first row. Only the group that a batch breaks off waits."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        starts = starts_of([held[k].to_numpy() for k in keys])
        if len(starts) > 1:
            yield held.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            held = held.slice(starts[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0])


def in_blocks(keyed: DataFrame, key: str, ident: Column, limit: int) -> DataFrame:
    """Rows of buckets of two or more, with block_a and block_b. A bucket of n
    rows is cut by hash into ceil(n / limit) blocks, and each pair of blocks
    is one group, so a hot bucket becomes many groups of about 2 * limit rows
    and no two of its rows miss each other. `mine` is the row's own block."""
    counts = keyed.groupBy(key).agg(F.count("*").alias("bucket_rows")).where("bucket_rows > 1")
    blocks = F.ceil(F.col("bucket_rows") / F.lit(limit)).cast("int")
    return (
        keyed.join(counts, key)
        .withColumn("blocks", blocks)
        .withColumn("mine", F.pmod(F.xxhash64(ident, F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("block_a", F.least("mine", "other"))
        .withColumn("block_b", F.greatest("mine", "other"))
        .drop("bucket_rows", "blocks", "other")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, root) with
    root the smallest node that can be reached; roots themselves and nodes
    without edges are left out. Alternating large and small stars: each round
    only moves edges towards smaller nodes, so it stays a shuffle of at most
    as many rows as edges however large a component is. Minima are written
    before they are joined: a join of two plain shuffles is one whose hot keys
    Spark splits, so the edges of a star's centre don't all go to one task."""
    now = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        low = save(low.select("u", F.least("u", "low").alias("low")), "low")
        large = save(both.where("v > u").join(low, "u").select(F.col("low").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "large")
        least = save(large.groupBy("b").agg(F.min("a").alias("low")), "least")
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("low").alias("x"), F.col("a").alias("y")), F.struct(F.col("low").alias("x"), F.col("b").alias("y")))).alias("e"))
        after = save(small.select(F.least("e.x", "e.y").alias("a"), F.greatest("e.x", "e.y").alias("b")).where("a <> b").distinct(), "edges")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for gone in (now, low, large, least):
            discard(gone)
        now = after
        if found == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = found
