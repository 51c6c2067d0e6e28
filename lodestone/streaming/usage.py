"""Usage counts as a stream, and index upkeep from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.shared import folder, save

EVENTS = T.StructType().add("event_id", "long").add("ts", "timestamp").add("user_id", "long").add("event_type", "string").add("value", "double").add("props", "string")


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, op, reads); rows later than `late` are dropped on a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("op"))
    return w.agg(F.count("*").alias("reads")).select(F.col("window.start").alias("start"), "op", "reads")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, reads) of runs of events without a longer gap."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("reads"))
    return s.select("user_id", F.col("w.start").alias("start"), "reads")


def hits(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, returned_id, hits): how often a record came back in each window."""
    rows = events.withWatermark("ts", late).withColumn("returned_id", F.get_json_object("props", "$.k").cast("long")).where("returned_id is not null")
    h = rows.groupBy(F.window("ts", width).alias("w"), "returned_id").agg(F.count("*").alias("hits"))
    return h.select(F.col("w.start").alias("start"), "returned_id", "hits")


def closed(spark: SparkSession, source: str, glob: str, make, files_per_batch: int | None = None, base: str | None = None) -> tuple[DataFrame, int]:
    """Run make(stream of the event files) to the end of the files there are, in
    append mode: each window or session is written once, when the watermark
    has passed it. Returns what is closed so far, and the rows (with make's
    partial counts, of a task) that came too late and were dropped. Another run
    with the same base goes on where this one ended."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    base = base or folder(spark, "closed")
    made = make(stream.parquet(source))
    running = made.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows")
    running.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for progress in running.recentProgress for op in progress["stateOperators"])
    return spark.read.schema(made.schema).parquet(f"{base}/rows"), late


def run(spark: SparkSession, source: str, glob: str) -> DataFrame:
    """Read the event files that there are as a stream, keep the hourly counts
    in a table of the shared folder, and return the table."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(source)
    out, state = folder(spark, "usage"), folder(spark, "state")

    def keep(batch: DataFrame, number: int) -> None:
        # counts that changed, one file set a batch; a batch that is run again replaces its own
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    windowed(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema("start timestamp, op string, reads long, batch long").option("basePath", out).parquet(out)
    return kept.groupBy("start", "op").agg(F.max_by("reads", "batch").alias("reads"))


def follow(spark: SparkSession, source: str, schema: T.StructType, index, glob: str = "*.parquet", name: str = "documents"):
    """Keep an Index up to date with document files that arrive; returns the
    stream's query. The index itself is what is known of each id: a batch reads
    its own documents and what the index has of their ids, and writes those
    that read otherwise. Within a batch, of rows of one id the one that sorts
    last holds. The checkpoint lies beside the index, so a stream that starts
    again goes on, and a batch that is run again changes nothing."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    done = f"stream_{name}"

    def apply(batch: DataFrame, number: int) -> None:
        if index.state and (index.state.get(done) or 0) > number:
            return
        whole = F.struct(*[c for c in schema.fieldNames() if c != "id"])
        latest = save(batch.groupBy("id").agg(F.max(whole).alias("x")).select("id", "x.*"), "batch")
        index.upsert(latest.select(*schema.fieldNames()), **{done: number + 1})

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{index.base}/{done}").trigger(availableNow=True).start()
