"""Line dedup over an index that documents enter and leave.

A line's key is the line without white space at its ends, in small ASCII
letters; keys of `least` code points or more count. Keys are known by 128 bits
of BLAKE2b and dealt to shards. Two things are stored for a shard:

- a cuckoo filter, 16 bits a key, of the keys that some document holds. What
  it does not know is new and needs no look at the exact tables; what leaves
  the last document leaves the filter too, which a Bloom filter could not do.
- exact tables: references (key, document, +1 or -1), appended, and counts
  (key, number of documents, largest document), a row for each time that a
  batch touches a key, of which the last holds.

Adding documents probes the filters first. Keys that the filter may know meet
the exact counts; all others start from nothing, so that reading is for known
keys alone. Removing documents adds references of -1 and counts those keys
anew, which brings back lines that had been given up for them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, save

WHITE = b" \t\n\v\f\r"
#: Buckets of a shard's filter and slots of a bucket, the keys for which it has room, and the moves before a key goes to the overflow.
BUCKETS, SLOTS, CAPACITY, MOVES = 1 << 11, 4, 6000, 200
LINES = "doc_id long, key binary"
FILTER = "shard long, slots binary, overflow binary, n long"
TOUCHED = "key binary, n long, top long, known boolean"


def keys_of(text: str | None, least: int) -> list[bytes | None]:
    """For each line its key's digest, None if the key is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(WHITE).lower()  # of bytes: ASCII letters alone
        counts = len(key) >= least and len(key.decode()) >= least
        out.append(blake2b(key, digest_size=16).digest() if counts else None)
    return out


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints. Keys are 64-bit hashes; each is
    put in once and taken out once. What finds no place is kept whole."""

    def __init__(self, slots: bytes | None = None, overflow: bytes | None = None):
        self.slots = np.zeros((BUCKETS, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        self.overflow = {*np.frombuffer(overflow or b"", np.uint64).tolist()}

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        prints = (keys & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = keys >> np.uint64(16) & mask
        return prints, first.astype(np.int64), self._other(first, prints).astype(np.int64)

    def _other(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return place.astype(np.uint64) ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7) & np.uint64(len(self.slots) - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        found = (self.slots[a] == prints[:, None]).any(axis=1) | (self.slots[b] == prints[:, None]).any(axis=1)
        return found | np.isin(keys, np.fromiter(self.overflow, np.uint64)) if self.overflow else found

    def _settle(self, prints: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Put in what finds a free slot at its place; returns what did."""
        order = np.argsort(place, kind="stable")
        at = place[order]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.repeat(new, np.diff(np.r_[new, len(at)]))
        free = self.slots[at] == 0
        fits = rank < free.sum(axis=1)
        row, own = at[fits], rank[fits]
        column = (np.cumsum(free[fits], axis=1) == own[:, None] + 1).argmax(axis=1)
        self.slots[row, column] = prints[order][fits]
        done = np.zeros(len(place), bool)
        done[order[fits]] = True
        return done

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        prints, a, b = self._places(keys)
        left = np.flatnonzero(~self._settle(prints, a))
        if len(left):
            left = left[~self._settle(prints[left], b[left])]
        for i in left.tolist():
            self._move(int(prints[i]), int(b[i]), int(keys[i]))

    def _move(self, mark: int, place: int, key: int) -> None:
        """Push others out of their places until one finds a free slot; if none
        does, all goes back and the key is kept whole."""
        done = []
        for n in range(MOVES):
            row = self.slots[place]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return
            at = (n + mark) % SLOTS
            done.append((place, at, int(row[at])))
            mark, row[at] = int(row[at]), mark
            place = int(self._other(np.array([place]), np.array([mark], np.uint16))[0])
        for place, at, was in reversed(done):
            self.slots[place, at] = was
        self.overflow.add(key)

    def remove(self, keys: np.ndarray) -> None:
        prints, a, b = self._places(keys)
        for key, mark, *places in zip(keys.tolist(), prints.tolist(), a.tolist(), b.tolist(), strict=True):
            if key in self.overflow:
                self.overflow.remove(key)
                continue
            for place in places:
                at = np.flatnonzero(self.slots[place] == mark)
                if len(at):
                    self.slots[place, at[0]] = 0
                    break

    def row(self) -> tuple[bytes, bytes]:
        return self.slots.tobytes(), np.array(sorted(self.overflow), np.uint64).tobytes()


def _hashes(column: pa.ChunkedArray) -> np.ndarray:
    """The last 8 bytes of each key; the first ones choose the shard."""
    return np.frombuffer(b"".join(x[8:] for x in column.to_pylist()), np.uint64)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, as texts are long."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def distinct_lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, key) of the keys that count, each once a document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {*keys_of(text, least)} - {None}
                ids += [i] * len(own)
                keys += own
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, LINES)
    return rows.distinct()  # rows that share a doc_id are one document


class LineIndex:
    """Which documents hold which lines. least: code points of a key that
    counts; documents: so many that hold a key make it a repeated one."""

    def __init__(self, spark: SparkSession, least: int = 20, documents: int = 3, capacity: int = CAPACITY):
        self.spark, self.least, self.documents, self.capacity = spark, least, documents, capacity
        self.shards, self.keys = 1, 0
        self.filters = spark.createDataFrame([], FILTER)
        self.references: DataFrame | None = None
        self.touched: DataFrame | None = None
        self.batch, self.removals = 0, False

    def _shard(self):
        return F.pmod(F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long"), F.lit(self.shards)).alias("shard")

    def counts(self, of: DataFrame | None = None) -> DataFrame:
        """(key, n, top): documents that hold a key, and the largest, of the keys
        (key) of `of`, or of all; the last row of a key holds."""
        if self.touched is None:
            return self.spark.createDataFrame([], "key binary, n long, top long")
        rows = self.touched if of is None else self.touched.join(of.select("key"), "key", "left_semi")
        last = rows.groupBy("key").agg(F.max_by(F.struct("n", "top"), "batch").alias("x"))
        return last.select("key", "x.n", "x.top").where("n > 0")

    def repeated(self) -> DataFrame:
        """(key, top) of the keys that enough documents hold."""
        return self.counts().where(F.col("n") >= self.documents).select("key", "top")

    def _probe(self, found: DataFrame) -> DataFrame:
        """found (key, n, top) and whether the filters may know the key."""
        if not self.keys:
            return found.withColumn("known", F.lit(False))

        def ask(stored: pa.Table, asked: pa.Table) -> pa.Table:
            keys = asked.select(["key", "n", "top"])
            known = np.zeros(keys.num_rows, bool)
            if stored.num_rows and keys.num_rows:
                known = Cuckoo(stored["slots"][0].as_py(), stored["overflow"][0].as_py()).has(_hashes(keys["key"]))
            return keys.append_column("known", pa.array(known))

        asked = found.withColumn("shard", self._shard())
        return self.filters.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(ask, TOUCHED)

    def _change(self, added: DataFrame | None, gone: DataFrame | None) -> None:
        """Keys (key) that no document held so far enter the filters, keys that none holds any more leave them."""
        none = self.spark.createDataFrame([], "key binary")
        rows = (added if added is not None else none).select("key", F.lit(True).alias("enters")).unionByName((gone if gone is not None else none).select("key", F.lit(False).alias("enters")))
        rows = save(rows, "entering")
        counts = {r["enters"]: r["count"] for r in rows.groupBy("enters").count().collect()}  # two rows
        self.keys += counts.get(True, 0) - counts.get(False, 0)
        old = self.filters
        if self.keys > self.shards * self.capacity:  # more and smaller shards, filled anew from the exact counts
            self.shards = 1 << (-(-self.keys // self.capacity) - 1).bit_length()
            rows = self.counts().select("key", F.lit(True).alias("enters"))
            discard(old)
            old = self.spark.createDataFrame([], FILTER)

        def follow(stored: pa.Table, rows: pa.Table) -> pa.Table:
            own = Cuckoo(stored["slots"][0].as_py(), stored["overflow"][0].as_py()) if stored.num_rows else Cuckoo()
            n = stored["n"][0].as_py() if stored.num_rows else 0
            shard = (stored if stored.num_rows else rows)["shard"][0].as_py()
            if rows.num_rows:
                keys, enters = _hashes(rows["key"]), rows["enters"].to_numpy()
                own.remove(keys[~enters])
                own.add(keys[enters])
                n += 2 * int(enters.sum()) - len(enters)
            slots, overflow = own.row()
            return pa.table({"shard": [shard], "slots": pa.array([slots], pa.binary()), "overflow": pa.array([overflow], pa.binary()), "n": pa.array([n], pa.int64())})

        dealt = rows.withColumn("shard", self._shard())
        self.filters = save(old.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(follow, FILTER), "filters")
        discard(old)

    def _touch(self, rows: DataFrame) -> None:
        rows = rows.withColumn("batch", F.lit(self.batch))
        self.touched = rows if self.touched is None else self.touched.unionByName(rows)

    def add(self, docs: DataFrame) -> None:
        """Documents (doc_id, text) enter. Rows that share a doc_id are one
        document, those without one too, and it precedes all others; documents
        that are in the index already have to be removed first."""
        lines = save(distinct_lines(docs, self.least), "lines")
        found = lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        found = save(self._probe(found), "probed")
        known = found.where("known").select("key", F.col("n").alias("more"), F.col("top").alias("newer"))
        both = known.join(self.counts(known), "key", "left")
        # a filter may be wrong about a key that it takes for known: then there is no count
        met = save(both.select("key", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), F.greatest("top", "newer").alias("top"), F.col("n").isNull().alias("first")), "met")
        fresh = found.where("not known").select("key", "n", "top")
        self.batch += 1
        self._touch(save(fresh.unionByName(met.select("key", "n", "top")), "counts"))
        references = lines.withColumn("change", F.lit(1))
        self.references = references if self.references is None else self.references.unionByName(references)
        self._change(fresh.select("key").unionByName(met.where("first").select("key")), None)
        discard(found)
        discard(met)

    def remove(self, ids: DataFrame) -> None:
        """Documents (doc_id) leave; ids that are not there change nothing."""
        if self.references is None:
            return
        gone = ids.select(F.col("doc_id").cast("long").alias("id")).distinct()
        held = self.references.join(gone, self.references["doc_id"].eqNullSafe(gone["id"]), "left_semi")
        minus = save(held.groupBy("doc_id", "key").agg(F.sum("change").alias("n")).where("n > 0").select("doc_id", "key", F.lit(-1).alias("change")), "removed")
        self.references = self.references.unionByName(minus)
        keys = minus.select("key").distinct()
        left = self.references.join(keys, "key", "left_semi").groupBy("key", "doc_id").agg(F.sum("change").alias("n"))
        left = left.groupBy("key").agg(F.count_if(F.col("n") > 0).alias("n"), F.max(F.when(F.col("n") > 0, F.col("doc_id"))).alias("top"))
        left = save(left, "counts")
        self.batch, self.removals = self.batch + 1, True
        self._touch(left)
        self._change(None, left.where("n = 0").select("key"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """docs with n_lines, n_dropped and kept_text: the lines, joined, without those whose
        key is repeated and held by a larger document. docs are documents of the index."""
        repeated = save(self.repeated(), "repeated")
        lost = self.references.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("top")))
        if self.removals:
            lost = lost.groupBy("doc_id", "key").agg(F.sum("change").alias("n")).where("n > 0")
        drops = lost.groupBy("doc_id").agg(F.collect_set("key").alias("dropped_keys"))
        drops = save(drops, "drops").withColumnRenamed("doc_id", "drop_id")
        least = self.least

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _small(batches):
                rows: list[tuple] = []
                for i, text, dropped in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "dropped_keys")), strict=True):
                    lines = (text or "").split("\n")
                    if not dropped:
                        rows.append((i, len(lines), 0, text or ""))
                        continue
                    gone = {*dropped}
                    stay = [x for x, key in zip(lines, keys_of(text, least), strict=True) if key not in gone]
                    rows.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
                ids, n, gone, texts = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        # texts meet their lines by a shuffle at every size, and only the lines are held
        both = texts.join(drops.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(drops["drop_id"]), "left").select("doc_id", "text", "dropped_keys")
        return both.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept_text string")


def dedup(docs: DataFrame, least: int = 20, documents: int = 3, batches: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: a row for each row of docs
    (doc_id, text), whose lines with keys that at least `documents` documents
    hold are dropped from all but the largest of them. docs enter an index in
    `batches` parts by a hash of their doc_id, as documents that come later do.

    A null or empty text is one empty line. Very long texts are read whole. Rows
    that share a doc_id are one document, rows without one another, smaller than
    all. An empty table gives an empty result; other columns are not read."""
    index = LineIndex(docs.sparkSession, least, documents)
    for k in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return index.kept(docs)
