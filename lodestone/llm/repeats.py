"""Removal of long repeated byte strings by a logarithmic family of sparse
suffix arrays.

A match of `span` bytes needs no suffix at every byte. In each window of `span`
bytes one suffix is sampled: the one whose first `gram` bytes hash lowest.
Equal windows sample the same suffix at the same place, so two windows are
equal only if their samples begin with the same gram. The windows that sample
one suffix follow each other; the text that they cover is its stretch.

Documents come in batches. A batch's array holds its suffixes in the order of
their grams (4 bytes and 32 hashed bits), each with a 128-bit BLAKE2b digest of
its stretch and a count. It is merge-scanned against the levels for grams that
both have and becomes a level itself; levels of equal size merge. Arrays are
bucketed by gram, so neither a scan nor a merge shuffles anything again.

Suffixes whose whole stretch occurs twice are decided by that. The others that
met a gram get a closer look, on their bytes: they are sorted by suffix and
then by what comes before, and by what comes before and then by suffix.
Neighbours of the two orders show how far a match reaches to either side. Where
the longest reach to the left and that to the right come from partners of which
none is long enough, the windows in between are compared one by one."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, discard_path, exists, save, shared_dir, starts_of

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(3).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are worked on at once; a longer text overlaps from one part to the next.
PART = 1 << 20
#: Bytes of short texts that are sampled together: numpy's calls are few, and what they work on stays in the cache.
PACK = 1 << 17
#: Suffixes that a task sends on at once.
SENT = 200_000
#: The most bits of the filter by which suffixes that met none are left out before they are shuffled. A full filter lets more through; the join that follows decides.
FILTER_BITS = 1 << 28


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes at each place, by sums of byte * BASE ** place."""
    n = len(data)
    if not hasattr(gram_hashes, "up") or len(gram_hashes.up) < n:
        gram_hashes.up, gram_hashes.down = _powers(BASE, max(n, PART)), _powers(INVERSE, max(n, PART))
    terms = _TABLE[data]
    terms *= gram_hashes.up[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    found = sums[gram:] - sums[: n - gram + 1]
    found *= gram_hashes.down[: n - gram + 1]
    return _mix(found)


def sampled(data: np.ndarray, span: int, gram: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(place, first, last, key) of each sampled suffix: the windows from first
    to last sample it, key orders it by its first 4 bytes and has 32 bits of its gram's hash.
    With bounds data is texts in a row, each from one bound to the next; no window crosses one."""
    n = len(data) - span + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    grams = gram_hashes(data, gram)
    low = grams & np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(len(grams), dtype=np.uint64)
    wide, width = 1, span - gram + 1
    while wide * 2 <= width:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < width:
        low = np.minimum(low[:n], low[width - wide :])
    first = starts_of([low])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    place = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if bounds is not None:  # the windows of one text that sample a place are those of the text that it is in
        own = text_of(place, bounds)
        first, last = np.maximum(first, bounds[own]), np.minimum(last, bounds[own + 1] - span)
        some = first <= last
        place, first, last = place[some], first[some], last[some]
    lead = sum(data[place + i].astype(np.uint64) << np.uint64(8 * (3 - i)) for i in range(4)) << np.uint64(32)
    key = (lead | grams[place] & np.uint64(0xFFFFFFFF)) ^ np.uint64(1 << 63)
    return place, first, last, key.view(np.int64)


def text_of(place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the texts in a row each place is in."""
    return np.searchsorted(bounds, place, "right") - 1


def parts(data: bytes | np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping parts of a text such that each window lies in one: a run of
    windows that a cut divides is sampled in two stretches, which is as good."""
    whole = np.frombuffer(data, np.uint8)
    step = PART - span + 1
    for at in range(0, max(1, len(whole) - span + 1), step):
        yield at, whole[at : at + PART]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts as they lie in memory, and where each text begins and the last one ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), bounds


def packs(data: np.ndarray, bounds: np.ndarray, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, at, bytes, bounds): texts in a row from that row on, of PACK bytes
    together or one text; of a text longer than PART its parts, each with the place where it begins."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        if bounds[row + 1] - bounds[row] > PART:
            for at, part in parts(data[bounds[row] : bounds[row + 1]], span):
                yield row, at, part, np.array([0, len(part)])
            row += 1
        else:
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + min(PACK, PART), "right")) - 1)
            yield row, 0, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
            row = end


def _digests(part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    data, digest = part.tobytes(), hashlib.blake2b
    return [digest(data[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _sixteens(digests: list[bytes]) -> pa.Array:
    offsets = np.arange(0, 16 * len(digests) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(digests))])


def entries(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(gram, stretch, n, batch) of the suffixes of docs (batch, text), counted within what a task holds at once."""
    names = ["gram", "stretch", "n", "batch"]

    def counted(keys: list[np.ndarray], digests: list[bytes], batches: list[np.ndarray]) -> pa.RecordBatch:
        key, batch = np.concatenate(keys), np.concatenate(batches)
        halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0], batch))
        halves, batch = halves[order], batch[order]
        first = starts_of([halves[:, 0], halves[:, 1], batch])
        n = np.diff([*first.tolist(), len(order)])
        kept = order[first]
        return pa.record_batch([pa.array(key[kept]), _sixteens([digests[i] for i in kept.tolist()]), pa.array(n, pa.int64()), pa.array(batch[first], pa.int32())], names)

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digests, batches = [], [], []
        for batch in rows:
            own, (data, bounds) = batch.column(0).to_numpy(), bytes_of(batch.column(1))
            for row, _, part, inner in packs(data, bounds, span):
                place, first, last, key = sampled(part, span, gram, inner)
                keys.append(key)
                digests += _digests(part, first, last + span)
                batches.append(own[row + text_of(place, inner)])
                if len(digests) > SENT:
                    yield counted(keys, digests, batches)
                    keys, digests, batches = [], [], []
        if digests:
            yield counted(keys, digests, batches)

    return docs.mapInArrow(of, "gram long, stretch binary, n long, batch int")


class Family:
    """Sorted arrays (gram, stretch, n) as partitions of one table, bucketed by
    gram. A run has a number and a size in batches; runs are levels until two
    of equal size merge. The table lies at `path`: a family that is opened again
    with as many buckets goes on where it was."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.name = spark, path, f"lodestone_family_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (gram BIGINT, stretch BINARY, n BIGINT, size INT, run INT) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (size, run) CLUSTERED BY (gram) SORTED BY (gram, stretch) INTO {buckets} BUCKETS LOCATION '{path}/runs'"
        )
        if exists(spark, f"{path}/runs"):
            spark.sql(f"MSCK REPAIR TABLE {self.name}")
        self.buckets = buckets
        there = spark.table(self.name).select("run", "size").distinct().collect()  # few: a logarithm of the batches
        self.levels = sorted(((r["run"], r["size"]) for r in there), key=lambda x: -x[1])

    def of(self, *runs: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("run").isin(*runs)).select("gram", "stretch", "n")

    def add(self, found: DataFrame) -> None:
        """found: rows (gram, stretch, n, batch). Each batch becomes a run; they are sorted by one shuffle.
        A suffix may have several rows in a run; counts are summed where they are asked for."""
        start = max((run for run, _ in self.levels), default=-1) + 1
        array = found.repartition(self.buckets, "gram")
        array.select("gram", "stretch", "n", F.lit(1).alias("size"), (F.col("batch") + start).alias("run")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        there = [r["run"] for r in self.spark.table(self.name).where(F.col("run") >= start).select("run").distinct().collect()]  # one row a batch
        self.next = max([start, *there]) + 1
        for run in sorted(there):
            self._admit(run)

    def _admit(self, run: int) -> None:
        own = self.of(run)
        met = own.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
        if self.levels:
            levels = self.of(*[r for r, _ in self.levels]).select("gram")
            met = met.unionByName(own.select("gram").join(levels.hint("merge"), "gram", "left_semi")).distinct()
        met.write.mode("append").parquet(f"{self.path}/met")
        size, gone = 1, []
        while self.levels and self.levels[-1][1] == size:
            old, _ = self.levels.pop()
            self.of(old, run).select("gram", "stretch", "n", F.lit(2 * size).alias("size"), F.lit(self.next).alias("run")).write.insertInto(self.name)
            gone += [(size, old), (size, run)]
            run, size, self.next = self.next, 2 * size, self.next + 1
            self.spark.catalog.refreshTable(self.name)
        self.levels.append((run, size))
        for was, old in gone:
            self.spark.sql(f"ALTER TABLE {self.name} DROP PARTITION (size = {was}, run = {old})")
            discard_path(self.spark, f"{self.path}/runs/size={was}/run={old}")

    def common(self) -> DataFrame:
        """(gram, stretch, n, lone): the suffixes that met another, and whether
        one of their gram has a stretch of its own."""
        met = self.spark.read.schema("gram long").parquet(f"{self.path}/met").distinct()
        found = self.of(*[r for r, _ in self.levels]).join(met, "gram", "left_semi").groupBy("gram", "stretch").agg(F.sum("n").alias("n"))
        return found.withColumn("lone", F.min("n").over(Window.partitionBy("gram")) == 1)

    def close(self, keep: bool = False) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        if not keep:
            discard_path(self.spark, self.path)


def _filter(grams: DataFrame) -> np.ndarray:
    """One bit for each value of the grams' low bits: at most FILTER_BITS, whatever the input."""
    n = grams.count()
    bits = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))
    low = F.col("gram").bitwiseAND(F.lit(bits - 1))
    words = grams.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bit"].to_numpy()
    return out


HIT = "no long, doc_id long, n_bytes long, sha256 string, text string, first long, last long, place long, stretch binary"


def _hits(docs: DataFrame, words: np.ndarray, span: int, gram: int) -> DataFrame:
    """A row for each text (no, doc_id, n_bytes, sha256, and the text itself if it has suffixes that
    pass the filter) and one for each of those suffixes (no, first, last, place, stretch)."""
    known = docs.sparkSession.sparkContext.broadcast(words)
    fields = [pa.field(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in HIT.split(", ")]

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(columns["no"])
        given = {name: x if isinstance(x, pa.Array) else pa.array(x) for name, x in columns.items()}
        return pa.record_batch([given.get(f.name, pa.nulls(n, f.type)) for f in fields], schema=pa.schema(fields))

    def suffixes(places: list[tuple[np.ndarray, ...]], stretches: list[bytes]) -> pa.RecordBatch:
        no, first, last, place = (np.concatenate(x) for x in zip(*places, strict=True))
        return rows_of(no=no, first=first, last=last, place=place, stretch=_sixteens(stretches))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        mask = np.int64(64 * len(words) - 1)
        start = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, bounds = bytes_of(batch.column(1))
            view, found = memoryview(data), np.zeros(batch.num_rows, bool)
            places, stretches = [], []
            for row, at, part, inner in packs(data, bounds, span):
                place, first, last, key = sampled(part, span, gram, inner)
                low = key & mask
                some = (words[low >> 6] >> (low & 63)) & 1 == 1
                place, first, last = place[some], first[some], last[some]
                own = text_of(place, inner)
                found[row + own] = True
                stretches += _digests(part, first, last + span)
                back = at - inner[own]
                places.append((start + row + own, first + back, last + back, place + back))
                if len(stretches) > SENT:
                    yield suffixes(places, stretches)
                    places, stretches = [], []
            if stretches:
                yield suffixes(places, stretches)
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            texts = pc.if_else(pa.array(found), batch.column(1), pa.scalar(None, pa.string()))
            yield rows_of(no=start + np.arange(batch.num_rows), doc_id=batch.column(0), n_bytes=np.diff(bounds), sha256=pa.array(digests, pa.string()), text=texts)
            start += batch.num_rows

    return docs.mapInArrow(of, HIT)


CONTEXT = "no long, place long, gram long, single boolean, suffix binary, before binary"


def _contexts(span: int, gram: int):
    """`span` bytes from each place, and the bytes before it in reverse, as far as a window reaches."""

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[list] = [[] for _ in range(6)]
            text, bounds = bytes_of(batch.column(1))
            for own, a, b, looks in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                data = text[a:b].tobytes()
                for x in looks:
                    p = x["place"]
                    for column, value in zip(out, (own, p, x["gram"], x["single"], data[p : p + span], data[max(0, p - span + gram) : p][::-1]), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["no", "place", "gram", "single", "suffix", "before"])

    return of


def _shared(a: list[bytes], b: list[bytes], most: int) -> np.ndarray:
    """How many first bytes the strings of a and of b have in common, row by row."""
    if not a:
        return np.zeros(0, np.int64)
    table = lambda rows: np.frombuffer(b"".join([x[:most].ljust(most, b"\0") for x in rows]), np.uint8).reshape(len(rows), most)
    differ = table(a) != table(b)
    reach = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return np.minimum(reach, [min(len(x), len(y)) for x, y in zip(a, b, strict=True)])


REACH = "no long, place long, single boolean, left int, right int"


def neighbours(contexts: DataFrame, order: list[str], span: int, gram: int, tasks: int) -> DataFrame:
    """(no, place, single, left, right): what each suffix shares with the one before and the one
    after it in the order, to the left of its gram and to the right; -1 where
    not even the gram is the same. Tasks take ranges of the order; where two
    ranges meet, their outermost rows are compared on the driver."""
    names = ["no", "place", "single", "left", "right"]
    more = ["task", "edge", "suffix", "before"]

    def pairs(suffix: list[bytes], before: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        right = _shared(suffix[:-1], suffix[1:], span) - gram
        left = _shared(before[:-1], before[1:], span - gram)
        return np.where(right < 0, -1, left), np.maximum(right, -1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            suffix, before = rows["suffix"].to_pylist(), rows["before"].to_pylist()
            left, right = pairs(suffix, before)
            id, place, single = (rows[c].to_numpy() for c in ("no", "place", "single"))
            n = len(left)
            both = [np.concatenate([x[:-1], x[1:]]) for x in (id, place, single)] + [np.concatenate([x, x]) for x in (left, right)]
            nothing = [pa.nulls(2 * n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
            yield pa.record_batch([*(pa.array(x, t) for x, t in zip(both, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()), strict=True)), *nothing], names + more)
            if held is None:
                yield edge(rows.slice(0, 1), task, 0)
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield edge(held, task, 1)

    def edge(row: pa.Table, task: int, side: int) -> pa.RecordBatch:
        columns = [row[c].combine_chunks() for c in ("no", "place", "single")] + [pa.array([-1], pa.int32())] * 2
        return pa.record_batch([*columns, pa.array([task], pa.int32()), pa.array([side], pa.int32()), row["suffix"].combine_chunks(), row["before"].combine_chunks()], names + more)

    by = [*order, "no", "place"]
    ranged = contexts.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    found = save(ranged.mapInArrow(of, f"{REACH}, task int, edge int, suffix binary, before binary"), "neighbours")
    edges = found.where("edge is not null").orderBy("task", "edge").collect()  # two rows a task
    extra = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a["task"] != b["task"]:
            left, right = pairs([bytes(a["suffix"]), bytes(b["suffix"])], [bytes(a["before"]), bytes(b["before"])])
            extra += [(x["no"], x["place"], x["single"], int(left[0]), int(right[0])) for x in (a, b)]
    return found.where("edge is null").select(*names).unionByName(contexts.sparkSession.createDataFrame(extra, REACH))


def _windows(span: int, gram: int):
    """Digests of the windows that begin from `least` to `most` bytes before a place."""

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            digests, counts, lows = [], [], []
            for suffix, before, least, most in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
                data, mid = before[::-1] + suffix, len(before)
                low, high = max(0, least, span - len(suffix)), min(most, mid)
                digests += [hashlib.blake2b(data[a : a + span], digest_size=16).digest() for a in range(mid - low, mid - high - 1, -1)]
                counts.append(max(0, high - low + 1))
                lows.append(low)
            no, place, single = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), counts) for i in range(3))
            counts = np.array(counts, np.int64)
            o = np.arange(len(digests)) - np.repeat(np.cumsum(counts) - counts - lows, counts)
            yield pa.record_batch([pa.array(no, pa.int64()), pa.array(place, pa.int64()), pa.array(single, pa.bool_()), pa.array(o.astype(np.int32)), _sixteens(digests)], ["no", "place", "single", "o", "window"])

    return of


def _closer(contexts: DataFrame, span: int, gram: int, tasks: int) -> DataFrame:
    """(no, start, end): what the windows around the single suffixes of contexts that occur elsewhere cover."""
    need = span - gram
    reach = neighbours(contexts, ["suffix", "before"], span, gram, tasks).unionByName(neighbours(contexts.withColumn("own", F.substring("suffix", 1, gram)), ["own", "before", "suffix"], span, gram, tasks))
    long = (F.col("left") >= 0) & (F.col("left") + F.col("right") >= need)
    reach = reach.where("single").groupBy("no", "place").agg(F.max("left").alias("left_most"), F.max("right").alias("right_most"), F.max(F.when(long, F.col("left"))).alias("left"), F.max(F.when(long, F.col("right"))).alias("right"))
    reach = save(reach.where(F.col("left_most") + F.col("right_most") >= need), "reach")
    done = reach.where("left is not null").select("no", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + gram + F.col("right")).alias("end"))
    # of these a longer reach to one side is known, but not with whom
    open_ = reach.where("left is null or left < left_most or right < right_most")
    least, most = F.lit(need) - F.col("right_most"), F.col("left_most")
    open_ = open_.select("no", "place", least.alias("least"), most.alias("most"))
    asked = contexts.join(open_, ["no", "place"])
    ranges = asked.groupBy("gram").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    windows = contexts.join(ranges, "gram").select("no", "place", "single", "suffix", "before", "least", "most").mapInArrow(_windows(span, gram), "no long, place long, single boolean, o int, window binary")
    windows = save(windows, "windows")
    # suffixes near each other in one text have windows in common: it is places that count
    start = F.col("place") - F.col("o")
    ends = windows.groupBy("window").agg(F.min("no").alias("n1"), F.max("no").alias("n2"), F.min(start).alias("s1"), F.max(start).alias("s2"))
    twice = ends.where("n1 < n2 or s1 < s2").select("window")
    more = windows.where("single").join(twice, "window", "left_semi").select("no", (F.col("place") - F.col("o")).alias("start"), (F.col("place") - F.col("o") + span).alias("end"))
    more = more.groupBy("no", "start").agg(F.max("end").alias("end"))
    return done.unionByName(more)


CUT = "no long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def _cut(keep: bool):
    """Texts without the bytes that lie in any of the runs."""

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            (text, bounds), runs = bytes_of(batch.column(1)), batch.column(2)
            view, counts = memoryview(text), np.diff(runs.offsets.to_numpy())
            first, end = (x.to_numpy() for x in runs.flatten().flatten())
            # all texts of the batch in one order: a text is far from the next
            far = np.repeat(np.arange(len(counts)) << 40, counts)
            order = np.argsort(first + far)
            first, end = (first + far)[order], np.maximum.accumulate((end + far)[order])
            new = np.concatenate([first[:1] >= 0, first[1:] > end[:-1]])
            begin, stop = first[new], end[np.concatenate([new[1:], new[:1]])]
            each = np.searchsorted(begin, np.arange(len(counts) + 1) << 40)
            begin, stop = begin & ((1 << 40) - 1), stop & ((1 << 40) - 1)
            removed, hashes, kept = [], [], []
            for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), each[:-1].tolist(), each[1:].tolist(), strict=True):
                pieces, at = [], a
                for x, y in zip(begin[i:j].tolist(), stop[i:j].tolist(), strict=True):
                    pieces.append(view[at : a + x])
                    at = a + y
                left = b"".join([*pieces, view[at:b]])
                removed.append(b - a - len(left))
                hashes.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep else None)
            spans = pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(stop, pa.int64())], ["start", "end"]))
            columns = [batch.column(0), pa.array(removed, pa.int64()), pa.array(np.diff(each), pa.int64()), pa.array(hashes, pa.string()), spans, pa.array(kept, pa.binary())]
            yield pa.record_batch(columns, ["no", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return of


def remove_repeats(docs: DataFrame, span: int = 200, gram: int = 64, batch_bytes: int = 32 << 20, keep: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, spans (array of start and end of the maximal runs removed) and
    kept (the bytes left where any were removed, else null; null without keep).

    Every UTF-8 byte covered by a string of `span` bytes that starts elsewhere
    too, in this document or another, is removed; strings are judged on the
    texts as they came and don't cross documents. A null text is an empty one,
    a text of fewer than `span` bytes stays; repeated rows are each other's
    copies; null doc_ids and other columns don't matter; an empty table gives
    an empty one. Very long texts are sampled in parts of PART bytes.

    The number of batches grows with the input: one more each time it doubles
    from `batch_bytes` on, so a batch is a part of the corpus that a scan of
    the levels is worth."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    batches = 1 + (total // batch_bytes).bit_length()
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    family = Family(spark, f"{shared_dir(spark)}/lodestone-family-{uuid.uuid4().hex}", tasks)
    batch = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(batches)).cast("int").alias("batch")
    family.add(entries(docs.select(batch, "text"), span, gram))
    common = save(family.common(), "common") if family.levels else None
    family.close()
    if common is None:  # no text is long enough
        none = F.lit(0).cast("long")
        return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(None).cast("binary").alias("kept"))
    hits = save(_hits(docs, _filter(common.select("gram").distinct()), span, gram), "hits")
    each = hits.where("place is not null").select("no", "first", "last", "place", "stretch")
    met = save(each.join(common, "stretch").select("no", "first", "last", "place", "gram", "stretch", "n", "lone"), "met")
    # of equal stretches one is enough for others to be compared with
    shown = met.where("n > 1 and lone").groupBy("gram", "stretch").agg(F.min(F.struct("no", "place")).alias("x")).select("x.*", "gram", F.lit(False).alias("single"))
    looks = met.where("n = 1").select("no", "place", "gram", F.lit(True).alias("single")).unionByName(shown)
    # a text has one sampled suffix for some bytes, so what is listed here is bounded by the text itself
    looks = looks.groupBy("no").agg(F.collect_list(F.struct("place", "gram", "single")).alias("looks"))
    texts = hits.where("text is not null").select("no", "text")
    contexts = save(texts.join(looks, "no").mapInArrow(_contexts(span, gram), CONTEXT), "contexts")
    whole = met.where("n > 1").select("no", F.col("first").alias("start"), (F.col("last") + span).alias("end"))
    runs = whole.unionByName(_closer(contexts, span, gram, tasks))
    runs = save(runs.groupBy("no").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "runs")
    discard(met)
    cut = save(texts.join(runs, "no").mapInArrow(_cut(keep), CUT), "cut")
    rest = hits.where("n_bytes is not null").select("no", "doc_id", "n_bytes", "sha256").join(cut, "no", "left")
    none = F.lit(0).cast("long")
    return rest.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "spans", "kept")
