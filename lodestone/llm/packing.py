"""Best-fit packing of token sequences by minimum bin slack.

All that the search needs is how many pieces there are of each length, at most
`capacity` numbers however large the corpus. It yields bin patterns and how
often each is used; every piece then finds its place from its rank among the
pieces of its length, by a binary search and without a shuffle of its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .words import coder, slices


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) for each kind of bin: pattern says how many pieces of
    each length it takes. A bin starts with the longest piece left; a bitset
    over 0..gap, whose bit t says that some pieces left sum to t, then finds
    the fullest fill of the gap. The fill is removed as often as the counts
    allow, which leaves the same choice to make until one length runs short."""
    left = {n: c for n, c in counts.items() if c > 0}
    made = []
    while left:
        first = max(left)
        pattern = {first: 1}
        gap = capacity - first
        mask = (1 << (gap + 1)) - 1
        reach, steps = 1, []
        for n in sorted((n for n in left if n <= gap), reverse=True):
            most = min(left[n] - (n == first), gap // n)
            steps.append((n, most, reach))
            for _ in range(most):
                wider = (reach | reach << n) & mask
                if wider == reach:
                    break
                reach = wider
            if reach >> gap & 1:
                break
        sum_ = reach.bit_length() - 1
        for n, most, before in reversed(steps):
            for used in range(most + 1):
                if sum_ >= used * n and before >> (sum_ - used * n) & 1:
                    sum_ -= used * n
                    if used:
                        pattern[n] = pattern.get(n, 0) + used
                    break
        times = min(left[n] // c for n, c in pattern.items())
        made.append((pattern, times))
        for n, c in pattern.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return made


def _places(made: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset of the first piece), sorted."""
    rows, taken, bins = [], {}, 0
    for pattern, times in made:
        offset = 0
        for n in sorted(pattern, reverse=True):
            rows.append((n, taken.get(n, 0), pattern[n], bins, offset))
            taken[n] = taken.get(n, 0) + pattern[n] * times
            offset += n * pattern[n]
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def tokenise(docs: DataFrame, path: str, capacity: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) of each document's ids
    followed by end_id, cut into pieces of `capacity`; with chunk (the task
    that made the row) and rank (of the piece among those of its length there)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ranks, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.uint32(end_id).tobytes()
        for batch in batches:
            ids_, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                out: list[list] = [[] for _ in range(8)]
                part = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                for doc_id, ids in zip(ids_[a:b], coder(path).ids(part), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        n = len(piece) // 4
                        for column, x in zip(out, (doc_id, k, at // 4, n, zlib.crc32(piece), chunk, ranks[n], piece), strict=True):
                            column.append(x)
                        ranks[n] += 1
                columns = [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"]
                if keep_ids:
                    flat = np.frombuffer(b"".join(out[7]), "<u4").astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(out[3])]).astype(np.int32), flat))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, rank long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    A document is its ids and end_id; only longer ones are cut. Returns one
    row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and ids if keep_ids. A null text is an empty one and so one
    token; a very long one is cut into as many pieces as it takes; null doc_ids
    stay null, repeated rows are packed each for itself, other columns are ignored, and no documents give no rows."""
    spark = docs.sparkSession
    pieces = save(tokenise(docs, path, capacity, end_id, keep_ids), "pieces")
    here = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    here = save(here.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(_places(minimum_bin_slack(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        starts = known[:, 0] << 48 | known[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            _, first, each, bins, offset = known[np.searchsorted(starts, length << 48 | rank, "right") - 1].T
            bin_, slot = np.divmod(rank - first, each)
            columns = [batch.column(c) for c in names[:5]] + [pa.array(bins + bin_), pa.array(offset + slot * length)] + [batch.column(c) for c in ["ids"] * keep_ids]
            yield pa.record_batch(columns, names + ["ids"] * keep_ids)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return pieces.join(here.drop("n"), ["chunk", "length"]).mapInArrow(place, schema)
