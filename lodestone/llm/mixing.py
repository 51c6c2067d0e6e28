"""Mixing sources to target weights by Pfair scheduling.

Each source is dealt in blocks. In the ideal mix all sources that still have
blocks are dealt at once, each at its exact weight's share of a slot a slot.
Block i of a source is released at the slot in which the ideal mix begins it
and due at the end of the slot in which the ideal mix ends it; at each slot
the released block that is due first goes next. The ideal mix itself shows
that all can be on time, and then the earliest deadline first is: every source
stays within less than one block of its share at every slot, from the first to
the last. Weights are whole numbers of any size here, so nothing is rounded."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from fractions import Fraction
from heapq import heapify, heappop, heappush
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save

NONE = "\0null"
#: Blocks up to which their slots are sent to every executor; beyond, they are joined by a shuffle.
SENT = 1 << 23


def parts_of(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole parts that sum to the period, by largest remainders, at least one each."""
    period = max(period, len(weights))
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    while (over := sum(parts.values()) - period) != 0:
        step = -1 if over > 0 else 1
        able = [s for s in parts if parts[s] + step >= 1]
        s = min(able, key=lambda s: (-step * (exact[s] - parts[s]), s))
        parts[s] += step
    return parts


def one_period(parts: dict[str, int]) -> dict[str, list[int]]:
    """Each source's slots in one period of whole parts."""
    return {s: x.tolist() for s, x in deal(parts, parts).items()}


def deal(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, array]:
    """The slot of each block of each source; the slots are 0 to the number of
    all blocks. Takes a step a block and keeps 8 bytes a block.

    With p the weights and n the blocks, the ideal mix has dealt the sum of
    min(n, p * v) by the virtual time v, and ends the x-th block of s at v = x / p[s]."""
    exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n}
    if bad := sorted(s for s, w in exact.items() if w <= 0):
        raise ValueError(f"weights must be positive: {bad[:5]}")
    scale = lcm(*(w.denominator for w in exact.values()))
    # by the virtual time at which they run out; sources that have by then are off
    order = sorted(exact, key=lambda s: (blocks[s] / exact[s], s))
    n = [blocks[s] for s in order]
    p = [int(exact[s] * scale) for s in order]
    off = [0, *accumulate(n)]
    going = [*accumulate(reversed(p))][::-1]
    phase = [0] * len(order)

    def end(s: int, x: int) -> tuple[int, int]:
        """The slot at which the ideal mix ends the x-th block of s, rounded down and up."""
        k = phase[s]
        if n[k] * p[s] < x * p[k]:
            k = phase[s] = bisect_left(range(s + 1), True, k + 1, key=lambda j: n[j] * p[s] >= x * p[j])
        whole, rest = divmod(x * going[k], p[s])
        return off[k] + whole, off[k] + whole + (rest > 0)

    slots = [array("q") for _ in order]
    release, ready = [0] * len(order), []
    for s in range(len(order)):
        release[s], due = end(s, 1)  # of the block after
        ready.append((due, s))
    heapify(ready)
    waiting: dict[int, list[tuple[int, int]]] = {}
    for t in range(off[-1]):
        for job in waiting.pop(t, ()):
            heappush(ready, job)
        due, s = heappop(ready)
        slots[s].append(t)
        dealt = len(slots[s])
        if dealt < n[s]:
            at = release[s]
            release[s], due = end(s, dealt + 1)
            if at <= t + 1:
                heappush(ready, (due, s))
            else:
                waiting.setdefault(at, []).append((due, s))
    return dict(zip(order, slots, strict=True))


def table_of(slots: dict[str, array], length: int) -> pa.Table:
    """Rows of (mix_source, mix_part, mix_slots): up to `length` blocks of a source each."""
    names = [s for s, x in slots.items() for _ in range(0, len(x), length)]
    parts = [k for x in slots.values() for k in range(-(-len(x) // length))]
    sizes = [min(length, len(x) - at) for x in slots.values() for at in range(0, len(x), length)]
    flat = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in slots.values())])
    lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.array(flat))
    return pa.table({"mix_source": pa.array(names, pa.string()), "mix_part": pa.array(parts, pa.int64()), "mix_slots": lists})


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = 16, period: int = 1024, power: float = 0.5, bucket: int = 256) -> DataFrame:
    """The columns of docs and mix_slot, mix_rank: ordered by the two, the rows
    of every source come in the proportion of its weight: within less than a
    block of it at every slot.

    weights: positive, for each source, a null source under None. Without
    them a source of n rows weighs n ** power. Rows of a source are dealt in
    blocks of `block` in an order given by a hash of their doc_id; no row is
    left out or repeated, and when a source runs out the others go on with
    their weights. Rows without doc_id are dealt like others, by their other
    columns; a text is not needed and, null, empty or very long, not read; an
    empty table gives an empty one. A source that weights doesn't name is an error. The driver
    works out the slots from the sources' counts alone, a number for each block;
    rows are never gathered. The table of slots has up to `period` blocks of a
    source in a row, which doesn't change the order."""
    docs = docs.drop("mix_slot", "mix_rank", "mix_source", "mix_bucket", "mix_n", "mix_before", "mix_part", "mix_slots")
    plain = [f.name for f in docs.schema if f.name != "doc_id" and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DatetimeType))]
    name = F.coalesce(F.col("source").cast("string"), F.lit(NONE))
    here = docs.withColumn("mix_source", name)
    counts = {r["mix_source"]: r["count"] for r in here.groupBy("mix_source").count().collect()}  # one row a source
    given = {NONE if s is None else s: w for s, w in weights.items()} if weights is not None else {s: n**power for s, n in counts.items()}
    if missing := sorted(set(counts) - set(given)):
        raise ValueError(f"no weight for {missing[:5]}")
    slots = deal({s: -(-n // block) for s, n in counts.items()}, given)
    # a row's rank in its source: ranks in buckets of a bounded size, and the rows of the buckets before
    buckets = max(1, -(-max(counts.values(), default=1) // bucket))
    here = here.withColumn("mix_bucket", F.pmod(F.xxhash64("doc_id", F.lit("bucket"), *plain), F.lit(buckets)).cast("int"))
    sizes = here.groupBy("mix_source", "mix_bucket").agg(F.count("*").alias("mix_n"))
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("mix_before", F.coalesce(F.sum("mix_n").over(before), F.lit(0))).drop("mix_n")
    within = F.row_number().over(Window.partitionBy("mix_source", "mix_bucket").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64(*plain))) - 1
    ranked = here.withColumn("mix_n", within).join(save(sizes, "mixing"), ["mix_source", "mix_bucket"]).withColumn("mix_rank", (F.col("mix_before") + F.col("mix_n")).cast("long"))
    table = docs.sparkSession.createDataFrame(table_of(slots, period), "mix_source string, mix_part long, mix_slots array<long>")
    if sum(map(len, slots.values())) <= SENT:
        table = F.broadcast(table)
    number = F.floor(F.col("mix_rank") / F.lit(block))
    placed = ranked.withColumn("mix_part", F.floor(number / F.lit(period))).join(table, ["mix_source", "mix_part"])
    return placed.withColumn("mix_slot", F.element_at("mix_slots", (F.pmod(number, F.lit(period)) + 1).cast("int"))).select(*docs.columns, "mix_slot", "mix_rank")
