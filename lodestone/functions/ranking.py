"""Ranking of matches, as Column expressions with an explicit present time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RECENCY_DAYS, RECENCY_WEIGHT, FILE_BOOST = 180.0, 0.15, 1.5
STATUS = {"draft": 0.5, "completed": 1.0, "superseded": 0.15, "deprecated": 0.1}
BRIDGE = {"supersedes": 1.5, "file": 1.0, "decision": 0.9, "concept": 0.7, "tag": 0.5}
DISTANCE_DECAY = 0.5
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def recency_decay(stamp: Column, now: Column) -> Column:
    """1 now, 0 after 180 days, linear between; 0 where stamp can't be read."""
    then = F.try_to_timestamp(stamp)
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then)) / F.lit(86_400_000_000.0)
    return F.when(then.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / RECENCY_DAYS)))


def recency_boost(stamp: Column, work_type: Column, now: Column) -> Column:
    """Up to 1.15; half of that gain for architecture decisions, which age less."""
    share = F.when(work_type == "architecture_decision", RECENCY_WEIGHT / 2).otherwise(RECENCY_WEIGHT)
    return 1 + share * recency_decay(stamp, now)


def status_penalty(status: Column) -> Column:
    out = F.lit(1.0)
    for name, x in STATUS.items():
        out = F.when(status == name, x).otherwise(out)
    return out


def files_overlap(mine: Column, asked: list[str]) -> Column:
    if not asked:
        return F.lit(False)
    return F.arrays_overlap(F.transform(mine, F.lower), F.array(*[F.lit(f.lower()) for f in asked]))


def score(bm25: Column, files: Column, asked: list[str], stamp: Column, work_type: Column, status: Column, now: Column) -> Column:
    boost = F.when(files_overlap(files, asked), FILE_BOOST).otherwise(1.0)
    return bm25 * boost * recency_boost(stamp, work_type, now) * status_penalty(status)


def bm25_term(tf: Column, dl: Column, n: Column | int, df: Column | int, avgdl: Column | float) -> Column:
    """One term's share of BM25; the idf has a small floor."""
    n, df, avgdl = (x if isinstance(x, Column) else F.lit(x) for x in (n, df, avgdl))
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((n - df + 0.5) / (df + 0.5)))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))).otherwise(0.0)
