"""Language identification in two steps: the family first, then one-versus-one
linear support vector machines between the languages of that family."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import svm

# Families of languages by their codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Buckets of byte pairs and of byte triples.
BUCKETS = 2048
#: Digits, punctuation and control characters count as a space.
LETTERS = np.array([32 if b < 128 and not chr(b).isalpha() else b for b in range(256)], np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of the whole text in lower case."""
    b = LETTERS[np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)]
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    blank = b[1:-1] == 32
    pairs = np.bincount((two >> np.uint32(13)) % np.uint32(BUCKETS), minlength=BUCKETS)
    triples = np.bincount(((three >> np.uint32(11)) % np.uint32(BUCKETS))[~blank], minlength=BUCKETS)
    x = np.concatenate([pairs, triples]).astype(np.float32)
    return np.sqrt(x / max(1.0, float(x.sum())))


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


class Model:
    """Family machines (one against the rest) and pair machines within each family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs))
        self.families = sorted({FAMILY.get(code, code) for code in self.langs})
        family = np.array([FAMILY.get(code, code) for code in langs])
        self.of = {f: [code for code in self.langs if FAMILY.get(code, code) == f] for f in self.families}
        self.first = [svm.fit(x, np.where(family == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {(a, b): svm.fit(x[(langs == a) | (langs == b)], np.where(langs[(langs == a) | (langs == b)] == a, 1, -1)) for codes in self.of.values() for a, b in combinations(codes, 2)}
        machines = [*self.first, *self.pairs.values()]
        self.w = np.array([w for w, _ in machines], np.float32).reshape(len(machines), x.shape[1])
        self.b = np.array([b for _, b in machines])

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        z = (self.w @ x if len(self.w) else np.zeros(0)) + self.b
        score, family = 1.0, self.families[0]
        if self.first:
            margins = z[: len(self.families)]
            best = int(np.argmax(margins))
            family, score = self.families[best], 1 / (1 + np.exp(-4 * float(margins[best])))
        votes = {code: [0, 0.0] for code in self.of[family]}
        for (a, b), m in zip(self.pairs, z[len(self.first) :].tolist(), strict=True):
            if a in votes:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        lang = max(votes, key=lambda code: (*votes[code], code))
        if len(votes) > 1:
            score /= 1 + np.exp(-4 * votes[lang][1] / (len(votes) - 1))
        return lang, min(1.0, max(0.0, float(score)))


def fit(labelled: DataFrame, per_language: int = 1000) -> Model | None:
    """Learn from text and lang of the rows given; of each language at most
    `per_language` different texts, those of the lowest hashes, take part.
    Rows with a null in either or no letter teach nothing; None if no row does."""
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    # copies count once; a task sends on at most per_language hashes of each language
    known = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    lowest = known.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("place") <= per_language)
    lowest = lowest.groupBy("lang").agg(F.max("hash").alias("highest")).collect()  # one row a language
    if not lowest:
        return None
    highest = F.create_map(*[x for r in lowest for x in (F.lit(r["lang"]), F.lit(r["highest"]))])
    chosen = rows.where(F.xxhash64("text") <= highest[F.col("lang")]).dropDuplicates()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1)
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            yield pa.record_batch([langs.take(pa.array(keep, pa.int64())), pa.array([features(texts[i]).astype(np.float16).tobytes() for i in keep], pa.binary())], ["lang", "x"])

    got = chosen.mapInArrow(turn, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(got.num_rows, -1).astype(np.float32)
    return Model(x, np.array(got["lang"].to_pylist()))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs, from the whole text
    alone. `und` with score 0 where the text is null or has no letter, or
    nothing was learnt; very long texts are read whole, null doc_ids and
    repeated rows stay, an empty table gives an empty result, other columns are
    ignored."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.value.predict(features(t)) if known.value and has_letter(t) else ("und", 0.0) for t in (x.as_py() for x in batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
