"""Token counts of documents: pieces are counted once per distinct pre-token,
joined to the pre-token frequencies of each document and summed; ids are never
materialised per document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .words import LONGEST_KEPT, coder, words

#: The most frequent pre-tokens, whose counts are broadcast: at most so many, of at most LONGEST_KEPT characters each. All others are joined by a shuffle.
HEAD = 1 << 18


def frequent(table: DataFrame, most: int) -> DataFrame:
    """The pre-tokens above a frequency that at most `most` of them reach, from
    a histogram of frequencies by eighths of their logarithm: under 512 rows."""
    short = table.where(F.length("word") <= LONGEST_KEPT)
    step = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    sizes = sorted(((r["step"], r["words"]) for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for at, words in sizes:
        total += words
        if total > most:
            break
        least = at
    return short.where(step >= least) if least is not None else short.limit(0)


def pre_token_table(docs: DataFrame, path: str) -> DataFrame:
    """(word, n, pieces): each distinct pre-token of all texts, how often it occurs and its number of tokens."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(words(text.as_py()))
                    if len(seen) > 300_000:
                        yield out()
                        seen.clear()
        yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(ids) for ids in coder(path).encode(batch.column(0).to_pylist())]
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int64())], ["word", "n", "pieces"])

    distinct = docs.select("text").mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return save(distinct.mapInArrow(pieces, "word string, n long, pieces long"), "pre-tokens")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row
    of docs; other columns are ignored. A null text counts as an empty one, a
    null doc_id stays null, repeated rows each have their own result, very long
    texts are counted whole, and an empty table gives an empty result. The
    counts are those of the library without begin, end or added special
    tokens; special strings inside a text count as the one token they are."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = pre_token_table(docs, path)
    head = frequent(table, HEAD).select("word", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(head["word"].to_pylist(), head["pieces"].to_pylist(), strict=True)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = known.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, sizes, counts, rest, times = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                total, w, f = 0, [], []
                for word, n in Counter(words(text)).items():
                    if (p := pieces.get(word)) is None:
                        w.append(word)
                        f.append(n)
                    else:
                        total += n * p
                rows.append(row)
                row += 1
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                counts.append(total)
                rest.append(w)
                times.append(f)
            yield pa.record_batch(
                [pa.array(rows, pa.int64()), batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                ["row", "doc_id", "n_bytes", "n_head", "rest", "times"],
            )

    per_doc = save(docs.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, n_head long, rest array<string>, times array<long>"), "frequencies")
    rare = per_doc.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    summed = rare.join(table.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_rest"))
    n = (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).cast("long")
    return per_doc.drop("rest", "times").join(summed, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
