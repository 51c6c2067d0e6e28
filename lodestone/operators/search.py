"""Full-text search: inverted index, BM25, filters, ranking, related files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import ranking, text
from lodestone.sources.shared import save

# Fixed values.
FILE_HIT, NEIGHBOUR_HIT, LIMIT = 10.0, 4.0, 8
#: Words that a task puts in the order of their terms at once; a longer document is taken alone.
AT_ONCE = 1 << 20


def compile_query(query: str) -> list[list[str]]:
    """Phrases of a query: words at ASCII non-word characters; one with '_' is a
    phrase of its parts. Repeated words count again; '_' alone is nothing."""
    return [p for w in re.split(r"[^A-Za-z0-9_]+", query) if (p := [x for x in w.lower().split("_") if x])]


def postings(docs: DataFrame, stem: bool = False, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """(id, pos, term) of every word of the columns, whose positions are far
    apart so that no phrase spans two. Stemming joins the stems of the distinct
    vocabulary back, so the UDF sees each word once."""
    words = None
    for k, name in enumerate(columns):
        part = docs.select("id", F.posexplode(text.tokens(_whole(docs, name))).alias("pos", "term")).withColumn("pos", F.col("pos") + F.lit(k << 32))
        words = part if words is None else words.unionByName(part)
    if not stem:
        return words
    from lodestone.functions.stem import stem as porter

    stems = words.select("term").distinct().withColumn("stemmed", porter("term"))
    return words.join(stems, "term").select("id", "pos", F.col("stemmed").alias("term"))


def _whole(docs: DataFrame, name: str) -> Column:
    return F.array_join(name, " ") if docs.schema[name].dataType.typeName() == "array" else F.col(name)


def length(docs: DataFrame, columns: tuple[str, ...] = ("content",)) -> Column:
    """The words of the columns, a long."""
    return sum((F.greatest(F.coalesce(F.size(text.tokens(_whole(docs, c))), F.lit(0)), F.lit(0)) for c in columns), F.lit(0)).cast("long")


def _inverted(stem: bool):
    """Rows (id, words of each column) as (id, term, positions), in blocks sorted by term and then as the rows came."""

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        n, flats, docs, places = rows.num_rows, [], [], []
        for k, column in enumerate(rows.columns[1:]):
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flats.append(column.flatten())
            docs.append(np.repeat(np.arange(n), sizes))
            places.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (k << 32))
        coded = pa.concat_arrays(flats).dictionary_encode()
        codes, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        if stem:
            from lodestone.functions.stem import porter

            coded = pa.array([porter(t) for t in terms.to_pylist()], pa.string()).dictionary_encode()
            codes, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], coded.dictionary
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = rank[codes] * n + np.concatenate(docs)
        at = np.argsort(key, kind="stable")
        key = key[at]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(np.concatenate(places)[at], pa.int64()))
        return pa.record_batch([rows.column(0).take(pa.array(key[first] % n)), terms.take(pa.array(order[key[first] // n])), positions], ["id", "term", "positions"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
            share = np.cumsum(sizes) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    yield block(batch.slice(a, b - a))

    return of


def packed(docs: DataFrame, stem: bool = False, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """(id, term, positions) of docs, an id once: postings() with a row for each
    document's different words. A document's words lie together, so nothing is shuffled."""
    words = docs.select("id", *[text.tokens(_whole(docs, c)).alias(f"w{k}") for k, c in enumerate(columns)])
    return words.mapInArrow(_inverted(stem), T.StructType([docs.schema["id"], T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.LongType()))]))


def unpacked(index: DataFrame) -> DataFrame:
    """(id, pos, term) of packed postings."""
    return index.select("id", F.explode("positions").alias("pos"), "term")


def term_stats(docs: DataFrame) -> DataFrame:
    """df and cf of each term: terms are counted within a document before rows are shuffled."""
    per_doc = docs.select("id", F.explode(F.array_sort(text.tokens(F.col("content")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def frequency(words: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs among words. A phrase of several words binds
    the words once, however many places are looked at."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda t: t == phrase[0]))
    n, wanted = len(phrase), F.array(*map(F.lit, phrase))

    def of(w: Column) -> Column:
        places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(places, lambda i: F.slice(w, i, F.lit(n)) == wanted))

    return F.transform(F.array(words), of)[0]


def bm25(docs: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """docs that hold some phrase, with bm25. The documents are scanned twice,
    for the corpus statistics (one row) and the scores, and never shuffled."""
    words = text.tokens(F.col("content"))
    counted = docs.withColumn("words", words)
    counted = counted.select(*docs.columns, F.size("words").alias("dl"), *[frequency(F.col("words"), p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(phrases))]).first()
    if not stats["n"]:
        return counted.withColumn("bm25", F.lit(0.0)).select(*docs.columns, "bm25")
    total = F.lit(0.0)
    for i in range(len(phrases)):
        total = total + ranking.bm25_term(F.col(f"tf{i}"), F.col("dl"), stats["n"], stats[f"df{i}"], stats["avgdl"] or 1.0)
    some = F.greatest(*[F.col(f"tf{i}") for i in range(len(phrases))], F.lit(0)) > 0
    return counted.where(some).withColumn("bm25", total).select(*docs.columns, "bm25")


def phrase_hits(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(id, phrase, words, start): where each phrase begins, and of how many words
    it is. A phrase occurs where its words follow each other; words of a
    phrase meet at the place where it would begin."""
    wanted = [(t, n, i, len(p)) for n, p in enumerate(phrases) for i, t in enumerate(p)]
    asked = F.broadcast(index.sparkSession.createDataFrame(wanted, "term string, phrase int, at int, words int"))  # the query's words
    hits = index.where(F.col("term").isin(*{w[0] for w in wanted})).join(asked, "term")
    return hits.groupBy("id", "phrase", "words", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("met")).where("met = words").drop("met")


def frequencies(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(id, phrase, tf) from packed postings, an id with a term once. A word's
    frequency is the number of its positions; where a phrase begins its words'
    positions, less their places in it, agree."""
    ones = [(p[0], n) for n, p in enumerate(phrases) if len(p) == 1]
    found = None
    if ones:
        asked = F.broadcast(index.sparkSession.createDataFrame(ones, "term string, phrase int"))  # the query's words
        found = index.where(F.col("term").isin(*{w[0] for w in ones})).join(asked, "term").select("id", "phrase", F.size("positions").cast("long").alias("tf"))
    for n, phrase in enumerate(phrases):
        if len(phrase) < 2:
            continue
        starts = None
        for k, word in enumerate(phrase):
            own = index.where(F.col("term") == word).select("id", F.transform("positions", lambda x: x - F.lit(k)).alias("own"))  # noqa: B023  called at once
            starts = own if starts is None else starts.join(own.withColumnRenamed("own", "more"), "id").select("id", F.array_intersect("own", "more").alias("own")).where(F.size("own") > 0)
        rows = starts.select("id", F.lit(n).alias("phrase"), F.size("own").cast("long").alias("tf"))
        found = rows if found is None else found.unionByName(rows)
    return found


def indexed_bm25(index: DataFrame, lengths: DataFrame, phrases: list[list[str]], totals: tuple[int, int] | None = None) -> DataFrame:
    """(id, bm25) from saved postings, packed or not: index is read for the query's
    terms alone. totals: the documents and their words, if they are known."""
    if not any(phrases):
        return lengths.select("id", F.lit(0.0).alias("bm25")).limit(0)
    tf = frequencies(index, phrases) if "positions" in index.columns else phrase_hits(index, phrases).groupBy("id", "phrase").agg(F.count("*").alias("tf"))
    n, words = totals or lengths.agg(F.count("*"), F.sum("dl")).first()
    df = {r["phrase"]: r["df"] for r in tf.groupBy("phrase").agg(F.count("*").alias("df")).collect()}  # a row a phrase
    if not df:
        return tf.select("id", F.lit(0.0).alias("bm25"))
    table = F.create_map(*[x for p, n in df.items() for x in (F.lit(p), F.lit(n))])
    one = ranking.bm25_term(F.col("tf"), F.col("dl"), n, table[F.col("phrase")], words / n)
    return tf.join(lengths.select("id", "dl"), "id").groupBy("id").agg(F.sum(one).alias("bm25"))


def asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, at, words, term) of queries (query_id, query), as
    compile_query() cuts one: phrase is its number, at the word's place in it."""
    words = F.filter(F.split("query", "[^A-Za-z0-9_]+"), lambda w: w != "")
    parts = queries.select("query_id", F.posexplode(words).alias("phrase", "word"))
    terms = F.filter(F.split(F.lower("word"), "_"), lambda t: t != "")
    return parts.withColumn("terms", terms).select("query_id", "phrase", F.size("terms").alias("words"), F.posexplode("terms").alias("at", "term"))


def many_bm25(index: DataFrame, lengths: DataFrame, asked: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """(query_id, id, bm25) of many queries (asked_words) over saved packed postings,
    which are read once for all of them.

    What queries ask is counted once for each different phrase: a document has a
    row for each phrase, not for each occurrence and query. These rows meet by
    document, and only there are the queries put to them."""
    at = F.array_sort(F.collect_list(F.struct("at", "term")))
    keyed = asked.groupBy("query_id", "phrase").agg(F.array_join(F.transform(at, lambda x: x["term"]), "_").alias("key"))
    keyed = save(keyed.groupBy("query_id", "key").agg(F.count("*").alias("times")), "keyed")
    keys = save(keyed.select("key").distinct(), "keys")
    single = keys.where(~F.col("key").contains("_"))
    tf = index.join(single, F.col("term") == F.col("key")).select("id", "key", F.size("positions").cast("long").alias("tf"))
    long = keys.where(F.col("key").contains("_")).withColumn("parts", F.split("key", "_"))
    if not long.isEmpty():
        long = save(long.select("key", F.size("parts").alias("words"), F.posexplode("parts").alias("at", "term")), "long")
        hits = unpacked(index.join(long.select("term").distinct(), "term", "left_semi")).join(long, "term")
        whole = hits.groupBy("id", "key", "words", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("met")).where("met = words")
        tf = tf.unionByName(whole.groupBy("id", "key").agg(F.count("*").alias("tf")))
    tf = save(tf, "tf")
    df = tf.groupBy("key").agg(F.count("*").alias("df"))
    put = save(keyed.join(df, "key"), "put")
    n, words = totals
    one = ranking.bm25_term(F.col("tf"), F.col("dl"), n, F.col("df"), words / max(n, 1))
    return tf.join(lengths.select("id", "dl"), "id").join(put, "key").groupBy("query_id", "id").agg(F.sum(F.col("times") * one).alias("bm25"))


def active(status: Column) -> Column:
    return status.isNull() | ~status.isin("superseded", "deprecated")


def filtered(docs: DataFrame, tags: list[str] | None, files: list[str] | None, exclude_superseded: bool) -> DataFrame:
    if exclude_superseded:
        docs = docs.where(active(F.col("status")))
    if tags:
        docs = docs.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if files:
        docs = docs.where(F.arrays_overlap("files", F.array(*map(F.lit, files))))
    return docs


def search(docs: DataFrame, query: str, now: str, limit: int | None = LIMIT, tags=None, files=None, exclude_superseded: bool = False) -> DataFrame:
    """id, title, score, status of the best matches; ties go to the smaller id."""
    phrases = compile_query(query)
    found = bm25(docs, phrases) if phrases else docs.withColumn("bm25", F.lit(0.0)).where(F.lit(False))
    return ranked(found, now, limit, tags, files, exclude_superseded)


def ranked(found: DataFrame, now: str, limit: int | None, tags=None, files=None, exclude_superseded: bool = False) -> DataFrame:
    """id, title, score, status of rows with bm25; ties go to the smaller id."""
    found = filtered(found, tags, files, exclude_superseded)
    score = ranking.score(F.col("bm25"), F.col("files"), files or [], F.col("created_at"), F.col("work_type"), F.col("status"), F.lit(now))
    found = found.select("id", "title", score.alias("score"), F.coalesce("status", F.lit("completed")).alias("status"))
    return found if limit is None else found.orderBy(F.desc("score"), "id").limit(limit)


def ranked_many(found: DataFrame, now: str, limit: int | None, tags=None, files=None, exclude_superseded: bool = False) -> DataFrame:
    """(query_id, rank, id, title, score, status): the best matches of each
    query of rows with bm25; without a limit all of them, unranked."""
    found = filtered(found, tags, files, exclude_superseded)
    score = ranking.score(F.col("bm25"), F.col("files"), files or [], F.col("created_at"), F.col("work_type"), F.col("status"), F.lit(now))
    found = found.select("query_id", "id", "title", score.alias("score"), F.coalesce("status", F.lit("completed")).alias("status"))
    return found if limit is None else first_ranks(found, limit)


def first_ranks(found: DataFrame, limit: int) -> DataFrame:
    """The best of each query (query_id, id, score) with rank from 1; ties go to the smaller id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= limit)


def related_to_file(docs: DataFrame, path: str, now: str, limit: int | None = LIMIT, tags=None, include_neighbours: bool = True, exclude_superseded: bool = False, match=None) -> DataFrame:
    """Documents that touch the file, mention its name, or touch a file of its
    directory, in this order of precedence. With match, which gives (id, bm25)
    of phrases, docs need no content."""
    stem, folder = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]), path.rpartition("/")[0]
    touching = docs.where(F.array_contains("files", path)).select("id", F.lit(1).alias("pass"), F.lit(FILE_HIT).alias("hit"), F.lit(True).alias("boosted"))
    phrases = compile_query(stem)
    passes = touching
    if phrases:
        own = ranking.score(F.col("bm25"), F.col("files"), [path], F.col("created_at"), F.col("work_type"), F.col("status"), F.lit(now))
        named = (docs.join(match(phrases), "id") if match else bm25(docs, phrases)).withColumn("own", own)
        if limit is not None:
            named = named.orderBy(F.desc("own"), "id").limit(4 * limit)
        passes = passes.union(named.select("id", F.lit(2), F.col("bm25"), ranking.files_overlap(F.col("files"), [path])))
    if include_neighbours:
        near = F.exists("files", lambda f: (f != path) & (text.directory(f) == folder))
        passes = passes.union(docs.where(near).select("id", F.lit(3), F.lit(NEIGHBOUR_HIT), F.lit(False)))
    best = passes.groupBy("id").agg(F.min_by(F.struct("pass", "hit", "boosted"), "pass").alias("x")).select("id", "x.*")
    rows = filtered(docs, tags, None, exclude_superseded).join(best, "id")
    rank = F.col("hit") * F.when(F.col("boosted"), ranking.FILE_BOOST).otherwise(1.0) * ranking.recency_boost(F.col("created_at"), F.col("work_type"), F.lit(now)) * ranking.status_penalty(F.col("status"))
    found = rows.select("id", "pass", rank.alias("score"))
    return found if limit is None else found.orderBy(F.desc("score"), "id").limit(limit)


def snippet(words: Column, terms: list[str], width: int = 12) -> Column:
    """The window of `width` words with the most different terms, the first of
    equals, a little ahead of its first hit; hits in brackets."""
    wanted = F.array(*map(F.lit, terms))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words))), lambda i: F.array_contains(wanted, F.get(words, i - 1)))
    inside = lambda i: F.size(F.array_intersect(F.slice(words, i, F.lit(width)), wanted))
    best = F.array_max(F.transform(places, lambda i: F.struct(inside(i).alias("n"), (-i).alias("at"))))
    hit = F.coalesce(-best["at"], F.lit(1))
    lead = F.when(best["n"] > 1, F.lit(0)).otherwise(F.lit(width // 2))
    start = F.greatest(F.lit(1), F.least(hit - lead, F.size(words) - width + 1))
    shown = F.transform(F.slice(words, start, F.lit(width)), lambda t: F.when(F.array_contains(wanted, t), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    return F.concat(F.when(start > 1, "… ").otherwise(""), F.array_join(shown, " "), F.when(start + width - 1 < F.size(words), " …").otherwise(""))


def snippets(docs: DataFrame, hits: DataFrame, width: int = 12) -> DataFrame:
    """(id, snippet) of docs (id, content; an id once) by the positions of
    phrases in the content (phrase_hits).

    A window of `width` words may begin at a hit or at the beginning of the
    sentence before it. It is worth 1000 for each phrase that begins in it, 1 for each
    that does so again, and 100 where a sentence begins, 120 for the first one; the first of
    equals is shown, centred on its hits unless it begins with a sentence. The text
    is the document's own, hits are in brackets, and dots stand for what is left out. Without
    a hit its first words are shown; a null content gives a null snippet.

    Positions are counted in a range frame per document, so a document
    costs its hits and not its words times its hits."""
    words = f"[\\p{{L}}\\p{{N}}\\p{{Co}}][\\p{{L}}\\p{{N}}\\p{{Co}}{text.MARKS}]*"
    whole = docs.select("id", F.regexp_extract_all("content", F.lit(words), F.lit(0)).alias("said"), F.split("content", words, -1).alias("gaps"))
    places = F.sequence(F.lit(0), F.size("said") - 1)
    begins = F.filter(places, lambda i: (i == 0) | F.get(F.col("gaps"), i).rlike(r"[.:][ \t\n\r]+\z"))
    texts = whole.select("id", F.size("said").alias("n"), F.when(F.size("said") > 0, begins).otherwise(F.array().cast("array<int>")).alias("begins"))
    near = hits.join(texts, "id").withColumn("start", F.col("start").cast("int"))
    before = F.array_max(F.filter("begins", lambda b: b <= F.col("start")))
    hit = F.struct(F.col("start").alias("at"), F.col("start").alias("hit"), F.lit(0).alias("extra"), F.lit(0).alias("kind"))
    ahead = F.struct(before.alias("at"), F.col("start").alias("hit"), F.when(before == 0, 120).otherwise(100).alias("extra"), F.lit(1).alias("kind"))
    also = F.when((F.col("n") > width) & (before < F.col("start")), F.array(ahead)).otherwise(F.array().cast(T.ArrayType(T.StructType([T.StructField(f, T.IntegerType()) for f in ("at", "hit", "extra", "kind")]))))
    asked = near.select("id", "n", F.explode(F.concat(F.array(hit), also)).alias("c")).select("id", "n", "c.*", F.lit(None).cast("int").alias("phrase"), F.lit(None).cast("int").alias("words"))
    there = near.select("id", "n", F.col("start").alias("at"), F.col("start").alias("hit"), F.lit(0).alias("extra"), F.lit(None).cast("int").alias("kind"), "phrase", "words")
    frame = Window.partitionBy("id").orderBy("at").rangeBetween(0, width - 1)
    inside = asked.unionByName(there).select(
        "id", "n", "at", "hit", "extra", "kind", F.size(F.collect_set("phrase").over(frame)).alias("different"), F.count("phrase").over(frame).alias("all"),
        F.max(F.when(F.col("phrase").isNotNull(), F.struct("hit", "phrase", "words"))).over(frame).alias("last"),
    )
    lead = (F.lit(width) - (F.col("last.hit") + F.col("last.words") - F.col("at"))) / 2
    centred = F.greatest(F.lit(0), F.least(F.col("at") - lead.cast("int"), F.col("n") - width))
    window = F.when(F.col("kind") == 0, centred).otherwise(F.col("at"))
    worth = F.struct((F.col("different") * 999 + F.col("all") + F.col("extra")).alias("worth"), -F.col("hit"), -F.col("kind"))
    best = inside.where("kind is not null").groupBy("id").agg(F.max_by(window, worth).alias("from"))
    marks = near.join(best, "id").where((F.col("start") >= F.col("from")) & (F.col("start") < F.col("from") + width))
    marks = marks.groupBy("id", "from").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("words")).alias("end"))).alias("marks"))
    rows = whole.join(marks, "id", "left").withColumn("from", F.coalesce("from", F.lit(0))).withColumn("to", F.least(F.col("from") + width, F.size("said")))

    def word(i: Column) -> Column:
        opens = F.exists("marks", lambda m: m["start"] == i) & ~F.exists("marks", lambda m: (m["start"] < i) & (m["end"] > i))
        closes = F.exists("marks", lambda m: (m["start"] <= i) & (m["end"] > i)) & ((i == F.col("to") - 1) | ~F.exists("marks", lambda m: (m["start"] <= i) & (m["end"] > i + 1)))
        return F.concat(F.when(opens, "[").otherwise(""), F.get(F.col("said"), i), F.when(closes, "]").otherwise(""), F.when(i < F.col("to") - 1, F.get(F.col("gaps"), i + 1)).otherwise(""))

    head = F.when(F.col("from") > 0, " … ").otherwise(F.get(F.col("gaps"), F.lit(0)))
    tail = F.when(F.col("from") + width < F.size("said"), " … ").otherwise(F.get(F.col("gaps"), F.size("said")))
    body = F.array_join(F.transform(F.sequence("from", F.col("to") - 1), word), "")
    return rows.select("id", F.when(F.size("said") > 0, F.concat(head, body, tail)).otherwise(F.get(F.col("gaps"), F.lit(0))).alias("snippet"))


def budget_prefix(ranked: DataFrame, cost: Column, budget: int, header: int, group: str | None = None) -> DataFrame:
    """Rows of a ranked result (rank from 1) while their running cost and the
    header's fit the budget; the first always stays. Costs are positive, so the
    first overflow is the first running sum above the budget."""
    w = Window.partitionBy(*([group] if group else [])).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = ranked.withColumn("cost", cost).withColumn("used", F.sum("cost").over(w) + header)
    return spent.where((F.col("used") <= budget) | (F.col("rank") == 1))
