"""Personal data: four kinds found by pattern, and identifiers that bootstrapped
contexts give away. DataFrame operations only.

Seeds are the spans of the four kinds, with white space or without, and words
in the shape of a secret key, which are no spans by themselves. The two words
before an instance make one lexical pattern and the two behind it another,
whatever those words are; patterns, seeds and the other identifier-like words
beside them form a graph. In each round a pattern scores the mean score of its
distinct instances, and an instance that is no seed scores by the patterns
that bring it up, until the accepted patterns stay as they are. Patterns of
enough seeds and a high score point out identifiers that no kind describes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

KINDS = ("email", "ip", "card", "phone")
LEARNT = "learnt"
# The four kinds. The groups are possessive and a match starts at
# the start of a run or where the last match ended, which changes no match of
# the plain patterns and keeps long runs from being tried again at each character.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A word with a digit or an at sign.
LIKE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: The shape of a secret key: letters and digits mixed, without the marks around them.
SECRET = r"(?=(?:[^0-9]*[0-9]){6})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9+/_=-]{20,}"
#: Rounds after which scoring ends even if patterns still come and go.
ROUNDS = 12
#: Identifier-like words have as many characters at least, without the marks around them.
LEAST = 5
NOTHING = "cast(array() as array<struct<start:int,end:int,value:string>>)"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digit = lambda i: F.substring(digits, n - i, F.lit(1)).try_cast("int")
        doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.coalesce(F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)), F.lit(0)))
        return n.between(16, 19) & F.when(n.between(16, 19), total % 10 == 0).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _running(values: Column, join: Callable[[Column, Column], Column], step: int = 256) -> Column:
    """Sums or maxima of whole numbers up to each place of an array that isn't
    empty, by chunks: appending one by one to a long array copies it each time."""
    from_zero = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(join(F.element_at(done, -1), x))))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / step).cast("int")), lambda k: from_zero(F.slice(values, k * step + 1, step)))
    before = from_zero(F.transform(chunks, lambda c: F.element_at(c, -1)))
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), F.slice(before, 1, F.size(before) - 1).alias("before")), lambda x: F.transform(F.slice(x["chunk"], 2, F.size(x["chunk"]) - 1), lambda v: join(x["before"], v))))


def _placed(found: Column, gaps: Column) -> Column:
    """Matches, at least one, with start and end in code points, from them and the text between them."""
    sizes = F.transform(found, lambda x, i: F.length(x) + F.length(F.get(gaps, i)))
    ends = _running(sizes, lambda a, b: a + b)
    return F.transform(F.arrays_zip(found.alias("value"), ends.alias("end")), lambda x: F.struct((x["end"] - F.length(x["value"])).cast("int").alias("start"), x["end"].cast("int").alias("end"), x["value"].alias("value")))


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")


def _plain(word: Column) -> Column:
    """In lower case with digits as 0."""
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


def _last_two(words: Column) -> Column:
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), 2)


def _outer(gap: Column, end: bool) -> Column:
    """The first or the last two words of a gap, fewer if it has fewer."""
    turned = F.reverse(F.lower(gap)) if end else F.lower(gap)
    two = [F.regexp_extract(turned, r"^\s*+(\S++)?(?:\s++(\S++))?", k) for k in (1, 2)]
    two = [F.reverse(two[1]), F.reverse(two[0])] if end else two
    return F.filter(F.array(*two), lambda w: w != "")


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def base(docs: DataFrame) -> DataFrame:
    """docs with spans, an array of (kind, start, end) of the four kinds, seeds,
    their (start, end, value), and like, an array of (start, end, word, before,
    last, after, next) of identifier-like words: before and after are the two
    words on either side, last and next the ones just beside. In texts with
    spans, like has all words with a digit or an at sign."""
    out = docs.withColumn("p_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("p_any", F.col("p_text").rlike("[0-9@]"))
    for kind, pattern in [*PATTERNS.items(), ("like", LIKE)]:
        there = F.col("p_any") & F.col("p_text").contains(NEEDS.get(kind, ""))
        out = out.withColumn(f"p_{kind}", F.when(there, F.regexp_extract_all("p_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        out = out.withColumn(f"g_{kind}", F.when(F.size(f"p_{kind}") > 0, F.split("p_text", pattern, -1)))
    for kind in (*KINDS, "like"):
        placed = F.when(F.size(f"p_{kind}") > 0, _placed(F.col(f"p_{kind}"), F.col(f"g_{kind}"))).otherwise(F.expr(NOTHING))
        out = out.withColumn(f"s_{kind}", placed)

    good = lambda kind: F.filter(f"s_{kind}", lambda x: _valid(kind, x["value"]))
    for kind in KINDS:
        out = out.withColumn(f"v_{kind}", good(kind))
    spans = F.concat(*(F.transform(f"v_{kind}", _of(kind)) for kind in KINDS))
    seeds = F.concat(*(F.col(f"v_{kind}") for kind in KINDS))
    out = out.withColumn("e_like", F.transform("g_like", lambda gap: _outer(gap, True))).withColumn("f_like", F.transform("g_like", lambda gap: _outer(gap, False)))
    out = out.withColumn("n_like", F.transform("p_like", _plain))
    # a word just beside may itself be identifier-like
    some = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    one = lambda i: F.when((i >= 0) & (i < F.size("n_like")), F.array(F.get("n_like", i)))
    out = out.withColumn("b_like", F.transform("p_like", lambda _, i: _last_two(F.concat(some(one(i - 2)), some(F.get("e_like", i - 1)), some(one(i - 1)), some(F.get("e_like", i))))))
    out = out.withColumn("a_like", F.transform("p_like", lambda _, i: F.slice(F.concat(some(F.get("f_like", i + 1)), some(one(i + 1)), some(F.get("f_like", i + 2)), some(one(i + 2))), 1, 2)))

    def placed(x: Column, i: Column) -> Column:
        two, behind = F.get("b_like", i), F.get("a_like", i)
        both = lambda words: F.when(F.size(words) == 2, F.array_join(words, " "))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("word"), both(two).alias("before"), F.get(two, F.size(two) - 1).alias("last"), both(behind).alias("after"), F.get(behind, F.lit(0)).alias("next"))

    out = out.withColumn("spans", spans).withColumn("seeds", seeds).withColumn("like", F.transform("s_like", placed))
    out = out.withColumn("like", F.filter("like", lambda x: (F.size("spans") > 0) | ((x["before"].isNotNull() | x["after"].isNotNull()) & (F.length(_bare(x["word"])) >= LEAST))))
    return out.select(*[c for c in docs.columns if c not in ("spans", "seeds", "like")], "spans", "seeds", "like")


def instances(rows: DataFrame) -> DataFrame:
    """Rows (p_row, start, end, value, before, after, base, seed): the spans,
    and the identifier-like words that share no character with one. Of spans
    that overlap the first one is an instance.

    A span begins and ends in words with a digit or an at sign, so the words
    beside those are the span's; what such a word has besides the span counts
    as a word if it has a letter or digit."""
    likes = rows.select("p_row", (F.size("spans") > 0).alias("near"), F.inline("like"))
    words = likes.select("p_row", "start", "end", F.col("end").alias("at"), F.struct("start", "word", "before", "last", "after", "next").alias("word"), F.lit(None).cast("string").alias("value"), "near")
    found = rows.select("p_row", F.inline("seeds")).select("p_row", "start", "end", F.col("start").alias("at"), F.lit(None).cast(words.schema["word"].dataType).alias("word"), "value", F.lit(True).alias("near"))
    both = words.where("near").unionByName(found)
    text = Window.partitionBy("p_row")  # bounded by what one text holds
    none = Window.unboundedPreceding
    is_span = F.col("value").isNotNull()
    both = both.withColumn("holds", F.last("word", ignorenulls=True).over(text.orderBy("start", is_span).rowsBetween(none, 0)))
    both = both.withColumn("ends", F.last("word", ignorenulls=True).over(text.orderBy(F.when(is_span, F.col("end") - 1).otherwise(F.col("start")), is_span).rowsBetween(none, 0)))
    # words come by their ends here, so all spans that begin before the end are met
    reach = F.max(F.when(is_span, F.col("end"))).over(text.orderBy("at", F.col("end").desc(), "value").rowsBetween(none, -1))
    both = both.withColumn("reach", reach).where(F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)))
    glued = F.substring(F.col("holds.word"), F.lit(1), F.col("start") - F.col("holds.start"))
    rest = F.substring(F.col("ends.word"), F.col("end") - F.col("ends.start") + 1, F.lit(2147483647))
    before = F.when(~glued.rlike("[A-Za-z0-9]"), F.col("holds.before")).otherwise(F.when(F.col("holds.last").isNotNull(), F.concat_ws(" ", "holds.last", _plain(glued))))
    after = F.when(~rest.rlike("[A-Za-z0-9]"), F.col("ends.after")).otherwise(F.when(F.col("ends.next").isNotNull(), F.concat_ws(" ", _plain(rest), "ends.next")))
    spans = both.where(is_span).select("p_row", "start", "end", "value", before.alias("before"), after.alias("after"), F.lit(True).alias("base"))
    others = both.where(~is_span).select("p_row", "start", "end", "word").unionByName(words.where("not near").select("p_row", "start", "end", "word"))
    others = others.select("p_row", "start", "end", _bare(F.col("word.word")).alias("value"), F.col("word.before").alias("before"), F.col("word.after").alias("after"), F.lit(False).alias("base")).where(F.length("value") >= LEAST)
    return spans.unionByName(others).where("before is not null or after is not null").withColumn("seed", F.col("base") | F.col("value").rlike(f"^(?:{SECRET})$"))


def _beside(likes: DataFrame) -> DataFrame:
    """Rows (p_row, start, end, value, base, seed, shape, pattern): each instance with the pattern before and the one behind it."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\p{L}+", "a"), "[0-9]+", "0"), "(?:a0|0a)[a0]*", "x")
    sides = F.array(F.concat(F.lit("before "), "before"), F.concat(F.lit("after "), "after"))
    return likes.select("p_row", "start", "end", "value", "base", "seed", shape.alias("shape"), F.explode(sides).alias("pattern")).where("pattern is not null")


def patterns(beside: DataFrame, rounds: int, least: int, confidence: float) -> DataFrame:
    """Accepted patterns: (pattern, shape). beside: rows (pattern, value, seed, shape)."""
    graph = save(beside.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.first("shape").alias("shape")), "graph")
    values = graph.groupBy("value").agg(F.max("seed").alias("seed"))
    scores = values.select("value", F.col("seed").cast("double").alias("score"))
    before = None
    for _ in range(rounds):
        rated = graph.join(scores, "value").groupBy("pattern").agg(F.avg("score").alias("mean"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        accepted = save(rated.where((F.col("seeds") >= least) & (F.col("mean") >= confidence)), "patterns")
        now = accepted.agg(F.count("*"), F.sum(F.xxhash64("pattern").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        doubt = graph.join(accepted, "pattern").groupBy("value").agg(F.sum(F.log(1.0001 - F.col("mean"))).alias("doubt"))
        scores = values.join(doubt, "value", "left").select("value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce(1 - F.exp("doubt"), F.lit(0.0))).alias("score"))
        scores = save(scores, "scores")
    # a pattern brings up words of shapes that several of its instances have
    return graph.join(accepted.select("pattern"), "pattern").groupBy("pattern", "shape").agg(F.count("*").alias("k")).where(F.col("k") >= 2).select("pattern", "shape")


def find(docs: DataFrame, rounds: int = ROUNDS, least: int = 5, confidence: float = 0.8) -> DataFrame:
    """The columns of docs and spans: an array of (kind, start, end) in code
    points, ordered by kind (email, ip, card, phone, learnt) and start.

    Learnt spans don't overlap those of the four kinds. A pattern is taken
    after at least `least` different seeds and with a score of at least
    `confidence`, over all texts; rounds end when the accepted patterns stay,
    and after `rounds` in any case. A null text is an empty one, an empty table
    gives an empty one, very long texts are searched whole; repeated rows and
    null doc_ids stay; a column named spans is replaced."""
    docs = docs.drop("spans", "seeds", "like", "p_row")
    rows = save(base(docs).withColumn("p_row", F.monotonically_increasing_id()), "spans")
    beside = save(_beside(instances(rows)), "instances")
    accepted = patterns(beside, rounds, least, confidence)
    new = beside.where("not base").join(accepted, ["pattern", "shape"]).select("p_row", "start", "end").distinct()
    # at most as many as the row's own identifier-like words
    new = new.groupBy("p_row").agg(F.array_sort(F.collect_list(F.struct(F.lit(LEARNT).alias("kind"), "start", "end"))).alias("new"))
    out = rows.drop("seeds", "like").join(new, "p_row", "left")
    return out.withColumn("spans", F.when(F.col("new").isNull(), F.col("spans")).otherwise(F.concat("spans", "new"))).drop("new", "p_row")


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; spans
    that overlap become one, under the first one's kind. Null, empty and other
    texts without spans stay, very long ones are redacted whole, repeated rows
    each for itself; an empty table stays empty."""
    found = find(docs, **options)
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    some = F.size("spans") > 0
    found = found.withColumn("p_spans", ordered).withColumn("p_ends", F.when(some, _running(F.transform("p_spans", lambda x: x["end"]), F.greatest)))

    def piece(x: Column, i: Column) -> Column:
        at = F.coalesce(F.get("p_ends", i - 1), F.lit(0))
        return F.when(x["start"] >= at, F.concat(F.substring(F.col("text"), at + 1, x["start"] - at), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

    tail = F.substring(F.col("text"), F.element_at("p_ends", -1) + 1, F.lit(2147483647))
    masked = F.concat(F.array_join(F.transform("p_spans", piece), ""), tail)
    return found.withColumn("text", F.when(some, masked).otherwise(F.col("text"))).select(*docs.columns)
