"""Manifests, freshness, and stored tables that follow their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.search import LIMIT, asked_words, compile_query, indexed_bm25, length, many_bm25, packed, phrase_hits, ranked, ranked_many, related_to_file, snippets, unpacked
from lodestone.operators.stored import DELTAS, SCHEMA_VERSION, Stored, bits_for, range_of
from lodestone.sources.shared import few, save


def manifest(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.sha1("content").alias("hash"), F.length("content").alias("size"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): added, removed, changed or same."""
    a, b = old.select("id", F.col("hash").alias("was")), new.select("id", F.col("hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return a.join(b, "id", "full_outer").select("id", change.alias("change"))


def corpus_hash(manifest_: DataFrame, width: int = 1000) -> DataFrame:
    """One row: a hash of all ids and hashes, built as a tree of groups of
    `width` ids, so no row gathers the corpus."""
    level = manifest_.select(F.col("id").alias("at"), F.concat_ws(":", "id", "hash").alias("line"))
    for _ in range(3):
        groups = level.groupBy(F.floor(F.col("at") / width).alias("at"))
        level = groups.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), ",")).alias("line"))
    top = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return level.agg(F.sha1(F.array_join(top, ",")).alias("corpus_hash"))


def freshness(version: Column, stored_count: Column, count: Column, stored_latest: Column, latest: Column) -> Column:
    """missing, stale with the reason, or fresh: schema, then count, then time."""
    return (
        F.when(version.isNull(), "missing")
        .when(version != SCHEMA_VERSION, "stale: schema")
        .when(stored_count != count, "stale: count")
        .when(latest > stored_latest, "stale: mtime")
        .otherwise("fresh")
    )


def diff_stat(old: DataFrame, new: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, change) as diff() gives it, from size and time of change first: a
    document with the same two is trusted. Only of the others the content
    (id, content) is read and hashed; one whose content is as before is the same."""
    a = old.select("id", F.col("hash").alias("was"), F.col("size").alias("size_was"), F.col("mtime").alias("mtime_was"))
    both = a.join(new.select("id", "size", "mtime"), "id", "full_outer")
    trusted = F.col("size_was").eqNullSafe(F.col("size")) & F.col("mtime_was").eqNullSafe(F.col("mtime"))
    doubtful = both.where(~trusted & F.col("was").isNotNull() & F.col("size").isNotNull()).select("id")
    hashed = contents.join(doubtful, "id", "left_semi").select("id", F.sha1("content").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("size").isNull(), "removed").when(F.col("now").isNotNull() & (F.col("now") != F.col("was")), "changed").otherwise("same")
    return both.join(hashed, "id", "left").select("id", change.alias("change"))


def built_at(docs: DataFrame, updated: Column | None = None) -> DataFrame:
    """One row: the latest time in the sources, not the clock's; the first of January 1970 without any."""
    latest = F.greatest(F.col("created_at"), updated) if updated is not None else F.col("created_at")
    return docs.agg(F.coalesce(F.max(latest), F.lit("1970-01-01T00:00:00.000Z")).alias("built_at"))


class Index(Stored):
    """Postings of columns, and documents with their length, their hash and
    what results show. docs: (id, columns, ...), ids of any one type. An update
    indexes new and changed documents alone.

    Postings are written where the documents are read, in blocks sorted by term
    (search.packed): a search reads the pages whose terms it asks for, and
    neither a build nor an update shuffles a word."""

    tables = ("docs", "postings")

    def __init__(self, spark: SparkSession, base: str | None = None, columns: tuple[str, ...] = ("content",), stem: bool = False):
        super().__init__(spark, base, "index")
        self.columns, self.stem = columns, stem

    def read(self, name: str) -> DataFrame:
        """postings (id, pos, term), packed (id, term, positions), lengths (id, dl), manifest (id, hash, size) or shown (what results show)."""
        if name == "packed":
            return self._live("postings").drop("_segment")
        if name == "postings":
            return unpacked(self.read("packed"))
        rows = self._live("docs")
        if name == "lengths":
            return rows.select("id", F.col("_dl").alias("dl"))
        if name == "manifest":
            return rows.select("id", F.col("_hash").alias("hash"), F.col("_size").alias("size"))
        return rows.select([c for c in rows.columns if not c.startswith("_")])

    @staticmethod
    def _own(docs: DataFrame) -> Column:
        return F.sha1(F.to_json(F.struct(*[c for c in docs.columns if c not in ("id", "mtime")]), {"ignoreNullFields": "false"}))

    def _hashed(self, docs: DataFrame, trust: bool = True) -> DataFrame:
        """(key, hash) of all that is indexed or shown of a document; its time
        of change (mtime) is neither. Where docs have mtime and size, a document
        whose two are as they were stored keeps its hash and isn't hashed again."""
        own = self._own(docs)
        if not (trust and self.state and {"mtime", "size"} <= {*docs.columns} and {"mtime", "size"} <= {*self._live("docs").columns}):
            return docs.select(F.col("id").alias("key"), own.alias("hash"))
        was = self._live("docs").select("id", F.col("_hash").alias("hash_was"), F.col("mtime").alias("mtime_was"), F.col("size").alias("size_was"))
        same = F.col("mtime").eqNullSafe(F.col("mtime_was")) & F.col("size").eqNullSafe(F.col("size_was"))
        return docs.join(was, "id", "left").select(F.col("id").alias("key"), F.when(same & F.col("hash_was").isNotNull(), F.col("hash_was")).otherwise(own).alias("hash"))

    def _segment(self, docs: DataFrame) -> tuple[dict[str, DataFrame], int, str]:
        """The tables' rows of docs, which have their _hash and _range; their words and latest time."""
        shown = docs.withColumn("_size", F.length("content") if "content" in docs.columns else F.lit(0)).withColumn("_dl", length(docs, self.columns))
        shown = save(shown.drop("content"), "shown")
        latest = built_at(shown).first()["built_at"] if "created_at" in docs.columns else ""
        return {"docs": shown, "postings": packed(docs, self.stem, self.columns)}, shown.agg(F.coalesce(F.sum("_dl"), F.lit(0))).first()[0], latest

    def build(self, docs: DataFrame) -> None:
        bits = bits_for(docs.count())
        segment, words, latest = self._segment(docs.withColumn("_hash", self._own(docs)).withColumn("_range", range_of(F.col("id"), bits)))
        rows = segment["docs"].select(F.col("id").alias("key"), F.col("_hash").alias("hash"), F.col("_range").alias("range"))
        self._begin(segment, rows, bits, words=words, built_at=latest)

    def _follow(self, docs: DataFrame, changes: DataFrame, built: str | None = None) -> None:
        if changes.isEmpty():
            return
        left = changes.where("change <> 'removed'").select(F.col("key").alias("id"), F.col("hash").alias("_hash"), F.col("range").alias("_range"))
        fresh = save(docs.join(few(left), "id"), "fresh")  # each text is met once
        gone = self._live("docs").join(changes.where("change <> 'added'").select(F.col("key").alias("id")), "id", "left_semi")
        less = gone.agg(F.coalesce(F.sum("_dl"), F.lit(0))).first()[0]
        segment, words, latest = self._segment(fresh)
        self._apply(changes, segment, words=self.state["words"] + words - less, built_at=built if built is not None else max(latest, self.state["built_at"]))

    def update(self, docs: DataFrame) -> None:
        """docs: the whole corpus as it is now; documents that read as before are left alone."""
        if self._anew():
            return self.build(docs)
        rows, tree, _ = self._survey(self._hashed(docs))
        self._follow(docs, self._changes(rows, tree), built_at(docs).first()["built_at"] if "created_at" in docs.columns else "")

    def upsert(self, docs: DataFrame, removed: DataFrame | None = None, **also) -> None:
        """docs: new and changed documents alone, an id once; removed: (id) of
        documents that are gone. Nothing else of the corpus is read. `also`
        is kept in the pointer."""
        if self.state is None or self.state["schema"] != SCHEMA_VERSION:
            self.build(docs)
        else:
            rows = self._rows(self._hashed(docs), self.state["bits"])
            self._follow(docs, self._asked(rows, None if removed is None else removed.select(F.col("id").alias("key"))))
        if also:
            self._point(self.version + 1, **{**self._kept(), **also})

    def _anew(self) -> bool:
        """Whether there is nothing to go on from, or ranges of the tree have grown too large."""
        return self.state is None or self.state["schema"] != SCHEMA_VERSION or bits_for(self.state["count"]) > self.state["bits"]

    def ensure(self, docs: DataFrame, trust: bool = True) -> str:
        """Build or update unless the index is fresh; returns the status before.
        Schema and count come first; where they agree the trees of hashes
        decide. Without trust, documents of the same size and time are hashed too."""
        now = docs.agg(F.count("*").alias("n"), F.coalesce(F.max("created_at"), F.lit("1970-01-01T00:00:00.000Z")).alias("latest")).first()
        status = self.status(now["n"], now["latest"])
        if self._anew():
            self.build(docs)
            return status
        rows, tree, root = self._survey(self._hashed(docs, trust))
        status = self.status(now["n"], now["latest"], root)
        if status != "fresh":
            self._follow(docs, self._changes(rows, tree), now["latest"])
        return status

    def match(self, phrases: list[list[str]]) -> DataFrame:
        """(id, bm25) of documents that hold some phrase."""
        if self.stem:
            from lodestone.functions.stem import porter

            phrases = [[porter(t) for t in p] for p in phrases]
        return indexed_bm25(self.read("packed"), self.read("lengths"), phrases, (self.state["count"], self.state["words"]))

    def search(self, query: str, now: str, limit: int | None = LIMIT, **filters) -> DataFrame:
        """id, title, score, status of the best matches, from the stored tables alone."""
        return ranked(self.read("shown").join(self.match(compile_query(query)), "id"), now, limit, **filters)

    def snippets(self, docs: DataFrame, query: str) -> DataFrame:
        """(id, snippet) of docs (id, content), few as a rule; hits come from the stored postings."""
        phrases = compile_query(query)
        if self.stem:
            from lodestone.functions.stem import porter

            phrases = [[porter(t) for t in p] for p in phrases]
        first = self.columns.index("content") << 32
        docs = save(docs.select("id", "content"), "contents")
        words = unpacked(self.read("packed").where(F.col("term").isin(*{t for p in phrases for t in p})).join(few(docs.select("id")), "id", "left_semi"))
        words = words.where(F.col("pos").between(first, first + (1 << 32) - 1)).withColumn("pos", F.col("pos") - first)
        return snippets(docs, phrase_hits(words, phrases))

    def related_to_file(self, path: str, now: str, limit: int | None = LIMIT, **options) -> DataFrame:
        """(id, pass, score): as search.related_to_file(), from the stored tables alone."""
        return related_to_file(self.read("shown"), path, now, limit, match=self.match, **options)


    def search_many(self, queries: DataFrame, now: str, limit: int | None = LIMIT, **filters) -> DataFrame:
        """(query_id, rank, id, title, score, status): the best matches of each
        query (query_id, query); the postings are read once for all."""
        asked = asked_words(queries)
        if self.stem:
            from lodestone.functions.stem import stem

            stems = asked.select("term").distinct().withColumn("stemmed", stem("term"))
            asked = asked.join(stems, "term").withColumn("term", F.col("stemmed")).drop("stemmed")
        found = many_bm25(self.read("packed"), self.read("lengths"), asked, (self.state["count"], self.state["words"]))
        return ranked_many(found.join(self.read("shown"), "id"), now, limit, **filters)


class Graph(Stored):
    """Edges with their owner, and nodes, kept up with a corpus. docs as
    graph.edges() takes them, supersedes as (newer, older), memory documents as
    (id, tags), with a title where they have one.

    A document owns its edges, its node and the nodes of its rejected options.
    The nodes that documents share have a count of the edges that lead to them:
    an update changes the counts of what its documents lead and led to, the
    first label stays, and a node goes when its count is zero."""

    key = "owner"
    tables = ("docs", "edges", "owned")

    def read(self, name: str) -> DataFrame:
        """edges (src, dst, rel, weight, owner), docs (nodes of documents: id, kind, label, ref, data) or nodes of all kinds."""
        if name == "edges":
            return self._live("edges").drop("_segment")
        docs = self._live("docs").select(F.col("owner").alias("id"), "kind", "label", "ref", "data")
        if name == "docs":
            return docs
        owned = self._live("owned").select("id", "kind", "label", "ref")
        shared = self._shared().where("refs > 0").select("id", "kind", "label", "ref")
        return docs.unionByName(owned.unionByName(shared).withColumn("data", F.lit(None).cast(docs.schema["data"].dataType)))

    def resolve(self, ids: list[str]) -> dict[str, str]:
        """The node that each id stands for: documents and memory documents by their id, nodes by their own."""
        return {r["asked"]: r["id"] for r in graph.resolve(self.read("docs"), ids).collect()}

    def _shared(self) -> DataFrame:
        """(id, kind, label, ref, refs): of a node written several times the last."""
        rows = self.spark.read.parquet(*[self._path("shared", v) for v in self.state["shared"]])
        if len(self.state["shared"]) == 1:
            return rows.drop("version")
        return rows.groupBy("id").agg(F.max_by(F.struct("kind", "label", "ref", "refs"), "version").alias("x")).select("id", "x.*")

    def _versions(self, state: dict) -> dict[str, list[int]]:
        return {**super()._versions(state), "shared": state["shared"]}

    def _put_shared(self, rows: DataFrame, version: int) -> None:
        rows.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(self._path("shared", version))

    @staticmethod
    def _hashed(docs: DataFrame, supersedes: DataFrame, memory: DataFrame | None) -> DataFrame:
        """(key, hash) of each document's node and of all that its edges follow
        from: its own columns, and which documents it supersedes."""
        own = [c for c in ("title", "tags", "files", "actor", "decisions", "rejected", "status", "work_type", "created_at", "updated_at", "path") if c in docs.columns]
        older = F.xxhash64("older")
        chained = supersedes.groupBy(F.col("newer").alias("id")).agg(F.count("*").alias("n_older"), F.bit_xor(older).alias("xor_older"), F.sum(older.cast("decimal(38,0)")).alias("sum_older"))
        json_of = lambda *names: F.sha1(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).alias("hash")
        rows = docs.select("id", json_of(*own)).join(chained, "id", "left")  # titles stay where they are
        found = rows.select(graph.node("footprint", F.col("id").cast("string")).alias("key"), json_of("hash", "n_older", "xor_older", "sum_older"))
        if memory is None:
            return found
        return found.unionByName(memory.select(graph.node("memory", F.col("id").cast("string")).alias("key"), json_of(*[c for c in memory.columns if c != "id"])))

    def _segment(self, rows: DataFrame, docs: DataFrame, supersedes: DataFrame, memory: DataFrame | None) -> tuple[dict[str, DataFrame], DataFrame, str]:
        """The tables' rows of docs, whose hashes and ranges are in rows, and the
        nodes that they share with others (id, kind, label, ref, refs); their latest time."""
        docs = save(docs.drop("content"), "own")  # read by all that follows
        pairs = supersedes.join(docs.select(F.col("id").alias("newer")), "newer", "left_semi")
        edges = graph.edges(docs, pairs)
        nodes, shared = graph.document_nodes(docs), graph.shared_nodes(docs)
        if memory is not None:
            edges = edges.unionByName(graph.memory_edges(memory))
            nodes = nodes.unionByName(graph.memory_nodes(memory).withColumn("data", F.lit(None).cast(nodes.schema["data"].dataType)))
            shared = shared.unionByName(graph.shared_nodes(memory))
        edges = save(edges.withColumn("owner", F.col("src")), "edges")
        known = rows.select(F.col("key").alias("owner"), F.col("hash").alias("_hash"), F.col("range").alias("_range"))
        owned = graph.rejected_nodes(docs) if "rejected" in docs.columns else self.spark.createDataFrame([], "owner string, id string, kind string, label string, ref string")
        plain = F.col("kind").isin("file", "concept")  # their label is their id
        labels = shared.where(~plain).groupBy("id").agg(F.min_by(F.struct("kind", "label", "ref"), "writer").alias("x")).select("id", "x.*")
        labels = labels.unionByName(shared.where(plain).select("id", "kind", "label", "ref").distinct())
        refs = edges.where(F.col("rel").isin(*graph.SHARED)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("refs"))
        latest = built_at(docs).first()["built_at"] if "created_at" in docs.columns else ""
        return {"docs": nodes.withColumnRenamed("id", "owner").join(known, "owner"), "edges": edges, "owned": owned}, save(refs.join(labels, "id"), "refs"), latest

    def build(self, docs: DataFrame, supersedes: DataFrame, memory: DataFrame | None = None) -> None:
        bits = bits_for(docs.count() + (0 if memory is None else memory.count()))
        rows = self._rows(self._hashed(docs, supersedes, memory), bits)
        segment, shared, latest = self._segment(rows, docs, supersedes, memory)
        self._put_shared(shared, self.version + 1)
        self._begin(segment, rows, bits, shared=[self.version + 1], built_at=latest)

    def update(self, docs: DataFrame, supersedes: DataFrame, memory: DataFrame | None = None) -> None:
        """Only what documents that changed own is made anew, and the counts of
        the nodes that they lead or led to; a document changes too with the
        documents that it supersedes."""
        if self._anew():
            return self.build(docs, supersedes, memory)
        rows, tree, _ = self._survey(self._hashed(docs, supersedes, memory))
        self._follow(self._changes(rows, tree), docs, supersedes, memory)

    def _anew(self) -> bool:
        return self.state is None or self.state["schema"] != SCHEMA_VERSION or bits_for(self.state["count"]) > self.state["bits"]

    def ensure(self, docs: DataFrame, supersedes: DataFrame, memory: DataFrame | None = None) -> str:
        """Build or update unless the graph is fresh; returns the status before."""
        if self._anew():
            status = self.status(0, "")
            self.build(docs, supersedes, memory)
            return status
        latest = built_at(docs).first()["built_at"] if "created_at" in docs.columns else ""
        rows, tree, root = self._survey(self._hashed(docs, supersedes, memory))
        status = self.status(rows.count(), latest, root)
        if status != "fresh":
            self._follow(self._changes(rows, tree), docs, supersedes, memory)
        return status

    def _follow(self, changes: DataFrame, docs: DataFrame, supersedes: DataFrame, memory: DataFrame | None) -> None:
        if changes.isEmpty():
            return
        left = changes.where("change <> 'removed'")
        owners = few(left.select(F.col("key").alias("owner")))
        of = lambda kind, rows: rows.join(owners, graph.node(kind, rows["id"].cast("string")) == F.col("owner"), "left_semi")
        some, some_memory = of("footprint", docs), None if memory is None else of("memory", memory)
        segment, more, latest = self._segment(left, some, supersedes, some_memory)
        was = self._live("edges").join(changes.where("change <> 'added'").select(F.col("key").alias("owner")), "owner", "left_semi")
        less = was.where(F.col("rel").isin(*graph.SHARED)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("less"))
        counts = save(more.select("id", F.col("refs").alias("more")).join(less, "id", "full_outer"), "counts")
        old = self._shared().where("refs > 0").join(counts, "id", "left_semi")
        labels = graph.upsert_nodes(old.drop("refs"), more.drop("refs"))
        after = counts.join(labels, "id").join(old.select("id", "refs"), "id", "left")
        refs = F.coalesce("refs", F.lit(0)) + F.coalesce("more", F.lit(0)) - F.coalesce("less", F.lit(0))
        v = self.version + 1
        self._put_shared(after.select("id", "kind", "label", "ref", refs.alias("refs")), v)
        shared = [*self.state["shared"], v]
        self._apply(changes, segment, shared=shared, built_at=max(latest, self.state["built_at"]))
        if len(shared) > DELTAS:
            v = self.version + 1
            self._put_shared(self._shared().where("refs > 0"), v)
            self._point(v, **{**self._kept(), "shared": [v]})
