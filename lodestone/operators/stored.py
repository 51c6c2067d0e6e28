"""Tables that follow their sources: segments, tombstones and a tree of hashes.

What is stored lies below a base path in numbered versions, and the last row of
a pointer table says which of them count. All files of a version are written
before its row, so a reader sees the version before or the new one.

- An update writes the rows of new and changed owners (documents) as a segment,
  and a tombstone (owner, segment) for each that is gone from an older one.
  When GROUP segments are of about one size they are merged, so a row is
  written again a number of times that grows with the logarithm of the table,
  and what an update writes grows with the change.
- The hashes of the owners make a tree over ranges of hashed keys. Two trees
  are compared from the root downwards, below nodes that differ alone; the
  root's hash stands in the pointer. An update rewrites the nodes above what
  changed."""

from __future__ import annotations

import json
from collections import defaultdict

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import exists, folder, save

SCHEMA_VERSION = 5
#: A node of the tree has 2 ** STEP below it, a range of the lowest level about this many owners.
STEP, PER_RANGE = 5, 256
#: Segments of a size that are merged, by powers of it, and versions of small tables that are put together.
GROUP, DELTAS = 4, 8
#: What the pointer has of every table.
COLUMNS = ("version", "schema", "count", "bits", "built_at", "root", "segments", "dead", "trees")


def bits_for(count: int) -> int:
    """Levels of the tree, in bits, for so many owners."""
    return STEP * -(-max(0, (count // PER_RANGE).bit_length()) // STEP)


def range_of(key: Column, bits: int) -> Column:
    hashed = F.xxhash64(key.cast("string"))
    return F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("long")


def leaves(rows: DataFrame) -> DataFrame:
    """(range, hash) of owners (key, hash, range), about PER_RANGE each."""
    line = F.concat_ws(":", F.col("key").cast("string"), "hash")
    return rows.groupBy("range").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), ",")).alias("hash"))


def above(nodes: DataFrame) -> DataFrame:
    """(range, hash) of the level above nodes (range, hash)."""
    rows = nodes.withColumn("up", F.shiftright("range", STEP))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "hash"))), lambda x: x["hash"]), ",")
    return rows.groupBy("up").agg(F.sha1(joined).alias("hash")).select(F.col("up").alias("range"), "hash")


def hash_tree(rows: DataFrame, bits: int) -> DataFrame:
    """(level, range, hash) of owners (key, hash, range): level `bits` has the ranges, level 0 the root."""
    at = save(leaves(rows), "leaves")
    tree = at.select(F.lit(bits).alias("level"), "range", "hash")
    for level in range(bits - STEP, -1, -STEP):
        at = above(at)
        tree = tree.unionByName(at.select(F.lit(level).alias("level"), "range", "hash"))
    return tree


def differing(old: DataFrame, new: DataFrame, bits: int) -> DataFrame:
    """(range) of the lowest level whose hashes differ between two trees (level,
    range, hash): of each level only what lies below nodes that differ is read."""
    at = None
    for level in range(0, bits + 1, STEP):
        a = old.where(F.col("level") == level).select("range", F.col("hash").alias("was"))
        b = new.where(F.col("level") == level).select("range", F.col("hash").alias("now"))
        if at is not None:
            a, b = (x.join(at, F.shiftright(x["range"], STEP) == at["up"], "left_semi") for x in (a, b))
        found = a.join(b, "range", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
        at = found.select(F.col("range").alias("up"))
    return at.select(F.col("up").alias("range"))


def changed_owners(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change, hash, range, segment) between owners: old has `segment` too, and so have rows that it has."""
    a = old.select("key", F.col("hash").alias("was"), F.col("range").alias("range_was"), "segment")
    both = a.join(new.select("key", "hash", "range"), "key", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("was") != F.col("hash"), "changed").otherwise("same")
    return both.select("key", change.alias("change"), "hash", F.coalesce("range", "range_was").alias("range"), "segment").where("change <> 'same'")


class Stored:
    """key: the owner's column in all of `tables`; the first of them has one
    row for each owner, with its _hash and _range. All have the number of their
    _segment."""

    key = "id"
    tables: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, base: str | None, name: str):
        self.spark, self.base = spark, base or folder(spark, name)
        self.state = self._readable()

    # --- what is there

    def _last(self) -> dict | None:
        path = f"{self.base}/pointer"
        row = self.spark.read.parquet(path).orderBy(F.desc("version")).first() if exists(self.spark, path) else None
        if row is None:
            return None
        found = {k: json.loads(v) if isinstance(v, str) and v[:1] in ("[", "{") else v for k, v in row.asDict().items()}
        return found | (found.pop("more", None) or {})

    def _readable(self) -> dict | None:
        """The pointer's last row; None too where it or what it points to can't be read."""
        try:
            found = self._last()
            if found and found["schema"] == SCHEMA_VERSION:
                for name, versions in self._versions(found).items():
                    for v in versions:
                        self.spark.read.parquet(self._path(name, v))  # reads a footer
            return found
        except (PySparkException, Py4JJavaError):
            return None

    def _versions(self, state: dict) -> dict[str, list[int]]:
        return {**{name: [int(s) for s in state["segments"]] for name in self.tables}, "dead": state["dead"], "tree": state["trees"]}

    @property
    def version(self) -> int:
        return self.state["version"] if self.state else 0

    def status(self, count: int, latest: str, root: str | None = None) -> str:
        """missing, stale with the reason, or fresh, for sources of so many
        owners and this latest time. With the root of their tree it decides
        where count and schema agree: what was touched and reads as before is
        fresh, what was edited is stale at any time."""
        if self.state is None:
            return "missing"
        if self.state["schema"] != SCHEMA_VERSION:
            return "stale: schema"
        if self.state["count"] != count:
            return "stale: count"
        newer = latest > self.state["built_at"]
        if root is None:
            return "stale: mtime" if newer else "fresh"
        return "fresh" if root == self.state["root"] else "stale: mtime" if newer else "stale: content"

    def _path(self, name: str, version: int) -> str:
        return f"{self.base}/{name}/v{version}"

    def _live(self, name: str, segments: list[int] | None = None) -> DataFrame:
        """The rows of a table that no tombstone is set on."""
        here = [int(s) for s in self.state["segments"]] if segments is None else segments
        rows = self.spark.read.parquet(*[self._path(name, v) for v in here])
        if self.state["dead"]:
            gone = self._tombstones().select(F.col("key").alias(self.key), F.col("segment").alias("_segment"))
            n = sum(x[1] for x in self.state["segments"].values())
            rows = rows.join(F.broadcast(gone) if n <= 1 << 20 else gone, [self.key, "_segment"], "left_anti")
        return rows

    def _tombstones(self) -> DataFrame:
        return self.spark.read.parquet(*[self._path("dead", v) for v in self.state["dead"]])

    def _owners(self) -> DataFrame:
        return self._live(self.tables[0]).select(F.col(self.key).alias("key"), F.col("_hash").alias("hash"), F.col("_range").alias("range"), F.col("_segment").alias("segment"))

    def _tree(self) -> DataFrame:
        """(level, range, hash): of a node written several times the last, which has no hash where the range is empty."""
        trees = self.state["trees"]
        rows = self.spark.read.parquet(*[self._path("tree", v) for v in trees])
        if len(trees) > 1:
            rows = rows.groupBy("level", "range").agg(F.max_by("hash", "version").alias("hash"))
        return rows.where("hash is not null").select("level", "range", "hash")

    # --- what changes it

    def _rows(self, owners: DataFrame, bits: int) -> DataFrame:
        """owners (key, hash) with their range, written out."""
        return save(owners.withColumn("range", range_of(F.col("key"), bits)), "owners")

    def _survey(self, owners: DataFrame) -> tuple[DataFrame, DataFrame, str]:
        """owners (key, hash) of all sources with their range, their tree and its root."""
        rows = self._rows(owners, self.state["bits"])
        tree = save(hash_tree(rows, self.state["bits"]), "tree")
        top = tree.where("level = 0").first()
        return rows, tree, top["hash"] if top else ""

    def _changes(self, rows: DataFrame, tree: DataFrame) -> DataFrame:
        """What differs between all sources and what is stored, from the ranges that differ alone."""
        at = differing(self._tree(), tree, self.state["bits"])
        few = [r["range"] for r in at.limit(65).collect()]
        old = self._owners()
        if len(few) <= 64:  # the files are sorted by range: what holds others is not read
            old, rows = old.where(F.col("range").isin(few)), rows.where(F.col("range").isin(few))
        else:
            at = save(at, "ranges")
            old, rows = old.join(at, "range", "left_semi"), rows.join(at, "range", "left_semi")
        return save(changed_owners(old, rows), "changes")

    def _asked(self, rows: DataFrame, removed: DataFrame | None) -> DataFrame:
        """What differs between some sources (key, hash, range), removed ones (key), and what is stored of them."""
        keys = rows.select("key") if removed is None else rows.select("key").unionByName(removed.select("key"))
        return save(changed_owners(self._owners().join(keys.distinct(), "key", "left_semi"), rows), "changes")

    def _tree_after(self, changes: DataFrame, bits: int) -> DataFrame:
        """(level, range, hash) of the nodes above changes; no hash where nothing is left."""
        touched = changes.select("range").distinct()
        kept = self._owners().join(touched, "range", "left_semi").join(changes.select("key"), "key", "left_anti").select("key", "hash", "range")
        rows = kept.unionByName(changes.where("change <> 'removed'").select("key", "hash", "range"))
        at = save(touched.join(leaves(rows), "range", "left"), "nodes")
        found, stored = at.select(F.lit(bits).alias("level"), "range", "hash"), self._tree()
        for level in range(bits - STEP, -1, -STEP):
            ups = at.select(F.shiftright("range", STEP).alias("up")).distinct()
            below = stored.where(F.col("level") == level + STEP).select("range", "hash")
            below = below.join(ups, F.shiftright(below["range"], STEP) == ups["up"], "left_semi").join(at.select("range"), "range", "left_anti")
            own = above(below.unionByName(at.where("hash is not null")))
            at = ups.withColumnRenamed("up", "range").join(own, "range", "left")
            found = found.unionByName(at.select(F.lit(level).alias("level"), "range", "hash"))
        return found

    def _arrange(self, name: str, rows: DataFrame) -> DataFrame:
        """How the rows of a table lie in their files."""
        return rows.sortWithinPartitions("_range") if name == self.tables[0] else rows

    def _put(self, name: str, rows: DataFrame, version: int) -> None:
        self._arrange(name, rows.withColumn("_segment", F.lit(version))).write.mode("overwrite").parquet(self._path(name, version))

    def _put_tree(self, tree: DataFrame, version: int) -> None:
        rows = tree.withColumn("version", F.lit(version)).sortWithinPartitions("level", "range")
        rows.write.mode("overwrite").parquet(self._path("tree", version))

    def _begin(self, segment: dict[str, DataFrame], rows: DataFrame, bits: int, **also) -> None:
        """Everything anew: one segment of all owners (key, hash, range)."""
        v = self.version + 1
        for name in self.tables:
            self._put(name, segment[name], v)
        tree = save(hash_tree(rows, bits), "tree")
        self._put_tree(tree, v)
        top, count = tree.where("level = 0").first(), rows.count()
        self._point(v, count=count, bits=bits, root=top["hash"] if top else "", segments={v: [count, 0]}, dead=[], trees=[v], **also)

    def _apply(self, changes: DataFrame, segment: dict[str, DataFrame], **also) -> None:
        """A segment with the rows of added and changed owners, and tombstones of changed and removed ones."""
        v, bits = self.version + 1, self.state["bits"]
        counts = {(r["change"], r["segment"]): r["count"] for r in changes.groupBy("change", "segment").count().collect()}  # three rows a segment at most
        added = sum(n for (change, _), n in counts.items() if change != "removed")
        gone: dict[int, int] = defaultdict(int)
        for (change, s), n in counts.items():
            if change != "added":
                gone[s] += n
        nodes = save(self._tree_after(changes, bits), "nodes")
        segments, dead, trees = ({k: [*x] for k, x in self.state["segments"].items()}, [*self.state["dead"]], [*self.state["trees"]])
        if added:
            for name in self.tables:
                self._put(name, segment[name], v)
            segments[str(v)] = [added, 0]
        if gone:
            changes.where("change <> 'added'").select("key", "segment").write.mode("overwrite").parquet(self._path("dead", v))
            dead.append(v)
            for s, n in gone.items():
                segments[str(s)][1] += n
        self._put_tree(nodes, v)
        trees.append(v)
        root = nodes.where("level = 0").first()["hash"]
        count = self.state["count"] + added - sum(gone.values())
        self._point(v, count=count, bits=bits, root=root or "", segments=segments, dead=dead, trees=trees, **also)
        self._merge()

    def _merge(self) -> None:
        """Merge segments of about one size when there are GROUP of them, and
        those of which more than half is gone."""
        tiers: dict[int, list[int]] = defaultdict(list)
        for s, (n, gone) in self.state["segments"].items():
            tiers[max(0, n - gone).bit_length() // 2].append(int(s))
        due = {int(s) for s, (n, gone) in self.state["segments"].items() if 2 * gone > n}
        full = [t for t, found in tiers.items() if len(found) >= GROUP]
        if full:
            due |= {s for t, found in tiers.items() if t <= max(full) for s in found}
        v, state = self.version + 1, self.state
        trees = state["trees"]
        if len(trees) > DELTAS:
            self._put_tree(save(self._tree(), "tree"), v)
            trees = [v]
        if not due:
            if trees != state["trees"]:
                self._point(v, **{**self._kept(), "trees": trees})
            return
        rest = {s: x for s, x in state["segments"].items() if int(s) not in due}
        n = sum(x[0] - x[1] for s, x in state["segments"].items() if int(s) in due)
        if n or not rest:
            for name in self.tables:
                self._put(name, self._live(name, sorted(due)), v)
            rest = {**rest, str(v): [n, 0]}
        dead = []
        if any(x[1] for x in rest.values()):
            self._tombstones().where(F.col("segment").isin([int(s) for s in rest])).write.mode("overwrite").parquet(self._path("dead", v))
            dead = [v]
        self._point(v, **{**self._kept(), "segments": rest, "dead": dead, "trees": trees})

    def _kept(self) -> dict:
        return {k: x for k, x in self.state.items() if k not in ("version", "schema")}

    def _point(self, version: int, **row) -> None:
        row = {"version": version, "schema": SCHEMA_VERSION, **row}
        row = {k: row.pop(k) for k in COLUMNS} | {"more": row}  # what only some tables have is one column
        plain = {k: json.dumps(x) if isinstance(x, (dict, list)) else x for k, x in row.items()}
        fields = ", ".join(f"{k} {'string' if isinstance(x, str) else 'long'}" for k, x in plain.items())
        # without a readable row before it, the pointer begins anew
        how = "append" if self.state and self.state["schema"] == SCHEMA_VERSION else "overwrite"
        self.spark.createDataFrame([tuple(plain.values())], fields).coalesce(1).write.mode(how).parquet(f"{self.base}/pointer")
        self.state = self._last()
