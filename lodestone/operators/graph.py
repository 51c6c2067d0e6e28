"""The typed graph of documents and what they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import ranking, text
from lodestone.sources.shared import few, save

# Relation, kind of the node that it points to, kind of bridge.
BRIDGES = {"TOUCHES_FILE": "file", "HAS_TAG": "tag", "HAS_DECISION": "decision", "MENTIONS": "concept"}
# Relations to nodes that documents share.
SHARED = (*BRIDGES, "AUTHORED_BY")
TOKEN_WEIGHT, PHRASE_WEIGHT, SUPERSEDES_WEIGHT = 0.6, 1.0, 3.0


def node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key)


def decisions(docs: DataFrame) -> Column:
    """A document's decisions: its title where it lists none of its own."""
    return F.col("decisions") if "decisions" in docs.columns else F.array("title")


def edges(docs: DataFrame, supersedes: DataFrame) -> DataFrame:
    """(src, dst, rel, weight), one row for each src, dst and rel with its
    highest weight. docs: id, title, tags, files, actor; a title is the
    document's decision and its words are concepts, or, where docs have
    `decisions`, those are. Where docs have `rejected`,
    rejected options lead to nodes and concepts of their own. An id occurs
    once, so a document's row has all its edges and nothing is shuffled for them."""
    src = node("footprint", F.col("id").cast("string"))
    none = F.array().cast("array<string>")
    listed = lambda values, key: F.coalesce(F.array_distinct(F.transform(values, key)), none)
    there = lambda values: F.filter(values, lambda x: x != "")
    words = F.flatten(F.transform(decisions(docs), lambda d: F.coalesce(text.significant_tokens(d), none)))
    to = lambda kind, rel, values, weight=1.0: F.transform(values, lambda x: F.struct(node(kind, x).alias("dst"), F.lit(rel).alias("rel"), F.lit(weight).alias("weight")))
    found = F.concat(
        to("file", "TOUCHES_FILE", F.coalesce(F.array_distinct("files"), none)),
        to("tag", "HAS_TAG", there(listed(F.col("tags"), text.normalise))),
        to("decision", "HAS_DECISION", F.array_distinct(F.transform(there(listed(decisions(docs), text.normalise)), text.fnv1a32))),
        to("concept", "MENTIONS", F.coalesce(F.array_distinct(words), none), TOKEN_WEIGHT),
        to("actor", "AUTHORED_BY", there(F.array(text.normalise(F.col("actor"))))),
    )
    out = docs.select(src.alias("src"), F.explode(found).alias("x")).select("src", "x.*")
    chained = supersedes.select(node("footprint", F.col("newer").cast("string")).alias("src"), node("footprint", F.col("older").cast("string")).alias("dst")).distinct()
    out = out.unionByName(chained.select("src", "dst", F.lit("SUPERSEDES").alias("rel"), F.lit(SUPERSEDES_WEIGHT).alias("weight")))
    if "rejected" not in docs.columns:
        return out
    return out.unionByName(rejected_edges(docs)).groupBy("src", "dst", "rel").agg(F.max("weight").alias("weight"))


def memory_edges(memory: DataFrame) -> DataFrame:
    """Edges of memory documents (id, tags): they lead to their tags alone."""
    src = node("memory", F.col("id").cast("string"))
    tags = memory.select(src.alias("src"), F.explode("tags").alias("tag")).withColumn("tag", text.normalise(F.col("tag"))).where("tag <> ''")
    return tags.select("src", node("tag", F.col("tag")).alias("dst"), F.lit("HAS_TAG").alias("rel"), F.lit(1.0).alias("weight")).distinct()


def rejected_edges(records: DataFrame) -> DataFrame:
    """Edges of rejected options (records: id, rejected): the option itself, and
    its words as concepts, a short one as a phrase too."""
    src = node("footprint", F.col("id").cast("string"))
    each = records.select(src.alias("src"), F.col("id").cast("string").alias("id"), F.posexplode("rejected").alias("at", "x")).withColumn("option", text.normalise(F.col("x.option")))
    stop = F.col("option").isin(*text.STOPWORDS)
    phrase = each.where((F.size(F.split("option", " ")) <= 4) & ~stop & (F.length("option") >= 3)).select("src", node("concept", F.col("option")).alias("dst"), F.lit("MENTIONS").alias("rel"), F.lit(PHRASE_WEIGHT).alias("weight"))
    words = each.select("src", F.explode(text.significant_tokens(F.col("option"))).alias("w")).select("src", node("concept", F.col("w")).alias("dst"), F.lit("MENTIONS").alias("rel"), F.lit(TOKEN_WEIGHT).alias("weight"))
    own = each.select("src", node("rejected_option", F.concat("id", F.lit("#"), "at")).alias("dst"), F.lit("REJECTED").alias("rel"), F.lit(1.0).alias("weight"))
    return own.unionByName(phrase).unionByName(words).groupBy("src", "dst", "rel").agg(F.max("weight").alias("weight"))


def nodes(edges_: DataFrame, docs: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """(id, kind): both ends of all edges, the documents and memory documents."""
    ends = edges_.select(F.col("src").alias("id")).union(edges_.select("dst")).union(docs.select(node("footprint", F.col("id").cast("string"))))
    if memory is not None:
        ends = ends.union(memory.select(node("memory", F.col("id").cast("string"))))
    return ends.distinct().select("id", F.substring_index("id", ":", 1).alias("kind"))


def degrees(edges_: DataFrame) -> DataFrame:
    """(id, degree): edges that start or end at a node; a loop counts once."""
    ends = edges_.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def orphans(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    ends = edges_.select(F.col("src").alias("id")).union(edges_.select("dst")).distinct()
    return nodes_.join(ends, "id", "left_anti")


def _hop(edges_: DataFrame, frontier: DataFrame) -> DataFrame:
    """(id, points) that the frontier's documents (id) give others. Each bridge
    adds up the frontier's edges by weight before it meets its other documents,
    so a hub of n documents costs n rows, not n * n; what a document would give
    itself is taken off. Points are decimals, so no order of adding matters."""
    exact = lambda x: F.round(x, 6).cast("decimal(20,6)")
    kinds = F.create_map(*[x for rel, kind in BRIDGES.items() for x in (F.lit(rel), F.lit(ranking.BRIDGE[kind]))])
    bridging = edges_.where(F.col("rel").isin(*BRIDGES))
    frontier = few(save(frontier.select("id"), "frontier"))
    mine = bridging.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
    counts = save(mine.groupBy("dst", "rel", F.col("weight").alias("w")).agg(F.count("*").alias("n")), "counts")
    given = bridging.join(few(counts), ["dst", "rel"]).select(F.col("src").alias("id"), (exact(kinds[F.col("rel")] * F.least("w", "weight")) * F.col("n").cast("decimal(12,0)")).alias("points"), F.col("n"))
    own = mine.select(F.col("src").alias("id"), (-exact(kinds[F.col("rel")] * F.col("weight"))).alias("points"), F.lit(-1).cast("long").alias("n"))
    sup = edges_.where("rel = 'SUPERSEDES'")
    both = sup.select("src", "dst", "weight").union(sup.select("dst", "src", "weight"))
    chained = both.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), exact(F.lit(ranking.BRIDGE["supersedes"]) * F.col("weight")).alias("points"), F.lit(1).cast("long").alias("n"))
    return given.union(own).union(chained).groupBy("id").agg(F.sum("points").alias("points"), F.sum("n").alias("bridges")).where("bridges > 0")


def expand(edges_: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(id, points, bridges, distance) of documents up to `depth` bridges from
    the seeds (id); points of later hops add up, seeds themselves are left out."""
    frontier, found = seeds.select("id"), None
    reached = frontier
    for d in range(1, depth + 1):
        got = _hop(edges_, frontier).withColumn("distance", F.lit(d))
        found = got if found is None else found.unionByName(got)
        if d < depth:
            found = save(found, "expand")
            frontier = found.select("id").distinct().join(reached, "id", "left_anti")
            reached = reached.union(frontier)
    out = found.groupBy("id").agg(F.sum("points").cast("double").alias("points"), F.sum("bridges").alias("bridges"), F.min("distance").alias("distance"))
    return out.join(seeds.select("id"), "id", "left_anti")


def expand_budgeted(edges_: DataFrame, seeds: list[str], depth: int = 1, max_nodes: int = 40, max_edges: int = 80) -> DataFrame:
    """(id, seed, kind, bridge, weight, distance): what leads from seeds to
    other documents, within a budget of edges and documents. Edges are walked
    in the order of the seeds, SUPERSEDES first, then bridges by id and their
    documents by id; walking to a bridge is an edge too. No seed is walked from
    once there are enough documents. Each task sends on no more edges than the
    budget has left."""
    kinds = F.create_map(*[x for rel, kind in BRIDGES.items() for x in (F.lit(rel), F.lit(kind))])
    spark = edges_.sparkSession
    bridging = edges_.where(F.col("rel").isin(*BRIDGES)).withColumn("kind", kinds[F.col("rel")])
    sup = edges_.where("rel = 'SUPERSEDES'")
    both = sup.select("src", F.col("dst").alias("other"), "weight").union(sup.select("dst", "src", "weight"))
    schema = "id string, seed string, kind string, bridge string, weight double, distance int"
    rows, known, frontier, left = [], [], list(seeds), max_edges
    seen = set(seeds)
    for d in range(1, depth + 1):
        if not frontier or left <= 0 or len(known) >= max_nodes:
            break
        start = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(frontier)], "seed string, at int"))  # seeds, then at most the budget
        chained = both.join(start, both.src == start.seed).select("at", F.lit(0).alias("step"), F.lit("").alias("bridge"), F.col("other").alias("id"), "seed", F.lit("supersedes").alias("kind"), "weight")
        mine = few(save(bridging.join(start, bridging.src == start.seed).select("at", "seed", F.col("dst").alias("bridge"), "rel", "kind", F.col("weight").alias("w")), "mine"))
        there = mine.select("at", F.lit(1).alias("step"), "bridge", F.lit(None).cast("string").alias("id"), "seed", "kind", F.col("w").alias("weight"))
        back = bridging.select("src", F.col("dst").alias("bridge"), "rel", "weight").join(mine, ["bridge", "rel"]).where("src <> seed")
        back = back.select("at", F.lit(1).alias("step"), "bridge", F.col("src").alias("id"), "seed", "kind", F.least("w", "weight").alias("weight"))
        walked = chained.union(there).union(back).orderBy("at", "step", "bridge", F.col("id").asc_nulls_first(), "kind").limit(left).collect()  # at most max_edges
        left -= len(walked)
        frontier, at = [], None
        for r in walked:
            if r["at"] != at and len(known) >= max_nodes:
                break
            at = r["at"]
            if r["id"] is None:
                continue
            if r["id"] not in known and len(known) < max_nodes:
                known.append(r["id"])
            if r["id"] in known:
                rows.append((r["id"], r["seed"], r["kind"], r["bridge"], r["weight"], d))
            if r["id"] not in seen:
                seen.add(r["id"])
                frontier.append(r["id"])
    return spark.createDataFrame([r for r in rows if r[0] not in set(seeds)], schema)


def related_to_file(edges_: DataFrame, path: str) -> DataFrame:
    """(id, points, bridges, distance): documents that touch a file, at no
    distance and with the points of one file bridge, and what they lead to;
    nothing for an unknown file."""
    touching = edges_.where((F.col("rel") == "TOUCHES_FILE") & (F.col("dst") == node("file", F.lit(path)))).select(F.col("src").alias("id")).distinct()
    own = touching.select("id", F.lit(ranking.BRIDGE["file"]).alias("points"), F.lit(1).cast("long").alias("bridges"), F.lit(0).alias("distance"))
    return own.unionByName(expand(edges_, touching, 1))


def resolve(nodes_: DataFrame, ids: list[str]) -> DataFrame:
    """(asked, id): the nodes that ids of documents stand for, by ref; ids with
    a kind stay, unknown ones are footprints."""
    asked = nodes_.sparkSession.createDataFrame([(i,) for i in ids], "asked string")
    refs = nodes_.where(F.col("kind").isin("footprint", "memory")).select(F.col("ref").alias("asked"), F.col("id").alias("known"))
    found = asked.join(refs, "asked", "left")
    return found.select("asked", F.when(F.col("asked").contains(":"), F.col("asked")).otherwise(F.coalesce("known", node("footprint", F.col("asked")))).alias("id"))


def superseding(edges_: DataFrame, affected: DataFrame) -> DataFrame:
    """SUPERSEDES edges that begin or end at affected documents (id)."""
    s = edges_.where("rel = 'SUPERSEDES'")
    ids = affected.select("id").distinct()
    return s.join(ids, s.src == ids.id, "left_semi").union(s.join(ids, s.dst == ids.id, "left_semi")).distinct()


def document_nodes(docs: DataFrame) -> DataFrame:
    """(id, kind, label, ref, data): a node for each document with what ranking
    and rendering need; null where docs have no such column."""
    of = lambda name, kind="string": F.col(name) if name in docs.columns else F.lit(None).cast(kind).alias(name)
    data = F.struct((F.col("path") if "path" in docs.columns else F.get("files", F.lit(0))).alias("file_path"), of("status"), of("work_type"), of("created_at"), of("updated_at"), of("actor"))
    return docs.select(node("footprint", F.col("id").cast("string")).alias("id"), F.lit("footprint").alias("kind"), F.col("title").alias("label"), F.col("id").cast("string").alias("ref"), data.alias("data"))


def memory_nodes(memory: DataFrame) -> DataFrame:
    """(id, kind, label, ref): a node for each memory document."""
    label = F.col("title") if "title" in memory.columns else F.col("id").cast("string")
    return memory.select(node("memory", F.col("id").cast("string")).alias("id"), F.lit("memory").alias("kind"), label.alias("label"), F.col("id").cast("string").alias("ref"))


def rejected_nodes(docs: DataFrame) -> DataFrame:
    """(owner, id, kind, label, ref): a node for each rejected option, which its document owns."""
    ident = F.col("id").cast("string")
    each = docs.select(ident.alias("ref"), F.posexplode("rejected").alias("at", "x"))
    return each.select(node("footprint", F.col("ref")).alias("owner"), node("rejected_option", F.concat("ref", F.lit("#"), "at")).alias("id"), F.lit("rejected_option").alias("kind"), F.col("x.option").alias("label"), "ref")


def shared_nodes(docs: DataFrame) -> DataFrame:
    """(id, kind, label, ref, writer): what documents, or memory documents (id,
    tags), lead to and share with others, as each of them writes it."""
    ident = F.col("id").cast("string").alias("writer")
    row = lambda kind, key, label, ref: (node(kind, key).alias("id"), F.lit(kind).alias("kind"), label.alias("label"), ref.alias("ref"), F.col("writer"))
    tags = docs.select(ident, F.explode("tags").alias("label")).withColumn("key", text.normalise(F.col("label"))).where("key <> ''")
    out = tags.select(*row("tag", F.col("key"), F.col("label"), F.col("key")))
    if "files" not in docs.columns:
        return out
    files = docs.select(ident, F.explode("files").alias("label"))
    decided = docs.select(ident, F.explode(decisions(docs)).alias("decision"))
    said = decided.select("writer", text.trim(F.col("decision")).alias("label"), text.normalise(F.col("decision")).alias("key")).where("key <> ''")
    words = decided.select("writer", F.explode(text.significant_tokens(F.col("decision"))).alias("label"))
    actors = docs.select(ident, F.col("actor").alias("label"), text.normalise(F.col("actor")).alias("key")).where("key <> ''")
    parts = [
        files.select(*row("file", F.col("label"), F.col("label"), F.col("label"))),
        said.select(*row("decision", text.fnv1a32(F.col("key")), F.col("label"), F.lit(None).cast("string"))),
        words.select(*row("concept", F.col("label"), F.col("label"), F.col("label"))),
        actors.select(*row("actor", F.col("key"), F.col("label"), F.col("key"))),
    ]
    if "rejected" in docs.columns:
        phrases = rejected_edges(docs).where("rel = 'MENTIONS'").select(F.split_part("src", F.lit(":"), F.lit(2)).alias("writer"), F.regexp_replace("dst", "^concept:", "").alias("label"))
        parts.append(phrases.select(*row("concept", F.col("label"), F.col("label"), F.col("label"))))
    for p in parts:
        out = out.unionByName(p)
    return out


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (id, kind, label, ref) after a write: what a document owns is
    replaced, of what documents share the first label stays."""
    both = old.withColumn("order_", F.lit(0)).unionByName(new.withColumn("order_", F.lit(1)))
    row = F.struct("kind", "label", "ref")
    chosen = both.groupBy("id").agg(F.min_by(row, "order_").alias("first"), F.max_by(row, "order_").alias("last"))
    owned = F.col("last.kind").isin("footprint", "memory", "rejected_option")
    return chosen.select("id", F.when(owned, F.col("last")).otherwise(F.col("first")).alias("x")).select("id", "x.*")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (src, dst, rel, weight, owner) after a write: the last writer's weight and owner hold."""
    both = old.withColumn("order_", F.lit(0)).unionByName(new.withColumn("order_", F.lit(1)))
    return both.groupBy("src", "dst", "rel").agg(F.max_by(F.struct("weight", "owner"), "order_").alias("x")).select("src", "dst", "rel", "x.*")


def rank(candidates: DataFrame, docs: DataFrame, now: str, exclude_superseded: bool = False) -> DataFrame:
    """Candidates that are documents, with their score."""
    known = docs.select(node("footprint", F.col("id").cast("string")).alias("id"), "status", "created_at", "work_type")
    rows = candidates.join(known, "id")
    if exclude_superseded:
        rows = rows.where(F.col("status").isNull() | ~F.col("status").isin("superseded", "deprecated"))
    score = F.col("points") * F.pow(F.lit(ranking.DISTANCE_DECAY), F.greatest(F.lit(0), F.col("distance") - 1)) * ranking.recency_boost(F.col("created_at"), F.col("work_type"), F.lit(now)) * ranking.status_penalty(F.col("status"))
    return rows.select("id", "distance", "bridges", score.alias("score"))


def _undirected(edges_: DataFrame) -> DataFrame:
    kept = edges_.where("rel <> 'AUTHORED_BY'")
    return kept.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel").union(kept.select("dst", "src", "rel"))


def _further(both: DataFrame, frontier: DataFrame, reached: DataFrame, distance: int) -> DataFrame:
    """What the frontier leads to and wasn't reached before; of several ways the smallest id wins."""
    step = both.join(few(frontier.select(F.col("id").alias("a"))), "a").join(few(reached.select(F.col("id").alias("b"))), "b", "left_anti")
    return save(step.groupBy("b").agg(F.min(F.struct("a", "rel")).alias("x")).select(F.col("b").alias("id"), F.lit(distance).alias("distance"), F.col("x.a").alias("before"), F.col("x.rel").alias("rel")), "hop")


def _origin(edges_: DataFrame, start: str) -> DataFrame:
    return edges_.sparkSession.createDataFrame([(start, 0, None, None)], "id string, distance int, before string, rel string")


def distances(edges_: DataFrame, start: str, depth: int = 6) -> DataFrame:
    """(id, distance, before, rel): the shortest way from start, at most `depth`
    edges, authorship left out. Each hop joins the frontier alone and is
    written out, and of several ways the smallest id wins."""
    both = _undirected(edges_)
    reached = frontier = _origin(edges_, start)
    for d in range(1, depth + 1):
        frontier = _further(both, frontier, reached, d)
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def between(edges_: DataFrame, start: str, end: str, depth: int = 6) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(id, distance, before, rel) as distances() gives them for the nodes that
    a shortest way from start to end may take (and others nearer to start), and the
    hops as (side, nodes of the frontier that was followed). Without a way of at most
    `depth` edges end is not among the rows.

    Searched from both ends, the smaller frontier first, until the two meet:
    the ways to end are then followed over nodes that its own side has reached.
    A hub between two documents is met, and what else it leads to is never read."""
    both = _undirected(edges_)
    levels = [[_origin(edges_, start)], [_origin(edges_, end)]]
    reached, sizes, hops = [levels[0][0], levels[1][0]], [1, 1], []
    met = levels[0][0] if start == end else None
    while met is None and len(hops) < depth:
        side = min((0, 1), key=lambda k: (sizes[k], len(levels[k])))
        hops.append((side, sizes[side]))
        step = _further(both, levels[side][-1], reached[side], len(levels[side]))
        sizes[side] = step.count()
        if not sizes[side]:
            return reached[0], hops
        common = step.join(levels[1 - side][-1].select("id"), "id", "left_semi")
        levels[side].append(step)
        reached[side] = reached[side].union(step)
        met = None if common.isEmpty() else save(common.select("id"), "met")
    if met is None:
        return reached[0], hops
    found, at = reached[0], len(levels[0])
    for level in levels[1][-2::-1]:  # from where they met towards end
        near = both.join(few(met.select(F.col("id").alias("a"))), "a").join(few(level.select(F.col("id").alias("b"))), "b", "left_semi")
        met = save(near.groupBy("b").agg(F.min(F.struct("a", "rel")).alias("x")).select(F.col("b").alias("id"), F.lit(at).alias("distance"), F.col("x.a").alias("before"), F.col("x.rel").alias("rel")), "back")
        found, at = found.union(met), at + 1
    return found, hops


def explain(edges_: DataFrame, start: str, end: str, depth: int = 6) -> list[tuple[str, str | None]]:
    """The nodes of a shortest path with the relation that leads to each; empty
    if there is none. Only the path's nodes come to the driver."""
    (found, _), path, at = between(edges_, start, end, depth), [], end
    while at is not None:
        row = found.where(F.col("id") == at).first()
        if row is None:
            return []
        path.append((at, row["rel"]))
        at = row["before"]
    return path[::-1]
