"""A Merkle manifest as a persistent tree in aligned blocks.

Every group of rows (a language) has a tree over its leaves, and a tree over
the groups' roots stands above. A tree is stored by aligned blocks of 1024
nodes: a block is one row that holds all of its levels, and the roots of a
layer's blocks are the nodes of the layer above. So no task sees more than a
block, and the number of layers is the logarithm of the leaves.

A changed leaf makes a version of the tree: the leaf and its ancestors are
copied, all other nodes are shared. Copies within the leaf's block come first;
above it the version goes on along the path of its block, which is made once
for a block, from the root downwards, and is what the versions of all its
leaves share. A version's last copy is its root."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: A block has 2 ** BITS nodes.
BITS = 10
#: Digests are hex texts of this length.
HEX = 64
BLOCK = "tree string, block long, height int, ids array<long>, nodes string, sizes array<int>, changed array<string>"
PATH = "tree string, at long, path string, subroot string"
COPY = "tree string, at long, id long, level int, node string"
PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, copies int, folded_root string, verified boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the bytes of the value as text, `:` and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def levels(leaves: list[str], height: int) -> list[list[str]]:
    """The leaves of a block and `height` levels above them."""
    out = [leaves]
    for _ in range(height):
        row = out[-1]
        out.append([digest("".join(row[i : i + 2])) for i in range(0, len(row), 2)])
    return out


def steps(rows: list[list[str]], above: str) -> list[str]:
    """For each leaf of a block the path to the root: L or R and the sibling
    for each level, - where there is none; `above` is the path of the block."""
    paths = [above]
    for row in reversed(rows[:-1]):
        paths = [("R" + row[i + 1] if i % 2 == 0 and i + 1 < len(row) else "L" + row[i - 1] if i % 2 else "-") + paths[i // 2] for i in range(len(row))]
    return paths


def climb(node: str, path: str) -> list[str]:
    """The copies of a node's ancestors along a path, the root last."""
    out, at = [], 0
    while at < len(path):
        side, sibling = path[at], path[at + 1 : at + 1 + HEX]
        at += 1 if side == "-" else 1 + HEX
        node = digest(node if side == "-" else sibling + node if side == "L" else node + sibling)
        out.append(node)
    return out


def siblings(path: str) -> str:
    """The siblings of a path, joined."""
    return path.replace("L", "").replace("R", "").replace("-", "")


def _unpacked(nodes: str, sizes: list[int]) -> list[list[str]]:
    out, at = [], 0
    for n in sizes:
        out.append([nodes[i : i + HEX] for i in range(at, at + n * HEX, HEX)])
        at += n * HEX
    return out


def _packed(table: pa.Table, bits: int) -> pa.Table:
    """One row for the nodes (tree, block, at, height, id, node, changed) of a
    block, whose tree has `height` more levels."""
    table = table.sort_by("at")
    rows = levels(table["node"].to_pylist(), min(bits, table["height"][0].as_py()))
    one = {"tree": table["tree"][:1], "block": table["block"][:1], "height": table["height"][:1], "ids": [table["id"].to_pylist()], "nodes": ["".join(map("".join, rows))], "sizes": [[len(r) for r in rows]], "changed": [table["changed"].to_pylist()]}
    kinds = {"height": pa.int32(), "ids": pa.list_(pa.int64()), "nodes": pa.string(), "sizes": pa.list_(pa.int32()), "changed": pa.list_(pa.string())}
    return pa.table({k: pa.array(v, kinds[k]) if k in kinds else v for k, v in one.items()})


@dataclass
class Tree:
    """layers: the blocks of all trees from the leaves upwards (BLOCK);
    roots: (tree, node), the root of each; bits: a block has 2 ** bits nodes."""

    layers: list[DataFrame]
    roots: DataFrame
    bits: int


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `at`, the number of a row within its tree in this order, and
    `height`, the levels above the tree's leaves. Rows are sorted by ranges; what
    a range holds of a tree, one number each, says where the next begins."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.asc_nulls_first(c) for c in ("tree", *order)]
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = save(placed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "sorted")
    runs = placed.groupBy("part", "tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(whole)
    runs = runs.select("part", "tree", (before - F.col("first")).alias("shift"), F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0).alias("height"))
    return placed.join(save(runs, "runs"), ["part", "tree"]).withColumn("at", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def build(nodes: DataFrame, bits: int = BITS) -> Tree:
    """nodes: tree, at, height as numbered() gives them, id, node, changed
    (the leaf's digest after a change, null without one)."""
    tallest = nodes.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]
    layers, roots = [], None
    for k in range(max(1, -(-tallest // bits))):
        blocks = nodes.withColumn("block", F.shiftright("at", bits)).select("tree", "block", "at", "height", "id", "node", "changed")
        blocks = save(blocks.groupBy("tree", "block").applyInArrow(lambda table: _packed(table, bits), BLOCK), f"layer{k}")
        layers.append(blocks)
        left = F.greatest(F.lit(0), F.col("height") - bits)
        tops = blocks.select("tree", F.col("block").alias("at"), left.alias("height"), F.lit(None).cast("long").alias("id"), F.right("nodes", F.lit(HEX)).alias("node"), F.lit(None).cast("string").alias("changed"))
        done = tops.where("height = 0").select("tree", "node")  # a tree that ends in this layer has one block in it
        roots = done if roots is None else roots.unionByName(done)
        nodes = tops.where("height > 0")
    return Tree(layers, save(roots, "roots"), bits)


def _children(blocks: DataFrame, paths: DataFrame, bits: int) -> DataFrame:
    """Paths (PATH) of the nodes of blocks, from the paths of the blocks."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = steps(_unpacked(r["nodes"], r["sizes"]), r["path"])
                first, n = r["block"] << bits, len(found)
                yield pa.record_batch([pa.array([r["tree"]] * n), pa.array(range(first, first + n), pa.int64()), pa.array(found), pa.array([r["subroot"]] * n)], ["tree", "at", "path", "subroot"])

    return _with_paths(blocks, paths).mapInArrow(down, PATH)


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    return blocks.join(paths.select("tree", F.col("at").alias("block"), "path", "subroot"), ["tree", "block"])


def block_paths(tree: Tree, paths: DataFrame) -> DataFrame:
    """Paths (PATH) of the lowest layer's blocks, from what lies above the root of each tree (PATH, at 0)."""
    for blocks in reversed(tree.layers[1:]):
        own = save(_children(blocks, paths, tree.bits), "paths")  # trees that end below this layer have no block in it
        paths = own.unionByName(paths.join(blocks.select("tree").distinct(), "tree", "left_anti"))
    return paths


class Manifest:
    """A tree over rows, and the versions that changes of single rows make.

    A leaf is the digest (sha256, hex) of `columns` of a row of docs, each as
    field() writes it. Leaves of a `group` (null is one of its own, and comes
    first) stand by `order`, whole numbers; of equal ones null comes first, then
    the smaller leaf. Every two consecutive nodes become one until one remains,
    and so do the groups' roots by the groups' names, bytewise. Rows for which
    `where` holds are changed: `changed` gives columns another value.

    Null values of any column are leaves like others, long texts are hashed
    whole, repeated rows are leaves of their own, an empty table has no root
    and empty results, and other columns are not read."""

    def __init__(self, docs: DataFrame, group: str, order: str, columns: list[str], changed: dict[str, Column] | None = None, where: Column | None = None, bits: int = BITS):
        self.bits = bits
        name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # in this order null precedes every name
        after = F.when(where, leaf(*[(changed or {}).get(c, F.col(c)) for c in columns])) if where is not None else F.lit(None).cast("string")
        rows = docs.select(name.alias("tree"), F.col(order).cast("long").alias("id"), leaf(*map(F.col, columns)).alias("node"), after.alias("changed"))
        rows = save(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
        trees = build(numbered(rows, "id", "node", "row"), bits)
        groups = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.lit(None).cast("long").alias("id"), "node", F.lit(None).cast("string").alias("changed"))
        groups = save(numbered(groups, "name"), "groups")
        above = build(groups, bits)
        top = above.roots.first()  # one row, none for an empty table
        self.root = top["node"] if top else None
        paths = block_paths(above, above.roots.select("tree", F.lit(0).cast("long").alias("at"), F.lit("").alias("path"), F.lit("").alias("subroot")))
        tops = _children(above.layers[0], paths, bits).select("at", "path").join(groups.select("at", "name", "node"), "at")
        paths = block_paths(trees, save(tops.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("node").alias("subroot")), "tops"))
        self.blocks = _with_paths(trees.layers[0], paths)

    def versions(self) -> DataFrame:
        """tree, at, id, level, node: the nodes that the version of each changed
        row copied, from the leaf (level 0) to the root. All others are shared."""

        bits = self.bits

        def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    paths, first = steps(_unpacked(r["nodes"], r["sizes"]), r["path"]), r["block"] << bits
                    found = [(r["tree"], first + i, r["ids"][i], level, node) for i, new in enumerate(r["changed"]) if new is not None for level, node in enumerate([new, *climb(new, paths[i])])]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                    yield pa.record_batch([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["tree", "at", "id", "level", "node"])

        return self.blocks.mapInArrow(copies, COPY)

    def proofs(self) -> DataFrame:
        """A row for each leaf: id (its `order`), leaf, subroot, root,
        proof_sha256 (of the siblings from the leaf to the root), copies (the
        nodes that its version copied, 0 without a change), folded_root (the
        version's root, else the tree's) and verified (whether it is the tree's)."""
        root = self.root

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    rows = _unpacked(r["nodes"], r["sizes"])
                    paths, n = steps(rows, r["path"]), len(rows[0])
                    copied = [[] if new is None else [new, *climb(new, path)] for new, path in zip(r["changed"], paths, strict=True)]
                    folded = [c[-1] if c else [node, *climb(node, path)][-1] for c, node, path in zip(copied, rows[0], paths, strict=True)]
                    columns = [r["ids"], rows[0], [r["subroot"]] * n, [root] * n, [digest(siblings(p)) for p in paths], [len(c) for c in copied], folded, [x == root for x in folded]]
                    kinds = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.bool_()]
                    yield pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["id", "leaf", "subroot", "root", "proof_sha256", "copies", "folded_root", "verified"])

        return self.blocks.mapInArrow(prove, PROOF)
