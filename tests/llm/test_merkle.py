import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def above(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path_of(levels, at):
    """For each level the sibling, None without one, and whether it stands before."""
    for k, row in enumerate(levels[:-1]):
        other = at >> k ^ 1
        yield (row[other] if other < len(row) else None), other < at >> k


def fold(node, path):
    for other, before in path:
        node = h(node if other is None else other + node if before else node + other)
    return node


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = above([leaf_of(r) for r in by[lang]])
    top = above([trees[x][-1][0] for x in langs])
    root = top[-1][0]
    out = []
    for n, lang in enumerate(langs):
        for at, r in enumerate(by[lang]):
            path = [*path_of(trees[lang], at), *path_of(top, n)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            start = leaf_of((*r[:3], r[3] + 1, r[4])) if changed else leaf_of(r)
            folded = fold(start, path)
            out.append((r[0], leaf_of(r), trees[lang][-1][0], root, h("".join(x for x, _ in path if x)), folded, folded == root))
    return sorted(out, key=str)


def manifest(spark, rows, bits=10):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return merkle.Manifest(df, "lang", "doc_id", COLUMNS, more, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, bits)


def found(m):
    return sorted((tuple(r) for r in m.proofs().select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def cases():
    rows = [(i, "web", "en", 10 + i, f"text {i}") for i in range(150)]
    rows += [(i * 3 - 40, None if i % 5 == 0 else "ü", "de", None if i % 3 == 0 else i, None if i % 4 == 0 else "") for i in range(37)]
    rows += [(7, "s", None, 2**63 - 1, "x" * 50_000), (-9, "s", "", 0, "é"), (None, "s", "fr", 1, "a"), (None, "s", "fr", 1, "b"), (3, "s", "fr", 1, "c")]
    return rows + [rows[5], rows[5], (5, "web", "en", 99, "another with the id of a row")]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_equals_a_tree_built_at_once(spark, bits):
    rows = cases()
    got = found(manifest(spark, rows, bits))
    assert got == plain(rows) and {x[-1] for x in got} == {True, False}


def test_versions_share_what_they_do_not_copy(spark):
    rows = cases()
    m = manifest(spark, rows, 2)
    proofs = {(r["id"], r["leaf"]): r for r in m.proofs().collect()}
    versions = {}
    for r in m.versions().collect():
        versions.setdefault((r["tree"], r["at"], r["id"]), {})[r["level"]] = r["node"]
    assert versions and all(sorted(v) == list(range(len(v))) for v in versions.values())
    # the leaf and one ancestor a level, no more: the others are the tree's own
    english = sum(r[2] == "en" for r in rows)
    assert {len(v) for (tree, *_), v in versions.items() if tree == "=en"} == {1 + (english - 1).bit_length() + 3}
    roots = {(i, v[max(v)]) for (_, _, i), v in versions.items()}
    assert {(r["id"], r["folded_root"]) for r in proofs.values() if r["copies"]} <= roots


def test_small_and_empty(spark):
    one = [(1, "a", "en", 1, "t")]
    assert found(manifest(spark, one)) == plain(one)
    assert found(manifest(spark, [])) == [] and manifest(spark, []).root is None and manifest(spark, []).versions().collect() == []
    two = [(1, "a", "en", 1, "t"), (2, "a", None, 1, "t")]
    assert found(manifest(spark, two)) == plain(two)
