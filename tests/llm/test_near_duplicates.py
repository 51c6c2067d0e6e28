import re
from itertools import combinations

import numpy as np
import xxhash

from lodestone.llm import embedding_dedup, simhash


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}é" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(30)]
    texts = [None, "", " \t", "one", "One", "a b", "a b c d e"] + base + base[:5]
    for t in base[:20]:
        for _ in range(4):
            w = t.split()
            w[rng.integers(len(w))] = "zz"
            texts.append(" ".join(w).upper() if rng.integers(2) else "\n".join(w))
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)]
    fps = [plain_fingerprint(t) for t in texts]
    root = components(len(fps), [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, fingerprint string").repartition(4)
    for limit in (2048, 2):
        got = {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, limit=limit).collect()}
        assert got == {i: (fps[i], root[i]) for i in range(len(fps))}
    assert len(set(root)) < len(root) - 10
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "q")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(odd).collect()) == [(0, 0), (0, 7), (7, 7), (7, 7)]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 64))
    near = np.concatenate([base[i] + rng.standard_normal((6, 64)) * s for i, s in enumerate(np.linspace(0.05, 0.5, 40))])
    v = np.concatenate([base, near, near[:30], -base[:3]]).astype("f4")
    unit = v.astype("f8") / np.linalg.norm(v.astype("f8"), axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    bad = [None, [], [0.0] * 64, [1.0, None] * 32, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, x.tolist(), 1, 0.5) for i, x in enumerate(v)] + [(1000 + i, x, 1, 0.5) for i, x in enumerate(bad)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links double").repartition(4)
    for limit in (1024, 3):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(data, limit=limit).collect()}
        assert len(got) == len(rows)
        for i in range(6):
            assert (got[1000 + i].n_links, got[1000 + i].component_id, got[1000 + i].kept) == (0, 1000 + i, True)
        assert (got[1007].n_links, got[1007].component_id) == (1, 1006)
        found = sum(got[i].n_links for i in range(len(v)))
        assert 0.9 * linked.sum() <= found <= linked.sum()
        assert all(got[i].n_links <= linked[i].sum() for i in range(len(v)))
        root = components(len(v), np.argwhere(linked).tolist())
        assert np.mean([got[i].component_id == root[i] for i in range(len(v))]) > 0.9
    assert embedding_dedup.near_duplicates(data.limit(0)).collect() == []
