from collections import defaultdict
from fractions import Fraction

import numpy as np

from lodestone.llm import mixing, top_k


def plain(rows, queries, k=5):
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in queries:
        if q in ints:
            scores = sorted((-min(sum(a * b for a, b in zip(ints[q], v)), 2**63 - 1), i) for i, v in ints.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16)) / 4
    v = np.concatenate([rng.standard_normal((300, 16)) / 4, base, base + rng.standard_normal((40, 16)) / 50]).astype("f4").tolist()
    rows = list(enumerate(v)) + [(500 + i, v[50]) for i in range(60)] + [(700, None), (750, [float("nan")] * 16), (800, [None] + [1.0] * 15), (None, v[0]), (850, []), (900, [0.0] * 16), (950, [1.0, 2.0]), (951, [3e8] * 16), (1000, [3e8] * 16)]
    data = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(5)
    queries = data.where("vec_id % 50 = 0")
    want = plain(rows, [i for i, _ in rows if i is not None and i % 50 == 0])
    for lists in (1, 2, 4):
        got = [tuple(r) for r in top_k.top_k(data, queries, lists=lists).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    few = data.where("vec_id in (0, 1, 2)")
    assert {tuple(r) for r in top_k.top_k(few, few).collect()} == plain([r for r in rows if r[0] in (0, 1, 2)], [0, 1, 2])
    assert top_k.top_k(data.limit(0), queries.limit(0)).collect() == []
    assert top_k.top_k(data.limit(0), queries).collect() == []


def test_period_is_pfair():
    weights = {"a": 0.5, "b": 0.31, "c": 0.15, "d": 0.04}
    parts = mixing.parts_of(weights, 100)
    slots = mixing.one_period(parts)
    assert sorted(x for s in slots.values() for x in s) == list(range(100))
    for s, xs in slots.items():
        w = Fraction(parts[s], 100)
        assert len(xs) == parts[s]
        for t in range(101):
            assert abs(sum(x < t for x in xs) - w * t) < 1


def test_mixing(spark):
    sizes = {"a": 700, "b": 90, None: 33, "c": 1}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"t{i}", s, 7))
            i += 1
    rows += [(None, None, "b", 7), (5, "t5", "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot int")
    weights = {"a": 0.5, "b": 0.3, None: 0.15, "c": 0.05}
    got = mixing.mix(docs, weights, block=4, period=40, bucket=50).collect()
    assert sorted(map(str, [(r.doc_id, r.text, r.source) for r in got])) == sorted(map(str, [x[:3] for x in rows]))
    by = defaultdict(set)
    for r in got:
        by[r.mix_slot].add(r.source)
    assert all(len(s) == 1 for s in by.values()) and set(by) == set(range(len(by)))
    blocks = {s: -(-(n + (s in ("a", "b"))) // 4) for s, n in sizes.items()}
    first = min(max(t for t, s in by.items() if x in s) for x in sizes)  # until a source runs out
    for t in range(first + 1):
        for s, w in weights.items():
            assert abs(sum(s in by[u] for u in range(t)) - w * t) < 1.01
    assert {s: sum(s in v for v in by.values()) for s in sizes} == blocks
    assert sorted(r.mix_rank for r in got if r.source == "a") == list(range(701))
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mix(docs).count() == len(rows)


def ideal(blocks, weights):
    """By slot, what each source has when all that have blocks left are dealt at once, each at its exact weight."""
    got = dict.fromkeys(blocks, Fraction(0))
    while True:
        yield dict(got)
        room = Fraction(1)
        while room and (left := [s for s in blocks if got[s] < blocks[s]]):
            total = sum(Fraction(weights[s]) for s in left)
            step = min(room, *((blocks[s] - got[s]) * total / Fraction(weights[s]) for s in left))
            for s in left:
                got[s] += step * Fraction(weights[s]) / total
            room -= step


def drift(order, blocks, weights):
    """The most blocks that a source is off the ideal mix after any slot."""
    dealt, most = dict.fromkeys(blocks, 0), 0
    for s, want in zip([*order, None], ideal(blocks, weights), strict=False):
        most = max(most, *(abs(dealt[x] - want[x]) for x in blocks))
        if s is not None:
            dealt[s] += 1
    return most


def test_mixing_keeps_exact_weights(spark, monkeypatch):
    equal = {f"s{i:02}": 150 for i in range(20)}  # 51.2 of 1024 each
    many = {"hot": 400} | {f"s{i:02}": 3 + i % 4 for i in range(40)}  # more sources than the period has slots
    uneven = {"a": 600, "b": 290, "c": 41, "d": 7}
    for n, weights, period in ((equal, dict.fromkeys(equal, 1.0), 1024), (many, None, 16), (uneven, {"a": 0.7, "b": 1 / 3, "c": 0.061, "d": 0.0123}, 32)):
        docs = spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))], "doc_id long, text string, source string")
        exact = weights or {s: k**0.5 for s, k in n.items()}
        got = sorted((r.mix_slot, r.source) for r in mixing.mix(docs, weights, block=1, period=period).collect())
        assert [t for t, _ in got] == list(range(sum(n.values())))
        assert drift([s for _, s in got], n, exact) < 1
        with monkeypatch.context() as m:
            m.setattr(mixing, "SENT", 0, raising=False)
            assert sorted((r.mix_slot, r.source) for r in mixing.mix(docs, weights, block=1, period=period).collect()) == got


def test_mixing_long_run():
    n = {"hot": 40_000} | {f"s{i:04}": 20 + i % 5 for i in range(1500)}
    weights = {s: k**0.5 for s, k in n.items()}
    slots = mixing.deal(n, weights)
    assert sorted(x for xs in slots.values() for x in xs) == list(range(sum(n.values())))
    first = 20_000  # no source has run out by then
    total = sum(map(Fraction, weights.values()))
    for s, xs in slots.items():
        share = Fraction(weights[s]) / total
        assert all(-1 < i - share * t < 1 and -1 < i + 1 - share * (t + 1) < 1 for i, t in enumerate(xs) if t < first)
