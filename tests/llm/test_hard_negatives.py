from collections import Counter

import numpy as np
import pytest

from lodestone.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def plain(rows, positives=5, negatives=3, low=50, high=95):
    """The definition, pair by pair."""
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for i, q, label in fine:
        if i % 50:
            continue
        scores = sorted((-dot(q, v), j, own) for j, v, own in fine)
        for s, j, _ in [x for x in scores if x[2] == label and x[1] != i][:positives]:
            inside = [x for x in scores if x[2] != label and x[1] != i and low * -s <= 100 * -x[0] <= high * -s]
            out.update((i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(inside[:negatives]))
    return out


def mined(df, **more):
    return Counter(tuple(r) for r in hard_negatives.mine(df, df["vec_id"] % 50 == 0, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def cases():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 12)) / 3
    rows = [(i, (centres[i % 4] + rng.standard_normal(12) / 6).astype("f4").tolist(), int(rng.integers(0, 5))) for i in range(400)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(60)]  # copies of an anchor: ties everywhere
    rows += [(5000, None, 1), (5050, rows[0][1], None), (None, rows[0][1], 1), (5100, [float("nan")] * 12, 1), (5150, [None] + [1.0] * 11, 1), (5200, [], 1), (5250, [0.0] * 12, 2), (5300, [1.0, 0.5], 2), (5350, (-centres[0]).tolist(), 99)]
    rows += [rows[100], rows[101], rows[101], (150, rows[7][1], 3)]  # repeated rows, and an anchor's id twice
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = cases()
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(7)
    want = plain(rows)
    assert len(want) > 100 and mined(df) == want
    assert mined(df, positives=2, negatives=5, low=80, high=100) == plain(rows, 2, 5, 80, 100)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 700)  # many blocks of anchors
    assert mined(df) == want


def test_empty_and_large(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == Counter()
    assert mined(spark.createDataFrame([(1, [1.0], 1, "", 0), (2, [1.0], 2, "", 0)], SCHEMA)) == Counter()  # no anchor
    assert mined(spark.createDataFrame([(50, [1.0], 1, "", 0), (2, [1.0], 2, "", 0)], SCHEMA)) == Counter()  # no positive
    large = [(0, [1e9, 1.0], 1), (1, [1e3, 1.0], 1), (2, [9e2, 5.0], 2), (3, [9e2, 4.0], 2)]
    assert mined(spark.createDataFrame([(*r, "", 0) for r in large], SCHEMA)) == plain(large) != Counter()
    with pytest.raises(Exception, match="does not fit a long"):
        mined(spark.createDataFrame([(0, [1e30], 1, "", 0), (1, [1e30], 1, "", 0)], SCHEMA))


def test_first_keeps_what_sorting_does():
    rng = np.random.default_rng(9)
    best, all_ = hard_negatives.First(5, 3), []
    for _ in range(30):
        g, s, i = rng.integers(0, 5, 40), rng.integers(-4, 4, 40), rng.integers(0, 1000, 40)
        all_ += zip(g.tolist(), s.tolist(), i.tolist())
        enters = best.open_to(g, s, i)
        best.add(g[enters], s[enters], i[enters])
    want = [x for k in range(5) for x in sorted((x for x in all_ if x[0] == k), key=lambda x: (-x[1], x[2]))[:3]]
    assert list(zip(best.group.tolist(), best.score.tolist(), best.ident.tolist())) == want
