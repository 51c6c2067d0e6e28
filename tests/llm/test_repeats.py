import hashlib
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import queries, repeats
from lodestone.llm.common import shared_dir


def plain(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, int)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i + 1 : i + span + 1] = 1
        runs = int((np.diff(gone) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdeéß"), rng.integers(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    passages = [text(60), text(45), text(120)]
    texts = [None, "", "x", "a" * 700, "ab" * 300, "a" * 199, "b" * 200, "b" * 200, "c" * 201]
    texts += [text(int(rng.integers(1, 300))) for _ in range(60)]
    texts += [text(20) + passages[int(rng.integers(3))] + text(30) + passages[int(rng.integers(3))] for _ in range(20)]
    texts += texts[20:30] + [texts[40], texts[40][:-1] + "q", "z" + texts[41], texts[42][10:], texts[43][:300] + "!" + texts[43][301:]]
    texts += [(s := text(80)) + s, text(10) + passages[0][3:200] + text(9)]
    # mosaics: what a piece has in common with others differs to the left and to the right
    core = text(40)
    for _ in range(60):
        a, b = sorted(rng.integers(0, len(core), 2).tolist())
        texts.append(text(8) + core[a:b] + text(8))
    # a long text of many edits of another
    long = text(3000)
    edited = list(long)
    for i in rng.integers(0, len(long), 40):
        edited[i] = "#"
    return texts + [long, "".join(edited)]


@pytest.fixture(scope="module")
def saved(spark):
    texts = made()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, no string").repartition(5)
    with tempfile.TemporaryDirectory(prefix="spark-") as folder:
        docs.write.mode("overwrite").parquet(f"{folder}/docs")
        yield spark.read.parquet(f"{folder}/docs"), texts


@pytest.mark.parametrize("part, batch_bytes", [(1 << 20, 1 << 30), (1000, 1 << 12)])
def test_against_brute_force(saved, part, batch_bytes, monkeypatch):
    docs, texts = saved
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "SENT", 100)
    rows = repeats.remove_repeats(docs, batch_bytes=batch_bytes).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    want = plain(texts, 200)
    assert len(rows) == len(texts) and {i: (got[i], w) for i, w in enumerate(want) if got[i] != w} == {}
    for r in rows:
        if r.spans and r.kept is not None:
            assert sum(s.end - s.start for s in r.spans) == r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_pieces_of_almost_a_span(spark):
    """Two sampled suffixes of a text reach far enough only by different partners: what both look at occurs once."""
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    texts = []
    for _ in range(60):
        core = text(400)
        for _ in range(int(rng.integers(2, 6))):
            a, n = int(rng.integers(0, 200)), int(rng.integers(150, 215))
            texts.append(text(int(rng.integers(0, 150))) + core[a : a + n] + text(int(rng.integers(0, 150))))
        texts.append(text(30) + core[:300] + text(20))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, 200)


def test_empty_and_short(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "short", 2), (1, "short", 2)], "doc_id long, text string, batch int")
    assert repeats.remove_repeats(docs.limit(0)).collect() == []
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()) == [(0, 0, 0, 0), (1, 5, 0, 0), (1, 5, 0, 0)]


def test_query(spark, saved, tmp_path):
    docs, texts = saved
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_repeats(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, 200)


def test_levels_merge_and_a_kept_family_goes_on(spark):
    path = f"{shared_dir(spark)}/lodestone-family-{uuid.uuid4().hex}"
    of = lambda rows: spark.createDataFrame([(g, s.encode().ljust(16), n, b) for g, s, n, b in rows], "gram long, stretch binary, n long, batch int")
    family = repeats.Family(spark, path, 3)
    family.add(of([(1, "a", 1, 0), (2, "b", 1, 0), (3, "c", 1, 1), (4, "d", 1, 2), (1, "a", 1, 2), (5, "e", 1, 3), (6, "f", 2, 4)]))
    assert [size for _, size in family.levels] == [4, 1]
    met = lambda f: sorted((r.gram, bytes(r.stretch).decode().strip(), r.n, r.lone) for r in f.common().collect())
    assert met(family) == [(1, "a", 2, False), (6, "f", 2, False)]
    family.close(keep=True)
    again = repeats.Family(spark, path, 3)
    assert [size for _, size in again.levels] == [4, 1]
    again.add(of([(3, "x", 1, 0), (9, "y", 1, 0)]))
    assert [size for _, size in again.levels] == [4, 2]
    assert met(again) == [(1, "a", 2, False), (3, "c", 1, True), (3, "x", 1, True), (6, "f", 2, False)]
    again.close()


def test_parts_sample_every_window(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000, np.uint8).tobytes()
    monkeypatch.setattr(repeats, "PART", 1000)
    runs = [(int(f) + at, int(last) + at) for at, part in repeats.parts(data, 200) for f, last in zip(*repeats.sampled(part, 200, 64)[1:3])]
    assert [x for a, b in runs for x in range(a, b + 1)] == list(range(4801))


def test_short_texts_are_sampled_together(monkeypatch):
    """Texts in a row are hashed at once and sampled as each would be alone."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcé "), int(n))) for n in rng.integers(0, 900, 300)] + ["", "x" * 5000, ""]
    alone = []
    for i, text in enumerate(texts):
        for at, part in repeats.parts(text.encode(), 200):
            place, first, last, key = repeats.sampled(part, 200, 64)
            alone += zip([i] * len(place), (place + at).tolist(), (first + at).tolist(), (last + at).tolist(), key.tolist())
    calls, hashes = [], repeats.gram_hashes
    monkeypatch.setattr(repeats, "gram_hashes", lambda data, gram: calls.append(len(data)) or hashes(data, gram))
    data, bounds = repeats.bytes_of(pa.array(["left out", *texts])[1:])
    together = []
    for row, at, part, inner in repeats.packs(data, bounds, 200):
        place, first, last, key = repeats.sampled(part, 200, 64, inner)
        own = repeats.text_of(place, inner)
        back = at - inner[own]
        together += zip((row + own).tolist(), (place + back).tolist(), (first + back).tolist(), (last + back).tolist(), key.tolist())
    assert together == alone and len(calls) <= 1 + sum(len(t.encode()) for t in texts) // (repeats.PACK // 2)


def test_cut_joins_runs_that_touch():
    texts = ["abcdefghij", "é" * 6, "klmnopqrst"]
    runs = [[(4, 6), (0, 2), (2, 3), (0, 1)], [(0, 12)], [(9, 10), (1, 5), (2, 4)]]
    runs = pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    batch = pa.record_batch([pa.array([7, 8, 9]), pa.array(texts), runs], ["no", "text", "runs"])
    (out,) = repeats._cut(True)([batch])
    assert out.column("kept").to_pylist() == [b"dghij", b"", b"kpqrs"]
    assert [[(x["start"], x["end"]) for x in r] for r in out.column("spans").to_pylist()] == [[(0, 3), (4, 6)], [(0, 12)], [(1, 5), (9, 10)]]
    assert out.column("n_removed").to_pylist() == [5, 12, 5] and out.column("n_spans").to_pylist() == [2, 1, 2]
    assert out.column("kept_sha256").to_pylist() == [hashlib.sha256(x).hexdigest() for x in (b"dghij", b"", b"kpqrs")]
