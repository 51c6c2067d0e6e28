import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p.lstrip("0")[:4] or 0) <= 255 for p in re.findall("[0-9]+", m[0])), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


CASES = [
    None, "", "x", "a@b.c_d@e.f a@b.c.@d.e @b.c a@b a@b.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 999999999999999999999.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111",
    "+1 (555) 123-4567 +1 +12345678901234567 ++49 30 123456 +1.(2)", "é\U0001f600 a@b.cd \U0001f600 +49 30 1234567é 10.0.0.1", "a" * 3000 + "@" + "b" * 3000 + ".c", "1" * 30000, "1 " * 20000, "a." * 20000 + "@", "+1" + "(" * 20000, "a@b.c" * 50, "4111111111111111\n4111111111111111",
]


def test_base(spark):
    rng = np.random.default_rng(6)
    texts = CASES + ["".join(rng.choice(list("1234@.+- ()ab\né"), 60)) for _ in range(800)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(None, "a@b.cd", "s", 1)] * 2, "doc_id long, text string, spans string, n_email int").repartition(4)
    rows = pii.find(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert [tuple(x) for x in r.spans if x.kind != pii.LEARNT] == plain(r.text)
    assert pii.find(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).collect() == []


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="12@.+- ()ab_", max_size=40))
def test_possessive_patterns_match_alike(text):
    for kind, pattern in pii.PATTERNS.items():
        ours = re.compile(pattern.replace(r"|\G)", "|(?!))"))  # re has no \G: then only starts of runs
        theirs = [m.span() for m in re.finditer(PLAIN[kind], text)]
        assert {m.span() for m in ours.finditer(text)} <= set(theirs)


def test_learning_and_redaction(spark):
    rows = [(i, f"foo bar my mail user{i}@site.org end") for i in range(30)] + [(100 + i, f"well my mail user{i}[at]site{i} end a{i}") for i in range(5)]
    rows += [(200 + i, f"chapter number {i}1111 of it and room number {i}2222") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i in range(5):
        assert [(x.kind, got[100 + i].text[x.start : x.end]) for x in got[100 + i].spans] == [(pii.LEARNT, f"user{i}[at]site{i}")]
    assert all(got[200 + i].spans == [] for i in range(20))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[3] == "foo bar my mail [EMAIL] end" and clean[101] == "well my mail [LEARNT] end a1" and clean[205] == rows[40][1]
    both = spark.createDataFrame([(1, "\U0001f600 +4111111111111111 a@b.cd"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(both).collect()} == {1: "\U0001f600 +[CARD] [EMAIL]", 2: None}


def card(i):
    digits = f"4{i:014}"
    return digits + str(next(c for c in range(10) if luhn(digits + str(c))))


def fours(x):
    return " ".join(x[i : i + 4] for i in range(0, len(x), 4))


def test_seeds_with_spaces_and_lists(spark):
    learnt = lambda r: [r.text[x.start : x.end] for x in r.spans if x.kind == pii.LEARNT]
    # cards and phones with spaces are seeds, the words before them a pattern
    rows = [(i, f"please charge card {fours(card(i))} now") for i in range(30)] + [(100 + i, f"please charge card acct{i}[x] now") for i in range(4)]
    rows += [(200 + i, f"you can call (+49 30 12345{i:02}) there") for i in range(30)] + [(300 + i, f"you can call desk{i}[x] there") for i in range(4)]
    # label, number, label, number: the number is one of the two words before
    rows += [(400 + i, f"card {card(i)} phone +49301234{i:03} mail u{i}@site.org") for i in range(30)] + [(500 + i, f"card {card(i)} phone desk{i}[x] mail") for i in range(4)]
    # two words of which one is longer than a window of characters
    rows += [(600 + i, f"at {'w' * 200} is u{i}@site.org") for i in range(30)] + [(700 + i, f"at {'w' * 200} is u{i}[at]site") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(got) == len(rows) and all([tuple(x) for x in r.spans if x.kind != pii.LEARNT] == plain(r.text) for r in got.values())
    for i in range(4):
        assert learnt(got[100 + i]) == [f"acct{i}[x]"] and learnt(got[300 + i]) == learnt(got[500 + i]) == [f"desk{i}[x]"] and learnt(got[700 + i]) == [f"u{i}[at]site"]
    assert not any(learnt(r) for i, r in got.items() if i // 100 % 2 == 0 and i % 100 < 30 and i not in range(100, 104))


def test_instances(spark):
    texts = ["My Card 4111 1111 1111 1111 and tel:+49 30 123456 or (a@b.cd), 12 ab34[x] cd56[x]", "one a@b.cd", "no 12 num77 it"]
    rows = pii.base(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "p_row long, text string"))
    got = sorted((r.p_row, r.value, r.before, r.after, r.seed) for r in pii.instances(rows).collect())
    want = [(0, "4111 1111 1111 1111", "my card", "and tel:+00", True), (0, "+49 30 123456", "and tel:", "or (a@b.cd),", True), (0, "a@b.cd", "000000 or", "00 ab00[x]", True)]
    want += [(0, "ab34[x", "(a@b.cd), 00", None, False), (0, "cd56[x", "00 ab00[x]", None, False), (2, "num77", "no 00", None, False)]
    assert got == sorted(want, key=lambda x: (x[0], x[1]))


def test_secrets_and_words_behind(spark):
    key = lambda i: f"{i:03}b{i * 7919 % 1000:03}adc0ffee{i:03}beef{i * 31 % 1000:03}c0de"
    rows = [(i, f'some words then token = "{key(i)}" and more') for i in range(20)] + [(100 + i, f'now token = "short{i}x9" again') for i in range(4)]
    # a shape that nothing but what stands behind gives away
    rows += [(200 + i, f"word{i} x u{i}@site.org is reachable by post") for i in range(20)] + [(300 + i, f"odd y u{i}[at]site is reachable by post") for i in range(4)]
    rows += [(400 + i, f"plain chapter {key(i)[:7]} of it") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(x.kind, r.text[x.start : x.end]) for x in r.spans] for r in pii.find(docs).collect()}
    assert all(got[i] == [(pii.LEARNT, f'"{key(i)}"')] for i in range(20))
    assert [got[300 + i] for i in range(4)] == [[(pii.LEARNT, f"u{i}[at]site")] for i in range(4)]
    assert all(not got[400 + i] for i in range(20))


def test_running_sums_over_chunks(spark):
    rows = [(i, [int(x) for x in np.random.default_rng(i).integers(0, 50, n)]) for i, n in enumerate((1, 2, 3, 4, 9, 700))]
    data = spark.createDataFrame(rows, "i int, x array<int>")
    for step in (3, 256):
        got = data.select("i", pii._running(data.x, lambda a, b: a + b, step).alias("s"), pii._running(data.x, pii.F.greatest, step).alias("m")).collect()
        for r in got:
            x = np.array(rows[r.i][1])
            assert r.s == np.cumsum(x).tolist() and r.m == np.maximum.accumulate(x).tolist()


def test_query(spark, tmp_path):
    import hashlib

    from lodestone.llm import queries

    texts = [None, "", "x a@b.cd y 10.0.0.1", "call +49 30 1234567 or 4111 1111 1111 1111"]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t))
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and got[i].spans == spans
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in plain(t)) for k in pii.KINDS]
