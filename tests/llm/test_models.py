import numpy as np
import pytest

from lodestone.llm import language_id, toxicity

INSULTS = ["blockhead", "numbskull", "dimwit"]


def sentence(rng, letters, n=40):
    return " ".join("".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    clean = [sentence(rng, "aeiourstlnhd") for _ in range(300)]
    toxic = []
    for _ in range(150):
        w = sentence(rng, "aeiourstlnhd").split()
        for i in rng.choice(len(w), 3, False):
            w[i] = rng.choice(INSULTS)
        toxic.append(" ".join(w))
    return clean, toxic


def test_kernel_is_the_sum_over_common_subsequences():
    from itertools import combinations

    def plain(s, t, decay=0.6):
        def parts(w):
            out = {}
            for i, j, k in combinations(range(len(w)), 3):
                u = w[i] + w[j] + w[k]
                out[u] = out.get(u, 0) + decay ** (k - i + 1)
            return out

        a, b = parts(s), parts(t)
        dot = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
        return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))

    marks, words = ["idiot", "aaaa", "straße"], ["idiot", "id-iot", "aaab", "éàß", "strasse", "xyz"]
    k = toxicity.Kernel(marks)
    assert np.allclose(k(words), [[plain(w, m) for m in marks] for w in words], atol=1e-5)
    assert np.allclose(k.sums(words, k.table @ np.array([1.0, -2.0, 0.5])), k(words) @ [1, -2, 0.5], atol=1e-5)


def test_toxicity(spark, texts):
    clean, toxic = texts
    rows = [(i, t, 0) for i, t in enumerate(clean)] + [(1000 + i, t, 1) for i, t in enumerate(toxic)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "q", "x"), (5000, None, "x")], "doc_id long, text string, toxic_score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3 != 1] + [(None, 1), (5000, 0), (77777, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    unseen = [(i, t, y) for i, t, y in rows if i % 3 == 1]
    more = [(9000, "what a block-head you are", 1), (9001, "b l o c k h e a d", 1), (9002, None, 0), (9003, "", 0), (9004, "of", 0), (9005, "numbsskull " + clean[0] * 50, 1), (9006, "x" * 100_000, 0)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in unseen + more], "doc_id long, text string"), model).collect()}
    right = [got[i].toxic_predicted == y for i, _, y in unseen]
    assert np.mean(right) > 0.98
    assert all(0 <= r.toxic_score <= 1 and r.toxic_predicted == (r.toxic_score >= 0.7) for r in got.values())
    assert all(got[i].toxic_predicted == y for i, _, y in more if y == 0) and sum(got[i].toxic_predicted for i, _, y in more if y) >= 2
    nothing = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.toxic_score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.fit(docs.limit(0), labels.limit(0)).kernel is None


def test_language(spark):
    rng = np.random.default_rng(4)
    alphabets = {"en": "thesaonirw", "de": "enirstüäch", "fr": "éèlaeuxoin", "es": "ñaosdeclór", "zz": "qjxkvyzpgb"}
    rows = [(1000 * k + i, sentence(rng, a, int(rng.integers(5, 60))), lang) for k, (lang, a) in enumerate(alphabets.items()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 4 <> 2").unionByName(spark.createDataFrame([(None, None, "en"), (1, "123", "fr"), (2, "abc", None)], docs.schema)))
    got = language_id.identify(docs.where("doc_id % 4 = 2"), model).collect()
    of = {i: lang for i, _, lang in rows}
    assert np.mean([r.lang_pred == of[r.doc_id] for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !?", "a"), (None, "thesaon", "a"), (5, "ß" * 200_000, "a"), (5, "ß", "a")], "doc_id long, text string, score string")
    found = sorted((r.doc_id or 0, r.lang_pred) for r in language_id.identify(odd, model).collect())
    assert [x for x in found if x[1] == "und"] == [(1, "und"), (2, "und"), (3, "und")] and len(found) == 6
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(docs.limit(0))).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'fr'"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, one).collect()} == {("fr", 1.0)}
