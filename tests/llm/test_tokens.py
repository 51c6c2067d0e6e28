import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm.packing import minimum_bin_slack, pack
from lodestone.llm.token_counts import count_tokens
from lodestone.llm.words import Coder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "Hello, World!", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "ΟΔΟΣ ΟΔΟΣ.", "J̌ ǰ İstanbul", "a\x1cb c\x85d\xa0e　f​g", "it's we'll I'M don''t",
    "x" * 5000, "word " * 3000, "é ́e ﬁ ² ½ 12345", "Same text", "Same text", "a", "힣 \U0001f600\U0001f600 z",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def frame(spark, texts):
    return spark.createDataFrame([(i if i else None, t, "x", 3, 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, length int, n_tokens int").repartition(3)


def test_counts(spark, library):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(frame(spark, TEXTS), PATH).collect()}
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert got == {(i if i else None, len((t or "").encode()), c, c > 2048) for i, (t, c) in enumerate(zip(TEXTS, n, strict=True))}
    assert count_tokens(frame(spark, []), PATH).collect() == []


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=3))
def test_words_give_the_librarys_ids(texts):
    coder = Coder(PATH, room=4)
    library = Tokenizer.from_file(PATH) if not hasattr(test_words_give_the_librarys_ids, "t") else test_words_give_the_librarys_ids.t
    test_words_give_the_librarys_ids.t = library
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.ids(texts)] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.ids(texts)] == want


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12))
def test_bins(counts):
    made = minimum_bin_slack(counts, 40)
    used = defaultdict(int)
    for pattern, times in made:
        assert sum(n * c for n, c in pattern.items()) <= 40
        for n, c in pattern.items():
            used[n] += c * times
    assert used == counts
    if made:  # the first bin is as full as any that holds a longest piece
        pattern = made[0][0]
        sums = {0}
        for n, c in counts.items():
            for _ in range(c - (n == max(counts))):
                sums |= {s + n for s in sums if s + n <= 40 - max(counts)}
        assert sum(n * c for n, c in pattern.items()) == max(counts) + max(sums)


def test_packing(spark, library):
    docs = frame(spark, TEXTS * 3)
    rows = pack(docs, PATH, capacity=256, keep_ids=True).collect()
    of = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) <= 256
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        of[r.sequence_id].append((r.offset, r.length))
    for places in of.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(TEXTS * 3):
        if i:
            own = sorted(by[i], key=lambda r: r.piece)
            assert sum((r.ids for r in own), []) == library.encode(t or "", add_special_tokens=False).ids + [0]
            assert all(r.length == 256 for r in own[:-1]) and [r.start for r in own] == [256 * k for k in range(len(own))]
    total = sum(r.length for r in rows)
    assert len(of) <= -(-total // 256) + 1
    assert pack(frame(spark, []), PATH).collect() == []
