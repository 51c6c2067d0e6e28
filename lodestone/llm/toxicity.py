"""Toxicity by a subsequence string kernel, Nyström landmarks and a support
vector machine.

The kernel of two words sums, over their common subsequences of three
characters, decay ** (stretch in one + stretch in the other), and is scaled so
that a word's kernel with itself is 1. A gap or an inserted character lowers a
match instead of ending it. Landmarks are words of labelled texts; a word's
kernels with them, turned by the inverse square root of the landmarks' own
kernel matrix, are its features.

The machine is trained on labelled sentences by multiple instances: a sentence
is as toxic as its most toxic word. All words of a sentence of a clean text are
negative examples. A sentence of a toxic text gives one positive example, its
witness: a word that tells toxic texts from clean ones, or else one that the
machine of the last round is sure of; a sentence without either gives none.
A text scores as its most toxic sentence does. A word is scored once per worker and
remembered."""

from __future__ import annotations

import re
import string
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import svm
from .common import remembered
from .words import slices

#: Words of more characters are scored in pieces of so many, each starting half as many later.
WIDEST = 20
#: Words that a worker remembers, besides those of the texts at hand.
ROOM = 200_000
EDGES = string.punctuation + "¡¿«»“”„‘’…–—·•"
NO_LETTER = re.compile(r"[\W_]+")
#: Three words in a row of one or two characters; then, runs of three or more single letters.
SHORT = re.compile(r"(?:^|\s)\S\S?\s+\S\S?\s+\S\S?(?:\s|$)")
SPELT = re.compile(r"(?<!\S)(?:[^\W\d_][.,*_-]?\s+){2,}[^\W\d_](?!\w)")
#: The first letters of longer words also count as a word: insults of inflected languages share a stem.
STEM = 5
FLOOR = -3.0
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Standard errors by which a word's share of toxic texts must exceed that of clean ones.
TELLING = 4.0


def units(text: str | None) -> set[str]:
    """The distinct words of a text in lower case without punctuation at their
    ends, and without any, their stems, and runs of three or more single letters
    as one word."""
    text = (text or "").lower()
    found = {w.strip(EDGES) for w in set(text.split())}
    found.update([NO_LETTER.sub("", w) for w in found if not w.isalnum()])
    if SHORT.search(text):
        found.update(NO_LETTER.sub("", m) for m in SPELT.findall(text))
    if max(map(len, found), default=0) > WIDEST:
        for w in [w for w in found if len(w) > WIDEST]:
            found.remove(w)
            found.update(_pieces(w))
    found.update([w[:STEM] for w in found if len(w) > STEM])
    return {w for w in found if len(w) > 2}


def _pieces(word: str) -> list[str]:
    """Overlapping pieces that together are the whole word."""
    if len(word) <= WIDEST:
        return [word]
    return [word[i : i + WIDEST] for i in range(0, len(word) - WIDEST // 2, WIDEST // 2)]


def sentences(text: str | None, most: int) -> list[list[str]]:
    """The units of each sentence of a text; of more than `most` sentences, so many spread over it."""
    parts = [p for p in SENTENCE.split(text or "") if p and not p.isspace()]
    if len(parts) > most:
        parts = [parts[i * len(parts) // most] for i in range(most)]
    return [sorted(units(p)) for p in parts]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of equal length and their characters."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), n)


def _own(codes: np.ndarray, decay: float) -> np.ndarray:
    """Square roots of words' kernels with themselves, by dynamic programming
    over pairs of positions: [i, j] holds what ends at i in the one copy and at j in the other."""
    n = codes.shape[1]
    gap = np.arange(n)[None, :] - np.arange(n)[:, None]
    before = np.where(gap > 0, decay ** np.maximum(gap - 1, 0), 0).astype(np.float32)
    match = (codes[:, :, None] == codes[:, None, :]).astype(np.float32) * np.float32(decay * decay)
    now = match
    for _ in range(2):
        now = np.swapaxes((now.reshape(-1, n) @ before).reshape(match.shape), 1, 2)
        now = np.swapaxes((now.reshape(-1, n) @ before).reshape(match.shape), 1, 2) * match
    return np.sqrt(np.maximum(now.sum(axis=(1, 2), dtype=np.float64), 1e-12))


class Kernel:
    """Kernels of words with landmarks. A kernel is an inner product over
    triples of characters, so the landmarks' triples with their weights are
    kept as rows of a table, and a word adds up the rows of its own triples."""

    def __init__(self, landmarks: list[str], decay: float = 0.6):
        self.decay = decay
        self.letters = np.array(sorted({ord(c) for w in landmarks for c in w}), np.uint32)
        rows: dict[int, np.ndarray] = {}
        for k, word in enumerate(landmarks):
            codes = np.array([[ord(c) for c in word]], np.uint32)
            norm = _own(codes, decay)[0]
            for i, j, m in combinations(range(len(word)), 3):
                at = int(self._triples(self._letters(codes), i, j, m)[0])
                rows.setdefault(at, np.zeros(len(landmarks), np.float32))[k] += decay ** (m - i + 1) / norm
        self.place = np.zeros((len(self.letters) + 1) ** 3, np.int32)
        self.place[list(rows)] = np.arange(1, len(rows) + 1)
        self.table = np.vstack([np.zeros((1, len(landmarks)), np.float32), *[r[None] for r in rows.values()]])

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the landmarks' letters from 1, and 0 for any other character."""
        at = np.searchsorted(self.letters, codes)
        return np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == codes, at + 1, 0)

    def _triples(self, letters: np.ndarray, i: int, j: int, m: int) -> np.ndarray:
        size = len(self.letters) + 1
        return (letters[:, i] * size + letters[:, j]) * size + letters[:, m]

    def sums(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """The kernels' sum with one weight for each row of the table."""
        out, dense = np.zeros(len(words), np.float32), weights.astype(np.float32)[self.place]
        for rows, codes in _by_length(words):
            i, j, m = np.array(list(combinations(range(codes.shape[1]), 3)), int).T
            decays = (self.decay ** (m - i + 1)).astype(np.float32)
            step = max(1, 1_000_000 // len(i))
            for at in range(0, len(rows), step):
                part = codes[at : at + step]
                letters = self._letters(part).astype(np.int32)
                out[rows[at : at + step]] = dense[self._triples(letters, i, j, m)] @ decays / _own(part, self.decay)
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        """Kernels with each landmark."""
        table = self.table
        out = np.zeros((len(words), table.shape[1]), np.float32)
        for rows, codes in _by_length(words):
            for at in range(0, len(rows), 2000):
                part = codes[at : at + 2000]
                letters, sums = self._letters(part), np.zeros((len(part), table.shape[1]), np.float32)
                for i, j, m in combinations(range(codes.shape[1]), 3):
                    if (found := self.place[self._triples(letters, i, j, m)]).any():
                        sums += np.float32(self.decay ** (m - i + 1)) * table[found]
                out[rows[at : at + 2000]] = sums / _own(part, self.decay)[:, None]
        return out


class Model:
    """What fit() learnt: landmarks, the word machine and the calibration."""

    def __init__(self, landmarks: list[str], base: float):
        self.kernel, self.base = Kernel(landmarks) if landmarks else None, base
        if landmarks:
            values, vectors = np.linalg.eigh(self.kernel(landmarks).astype(np.float64))
            kept = values > 1e-2
            self.turn = vectors[:, kept] / np.sqrt(values[kept])
        self.w = self.beta = self.bias = 0.0
        self.slope = self.shift = 0.0
        self.name = uuid.uuid4().hex

    def features(self, words: list[str]) -> np.ndarray:
        return (self.kernel(words) @ self.turn).astype(np.float32)

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.w, self.bias = svm.fit_small(x, y, weight)
        self.beta = self.kernel.table @ (self.turn @ self.w)

    def margins(self, words: list[str]) -> np.ndarray:
        return self.kernel.sums(words, self.beta) + self.bias

    def score(self, texts: list[str | None]) -> list[float]:
        """Each text's score, 0 to 1."""
        if not self.kernel:
            return [self.base] * len(texts)
        split = [units(t) for t in texts]
        known = remembered(("toxicity", self.name), dict)
        if len(known) > ROOM:
            known.clear()
        new = [*{w for s in split for w in s if w not in known}]
        known.update(zip(new, self.margins(new).tolist(), strict=True))
        z = np.array([max(map(known.__getitem__, s), default=FLOOR) for s in split])
        return (1 / (1 + np.exp(-np.clip(self.slope * np.maximum(z, FLOOR) + self.shift, -30, 30)))).tolist()


class Bags:
    """The distinct words of some sentences of some texts, as numbers of a vocabulary."""

    def __init__(self, column: pa.ListArray):
        """column: for each text a list of sentences, which are lists of words."""
        inner = column.flatten()
        coded = inner.flatten().dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy()
        size = lambda c: np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64))])
        self.bounds = size(inner)
        self.first = size(column)
        self.text = np.repeat(np.arange(len(column)), np.diff(self.first))

    def of(self, i: int) -> np.ndarray:
        """The distinct words of a text."""
        return np.unique(self.codes[self.bounds[self.first[i]] : self.bounds[self.first[i + 1]]])

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """In how many of these texts each word occurs."""
        out = np.zeros(len(self.words), np.int64)
        for i in rows:
            out[self.of(i)] += 1
        return out

    def witnesses(self, values: np.ndarray) -> np.ndarray:
        """The word of highest value in each sentence, -1 in one without words."""
        out = np.full(len(self.bounds) - 1, -1)
        some = np.flatnonzero(np.diff(self.bounds))
        if len(some):
            own = values[self.codes]
            highest = np.repeat(np.maximum.reduceat(own, self.bounds[some]), np.diff(self.bounds)[some])
            at = np.flatnonzero(own == highest)
            sentence = np.repeat(some, np.diff(self.bounds)[some])[at]
            out[sentence[::-1]] = self.codes[at[::-1]]  # the first one of equal words
        return out

    def highest(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Each of these texts' highest value over its words."""
        return np.array([max(FLOOR, float(values[self.of(i)].max(initial=FLOOR))) for i in rows])

    def apart(self, alike: float = 0.6) -> np.ndarray:
        """The texts that resemble none before them, by 32 minima of hashes:
        copies of one text must not make its chance words look telling."""
        hashes = np.random.default_rng(5).integers(0, 1 << 32, (len(self.words) + 1, 32), np.uint32)
        minima = np.empty((len(self.first) - 1, 32), np.uint32)
        kept: list[int] = []
        for i in range(len(minima)):
            own = self.of(i)
            own = hashes[own if len(own) else [-1]].min(axis=0)
            if not kept or (minima[: len(kept)] == own).mean(axis=1).max() < alike:
                minima[len(kept)] = own
                kept.append(i)
        return np.array(kept, int)


def _landmarks(words: list[str], there: np.ndarray, elsewhere: np.ndarray, p: int, n: int, most: int, candidates: int) -> tuple[list[str], np.ndarray]:
    """Words that tell toxic texts from clean ones, then the clean words that
    are most like them; and how telling each word is, in standard errors.
    there and elsewhere: how many of the p toxic and n clean texts have it."""
    q = (there + elsewhere) / (p + n)
    telling = (there / p - elsewhere / n) / np.sqrt(np.maximum(q * (1 - q), 1e-12) * (1 / p + 1 / n))
    telling[(there < 3) | (there / p <= 4 * elsewhere / n)] = 0
    first = sorted(np.flatnonzero(telling > TELLING), key=lambda i: (-telling[i], words[i]))[:candidates]
    if not first:
        return [], telling
    like = Kernel([words[i] for i in first])([words[i] for i in first])
    kept: list[int] = []
    for i in range(len(first)):
        if len(kept) < most * 2 // 3 and (not kept or like[i, kept].max() < 0.8):
            kept.append(i)
    chosen = [words[first[i]] for i in kept]
    others = sorted(np.flatnonzero((elsewhere > 0) & (telling == 0)), key=lambda i: (-elsewhere[i], words[i]))[: 50 * candidates]
    if others:
        near = Kernel(chosen)([words[i] for i in others]).max(axis=1)
        chosen += [words[others[i]] for i in np.argsort(-near, kind="stable")[: most - len(chosen)]]
    return chosen, telling


def _gapped(word: str) -> list[str]:
    """A word with one character put in at each place in turn, or a mark at all."""
    made = [*(word[:i] + "x*e.h-"[i % 6] + word[i:] for i in range(1, len(word))), ".".join(word), "-".join(word)]
    return [piece for w in made for piece in _pieces(w)[:1]]


def _learn(labels: np.ndarray, bags: Bags, base: float, landmarks: int, candidates: int, negatives: int, rounds: int) -> Model:
    """The machine for the bags of texts with these labels."""
    rows = bags.apart()
    toxic, clean = rows[labels[rows] == 1], rows[labels[rows] == 0]
    if not len(toxic) or not len(clean):
        return Model([], base)
    elsewhere = bags.counts(clean)
    chosen_words, telling = _landmarks(bags.words, bags.counts(toxic), elsewhere, len(toxic), len(clean), landmarks, candidates)
    model = Model(chosen_words, base)
    if not chosen_words:
        return model
    used = np.zeros(len(labels), bool)
    used[rows] = True
    inside = used[bags.text] & (labels[bags.text] == 1)
    # each word of a sentence of a clean text is a negative example, and weighs as the root of its texts; those far from all landmarks are left to the bias
    against = np.flatnonzero((elsewhere > 0) & (telling <= TELLING))
    near = np.concatenate([np.zeros(0, np.float32), *(model.kernel([bags.words[i] for i in against[k : k + 20_000]]).max(axis=1) for k in range(0, len(against), 20_000))])
    against = against[np.argsort(-near, kind="stable")[:negatives]]
    x_against = model.features([bags.words[i] for i in against])
    worth = np.where(telling > TELLING, telling, -1.0)
    for _ in range(rounds):
        # of a sentence of a toxic text one word is a positive example, if there is one to be had
        witness = bags.witnesses(worth)
        witness = witness[inside & (witness >= 0)]
        words, times = np.unique(witness[worth[witness] > 0], return_counts=True)
        gapped = [_gapped(bags.words[i]) for i in words]
        x = np.concatenate([model.features([bags.words[i] for i in words] + [w for g in gapped for w in g]), x_against])
        y = np.array([1] * (len(x) - len(against)) + [-1] * len(against))
        seen = np.sqrt(times)
        weight = np.concatenate([seen, np.repeat(seen / 40, [len(g) for g in gapped]), np.sqrt(elsewhere[against])])
        for _ in range(2):  # words of clean sentences that come near weigh more the second time
            model.learn(x, y, weight)
            weight = np.where((y < 0) & (x @ model.w + model.bias > -0.5), weight * 5, weight)
        margins = model.margins(bags.words)
        # sentences without a telling word, such as those with a disguised one, find their witness by the machine
        worth = np.where(telling > TELLING, 10 + margins, np.where((margins > 1) & (elsewhere == 0), margins, -1.0))
    model.slope, model.shift = svm.calibrate(bags.highest(margins, rows), labels[rows].astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500, landmarks: int = 192, per_text: int = 400, candidates: int = 400, negatives: int = 30_000, rounds: int = 2) -> Model:
    """Learn from labelled sentences of the texts of docs (doc_id, text) whose
    doc_id labels (doc_id, toxic 0 or 1) name.

    What is gathered is bounded: of each label at most `most` texts, those with
    the lowest hashes of doc_id and text, of each at most `per_text` sentences
    spread over it; as landmarks at most `candidates` telling words and 50
    times as many frequent clean words come into question; of the words of
    clean sentences the `negatives` nearest to a landmark are learnt from.
    Positive sentences count once more with a character put into their witness. Nulls
    teach nothing. Without a toxic and a clean text, or without a word that
    tells them apart, every text scores the share of toxic labels."""
    labels = labels.select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").distinct()
    counts = dict(labels.groupBy("toxic").agg(F.count("*")).collect())  # two rows at most
    lowest = lambda *by: F.row_number().over(Window.partitionBy("toxic").orderBy(*by))
    chosen = labels.withColumn("place", lowest(F.xxhash64("doc_id"), "doc_id")).where(F.col("place") <= most).drop("place")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    chosen = texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * most rows are sent
    chosen = chosen.withColumn("place", lowest(F.xxhash64("doc_id"), F.xxhash64("text"))).where(F.col("place") <= most).select("text", "toxic")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sentences(t.as_py(), per_text) for t in batch.column(0)]
            yield pa.record_batch([batch.column(1), pa.array(made, pa.list_(pa.list_(pa.string())))], ["toxic", "units"])

    got = chosen.mapInArrow(split, "toxic int, units array<array<string>>").toArrow()
    if not got.num_rows:
        return Model([], 0.0)
    labels, bags = got["toxic"].to_numpy(), Bags(got["units"].combine_chunks())
    del got
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    return _learn(labels, bags, base, landmarks, candidates, negatives, rounds)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The columns of docs with toxic_score (0 to 1) and toxic_predicted (1 from
    `threshold`, else 0), from the whole text alone, however long: words of
    over WIDEST characters count by overlapping pieces. A null or wordless text
    scores as one without any toxic word; all rows, null doc_ids and repeated
    rows too, stay as they are; an empty table gives an empty one; columns of
    the two names are replaced."""
    docs = docs.drop("toxic_score", "toxic_predicted")
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())])
    at, names = docs.columns.index("text"), docs.columns

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value  # one per worker, with the words it remembers
        for batch in batches:
            for a, b in slices(batch.column(at), 4_000_000):
                part = batch.slice(a, b - a)
                values = np.array(own.score(part.column(at).to_pylist()), np.float64)
                yield pa.record_batch([*part.columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))], [*names, "toxic_score", "toxic_predicted"])

    return docs.mapInArrow(rate, schema)
