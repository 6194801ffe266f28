"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and prefixes of words, that come up far more often in toxic labelled texts
than in others, with their log odds. A text's features are the densities of lexicon words and prefixes by
strength, how often a lexicon word stands near a word of the second person, and the rates of capitals,
punctuation and obfuscation (symbols or digits inside words, stretched letters, words that are in the
lexicon only after such disguise is taken off). The trees' scores are calibrated by isotonic regression on
unseen rows: the labelled rows are cut into ``FOLDS`` folds by a hash of their key, and a fold's scores for the
calibration come from a lexicon and trees that are fitted to the other folds alone. The lexicon and the trees
that score are fitted to all.

The classifier is fitted on at most about ``PER_CLASS`` labelled rows of each class; lexicon counts are
gathered on the executors and at most ``LEXICON`` entries come to the driver. Scoring is one map over the
rows without a shuffle; whole texts are read.

Defined results: null and empty texts get the score of an empty text; null labels and labels of unknown
documents are left out; of several labels of a document the greatest counts; with no labels at all the
score is 0. Repeated rows get equal rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import bounded_sample, checkpoint, chunks, held_out

#: Bounds: labelled rows of a class, entries of the lexicon.
PER_CLASS, LEXICON = 4000, 3000
#: Folds of the labelled rows.
FOLDS = 4
#: An entry has this log odds at least, and comes up in so many toxic texts.
ODDS, SEEN = 1.0, 4
PREFIXES = range(3, 8)

# Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine deiner ihr euch euer eure sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra".split())
# Characters that stand for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "*": None, ".": None, "-": None, "_": None})

_WORD = re.compile(r"[^\x00-\x20]+")
_EDGE = "\"'()[]{}<>.,;:!?%&#*$-_/|\\"
_STRETCH = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[a-z][0-9@$!*|._-]+[a-z]")


def words(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w.strip(_EDGE) for w in _WORD.findall(text.lower())]


@dataclass
class Lexicon:
    whole: dict[str, float]
    prefix: dict[str, float]

    def weight(self, word: str) -> tuple[float, float]:
        """The log odds of the word, and of its most telling prefix."""
        return self.whole.get(word, 0.0), max((self.prefix.get(word[:k], 0.0) for k in PREFIXES if k <= len(word)), default=0.0)


NAMES = ["words", "whole_sum", "whole_max", "whole_strong", "whole_strong_rate", "prefix_sum", "prefix_max", "prefix_strong", "prefix_strong_rate", "prefix_kinds", "near_you", "you_rate", "capitals", "shouted", "punctuation", "exclaims", "symbols", "digits", "inner_marks", "stretched", "disguised", "word_length"]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, in the order of NAMES."""
    text = text or ""
    found = words(text)
    count, n = Counter(found), max(1, len(found))
    sums, tops, strong, kinds = [0.0, 0.0], [0.0, 0.0], [0, 0], 0
    hot, inner, stretched, disguised, you = set(), 0, 0, 0, 0
    for w, c in count.items():
        odds = lexicon.weight(w)
        for k in (0, 1):
            if odds[k]:
                sums[k] += c * odds[k]
                tops[k] = max(tops[k], odds[k])
                if odds[k] >= 2:
                    strong[k] += c
                    hot.add(w)
        kinds += odds[1] >= 2
        you += c * (w in SECOND_PERSON)
        if not w.isalpha() and w:
            if _INNER.search(w):
                inner += c
            plain = w.translate(DISGUISE)
            if plain != w and lexicon.whole.get(plain, 0.0) >= 2:
                disguised += c
        if _STRETCH.search(w):
            stretched += c
            if lexicon.whole.get(_STRETCH.sub(r"\1", w), 0.0) >= 2:
                disguised += c
    near = 0
    if hot and you:
        places = np.array([i for i, w in enumerate(found) if w in SECOND_PERSON])
        at = np.array([i for i, w in enumerate(found) if w in hot])
        right = np.searchsorted(places, at)
        gap = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - at), np.abs(places[np.maximum(right - 1, 0)] - at))
        near = int((gap <= 5).sum())
    b = np.frombuffer(text.encode(), np.uint8)
    kind = np.bincount(_CLASS[b], minlength=7)
    letters, size = max(1, kind[0] + kind[1] + kind[6]), max(1, len(b))
    shouted = sum(c for w, c in Counter(_WORD.findall(text)).items() if len(w) > 2 and w.isupper())
    return [np.log1p(len(found)), sums[0] / n, tops[0], np.log1p(strong[0]), strong[0] / n, sums[1] / n, tops[1], np.log1p(strong[1]), strong[1] / n, kinds, near / n, you / n,
            kind[1] / letters, shouted / n, (kind[2] + kind[3]) / size, kind[3] / size, kind[4] / size, kind[5] / size, inner / n, stretched / n, disguised / n, len(text) / n]


#: 0 small letters, 1 capitals, 2 punctuation, 3 exclamation and question marks, 4 symbols, 5 digits, 6 other bytes of letters
_CLASS = np.full(256, 6, np.uint8)
_CLASS[:33] = 2
_CLASS[[10, 13, 9, 32]] = 2
_CLASS[33:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 5
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 2
_CLASS[[ord(c) for c in "!?"]] = 3


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: gbt.Trees
    map: gbt.Isotonic

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.map(self.trees.probability(np.array([features(t, self.lexicon) for t in texts], np.float64)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", per_class: int = PER_CLASS) -> Scorer:
    """Fit on a bounded sample of the labelled documents."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label)).cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("k", F.lit("fold")), F.lit(FOLDS)).cast("int")
    # narrow rows, at most 1.2 times as many as asked for
    picked = checkpoint(bounded_sample(known, "k", "y", per_class).withColumn("fold", fold))
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k").select("y", "fold", "t")
    sizes, whole = np.zeros((2, FOLDS)), [0, 0]
    for y, f, n in picked.groupBy("y", "fold").count().collect():
        sizes[int(y == 1), f] += n
    for y, n in known.groupBy("y").count().collect():
        whole[int(y == 1)] += n
    lexicons = [Lexicon({t[1:]: o for t, o in top if t[0] == "w"}, {t[1:]: o for t, o in top if t[0] == "p"}) for top in _terms(sample, sizes)]
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def dense(batches):
        for b in chunks(batches, column=2):
            x = [[v for lexicon in shared.value for v in features(t, lexicon)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "fold", "x"])

    rows = sorted((list(r.x), r.fold, r.y) for r in sample.mapInArrow(dense, "y int, fold int, x array<double>").collect())
    if not rows:
        return Scorer(lexicons[-1], gbt.Trees(-30.0), gbt.Isotonic(np.array([0.0, 1.0]), np.array([0.0, 0.0])))
    x, y, of = np.array([r[0] for r in rows]).reshape(len(rows), len(lexicons), len(NAMES)), np.array([r[2] for r in rows], float), np.array([r[1] for r in rows])
    unseen = np.zeros(len(y))
    for f in range(FOLDS):
        if (of == f).any():
            unseen[of == f] = gbt.fit(x[of != f, f], y[of != f]).probability(x[of == f, f])
    # a class of which the sample holds a part only counts in full for the probabilities
    weight = np.where(y == 1, *(max(1.0, whole[k] / max(1, sizes[k].sum())) for k in (1, 0)))
    return Scorer(lexicons[-1], gbt.fit(x[:, -1], y), gbt.isotonic(unseen, y, weight))


def _terms(sample: DataFrame, sizes: np.ndarray):
    """For each fold the best terms of the others with their log odds, and at last those of all folds."""

    def terms(batches):
        for b in chunks(batches, column=2):
            for y, f, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                seen = {w for w in words(t or "") if w}
                out = [f"w{w}" for w in seen] + list({f"p{w[:k]}" for w in seen for k in PREFIXES if k <= len(w)})
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out), pa.array([y] * len(out), pa.int32()), pa.array([f] * len(out), pa.int32())], ["term", "y", "fold"])

    counts = [F.count_if((F.col("y") == y) & (F.col("fold") != f)).alias(f"n{y}_{k}") for k, f in enumerate((*range(FOLDS), -1)) for y in (0, 1)]
    by_term = checkpoint(sample.mapInArrow(terms, "term string, y int, fold int").groupBy("term").agg(*counts).where(F.col(f"n1_{FOLDS}") >= SEEN))
    for k in range(FOLDS + 1):
        others = sizes.sum(axis=1) - (sizes[:, k] if k < FOLDS else 0)
        bad, good = F.col(f"n1_{k}"), F.col(f"n0_{k}")
        odds = F.log((bad + 0.5) / F.lit(max(1, int(others[1])) + 1.0)) - F.log((good + 0.5) / F.lit(max(1, int(others[0])) + 1.0))
        top = by_term.where(bad >= SEEN).select("term", odds.alias("odds"), bad.alias("n")).where(F.col("odds") >= ODDS)
        yield top.orderBy((F.col("odds") * F.sqrt("n")).desc(), "term").limit(LEXICON).select("term", "odds").collect()


def score(docs: DataFrame, model: Scorer, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist()))], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's form: learn from the labels of rows that are not held out, score all."""
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
