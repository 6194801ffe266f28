"""Language identification by nearest clustered centroids of TF-IDF n-gram vectors.

A text becomes a vector of hashed n-grams (one to three UTF-8 bytes, lower case, everything in ASCII
that is no letter counting as a space), weighted by sublinear term frequency and inverse document
frequency and scaled to length one. Each language has several centroids, found by spherical k-means.
A text gets the language of the centroid with the greatest cosine; it is *rejected* if that cosine is
below the language's own distance bound, or if it has no letters at all.

The centroids are fitted on at most ``per_lang`` labelled rows a language, fewer of each where there are many
languages (``MAX_ROWS`` in all, of which each of as many languages has one); the document frequencies are those of all labelled rows. Prediction is
one map over the rows: no shuffle, memory bounded by one chunk of texts.

Defined results: null text, empty text and text without letters: ``und``, score 0, rejected. Rows that
repeat get equal results. With no labelled row every text is ``und``. Other columns of the input are
ignored by ``predict`` and kept by ``filter_known``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, chunks, held_out, utf8

#: Hashed n-gram dimensions.
DIM = 8192
#: Bounds of the labelled sample that the classifier is fitted on.
PER_LANG, MAX_ROWS = 400, 4000
#: Texts that are counted at a time (DIM counts each).
ROWS = 256
#: Centroids of one language.
CENTROIDS = 4
#: A text is rejected below this share of the least cosine that the language's training rows have; the
#: bound shrinks with the root of the distinct n-grams below FULL, as the cosine of a short text does.
REJECT_SHARE, FULL = 0.6, 400

_LETTER = regex.compile(r"\p{L}")
_MAP = np.full(256, 32, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram counts (rows x DIM, float32) of the texts in ``data``."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    b = _MAP[data]
    if len(b) > 1:  # capitals of the Latin-1 block
        up = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) + 1
        b[up] += 0x20
        keep = np.ones(len(b), bool)
        keep[1:] = ~((b[1:] == 32) & (b[:-1] == 32) & (row[1:] == row[:-1]))
        b, row = b[keep], row[keep]
    key = b.astype(np.uint32)
    out = np.zeros(n * DIM, np.float32)
    base = row * DIM
    for size in (1, 2, 3):
        if size > 1:
            if len(b) < size:
                break
            key = key[:-1] * np.uint32(256) + b[size - 1 :]
            same = row[: len(key)] == row[size - 1 :]
        else:
            same = b != 32
        h = ((key + np.uint32(size << 28)) * np.uint32(2654435761)) >> np.uint32(19)
        out += np.bincount((base[: len(key)] + h)[same], minlength=n * DIM)
    return out.reshape(n, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Centroids:
    langs: list[str]
    idf: np.ndarray
    vectors: np.ndarray  # centroids x DIM
    owner: np.ndarray  # index into langs
    least: np.ndarray  # the cosine below which a centroid rejects

    def vectorise(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = counts(data, offsets)
        np.log1p(x, out=x)
        x *= self.idf
        return _unit(x)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, rejected."""
        if not self.langs:
            none = np.zeros(len(offsets) - 1)
            return none.astype(int), none, none == 0
        vectors = self.vectorise(data, offsets)
        cos = vectors @ self.vectors.T
        best = cos.argmax(axis=1)
        top = cos[np.arange(len(best)), best]
        distinct = (vectors > 0).sum(axis=1)
        return self.owner[best], np.clip(top, 0, 1), top < self.least[best] * np.minimum(1, np.sqrt(distinct / FULL))


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from rows far from each other."""
    centres = [_unit(x.mean(axis=0, keepdims=True))[0]]
    for _ in range(1, min(k, len(x))):
        centres.append(x[int((x @ np.array(centres).T).max(axis=1).argmin())])
    c = np.array(centres)
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with n-grams (column ``t``), and how many of them hold each n-gram."""

    def run(batches):
        seen = np.zeros(DIM + 1, np.int64)
        for b in chunks(batches, column=0, rows=ROWS):
            has = counts(*utf8(b.column(0))) > 0
            seen[:-1] += has.sum(axis=0)
            seen[-1] += has.any(axis=1).sum()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["at", "n"])

    sums = np.zeros(DIM + 1)
    for at, n in texts.select("t").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        sums[at] = n
    return int(sums[-1]), sums[:-1]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG, centroids: int = CENTROIDS) -> Centroids:
    """Fit centroids on a bounded sample of the labelled rows of ``docs``, with the document frequencies of all. The executors make the n-gram counts."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    # the sample has up to 1.2 times what it is asked for
    most = max(1, min(per_lang, int(MAX_ROWS / 1.2 / max(1, known.select("l").distinct().count()))))
    picked = bounded_sample(known, "k", "l", most, "t", MAX_ROWS).select("l", "t").repartition(8)

    def sparse(batches):
        for b in chunks(batches, rows=ROWS):
            for l, c in zip(b.column(0).to_pylist(), counts(*utf8(b.column(1)))):
                at = np.flatnonzero(c).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([l]), pa.array([at.tobytes()]), pa.array([c[at].tobytes()])], ["l", "at", "c"])

    # about 3 KB a row, in an order of its own so that the fit doesn't hang on that of the tasks
    rows = sorted((l, bytes(at), bytes(c)) for l, at, c in picked.mapInArrow(sparse, "l string, at binary, c binary").collect() if at)
    langs = sorted({r[0] for r in rows})
    if not rows:
        return Centroids([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    x = np.zeros((len(rows), DIM), np.float32)
    for i, (_, at, c) in enumerate(rows):
        at = np.frombuffer(at, np.uint16)
        x[i, at] = np.frombuffer(c, np.float32)
    n, seen = frequencies(known)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(1)
    np.log1p(x, out=x)
    x *= idf
    for row in x:
        row /= np.linalg.norm(row) or 1
    vectors, owner, least = [], [], []
    label = np.array([langs.index(r[0]) for r in rows])
    for i in range(len(langs)):
        own = x[label == i]
        c = _kmeans(own, centroids)
        floor = float(((own @ c.T).max(axis=1) / np.minimum(1, np.sqrt((own > 0).sum(axis=1) / FULL))).min())
        vectors.append(c)
        owner += [i] * len(c)
        least += [REJECT_SHARE * floor] * len(c)
    return Centroids(langs, idf, np.concatenate(vectors).astype(np.float32), np.array(owner), np.array(least))


def predict(docs: DataFrame, model: Centroids, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, rejected) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for b in chunks(batches, rows=ROWS):
            lang, score, rejected = m.predict(*utf8(b.column(1)))
            blank = np.array([not (t and _LETTER.search(t)) for t in b.column(1).to_pylist()]) | (not m.langs)
            lang, score, rejected = np.where(blank, len(m.langs), lang), np.where(blank, 0.0, score), rejected | blank
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[lang], pa.string()), pa.array(score.astype(float)), pa.array(rejected)], [key, "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, rejected boolean")


def filter_known(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for b in chunks(batches, column=at, rows=ROWS):
            *_, rejected = m.predict(*utf8(b.column(at)))
            blank = np.array([not (t and _LETTER.search(t)) for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(~(rejected | blank)))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """The query's form: learn from the rows that are not held out, predict all."""
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    out = predict(docs, model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
