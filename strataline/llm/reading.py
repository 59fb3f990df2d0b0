"""Reading level of texts (problem 10).

A linear ranker is learned from pairs of graded documents: the harder text of a pair must score higher
(logistic loss on the difference). It sees syntax (lengths of sentences and words, commas, how words repeat)
and vocabulary (hashed words, rarity in the corpus). Isotonic regression turns scores into levels.

Corpus statistics cover all documents, as a table of fixed size: document frequencies of hashed words. The model
is fitted on at most LABEL_LIMIT graded documents, chosen by hash; that bound is a parameter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.words import plain, words, words_of

#: Most graded documents used to fit the ranker; pairs drawn from them; buckets of hashed words.
LABEL_LIMIT, PAIRS, BUCKETS = 8000, 200_000, 1 << 15
#: Buckets of the corpus' document frequencies.
FREQUENCIES = 1 << 17
LEVELS = (1, 2, 3, 4)

_SENTENCE = re.compile(r"[.!?;:]+|\n\s*\n")
DENSE = 9
#: A word found in at most FEW + FEW_SHARE x documents is a name or a code: it says nothing about the level.
FEW, FEW_SHARE = 4, 5e-5


class Words(dict):
    """Words numbered in order of first use, with what the ranker sees of each: length, whether it is letters only, and
    its buckets of corpus frequencies and of hashed vocabulary. Each word is hashed once a task, texts become arrays."""

    LIMIT = 200_000

    def __init__(self) -> None:
        super().__init__()
        self.size, self.alpha = np.zeros(1024, np.int32), np.zeros(1024, bool)
        self.frequency, self.hashed = np.zeros(1024, np.int32), np.zeros(1024, np.int32)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k == len(self.size):
            for name in ("size", "alpha", "frequency", "hashed"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        h = xxhash.xxh64_intdigest(word)
        self.size[k], self.alpha[k], self.frequency[k], self.hashed[k] = len(word), word.isalpha(), h % FREQUENCIES, h % BUCKETS
        return k

    def numbers(self, ws: list[str]) -> np.ndarray:
        """The words of one text; their numbers hold until the next text."""
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.int32, len(ws))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(FREQUENCIES, np.int64)
    docs, known = 0, Words()
    for pdf in batches:
        for text in pdf["text"]:
            docs += 1
            ids = known.numbers(words(text))
            counts[np.unique(known.frequency[ids])] += 1
    held = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": np.append(held, -1), "n": np.append(counts[held], docs)})


def document_frequencies(documents: DataFrame) -> np.ndarray:
    """Document frequency of every word bucket over all documents, the number of documents last. Each task sends
    one table of at most FREQUENCIES + 1 rows; the sum has the same fixed size."""
    rows = documents.select("text").filter("text is not null").mapInPandas(_counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FREQUENCIES + 1, np.float64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def features(text: str | None, rarity: np.ndarray, known: Words | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(dense syntax and vocabulary features, hashed buckets of the words, number of all words) of a text. Only letters-only words that
    the corpus knows are looked at; names, numbers and codes are left out. A text without known words has zeros."""
    known = Words() if known is None else known
    body = plain(text) if text else ""
    all_ids = known.numbers(words_of(body))
    ids = all_ids[known.alpha[all_ids]]
    rare = rarity[known.frequency[ids]]
    ids, rare = ids[np.isfinite(rare)], rare[np.isfinite(rare)]
    dense, n = np.zeros(DENSE), len(ids)
    if not n:
        return dense, known.hashed[ids], len(all_ids)
    sizes = known.size[ids]
    sentences = [len(s.split()) for s in _SENTENCE.split(body) if s.strip()]
    dense[:] = [
        sizes.mean() / 5, (sizes >= 7).mean(), (sizes >= 10).mean(), (sizes >= 13).mean(), sizes.std() / 3,
        math.log1p(sum(sentences) / len(sentences) if sentences else n) / 3, body.count(",") / n * 5,
        math.log(len(np.unique(ids))) / math.log(n + 1), rare.mean() / 5,
    ]
    return dense, known.hashed[ids], len(all_ids)


@dataclass
class Model:
    """A fitted ranker with its calibration."""

    dense: np.ndarray
    hashed: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    rarity: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, dense: np.ndarray, buckets: np.ndarray) -> float:
        """The score of a text's :func:`features`."""
        return float(((dense - self.mean) / self.scale) @ self.dense) + (WORD_SCALE * float(self.hashed[buckets].mean()) if len(buckets) else 0.0)

    def level(self, score: float) -> float:
        """The calibrated level, between 1 and 4, not rounded."""
        return float(np.interp(score, self.knots, self.values))


#: Weight of word shares beside the standardised dense features.
WORD_SCALE = 8.0


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y on x by pooling adjacent violators: (knots, values)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, hi = blocks.pop()
            u, z, lo, _ = blocks[-1]
            blocks[-1] = [(u * z + v * w) / (z + w), z + w, lo, hi]
    knots, values = [], []
    for v, _, lo, hi in blocks:
        knots += [lo] if lo == hi else [lo, hi]
        values += [v] if lo == hi else [v, v]
    return np.array(knots), np.array(values)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], levels: np.ndarray, rarity: np.ndarray, *, rounds: int = 300, penalty: float = 2e-4, seed: int = 11) -> Model:
    """Fit the pairwise ranker and its calibration on the (dense features, buckets) of graded texts."""
    x = np.array([d for d, _ in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = (x - mean) / scale
    # Shares of the buckets of each text.
    shares = [np.unique(b, return_counts=True) for _, b in rows]
    at = np.repeat(np.arange(len(rows)), [len(b) for b, _ in shares])
    col = np.concatenate([b for b, _ in shares]).astype(int)
    val = WORD_SCALE * np.concatenate([n / max(1, n.sum()) for _, n in shares])
    rng = np.random.default_rng(seed)
    n = len(rows)
    a, b = rng.integers(0, n, PAIRS), rng.integers(0, n, PAIRS)
    keep = np.abs(levels[a] - levels[b]) >= 1
    a, b = a[keep], b[keep]
    flip = levels[a] < levels[b]
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    w, h = np.zeros(DENSE), np.zeros(BUCKETS)
    mw, vw, mh, vh = np.zeros(DENSE), np.zeros(DENSE), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for t in range(1, rounds + 1):
        s = x @ w + np.bincount(at, val * h[col], n)
        p = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        g = (np.bincount(b, p, n) - np.bincount(a, p, n)) / max(1, len(a))
        gw, gh = x.T @ g + penalty * w, np.bincount(col, val * g[at], BUCKETS) + penalty * h
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mh, vh = 0.9 * mh + 0.1 * gh, 0.999 * vh + 0.001 * gh**2
        step = 0.05 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, h = w - step * mw / (np.sqrt(vw) + 1e-8), h - step * mh / (np.sqrt(vh) + 1e-8)
    s = x @ w + np.bincount(at, val * h[col], n)
    return Model(w, h, mean, scale, rarity, *isotonic(s, levels.astype(float)))


def rarities(frequencies: np.ndarray) -> np.ndarray:
    """Rarity of each word bucket: logarithm of the inverse share of documents that hold it; infinite for words
    of few documents."""
    total, held = frequencies[-1], frequencies[:-1]
    few = min(FEW, total * 0.01) + FEW_SHARE * total
    return np.where(held <= few, np.inf, np.log((total + 1) / (held + 1)))


class NotGraded(ValueError):
    """There are no two levels to rank."""


def train(documents: DataFrame, labels: DataFrame, *, limit: int = LABEL_LIMIT) -> Model:
    """Fit on graded documents. ``labels``: doc_id, reading_level (1 to 4; others are left out); several grades of one
    document count as their mean. Fewer than two different levels cannot be ranked and raise NotGraded."""
    rarity = rarities(document_frequencies(documents))
    grades = labels.filter(F.col("reading_level").isin(*LEVELS)).groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    some = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sent = documents.sparkSession.sparkContext.broadcast(rarity)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for pdf in batches:
            rows = [features(t, sent.value, known)[:2] for t in pdf["text"]]
            counts = [np.unique(b, return_counts=True) for _, b in rows]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "level": pdf["level"], "dense": [d for d, _ in rows], "buckets": [b for b, _ in counts], "times": [n for _, n in counts]})

    # Features come to the driver, not texts: at most ``limit`` rows of at most BUCKETS entries.
    graded = documents.select("doc_id", "text").filter("text is not null").join(some, "doc_id").select("doc_id", "level", "text")
    rows = graded.mapInPandas(seen, "doc_id bigint, level double, dense array<double>, buckets array<int>, times array<bigint>").toPandas().sort_values("doc_id")
    if rows["level"].nunique() < 2:
        raise NotGraded("graded documents of at least two levels are needed")
    return fit([(np.array(d, float), np.repeat(b, n)) for d, b, n in zip(rows["dense"], rows["buckets"], rows["times"], strict=True)], rows["level"].to_numpy(), rarity)


def reading_levels(documents: DataFrame, labels: DataFrame, *, limit: int = LABEL_LIMIT) -> DataFrame:
    """(doc_id, n_words, score, calibrated, reading_level) of every document.

    ``n_words`` counts words split at white space. Null texts and texts without words have null levels; rows
    without an id are left out. Without grades of at least two levels all levels are null. The language
    need not be known: words of all languages share one hashed vocabulary. Texts are read whole.
    """
    try:
        model = train(documents, labels, limit=limit)
    except NotGraded:
        empty = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("n_words"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
        words_or_none = F.when(F.coalesce(F.col("t"), F.lit("")) == "", 0).otherwise(F.col("n_words"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("score", "double"), ("calibrated", "double"), ("reading_level", "int"))]
        return empty.filter("doc_id is not null").select("doc_id", words_or_none.cast("int").alias("n_words"), *none)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = sent.value, Words()
        for pdf in batches:
            scores = []
            for t in pdf["text"]:
                dense, buckets, n = features(t, model.rarity, known)
                scores.append(model.score(dense, buckets) if n else None)
            levels = [None if s is None else model.level(s) for s in scores]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_words": [len(t.split()) if t else 0 for t in pdf["text"]],
                "score": pd.Series(scores, dtype="float64"), "calibrated": pd.Series(levels, dtype="float64"),
            })

    known = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null")
    graded = known.mapInPandas(grade, "doc_id bigint, n_words int, score double, calibrated double")
    return graded.withColumn("reading_level", F.floor(F.col("calibrated") + 0.5).cast("int"))
