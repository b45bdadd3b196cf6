"""Toxicity severity by cumulative-link ordinal regression.

Model: P(grade <= k | x) = sigmoid(threshold_k - w.x), thresholds increasing,
one weight vector shared by all of them. x is sparse: one entry per distinct
word of the lower-cased text and per word beginning of 4 and 5 letters (insults
take endings and compounds), hashed, with value 1 + ln(count). The result is
the expected severity, the sum over k of P(grade > k), and whether a grade
above the lowest is more probable than not.

Weights carry an L1 penalty (proximal gradient), which leaves the many words
that say nothing at exactly zero; so a long clean text does not add up to a
toxic one.

The model is fitted on at most about ``max_per_grade`` labelled rows per grade,
the ones with the smallest id hash, read whole; scoring covers all rows.
Labels that only say toxic or not are first split into grades by
``split_grades``: 0 clean, 1 toxic, 2 toxic with more marked words than about
half of the toxic texts.

Edge cases: a null or empty text has no features and gets the severity of an
empty vector; labels that are null, or whose document is missing, are not
learned from; with no labels, or a single grade, every severity is that grade
(0 without labels); repeated rows are scored row by row; null ids are kept;
extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsift.llm.common import by_value, in_slices, map_texts

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5)
HASH_BITS = 22
MIN_DF = 4                  # rows that must hold a feature for it to get a weight
KNOWN_WORDS = 100_000       # words whose features a task remembers


def features(text: str | None) -> dict[int, int]:
    """Hashed feature -> count over the whole text."""
    out: dict[int, int] = {}
    mask = (1 << HASH_BITS) - 1
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        key = crc32(word.encode()) & mask
        out[key] = out.get(key, 0) + n
        for size in BEGINNINGS:
            if len(word) >= size:
                key = crc32(b"^" + word[:size].encode()) & mask
                out[key] = out.get(key, 0) + n
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    weights: dict[int, float] = field(default_factory=dict)   # features whose weight is not zero
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lowest: int = 0

    def margin(self, text: str | None, known: dict[str, tuple[int, ...]] | None = None) -> float:
        """w.x of a text; only features with a weight are counted. ``known``
        remembers the weighted features of words from text to text."""
        if not text:
            return 0.0
        found: dict[int, int] = {}
        known = {} if known is None else known
        for word, n in Counter(WORD.findall(text.lower())).items():
            keys = known.get(word)
            if keys is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                keys = known[word] = tuple(k for k in features(word) if k in self.weights)
            for key in keys:
                found[key] = found.get(key, 0) + n
        return sum(self.weights[k] * (1 + log(n)) for k, n in found.items())

    def predict(self, text: str | None, known: dict[str, tuple[int, ...]] | None = None) -> tuple[float, int, bool]:
        """(expected severity, most probable grade, above the lowest grade)."""
        margin = self.margin(text, known)
        above = [1 / (1 + exp(min(700.0, t - margin))) for t in self.thresholds]      # P(grade > k)
        probs = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        return (self.lowest + sum(above), self.lowest + probs.index(max(probs)), bool(above) and above[0] > 0.5)


@dataclass
class Rows:
    """Sparse rows: parallel arrays of (row, feature, count)."""
    row: np.ndarray
    key: np.ndarray
    n: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[dict[int, int]]) -> Rows:
        return cls.join([(np.fromiter(r.keys(), np.int32, len(r)), np.fromiter(r.values(), np.int32, len(r)))
                         for r in rows])

    @classmethod
    def join(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        if not parts:
            return cls(*[np.zeros(0, np.int32)] * 3, 0)
        return cls(np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts]),
                   np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]), len(parts))


    def frequent(self, min_df: int) -> Rows:
        """Only the features that at least ``min_df`` rows hold."""
        keep = np.bincount(self.key, minlength=1 << HASH_BITS)[self.key] >= min_df     # a row holds a feature once
        return Rows(self.row[keep], self.key[keep], self.n[keep], self.size)


def fit_ordinal(rows: Rows, grades: np.ndarray, min_df: int = MIN_DF, l1: float = 2e-3,
                rounds: int = 200, clean_share: float | None = None) -> OrdinalModel:
    """Maximum penalised likelihood by accelerated proximal gradient. The
    lowest grade and all others together weigh as the tenth roots of their
    sizes, or of ``clean_share`` and the rest where rows are a sample."""
    if not rows.size:
        return OrdinalModel()
    lowest, n_cuts = int(grades.min()), int(grades.max() - grades.min())
    if not n_cuts:
        return OrdinalModel(lowest=lowest)
    rows = rows.frequent(min_df)
    vocab, at_col = np.unique(rows.key, return_inverse=True)
    at_row, at_col = rows.row, at_col.astype(np.int32)
    value = (1 + np.log(rows.n)).astype(np.float32)
    y = (grades - lowest).astype(int)
    low = y == 0
    share = low.mean() if clean_share is None else clean_share
    weight = np.where(low, share ** 0.1 / max(1, low.sum()), (1 - share) ** 0.1 / max(1, (~low).sum()))
    weight /= weight.sum()
    norms = np.bincount(at_row, value ** 2, rows.size)
    step = 2.0 / max(1.0, float((weight * norms).sum()))

    def cuts(t: np.ndarray) -> np.ndarray:
        """Thresholds from the first one and the logarithms of the gaps, so they stay in order."""
        return t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])

    w, t = np.zeros(len(vocab)), np.zeros(n_cuts)
    seen, seen_t, moment = w.copy(), t.copy(), 1.0
    for _ in range(rounds):
        margin = np.bincount(at_row, value * seen[at_col], rows.size)
        edges = np.concatenate([[-np.inf], cuts(seen_t), [np.inf]])
        hi, lo = _sigmoid(edges[y + 1] - margin), _sigmoid(edges[y] - margin)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
        g_w = np.bincount(at_col, value * (d_hi - d_lo)[at_row], len(vocab))   # of minus the log likelihood
        g_cut = (np.bincount(y, d_lo, n_cuts + 2) - np.bincount(y + 1, d_hi, n_cuts + 2))[1:-1]
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_t = np.concatenate([[tail[0]], tail[1:] * np.exp(seen_t[1:])])
        moved = seen - step * g_w
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_t = seen_t - 0.5 * g_t
        ahead = (1 + np.sqrt(1 + 4 * moment * moment)) / 2
        seen, seen_t = new + (moment - 1) / ahead * (new - w), new_t + (moment - 1) / ahead * (new_t - t)
        w, t, moment = new, new_t, ahead
    return OrdinalModel({int(vocab[i]): float(w[i]) for i in np.flatnonzero(w)}, cuts(t), lowest)


def split_grades(rows: Rows, toxic: np.ndarray, **settings) -> np.ndarray:
    """Grades 0, 1, 2 from labels 0, 1: toxic rows are split at their median
    number of marked words, those with at least a quarter of the largest
    weight in a two-grade fit."""
    if not rows.size or toxic.min() == toxic.max():
        return toxic
    weights = fit_ordinal(rows, toxic, **settings).weights
    marked = np.zeros(1 << HASH_BITS, bool)
    marked[[k for k, v in weights.items() if v >= 0.25 * max(weights.values())]] = True
    hits = np.bincount(rows.row, rows.n * marked[rows.key], rows.size)
    middle = np.median(hits[toxic > 0])
    halves = [hits > middle, hits >= middle]         # of equal counts, the more even cut
    share = [abs(h[toxic > 0].mean() - 0.5) for h in halves]
    return np.where(toxic == 0, 0, 1 + halves[int(np.argmin(share))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "toxic", max_per_grade: int = 3000, split: bool = True, seed: int = 7) -> OrdinalModel:
    """Learn the grades of ``labels`` (id, grade) from the texts of ``docs``.

    Only labelled rows move, and of them at most about ``max_per_grade`` for
    each grade: those whose id hash lies below the matching bound.
    """
    graded = (labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(grade_col).cast("int")).alias("grade")))
    sizes = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}  # one row per grade
    if not sizes:
        return OrdinalModel()
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, max_per_grade / n))])
    hashed = F.xxhash64("label_id", F.lit(seed)).cast("double") / F.lit(float(1 << 64)) + 0.5
    picked = graded.where(hashed < share[F.col("grade")])
    known = (docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
             .join(F.broadcast(picked), "label_id").select("grade", "text"))  # bounded by max_per_grade

    def encode(texts: list) -> list:
        out = []
        for found in map(features, texts):
            keys = sorted(found)
            out.append((np.array(keys, "<i4").tobytes(), np.array([found[k] for k in keys], "<i4").tobytes()))
        return out

    found = map_texts(known, "grade", "text", encode, "keys binary, n binary", 64).collect()
    found.sort(key=lambda r: (r["grade"], r["keys"], r["n"]))
    rows = Rows.join([(np.frombuffer(r["keys"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in found]).frequent(MIN_DF)
    grades = np.array([r["grade"] for r in found], int)
    del found
    share = sizes[min(sizes)] / sum(sizes.values())
    if split and sorted(sizes) == [0, 1]:
        grades = split_grades(rows, grades, clean_share=share)
    return fit_ordinal(rows, grades, clean_share=share)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade, toxic) per row."""
    shared = by_value(docs.sparkSession, model)
    known: dict[str, tuple[int, ...]] = {}      # travels empty; filled and dropped with each task
    return map_texts(docs, id_col, text_col, lambda texts: [shared().predict(t, known) for t in texts],
                     "severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are toxic; all columns as they are."""
    shared = by_value(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in in_slices(batches):
            clean = [not shared().predict(t, known)[2] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
