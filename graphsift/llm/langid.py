"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (n = 2 and 3 over the
lower-cased UTF-8 text, where ASCII characters other than letters count as
one space): sub-linear term frequency times inverse document
frequency, scaled to unit length. Each language has several centroids, found
by spherical k-means over its labelled texts; the label of the centroid with
the highest cosine wins. A text is marked as rejected if its distance (one
minus the cosine) to that centroid exceeds ``slack`` times the distance that
all but a share ``reject_quantile`` of the centroid's own training texts keep:
it is far from everything that was learned.

Document frequencies are counted over all texts with a label, as one partial
vector a task. The centroids are fitted on at most ``max_per_lang`` labelled
texts per language, the ones with the smallest id hash, each read whole.

Edge cases: a null text, or one without any letter, is ``und`` with score 0;
without labelled rows every text is; ties between centroids go to the
language that sorts first; repeated rows are predicted row by row; null ids
are kept; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphsift.llm.common import by_value, in_slices, map_texts

DIM = 1 << 12
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
AS_LETTER = np.array([b if b > 0x7F or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
CHUNK = 1 << 20  # bytes whose n-grams are counted at once


def counts(text: str, dim: int = DIM) -> np.ndarray:
    """Hashed counts of the byte 2-grams and 3-grams of a whole text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    raw = AS_LETTER[raw]
    blank = raw == 0x20
    raw = raw[np.append(True, ~(blank[1:] & blank[:-1]))]
    shift = np.uint32(32 - (dim.bit_length() - 1))
    out = np.zeros(dim, np.int64)
    for start in range(0, len(raw), CHUNK):
        part = raw[start:start + CHUNK + 2].astype(np.uint32)  # overlap: no n-gram is lost at a cut
        two = (part[:-1] << np.uint32(8)) | part[1:]
        three = (two[:-1] << np.uint32(8)) | part[2:]
        last = start + CHUNK >= len(raw)
        grams = np.concatenate([two if last else two[:CHUNK], three + np.uint32(1 << 24)])
        out += np.bincount((grams * np.uint32(2654435761)) >> shift, minlength=dim)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


@dataclass
class LanguageModel:
    langs: list[str]          # one per centroid
    idf: np.ndarray
    centroids: np.ndarray     # unit rows
    reach: np.ndarray         # per centroid: largest accepted distance

    def vectors(self, texts: list[str]) -> np.ndarray:
        tf = np.stack([counts(t) for t in texts]).astype(np.float32)
        return _unit(np.log1p(tf) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) per text."""
        known = [i for i, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if known:
            scores = self.vectors([texts[i] for i in known]) @ self.centroids.T
            best = scores.argmax(axis=1)
            for row, i, b in zip(scores, known, best, strict=True):
                score = min(1.0, max(0.0, float(row[b])))
                out[i] = (self.langs[b], score, 1 - score > self.reach[b])
        return out


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        new = _unit(np.stack([rows[own == c].sum(axis=0) if (own == c).any() else centres[c]
                              for c in range(len(centres))]))
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def document_frequencies(texts: DataFrame, text_col: str = "text", dim: int = DIM) -> tuple[int, np.ndarray]:
    """Number of all texts, and of those that hold each hashed n-gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(dim + 1, np.int64)      # the last one counts texts
        for batch in in_slices(batches, 256):
            for text in batch.column(0).to_pylist():
                seen[:dim] += counts(text, dim) > 0
            seen[dim] += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["gram", "n"])

    out = np.zeros(dim + 1, np.int64)
    found = texts.select(F.col(text_col)).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    for r in found.collect():       # at most dim + 1 rows
        out[r["gram"]] = r["n"]
    return int(out[dim]), out[:dim]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_per_lang: int = 400, clusters: int = 4, reject_quantile: float = 0.01, slack: float = 1.25,
        seed: int = 7) -> LanguageModel:
    """Learn from rows with a text and a language. At most ``max_per_lang``
    rows per language reach the driver, as vectors of fixed size."""
    pick = Window.partitionBy("lang").orderBy("h")
    has_text = labelled.where(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull())
    # Narrow rows first: the smallest hashes are found per lang without moving texts.
    keyed = has_text.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"))
    cuts = (keyed.groupBy("lang").agg(F.count("*").alias("n"))
            .withColumn("p", F.least(F.lit(1.0), F.lit(2.0 * max_per_lang) / F.col("n"))))
    share = {r["lang"]: r["p"] for r in cuts.collect()}  # one row per language
    low = F.lit(-(1 << 63)).cast("double")
    limit = F.create_map(*[F.lit(x) for k, p in share.items() for x in (k, float(p))]) if share else None
    if limit is None:
        return LanguageModel([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0))
    hashed = F.xxhash64(F.col(id_col), F.lit(seed))
    sample = (has_text.where((hashed.cast("double") - low) / F.lit(float(1 << 64)) < limit[F.col(lang_col)])
              .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hashed.alias("h"))
              .withColumn("r", F.row_number().over(pick)).where(F.col("r") <= max_per_lang))
    found = map_texts(sample, "lang", "text", lambda ts: [(counts(t).astype("<i4").tobytes(),) for t in ts],
                      "tf binary", 64).collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["tf"])))
    tf = np.stack([np.frombuffer(r["tf"], "<i4") for r in found]).astype(np.float32)
    total, seen = document_frequencies(has_text, text_col)
    idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + np.float32(1)
    rows, names = _unit(np.log1p(tf) * idf), np.array([r["lang"] for r in found])
    rng = np.random.default_rng(seed)
    langs, centroids, reach = [], [], []
    for lang in sorted(set(names)):
        own = rows[names == lang]
        centres = _k_means(own, clusters, rng)
        best = own @ centres.T
        for c in range(len(centres)):
            far = 1 - best[best.argmax(axis=1) == c, c]
            reach.append(slack * float(np.quantile(far, 1 - reject_quantile)) if len(far) else 0.0)
            langs.append(lang)
        centroids.append(centres)
    return LanguageModel(langs, idf, np.concatenate(centroids), np.array(reach))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) per row."""
    shared = by_value(docs.sparkSession, model)
    return map_texts(docs, id_col, text_col, lambda texts: shared().predict(texts),
                     "lang_pred string, score double, rejected boolean", 256)
