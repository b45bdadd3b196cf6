"""Secret scanning with a random forest that removes false positives.

Candidates are found in the whole text: runs of key characters with a digit,
and values that are assigned to a name such as ``token`` or ``password``; an
assigned value takes the place of the runs inside it, and one that ends within
a run reaches to the end of that run. Each gets features of

* its length and share of digits, capitals and symbols, and its entropy;
* character transitions: mean log probability of its letter pairs under a
  model of ordinary words, and how often it changes between letters and digits;
* dictionary coverage: the share of its letters that lie in known words;
* the path it lies in (test, example and documentation paths);
* the neighbouring words: secret names, names of harmless digests and numbers,
  an assignment sign, quotes.

A random forest (``pyspark.ml``), trained from labelled findings, decides. Its
trees become arrays that score candidates inside the scan. The words and letter
pairs are counted over all texts before, in one aggregation.
``labelled_findings`` makes findings of known label around the most frequent
words of the corpus; findings labelled by hand take the same form.

Edge cases: null and empty texts have no findings and are left as they are by
``redact``; candidates longer than ``MAX_LENGTH`` (embedded files) are read
whole for their features, like any other; repeated rows and null ids are
scanned row by row; without any labelled finding every candidate is accepted;
extra columns are not read (``scan``) or carried along (``redact``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsift.llm.common import by_value, id_and, in_slices, to_arrow
from graphsift.session import cut_lineage

MIN_LENGTH, MAX_LENGTH = 12, 4096
KEY_CHARS = r"A-Za-z0-9_+/=\-"
DIGIT = re.compile(r"[0-9]")
RUN_LEFT = re.compile(rf"[{KEY_CHARS}]*\Z")
RUN_RIGHT = re.compile(rf"[{KEY_CHARS}]*")
NEXT_WORDS = re.compile(r"[A-Za-z]{2,}")
LOWER_WORD = re.compile(r"[a-z]{3,}")
# Names that secrets are assigned to, and names of values that look alike but are harmless.
SECRET_NAMES = frozenset("""token secret password passwd pwd apikey api key auth authorization bearer credential
    credentials private access aws""".split())
HARMLESS_NAMES = frozenset("""commit sha md5 sha1 sha256 checksum digest hash etag revision rev id uuid guid order
    invoice phone tel call date version build serial isbn card number ref page image example sample test dummy
    placeholder""".split())
TEST_PATHS = re.compile(r"(?<![A-Za-z])(?:tests?|examples?|samples?|fixtures?|mocks?|docs?|readme|lock)(?![A-Za-z])", re.I)
ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api_?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,})", re.I)
ASSIGNED_NAMES = ("token", "secret", "passw", "pwd", "api", "auth")
FEATURES = ["length", "digits", "capitals", "symbols", "entropy", "transitions", "switches", "dictionary",
            "hex_only", "digits_only", "test_path", "secret_name", "harmless_name", "assigned", "quoted"]
CONTEXT = 48


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate, in order, none overlapping."""
    spans, at = [], 0
    while m := DIGIT.search(text, at):
        left = m.start()
        while left > 0 and RUN_CHAR[ord(text[left - 1]) & 127] and text[left - 1] < "\x80":
            left -= 1
        at = RUN_RIGHT.match(text, m.start()).end()
        if at - left >= MIN_LENGTH:
            spans.append((left, at))
    lower = text.lower()
    if any(n in lower for n in ASSIGNED_NAMES):
        spans = _joined(sorted(spans + [m.span(1) for m in ASSIGNED.finditer(text)]))
    return spans


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


RUN_CHAR = [bool(re.match(rf"[{KEY_CHARS}]", chr(c))) for c in range(128)]


def _kind(c: str) -> int:
    """Letters 0-25, digit 26, anything else 27."""
    o = ord(c)
    return o - 97 if 97 <= o <= 122 else 26 if 48 <= o <= 57 else 27


@dataclass
class WordModel:
    """What ordinary words look like: letter-pair log probabilities, and a dictionary."""

    pairs: np.ndarray
    words: frozenset

    @classmethod
    def of(cls, counts: np.ndarray, words: list[str]) -> WordModel:
        """From counts of letter pairs (by _kind, 28 x 28) and the dictionary."""
        pairs = counts + 1
        return cls(np.log(pairs / pairs.sum(axis=1, keepdims=True)), frozenset(words))

    def transitions(self, lower: str) -> float:
        kinds = [_kind(c) for c in lower]
        return float(np.mean(self.pairs[kinds[:-1], kinds[1:]])) if len(kinds) > 1 else 0.0

    def coverage(self, lower: str) -> float:
        """Share of characters in dictionary words, longest words first."""
        covered = 0
        for m in LOWER_WORD.finditer(lower):
            part, at = m.group(), 0
            while at + 3 <= len(part):
                size = next((n for n in range(min(16, len(part) - at), 2, -1) if part[at:at + n] in self.words), 0)
                covered += size
                at += size or 1
        return covered / max(1, len(lower))


def features(text: str, start: int, end: int, path: str, model: WordModel) -> list[float]:
    """Values of FEATURES for one candidate."""
    value = text[start:end]
    lower, n = value.lower(), end - start
    counts = np.array([*Counter(value).values()]) / n
    before, after = text[max(0, start - CONTEXT):start], text[end:end + 2]
    near = {w.lower() for w in NEXT_WORDS.findall(before)[-3:]}
    near |= {p for w in near for p in re.split(r"_", w)}
    digits = sum(c.isdigit() for c in value)
    kinds = [c.isdigit() for c in value]
    return [n, digits / n, sum(c.isupper() for c in value) / n, sum(not c.isalnum() for c in value) / n,
            float(-(counts * np.log2(counts)).sum()), model.transitions(lower),
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, model.coverage(lower),
            float(not lower.strip("0123456789abcdef")), float(digits == n), float(bool(TEST_PATHS.search(path))),
            float(bool(near & SECRET_NAMES)), float(bool(near & HARMLESS_NAMES)),
            float(bool(re.search(r"[:=]\s{0,3}[\"']?\Z", before))),
            float(before[-1:] in ("'", '"') or after[:1] in ("'", '"'))]


# ---- labelled findings ----

def labelled_findings(words: list[str], rng: np.random.Generator) -> list[tuple[str, str, int]]:
    """(path, text, label) of made-up findings between words of the corpus,
    one candidate each. Label 1 is a secret."""
    hexa, alnum = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def draw(chars: str, n: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), n))

    def one(options: list[str]) -> str:
        return options[int(rng.integers(0, len(options)))]

    def some(n: int) -> str:
        return " ".join(one(words) for _ in range(n)) if words else ""

    quote, names = one(['"', "'", ""]), ["token", "secret", "password", "api_key", "auth_token", "access_key", "TOKEN"]
    sign = one([" = ", "=", ": ", ":"])
    secret = one([draw(hexa, int(rng.integers(32, 65))), draw(alnum, int(rng.integers(20, 48))),
                  draw(hexa, 40), draw(hexa, 40).upper(), "AKIA" + draw(alnum[:10] + alnum[36:], 16),
                  "ghp_" + draw(alnum, 36), draw(alnum + "+/", 40) + "="])
    word, digits = one(words) if words else "word", draw("0123456789", int(rng.integers(12, 20)))
    year = int(rng.integers(1990, 2030))
    harmless = [
        (f"commit {draw(hexa, 40)}", draw(hexa, 1)), (f"sha256: {draw(hexa, 64)}", ""), (f"md5 {draw(hexa, 32)}", ""),
        (f"id {draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}", ""), (digits, ""), (digits, ""),
        (f"{one(['card', 'order', 'phone', 'invoice'])} {digits}", ""), (f"{word}{word}{year}", ""),
        (f"{year}-05-1{draw('0123456789', 1)}T10-2{draw('0123456789', 1)}", ""), (f"/{word}/{word}/{digits[:4]}", ""),
        (f'token = "your-{word}-token-{digits[:1]}"', ""), (f'secret: "{"x" * 15}1"', ""),
        (f"password = example{word}123", ""), (f"page {word}-{word}-{digits[:3]}", "")]
    prefix, suffix = some(int(rng.integers(0, 6))), some(int(rng.integers(0, 4)))
    ordinary = one(["src1", "app/config.py", "deploy/env", "src14", "notes.txt"])
    found = [(ordinary, f"{prefix} {one(names)}{sign}{quote}{secret}{quote} {suffix}", 1),
             (ordinary, f"{prefix} {one(names).upper()}{sign}{quote}{secret}{quote}!! {suffix}", 1),
             (ordinary, f"{prefix} Authorization: Bearer {draw(alnum, int(rng.integers(24, 60)))} {suffix}", 1)]
    for _ in range(3):
        text, _tail = harmless[int(rng.integers(0, len(harmless)))]
        found.append((ordinary, f"{prefix} {text} {suffix}", 0))
    found.append((one(["tests/fixtures/a.py", "docs/readme.md", "example/config"]),
                  f"{prefix} {one(names)}{sign}{quote}{secret}{quote} {suffix}", 0))
    return found


# ---- forest ----

@dataclass
class Forest:
    """Trees as arrays. A leaf has feature -1 and its class as threshold."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    words: WordModel

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of trees that vote for a secret."""
        if not self.trees:
            return np.ones(len(rows))
        votes = np.zeros(len(rows))
        for feature, value, left, right in self.trees:
            at = np.zeros(len(rows), int)
            while (inner := feature[at] >= 0).any():
                go = rows[np.arange(len(rows)), np.maximum(feature[at], 0)] <= value[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            votes += value[at]
        return votes / len(self.trees)


def _tree_arrays(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays from a tree's ``toDebugString``."""
    lines = [ln.strip() for ln in text.splitlines() if re.match(r"\s*(If|Else|Predict)", ln)]
    nodes: list[list] = []

    def build(at: int) -> tuple[int, int]:
        me, line = len(nodes), lines[at]
        if line.startswith("Predict"):
            nodes.append([-1, float(line.split(":")[1]), -1, -1])
            return me, at + 1
        feature, value = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        nodes.append([int(feature), float(value), 0, 0])
        nodes[me][2], at = build(at + 1)
        nodes[me][3], at = build(at + 1)        # the line between is the matching Else
        return me, at

    build(0)
    cols = list(zip(*nodes, strict=True))
    return np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, count) -> (pair, n): one table of letter pairs a task."""
    table = np.zeros(28 * 28)
    for batch in batches:
        if batch.num_rows:
            letters = np.frombuffer(("\n".join(batch.column(0).to_pylist()) + "\n").encode(), np.uint8).astype(np.int64) - 97
            ends = np.flatnonzero(letters < 0)
            times = np.repeat(batch.column(1).to_numpy(), np.diff(ends, prepend=-1))
            at = np.flatnonzero((letters[:-1] >= 0) & (letters[1:] >= 0))
            table += np.bincount(letters[at] * 28 + letters[at + 1], times[at], 28 * 28)
    seen = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(table[seen].astype(np.int64))], names=["pair", "n"])


def fit_words(docs: DataFrame, text_col: str = "text", min_count: int = 3,
              min_share: float = 1e-7) -> tuple[WordModel, list[str]]:
    """Letter pairs of all words of all texts, the dictionary of their words
    of 3 to 16 letters, and the 2,000 most frequent words. A word is in the
    dictionary if it occurs ``min_count`` times and is ``min_share`` of all
    words, so that the broadcast dictionary does not grow with the corpus and
    the letter runs of random keys stay out of it."""
    counts = cut_lineage(docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^a-z]+")).alias("w"))
                         .where(F.length("w") >= 2).groupBy("w").count())
    pairs = np.zeros(28 * 28)
    for r in counts.mapInArrow(_pair_counts, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    total = counts.agg(F.sum("count")).first()[0] or 0
    known = counts.where(F.length("w").between(3, 16) & (F.col("count") >= max(min_count, min_share * total)))
    common = counts.orderBy(F.desc("count"), "w").limit(2000).collect()
    words = known.select("w").toArrow().column("w").to_pylist()
    return WordModel.of(pairs.reshape(28, 28), words), [r["w"] for r in common]


def fit(findings: DataFrame, words: WordModel, trees: int = 25, depth: int = 8, seed: int = 7) -> Forest:
    """Train from labelled findings (path, text, label), each with at least
    one candidate; bounded by the caller."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("label", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for path, text, label in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for start, end in candidates(text or ""):
                    rows.append(features(text, start, end, path or "", words))
                    labels.append(float(label))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())],
                                             names=schema.names)

    rows = findings.select("path", "text", "label").mapInArrow(run, schema)
    data = rows.select(array_to_vector("x").alias("features"), "label").cache()
    try:
        labels = [r["label"] for r in data.select("label").distinct().collect()]
        if len(labels) < 2:
            return Forest([] if labels != [0.0] else [tuple(np.array([v]) for v in (-1, 0.0, -1, -1))], words)
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed,
                                        featureSubsetStrategy="sqrt").fit(data)
    finally:
        data.unpersist()
    return Forest([_tree_arrays(t.toDebugString) for t in forest.trees], words)


def train(docs: DataFrame, text_col: str = "text", findings: int = 1500, seed: int = 7) -> Forest:
    """Forest for a corpus: word model from all its texts, ``findings`` groups
    of seven labelled findings."""
    model, common = fit_words(docs, text_col)
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f for i in batch.column(0).to_pylist()
                    for f in labelled_findings(common, np.random.default_rng(crc32(f"{seed}:{i}".encode())))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)],
                                             names=["path", "text", "label"])

    made = spark.range(findings).mapInArrow(run, "path string, text string, label bigint")
    return fit(made, model)


# ---- jobs ----

def _found(text: str | None, path: str | None, forest: Forest) -> tuple[list[tuple[int, int]], np.ndarray]:
    spans = candidates(text) if text else []
    if not spans:
        return [], np.zeros(0)
    return spans, forest.score(np.array([features(text, s, e, path or "", forest.words) for s, e in spans]))


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """(id, start, end, candidate, score, is_secret): one row per candidate."""
    shared = by_value(docs.sparkSession, forest)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL(
        "start bigint, end bigint, candidate string, score double, is_secret boolean").fields])
    types = [to_arrow(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, texts, *paths = [c.to_pylist() for c in batch.columns]
            rows = []
            for key, text, path in zip(ids, texts, paths[0] if paths else [""] * len(ids), strict=True):
                spans, scores = _found(text, path, shared())
                rows += [(key, s, e, text[s:e], float(p), bool(p >= threshold))
                         for (s, e), p in zip(spans, scores, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)],
                                             names=schema.names)

    return id_and(docs, id_col, text_col, *([path_col] if path_col else [])).mapInArrow(run, schema)


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source",
           threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every accepted finding in ``text_col`` replaced by
    ``mark``; all rows and all other columns stay as they are."""
    shared = by_value(docs.sparkSession, forest)
    at, path_at = docs.columns.index(text_col), docs.columns.index(path_col) if path_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column(at).to_pylist()
            paths = batch.column(path_at).to_pylist() if path_at is not None else [""] * len(texts)
            out = []
            for text, path in zip(texts, paths, strict=True):
                spans, scores = _found(text, path, shared())
                parts, last = [], 0
                for (s, e), p in zip(spans, scores, strict=True):
                    if p >= threshold:
                        parts += [text[last:s], mark]
                        last = e
                out.append("".join([*parts, text[last:]]) if parts else text)
            columns = [*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1:]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
