"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprint: words are maximal runs of characters other than space and
U+0009-U+000D after lower-casing A-Z; every run of ``shingle`` words (the
whole sequence if there are fewer) is hashed with XXH64, seed 42; a bit of
the 64-bit fingerprint is set if it is set in more than half of the hashes.

Candidate search: the 64 bits are cut into ``blocks`` blocks. Two
fingerprints with at most ``max_bits`` differing bits agree on at least
``blocks - max_bits`` whole blocks, so joining on every choice of that many
blocks finds every such pair. With 6 blocks and 3 bits this is 20 keys of
about 32 bits: random pairs meet 20 / 2^32 of the time, so candidates stay far
below one per row even for billions of rows. The Hamming distance is part of
the join condition, so the join emits verified links only. Of these each task
hands on a spanning forest: a dense group of near copies is joined pair by
pair, but becomes a tree before anything is shuffled.

Equal fingerprints collapse to one vertex before the join: copies cost one
map-side combined row per task, never a pair.

Edge cases: null, empty and blank texts have fingerprint zero and link like
any other; a repeated row is a row of its own in the result; null ids stay in
the result, and a component's id is the smallest non-null id in it; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsift.llm.common import lookup, map_texts, spanning_forest, whole_row
from graphsift.operators.components import component_roots
from graphsift.session import cut_lineage

SEED = 42
CHUNK = 1 << 16  # shingles whose bits are counted at once: bounds memory for very long texts


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, CHUNK):
        stop = min(start + CHUNK, total)
        runs = zip(*[words[start + i:stop + i] for i in range(min(shingle, len(words)))], strict=True) \
            if len(words) >= shingle else [words]
        hashes = np.fromiter((digest(b" ".join(r), SEED) for r in runs), np.uint64, stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp): one signed 64-bit fingerprint per row."""
    return map_texts(docs, id_col, text_col, lambda texts: [(fingerprint(t, shingle),) for t in texts],
                     "fp bigint")


def block_masks(blocks: int = 6, max_bits: int = 3) -> list[int]:
    """Signed 64-bit masks, one per choice of ``blocks - max_bits`` blocks."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("needs 0 <= max_bits < blocks <= 64")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(distinct: DataFrame, max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column ``fp``) with
    1 to ``max_bits`` differing bits, found by the block join; a pair comes
    once for each key that it shares."""
    masks = block_masks(blocks, max_bits)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
        for i, m in enumerate(masks)])).alias("key")).select("fp", "key.t", "key.k")
    left = keyed.select(F.col("fp").alias("a"), "t", "k")
    right = keyed.select(F.col("fp").alias("b"), F.col("t").alias("t2"), F.col("k").alias("k2"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return (left.join(right, (F.col("t") == F.col("t2")) & (F.col("k") == F.col("k2"))
                      & (F.col("a") < F.col("b")) & near)
            .select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """(id, fp, component_id): rows of ``docs`` with the smallest id reachable
    by links of at most ``max_bits`` differing bits."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    roots = component_roots(close_pairs(distinct, max_bits, blocks).mapInArrow(spanning_forest(), "a bigint, b bigint"))
    groups = (distinct.join(roots, distinct["fp"] == roots["id"], "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = cut_lineage(groups.groupBy("root").agg(F.min("first_id").alias("component_id")))  # hot roots are split
    named = groups.join(smallest, "root").select(F.col("fp").alias("fp_key"), "component_id")
    return fps.join(named, fps["fp"] == named["fp_key"]).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """One row of ``docs`` per component, that of its smallest id; all columns
    as they are. Texts are not shuffled: the ids to drop come back as a filter.

    Where ids are null or repeat, rows are numbered in a table first and the
    numbers take their place: of rows that share the smallest id, and of a
    component without any id, the first in that table stays.
    """
    settings = {"shingle": shingle, "max_bits": max_bits, "blocks": blocks}
    unclear = docs.groupBy(F.col(id_col).alias("i")).count().where(F.col("i").isNull() | (F.col("count") > 1))
    if unclear.isEmpty():
        found = near_duplicates(docs, id_col, text_col, **settings)
        dropped = lookup(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")))
        return docs.join(dropped, docs[id_col] == dropped["gone"], "left_anti")
    numbered = cut_lineage(docs.select(whole_row(docs).alias("row"),
                                       F.monotonically_increasing_id().alias("number")))
    plain = numbered.select("number", F.col(f"row.`{id_col}`").alias("key"), F.col(f"row.`{text_col}`").alias("content"))
    found = cut_lineage(near_duplicates(plain, "number", "content", **settings))
    keyed = plain.select("key", F.col("number").alias("n")).join(found, F.col("n") == F.col("number"))
    best = keyed.groupBy("component_id").agg(
        F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "n"))["n"].alias("kept"))
    dropped = lookup(found.join(best.select("kept"), F.col("number") == F.col("kept"), "left_anti")
                     .select(F.col("number").alias("gone")))
    return numbered.join(dropped, F.col("number") == F.col("gone"), "left_anti").select("row.*")


def hex_fingerprint(col: str = "fp"):
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
