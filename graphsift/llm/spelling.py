"""Spelling variants: words one edit apart, found by variable-length grams.

Words are counted over all documents. Two words are near if one inserted,
deleted or replaced code point turns one into the other; a word's form is its
most frequent near word if that is far more frequent, and forms are followed to
the root.

Near words are found with a variable-length gram index:

* **Dictionary.** All grams of ``q_min`` to ``q_max`` code points of the words
  (with a start and an end mark) are counted. A gram is frequent if it has more
  than ``share`` of all gram places; the dictionary is what no frequent gram
  can be replaced by: grams are extended while they are frequent. So only the
  frequent grams travel to the tasks, at most ``1 / share`` of each length.
* **Decomposition.** From every place of a word the shortest gram that is not
  frequent (or ``q_max`` long, or at the word's end) is taken; grams inside an
  earlier gram go.
* **Affected grams.** Whether the gram that ends at e is in the decomposition
  depends on the ``q_max`` characters up to e alone. One edit at i can thus
  affect the grams that end in i .. i + q_max - 1; their largest number over
  all i is the word's bound. Near words share at least (grams - bound) grams,
  at places that differ by the length difference at most. The first and the
  last gram are never affected together in words of at least 2 * q_max - 2
  code points, so that number is at least 1 for every word: no word needs
  another way.
* **Merging the lists.** Lists are keyed by gram, place and length. Of a word's
  grams, rarest first, the first ``bound + 1`` hold one that is shared, so only
  these lists are merged. A pair that meets goes on if neither word has more grams
  without a match in the other than its bound, told by 64-bit maps of the grams.
* **Verification** by edit distance over code points.

A list of more than ``max_list`` words is dealt out further: by the word
without one character, and that character's place. Words of equal length that
differ at that place, and a word and its longer neighbour, meet there; no list
is joined with itself at quadratic cost, whatever share of the words it holds.

Edge cases: a null text has no words; a null id counts as an empty one where
words depend on it; very long texts are split into words in the JVM, very long
words are decomposed whole; ties between forms go to the smallest in code-point
order; repeated rows count as often as they occur; an empty table, or one
without near words, gives words without form; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsift.llm.common import map_texts
from graphsift.operators.joins import broadcast_if_small
from graphsift.session import cut_lineage, drop_table

LETTERS = r"A-Za-zÀ-ÿ"
START, END = "^", "$"       # not letters
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2,
                change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): lower-cased (A-Z) runs of letters with at least ``min_length``
    code points and ``min_count`` occurrences in all texts. ``change`` maps
    (id, run) to the word that the run stands for, which must not be longer."""
    run = f"[{LETTERS}]{{{min_length},}}+"
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(run), F.lit(0))
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    word = F.col("run") if change is None else change(F.col("id"), F.col("run"))
    return (found.select(word.alias("word")).where(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def drop_one(period: int = 31) -> Callable[[Column, Column], Column]:
    """A ``change`` that deletes one code point of some occurrences: if
    ``period`` divides h, the CRC-32 of ``<id>:<run>``, that at h % length."""
    def change(key: Column, run: Column) -> Column:
        h = F.crc32(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run), "utf-8"))
        at = (h % F.char_length(run)).cast("int")
        without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
        return F.when(h % period == 0, without).otherwise(run)
    return change


def frequent_grams(words: DataFrame, q_min: int, q_max: int, share: float) -> dict[str, int]:
    """Grams of ``q_min`` to ``q_max`` code points with more than ``share`` of
    all places, and their counts: at most ``(q_max - q_min + 1) / share`` of them."""
    marked = F.concat(F.lit(START), F.col("word"), F.lit(END))
    places = words.agg(F.sum(F.char_length("word") + 2)).first()[0] or 0
    at = words.select(marked.alias("w"), F.explode(F.sequence(F.lit(1), F.char_length("word") + 3 - q_min)).alias("p"))
    grams = at.select(F.explode(F.array(*[
        F.when(F.col("p") + q - 1 <= F.char_length("w"), F.substring("w", F.col("p"), F.lit(q)))
        for q in range(q_min, q_max + 1)])).alias("gram")).where(F.col("gram").isNotNull())
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > share * places)
    return {r["gram"]: r["n"] for r in found.collect()}


def decompose(word: str, frequent: dict[str, int], q_min: int, q_max: int) -> list[tuple[int, str]]:
    """(place, gram) of the marked word, left to right, none inside an earlier one."""
    w, out, covered = f"{START}{word}{END}", [], -1
    for p in range(len(w) - q_min + 1):
        end = p + q_min
        while end - p < q_max and end < len(w) and w[p:end] in frequent:
            end += 1
        if end > covered:
            out.append((p, w[p:end]))
            covered = end
    return out


def affected(grams: list[tuple[int, str]], length: int, q_max: int) -> int:
    """Most grams that one edit in a word of ``length`` code points can affect:
    those that end within ``q_max`` places from the edit on. Ends ascend."""
    ends = [p + len(g) - 1 for p, g in grams]
    most = stop = 0
    for k, e in enumerate(ends):
        last = min(e, length) + q_max
        while stop < len(ends) and ends[stop] < last:
            stop += 1
        most = max(most, stop - k)
    return most


def index_entry(word: str, frequent: dict[str, int], q_min: int, q_max: int) -> tuple[list[str], list[int], int, int]:
    """(grams of the lists to merge, their places, bit map of all grams, bound
    of affected grams)."""
    grams = decompose(word, frequent, q_min, q_max)
    bound = affected(grams, len(word), q_max)
    rare = sorted(grams, key=lambda g: (frequent.get(g[1], 0), g[1], g[0]))[:bound + 1]
    bits = 0
    for _, g in grams:
        bits |= 1 << (crc32(g.encode()) & 63)
    return [g for _, g in rare], [p for p, _ in rare], bits - (bits >> 63 << 64), bound


def near_pairs(words: DataFrame, min_length: int = 7, q_min: int = 2, q_max: int = 4, share: float = 2e-5,
               max_list: int = 1000) -> DataFrame:
    """(a, an, b, bn): all pairs of near words of ``words`` (word, n), once each;
    all have at least ``min_length`` code points."""
    q_max = min(q_max, (min_length + 2) // 2)
    if q_max < q_min:
        raise ValueError("words are too short for the grams")
    grams = words.sparkSession.sparkContext.broadcast(frequent_grams(words, q_min, q_max, share))

    def entries(batch: list[str]) -> list[tuple]:
        return [index_entry(w, grams.value, q_min, q_max) for w in batch]

    out = "lists array<string>, places array<int>, map bigint, bound int"
    indexed = map_texts(words, "word", "word", entries, out, 4096, keep=["n"])
    index = cut_lineage(indexed.select("word", "n", F.char_length("word").alias("len"), "map", "bound",
                                       F.explode(F.arrays_zip("lists", "places")).alias("at"))
                        .select("word", "n", "map", "bound", "len", F.col("at.lists").alias("gram"),
                                F.col("at.places").alias("place")))
    named = [F.col(c).alias(f"l_{c}") for c in ("gram", "len", "place")]
    long_lists = cut_lineage(index.groupBy("gram", "len", "place").agg(F.count("*").alias("c"))
                             .where(F.col("c") > max_list).select(*named))
    row = ["word", "n", "map", "bound"]
    left = index.select(*row, "gram", "len", "place", F.lit(None).cast("boolean").alias("longer"))
    # The other word of a pair is as long, or longer by one and its gram at the same place or one on.
    right = index.select(*row, "gram", F.explode(F.array(*[
        F.struct((F.col("len") - d).alias("len"), (F.col("place") - s).alias("place"), F.lit(d == 1).alias("longer"))
        for d, s in ((0, 0), (1, 0), (1, 1))])).alias("key")).select(*row, "gram", "key.len", "key.place", "key.longer")
    right = right.where(F.col("len") >= min_length)
    # Lists are joined on a hash of what names them: rows stay narrow, and what meets by chance is no pair.
    left, right = (_deal_out(x, long_lists).select(F.xxhash64("gram", "len", "place", "part").alias("key"), *row, "longer")
                   for x in (left, right))
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in ("key", *row)])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in ("key", *row, "longer")])
    once = F.col("b_longer") | (F.col("a_word") < F.col("b_word"))
    rest_a = F.bit_count(F.col("a_map").bitwiseAND(F.bitwise_not("b_map"))) <= F.col("a_bound")
    rest_b = F.bit_count(F.col("b_map").bitwiseAND(F.bitwise_not("a_map"))) <= F.col("b_bound")
    near = F.levenshtein("a_word", "b_word", 1) == 1
    met = a.join(b, (F.col("a_key") == F.col("b_key")) & rest_a & rest_b & once & near)
    return met.select(F.col("a_word").alias("a"), F.col("a_n").alias("an"), F.col("b_word").alias("b"),
                      F.col("b_n").alias("bn")).distinct()


def _deal_out(rows: DataFrame, long_lists: DataFrame) -> DataFrame:
    """``rows`` with a column ``part``: empty, or in long lists what is left of
    the word without one character, a row for each character.

    A row without ``longer`` takes both sides' names: a word as long as the
    other leaves out the same place, a word one shorter is the rest itself.
    """
    flagged = rows.join(broadcast_if_small(long_lists), (F.col("gram") == F.col("l_gram")) & (F.col("len") == F.col("l_len"))
                        & (F.col("place") == F.col("l_place")), "left")
    cuts = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.concat(
        F.when(F.coalesce("longer", F.lit(False)), F.lit("")).otherwise(i.cast("string")),
        F.lit(":"), F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.char_length("word"))))
    whole = F.when(F.col("longer").isNull(), F.array(F.concat(F.lit(":"), "word")))
    whole = whole.otherwise(F.array().cast("array<string>"))
    parts = F.when(F.col("l_gram").isNull(), F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(cuts, whole)))
    return flagged.select(*rows.columns, F.explode(parts).alias("part"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) in which forms never lead back:
    every round follows twice as many forms as the one before."""
    current = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not current.where("moved").isEmpty():
        on = current.select(F.col("word").alias("next"), F.col("root").alias("further"))
        moved = cut_lineage(current.join(on, F.col("root") == F.col("next"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_table(current)
        current = moved
    return current.select("word", "root")


def variants(words: DataFrame, min_length: int = 7, times: int = 10, **settings) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n) of distinct
    words. A form is at least ``times`` as frequent as its word."""
    words = cut_lineage(words)
    pairs = near_pairs(words, min_length, **settings)
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("other"), F.col("bn").alias("m")).unionByName(
        pairs.select(F.col("b").alias("w"), F.col("a").alias("other"), F.col("an").alias("m")))
    best = both.groupBy("w").agg(F.count("*").alias("near"),
                                 F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    chosen = -F.col("best.minus") >= times * F.col("n")
    named = cut_lineage(words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.minus")).alias("form_n")))
    last = roots(named.where("form IS NOT NULL").select("word", "form")).select(F.col("word").alias("r"), "root")
    return named.join(last, F.col("word") == F.col("r"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
