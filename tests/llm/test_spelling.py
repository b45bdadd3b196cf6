"""Spelling variants against brute force; the bound of affected grams; long lists."""

import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from graphsift.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n int, a string, `len` int, moved boolean"
LOWER_AZ = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, min_length, min_count, period):
    seen = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER_AZ)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % period == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= min_count}


def brute(words, times):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def made_words(rng, count, alphabet="abé", length=(7, 12)):
    """Words over few letters: many are near, and most grams are frequent."""
    return ["".join(rng.choice(list(alphabet), rng.integers(*length))) for _ in range(count)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = made_words(rng, 300) + ["Straßenbahn", "straßenbahn", "ÀÉÎÕÜŸxyz", "x" * 4000, "x" * 4001, "short", "sixsix"]
    rows = [(int(i), " ".join(rng.choice(words, 30)) + f", Common{'x' * (i % 3)}.") for i in range(120)]
    rows += [(i, "commonword commonword Commonword") for i in range(200, 260)] + [(1, "commonwort"), (2, "commonwort comonwort comonwort")]
    return [*rows, (None, "nullnullnull nullnullnull"), (None, None), (3, None), (4, ""), (5, "4 _ %"), (5, "4 _ %")]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "w", 1, "a", 2, True) for r in rows], SCHEMA).repartition(parts)


def result(df):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


@pytest.mark.parametrize("settings", [{}, {"max_list": 1}, {"share": 0.001, "max_list": 20}])
def test_against_brute_force(spark, rows, settings):
    words = spelling.word_counts(frame(spark, rows), min_length=7, min_count=2, change=spelling.drop_one(31))
    counted = brute_words(rows, 7, 2, 31)
    assert {r.word: r.n for r in words.collect()} == counted
    assert any(n > 100 for n in counted.values())
    got = result(spelling.variants(words, times=10, **settings))
    assert got == brute(counted, 10)
    assert any(f for *_, f, _, _ in got) and sum(n for _, _, n, *_ in got) > 100


def test_an_edit_affects_no_more_grams_than_the_bound():
    rng = np.random.default_rng(5)
    for alphabet, chance in (("ab", 0.5), ("abc", 0.3), ("abcdefgh", 0.1)):
        for word in made_words(rng, 150, alphabet):
            frequent = {g: 5 for q in (2, 3, 4) for g in {f"^{word}$"[i:i + q] for i in range(len(word))} if rng.random() < chance}
            placed = spelling.decompose(word, frequent, 2, 4)
            grams = Counter(g for _, g in placed)
            ends = [p + len(g) - 1 for p, g in placed]
            bound = spelling.affected(placed, len(word), 4)
            assert bound == max(sum(i <= e < i + 4 for e in ends) for i in range(1, len(word) + 1))
            assert bound < len(placed)
            letters = [*alphabet, "z"]
            edits = {word[:i] + x + word[i + cut:] for i in range(len(word) + 1) for cut in (0, 1) for x in ["", *letters]} - {word}
            for other in edits:
                shared = grams & Counter(g for _, g in spelling.decompose(other, frequent, 2, 4))
                assert sum(shared.values()) >= len(placed) - bound, (word, other)


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(40)] + [("x", "w38"), ("y", "z")]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {**{w: "w40" for w, _ in chain[:40]}, "x": "w40", "y": "z"}


def test_empty_and_lonely(spark):
    empty = spelling.word_counts(frame(spark, []))
    assert result(spelling.variants(empty)) == []
    one = spelling.word_counts(frame(spark, [(1, "lonelyword lonelyword")]))
    assert result(spelling.variants(one)) == [("lonelyword", 2, 0, None, None, "lonelyword")]


def test_words_too_short_for_grams(spark):
    words = spelling.word_counts(frame(spark, [(1, "ab ab")]), min_length=1)
    with pytest.raises(ValueError):
        spelling.variants(words, min_length=1)
