"""The similarity join of texts against all pairs, and its classes in the greedy merge."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import folds, strings, vectors
from topicloom.plans import book, catalogue


def varied(seed, n=120):
    """Titles, many of them edits of others, short and empty and repeated ones, other alphabets."""
    draw = random.Random(seed)
    letters = "aabbcdeefghiilmnoprstuü日x "
    base = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 3, 5, 12, 30, 60]))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        t = list(draw.choice(base))
        for _ in range(draw.choice([0, 1, 2, 5, 9])):
            at = draw.randrange(len(t) + 1)
            t[at : at + draw.choice([0, 1, 1])] = draw.choice(["", "x", "q", "z y"])
        out.append("".join(t))
    out[5] = None
    draw.shuffle(out)
    return out


def table(spark, titles):
    return spark.createDataFrame([(2 * i + 1, t) for i, t in enumerate(titles)], "ord long, title string").repartition(3)


@pytest.mark.parametrize(("seed", "least", "block"), [(1, 80.0, 2048), (2, 80.0, 5), (3, 55.0, 7), (4, 92.0, 3), (5, 30.0, 64), (6, 70.0, 16)])
def test_equals_all_pairs(spark, seed, least, block):
    titles = varied(seed)
    got = [(r["i"], r["j"], round(r["ratio"], 9)) for r in strings.alike_rows(table(spark, titles), least, text="title", block=block).collect()]
    want = {}
    for i in range(len(titles)):
        for j in range(i + 1, len(titles)):
            # The ratio may differ with the side that a text is on: a class's first member decides.
            a, b = sorted((strings.sorted_words(titles[i]), strings.sorted_words(titles[j])), key=lambda s: min(k for k, t in enumerate(titles) if strings.sorted_words(t) == s))
            ratio = 100 * difflib.SequenceMatcher(None, a, b).ratio()
            if ratio >= least:
                want[2 * i + 1, 2 * j + 1] = round(ratio, 9)
    assert len(got) == len({g[:2] for g in got}) and {g[:2]: g[2] for g in got} == want


def test_postings_of_a_common_gram_are_in_blocks(spark):
    rows = spark.range(900).select(F.col("id").alias("ord"), F.concat(F.lit("common words here "), F.col("id") % 450).alias("title"))
    found, members = strings.classes(rows, text="title")
    assert found.count() == 450 and members.count() == 900
    posts = strings._postings(found, 0.8, strings.gram_length(0.8), 32)
    a = posts.select("gram", "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"))
    assert a.groupBy("gram", "part", "other").count().agg(F.max("count")).first()[0] <= 64


@pytest.mark.parametrize("least", [55.0, 85.0])
def test_topics_of_classes_are_topics_of_rows(spark, least):
    titles = varied(9, 60)
    rows = table(spark, titles)
    want = {r["node"]: r["topic"] for r in vectors.greedy_merge(rows, strings.alike_rows(rows, least, text="title")).collect()}
    assert {r["node"]: r["topic"] for r in strings.topics(rows, least, text="title").collect()} == want


def test_gram_length():
    assert [strings.gram_length(r) for r in (0.3, 0.55, 0.7, 0.8, 0.9, 1.0)] == [1, 1, 1, 2, 3, 3]


def test_nothing(spark):
    none = spark.createDataFrame([], "ord long, title string")
    assert strings.alike_rows(none, text="title").collect() == [] and strings.topics(none, text="title").collect() == []


def test_registered_pairs(spark, sf_dir):
    first = {}
    for r in sorted(book.articles(spark, sf_dir).select("ord", "title").collect(), key=lambda r: r["ord"]):
        first.setdefault(strings.sorted_words(r["title"]), r["ord"])
    known = sorted(first.items(), key=lambda x: x[1])
    want = set()
    for k, (a, i) in enumerate(known):
        for b, j in known[k + 1 :]:
            m = difflib.SequenceMatcher(None, a, b)
            if m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and 100 * m.ratio() >= 80.0:
                want.add((i, j, round(100 * m.ratio(), 6)))
    assert {(r["i"], r["j"], r["ratio"]) for r in catalogue.QUERIES["alike_title_pairs"](spark, sf_dir).collect()} == want
    assert folds.token_sort_ratio("b A", "a b") == 100.0


@pytest.mark.parametrize(("seed", "least", "block"), [(1, 80.0, 2048), (2, 80.0, 5), (3, 55.0, 7), (4, 92.0, 3), (5, 30.0, 64), (7, 100.0, 4)])
def test_lengths_and_grams_find_the_same(spark, seed, least, block):
    found, _ = strings.classes(table(spark, varied(seed, 240)), text="title")
    by = [{(r["i"], r["j"], r["ratio"]) for r in strings.alike(found, least, block, grams).collect()} for grams in (True, False)]
    assert by[0] == by[1] and (by[0] or least == 100.0)


def test_common_subsequence_against_a_table():
    draw = random.Random(3)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(1, 70))) for _ in range(2))
        row = [0] * (len(a) + 1)
        for c in b:
            row = _next(row, a, c)
        for need in range(max(1, row[-1] - 2), min(len(a), len(b), row[-1] + 2) + 1):
            assert strings._reaches(strings._places(a), len(a), b, need) == (row[-1] >= need)
        assert strings._common(["xa", a], [b, "c"], np.array([1, 1]), np.array([0, 1])).tolist() == [row[-1], int("c" in a)]


def _next(row, a, c):
    out = [0]
    for k, d in enumerate(a):
        out.append(row[k] + 1 if c == d else max(row[k + 1], out[k]))
    return out


def test_long_lines_of_the_same_syllables_meet_by_length(spark, monkeypatch):
    """Nearly every text has nearly every q-gram: an index of them would hold more meetings than there are pairs."""
    draw = random.Random(5)
    words = ["en", "the", "ing", "on", "ti", "ha", "er", "or"]
    lines = [" ".join("".join(draw.choice(words) for _ in range(3)) for _ in range(18)) for _ in range(60)]
    lines += [x[:-3] + "q" for x in lines[:9]]
    found, _ = strings.classes(table(spark, lines), text="title")
    monkeypatch.setattr(strings, "_candidates", lambda *_: pytest.fail("by q-grams"))
    assert strings.alike(found, 92.0).count() >= 9


def test_long_texts_by_their_rare_characters(spark):
    """Texts of about 200 characters and more, of which difflib leaves frequent characters out: against all pairs."""
    draw = random.Random(11)
    base = [" ".join("".join(draw.choice("eeenrtiaosdhqzxj") for _ in range(draw.randrange(2, 9))) for _ in range(n)) for n in (28, 36, 60, 90)]
    lines = list(base)
    for k in range(50):
        words = draw.choice(base).split()
        for _ in range(k % 12):
            words[draw.randrange(len(words))] = "".join(draw.choice("eenrtiq") for _ in range(5))
        lines.append(" ".join(words))
    found, _ = strings.classes(table(spark, lines), text="title")
    known = sorted((r["node"], r["s"]) for r in found.collect())
    ratios = {(i, j): 100 * difflib.SequenceMatcher(None, a, b).ratio() for k, (i, a) in enumerate(known) for j, b in known[k + 1 :]}
    for least in (60.0, 80.0):
        got = {(r["i"], r["j"]): r["ratio"] for r in strings.alike(found, least, 9, False).collect()}
        assert got == {p: v for p, v in ratios.items() if v >= least} and len(got) > 10


def test_minima_of_counts_by_products():
    """Exact where levels suffice, else never too small, by steps or with what is above the first levels."""
    draw = np.random.default_rng(2)
    a, b = draw.poisson(1.5, (30, 40)), draw.poisson(2.5, (20, 40))
    want = np.minimum(a[:, None], b).sum(axis=2)
    found, exact = strings._minima(a, b, 1000)
    assert exact and (found == want).all()
    for cap in (False, True):
        found, exact = strings._minima(a, b, 90, cap=cap)
        assert not exact and (found >= want).all() and (found - want).mean() < 60
    assert strings._minima(a[:0], b, 9)[0].shape == (0, 20)


def test_pairs_that_cannot_reach_their_need_are_left_early():
    draw = random.Random(8)
    left, right = (["".join(draw.choice("abcdef") for _ in range(draw.randrange(60, 190))) for _ in range(25)] for _ in range(2))
    right[:5] = [s[:-3] for s in left[:5]]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(25), np.arange(25), indexing="ij"))
    whole = strings._common(left, right, i, j)
    need = strings._needed(np.array([len(left[a]) + len(right[b]) for a, b in zip(i, j, strict=True)]), 0.8)
    some = strings._common(left, right, i, j, need)
    assert ((some >= need) == (whole >= need)).all() and (some[whole >= need] == whole[whole >= need]).all()
    assert (some < whole).any() and (whole >= need).sum() >= 5
