"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelake.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=5):
    out, forms = {}, {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        best = min(found, key=lambda v: (-words[v], v)) if found else None
        forms[w] = best if best and words[best] >= ratio * n else None
        out[w] = len(found)

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {(w, forms[w], root(w), n, out[w], words[forms[w]] if forms[w] else None) for w, n in words.items()}


def result(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("group,region,letters,longest", [(4096, 32, "ab", 9), (4, 32, "ab", 9), (1, 1, "abé", 7), (4096, 2, "abcd", 14), (50, 32, "a", 40)])
def test_variants(spark, group, region, letters, longest):
    rng = random.Random(group + region)
    words = {"".join(rng.choices(letters, k=rng.randint(1, longest))): rng.choice([1, 2, 5, 5, 30, 200, 5000]) for _ in range(400)}
    for w in list(words)[:100]:
        i = rng.randint(0, len(w))
        words[w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :]] = rng.choice([1, 7, 40])
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert result(spelling.spelling_variants(df, group=group, region=region)) == brute(words)


def test_very_long_words_and_a_hot_beginning(spark):
    rng = random.Random(8)
    head, tail = "a" * 30, "b" * 3000
    words = {head + "".join(rng.choices("xyz", k=5)) + tail: rng.randint(1, 100) for _ in range(120)}
    words |= {"x" * 100_000: 7, "x" * 100_001: 70, "": 5}
    df = spark.createDataFrame([*words.items(), (None, 3)], "word string, n long")
    got = result(spelling.spelling_variants(df, group=8))
    assert got == brute(words)


def test_words_of_one_place_edits():
    short, long = ["ab", "aa", "bb"], ["aab", "abb", "xab", "abx"]
    for last in (True, False):
        got = sorted(spelling._pairs(short, long, last))
        assert len(got) == len(set(got))
        assert {p for p in got if len(p[0]) == len(p[1])} == {("ab", "aa"), ("aa", "ab"), ("ab", "bb"), ("bb", "ab")} & set(got)
        assert (("ab", "abx") in got) == last and ("ab", "xab") in got and ("ab", "aab") in got


def test_word_counts(spark, odd, odd_rows):
    rng = random.Random(2)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r[0], r[1]) for r in odd_rows] + [(i, " ".join("".join(rng.choices("aÉe×Z", k=6)) for _ in range(300)) + "日本dreißigste÷ok Ωlonger") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    for blur in (None, 3, 199):
        want: Counter = Counter()
        for i, text in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                w = w.translate(low)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if blur and h % blur == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                want[w] += 1
        got = {r.word: r.n for r in spelling.word_counts(docs, blur=blur).collect()}
        assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}


def test_no_words(spark, odd):
    assert spelling.spelling_groups(odd.limit(0)).count() == 0
    one = spark.createDataFrame([("single", 9)], "word string, n int")
    assert result(spelling.spelling_variants(one)) == {("single", None, "single", 9, 0, None)}
