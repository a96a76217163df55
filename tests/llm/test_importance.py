"""Importance resampling against scalar code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import importance
from pagelake.llm.common import Tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = WORD.findall((text or "").translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, buckets=10000, longest=1, share=10, least=20):
    made = [(i, text, *grams(text, longest)) for i, text in rows]
    s, t = Counter(c % buckets for r in made for c in r[3]), Counter(c % buckets for x in target for c in grams(x, longest)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text, n, crcs in made:
        weight = sum(gain[c % buckets] for c in crcs) // len(crcs) if crcs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), zlib.crc32((text or "").encode())))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, x[5]))
    drawn = able[: share * len(able) // 100]
    ranks = Counter((x[0], *x[2:5], k) for k, x in enumerate(drawn, 1))
    return ranks + Counter((x[0], *x[2:5], None) for x in out) - Counter((*x[:4], None) for x in ranks)


@pytest.mark.parametrize("longest,share,few", [(1, 10, 4096), (1, 60, 2), (3, 35, 1), (1, 0, 9), (1, 100, 3)])
def test_resample(spark, odd, odd_rows, longest, share, few):
    rng = random.Random(share)
    rows = [(r[0], r[1]) for r in odd_rows] + [(1000 + i // 3, " ".join(rng.choices(["the", "Of", "cat", "äx", "9"], k=rng.randint(15, 40)))) for i in range(120)]
    rows += [(2000, " ".join("abcdefghijklmnopqrstuvwxyz"))] * 40  # repeated rows on both sides of a cutoff
    target = ["the cat of the cat", None, "", "ünï dog 12 5"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest, share=share, few=few).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == brute(rows, target, longest=longest, share=share)


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(importance, "_PIECE", 11)
    text = "the cat sat on a mat and-more words 1 2 3 " * 9 + "x" * 40
    for longest in (1, 2, 4):
        parts = list(importance.features(text.encode(), importance.Sums(), longest))
        n, want = grams(text, longest)
        assert sum(p[0] for p in parts) == n
        assert Counter(np.concatenate([p[1] for p in parts]).tolist()) == Counter(want)


def test_kth_key(spark):
    rng = random.Random(4)
    keys = [(rng.randint(-3, 3), rng.randint(-2, 2), rng.randint(0, 1), i) for i in range(3000)]
    for order in (keys, sorted(keys)):  # partitions of like keys too
        df = spark.createDataFrame(order, "_a long, _b long, _c long, _d long").repartitionByRange(7, "_a") if order is not keys else spark.createDataFrame(order, "_a long, _b long, _c long, _d long")
        for k in (1, 2, 1499, 3000):
            assert importance.kth_key(df, k, Tables(spark, "kth"), few=1) == sorted(keys)[k - 1]
        assert importance.kth_key(df, 3001, Tables(spark, "kth")) is None
        assert importance.kth_key(df, 0, Tables(spark, "kth")) is None


def test_empty_and_drawn_rows(spark, odd):
    none, target = odd.limit(0), spark.createDataFrame([("the cat",)], "text string")
    assert importance.resample(none, target).count() == 0
    assert importance.resample(odd, target.limit(0)).count() == odd.count()
    drawn = importance.drawn_documents(odd, target, share=50)
    assert drawn.columns == odd.columns and 0 < drawn.count() < odd.count()
