import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import common, near_dedup
from pagelake.llm.near_dedup import components, near_duplicate_groups


def sets_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """(doc_id, text) to (size, component); rows with one id share a component."""
    sets = {(k, t): sets_of(t) for k, t in rows}
    up = {k: k for k, _ in rows if k is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    items = [(k, s) for (k, _), s in sets.items() if k is not None and s]
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {(k, t): (len(s), None if k is None else root(k) if s else k) for (k, t), s in sets.items()}


def make(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 150, 400]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words += shared
        rows.append((i, " ".join(words if rng.random() < 0.8 else map(str.upper, words))))
    rows += [(1000 + i, rows[i][1]) for i in range(0, n, 7)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, rows[0][1]), (None, None), rows[4], (2003, "one"), (2004, "ONE")]
    return rows


@pytest.mark.parametrize("seed,chunk,block,lists,few", [(0, 512, 256, 128, 1000), (1, 16, 8, 128, 1000), (2, 5, 3, 4, 3)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, block, lists, few):
    monkeypatch.setattr(common, "FEW_ROWS", few)
    monkeypatch.setattr(near_dedup, "LIST", lists)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", block)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    monkeypatch.setattr(near_dedup, "TASK_EDGES", 1 << 18 if seed < 2 else 20)
    rows = make(seed, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("x")).withColumn("label", F.lit(1))
    got = near_duplicate_groups(docs.repartition(6))
    want = brute(rows)
    texts = {}
    for k, t in rows:
        texts.setdefault((k, len(sets_of(t))), t)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        size, component = want[r.doc_id, texts[r.doc_id, r.n_shingles]]
        assert (r.n_shingles, r.component_id) == (size, component), r
        assert r.kept == (r.doc_id is None or r.doc_id == component)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    by_id = {k: v for (k, _), v in want.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_groups(docs).collect()} == by_id


def test_of_nothing(spark):
    assert near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def morse(n, swap=False):
    """The Thue-Morse word of n letters, or its mirror image."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_different_words_of_equal_sums_are_not_linked(spark, size):
    x, y = morse(size), morse(size, True)
    rows = [(0, x), (1, y), (2, x.upper()), (3, f"a {x} b c d e"), (4, f"a {y} b c d e"), (5, " ".join(x)), (6, " ".join(y))]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == {k: c for (k, _), (_, c) in want.items()}


def test_lower_similarity_loses_no_links(spark):
    """Texts of 200 shingles and longer ones of 390 that begin with them: half of a sketch is shared."""
    rows = [(2 * i + j, " ".join(f"p{i}c{k}" for k in range((204, 394)[j]))) for i in range(80) for j in (0, 1)]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=50).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - k % 2 for k, _ in rows}


def test_shared_values_by_similarity(spark):
    assert [near_dedup.shared_at_least(x) for x in (26, 50, 75, 90, 100)] == [1, 11, 27, 41, 64]
    for percent in (25, 101):
        with pytest.raises(ValueError):
            near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string"), percent=percent)


@pytest.mark.parametrize("limit,few", [(1 << 18, 200), (50, 200), (50, 3)])
def test_components_of_random_graphs(spark, monkeypatch, limit, few):
    monkeypatch.setattr(near_dedup, "TASK_EDGES", limit)
    monkeypatch.setattr(common, "FEW_ROWS", few)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2500, i) for i in range(2000, 2080)]
    up = {x: x for e in edges for x in e}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), common.Tables(spark, "t"), "t").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
