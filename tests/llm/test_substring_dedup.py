import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagelake.llm import common, queries, substring_dedup
from pagelake.llm.recompression import Words, anchors
from pagelake.llm.substring_dedup import dedup_substrings
from tests.llm.test_near_dedup import morse


def brute(rows, window):
    """(id, text) to (words, removed word indexes); equal rows are one document."""
    seen, out = {}, {}
    for key, text in sorted({(k, t) for k, t in rows}, key=lambda r: (-1 if r[0] is None else r[0])):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i : i + window]), (key, i)) != (key, i):
                gone.update(range(i, i + window))
        out[key, text] = words, gone
    return out


def make(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range((2, 5, 400)[seed % 3])]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(window - 1, 4 * window))] for _ in range(6)]
    rows = []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 3 * window))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = p
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(i + 100, rows[i][1]) for i in range(0, 80, 9)] + [rows[3], rows[3]]
    rows += [(300, "same " * 5 * window), (301, "a b " * 3 * window), (302, "same " * window), (303, None), (304, ""), (305, " \n "), (None, rows[5][1])]
    return rows


def check(spark, rows, window):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_removed string").repartition(5)
    got = dedup_substrings(docs.withColumn("_spans", F.lit(1)), window).collect()
    want = brute(rows, window)
    assert len(got) == len(rows)
    texts = {k: t for k, t in rows}
    for r in got:
        words, gone = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_words, r.n_removed) == (len(words), len(gone)), r.doc_id
        assert {i for s in r.removed for i in range(s.start, s.end)} == gone
        assert (r.text or "").encode().split() == [w for i, w in enumerate(words) if i not in gone]
        if not gone:
            assert r.text == texts[r.doc_id]


@pytest.mark.parametrize("seed,window", [(0, 4), (1, 4), (2, 20), (1, 20), (2, 1), (4, 7)])
def test_against_brute_force(spark, seed, window):
    check(spark, make(seed, window), window)


def test_different_words_of_equal_sums_are_not_repeats(spark):
    rows = []
    for size in (128, 255, 256, 1024, 4096):
        x, y = morse(size), morse(size, True)
        rows += [(len(rows) + i, " ".join([*[f"w{j}" for j in range(10)], w, *[f"w{j}" for j in range(10, 20)]])) for i, w in enumerate((x, y))]
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate((x, y))]
    check(spark, [*rows, (100, rows[4][1])], 20)


def test_repeats_across_the_batches_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 200)
    monkeypatch.setattr(common.text_chunks, "__defaults__", (200,))
    monkeypatch.setattr(substring_dedup, "KEPT_PLACES", 50)
    check(spark, make(2, 7)[::-1], 7)


def test_every_window_has_one_anchor_and_equal_windows_equal_ones():
    for seed in range(6):
        texts = [(t or "").encode() for _, t in make(seed, 20)]
        words = Words(texts)
        key, low, high = anchors(words, 20)
        found = {}
        for k, a, b in zip(key.tolist(), low.tolist(), high.tolist()):
            for s in range(a, b + 1):
                assert s not in found
                found[s] = k
        flat = [w for t in texts for w in t.split()]
        same = {}
        for i, t in enumerate(texts):
            for s in range(int(words.first[i]), int(words.first[i + 1]) - 19):
                assert same.setdefault(tuple(flat[s : s + 20]), found[s]) == found[s]
        assert len(found) == sum(max(0, len(t.split()) - 19) for t in texts)


def test_query_on_real_documents(spark):
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for (key, _), (words, gone) in brute(rows, 20).items():
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert (got[key].n_words, got[key].n_removed, got[key].kept_sha256) == (len(words), len(gone), hashlib.sha256(kept).hexdigest())


def test_of_nothing(odd):
    assert dedup_substrings(odd.limit(0)).count() == 0
