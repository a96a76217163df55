"""The pipeline against a brute-force version of its stages on the smallest documents."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pagelake.llm.common import materialize  # noqa: E402
from pagelake.llm.mixing import mixed_documents  # noqa: E402
from pagelake.llm.near_dedup import drop_near_duplicates  # noqa: E402
from tests.llm.test_mixing_sharding import mix_brute, targets_of  # noqa: E402
from tests.llm.test_near_dedup import brute as near_brute  # noqa: E402
from tests.llm.test_rules import stats  # noqa: E402
from tests.llm.test_substring_dedup import brute as cut_brute  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], DATA), "test"))
    rows = [x.collect() for x in seen]
    for x in seen[:-1]:
        assert x.columns == docs.columns
    # quality: with few labels only the base test rejects
    base = [r for r in rows[0] if stats(r.text)[0] >= 10 and 100 * stats(r.text)[5] <= 20 * stats(r.text)[0]]
    assert set(rows[1]) <= set(base)
    # near copies: the smallest id of each group
    groups = near_brute([(r.doc_id, r.text) for r in rows[1]])
    assert {r.doc_id for r in rows[2]} == {k for (k, _), (_, c) in groups.items() if k == c}
    # passages
    cut = cut_brute([(r.doc_id, r.text) for r in rows[2]], 20)
    want = {k: [w for i, w in enumerate(words) if i not in gone] for (k, _), (words, gone) in cut.items() if not gone or len(gone) < len(words)}
    assert {r.doc_id: r.text.encode().split() for r in rows[3]} == want
    assert all(r.n_chars == len(r.text) for r in rows[3] if cut)
    # mix
    plan = mix_brute([(r.doc_id, len(r.text.encode().split()), r.source) for r in rows[3]])
    taken = Counter()
    for r in rows[4]:
        taken[r.doc_id] += len(r.text.encode().split())
        assert want[r.doc_id][: len(r.text.encode().split())] == r.text.encode().split()
    assert taken == Counter({k: n for k, n in plan.items() if n})
    # windows
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows[4])
    assert sum(r.length for r in rows[5]) == tokens
    fill = defaultdict(int)
    for r in rows[5]:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and sum(x < 2048 for x in fill.values()) <= seen[4].rdd.getNumPartitions()
    final = corpus_pipeline.run(spark, DATA)
    assert final.agg(F.sum("length")).first()[0] == tokens
    assert len({zlib.crc32(repr(r.text).encode()) for r in rows[2]}) == len(rows[2])
    assert np.all([r.n_chars >= 0 for r in rows[4]])


def test_stages_of_odd_rows(spark, odd):
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            stage(spark, docs, DATA).count()
        corpus_pipeline.quality(spark, docs, DATA).count()


def test_one_row_of_each_group_stays(spark, odd):
    left = drop_near_duplicates(odd)
    ids = [r.doc_id for r in left.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and left.columns == odd.columns


def test_repeated_rows_share_the_mix(spark, odd):
    rows = [(r.doc_id, len((r.text or "").encode().split()), r.source) for r in odd.collect()]
    total = int(sum(map(int, targets_of(rows).values())))
    got = sum(len(r.text.encode().split()) for r in mixed_documents(odd).collect())
    assert total - 3 <= got <= total


NAMES = "words lines places size source_size taken target before node label kept component_id n_shingles sketch text_hash h of first span row spans stratum good cut".split()


def test_columns_with_clashing_names_stay(spark, odd):
    docs = odd.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES if n not in ("source", "text")])
    docs = materialize(docs, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, DATA), "test")
        assert kept.columns == docs.columns, name
        for r in kept.collect():
            assert all(r[n] == f"{n}-{'none' if r.doc_id is None else r.doc_id}" for n in NAMES), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
