"""A corpus in five stages: quality, near copies, repeated passages, mix, windows.

Every stage takes documents (doc_id, text, lang, source, n_chars and any more columns)
and works on all that the stage before has kept. Nulls, empty texts, repeated rows
and empty tables pass through each stage with the results named there. Further columns
stay, also those with names that a stage uses itself, but for ``n_words``, ``n_removed``
and ``removed``, which the cutting of passages replaces; names that begin with ``_`` are
kept for the stages. The last stage returns pieces. A very long text is one row like others;
a task holds it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import materialize
from pagelake.llm.mixing import mixed_documents
from pagelake.llm.near_dedup import drop_near_duplicates
from pagelake.llm.packing import pack_documents
from pagelake.llm.quality_rules import drop_rejected
from pagelake.llm.queries import vocabulary
from pagelake.llm.substring_dedup import dedup_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, cutoffs from the labels.

    Null and empty texts have too few words and go. Rows alike in id and text, null ids
    too, share a verdict and stay or go together. A null language is a stratum.
    """
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id.

    Of rows with one id one stays, repeated rows too. Rows with a null id and texts
    without words are copies of nothing and stay.
    """
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 20-word passages that start earlier; documents of nothing else go.

    Rows alike in id and text are one document and are cut alike; a null id comes
    before all others. Null and empty texts stay as they are. ``n_chars`` is counted
    anew (null for a null text).
    """
    cut = dedup_substrings(docs, 20).where("n_removed = 0 OR n_removed < n_words")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one, too.

    Documents of which nothing is taken, such as null and empty texts, go. Rows alike
    in id, text and source share what they give evenly. ``n_chars`` is counted anew.
    """
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens.

    A null or empty text is its end token alone; repeated rows are packed each time, and
    so are rows with a null id. A very long text fills several windows.
    """
    return pack_documents(docs, tokenizer=vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("windows", windows),
]

#: Fingerprints, tokenizers and packing are not SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, a written table between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
