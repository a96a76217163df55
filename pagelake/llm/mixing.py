"""Mixing sources to target weights (operator 2): capped water-filling.

A budget of words is shared over the sources by weight. A source that would get
more than ``epochs`` times its size is clamped there and what it leaves goes to
the others by weight, until none is above its clamp. Sources sorted by clamp per
weight are clamped in that order, so the fixed point is one running sum away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import Tables, number_rows, word_count

#: Fixed values of the production query: weights in code point order of the sources.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, *, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``source, source_size, target`` of every source (null is a source, last in order).

    ``weights`` repeat over the sources in code point order; the budget is
    ``share`` times all sizes. If every source is clamped the budget stays short.
    A source of size 0 has target 0.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    per = per.withColumn("last", F.col("source").isNull().cast("int")).withColumn("one", F.lit(1).cast("long"))
    ranked = number_rows(per, ["last", "source"], by=[], sums={"rank": "one"}, name="sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * epochs)
    ranked = ranked.withColumn("ratio", F.col("most") / F.col("weight"))
    filled = number_rows(ranked, ["ratio", "last", "source"], by=[], sums={"clamped": "most", "passed": "weight"}, name="levels")
    total, weighed = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()  # one row of sums
    level = (F.lit(float(total) * share) - F.col("clamped")) / (F.lit(float(weighed)) - F.col("passed"))
    free = filled.withColumn("level", level).where(F.col("weight") * F.col("level") <= F.col("most"))
    found = free.agg(F.min_by("level", F.struct("ratio", "last", "source"))).first()[0]  # one number
    target = F.col("most").cast("double") if found is None else F.least(F.col("most").cast("double"), F.col("weight") * F.lit(found))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Words that the mix takes from each row: ``doc_id, text_hash, size, source, source_size, target, taken``.

    Every document of a source is repeated as often as whole epochs fit its
    target. The fraction left goes to documents in the order of a seeded hash of
    the id, each once more, until it is used up; the last of them gives a part,
    so a source's sum is its target rounded down. Null texts have size 0. Equal
    ids are ordered by size; rows that agree in both are alike. No rows give none; a very
    long text is a large document, of which a part may be taken, and only its size is moved.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
    )
    tables = Tables(docs.sparkSession, "mix")
    rows = tables.write(rows, "sizes")  # texts are read once
    rows = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    ordered = number_rows(rows, ["h", "doc_id", "size"], by=["source"], sums={"before": "size"}, name="mix", tables=tables)
    tables.drop("sizes")
    targets = source_targets(ordered.select("source", "size"), weights=weights, share=share, epochs=epochs)
    targets = targets.withColumnRenamed("source", "of")
    want = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), want - whole * F.col("source_size") - F.col("before")))
    return ordered.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "text_hash", "size", "source", "source_size", "target", (whole * F.col("size") + extra).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, all columns as they are.

    A part of a document is a row with its first words, one space between them.
    Rows alike in id, text and source share what they give evenly, rounded down.
    Rows of which nothing is taken, such as those without words, do not appear.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    plan = plan.groupBy(F.col("doc_id").alias("_mx_id"), F.col("text_hash").alias("_mx_hash"), F.col("source").alias("_mx_source"), F.col("size").alias("_mx_size"))
    plan = plan.agg(F.floor(F.sum("taken") / F.count("*")).cast("long").alias("_mx_taken")).where("_mx_taken > 0")
    same = docs[id_col].cast("long").eqNullSafe(F.col("_mx_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_mx_hash")) & docs[source_col].cast("string").eqNullSafe(F.col("_mx_source"))
    parts = F.ceil(F.col("_mx_taken") / F.col("_mx_size")).cast("int")
    rows = docs.join(plan, same).withColumn("_mx_part", F.explode(F.sequence(F.lit(1), parts)))
    left = F.col("_mx_taken") - (F.col("_mx_part") - 1) * F.col("_mx_size")
    words = F.array_remove(F.split(F.col(text_col).cast("string"), r"[\x20\x09-\x0D]+"), "")
    text = F.when(left >= F.col("_mx_size"), F.col(text_col)).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), " "))
    return rows.withColumn(text_col, text).select(*docs.columns)
