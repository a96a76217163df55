"""Quality rules with risk-controlled cutoffs (operator 8), in DataFrame functions only.

Each rule is a score per document in thousandths, higher is worse. In every
stratum (language) a rule may reject from a cutoff upwards. Labelled documents
decide the cutoff: a candidate is certified if an exact binomial test shows that
it rejects less than its share of ``alpha`` of the good documents. A document goes if
any rule rejects it, so each of the rules gets an equal share of ``alpha``: together
they reject less than ``alpha`` of a stratum's good documents. The error level
``delta`` is split over all rules and strata (Bonferroni). Within a rule the candidates
are nested, lenient first, so testing them in that order needs no further correction.
The guarantee is for good documents that pass the base test; those that fail it
are rejected whatever the labels say.
Of the certified candidates the one that serves best is used: most bad documents
rejected, a good one counting against it ``cost`` times, the most lenient on ties.
Without enough labels nothing is certified and nothing is rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagelake.llm.common import materialize

#: Fixed values of the production rules.
RULES = ("symbols", "dup_lines", "repeats", "capitals")
CUTOFFS = (5, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
ALPHA, DELTA, COST = 0.04, 0.05, 20
_SPACE = r"[\x20\x09-\x0D]+"


def document_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, text_hash, stratum`` and counts of the whole text.

    Null and empty texts have no words and count 0 everywhere. Repeated words are
    those in 5-word windows that the text has twice or more; windows are compared
    by 64-bit hashes within one text. The counts are written to the shared folder,
    so a later filter cannot be pushed into their computation.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(-1, 4)])
    base = base.withColumn("windows", F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), window)))
    base = base.withColumn("twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    # only texts with a repeated window are sorted by (hash, place); equal neighbours are the repeats
    base = base.withColumn("sorted", F.when(F.col("twice"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(x["h"] == F.get("sorted", i)["h"], F.lit(False))
    base = base.withColumn("places", F.array_sort(F.transform(F.filter("sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    counts = base.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        "stratum",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
    )
    return materialize(counts, "quality")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(0).cast("int")


def scores() -> dict[str, Column]:
    """Score of each rule, in thousandths."""
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "capitals": _share("n_capitals", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Bin(n, p), for k <= n * p; the sum starts at its largest term."""
    k, n = k.cast("int"), n.cast("double")
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    top = F.aggregate(steps, F.lit(0.0), lambda a, j: a + F.log((n - j + 1) / j)) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = (1 - p) / p
    sums = F.aggregate(
        F.reverse(steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * j / (n - j + 1) * ratio).alias("term"), (a["sum"] + a["term"] * j / (n - j + 1) * ratio).alias("sum")),
        lambda a: a["sum"],
    )
    return top + F.log(sums)


def certified_cutoffs(holdout: DataFrame, *, cutoffs: tuple[int, ...] = CUTOFFS, alpha: float = ALPHA, delta: float = DELTA, cost: int = COST) -> DataFrame:
    """``stratum, rule, cutoff`` from rows ``stratum, good, <score of each rule>``.

    One row per stratum and rule that has a certified cutoff which rejects more
    than it costs. ``alpha`` bounds the false rejections of all rules together.
    Counts are added up before anything is shuffled.
    """
    alpha = alpha / len(RULES)
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES]))
    rows = holdout.select("stratum", "good", pairs.alias("x")).select("stratum", "good", "x.rule", "x.score")
    counts = rows.groupBy("stratum", "rule").agg(
        F.count_if("good").alias("n"),
        *[F.count_if(F.col("good") & (F.col("score") >= c)).alias(f"g{c}") for c in cutoffs],
        *[F.count_if(~F.col("good") & (F.col("score") >= c)).alias(f"b{c}") for c in cutoffs],
    )
    tests = counts.select("stratum", "rule", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"g{c}").alias("k"), F.col(f"b{c}").alias("bad")) for c in cutoffs])).alias("t"))
    tests = tests.select("stratum", "rule", "n", "t.*")
    strata = F.count("*").over(Window.partitionBy(F.lit(1)))  # a row per stratum and rule: their number
    tests = tests.join(counts.select(F.col("stratum").alias("s"), F.col("rule").alias("r"), strata.alias("family")), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r")))
    sure = F.when(F.col("k") <= F.col("n") * alpha, log_binomial_tail(F.col("k"), F.col("n"), alpha) <= F.log(F.lit(delta) / F.col("family"))).otherwise(False)
    gain = F.col("bad") - cost * F.col("k")
    good = tests.where((F.col("n") > 0) & sure & (gain > 0))
    return good.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain.alias("gain"), "cutoff")).alias("cutoff"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts of every row, ``base_failed`` and ``kept``.

    ``labels`` (doc_id, quality) name some documents good (1) or bad (0); null
    ids and qualities are ignored, and an id labelled both ways is bad. Labelled
    rows that fail the base test take no part in the calibration. Null strata are
    a stratum. Repeated rows get the same verdict.
    """
    stats = document_stats(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col)
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    holdout = stats.where(~base_failed()).join(marks, "doc_id").select("stratum", "good", *[c.alias(r) for r, c in scores().items()])
    cut = certified_cutoffs(holdout).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    cut = cut.withColumnRenamed("stratum", "of")
    rejected = F.lit(False)
    for rule, score in scores().items():
        rejected = rejected | F.coalesce(score >= F.col(f"cut_{rule}"), F.lit(False))
    judged = stats.join(cut, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return judged.select(*stats.columns, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, all columns as they are."""
    verdicts = quality_verdicts(docs, labels, id_col=id_col, text_col=text_col, stratum_col=stratum_col)
    out = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("_qr_id"), F.col("text_hash").alias("_qr_hash")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col("_qr_id")) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col("_qr_hash"))
    return docs.join(out, same, "left_anti")
