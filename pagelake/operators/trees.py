"""Nested documents as variants and flat rows, in SQL after one parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.payloads import MAX_DEPTH
from pagelake.operators.shared import written


def as_variant(body: Column) -> Column:
    """A JSON text as a variant, of which single paths can be asked; null for text that is no JSON or repeats a key."""
    return F.try_parse_json(body)


def _levels(first: DataFrame, expand, name: str) -> DataFrame:
    """The rows of all levels: ``expand`` gives a level's children, until none has any."""
    found, level = None, first
    for depth in range(MAX_DEPTH + 1):
        level = written(level, f"{name}-{depth}")
        found = level if found is None else found.unionByName(level)
        inner = level.where("_open")
        if inner.isEmpty():
            break
        level = expand(inner, depth)
    return found


def _children(rows: DataFrame, value: str) -> DataFrame:
    """A row per element or entry of a variant, with ``pos, key, value``; ``key`` is null in lists."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(value).outer()))


def _is_open(value: Column) -> Column:
    """A list or object that holds something."""
    return F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")) > 0, F.size(F.try_variant_get(value, "$", "map<string,variant>")) > 0, F.lit(False))


def json_rows(df: DataFrame, body: str, *keys: str, most: int | None = None) -> DataFrame:
    """The leaves of JSON texts: ``keys, path, value, omitted``.

    ``path`` is a JSON pointer, ``value`` a leaf as JSON (empty lists and objects are leaves).
    With ``most``, of a list at any level only the first so many elements are followed;
    each other one is a row with ``omitted`` true and no value, so that their number is an
    aggregate. Text that is no JSON, or null, gives no row; repeated rows give theirs each.
    A level is one step and a written table, and every text is parsed once; nesting beyond
    the limit of payloads ends as leaves that are JSON themselves.
    """
    start = df.select(*keys, F.lit("").alias("path"), as_variant(F.col(body)).alias("_v"), F.lit(False).alias("omitted")).where("_v IS NOT NULL")
    opened = lambda rows: rows.withColumn("_open", ~F.col("omitted") & _is_open(F.col("_v")))

    def expand(rows: DataFrame, depth: int) -> DataFrame:
        rows = _children(rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("path").alias("_path"), "_v"), "_v")
        name = F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        left_out = F.col("key").isNull() & (F.col("pos") >= most) if most is not None else F.lit(False)
        made = rows.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.concat("_path", F.lit("/"), name).alias("path"), F.when(~left_out, F.col("value")).alias("_v"), left_out.alias("omitted"))
        return opened(made) if depth + 1 < MAX_DEPTH else made.withColumn("_open", F.lit(False))

    return _levels(opened(start), expand, "json").where("NOT _open").select(*keys, "path", F.when(~F.col("omitted"), F.to_json("_v")).alias("value"), "omitted")


def element_rows(normalized: DataFrame, *keys: str) -> DataFrame:
    """The elements of normalised XML: ``keys, path, position, tag, attributes, text``.

    ``path`` is the tags from the root, each with its place from 0 among its parent's
    children (``/r[0]/user[1]``), ``position`` the last of these places, ``attributes`` a map.
    Rows that could not be normalised, or are no XML, give none.
    """
    at = lambda v, p, kind: F.try_variant_get(v, p, kind)

    def shown(rows: DataFrame) -> DataFrame:
        v = F.col("_v")
        tag = at(v, "$.tag", "string")
        kept = rows.select(*[c for c in rows.columns if c not in ("_v", "_path")], F.concat("_path", F.lit("/"), tag, F.lit("["), F.col("position").cast("string"), F.lit("]")).alias("path"),
                           tag.alias("tag"), at(v, "$.attributes", "map<string,string>").alias("attributes"), at(v, "$.text", "string").alias("text"), at(v, "$.children", "variant").alias("_c"))
        return kept.where("tag IS NOT NULL").withColumn("_open", _is_open(F.col("_c")))

    def expand(rows: DataFrame, depth: int) -> DataFrame:
        rows = _children(rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("path").alias("_path"), "_c"), "_c")
        return shown(rows.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "_path", F.col("pos").alias("position"), F.col("value").alias("_v")))

    rows = normalized.where("error IS NULL AND format = 'xml'").select(*keys, F.lit("").alias("_path"), F.lit(0).alias("position"), as_variant(F.col("data")).alias("_v"))
    return _levels(shown(rows), expand, "elements").select(*keys, "path", "position", "tag", "attributes", "text")
