"""Text of HTML as columns, with Python only for entities that SQL has no table for."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.quality import squeeze

_DROPPED = r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>"
_MAIN = r"(?is)<(main|article)\b[^>]*>(.*?)</\1>"
LOC = r"(?is)<loc\b[^>]*>(.*?)</loc>"


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Entities as characters; rows that the caller made null cost nothing."""
    return text.map(_html.unescape, na_action="ignore")


def tags_to_spaces(markup: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(markup, _DROPPED, " "), r"(?s)<[^>]+>", " ")


def clean_text(markup: Column) -> Column:
    """Visible text: scripts and styles out, tags as spaces, entities, single spaces."""
    bare = tags_to_spaces(F.coalesce(markup, F.lit("")))
    return squeeze(F.coalesce(unescape(F.when(F.contains(bare, F.lit("&")), bare)), bare))


def main_html(markup: Column) -> Column:
    """Inside of the longest main or article element (the first on ties), else all."""
    found = F.regexp_extract_all(markup, F.lit(_MAIN), F.lit(2))
    longest = F.aggregate(found, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))
    return F.coalesce(longest, markup)


def main_article(markup: Column) -> Column:
    return clean_text(main_html(markup))
