"""Page state, language and score of a text as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.shared import let

#: State, pattern and whether only short texts count.
STATES = (
    ("CAPTCHA", r"captcha|verify you are human|human verification", False, "CAPTCHA marker detected"),
    ("BOT_BLOCK", r"access denied|bot detection|unusual traffic|checking your browser", False, "bot-block marker detected"),
    ("PAYWALL", r"subscribe to continue|subscription required|unlock this article", False, "paywall marker detected"),
    ("LOGIN", r"sign[ -]?in|log[ -]?in|enter your password|authentication required", True, "login page marker detected"),
    ("ERROR", r"404 not found|500 internal server error|service unavailable", True, "error page marker detected"),
)
SHORT = 5000
#: Marker words by language.
MARKERS = {
    "de": ("der", "die", "das", "ein", "eine", "ist", "mit", "und"),
    "en": ("a", "and", "for", "is", "of", "that", "the", "to"),
    "es": ("de", "el", "en", "es", "la", "los", "que", "y"),
    "fr": ("dans", "de", "des", "est", "et", "la", "le", "les"),
    "it": ("che", "con", "di", "e", "il", "la", "per", "un"),
    "pt": ("a", "com", "de", "e", "o", "os", "para", "que"),
}
LETTER = r"\p{L}\p{Nl}\p{No}"
WORD = rf"[{LETTER}]+"
#: Arabic, Hangul, Cyrillic, kana and Han.
SCRIPTS = r"؀-ۿ가-힯Ѐ-ӿ぀-ヿ一-鿿"


#: White space but the space, as Python has it: the separators U+001C to U+001F too.
_OTHER_SPACE = r"\t-\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends; runs that are one space already are left alone."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_OTHER_SPACE}][ {_OTHER_SPACE}]*| [ {_OTHER_SPACE}]+", " "))


def _may_hold(low: Column, pattern: str) -> Column:
    """True if a lowered text has the first letters of one of a pattern's words.

    A plain search rules most texts out before the pattern is tried. The long s,
    which a pattern without regard to case takes for an s, counts as a find.
    """
    heads = sorted({re.match("[a-z0-9 ]+", x).group(0) for x in pattern.split("|")})
    found = F.contains(low, F.lit("ſ"))
    for head in heads:
        found = found | F.contains(low, F.lit(head))
    return found


def page_state(text: Column) -> Column:
    """First state whose marker the squeezed text shows."""

    def state(low: Column) -> Column:
        out = F.when(text == "", "EMPTY")
        for name, pattern, short, _ in STATES:
            hit = _may_hold(low, pattern) & text.rlike(rf"(?iU)\b({pattern})\b")
            out = out.when((F.length(text) < SHORT) & hit if short else hit, name)
        return out.otherwise("OK")

    return let(F.lower(text), state)


def _best(counts: Column) -> Column:
    """Language with most marker words, the first on ties."""
    most = F.greatest(*[counts[k] for k in MARKERS])
    out = F.when(most < 2, None)
    for name in MARKERS:
        out = out.when(counts[name] == most, name)
    return out


def _in(values: tuple[str, ...]):
    return lambda w: w.isin(*values)


def language(text: Column) -> Column:
    """Language by script, else by marker words (two at least); null if unclear."""
    # words of all languages' markers in one pass over the text; each is then told by a lookup
    found = F.filter(F.split(F.lower(text), f"[^{LETTER}]+"), _in(tuple(sorted({w for m in MARKERS.values() for w in m}))))
    counts = lambda ws: F.struct(*[F.size(F.filter(ws, _in(m))).alias(k) for k, m in MARKERS.items()])
    marked = _bound(found, lambda ws: _bound(counts(ws), _best))
    # most texts have no letter of the five scripts; of others these letters alone are counted
    letters = F.regexp_replace(text, f"[^{SCRIPTS}]+", "")
    return F.coalesce(F.when(text.rlike(f"[{SCRIPTS}]"), _bound(letters, lambda x: _bound(_script_counts(x), _script))), marked)


def _bound(value: Column, f) -> Column:
    """f(value) with the value made once per row: an array of one binds it."""
    return F.transform(F.array(value), f)[0]


def _script_counts(letters: Column) -> Column:
    count = lambda chars: F.length(letters) - F.length(F.regexp_replace(letters, f"[{chars}]+", ""))
    ranges = {"ar": r"؀-ۿ", "ko": r"가-힯", "ru": r"Ѐ-ӿ", "ja": r"぀-ヿ", "zh": r"一-鿿"}
    return F.struct(*[count(x).alias(k) for k, x in ranges.items()])


def _script(n: Column) -> Column:
    """Language of a script's counts, or null."""
    most = F.greatest(n["ar"], n["ko"], n["ru"])
    first = F.when(n["ar"] == most, "ar").when(n["ko"] == most, "ko").otherwise("ru")
    return F.when(most >= 8, first).when(n["ja"] >= 4, "ja").when(n["zh"] >= 8, "zh")


def mismatch(state: Column, found: Column, expected: Column) -> Column:
    """True if an accepted text is in another language than expected."""
    wanted = F.substring_index(F.lower(expected), "-", 1)
    return F.coalesce((state == "OK") & (expected != "") & (found != wanted), F.lit(False))


def completeness(text: Column) -> Column:
    return F.least(F.lit(1.0), F.length(text) / F.lit(1000.0))


def accepted(state: Column, share: Column) -> Column:
    return (state == "OK") & (share >= 0.05)


def score(state: Column, share: Column) -> Column:
    return F.bround(F.when(state == "OK", share).otherwise(F.least(F.lit(0.2), share)), 4)


def reasons(text: Column, state: Column, found: Column, expected: Column) -> Column:
    """Reasons in order: state, language, length, ambiguity."""
    first = F.when(state == "EMPTY", "no usable text")
    for name, _, _, reason in STATES:
        first = first.when(state == name, reason)
    wrong = F.when(state == "WRONG_LANGUAGE", F.concat(F.lit("detected language "), found, F.lit(" does not match requested "), expected))
    low = F.when((state == "OK") & (completeness(text) < 0.05), "content is below the minimum useful-text threshold")
    unclear = F.when((F.coalesce(expected, F.lit("")) != "") & found.isNull(), "text was too ambiguous for deterministic language detection")
    return F.array_compact(F.array(first, wrong, low, unclear))


def with_quality(df: DataFrame, text: Column, expected: Column | None = None) -> DataFrame:
    """Add all quality columns of a text. What they share is computed once, in steps."""
    df = df.withColumn("_text", squeeze(text)).withColumns({"_found": language(F.col("_text")), "_base": page_state(F.col("_text"))})
    made = assess(F.col("_text"), expected, found=F.col("_found"), base=F.col("_base"))
    return df.withColumns(made).drop("_text", "_found", "_base")


def assess(text: Column, expected: Column | None = None, *, found: Column | None = None, base: Column | None = None) -> dict[str, Column]:
    """All quality columns of a squeezed text, from its language and state if known."""
    expected = F.lit(None).cast("string") if expected is None else expected
    found = language(text) if found is None else found
    base = page_state(text) if base is None else base
    state = F.when(mismatch(base, found, expected), "WRONG_LANGUAGE").otherwise(base)
    share = completeness(text)
    return {"page_state": state, "language": found, "completeness": share, "accepted": accepted(state, share), "score": score(state, share), "reasons": reasons(text, state, found, expected)}


def binary_state(size: Column) -> Column:
    return F.when(size > 0, "OK").otherwise("EMPTY")


#: Media whose markup is judged as text.
TEXT_MEDIA = ("text/html", "application/xhtml+xml", "application/json", "application/xml", "text/xml")


def raw_state(body: Column, media_type: Column) -> Column:
    """State of a body as it came: markup is judged as it stands, other media by their size."""
    return F.when(media_type.isin(*TEXT_MEDIA), page_state(squeeze(body))).otherwise(binary_state(F.octet_length(body)))


def ocr_state(text: Column, form: Column) -> Column:
    """State of a document's text, squeezed once; a PDF without text needs OCR."""
    return let(squeeze(text), lambda plain: F.when((form == "pdf") & (plain == ""), "NEEDS_OCR").otherwise(page_state(plain)))


def role(ok: Column) -> Column:
    return F.when(ok, "primary").otherwise("checked-only")
