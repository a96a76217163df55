"""Personal data in texts (operator 12), in DataFrame functions only.

Patterns propose spans, validators confirm them (digit counts, Luhn for cards, mod 97
for bank accounts, ranges for addresses and numbers), and words nearby adjust the score.
Spans of the base kinds stay once they are valid; those of the added kinds need a score
of ``LEAST`` and must not overlap a base span, so a bare date or number counts only
where the text says what it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local", "birth")
KINDS = BASE + ADDED

#: Patterns of the base kinds. No part of them can be matched in two ways and each
#: run of characters is tried from its start only, so time grows with the text's length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Patterns of the added kinds.
ADDED_PATTERNS = {
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local": r"[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}",
    "birth": r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2}",
}
#: What may not stand beside a span of an added kind.
BESIDE = {"iban": "[A-Za-z0-9]", "ssn": "[0-9A-Za-z-]", "local": "[0-9A-Za-z+()-]", "birth": "[0-9A-Za-z./-]"}
#: A text without this holds no span of the kind.
NEEDED = {"email": "@", "phone": "+", "ssn": "-"}

#: Words that make a kind likelier where they stand within ``BEFORE`` code points before a span or ``AFTER`` behind it.
CONTEXT = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta|cvv",
    "phone": "phone|tel|call|mobile|fax|telefon|portable|movil",
    "iban": "iban|bank|account|konto|compte|cuenta|bic|swift",
    "ssn": "ssn|social security|social security number|tax id",
    "local": "phone|tel|call|mobile|fax|telefon|portable|movil",
    "birth": "born|birth|dob|birthday|date of birth|geboren|geburtsdatum|naissance|nacimiento",
}
BEFORE, AFTER = 40, 20
#: Score of a valid span, and what a word nearby adds, in hundredths.
SCORES = {"email": 80, "ip": 50, "card": 80, "phone": 70, "iban": 80, "ssn": 30, "local": 30, "birth": 20}
NEARBY, LEAST = 50, 60
#: Length of bank account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
_BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``use(before)`` where ``before(i)`` is the sum of the first ``i`` of ``sizes``.

    Sums of blocks are made once, so a text with very many matches is no square.
    """
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / _BLOCK).cast("int")), lambda b: add(F.slice(sizes, b * _BLOCK + 1, _BLOCK)))
    return let(blocks, lambda found: use(lambda i: add(F.slice(found, F.lit(1), F.floor(i / _BLOCK).cast("int"))) + add(F.slice(sizes, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))


def proposals(text: Column, pattern: str) -> Column:
    """All leftmost matches: ``start``, ``value`` and the text around, up to the matches beside it."""

    def places(both: Column) -> Column:
        sizes = F.transform(both["found"], lambda m, i: F.length(m) + F.length(F.get(both["gaps"], i)))
        before = lambda i: F.get(both["gaps"], i)
        return let(
            sizes,
            lambda z: running(
                z,
                lambda sum_of: F.transform(
                    both["found"],
                    lambda m, i: F.struct(
                        (sum_of(i) + F.length(before(i))).alias("start"), m.alias("value"),
                        F.right(before(i), F.lit(BEFORE)).alias("before"), F.left(before(i + 1), F.lit(AFTER)).alias("after"), ((i > 0) & (before(i) == "")).alias("joined"),
                    ),
                ),
            ),
        )

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), places)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether letters and digits pass the check of bank account numbers."""
    moved = F.split(F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4))), "")
    step = lambda a, c: F.when(c >= "A", (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def _account(value: Column) -> Column:
    """The part of a match that is as long as its country's numbers; empty where it is too short or no country's."""
    length = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), lambda k, _: k == F.left(value, F.lit(2)))), F.lit(0))
    ends = F.filter(F.transform(F.split(value, ""), lambda c, i: F.when(c != " ", i + 1)), lambda e: e.isNotNull())
    return F.coalesce(F.left(value, F.get(ends, length - 1)), F.lit(""))


def _valid(kind: str, x: Column) -> Column:
    value = x["value"]
    if kind == "ip":
        part = lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(F.try_to_number(F.left(q, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return (value != "") & mod_97(F.replace(value, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "birth":
        return ~value.rlike("^[0-9]{4}-(?:00|1[3-9]|[2-9])|^[0-9]{4}-[0-9]{2}-(?:00|3[2-9]|[4-9])|^(?:00|3[2-9]|[4-9])[0-9]?[./]|^[0-9]{2}[./](?:00|1[3-9]|[2-9])")
    return F.lit(True)


def nearby(kind: str, x: Column) -> Column:
    """Whether a context word of the kind stands near; only A-Z are lower-cased."""
    around = F.translate(F.concat(x["before"], F.lit(" | "), x["after"]), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return around.rlike(f"(?:^|[^a-z])(?:{CONTEXT[kind]})(?:[^a-z]|$)")


def kind_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind as ``start, kind, end, text, score``; ``kind`` is its place in ``KINDS``."""
    pattern = PATTERNS.get(kind) or ADDED_PATTERNS[kind]
    found = proposals(text, pattern)
    if kind == "iban":
        found = F.transform(found, lambda x: let(_account(x["value"]), lambda v: x.withField("after", F.left(F.concat(F.substr(x["value"], F.length(v) + 1), x["after"]), F.lit(AFTER))).withField("value", v)))
    good = lambda x: _valid(kind, x)
    if kind in ADDED:
        free = lambda x: ~x["joined"] & ~F.right(x["before"], F.lit(1)).rlike(BESIDE[kind]) & ~F.left(x["after"], F.lit(1)).rlike(BESIDE[kind])
        good = lambda x: free(x) & _valid(kind, x)
    spans = F.transform(
        F.filter(found, good),
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("text"),
            F.least(F.lit(100), SCORES[kind] + F.when(nearby(kind, x), NEARBY).otherwise(0)).alias("score"),
        ),
    )
    here = text.rlike(pattern)
    if kind in NEEDED:
        here = F.contains(text, F.lit(NEEDED[kind])) & here
    return F.when(here, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,text:string,score:int>>"))


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, text, base, spans`` of every row: arrays of spans by start, then kind.

    A span has ``start`` and ``end`` (code points, end exclusive), ``kind`` (place in
    ``KINDS``), ``text`` and ``score``. ``base`` holds the valid spans of the base kinds,
    ``spans`` also those of added kinds with a score of ``least`` that overlap none of
    them. A null text counts as empty and has no spans; repeated rows are searched each
    time. Time grows with a text's length, also for very long runs of one character.
    Columns of ``docs`` other than these two are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", F.array_sort(F.concat(*[kind_spans(F.col("text"), k) for k in BASE])).alias("base"))
    more = F.concat(*[kind_spans(F.col("text"), k) for k in ADDED])
    fresh = lambda x: (x["score"] >= least) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return rows.select("*", F.array_sort(F.concat("base", F.filter(more, fresh))).alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def pii_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Numbers of base spans per kind, digest of the base spans and all spans of every row of ``docs``."""
    found = pii_spans(docs, id_col=id_col, text_col=text_col, least=least)
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k)))
    return found.select("doc_id", *[number(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, *, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Rows of ``docs`` with each span of ``text_col`` replaced by its kind, such as ``[EMAIL]``.

    Of overlapping spans the first is replaced. A null text stays null. All other columns
    stay as they are. Each span copies what was made before it, so a text takes time with its
    length times its spans.
    """
    text = F.col(text_col).cast("string")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.concat(*[kind_spans(text, k) for k in BASE])

    def spans(base: Column) -> Column:
        fresh = lambda x: (x["score"] >= least) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return F.array_sort(F.concat(base, F.filter(F.concat(*[kind_spans(text, k) for k in ADDED]), fresh)))

    step = lambda a, x: F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["made"], F.substr(text, a["at"] + 1, x["start"] - a["at"]), F.get(names, x["kind"])).alias("made"))).otherwise(a)
    made = let(base, lambda b: F.aggregate(spans(b), F.struct(F.lit(0).alias("at"), F.lit("").alias("made")), step, lambda a: F.concat(a["made"], F.substr(text, a["at"] + 1))))
    return docs.withColumn(text_col, made)
