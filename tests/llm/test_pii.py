"""Personal data: base spans by the patterns as given, added kinds by hand, SQL on odd texts."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelake.llm import oracles, pii

BASE = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v, d: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v, d: all(int(p) <= 255 for p in v.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda v, d: 12 <= len(d) <= 19 and luhn(d)),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda v, d: 9 <= len(d) <= 15),
)


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def base_spans(text):
    found = []
    for kind, (pattern, valid) in enumerate(BASE):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text or "") if valid(m.group(), re.sub("[^0-9]", "", m.group()))]
    return sorted(found)


def odd_texts():
    rng = random.Random(3)
    parts = ["1", "2", "0", "255", "256", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "%", "4785380592391139", "4111 1111 1111 1111", "é", "1.2.3.4", "x@y.z", "+1 (743) 555-3824", "\n", "..", "--", "日"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "a@b.c@d.e %x@d.e", "a@b.co%x@d.e", "0" * 300 + "1.2.3.4", "1.2.3.0000255", "1.2.3.4.5.6.7.8", "4111-1111-1111-1111-4", " 4111111111111111 4111111111111111"]
    return texts + ["x " * 300 + " ".join(["4111111111111111,"] * 700)]


@pytest.fixture(scope="module")
def table(spark):
    texts = odd_texts()
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).withColumn("base", F.lit(1)).withColumn("spans", F.lit("x"))


def test_base_spans(table):
    texts, docs = table
    got = {r.doc_id: r for r in pii.pii_counts(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text)
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert list(got[i][1:5]) == [sum(k == x for _, k, _ in want) for x in range(4)], text
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), text


ADDED = [
    ("pay to IBAN DE89 3704 0044 0532 0130 00 AND MORE", "iban:12:39"),
    ("GB82WEST12345698765432", "iban:0:22"),
    ("GB83WEST12345698765432, XX82WEST12345698765432, AGB82WEST12345698765432", ""),
    ("my SSN is 123-45-6789, tel. 212-555-0199", "ssn:10:21,local:28:40"),
    ("a ssn of 000-45-6789 or 123-00-6789 or 123-45-6789-1", ""),
    ("123-45-6789 and 212-555-0199 and 1980-02-03 alone", ""),
    ("born 1980-02-03; née 03.02.1980", "birth:5:15"),
    ("born 1980-13-03 or 1980-02-32 or 31/12/1999", ""),
    ("geboren am 31.12.1999, Mail a@b.co", "birth:11:21,email:28:34"),
    ("call +1 (743) 555-3824", "phone:5:22"),
    ("tel: (743) 555-3824", "local:5:19"),
    ("embryo 1980-02-03", ""),
]


def test_added_kinds(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(ADDED)], "doc_id int, text string")
    got = {r.doc_id: r.spans for r in pii.pii_counts(docs).collect()}
    for i, (text, want) in enumerate(ADDED):
        assert got[i] == want, text


def test_sql_on_odd_texts(spark, table):
    texts = [*table[0], *[t for t, _ in ADDED]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    frame = docs.toPandas()  # noqa: F841
    con.sql("CREATE VIEW documents AS SELECT doc_id, text FROM frame")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans FROM ({oracles.PERSONAL})").fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in pii.pii_counts(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i] == want[i], text


def test_long_runs_take_little_time(spark):
    texts = ["9" * 300_000, "a" * 300_000, "1." * 100_000, "a." * 100_000 + "@b.c", "a@" * 50_000, "+1" * 50_000, "1 " * 100_000, "+1" + "(" * 100_000, "AB12" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.pii_counts(docs).collect()}
    assert got == {**dict.fromkeys(range(9), (0, 0, 0, 0)), 2: (0, 25_000, 0, 0), 3: (1, 0, 0, 0)}


def test_scores_and_redaction(spark, odd):
    docs = spark.createDataFrame([(1, "card 4111 1111 1111 1111, then a@b.co and 1.2.3.4", 5), (2, None, 6), (None, "x", 7)], "doc_id long, text string, start int")
    spans = {r.doc_id: [(x.text, x.score) for x in r.spans] for r in pii.pii_spans(docs).collect()}
    assert spans == {1: [("4111 1111 1111 1111", 100), ("a@b.co", 80), ("1.2.3.4", 50)], 2: [], None: []}
    assert [tuple(r) for r in pii.redacted(docs).collect()] == [(1, "card [CARD], then [EMAIL] and [IP]", 5), (2, None, 6), (None, "x", 7)]
    assert pii.pii_counts(odd).count() == odd.count() and pii.pii_counts(odd.limit(0)).count() == 0
