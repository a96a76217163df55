import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["the", "Cat", "sat,", "on", "it's", "naïve", "x1y2", "###", "Ünï.", "a<|endoftext|>b", "ſtraße", "12.5%"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), "en", f"s{i % 3}", i) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (None, "no id here", None, "s2", 3)]
    rows += [(7, rows[7][1], "en", "s1", 7)] * 2
    rows += [(102, "  \t\n\x0b\f\r ", "en", None, 5), (103, "word " * 9000, "en", "s0", 45000)]
    rows += [(104, "a  b  c\x1c d\x85e  \n\n  f", "en", "s0", 1), (105, "é ́x KÅ İI ΑΣ", "fr", "s0", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)
