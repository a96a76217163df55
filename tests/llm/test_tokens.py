import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelake.llm import token_files
from pagelake.llm.packing import Levels, pack_documents
from pagelake.llm.token_counts import ByteMerges, token_counts
from pagelake.llm.token_files import decode, encode, read_token_files, write_token_files
from pagelake.llm.wordpieces import WordPieces

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(WORD)


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(6))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 255, 256, 257, 5000][seed]
    ids = rng.integers(0, 1 << 16, n).astype(np.uint64) >> rng.integers(0, 17, n).astype(np.uint64)
    if seed >= 4:
        ids[:130] = 0
        ids[200:203] = [2**60, 2**64 - 1, 2**60 - 1]
    words, first = encode(ids)
    assert (decode(words, first, n) == ids).all()
    if n == 5000:
        assert len(words) < n / 3


def test_token_files_equal_the_library(spark, odd, odd_rows, tmp_path):
    write_token_files(odd.withColumn("part", F.lit(1)), f"file://{tmp_path}/t", tokenizer=WORD)
    got = read_token_files(spark, f"file://{tmp_path}/t").collect()
    want = Counter((r[0], zlib.crc32(np.array(library_ids(r[1]), "<u4").tobytes()), len(library_ids(r[1]))) for r in odd_rows)
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)


#: Characters that compose, lower to several, belong to no word or start a special string.
ODD = [*"aaab  \n\t'sé漢🙂.1,;-_!?\"(<>|&İIıiKÅﬁﬃßſΑΣς한글กำاّب한̸ְ̧́̇ि⃐᫁  ‍ǅǅⓐⅣ²ႠᎠꟜ𞤀𝐀", "<|endoftext|>", "<|StartOfText|>", "'t", " the", "Cat", ". ", ", "]


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(10_000)]
    return texts + ["Ali İ. geldi", "BELİ!", "KADİ, x", "İ_", "ab" * 30_000, "'" * 5000, "x." * 20_000, "İ." * 5000]


def test_ids_of_odd_strings_in_files_and_windows(spark, odd_texts, tmp_path):
    library = Tokenizer.from_file(WORD)
    ids = [np.array([*x.ids, 1], "<u4").tobytes() for x in library.encode_batch(odd_texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("part", F.lit("y"))
    write_token_files(docs, f"file://{tmp_path}/o", tokenizer=WORD)
    assert {r.doc_id: (r.ids_crc32, r.n_tokens) for r in read_token_files(spark, f"file://{tmp_path}/o").collect()} == {i: (zlib.crc32(x), len(x) // 4) for i, x in enumerate(ids)}
    covered = Counter()
    for r in pack_documents(docs, tokenizer=WORD).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) // 4
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) // 4 for i, x in enumerate(ids)}


def test_other_vocabularies_go_to_the_library():
    pieces, library = WordPieces(BYTE), Tokenizer.from_file(BYTE)
    texts = ["A  b c.", "", "İ. x", "a<|endoftext|> b"]
    assert not pieces.by_words and WordPieces(WORD).by_words
    assert pieces.documents([t.encode() for t in texts]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_many_parts_are_joined(spark, odd, tmp_path, monkeypatch):
    write_token_files(odd, f"file://{tmp_path}/m", tokenizer=WORD)
    want = Counter(map(tuple, read_token_files(spark, f"file://{tmp_path}/m").collect()))
    monkeypatch.setattr(token_files, "MOST_PARTS", 0)
    assert Counter(map(tuple, read_token_files(spark, f"file://{tmp_path}/m").collect())) == want


def test_token_files_of_nothing(spark, odd, tmp_path):
    write_token_files(odd.limit(0), f"file://{tmp_path}/e", tokenizer=WORD)
    assert read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_counts_equal_the_library(odd, odd_rows):
    library = Tokenizer.from_file(BYTE)
    got = Counter(tuple(r) for r in token_counts(odd, tokenizer=BYTE, limit=50).collect())
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((r[0], len((r[1] or "").encode()), size(r[1]), size(r[1]) > 50) for r in odd_rows)
    assert token_counts(odd.limit(0), tokenizer=BYTE).count() == 0


def test_counts_of_random_strings():
    library, counter = Tokenizer.from_file(BYTE), ByteMerges(BYTE)
    rng = random.Random(1)
    texts = ["".join(rng.choices("aaab  \n\t'sé漢🙂.1<|endoftext|>", k=rng.randint(0, 80))) for _ in range(400)]
    texts += ["".join(rng.choices([*ODD, " "], k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 500, "abab" * 99, "x <|endoftext|> y", " <|endoftext|>"]
    assert counter.documents(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_long_words():
    library, counter = Tokenizer.from_file(BYTE), ByteMerges(BYTE)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzéßж漢字한"
    texts = [kind * 3000 for kind in ("a", "ab", "aab", "abcab", "é", "漢", "0", "-", "the", "=\u0338")]
    texts += ["".join(rng.choices(letters[:k], k=n)) for k in (1, 2, 3, 26, len(letters)) for n in (1000, 1025, 5000)]
    texts += ["x " + texts[-1] + "\n" + texts[-1] + "!" * 3000]
    assert counter.documents(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert all(len(p) <= 1024 for p in counter.table)


@pytest.mark.parametrize("kind", ["one letter", "letters", "base64"])
def test_a_million_letters_without_a_blank(kind):
    rng = random.Random(5)
    alphabet = {"one letter": "a", "letters": "abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}[kind]
    text = "".join(rng.choices(alphabet, k=1_000_000))
    counter, start = ByteMerges(BYTE), time.process_time()
    assert counter.documents([text]) == [len(Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids)]
    assert time.process_time() - start < 30


def test_clashing_columns(odd):
    more = odd.withColumn("n_tokens", F.lit("x")).withColumn("n_bytes", F.lit(None)).withColumn("length", F.lit(1)).withColumn("offset", F.lit("y"))
    assert token_counts(more, tokenizer=BYTE).count() == odd.count()
    assert pack_documents(more, tokenizer=WORD).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_counts_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(BYTE)
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, tokenizer=BYTE).collect()} == want


def test_levels_choose_the_least_sum_of_squares():
    rng = random.Random(2)
    levels = Levels(16)
    for _ in range(600):
        size, before = rng.randint(1, 15), levels.counts.copy()

        def total(h):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return int((n**2).sum())

        allowed = [0, *[h for h in range(1, 17 - size) if before[h]]]
        chosen = levels.place(size)
        assert total(chosen) == min(map(total, allowed))
        assert int((levels.counts**2).sum()) == total(chosen) and (levels.counts >= 0).all()


@pytest.mark.parametrize("table", ["odd", "real"])
def test_packing_is_whole_and_tight(spark, odd, odd_rows, table):
    docs = odd if table == "odd" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = odd_rows if table == "odd" else [tuple(r) for r in docs.collect()]
    got = pack_documents(docs.coalesce(1), tokenizer=WORD).collect()
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
    fills = sorted(sum(p.length for p in pieces) for pieces in by_seq.values())
    assert all(x == 2048 for x in fills[1:])  # one input partition: one short sequence at most
    ids = {r[0]: library_ids(r[1]) for r in rows}
    copies = Counter(r[0] for r in rows)
    covered = Counter()
    for p in got:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        covered.update((p.doc_id, i) for i in range(p.start, p.start + p.length))
    assert covered == Counter({(k, i): copies[k] for k, x in ids.items() for i in range(len(x))})


def test_packing_of_nothing(odd):
    assert pack_documents(odd.limit(0), tokenizer=WORD).count() == 0
