"""Token-id files (operator 3): Simple-8b words in Parquet segments.

A 64-bit word has a 4-bit selector and 60 data bits; the selector says how many
ids share the word. Ids that need more than 60 bits follow an escape selector as
a raw word. Ids are coded in blocks of 256; a segment stores where each block's
words begin, so that all blocks decode side by side.

Layout of a written folder: ``segments`` (one row per run of whole documents:
``part``, ``seq``, ``n_ids``, ``words``, ``block_words``, ``doc_ids``,
``doc_tokens``) in ascending document order, and ``parts`` (``part``, ``start``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagelake.llm.common import as_bytes, text_chunks

#: Ids in a block, and ids after which a segment ends with its document.
BLOCK = 256
SEGMENT_IDS = 1 << 17

#: Ids in a word and bits of each, by selector. 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

SEGMENTS = "part int, seq long, n_ids long, words binary, block_words binary, doc_ids array<long>, doc_tokens array<long>"


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, as uint8; from 2**53 on it may be one more."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` (uint64), and the index of each block's first word.

    Every block takes, word by word, the selector that holds most ids; one step
    does this for all blocks together.
    """
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    blocks = -(-n // BLOCK)
    width = np.full(blocks * BLOCK, 255, np.uint8)
    width[:n] = _widths(ids)
    width = width.reshape(blocks, BLOCK)
    best = np.zeros((blocks, BLOCK), np.uint8)
    most, reach = width, 1  # most[:, i]: the largest width of ids i .. i + reach - 1
    for s in range(15, 0, -1):
        count = int(COUNTS[s])
        while reach < count:
            step = min(reach, count - reach)
            most = np.maximum(most[:, : BLOCK - reach - step + 1], most[:, step : BLOCK - reach + 1])
            reach += step
        fit = most <= BITS[s]
        view = best[:, : fit.shape[1]]
        view[fit] = s
    row, at, word = np.arange(blocks), np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    used = np.zeros(blocks, np.int64)
    end = np.full(blocks, BLOCK)
    end[-1] = n - (blocks - 1) * BLOCK
    rows, starts, picks, places = [], [], [], []
    while len(row):
        s = best[row, at]
        rows.append(row)
        starts.append(row * BLOCK + at)
        picks.append(s)
        places.append(word)
        word = word + 1 + (s == 0)
        at = at + COUNTS[s]
        used[row] = word
        go = at < end[row]
        row, at, word = row[go], at[go], word[go]
    first = np.concatenate([[0], np.cumsum(used)])
    rows, starts, picks, places = map(np.concatenate, (rows, starts, picks, places))
    places = first[rows] + places
    words = np.zeros(first[-1], np.uint64)
    for s in np.unique(picks):
        mine = picks == s
        begin, put = starts[mine], places[mine]
        if s == 0:
            words[put + 1] = ids[begin]
            continue
        made = np.full(len(begin), np.uint64(s) << np.uint64(60))
        if BITS[s]:
            for j in range(COUNTS[s]):
                made |= ids[begin + j] << np.uint64(j * BITS[s])
        words[put] = made
    return words, first[:-1].astype(np.uint32)


def decode(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids (uint64) of ``encode``'s output."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    pick = (words >> np.uint64(60)).astype(np.uint8)
    if (pick == 0).any():  # raw words follow some: walk all blocks side by side
        places, starts = [], []
        at, place = np.arange(len(block_words)) * BLOCK, block_words.astype(np.int64)
        end = np.minimum(at + BLOCK, n)
        while len(at):
            s = pick[place]
            places.append(place)
            starts.append(at)
            at = at + COUNTS[s]
            place = place + 1 + (s == 0)
            go = at < end
            at, place, end = at[go], place[go], end[go]
        places, starts = np.concatenate(places), np.concatenate(starts)
    else:
        places, starts = np.arange(len(words)), np.concatenate([[0], np.cumsum(COUNTS[pick])[:-1]])
    for s in np.unique(pick[places]):
        mine = pick[places] == s
        w, begin = places[mine], starts[mine]
        if s == 0:
            out[begin] = words[w + 1]
        elif BITS[s]:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                out[begin + j] = (words[w] >> np.uint64(j * BITS[s])) & mask
    return out


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id``, write the folder.

    Texts are range-partitioned by id (ties by a hash of the text), so segments
    of part p come before those of part p + 1. An empty table gives an empty folder.
    Repeated rows are written each time; null ids come first. A very long text is coded in
    one task, and its ids lie in one segment; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from pagelake.llm.wordpieces import word_pieces

        part, seq = TaskContext.get().partitionId(), 0
        pieces = word_pieces(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        held, ids, sizes, total = [], [], [], 0

        def segment() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), "<u4").astype(np.uint64)
            words, first = encode(flat)
            cols = [[part], [seq], [len(flat)], [words.astype("<u8").tobytes()], [first.astype("<u4").tobytes()], [ids], [sizes]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "seq", "n_ids", "words", "block_words", "doc_ids", "doc_tokens"])

        for b in text_chunks(batches, "text"):
            made = pieces.documents(as_bytes(b.column("text")))
            for key, x in zip(b.column("doc_id").to_pylist(), made):
                x += end
                held.append(x)
                ids.append(key)
                sizes.append(len(x) // 4)
                total += len(x) // 4
                if total >= SEGMENT_IDS:
                    yield segment()
                    held, ids, sizes, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield segment()

    rows.select("doc_id", "text").mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    spark = docs.sparkSession
    per_part = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/parts")


#: Parts whose starts may be broadcast (16 bytes each).
MOST_PARTS = 1_000_000


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: ``doc_id, start, n_tokens, ids_crc32``.

    The starts of the parts are broadcast behind a check of their number;
    beyond it they are joined by ``part``.
    """
    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts")
    few = parts.count() <= MOST_PARTS
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    # ids before each segment of its part, from the two small columns alone
    counts = segments.select("part", "seq", "n_ids")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    place = counts.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("inner"))
    place = place.join(F.broadcast(parts) if few else parts, "part").select("part", "seq", (F.col("inner") + F.col("start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 1) for i in range(batch.num_rows)):
                row = {k: b.column(k)[0] for k in b.schema.names}
                words = np.frombuffer(row["words"].as_py(), "<u8")
                first = np.frombuffer(row["block_words"].as_py(), "<u4")
                flat = decode(words, first, row["n_ids"].as_py()).astype("<u4")
                sizes = np.asarray(row["doc_tokens"].as_py(), np.int64)
                ends = np.cumsum(sizes)
                raw = flat.tobytes()
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(np.full(k, row["part"].as_py(), np.int32)), pa.array(np.full(k, row["seq"].as_py(), np.int64)), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "seq", "inner", "n_tokens", "ids_crc32"],
                )

    docs = segments.mapInArrow(run, "doc_id long, part int, seq long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(place, ["part", "seq"]).select("doc_id", (F.col("inner") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
