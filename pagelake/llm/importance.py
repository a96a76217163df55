"""Target-distribution importance resampling (operator 13).

Features of a text are its word n-grams, hashed into buckets. Two vectors of counts,
of the documents and of the target texts, give a gain per bucket; a document's weight
is the mean gain of its features. Weight plus Gumbel noise from the hash of the
document's id is its score, so the documents with the highest scores are a draw without
replacement in proportion to the exponents of the weights.

The cutoff between drawn and undrawn documents is found exactly, without a global
sort: in each round every partition gives the median of its remaining keys, the
median of these medians, weighted by the partitions' remaining sizes, is the pivot, and
at least a quarter of the remaining keys falls away. Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import Tables, as_bytes, number_rows, text_chunks

#: Fixed values of the production draw.
BUCKETS, SEED, SHARE, MIN_WORDS, LONGEST = 10_000, 2024, 10, 20, 1

#: Upper-case ASCII letters become lower-case ones; what is in no word becomes a space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Bytes of a text that are cut into words at once.
_PIECE = 4 << 20
#: Keys that one job may finish by sorting them.
FEW = 4096
KEY = ("_a", "_b", "_c", "_d")


class Sums(dict):
    """crc32 of words; emptied when full, and no long word is kept."""

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word)
        if len(word) <= 64:
            if len(self) > 500_000:
                self.clear()
            self[word] = found
        return found


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of some MB at a time."""
    text, at = raw.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + _PIECE) if at + _PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(raw: bytes, sums: Sums, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of words and the crc32 of all n-grams of up to ``longest`` words, piece by piece."""
    tail: list[bytes] = []
    for new in pieces(raw):
        words = tail + new
        crcs = np.fromiter(map(sums.__getitem__, words), np.int64, len(words))
        yield len(new), crcs[len(tail) :]
        for k in range(2, longest + 1):
            crcs = np.array([zlib.crc32(b" " + w, c) for c, w in zip(crcs.tolist(), words[k - 1 :])], np.int64)
            yield 0, crcs[max(0, len(tail) - k + 1) :]
        tail = words[len(words) - longest + 1 :] if longest > 1 else []


def bucket_counts(docs: DataFrame, *, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket, n`` over all features of all texts; a task adds up its own texts first.

    Null and empty texts have no features. At most ``buckets`` rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = Sums(), np.zeros(buckets, np.int64)
        for b in text_chunks(batches, "text"):
            for raw in as_bytes(b.column("text")):
                for _, crcs in features(raw, sums, longest):
                    total += np.bincount(crcs % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Gain of each bucket, in thousandths: an array of ``buckets`` numbers on the driver."""
    found = np.zeros((2, buckets), np.int64)
    for row, texts in zip(found, (docs, target)):
        for r in bucket_counts(texts, text_col=text_col, buckets=buckets, longest=longest).collect():  # at most ``buckets`` rows
            row[r.bucket] = r.n
    (s, t), (all_s, all_t) = found.tolist(), found.sum(axis=1).tolist()
    return np.array([math.floor(1000 * math.log((y + 1.0) * (all_s + buckets) / ((x + 1.0) * (all_t + buckets)))) for x, y in zip(s, t)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from the hash of seed and id (a null id: nothing after the colon)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, gains: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, text_crc, row`` of every row.

    ``row`` is unique in one run. A null or empty text has no features and the weight
    0. Repeated rows are scored each time. Of a very long text, some MB are cut into words
    at a time. Columns of ``docs`` other than these two are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "text_crc", "row"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, row = Sums(), TaskContext.get().partitionId() << 33
        for b in text_chunks(batches, "text"):
            made = []
            for i, raw in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                n = size = gain = 0
                for words, crcs in features(raw, sums, longest):
                    n, size, gain = n + words, size + len(crcs), gain + int(gains[crcs % len(gains)].sum())
                weight = gain // size if size else 0
                made.append((i, n, size, weight, weight + noise(i, seed), zlib.crc32(raw), row))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _middle(keys: np.ndarray) -> list[int]:
    """The median of sorted keys, as four numbers; zeros where there are none."""
    return keys[(len(keys) - 1) // 2].tolist() if len(keys) else [0] * 4


def _split(keys: np.ndarray, pivot: tuple) -> tuple[int, int]:
    """Numbers of sorted keys below the pivot and not above it."""
    lo, hi = 0, len(keys)
    for x, column in zip(pivot, keys.T):
        lo, hi = lo + int(np.searchsorted(column[lo:hi], x)), lo + int(np.searchsorted(column[lo:hi], x, "right"))
    return lo, hi


def _sides(keys: DataFrame, pivot: tuple | None) -> list:
    """One row per partition: sizes and medians of the keys below and above the pivot."""
    names = ["below", "equal", "above", *[f"{side}{i}" for side in "lg" for i in range(4)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
        if not parts:
            return
        all_keys = np.concatenate(parts)
        all_keys = all_keys[np.lexsort(all_keys.T[::-1])]
        lo, hi = _split(all_keys, pivot) if pivot else (len(all_keys), len(all_keys))
        row = [lo, hi - lo, len(all_keys) - hi, *_middle(all_keys[:lo]), *_middle(all_keys[hi:])]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=names)

    return keys.mapInArrow(run, ", ".join(f"{n} long" for n in names)).collect()


def _compare(key: tuple) -> Column:
    return F.struct(*[F.lit(int(x)).cast("long").alias(c) for c, x in zip(KEY, key)])


def kth_key(keys: DataFrame, k: int, tables: Tables, *, few: int = FEW) -> tuple | None:
    """The ``k``-th smallest of unique keys of four longs; null where there are fewer.

    A partition's keys are held and sorted in its task; they are bounded by the size of
    a split. One row per partition comes to the driver. What is left is written anew each
    time it has shrunk to an eighth, so all rounds together read the keys a few times.
    """
    low = high = None
    left, written, rounds = keys, None, 0
    pivot = None
    while True:
        sides = _sides(left, pivot)
        below, equal, above = (sum(r[i] for r in sides) for i in range(3))
        if pivot is None:
            if not 1 <= k <= below:
                return None
            side, size, written = "l", below, below
        elif k <= below:
            side, size, high = "l", below, pivot
        elif k <= below + equal:
            return pivot
        else:
            side, size, low, k = "g", above, pivot, k - below - equal
        left = keys
        if low:
            left = left.where(F.col("_a") >= low[0]).where(F.struct(*KEY) > _compare(low))
        if high:
            left = left.where(F.col("_a") <= high[0]).where(F.struct(*KEY) < _compare(high))
        if size <= few:
            return tuple(left.orderBy(*KEY).limit(k).collect()[-1])
        if size * 8 <= written:
            rounds += 1
            left = keys = tables.write(left, f"keys-{rounds}")
            tables.drop(f"keys-{rounds - 1}") if rounds > 1 else None
            written = size
        medians = sorted((tuple(r[f"{side}{i}"] for i in range(4)), r["below" if side == "l" else "above"]) for r in sides)
        half, seen = size / 2, 0
        for pivot, n in medians:
            seen += n
            if seen >= half:
                break


def resample(
    docs: DataFrame, target: DataFrame, *, share: int = SHARE, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", few: int = FEW
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; undrawn rows have no rank.

    Of the N rows with ``min_words`` words or more, floor(``share`` * N / 100) are drawn:
    the highest scores, ties to smaller ids (a null id before all others), then by the
    text's crc32; rows alike in all of this are interchangeable and drawn as single rows.
    Null and empty texts have the weight 0 and, with ``min_words`` above 0, are not drawn.
    Without documents there are no rows; without target texts all gains follow from the
    documents' counts alone. Columns other than id and text are not read.
    """
    tables = Tables(docs.sparkSession, "importance")
    gains = bucket_gains(docs, target, text_col=text_col, buckets=buckets, longest=longest)
    scored = tables.write(importance_scores(docs, gains, id_col=id_col, text_col=text_col, longest=longest, seed=seed), "scores")
    scored = scored.select("*", (-F.col("score")).alias("_a"), F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("_b"), F.col("text_crc").alias("_c"), F.col("row").alias("_d"))
    able = scored.where(F.col("n_words") >= min_words)
    cut = kth_key(able.select(*KEY), able.count() * share // 100, tables, few=few)
    columns = ["doc_id", "n_features", "weight", "score"]
    if cut is None:  # nothing is drawn
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= min_words) & (F.struct(*KEY) <= _compare(cut))
    winners = scored.where(F.col("_a") <= cut[0]).where(drawn).withColumn("_one", F.lit(1).cast("long"))
    ranked = number_rows(winners, list(KEY), by=[], sums={"rank": "_one"}, name="ranks", tables=tables)
    return ranked.select(*columns, (F.col("rank") + 1).alias("rank")).unionByName(scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, all columns as they are.

    Rows alike in id are drawn together if one of them is.
    """
    winners = resample(docs, target, id_col=id_col, text_col=text_col, **how).where(F.col("rank").isNotNull())
    return docs.join(winners.select(F.col("doc_id").alias("_drawn")).distinct(), docs[id_col].cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
