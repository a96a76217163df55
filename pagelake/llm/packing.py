"""Sum-of-squares packing into fixed windows (operator 9).

Each input partition packs its documents online. An array counts the partly
filled windows at each fill level; a document goes where the sum of the squared
counts comes out smallest, which keeps every level's count low and so leaves
few gaps that nothing fits. When the partition ends, the windows still open are
merged by cutting, so that one window at most stays short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import as_bytes, text_chunks

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Local sequence numbers per partition: the low bits of ``sequence_id``.
LOCAL_BITS = 40


class Levels:
    """Open windows by fill level; ``place`` returns the level chosen (0: a new window)."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)

    def place(self, size: int) -> int:
        """Count ``size`` into the level that minimises the sum of squares.

        Moving a window from level h to h + size changes the sum by
        2 + 2 * (count[h + size] - count[h]); filling it up by 1 - 2 * count[h];
        opening a new one by 1 + 2 * count[size]. Ties go to the fuller window.
        """
        n, room = self.counts, self.window - size
        best, least = 0, 1 + 2 * int(n[size])
        if room:
            here = n[1 : room + 1]
            change = 2 + 2 * (n[size + 1 : self.window + 1] - here)
            change[-1] -= 1
            change[here == 0] = np.iinfo(np.int64).max
            at = room - 1 - int(np.argmin(change[::-1]))
            if change[at] <= least:
                best = at + 1
        if best:
            n[best] -= 1
        if best + size < self.window:
            n[best + size] += 1
        return best


def pack(documents: Iterator[tuple[int, bytes]], window: int) -> Iterator[list[tuple[int, int, bytes, int]]]:
    """Sequences of pieces (id, start, id bytes, ids in the document).

    A document's whole windows come first; the rest, shorter than a window, is
    placed by ``Levels``. Memory holds the open windows only.
    """
    levels = Levels(window)
    open_at: dict[int, list[list]] = {}
    for key, ids in documents:
        total = len(ids) // 4
        whole = total // window * window
        for s in range(0, whole, window):
            yield [(key, s, ids[4 * s : 4 * (s + window)], total)]
        if whole == total:
            continue
        size = total - whole
        level = levels.place(size)
        pieces = open_at[level].pop() if level else []
        pieces.append((key, whole, ids[4 * whole :], total))
        if level + size == window:
            yield pieces
        else:
            open_at.setdefault(level + size, []).append(pieces)
    rest = [(fill, pieces) for fill in sorted(open_at, reverse=True) for pieces in open_at[fill]]
    low, high = 0, len(rest) - 1  # the emptiest windows fill the gaps of the fullest
    while low <= high:
        fill, pieces = rest[low]
        while fill < window and high > low:
            left, giving = rest[high]
            key, s, ids, total = giving.pop()
            take = min(window - fill, len(ids) // 4)
            pieces.append((key, s, ids[: 4 * take], total))
            fill += take
            if 4 * take < len(ids):
                giving.append((key, s + take, ids[4 * take :], total))
            if giving:
                rest[high] = (left - take, giving)
            else:
                high -= 1
        yield pieces
        low += 1


def pack_documents(docs: DataFrame, *, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every whole text (null: empty) with ``end_id`` after it.

    One row per piece, columns as in ``PIECES``; offsets run from 0 without gaps
    in each sequence. A document with no text is its ``end_id`` alone. Repeated
    rows are packed each time, null ids like others; no rows give no pieces. A very long
    text is coded in one task and cut over as many sequences as it fills; columns other
    than these two are not read. Sequences do not cross input partitions: there is
    no shuffle, and each partition leaves one sequence at most that isn't full.
    The plan is a function of the partition's rows, so a task that runs again
    gives the same sequences.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from pagelake.llm.wordpieces import word_pieces

        sequence = TaskContext.get().partitionId() << LOCAL_BITS
        pieces = word_pieces(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def documents() -> Iterator[tuple[int, bytes]]:
            for b in text_chunks(batches, "text"):
                made = pieces.documents(as_bytes(b.column("text")))
                yield from zip(b.column("doc_id").to_pylist(), (x + end for x in made))

        names = [x.split()[0] for x in PIECES.split(", ")]
        out: list[tuple] = []
        for found in pack(documents(), window):
            at = 0
            for key, s, ids, total in found:
                out.append((key, s, len(ids) // 4, zlib.crc32(ids), total, sequence, at))
                at += len(ids) // 4
            sequence += 1
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return rows.mapInArrow(run, PIECES)
