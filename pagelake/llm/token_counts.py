"""Token counts under a byte-level BPE (operator 7): rank-synchronous merging.

Pre-tokens of a batch lie in one ragged array of symbols. In each round every
pre-token merges all places of its own lowest-rank pair at once; rounds end when
no pre-token has a known pair. The symbols that survive are the token count.

A round walks the whole array, which a pre-token with thousands of rounds would pay
for each time. Pre-tokens above ``LONG`` bytes (text without white space) are cut
where two bytes stand side by side in no token, and what is still long keeps the
places of each pair in buckets by rank, so that a round costs what it merges.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import as_bytes, text_chunks

#: White space of the pre-tokenizer's pattern, and the pattern.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same pattern with all that lies between white space taken as one piece.
_PIECE = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Entries that a worker's table of pieces may hold; a full table is emptied.
TABLE_PIECES = 1_000_000
NONE = np.iinfo(np.int64).max
#: Bytes above which a pre-token is merged by buckets, and is not kept in the table.
LONG = 1024


class ByteMerges:
    """Counts tokens from the vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.bytes = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.left, self.right, self.result = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in pairs], np.int64).reshape(-1, 3).T
        code = {c: b for b, c in chars.items()}
        tokens = b"".join(bytes([0, *[code[c] for c in t if c in code], 0]) for a, b in pairs for t in (a + b,))
        flat = np.frombuffer(tokens, np.uint8).astype(np.int64)
        self.beside = np.zeros(1 << 16, bool)  # two bytes side by side in a token; more pairs do no harm
        self.beside[flat[:-1] << 8 | flat[1:]] = True
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pretoken = regex.compile(_PRETOKEN)
        self.table: dict[str, int] = {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted merges; -1 if it is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty pre-token."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        counts = sizes.copy()
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            at = np.where(same, self._look_up(symbols[:-1], symbols[1:]), -1)
            rank = np.append(np.where(at >= 0, self.ranks[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            hit = (rank == np.repeat(least, lengths)) & (rank < NONE)
            if not hit.any():
                break
            place = np.flatnonzero(hit)
            run = np.flatnonzero(np.append(True, np.diff(place) != 1))  # aaa: every other place of a run
            inside = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
            place = place[inside % 2 == 0]
            np.subtract.at(counts, owner[place], 1)
            symbols[place] = self.made[at[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            keep &= np.repeat(least < NONE, lengths)  # finished pre-tokens leave
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def _long(self, word: bytes) -> int:
        """Symbols that survive in one long pre-token."""
        flat = np.frombuffer(word, np.uint8).astype(np.int64)
        cuts = np.flatnonzero(~self.beside[flat[:-1] << 8 | flat[1:]]) + 1
        ends = [*cuts.tolist(), len(word)]
        parts = Counter(word[a:b] for a, b in zip([0, *ends], ends))
        short = [p for p in parts if len(p) <= LONG]
        total = sum(parts[p] * int(n) for p, n in zip(short, self.merge(short))) if short else 0
        return total + sum(n * self._by_buckets(p) for p, n in parts.items() if len(p) > LONG)

    def _by_buckets(self, word: bytes) -> int:
        """As ``merge`` for one pre-token: lowest rank first, all its places at once."""
        n = len(word)
        symbol = np.append(self.bytes[np.frombuffer(word, np.uint8)], -1)  # the last is a stop
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        buckets: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Put places whose pair is known into the bucket of its rank."""
            at = self._look_up(symbol[places], symbol[after[places]])
            places, rank = places[at >= 0], self.ranks[at[at >= 0]]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            starts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, some in zip(rank[starts].tolist(), np.split(places, starts[1:])):
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(heap, r)
                buckets[r].append(some)

        note(np.arange(n - 1))
        left = n
        while heap:
            r = heapq.heappop(heap)
            place = np.unique(np.concatenate(buckets.pop(r)))
            place = place[symbol[place] == self.left[r]]
            place = place[symbol[after[place]] == self.right[r]]
            if self.left[r] == self.right[r] and len(place):  # aaa: every other place of a run
                run = np.flatnonzero(np.append(True, after[place[:-1]] != place[1:]))
                place = place[(np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))) % 2 == 0]
            if not len(place):
                continue
            gone = after[place]
            symbol[place], symbol[gone] = self.result[r], -2
            after[place] = after[gone]
            before[after[place]] = place
            left -= len(place)
            around = np.concatenate([before[place][before[place] >= 0], place])
            note(np.unique(around[after[around] < n]))
        return left

    def learn(self, pieces: list[list[str]]) -> None:
        """Make sure that the table has all of ``pieces``."""
        flat = itertools.chain.from_iterable
        new = list(set(itertools.filterfalse(self.table.__contains__, flat(pieces))))
        if len(self.table) + len(new) > TABLE_PIECES:
            self.table.clear()
            new = list(set(flat(pieces)))
        if not new:
            return
        words = [self.pretoken.findall(p) for p in new]
        flat = [w.encode() for ws in words for w in ws]
        unique = dict.fromkeys(flat)
        short = [w for w in unique if len(w) <= LONG]
        unique = dict(zip(short, self.merge(short).tolist())) | {w: self._long(w) for w in unique if len(w) > LONG}
        at = 0
        for p, ws in zip(new, words):
            self.table[p] = sum(unique[w] for w in flat[at : at + len(ws)])
            at += len(ws)

    def documents(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text; a special string inside is one token."""
        parts = [self.special.split(t) if self.special and "<" in t else [t] for t in texts]
        pieces = [[p for x in xs for p in _PIECE.findall(x)] for xs in parts]
        self.learn(pieces)
        get = self.table.__getitem__
        found = [sum(map(get, ps)) + len(xs) - 1 for ps, xs in zip(pieces, parts)]
        for p in {p for ps, t in zip(pieces, texts) if len(t) > LONG for p in ps if len(p) > LONG}:
            del self.table[p]
        return found


@functools.cache
def byte_merges(path: str) -> ByteMerges:
    """The worker's own table, kept from task to task."""
    return ByteMerges(path)


def token_counts(docs: DataFrame, *, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, in one pass over the texts.

    A null or empty text has no bytes and no tokens. Repeated rows are counted
    each time. A text of one unbroken word takes time in proportion to its length
    (1 MB: seconds). Columns of ``docs`` other than these two are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = byte_merges(tokenizer)
        for b in text_chunks(batches, "text"):
            raw = as_bytes(b.column("text"))
            n = counter.documents([x.decode("utf-8", "replace") for x in raw])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
