"""Substring dedup (operator 1) by recompression.

1. Each task names symbols (``recompression``) and turns every document into
   stretches of windows with one anchor: about one row for six words.
2. Stretches meet by anchor key. Those with equal words have an earlier copy in
   all but the first place; their windows are settled. An anchor that no other
   text shares is settled too. Where an anchor occurs in different stretches, the
   first of each is asked for its windows.
3. The windows asked for (a few per cent) meet by fingerprint; all but the first
   of equal ones are repeats.
4. The repeats' words are cut from the texts.

Only (key, place) rows are shuffled for 2 and 3. A task keeps the first places of
what it has met more than once (a bounded table) and sends later ones on as settled,
so a passage in a third of all texts sends a row or a few per task. Rows of one key
stream through sorted; no group is held.

Anchor keys only bring rows together. A repeat is one whose words have the same
BLAKE2b-128, a cryptographic digest of the words' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import as_bytes, materialize, text_chunks
from pagelake.llm.recompression import Words, anchors, mix

#: ``h``/``g``: the digest; ``_d``/``_t``: the document (id, hash of the text); windows
#: ``first`` to ``first + span``. kind 0: all of them are repeats; 1: to be settled.
PLACE = "key long, h long, g long, _d long, _t long, first int, span int, kind int"
_NAMES = [x.split()[0] for x in PLACE.split(", ")]
_KINDS = [np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32]
#: The document number of a null id: the smallest.
NO_ID = -(1 << 63)
#: Places that a task keeps of what it has met more than once (52 bytes each).
KEPT_PLACES = 1 << 16


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_d"), F.xxhash64(F.col(text_col).cast("string")).alias("_t"), *more)


def _differs(cols: list[np.ndarray]) -> np.ndarray:
    """Where a row is unlike the row before it."""
    out = np.zeros(len(cols[0]) - 1, bool)
    for c in cols:
        out |= c[1:] != c[:-1]
    return np.concatenate([[True], out])


class _Firsts:
    """Sends on one task's rows: of equal (key, digest) the first place to be settled, later ones as repeats."""

    def __init__(self):
        self.kept = [np.empty(0, k) for k in _KINDS[:7]]

    def take(self, rows: list[np.ndarray]) -> pa.RecordBatch:
        old = len(self.kept[0])
        cols = [np.concatenate([k, r.astype(k.dtype, copy=False)]) for k, r in zip(self.kept, rows)]
        key, h, g, d, t, first, _ = cols
        group = mix(key.view(np.uint64) ^ mix(h.view(np.uint64)))
        order = np.argsort(group)
        near = group[order][1:] == group[order][:-1]
        many = np.zeros(len(key), bool)
        many[order[1:][near]] = True
        many[order[:-1][near]] = True
        kind = np.ones(len(key), np.int32)
        lasting = np.zeros(len(key), bool)
        lasting[:old] = True
        some = np.flatnonzero(many)
        if len(some):
            some = some[np.lexsort((first[some], t[some], d[some], g[some], h[some], key[some]))]
            new = _differs([c[some] for c in (key, h, g)])
            lead = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
            alike = (d[some] == d[lead]) & (t[some] == t[lead]) & (first[some] == first[lead])
            lasting[some] = False
            lasting[lead[~new]] = True
            kind[some[~new]] = 0
            kind[some[~new & alike]] = -1  # the same place again
            away = some[~new & ~alike]
            settled = key.copy()
            settled[away] = mix((d[away] * 31 + first[away]).view(np.uint64)).view(np.int64)  # dealt out evenly
        else:
            settled = key
        stay = np.flatnonzero(lasting)[-KEPT_PLACES:]
        self.kept = [c[stay] for c in cols]
        kind[:old] = -1  # sent before
        send = kind >= 0
        return _batch([x[send] for x in (settled, *cols[1:], kind)])


def _batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k, copy=False)) for c, k in zip(cols, _KINDS)], names=_NAMES)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in _NAMES]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, h and place: repeats out as kind 0, and as kind 1 the
    first place of every h of a key that has more than one."""
    last, pending = None, None  # the last group's first row; a key's first row while it has one h
    for batch in batches:
        cols = _columns(batch)
        done = cols[7] == 0
        if done.any():
            yield _batch([c[done] for c in cols])
            cols = [c[~done] for c in cols]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.concatenate([[v], c]).astype(c.dtype) for v, c in zip(last, cols)]
        key, h, g, d, t, first, _, _ = cols
        new_key, new = _differs([key]), _differs([key, h, g])
        new_key[0] = new[0] = last is None
        lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        repeat = ~new & ~((d == d[lead]) & (t == t[lead]) & (first == first[lead]))
        repeat[0] = False
        leads = np.flatnonzero(new)
        if len(leads):
            fresh = new_key[leads]
            mixed = ~fresh
            mixed[:-1] |= ~fresh[1:]
            if pending is not None and not fresh[0]:
                yield _batch([np.array([v]) for v in pending])
            end = leads[-1]
            pending = [c[end] for c in cols] if not mixed[-1] else None
            ask = leads[mixed]
            if len(ask):
                yield _batch([c[ask] for c in cols])
        if repeat.any():
            yield _batch([*[c[repeat] for c in cols[:7]], np.zeros(int(repeat.sum()), np.int32)])
        last = [c[lead[-1]] for c in cols]


def _meet(places: DataFrame) -> DataFrame:
    order = ["key", "h", "g", "_d", "_t", "first"]
    return places.repartition("key").sortWithinPartitions(*order).mapInArrow(_settle, PLACE)


def repeated_windows(docs: DataFrame, window: int = 20, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``_d, _t, first, span``: windows whose words start earlier elsewhere."""
    texts = _keyed(docs, id_col, text_col, F.col(text_col).cast("string").alias("text"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for b in text_chunks(batches, "text"):
            words = Words(as_bytes(b.column("text")))
            key, low, high = anchors(words, window)
            if not len(key):
                continue
            digest = words.digests(low, high + window)
            owner = words.owner[low]
            d, t = (b.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("_d", "_t"))
            yield firsts.take([key.view(np.int64), digest[:, 0], digest[:, 1], d, t, low - words.first[owner], high - low])

    stretches = materialize(_meet(texts.mapInArrow(propose, PLACE)).select("_d", "_t", "first", "span", "kind"), "stretches")
    asked = stretches.where("kind = 1").groupBy("_d", "_t").agg(F.collect_list(F.struct("first", "span")).alias("asked"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for b in text_chunks(batches, "text"):
            words = Words(as_bytes(b.column("text")))
            lists = b.column("asked")
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            first, span = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "span"))
            low = np.repeat(words.first[owner] + first, span + 1)
            owner = np.repeat(owner, span + 1)
            low = low + np.arange(len(low)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
            digest = words.digests(low, low + window)
            d, t = (b.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("_d", "_t"))
            yield firsts.take([digest[:, 0], digest[:, 0], digest[:, 1], d, t, low - words.first[owner], np.zeros(len(low), np.int32)])

    windows = _meet(texts.join(asked, ["_d", "_t"]).mapInArrow(spell, PLACE)).where("kind = 0")
    return stretches.where("kind = 0").unionByName(windows.select(*stretches.columns)).select("_d", "_t", "first", "span")


def dedup_substrings(docs: DataFrame, window: int = 20, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every word that a repeated window covers; one row per input row.

    A window is ``window`` consecutive words of one text. It is repeated if the
    same words also start earlier: in a row with a smaller id, or earlier in the
    same text. A null id is the smallest. Rows with one id and different texts are
    ordered by a hash of the text; rows alike in both are one document and are cut
    alike. No rows give none, and a very long text is read in one task. Windows are judged on
    the input. Texts without a repeat stay as they
    are, null stays null; of others the words left keep what lies between
    neighbours, and one space stands for a cut.

    Input columns are kept, the text is replaced; ``n_words``, ``n_removed`` and
    ``removed`` (word spans, end exclusive) are added and replace columns of
    these names.
    """
    spans = repeated_windows(docs, window, id_col=id_col, text_col=text_col)
    spans = spans.groupBy("_d", "_t").agg(F.collect_list(F.struct("first", "span")).alias("_spans"))
    kept = docs.drop("n_words", "n_removed", "removed")
    kept = kept.withColumn(text_col, F.col(text_col).cast("string"))
    fields = kept.schema.fields
    rows = _keyed(kept, id_col, text_col, F.col(text_col).alias("text"), F.struct(*[F.col(f.name) for f in fields if f.name != text_col]).alias("row"))
    joined = rows.join(spans, ["_d", "_t"], "left").select("text", "row", "_spans")
    added = T.StructType.fromDDL("n_words long, n_removed long, removed array<struct<start:int,end:int>>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            raw = b.column("text")
            texts = as_bytes(raw)
            words = Words(texts)
            sizes = np.diff(words.first)
            lists = b.column("_spans")
            owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            first, span = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "span"))
            change = np.zeros(len(words.names) + 1, np.int64)
            np.add.at(change, words.first[owner] + first, 1)
            np.add.at(change, words.first[owner] + first + span + window, -1)
            gone = np.cumsum(change)[:-1] > 0
            count = np.concatenate([[0], np.cumsum(gone)])
            removed = count[words.first[1:]] - count[words.first[:-1]]
            out: list = [None] * len(texts)
            where: list = [[] for _ in texts]
            for i in range(len(texts)):
                if not removed[i]:
                    out[i] = texts[i].decode("utf-8", "replace") if raw[i].is_valid else None
                    continue
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[lo:hi].view(np.int8), [0]])))
                where[i] = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]
                left = np.concatenate([[0], edge, [hi - lo]]).reshape(-1, 2) + lo
                parts = [words.raw[words.begin[s] : words.end[e - 1]] for s, e in left.tolist() if e > s]
                out[i] = b" ".join(parts).decode("utf-8", "replace")
            rest = iter(b.column("row").flatten())
            cols = {f.name: pa.array(out, raw.type) if f.name == text_col else next(rest) for f in fields}
            cols |= {"n_words": pa.array(sizes.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "removed": pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return joined.mapInArrow(cut, T.StructType([*fields, *added.fields]))
