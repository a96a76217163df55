"""Exact top-k search (operator 5) by distributed histogram selection.

Candidate vectors are packed into blocks where they lie and are not moved again.
Query vectors are packed into blocks, too, and sent to all candidates in passes of
bounded size. Every round scores all pairs of blocks; each task adds up, per query,
a histogram of its highest scores in the query's current range (of the highest
bins, those that hold k), and the bin in which the k-th score lies is the next
range. When bins have width 1 the k-th score is known. A last round keeps scores
above it, and of those equal to it the ids that the ties need. Only histograms and
results are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagelake.llm.common import Tables

#: Vectors in a block, bins of a histogram, and bytes of query vectors in a pass.
CANDIDATES, QUERIES, BINS = 4096, 2048, 4096
PASS_BYTES = 32 << 20
#: Scores from here on are ranked by their exact integers.
SATURATED = 1 << 62
NO_SCORE = -(1 << 63)


def quantized(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``row, id, dim, v``: floor(scale * x) of every component, as whole doubles, and a number for the row.

    Rows with a null id, a null vector, an empty one, or null or non-finite
    components take no part, nor do components that ``scale`` takes out of the range
    of doubles. Rows with one id stay apart.
    """
    x = F.col(vector_col).cast("array<double>")
    v = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**44, F.floor(c * scale).cast("double")).otherwise(c * scale))  # whole beyond
    usable = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), v.alias("v"))


def _packed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Blocks of the vectors of one task, by length, ids ascending."""
    held: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        row, id_, v = (np.concatenate(x) for x in zip(*held.pop(dim)))
        order = np.argsort(id_, kind="stable")
        cols = [pa.array([dim], pa.int32()), *[pa.array([x[order].tobytes()], pa.binary()) for x in (row, id_, v)]]
        return pa.RecordBatch.from_arrays(cols, names=["dim", "c_rows", "c_ids", "c_vectors"])

    for b in batches:
        dims, row, id_ = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "row", "id"))
        flat, ends = b.column("v").flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
        for dim in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == dim)
            places = (ends[mine] - dim)[:, None] + np.arange(dim)
            for s in range(0, len(mine), CANDIDATES):
                some = mine[s : s + CANDIDATES]
                held.setdefault(dim, []).append((row[some], id_[some], flat[places[s : s + CANDIDATES]].astype(kind)))
                if sum(len(x[0]) for x in held[dim]) >= CANDIDATES:
                    yield block(dim)
    for dim in list(held):
        yield block(dim)


def _exact(v: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in r] for r in v.tolist()], object).reshape(v.shape)


def _scores(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """Integer inner products, and the exact ones of those that are cut to ``SATURATED``.

    Cauchy's inequality bounds a score and all sums on the way to it: doubles hold
    them below 2**53, int64 below 2**62, Python integers beyond.
    """
    q, c = q.astype(np.float64), c.astype(np.float64)
    with np.errstate(over="ignore"):
        long_q, long_c = np.sqrt((q * q).sum(1)) * 1.001, np.sqrt((c * c).sum(1)) * 1.001
        most = long_q[:, None] * long_c[None, :] if long_q.max(initial=0) * long_c.max(initial=0) >= 2.0**53 else None
    if most is None:
        return (q @ c.T).astype(np.int64), {}
    big_q, big_c = (most >= 2.0**53).any(1), (most >= 2.0**53).any(0)
    if (most < 2.0**62).all():
        return q.astype(np.int64) @ c.astype(np.int64).T, {}
    s, exact = np.zeros(most.shape, np.int64), {}
    s[np.ix_(~big_q, ~big_c)] = q[~big_q] @ c[~big_c].T
    rows, cols = np.flatnonzero(big_q), np.flatnonzero(~big_q)
    for i, j in ((rows, np.arange(len(c))), (cols, np.flatnonzero(big_c))):
        if len(i) and len(j):
            found = _exact(q[i]) @ _exact(c[j]).T
            for a, b in zip(*np.nonzero(np.abs(found) >= SATURATED)):
                exact[int(i[a]), int(j[b])] = found[a, b]
                found[a, b] = SATURATED if found[a, b] > 0 else -SATURATED
            s[np.ix_(i, j)] = found.astype(np.int64)
    return s, exact


def _first_k(query: np.ndarray, order: list[np.ndarray], k: int) -> np.ndarray:
    """Indexes of the first ``k`` rows of each query, sorted by ``order`` (most significant first)."""
    at = np.lexsort([*order[::-1], query])
    head = np.flatnonzero(np.diff(query[at], prepend=-1))
    place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    return at[place < k]


#: The order of exact integers as that of bytes: shifted to be positive, big-endian.
_SHIFT, _WIDE = 1 << 2200, 280


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own, of the same length. Rows that share an id are
    candidates each, of each other, too, and queries each. Ties go to the smaller
    id. A query with fewer candidates gets all of them, one with none gets no row.
    Components may be any doubles: scores that no long holds are ranked exactly
    and returned as the largest or smallest long.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "top-k")
    rows = tables.write(quantized(vectors, id_col=id_col, vector_col=vector_col, scale=scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    widest = F.array_max(F.transform("v", F.abs))
    query = F.col("id") % every == 0
    longest, widest, dim, n = rows.agg(F.max(square), F.max(widest), F.max("dim"), F.count_if(query)).first()  # one row
    reach = int(min(SATURATED, (longest or 0.0) * 1.000001 + 1))  # no score is larger, by Cauchy's inequality
    kind, sql = ("<i2", "short") if (widest or 0) < 2**15 else ("<i4", "int") if widest < 2**31 else ("<f8", "double")
    stored = F.transform("v", lambda x: x.cast(sql)).alias("v")
    size = max(1, min(QUERIES, PASS_BYTES // (int(kind[2]) * (dim or 1))))
    blocks = max(1, math.ceil((n or 0) / size))
    per_pass = max(1, PASS_BYTES // (int(kind[2]) * size * (dim or 1)))
    candidates = tables.write(rows.select("row", "id", "dim", stored).mapInArrow(lambda x: _packed(x, kind), "dim int, c_rows binary, c_ids binary, c_vectors binary"), "candidates")
    queries = tables.write(rows.where(query).select("row", "id", "dim", stored).withColumn("q", F.pmod(F.xxhash64("row"), F.lit(blocks))), "queries")
    tables.drop("vectors")

    def pack(table: pa.Table) -> pa.Table:
        row, id_, low, need = (table.column(c).to_numpy().astype("<i8").tobytes() for c in ("row", "id", "low", "need"))
        v = table.column("v").combine_chunks().flatten().to_numpy().astype(kind).tobytes()
        return pa.table({"q": table.column("q")[:1], "dim": table.column("dim")[:1], "rows": [row], "ids": [id_], "low": [low], "need": [need], "vectors": [v]})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                longs = lambda c: np.frombuffer(x[c], "<i8")  # noqa: E731, B023
                q, c = (np.frombuffer(x[y], kind).reshape(-1, x["dim"]) for y in ("vectors", "c_vectors"))
                s, exact = _scores(q, c)
                s[longs("rows")[:, None] == longs("c_rows")[None, :]] = NO_SCORE
                yield (x["q"], x["dim"]), longs("rows"), longs("ids"), longs("c_ids"), s, exact, longs("low"), longs("need")

    def round_of(state: DataFrame | None, run, schema: str, name: str) -> DataFrame:
        """``run`` over all pairs of blocks, a pass of query blocks at a time."""
        ranges = queries.withColumn("low", F.lit(None).cast("long")).withColumn("need", F.lit(None).cast("long")) if state is None else queries.join(state, "row", "left")
        ranges = ranges.withColumn("low", F.coalesce("low", F.lit(-reach))).withColumn("need", F.coalesce("need", F.lit(k)).cast("long"))
        packed = ranges.groupBy("q", "dim").applyInArrow(pack, "q long, dim int, rows binary, ids binary, low binary, need binary, vectors binary")
        packed = tables.write(packed, f"{name}-queries")
        done = []
        for first in range(0, blocks, per_pass):
            some = packed.where(F.col("q").between(first, first + per_pass - 1))
            found = candidates.join(F.broadcast(some), "dim").mapInArrow(run, schema)  # at most PASS_BYTES of vectors
            done.append(tables.write(found, f"{name}-{first}"))
        out = done[0]
        for x in done[1:]:
            out = out.unionByName(x)
        return out

    def used(name: str) -> list[str]:
        """The tables of a round."""
        return [f"{name}-queries", *[f"{name}-{first}" for first in range(0, blocks, per_pass)]]

    def histogram(span: int, width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops: dict[tuple, list] = {}
            for key, row, _, _, s, _, low, need in scored(batches):
                if s.shape[1] > k:
                    s = np.partition(s, s.shape[1] - k, axis=1)[:, -k:]
                inside = (s >= low[:, None]) & (s - low[:, None] < span) & (s > NO_SCORE)
                bins = np.where(inside, (s - low[:, None]) // width, -1)
                if key in tops:
                    bins = np.concatenate([tops[key][-1], bins], axis=1)
                tops[key] = [row, low, need, -np.sort(-bins, axis=1)[:, :k]]
            for row, low, need, bins in tops.values():
                flat = np.repeat(np.arange(len(row)), bins.shape[1]) * (BINS + 1) + bins.ravel() + 1
                at, count = np.unique(flat[bins.ravel() >= 0], return_counts=True)
                i, b = at // (BINS + 1), at % (BINS + 1) - 1
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (row[i], low[i], need[i], b, count)], names=["row", "low", "need", "bin", "n"])

        return run

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list] = {}
        for key, row, id_, c_ids, s, exact, low, need in scored(batches):
            equal = (s == low[:, None]) & (abs(low) < SATURATED)[:, None]
            equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= need[:, None]  # ids ascend in a block
            at, c = np.nonzero(((s > low[:, None]) | equal | ((s == low[:, None]) & (abs(low) >= SATURATED)[:, None])) & (s > NO_SCORE))
            beyond = np.array([exact.get(x, 0) for x in zip(at.tolist(), c.tolist())] if exact else [0] * len(at), object)
            now = [at, s[at, c], beyond, c_ids[c]]
            if key in kept:
                now = [np.concatenate(x) for x in zip(kept[key][-1], now)]
            rank = {x: i for i, x in enumerate(sorted(set(now[2].tolist())))}
            best = _first_k(now[0], [-now[1], np.array([-rank[x] for x in now[2].tolist()], np.int64), now[3]], k)
            kept[key] = [row, id_, [x[best] for x in now]]
        for row, id_, (at, s, beyond, found) in kept.values():
            score = s.copy()
            for i in np.flatnonzero(np.abs(s) >= SATURATED):
                score[i] = max(-(1 << 63), min((1 << 63) - 1, beyond[i]))
            order = [int(x + _SHIFT).to_bytes(_WIDE, "big") if x else b"" for x in beyond.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(id_[at]), pa.array(found), pa.array(score), pa.array(order, pa.binary())], names=["row", "query_id", "vec_id", "score", "beyond"])

    span, state, step = 2 * reach + 1, None, 0  # the k-th score of a query is in [low, low + span)
    while span > 1:
        width, step = math.ceil(span / BINS), step + 1
        found = round_of(state, histogram(span, width), "row long, low long, need long, bin long, n long", f"round-{step}")
        found = found.groupBy("row", "low", "need", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("bin")))  # at most BINS rows a query
        found = found.withColumn("upto", upto).where("upto >= need")
        # a query with fewer than k candidates has no row here: it keeps the whole range and all of them
        state = tables.write(found.groupBy("row").agg(F.max_by(F.struct((F.col("low") + F.col("bin") * width).alias("low"), (F.col("need") - F.col("upto") + F.col("n")).alias("need")), "bin").alias("x")).select("row", "x.low", "x.need"), f"state-{step}")
        tables.drop(f"state-{step - 1}", *used(f"round-{step}"))
        span = width
    best = round_of(state, select, "row long, query_id long, vec_id long, score long, beyond binary", "best")
    tables.drop("candidates", "queries", f"state-{step}", "best-queries")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
