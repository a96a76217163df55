"""Helpers shared by the operators: words, text batches, shared tables, ranks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: A word is a run of characters other than space and U+0009 to U+000D.
#: ``bytes.split()`` splits at exactly these, so Python and SQL agree.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one step of a Python operator holds at once.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a folder of this machine serves if all of Spark
    runs in one process; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "/tmp/pagelake-shared"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def job_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; other jobs have their own."""
    return f"{shared_dir(spark)}/pagelake/{spark.sparkContext.applicationId}"


def clear_tables(spark: SparkSession) -> None:
    """Remove all tables that operators of this application wrote to the shared folder.

    For the end of a job: results that were not written elsewhere can't be read afterwards.
    """
    remove_folder(spark, job_dir(spark))


class Tables:
    """The written tables of one call, by name, so that used-up ones can go before the call ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{job_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *, compression: str = "zstd") -> DataFrame:
        """Write ``df`` and read it back.

        This cuts the lineage: a lost executor costs a re-read, not a recomputation
        of all that came before, and several consumers read one result.
        """
        df.write.option("compression", compression).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables of which all that is read later was written since."""
        for name in names:
            remove_folder(self.spark, f"{self.root}/{name}")

    def clear(self) -> None:
        """Remove all of them."""
        remove_folder(self.spark, self.root)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A written table of its own, which stays until ``clear_tables``."""
    return Tables(df.sparkSession, name).write(df, "table")


#: Keys that may be broadcast as hot (a key and a few numbers each).
HOT_KEYS = 20_000
#: Rows of one key that are never called hot.
FEW_ROWS = 200


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right``, without hot tasks.

    Column ``n`` of ``right`` counts the key's rows in ``left``, ``total`` all of
    them. Keys with more than a ``HOT_KEYS``-th of all rows, of which there are
    ``HOT_KEYS`` at most, are broadcast; the other rows are shuffled.
    """
    bound = max(FEW_ROWS, total // HOT_KEYS)
    if total <= bound:
        return left.join(right, key)
    hot = F.broadcast(right.where(F.col(n) > bound))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(n) <= bound), key)
    return rest.unionByName(left.join(hot, key))


def word_count(text: Column) -> Column:
    """Number of words (null: 0), counted by the JVM."""
    found = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    return F.when(text.isNull(), F.lit(0)).otherwise(found).cast("long")


def text_chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``.

    One longer text makes a batch of its own; texts are never cut.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if held and held + sizes[i] > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partition and sort by ``keys``; partition numbers follow the order."""
    return df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(
        *[F.col(k).asc_nulls_first() for k in keys]
    )


def number_rows(df: DataFrame, order: list[str], *, by: list[str], sums: dict[str, str], name: str, tables: Tables | None = None) -> DataFrame:
    """Add running sums without putting a group in one task.

    For each entry ``out: column`` of ``sums`` the result has ``out``, the sum
    of the long ``column`` over the earlier rows of the same ``by`` values, in
    ``order`` (nulls first). Rows are range-partitioned on ``by + order``, each
    partition adds up its own rows, and only one row per partition and group
    takes part in the sum over partitions. The rows are written as table ``name``.
    """
    keys = [*by, *order]
    outs = list(sums)
    fields = df.schema.fields
    schema = T.StructType([*fields, *[T.StructField(o, T.LongType()) for o in outs], T.StructField("_part", T.IntegerType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last: tuple = ()
        run = dict.fromkeys(outs, 0)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            now = list(zip(*[b.column(k).to_pylist() for k in by])) if by else [()] * n
            starts = [i for i in range(n) if now[i] != (now[i - 1] if i else last)]
            cuts = sorted({0, *starts}) + [n]
            cols = {o: pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for o, c in sums.items()}
            made = {o: np.empty(n, np.int64) for o in outs}
            for lo, hi in zip(cuts, cuts[1:]):
                if lo in starts:
                    run = dict.fromkeys(outs, 0)
                for o in outs:
                    total = np.cumsum(cols[o][lo:hi])
                    made[o][lo:hi] = run[o] + total - cols[o][lo:hi]
                    run[o] += int(total[-1])
            last = now[-1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(made[o]) for o in outs], pa.array(np.full(n, part, np.int32))],
                names=[*b.schema.names, *outs, "_part"],
            )

    done = (tables or Tables(df.sparkSession, name)).write(ranged(df, *keys).mapInArrow(local, schema), name)
    ends = [F.max(F.col(o) + F.coalesce(F.col(c), F.lit(0))).alias(f"_{o}") for o, c in sums.items()]
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = done.groupBy(*by, "_part").agg(*ends)
    bases = bases.select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in outs])
    on = F.col("_part") == F.col("_p")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    return done.join(bases, on).select(*[f.name for f in fields], *[(F.col(o) + F.col(f"_b_{o}")).alias(o) for o in outs])
