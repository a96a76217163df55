"""Tables written between steps."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Bytes of bodies that one step of a Python operator holds as objects.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, body: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of ``body``, a row at least: what a task makes of bodies grows with a piece, not a batch."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(body)), 0).to_pylist()):
        if i > first and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n + 64
    if first < batch.num_rows:
        yield batch.slice(first)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is not set, a folder of this machine serves if all of Spark runs in
    one process; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{found or '/tmp/pagelake-shared'}/pagelake/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_tables(spark: SparkSession) -> None:
    """Remove all tables that operators of this application wrote between steps, at the end of a job."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: cuts the lineage of loops and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffled(spark: SparkSession, rows: int, most: int) -> Iterator[None]:
    """What is run inside deals shuffles of ``rows`` over a partition per ``most`` rows at least.

    Unlike ``repartition``, this leaves it to Spark to merge small partitions and split skewed ones.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), -(-rows // most))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, total: int, *, few: int = 10_000, hot: int = 20_000) -> DataFrame:
    """Null-safe inner join on ``key``, unique in ``right``, whose column ``n`` counts the key's rows in ``left``.

    Keys with more than a ``hot``-th of the ``total`` rows, ``hot`` of them at most, are
    broadcast, so no task gets all rows of one key; the others are shuffled.
    """
    bound, other = max(few, total // hot), right.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    often = F.broadcast(other.where(F.col(n) > bound))
    if total <= bound:
        return left.join(other, same).drop("_key")
    rest = left.join(often.select("_key"), same, "left_anti").join(other.where(F.col(n) <= bound), same)
    return rest.unionByName(left.join(often, same)).drop("_key")


def join_split(left: DataFrame, right: DataFrame, key: str, n: str, total: int, *, few: int = 10_000, hot: int = 20_000) -> DataFrame:
    """``join_counted`` where the rows of ``right`` may be of any size: of hot keys only the keys are broadcast.

    The rows of a hot key are dealt over as many shares as its count asks for, and its row of
    ``right`` is copied once per share. ``left`` must be read from a table, so that a task
    that is run again deals its rows alike.
    """
    bound = max(few, total // hot)
    other = right.withColumn("_shares", F.ceil(F.col(n) / bound).cast("int")).withColumnRenamed(key, "_same")
    if total <= bound:
        return left.join(other, F.col(key).eqNullSafe(F.col("_same"))).drop("_same", "_shares")
    often = F.broadcast(other.where("_shares > 1").select(F.col("_same").alias("_often"), F.col("_shares").alias("_of")))
    dealt = left.withColumn("_row", F.monotonically_increasing_id()).join(often, F.col(key).eqNullSafe(F.col("_often")), "left")
    dealt = dealt.withColumn("_share", F.pmod("_row", F.coalesce("_of", F.lit(1)).cast("long")).cast("int"))
    copies = other.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    same = F.col(key).eqNullSafe(F.col("_same")) & (F.col("_share") == F.col("_copy"))
    return dealt.join(copies, same).drop("_same", "_shares", "_row", "_often", "_of", "_share", "_copy")


def ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows in range partitions of ``by`` and ``order``: ``_part``, and ``_k``, the place in part and group.

    No group is one task, and parts follow the order.
    """
    parts = written(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id()), "ranged")
    return parts.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1)


def on_parts(rows: DataFrame, bases: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``ranged`` with what ``bases`` has for their group and part."""
    bases = bases.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_p"), *[c for c in bases.columns if c not in (*by, "_part")])
    same = F.col("_part") == F.col("_p")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return rows.join(bases, same).drop("_p", *[f"_by_{b}" for b in by])


def earlier_parts(by: list[str]):
    return Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def accumulated(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], *, before: bool = False) -> DataFrame:
    """Add, for each entry of ``sums``, the sum over this and the earlier rows of the group in ``order``.

    With ``before``, this row's own is left out.
    Each part adds up its own rows; one row per part and group takes part in the
    sum over parts.
    """
    rows = ranged(df, by, order)
    here = Window.partitionBy(*by, "_part").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    bases = totals.select(*by, "_part", *[F.coalesce(F.sum(n).over(earlier_parts(by)), F.lit(0)).alias(f"_b_{n}") for n in sums])
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()})
    return on_parts(rows, bases, by).select(*df.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """Add ``out``, the place from 0 of each row in ``order`` among its ``by`` values."""
    return accumulated(df, by, order, {out: F.lit(1)}).withColumn(out, F.col(out) - 1)
