"""Tables that grow by batches: staged files, one commit per batch, reads of touched shards only.

A batch is written to a folder of its own and counts from the moment its manifest is
there. A batch that failed is written anew under its name, and one that was committed
is not written again, so a retry leaves one copy. A table has one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits of a digest of the key that name a shard: 16 folders a batch, so that small batches are few files.
DIGITS = 1


def shard_of(key: Column) -> Column:
    """The first ``DIGITS`` of the key's digest in hexadecimal."""
    return F.left(F.sha2(key.cast("string"), 256), F.lit(DIGITS))


class BatchTable:
    """A folder of batches; ``schema`` has no columns ``batch`` and ``shard``, which are those of its folders."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[dict]:
        """What was committed, by first sequence: ``batch, first, n`` of each batch."""
        at = self.path(f"{self.root}/manifests")
        if not self.files.exists(at):
            return []
        names = [s.getPath().toString() for s in self.files.listStatus(at) if s.getPath().getName().endswith(".json")]
        rows = self.spark.read.schema("batch string, first long, n long").json(names).collect() if names else []  # a row per batch
        return sorted((r.asDict() for r in rows), key=lambda m: m["first"])

    def read(self, shards: list[str] | None = None) -> DataFrame:
        """All committed rows, or those of some shards: other folders are not read."""
        paths = [f"{self.root}/data/batch={m['batch']}" for m in self.manifests() if m["n"]]
        whole = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()), T.StructField("shard", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).option("basePath", f"{self.root}/data").parquet(*paths)
        return rows if shards is None else rows.where(F.col("shard").isin(*shards))

    def touched(self, keys: DataFrame, key: str) -> list[str]:
        """The shards of some keys, 16 at most."""
        return [r.s for r in keys.select(shard_of(F.col(key)).alias("s")).where("s IS NOT NULL").distinct().collect()]

    def append(self, batch: str, rows: DataFrame, key: str, first: int = 0) -> int:
        """Stage ``rows`` under a batch's name and commit them; the number of rows."""
        out = f"{self.root}/data/batch={batch}"
        staged = rows.select(*self.schema.names, F.coalesce(shard_of(F.col(key)), F.lit("none")).alias("shard"))
        # by shard, large ones over several tasks
        staged.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(out)
        n = self.spark.read.schema(self.schema).parquet(out).count() if self.files.exists(self.path(out)) else 0
        self.commit(batch, first, n)
        return n

    def commit(self, batch: str, first: int, n: int) -> None:
        """Write the manifest under another name, then rename it: it is there as a whole or not at all."""
        draft, final = (self.path(f"{self.root}/manifests/{name}") for name in (f"_{batch}.draft", f"{batch}.json"))
        out = self.files.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, "first": first, "n": n}).encode()))
        out.close()
        if not self.files.rename(draft, final) and not self.files.exists(final):
            raise OSError(f"batch {batch} could not be committed")
