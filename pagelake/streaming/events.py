"""Structured Streaming over event folders and arriving pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from pagelake.functions import quality
from pagelake.operators import content
from pagelake.operators.shared import shared_path


def tail(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored events first, then those that arrive."""
    return spark.readStream.schema(schema).parquet(path)


def idempotent(events: DataFrame, key: str = "event_id", *, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once; with ``time``, state is kept for ``delay`` only."""
    if time is None:
        return events.dropDuplicates([key])
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def keep_state(spark: SparkSession) -> None:
    """Let streams with state of their own keep it on disk, as they must."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InSequence(StatefulProcessor):
    """Events of a run by sequence: one is sent when all before it were, others wait in the state."""

    def __init__(self, schema: T.StructType, end: str, patience_ms: int | None, forget_ms: int | None):
        self.names, self.end, self.patience, self.forget = schema.names, end, patience_ms, forget_ms
        self.at, self.kind = schema.names.index("sequence"), schema.names.index("event_type")
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "sequence long")
        self.over = handle.getValueState("over", "over boolean", ttlDurationMs=self.forget)
        self.waiting = handle.getMapState("waiting", "sequence long", self.schema)

    def _send(self, arrived: dict[int, tuple], next_: int) -> Iterator[pd.DataFrame]:
        """What follows on without a gap; the rest waits."""
        out, ended, stored = [], False, self.waiting.exists()
        while not ended:
            row = arrived.pop(next_, None)
            if row is None and stored and self.waiting.containsKey((next_,)):
                row = tuple(self.waiting.getValue((next_,)))
                self.waiting.removeKey((next_,))
            if row is None:
                break
            out.append(row)
            ended, next_ = row[self.kind] == self.end, next_ + 1
        if ended:
            self.over.update((True,))
            self.next.clear()
            self.waiting.clear()
            for timer in list(self.handle.listTimers()) if self.patience else []:
                self.handle.deleteTimer(timer)
        else:
            for n, row in arrived.items():
                if n > next_:
                    self.waiting.updateValue((n,), row)
            self.next.update((next_,))
        if out:
            yield pd.DataFrame(dict(zip(self.names, zip(*out))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            return
        for frame in rows:  # some thousand events at a time
            if self.over.exists():
                return
            next_ = self.next.get()[0] if self.next.exists() else 1
            values = [tuple(x.item() if hasattr(x, "item") else x for x in row) for row in frame[self.names].itertuples(index=False)]
            yield from self._send({r[self.at]: r for r in reversed(values) if r[self.at] >= next_}, next_)
        if self.patience and not self.over.exists() and self.waiting.exists() and not list(self.handle.listTimers()):
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timers: TimerValues, expired: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The gap before the waiting events is given up."""
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is not None:
            yield from self._send({}, first)
        if not self.over.exists() and self.waiting.exists():
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience)

    def close(self) -> None:
        pass


def until_finished(events: DataFrame, end: str = "FINISHED", *, patience_ms: int | None = None, forget_ms: int | None = None) -> DataFrame:
    """Events ``run_id, sequence, event_type, ...`` of each run in sequence up to its end, later ones dropped.

    Sequences of a run count from 1. An event that comes early waits, over batches and
    restarts, until all before it have come; of events with one sequence the first stays.
    With ``patience_ms``, a gap that lasts longer is passed over. At the end the
    waiting events go; that the run is over is remembered, for ``forget_ms`` if given.
    Frames of a run are taken one by one, so no run is held as a whole.
    """
    keep_state(events.sparkSession)
    mode = "ProcessingTime" if patience_ms or forget_ms else "None"
    return events.groupBy("run_id").transformWithStateInPandas(_InSequence(events.schema, end, patience_ms, forget_ms), events.schema, "Append", mode)


#: What a run goes through, never back.
STATES = ("QUEUED", "RUNNING", "FINISHED")


class _Transitions(StatefulProcessor):
    """The furthest state of a run; each state that it enters is sent once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rank = handle.getValueState("rank", "rank int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        rank = self.rank.get()[0] if self.rank.exists() else -1
        first: dict[int, int] = {}
        for frame in rows:
            for state, seq in frame[frame["state"].isin(STATES)].groupby("state")["seq"].min().items():
                i = STATES.index(state)
                first[i] = min(int(seq), first.get(i, int(seq)))
        sent = [(i, seq) for i, seq in sorted(first.items()) if i > rank and all(seq < s for j, s in first.items() if j > i)]
        if sent:
            self.rank.update((sent[-1][0],))
            yield pd.DataFrame([(key[0], STATES[i], seq, STATES[i] == STATES[-1]) for i, seq in sent], columns=["run_id", "state", "seq", "notify"])

    def close(self) -> None:
        pass


def run_states(events: DataFrame) -> DataFrame:
    """States that each run enters, from ``run_id, state, seq``: ``run_id, state, seq, notify``.

    A state of ``STATES`` is sent once, with the first event that brought it, and never
    after a later one; ``notify`` marks the end of a run and is sent once too, also over
    restarts. Other states are ignored.
    """
    keep_state(events.sparkSession)
    out = T.StructType([events.schema["run_id"], T.StructField("state", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("notify", T.BooleanType())])
    return events.select("run_id", "state", F.col("seq").cast("long").alias("seq")).groupBy("run_id").transformWithStateInPandas(_Transitions(), out, "Append", "None")


def page_states(pages: DataFrame, text: str) -> DataFrame:
    """Quality columns of arriving texts; the same functions as in batch."""
    return quality.with_quality(pages, F.col(text))


def run_to_table(stream: DataFrame, name: str, *, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Process all that is there and read the written table.

    In update mode each batch appends the rows that it changed, so unchanged ones are
    not written again; the table that is read has the last row of each of ``keys``.
    """
    spark = stream.sparkSession
    out, marks = shared_path(spark, name), shared_path(spark, f"{name}-marks")
    writer = stream.writeStream.option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, batch: df.withColumn("_batch", F.lit(batch).cast("long")).write.mode("append").parquet(out)).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    table = spark.read.schema(stream.schema.add("_batch", "long")).parquet(out)
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def store_arrivals(stream: DataFrame, body: str, name: str = "cas") -> DataFrame:
    """Append each batch's new contents to a content store, once however often the batch is run, and read the store."""
    spark = stream.sparkSession
    out, marks = shared_path(spark, name), shared_path(spark, f"{name}-marks")
    stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(lambda df, n: content.cas_append(out, df, body, f"b{n}")).start().awaitTermination()
    return content.content_store(spark, out).read()
