"""Structured Streaming forms of ingest, dedup, windows, sessions and upserts.

Each takes a streaming DataFrame; ``collect_stream`` runs one over all files that are there
and returns what it wrote, so that stream and batch results can be compared.
"""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ledgerline.sources.keyed import KeyedTable
from ledgerline.workdir import new_path

#: Batches of an upsert stream between two compactions.
COMPACT_EVERY = 10


def read_stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A folder's table as a stream of files, each taken once; times without zone become UTC."""
    table = spark.read.parquet(f"{path}/{name}.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet").parquet(path)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, t in table.dtypes if t == "timestamp_ntz"})


def dedup_stream(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """First row of each key within the delay; state is dropped behind the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def window_counts_stream(stream: DataFrame, key: str, at: str, size: str, slide: str, delay: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, size, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_stream(stream: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def enrich_stream(stream: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    return stream.join(registry, key, "left")


def collect_stream(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over what is there; only closed windows are out in append mode."""
    out = new_path(spark, f"stream-{name}")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upsert_stream(spark: SparkSession, stream: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Latest row a key: every batch is an upsert of a keyed table under its own id, so a replay changes nothing."""
    out = new_path(spark, f"upsert-{name}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    held = KeyedTable(spark, out, schema, keys, at)

    def store(batch: DataFrame, batch_id: int) -> None:
        held.upsert(str(batch_id), batch)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            held.compact()

    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    return held.read()


class _OncePerKey(StatefulProcessor):
    """Lets a key's first row through while it has no live alert; a dismissal ends the alert, and so does its time."""

    def __init__(self, order: str, columns: list[str], dismissed: str, at: str | None, days: int) -> None:
        self.order, self.columns, self.dismissed, self.at, self.span = order, columns, dismissed, at, days * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "until long")

    def _until(self, when) -> int:
        return 0 if self.at is None else int(pd.Timestamp(when).value // 1_000_000) + self.span

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        # Rows of one key in one trigger, by their order.
        whole = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        times = whole[self.at].tolist() if self.at else [None] * len(whole)
        until, out = (self.live.get()[0] if self.live.exists() else None), []
        for i, (gone, when) in enumerate(zip(whole[self.dismissed].tolist(), times, strict=True)):
            if until and self.at and int(pd.Timestamp(when).value // 1_000_000) >= until:
                until = None
            if gone:
                until = None
            elif until is None:
                out.append(i)
                until = self._until(when)
        if until is None:
            self.live.clear()
        else:
            self.live.update((until,))
            if until:
                self.handle.registerTimer(until)
        yield whole.iloc[out][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.live.exists() and 0 < self.live.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.live.clear()
        return iter([])

    def handleInitialState(self, key, rows, timerValues):  # noqa: N802, N803
        self.live.update((0,))

    def close(self) -> None:
        pass


def alert_stream(spark: SparkSession, stream: DataFrame, live: DataFrame, keys: list[str], order: str, name: str, dismissed: str = "dismissed", at: str | None = None, days: int = 60, delay: str = "0 seconds") -> DataFrame:
    """One alert a key while it is not dismissed: rows whose key has no live alert, by ``order`` within a trigger.

    A row with ``dismissed`` set ends its key's alert, so the next row alerts again; with ``at``
    an alert also ends after ``days``, and a timer drops its state once the watermark is there.
    ``live`` are the keys whose alert stands at the start, without an end. What is held is one
    value a live key; no batch reads an earlier one. Rows of one key within a trigger are taken
    together: bound a trigger by its files.
    """
    columns = [c for c in stream.columns if c != dismissed]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields if f.name != dismissed)
    setting, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting)
    spark.conf.set(setting, store)
    try:
        rows = stream.withWatermark(at, delay) if at else stream
        alerts = rows.groupBy(*keys).transformWithStateInPandas(_OncePerKey(order, columns, dismissed, at, days), schema, "Append", "EventTime" if at else "None", initialState=live.select(*keys).distinct().groupBy(*keys))
        return collect_stream(spark, alerts, f"alerts-{name}")
    finally:
        spark.conf.set(setting, before)


def late_rows(spark: SparkSession, arrivals: list[DataFrame], at: str, delay: timedelta) -> DataFrame:
    """Rows that lie more than ``delay`` behind the newest row of the batches before theirs.

    ``arrivals`` are written to a folder one after another and read as a stream, a file's batch
    each; every batch is split and its late rows go to a side table. A batch leaves the newest
    time of all batches so far, so the next one reads that alone.
    """
    root, out = new_path(spark, "arrivals"), new_path(spark, "late-rows")
    schema = arrivals[0].schema

    def split(batch: DataFrame, batch_id: int) -> None:
        seen = spark.read.schema(f"{at} timestamp").parquet(f"{out}-seen/batch={batch_id - 1}") if batch_id else spark.createDataFrame([(None,)], f"{at} timestamp")
        batch.select(at).union(seen).agg(F.max(at).alias(at)).write.mode("overwrite").parquet(f"{out}-seen/batch={batch_id}")
        top = seen.select(F.col(at).alias("top"))
        late = batch.join(F.broadcast(top)).where(F.col(at) < F.col("top") - F.lit(delay)).drop("top")  # one row
        late.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for rows in arrivals:
        rows.write.mode("append").parquet(root)
        stream = spark.readStream.schema(schema).parquet(root)
        stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*")
