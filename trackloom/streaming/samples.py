"""The last samples of each name over an event stream, kept as state, and their figures after every micro-batch."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of this kind needs RocksDB; the stores of an executor share one budget of memory outside the heap.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
FIGURES = ("avg", "min", "max", "sum")


class LastSamples(StatefulProcessor):
    """List state with the ``n`` samples of highest ``place``. Holds n samples of a name at a time, however many come."""

    def __init__(self, by: str, n: int) -> None:
        self.by, self.n = by, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "place long, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = [(int(place), value) for place, value in self.kept.get()]
        for part in rows:
            part = part.nlargest(self.n, "place")
            fresh = [(int(p), None if pd.isna(v) else float(v)) for p, v in zip(part["place"], part["value"], strict=True)]
            best = heapq.nlargest(self.n, best + fresh, key=lambda sample: sample[0])
        self.kept.put(best)
        values = pd.Series([v for _, v in best if v is not None], dtype="float64")
        some = len(values) > 0
        figures = [len(values), *(getattr(values, f)() if some else None for f in ("mean", "min", "max", "sum"))]
        yield pd.DataFrame([[key[0], *figures]], columns=[self.by, "count", *FIGURES])

    def close(self) -> None:
        pass


def sample_stats(events: DataFrame, by: str, value: str, place: str, n: int = 1000) -> DataFrame:
    """``usage.sample_stats`` over a stream: count, avg, min, max and sum of the last ``n`` values of each name.

    ``place`` is a long that orders samples (a number of the event); late rows find their place, rows without one are
    left out. Null values take a place and don't count; null is a name of its own. Update mode: a row for each name that
    a micro-batch brings. State is n samples a name; it needs the store of ``STATE_STORE`` where the stream starts.
    """
    rows = events.select(by, F.col(place).cast("long").alias("place"), F.col(value).cast("double").alias("value")).where("place IS NOT NULL")
    out = T.StructType([T.StructField(by, events.schema[by].dataType), T.StructField("count", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FIGURES]])
    return rows.groupBy(by).transformWithStateInPandas(LastSamples(by, n), out, "Update", "None")


def run_to_table(result: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream to its present end; each micro-batch is a folder below ``path``, which a repeated one overwrites."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    conf = result.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        conf.set(k, v)
    try:
        writer = result.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def latest(rows: DataFrame, by: str) -> DataFrame:
    """Of the rows that ``run_to_table`` kept, the newest of each name."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.col("batch").desc()))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth", "batch")
