"""Micro-batches: the newest row per key in the engine's keyed state, and the log of what each batch changed.

The state lives in the engine's state store: a batch writes the keys that it touched
to the store's change log, whatever the size of the state, and the store's versions belong to
the batches, so that a batch that is run again after a failure starts from the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: How the engine keeps keyed state: on disk, with a log of changes for each batch; keys expire in batches that have data.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _rank(schema: StructType, order: str) -> Column:
    """The order as a long, so that the state compares it alike for numbers and times; null comes first."""
    kind = schema[order].dataType.simpleString()
    value = F.unix_micros(order) if kind == "timestamp" else F.unix_date(order).cast("bigint") if kind == "date" else F.col(order).cast("bigint")
    return F.coalesce(value, F.lit(-(1 << 63)))


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    old = state.get if state.exists else None
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"key": [key[0]], "change": ["expire"], "old": [old[1]], "new": [None]})
        return
    best = old
    for pdf in frames:
        # frames come one after the other, so a key with very many rows is never held whole
        row = pdf.sort_values(["rank", "body"]).iloc[-1]
        found = (int(row["rank"]), str(row["body"]))
        best = found if best is None or found >= tuple(best) else best
    state.update(tuple(best))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    if old is None or old[1] != best[1]:
        yield pd.DataFrame({"key": [key[0]], "change": ["add" if old is None else "modify"], "old": [None if old is None else old[1]], "new": [best[1]]})


def run(spark: SparkSession, source: str, schema: str | StructType, key: str, order: str, work: str, files_per_batch: int = 1, idle_ms: int | None = None) -> StreamingQuery:
    """All files now in ``source``, a batch of files at a time: the row of largest ``order`` per key wins, of equal ones the largest as text.

    ``work``/changes gets, under the batch's number, (key, change, old, new): ``old`` and ``new`` are the row's other
    columns, change is add, modify, or expire for a key that had no row for ``idle_ms``.  A batch that changes nothing logs nothing; one that is
    run again replaces its own files.  Rows without a key are left out.
    """
    schema = spark.createDataFrame([], schema).schema
    rest = StructType([f for f in schema if f.name != key])
    for name, value in STORE.items():
        spark.conf.set(name, value)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).where(F.col(key).isNotNull())
    keyed = stream.select(F.col(key).alias("key"), _rank(schema, order).alias("rank"), F.to_json(F.struct(*rest.names), {"ignoreNullFields": "false"}).alias("body"))
    kind = schema[key].dataType.simpleString()
    changed = keyed.groupBy("key").applyInPandasWithState(
        lambda k, frames, state: _newest(k, frames, state, idle_ms), f"key {kind}, change string, old string, new string", "rank bigint, body string", "update",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
    )

    def log(df: DataFrame, batch: int) -> None:
        told = df.select(F.col("key").alias(key), "change", F.from_json("old", rest).alias("old"), F.from_json("new", rest).alias("new"))
        told.write.mode("overwrite").parquet(f"{work}/changes/batch={batch:010d}")

    return changed.writeStream.foreachBatch(log).outputMode("update").option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start()


def changes(spark: SparkSession, work: str) -> DataFrame:
    """The change log of all batches."""
    return spark.read.parquet(f"{work}/changes")


def current(spark: SparkSession, work: str, schema: str | StructType, key: str) -> DataFrame:
    """The newest row of every key, read from the engine's state as of the last batch."""
    schema = spark.createDataFrame([], schema).schema
    rest = StructType([f for f in schema if f.name != key])
    found = spark.read.format("statestore").load(f"{work}/progress").select(F.col("key.key").alias(key), F.from_json("value.groupState.body", rest).alias("row"))
    return found.select(key, "row.*").select(*schema.names)
