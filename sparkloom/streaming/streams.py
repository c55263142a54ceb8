"""Streams: sources, windows, deduplication, bounded shuffles, token-budget batches and idempotent appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sparkloom.functions.hashing import order_key


def file_stream(spark: SparkSession, path: str, schema: StructType, *, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def with_event_time(df: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A time without zone becomes one with, and gets a watermark."""
    timed = df.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, delay) if df.isStreaming else timed


def tumbling_counts(df: DataFrame, column: str, width: str, keys: list[str], value: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return df.groupBy(F.window(column, width).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def sliding_counts(df: DataFrame, column: str, width: str, slide: str, keys: list[str]) -> DataFrame:
    return df.groupBy(F.window(column, width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(df: DataFrame, column: str, gap: str, keys: list[str]) -> DataFrame:
    """Sessions of events no farther apart than ``gap``."""
    return df.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def deduplicate(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key; state is dropped behind the watermark."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def batched_map(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """A function over Arrow batches; columns it doesn't return are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def shuffled_batches(seed: int, key: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch in hash order."""
    def run(batch: DataFrame, number: int) -> None:
        write(batch.orderBy(order_key(f"{seed}:{number}", F.col(key)), key), number)

    return run


def append_new(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append rows whose key is not in the table yet, so that a replayed batch adds nothing."""
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
            rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
        rows.write.mode("append").parquet(path)

    return run


def token_batches(df: DataFrame, key: str, item: str, tokens: str, budget: int) -> DataFrame:
    """(key, batch, items, tokens): rows of each key gathered until the budget would be passed; what is left waits in the state."""
    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, items, used = state.get if state.exists else (0, "", 0)
        held = items.split("\x1f") if items else []
        out = []
        for frame in frames:
            for name, n in zip(frame[item].astype(str), frame[tokens], strict=True):
                if held and used + n > budget:
                    out.append((group[0], number, ",".join(held), used))
                    number, held, used = number + 1, [], 0
                held.append(name)
                used += int(n)
        state.update((number, "\x1f".join(held), used))
        yield pd.DataFrame(out, columns=[key, "batch", "items", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, item, tokens).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, batch long, items string, tokens long", "number long, items string, used long", "append", GroupStateTimeout.NoTimeout)


def keep_new_states(df: DataFrame, key: str, item: str, x: str, y: str, gap: float, most: int = 100_000) -> DataFrame:
    """(key, item): rows at least ``gap`` from every kept one of their key, in order of arrival.

    Kept points are a key's state; more than ``most`` of them is an error, not a silent loss.
    """
    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        xs, ys = (list(v) for v in state.get) if state.exists else ([], [])
        out = []
        for frame in frames:
            for name, a, b in zip(frame[item], frame[x], frame[y], strict=True):
                if all((a - p) ** 2 + (b - q) ** 2 >= gap * gap for p, q in zip(xs, ys, strict=True)):
                    xs.append(float(a))
                    ys.append(float(b))
                    out.append((group[0], name))
        if len(xs) > most:
            raise ValueError(f"more than {most} kept points for {group[0]}")
        state.update((xs, ys))
        yield pd.DataFrame(out, columns=[key, item])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, item))
    return df.select(key, item, x, y).groupBy(key).applyInPandasWithState(run, fields, "xs array<double>, ys array<double>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there now and stop; Parquet at ``path``, or a function for each batch."""
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    query.awaitTermination()
