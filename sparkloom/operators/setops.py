"""Unions, interleaving, repetition and padding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.select import global_row_number


def union_sources(sources: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """All rows with their source; an id seen in an earlier source gets 'source:' before it.

    An id that clashes even then makes the job fail.
    """
    tagged = [df.withColumn("source", F.lit(name)).withColumn("__o", F.lit(i)) for i, (name, df) in enumerate(sources.items())]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = both.groupBy(key).agg(F.min("__o").alias("__first"))
    named = both.join(first, key).withColumn(key, F.when(F.col("__o") == F.col("__first"), F.col(key)).otherwise(F.concat_ws(":", "source", key)))
    return named.drop("__o", "__first")


def clashes(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def interleave(sources: dict[str, DataFrame], weights: dict[str, float], order: list[Column], *, stop: str = "first_exhausted") -> DataFrame:
    """Rows of all sources, a source's i-th at place i / weight; cut where the first source runs out, or not at all."""
    parts = []
    for name, df in sources.items():
        keyed = df.withColumns({f"order_{i}": c for i, c in enumerate(order)})
        ranked = global_row_number(keyed, [f"order_{i}" for i in range(len(order))])
        parts.append(ranked.withColumn("source", F.lit(name)).withColumn("place", (F.col("row_no") + 1) / F.lit(float(weights[name]))).drop("row_no", *(f"order_{i}" for i in range(len(order)))))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    if stop == "first_exhausted":
        ends = both.groupBy("source").agg(F.max("place").alias("end")).agg(F.min("end").alias("cut"))
        both = both.join(F.broadcast(ends), F.col("place") <= F.col("cut")).drop("cut")
    return both.orderBy("place", "source")


def repeat_rows(df: DataFrame, times: int, key: str, *, interleaved: bool = True) -> DataFrame:
    """Each row ``times`` times, copies next to each other or in whole rounds; adds copy_no from 0."""
    out = df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return out.orderBy(*((key, "copy_no") if interleaved else ("copy_no", key)))


def pad_to_multiple(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows in order with the first ones repeated until the count divides by n; adds padded."""
    missing = -df.count() % n
    rows = df.withColumn("padded", F.lit(False))
    copies = -(-missing // max(1, df.count())) if missing else 0
    extra = df.withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(max(1, copies))))).orderBy("__c", order).limit(missing).drop("__c")
    return rows.unionByName(extra.withColumn("padded", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.where("not padded").drop("padded")


def chunks(df: DataFrame, order: str, n: int) -> DataFrame:
    """Adds chunk (from 0): n contiguous parts of a batch, as equal as can be."""
    size, more = divmod(df.count(), n)  # the first ones have one row more
    row, ahead = F.col("row_no"), more * (size + 1)
    chunk = F.when(row < ahead, F.floor(row / (size + 1))).otherwise(more + F.floor((row - ahead) / max(1, size)))
    return global_row_number(df, [order]).withColumn("chunk", chunk.cast("int")).drop("row_no")


def collate(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One row a batch, each column an array in order."""
    rows = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("r"))
    return rows.select(batch, *(F.col("r").getField(c).alias(c) for c in columns))


def key_sets(a: DataFrame, b: DataFrame, key: str) -> dict[str, DataFrame]:
    """Distinct keys of both, of the first alone, and of either."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return {"both": x.intersect(y), "only_first": x.exceptAll(y), "either": x.union(y).distinct()}
