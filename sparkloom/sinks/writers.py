"""Writers: JSON lines, fan-outs, size-bounded shards, append-and-skip, manifests and summaries."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.select import size_shards


def write_jsonl(df: DataFrame, path: str, *, gzip: bool = False, mode: str = "errorifexists") -> None:
    """Compact JSON lines; gzip bodies carry no time stamp."""
    df.write.mode(mode).option("ignoreNullFields", "false").option("compression", "gzip" if gzip else "none").json(path)


def write_by(df: DataFrame, path: str, *keys: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One pass, one folder for each value of the keys (levels, splits, decisions)."""
    df.write.mode(mode).partitionBy(*keys).format(fmt).save(path)


def write_shards(df: DataFrame, path: str, size: Column, limit: int, order: list[str], *, group: list[str] | None = None) -> None:
    """zstd Parquet shards of at most ``limit`` bytes (a larger row alone), numbered in order; the committer makes each appear whole."""
    dealt = size_shards(df, size, limit, order, group=group)
    dealt.repartition("shard").sortWithinPartitions("shard", *order).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def _content(df: DataFrame, names: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(names))), {"ignoreNullFields": "false"}), 256)


def resume_shards(df: DataFrame, path: str, key: str, size: Column, limit: int, order: list[str]) -> int:
    """Append what an earlier run has not written; fails if its rows are not the first ones of ``df``, content and all. Returns rows added."""
    spark = df.sparkSession
    done = spark.read.parquet(path)
    if not set(df.columns) <= set(done.columns):
        raise ValueError("written shards have other columns")
    before = done.select(key, _content(done.select(*(F.col(c).cast(df.schema[c].dataType) for c in df.columns)), df.columns).alias("was_"))
    now = df.select(key, F.struct(*order).alias("order_"), _content(df, df.columns).alias("is_"))
    both = now.join(before, key, "full_outer")
    last = both.where("was_ is not null and is_ is not null").agg(F.max("order_").alias("m")).first()["m"]
    odd = F.col("is_").isNull() | (F.col("was_").isNotNull() & (F.col("was_") != F.col("is_")))
    if last is not None:
        odd |= F.col("was_").isNull() & (F.col("order_") < F.struct(*(F.lit(last[c]) for c in order)))
    if not both.where(odd).isEmpty():
        raise ValueError("written shards are not a prefix of the input")
    rest = df.join(done.select(key), key, "left_anti")
    n = rest.count()
    if n:
        first = done.agg(F.max("shard")).first()[0] + 1
        dealt = size_shards(rest, size, limit, order).withColumn("shard", F.col("shard") + first)
        dealt.repartition("shard").write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(path)
    return n


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key is not there yet; the number of rows added. Safe to repeat."""
    done = df.sparkSession.read.parquet(path).select(key).distinct()
    rest = df.dropDuplicates([key]).join(done, key, "left_anti").persist()
    n = rest.count()
    rest.write.mode("append").parquet(path)
    rest.unpersist()
    return n


def file_manifest(df: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, bytes, sha256) of files read as rows of bytes."""
    return df.select(path, F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def tar_shards(files: DataFrame, name: str, content: str, limit: int) -> DataFrame:
    """(shard, tar binary, members, sha256): files packed into tar archives of at most ``limit`` bytes of content, by name."""
    dealt = size_shards(files, F.octet_length(content).cast("long"), limit, [name])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        out, group = io.BytesIO(), group.sort_values(name)
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for n, c in zip(group[name], group[content], strict=True):
                info = tarfile.TarInfo(n)
                info.size = len(c)
                tar.addfile(info, io.BytesIO(c))
        body = out.getvalue()
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "tar": [body], "members": [len(group)], "sha256": [hashlib.sha256(body).hexdigest()]})

    return dealt.select("shard", name, content).groupBy("shard").applyInPandas(pack, "shard long, tar binary, members long, sha256 string")


def asset_outputs(df: DataFrame) -> dict[str, DataFrame]:
    """The four forms of an asset: all, data only, prompt pairs and a summary."""
    pair = df.select("id", F.struct(F.col("question").alias("q"), F.col("answer").alias("a")).alias("qa"), F.concat_ws("\n", "question", F.array_join("options", "\n")).alias("prompt"))
    return {"all": df, "data": df.drop("metadata"), "pairs": pair, "summary": summary(df, ["task_type"])}


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, and for each key a JSON object of counts."""
    sets = [[k] for k in keys]
    counts = df.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*keys).alias("g"))
    parts = [F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("g") == _set_id(i, len(keys)), F.struct(F.coalesce(F.col(k).cast("string"), F.lit("null")).alias("key"), F.col("n").alias("value"))))))).alias(k) for i, k in enumerate(keys)]
    return counts.agg((F.sum(F.when(F.col("g") == _set_id(0, len(keys)), F.col("n")))).alias("rows"), *parts)


def _set_id(i: int, n: int) -> int:
    """grouping_id of the set that has only the i-th of n keys."""
    return (1 << n) - 1 - (1 << (n - 1 - i))


def write_registry(path: str, entries: dict[str, dict]) -> None:
    """A dataset registry as JSON on a path the driver can open."""
    with open(path, "w") as f:
        json.dump(entries, f, indent=2, sort_keys=True)


def html_cards(df: DataFrame, columns: list[str]) -> DataFrame:
    """One column, value: each row as an HTML card, for reading by people."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = [F.concat(F.lit(f"<p><b>{c}</b> "), safe(c), F.lit("</p>")) for c in columns]
    return df.select(F.concat(F.lit("<div class=card>"), *lines, F.lit("</div>")).alias("value"))


def write_html(df: DataFrame, path: str, title: str, columns: list[str], order: list[str]) -> None:
    """A report of all rows in order, as a folder of HTML files, each a page of its own."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [f"<html><head><title>{title}</title></head><body><h1>{title}</h1>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</body></html>"]})

    html_cards(ranged, columns).mapInPandas(pages, "value string").write.text(path)


def take_skip(df: DataFrame, key: Column, n: int, of: int) -> tuple[DataFrame, DataFrame]:
    """(taken, rest) of a stream or table: rows whose key's hash falls on the first ``n`` of ``of`` places, and the others."""
    place = F.pmod(F.xxhash64(key), F.lit(of))
    return df.where(place < n), df.where(place >= n)
