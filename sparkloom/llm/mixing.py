"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's target share sets the mean number of times that each of its
documents is to appear. Each document's own number is drawn from the Poisson
distribution of that mean by inverting it at a uniform value that a seed and
the document's id determine; the document is exploded by it, and all copies are
shuffled globally. No document needs to know of another, so the draw is the
same however the table is partitioned, and a lost task redraws the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to which their table of a few numbers each is broadcast; with more it is joined by a shuffle.
BROADCAST_SOURCES = 5_000
#: The largest mean that is inverted at once; a larger one is a sum of draws.
PART_MEAN = 200.0


def uniform(*key: Column) -> Column:
    """48 bits of a digest of the key, as a number from 0 to below 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the 48 bits of a draw can reach."""
    last = F.ceil(mean + 9 * F.sqrt(mean) + 20).cast("int")
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step)["cdf"]


def source_means(docs: DataFrame, source_col: str = "source", *, exponent: float = 0.5, scale: float = 1.0, weights: dict[str, float] | None = None) -> tuple[DataFrame, int]:
    """(of, mean): the sources and their means; and the number of sources.

    Target shares are ``weights`` (sources not named get none), or else in
    proportion to the sources' sizes to the power ``exponent``; the expected
    size of the mix is ``scale`` times the input's.
    """
    sizes = docs.groupBy(F.col(source_col).alias("of")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("of")), F.lit(0.0))
    else:
        share = F.pow("n", F.lit(float(exponent)))
    sizes = sizes.withColumn("share", share)
    total = sizes.agg(F.sum("n").alias("n"), F.sum("share").alias("share"), F.count(F.lit(1)).alias("sources")).first()
    factor = float(scale) * (total["n"] or 0.0) / (total["share"] or 1.0)
    return sizes.select("of", (F.lit(factor) * F.col("share") / F.col("n")).alias("mean")), total["sources"]


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", seed: int = 7, exponent: float = 0.5, scale: float = 1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """The mix: ``docs`` with copy_no (from 1) and mix_key, in the order of mix_key within random partitions.

    A null source is a source; a null id draws as the text 'null'. Rows with the
    same id draw the same number. Nulls in other columns and empty texts are
    carried along; an empty table gives an empty mix. Columns of ``docs`` named
    copy_no or mix_key are replaced.

    Two passes: sizes by source (combined before the shuffle), then one shuffle
    of the copies by a random key, so no source, however large, meets in a task.
    """
    means, n_sources = source_means(docs, source_col, exponent=exponent, scale=scale, weights=weights)
    parts = F.greatest(F.lit(1), F.ceil(F.col("mean") / PART_MEAN)).cast("int")
    means = means.withColumn("parts", parts).withColumn("cdf", _cdf(F.col("mean") / F.col("parts")))
    if n_sources <= BROADCAST_SOURCES:
        means = F.broadcast(means)
    columns = [c for c in docs.columns if c not in ("copy_no", "mix_key")]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(source_col).alias("source"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("key"))
    joined = rows.join(means, F.col("source").eqNullSafe(F.col("of")))
    draw = lambda j: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(str(seed)), F.col("key"), j.cast("string"))))
    one = joined.withColumn("u", uniform(F.lit(str(seed)), F.col("key"), F.lit("1")))
    single = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    several = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, j: acc + draw(j))
    counted = one.withColumn("times", F.when(F.col("parts") == 1, single).otherwise(several))
    kept = counted.where(F.col("times") > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("times"))))
    keyed = kept.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.col("key"), F.col("copy_no").cast("string")).cast("binary")))
    return keyed.select(*(F.col(f"row.`{c}`").alias(c) for c in columns), "copy_no", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")
