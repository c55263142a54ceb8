"""Counts, ratios, distributions and similarity metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multi_grain_counts(df: DataFrame, sets: list[list[str]], out: str = "n") -> DataFrame:
    """Counts at several grains in one pass; columns outside a grain are null, ``grain`` names it."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    counts = df.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias(out), F.grouping_id(*keys).alias("__g"))
    label = F.lit(None).cast("string")
    for s in sets:
        mask = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        label = F.when(F.col("__g") == mask, ":".join(s) or "all").otherwise(label)
    return counts.select(label.alias("grain"), *keys, out)


def decision_counts(df: DataFrame, group: str, decision: str, values: list[str]) -> DataFrame:
    """Per group a count for each decision, the total, and the first decision's share."""
    counts = [F.count_if(F.col(decision) == v).alias(f"n_{v}") for v in values]
    out = df.groupBy(group).agg(*counts, F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("keep_ratio", F.try_divide(F.col(f"n_{values[0]}").cast("double"), F.col("n_total").cast("double")))


def collapse_references(df: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """Per key the sorted distinct values of some columns and the number of rows."""
    return df.groupBy(key).agg(*(F.sort_array(F.collect_set(c)).alias(f"{c}_set") for c in sets), F.count(F.lit(1)).alias("n_refs"))


def membership_counts(df: DataFrame, values: str) -> DataFrame:
    """Counts of the elements of a set column, most common first."""
    return df.select(F.explode(values).alias("value")).groupBy("value").count().orderBy(F.desc("count"), "value")


def reason_histogram(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def first_mode(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Each group's most common value, the one seen first among equals."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"))


def masked_mean(values: Column, mask: Column) -> Column:
    """Of an array, over the places where the mask is not 0; 0 without any."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))


def whiten(df: DataFrame, value: str, valid: Column, out: str, eps: float = 1e-8) -> DataFrame:
    """(x - mean) / sqrt(var + eps) over the valid rows, with Bessel's correction; deviations are summed about the mean, so large means don't cancel."""
    x, n = F.col(value).cast("double"), F.count(F.lit(1)).cast("double")
    mean = F.avg(x) * n / (n + eps)
    stats = df.where(valid).agg(mean.alias("mean_"), F.var_samp(x).alias("var_"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, (x - F.col("mean_")) / F.sqrt(F.col("var_") + eps)).drop("mean_", "var_")


def answer_profile(df: DataFrame, answer: str, number: Column) -> DataFrame:
    """One row: the most common answer (the first by name among equals) and its share, shares of distinct and of missing answers, quantiles of the numbers."""
    counts = df.groupBy(answer).agg(F.count(F.lit(1)).alias("n"))
    given = F.col(answer).isNotNull()
    modes = counts.agg(F.sum("n").alias("rows"), F.min_by(F.when(given, F.col(answer)), F.struct(~given, -F.col("n"), F.col(answer))).alias("mode"), F.max(F.when(given, F.col("n"))).alias("most"), F.count(answer).alias("unique"), F.coalesce(F.sum(F.when(~given, F.col("n"))), F.lit(0)).alias("missing"))
    numbers = df.agg(*(F.percentile_approx(number, q, 10_000).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.9)))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("rows"))
    return modes.select("mode", share("most").alias("mode_fraction"), share("unique").alias("unique_fraction"), share("missing").alias("missing_fraction")).crossJoin(F.broadcast(numbers))


def audit_scalars(df: DataFrame, reward: str, length: str, fmt: str | None = None) -> DataFrame:
    """One row: spread, quantiles, shares of zero and perfect rewards, and correlation with length (0 without spread)."""
    r, n = F.col(reward).cast("double"), F.col(length).cast("double")
    spread = (F.stddev_pop(r) > 0) & (F.stddev_pop(n) > 0)
    extra = [F.avg(((r <= 0.1 + 1e-9) & (F.col(fmt) > 0)).cast("double")).alias("format_only_fraction")] if fmt else []
    return df.agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), *(F.percentile(r, q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)), F.avg((r <= 0).cast("double")).alias("zero_fraction"), F.avg((r >= 1).cast("double")).alias("perfect_fraction"), F.when(spread, F.corr(r, n)).otherwise(0.0).alias("length_correlation"), *extra)


def answer_entropy(df: DataFrame, group: str, answer: str, reward: str) -> DataFrame:
    """Per group: size, unique fraction, normalised entropy of answers, and flags of collapse and of no signal."""
    counts = df.groupBy(group, answer).agg(F.count(F.lit(1)).alias("c"), F.min(reward).alias("lo"), F.max(reward).alias("hi"))
    c = F.col("c").cast("double")
    w = counts.groupBy(group).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("unique"), F.sum(c * F.ln(c)).alias("clnc"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    n = F.col("n").cast("double")  # the sum of -p ln p is ln n less the mean of ln c
    entropy = F.greatest(F.ln(n) - F.col("clnc") / n, F.lit(0.0)) / F.ln(F.greatest(n, F.lit(2.0)))
    return w.select(group, "n", (F.col("unique") / F.col("n").cast("double")).alias("unique_fraction"), entropy.alias("entropy"), ((F.col("unique") == 1) & (F.col("n") > 1)).alias("collapsed"), (F.col("hi") == F.col("lo")).alias("no_signal"))


def length_metrics(df: DataFrame, length: str, most: int) -> DataFrame:
    n = F.col(length)
    return df.agg(F.avg(n).alias("mean"), F.max(n).alias("max"), F.min(n).alias("min"), F.avg((n >= most).cast("double")).alias("clip_ratio"))


def explained_variance(df: DataFrame, value: str, target: str) -> DataFrame:
    v, t = F.col(value).cast("double"), F.col(target).cast("double")
    return df.agg((1.0 - F.try_divide(F.var_samp(t - v), F.var_samp(t) + 1e-5)).alias("explained_variance"))


def category_accuracy(df: DataFrame, category: str, correct: Column) -> DataFrame:
    """Accuracy in percent by category, and 'Average' over all rows."""
    return df.rollup(category).agg((F.avg(correct.cast("double")) * 100).alias("accuracy"), F.grouping(category).alias("__g")).select(F.when(F.col("__g") == 1, "Average").otherwise(F.col(category)).alias(category), "accuracy")


def token_accuracy(predicted: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of equal tokens where the label is not ignored; null without any."""
    hits = F.filter(F.zip_with(predicted, labels, lambda p, y: F.when(y != ignore, (p == y).cast("double"))), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(hits, F.lit(0.0), lambda a, x: a + x), F.size(hits).cast("double"))


def imbalance(df: DataFrame, partition: str, length: str) -> DataFrame:
    """Smallest and largest sum of a partition, their difference, and the mean."""
    sums = df.groupBy(partition).agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("spread"), F.avg("s").alias("mean"))


def throughput(df: DataFrame, tokens: str, seconds: str, devices: int) -> DataFrame:
    total = F.sum(tokens)
    return df.agg(total.alias("tokens"), F.sum(seconds).alias("seconds"), F.try_divide(total.cast("double"), F.sum(seconds) * devices).alias("tokens_per_second_device"))


def similarity(df: DataFrame, predicted: str, reference: str) -> DataFrame:
    """Adds rouge_1, rouge_2, rouge_l (F scores of word sequences) and bleu_4 (of characters), in percent. Arrow-batched: it needs alignments.

    Precisions without a hit are smoothed by halving: 1 / (2 size), 1 / (4 size)
    and so on; without a common character bleu_4 is 0.
    """
    import math
    from collections import Counter
    from collections.abc import Iterator

    def grams(w: list[str], n: int) -> Counter:
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    def f_score(hit: float, a: float, b: float) -> float:
        return 200.0 * hit / (a + b) if a + b else 0.0

    def common_length(a: list[str], b: list[str]) -> int:
        # bit-parallel: a zero of ``open_`` is a word of a at which the common subsequence grows
        where: dict[str, int] = {}
        for i, x in enumerate(a):
            where[x] = where.get(x, 0) | 1 << i
        every = (1 << len(a)) - 1
        open_ = every
        for y in b:
            u = open_ & where.get(y, 0)
            open_ = (open_ + u | open_ - u) & every
        return len(a) - open_.bit_count()

    def character_bleu(p: str, r: str) -> float:
        logs, missed = [], 0
        for n in range(1, 5):
            hit = sum((grams(list(p), n) & grams(list(r), n)).values())
            if not hit and n == 1:
                return 0.0
            missed += not hit
            logs.append(math.log((hit or 0.5**missed) / max(1, len(p) - n + 1)))
        return math.exp(sum(logs) / 4) * (1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p)))

    def one(p: str, r: str) -> tuple:
        a, b = (p or "").split(), (r or "").split()
        hits = [sum((grams(a, n) & grams(b, n)).values()) for n in (1, 2)]
        sizes = [(max(0, len(a) - n + 1), max(0, len(b) - n + 1)) for n in (1, 2)]
        bleu = 100 * character_bleu(p or "", r or "")
        return f_score(hits[0], *sizes[0]), f_score(hits[1], *sizes[1]), f_score(common_length(a, b), len(a), len(b)), bleu

    names = ["rouge_1", "rouge_2", "rouge_l", "bleu_4"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(p, r) for p, r in zip(batch[predicted], batch[reference], strict=True)]
            yield pd.concat([batch, pd.DataFrame(found, columns=names, index=batch.index, dtype=float)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} double" for n in names)])
    return df.mapInPandas(run, schema)
