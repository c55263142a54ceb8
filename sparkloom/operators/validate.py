"""Validators: violation rows instead of exceptions, and reasons by first or all failed checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import is_private, unsafe_path


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails (is true); null if none does. A null check doesn't fail."""
    out = None
    for name, failed in checks:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out if out is not None else F.lit(None).cast("string")


def all_reasons(checks: list[tuple[str, Column]]) -> Column:
    """The names of all checks that fail, in order."""
    return F.filter(F.array(*(F.when(failed, F.lit(name)) for name, failed in checks)), lambda x: x.isNotNull())


def split_reasons(reasons: Column, hard: list[str], prefixes: list[str] | None = None) -> Column:
    """struct(hard, soft): each sorted and distinct; hard by name or prefix."""
    is_hard = lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in prefixes or []], x.isin(*hard))
    return F.struct(F.array_sort(F.array_distinct(F.filter(reasons, is_hard))).alias("hard"), F.array_sort(F.array_distinct(F.filter(reasons, lambda x: ~is_hard(x)))).alias("soft"))


def violations(df: DataFrame, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """(key, violation): one row for each check that a row fails."""
    return df.select(key, F.explode(all_reasons(checks)).alias("violation"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sft_checks(turns: Column) -> list[tuple[str, Column]]:
    roles = F.transform(turns, lambda t: t["from"])
    return [("too_few_turns", F.coalesce(F.size(turns) < 2, F.lit(True))), ("no_human", ~F.coalesce(F.array_contains(roles, "human"), F.lit(False))), ("no_gpt", ~F.coalesce(F.array_contains(roles, "gpt"), F.lit(False)))]


FAMILIES = ("choice", "numeric_mra", "multi_choice")


def opd_checks(df: DataFrame) -> list[tuple[str, Column]]:
    """Required columns, a parsable answer, a known family, exactly one video, and no trace text in the plain prompt."""
    required = ("prompt", "privileged_prompt", "answer", "source_id", "task_type", "trace_id")
    missing = [(f"missing_{c}", F.coalesce(F.trim(c) == "", F.lit(True))) for c in required]
    return [*missing, ("unparsable_answer", F.try_parse_json("answer").isNull()), ("unknown_family", ~F.coalesce(F.col("reward_family").isin(*FAMILIES), F.lit(False))), ("not_one_video", F.coalesce(F.size("videos") != 1, F.lit(True))), ("leaked_trace", F.col("prompt") == F.col("privileged_prompt"))]


def media_checks(paths: Column) -> list[tuple[str, Column]]:
    return [("no_media", F.coalesce(F.size(paths) == 0, F.lit(True))), ("unsafe_path", F.exists(paths, unsafe_path)), ("private_content", F.exists(paths, is_private))]


def option_checks(question: Column, options: Column, answer: Column, answer_text: Column) -> list[tuple[str, Column]]:
    """Four options A to D with distinct texts, none of them empty or 'none', and an answer that agrees with its text."""
    labels, texts = F.transform(options, lambda o: o["label"]), F.transform(options, lambda o: F.lower(F.trim(o["text"])))
    told = F.try_element_at(F.map_from_arrays(labels, F.transform(options, lambda o: o["text"])), answer)
    return [("empty_question", F.coalesce(F.trim(question) == "", F.lit(True))), ("not_four_options", F.coalesce(F.size(options) != 4, F.lit(True))), ("bad_labels", labels != F.array(*map(F.lit, "ABCD"))), ("duplicate_options", F.size(F.array_distinct(texts)) < 4), ("none_option", F.exists(texts, lambda t: t.isin("", "none", "none of the above"))), ("bad_answer", ~F.coalesce(answer.isin(*"ABCD"), F.lit(False))), ("answer_text_differs", ~told.eqNullSafe(answer_text))]


def candidate_spacing(distances: Column, bins: tuple[float, ...] = (5, 10, 15, 20), gap: float = 3.0) -> Column:
    """Four candidates, one near each bin, sorted neighbours at least ``gap`` apart."""
    s = F.array_sort(distances)
    near = F.zip_with(s, F.array(*(F.lit(float(b)) for b in bins)), lambda a, b: F.abs(a - b) <= 2.0)
    apart = F.zip_with(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: a - b >= gap)
    return (F.size(s) == len(bins)) & F.forall(near, lambda x: F.coalesce(x, F.lit(False))) & F.forall(apart, lambda x: F.coalesce(x, F.lit(False)))


def alternation_ok(roles: Column, odd: tuple[str, ...] = ("human", "observation"), even: tuple[str, ...] = ("gpt", "function")) -> Column:
    """Roles at odd places among ``odd``, at even ones among ``even``, and an even number of them."""
    flags = F.transform(roles, lambda r, i: F.when(i % 2 == 0, r.isin(*odd)).otherwise(r.isin(*even)))
    return (F.size(roles) % 2 == 0) & F.forall(flags, lambda x: F.coalesce(x, F.lit(False)))


def threshold_flags(df: DataFrame, thresholds: DataFrame, on: str, metrics: list[str]) -> DataFrame:
    """Adds ``flags``: the metrics that fall below their class's threshold (columns <metric>_min of ``thresholds``)."""
    joined = df.join(thresholds, on, "left")
    return joined.withColumn("flags", all_reasons([(f"low_{m}", F.col(m) < F.col(f"{m}_min")) for m in metrics])).drop(*(f"{m}_min" for m in metrics))


def expected_counts(actual: DataFrame, expected: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Reconciliation: (key, actual, expected) where they differ, a missing side null."""
    a, e = actual.select(key, F.col(n).alias("actual")), expected.select(key, F.col(n).alias("expected"))
    return a.join(e, key, "full_outer").where(~F.col("actual").eqNullSafe(F.col("expected")))


def split_leaks(df: DataFrame, split: str, key: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def mapping_breaks(df: DataFrame, a: str, b: str) -> DataFrame:
    """(side, value, n): values of either column that go with several of the other."""
    one = lambda x, y: df.groupBy(F.col(x).cast("string").alias("value")).agg(F.count_distinct(y).alias("n")).where("n > 1").select(F.lit(x).alias("side"), "value", "n")
    return one(a, b).union(one(b, a))


def fail_if_any(df: DataFrame, message: str) -> None:
    """Fail closed: raise with the first violations if there are any."""
    rows = df.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {rows}")


def valid_instruction(c: Column) -> Column:
    """A text of 3 to 200 characters with enough letters and no long run of consonants."""
    letters = F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.coalesce(F.length(F.trim(c)).between(3, 200) & (letters >= 3) & ~c.rlike(r"(?i)[bcdfghjklmnpqrstvwxz]{7,}"), F.lit(False))
