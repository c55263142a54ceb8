"""Question rows: dispatch by task, templates, options, drop rules, and builders from measured windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import options_with_answer, stable_pick
from sparkloom.functions.text import normalize_name, quoted_names
from sparkloom.operators.trajectory import turn_fraction
from sparkloom.operators.validate import first_reason


def dispatch(task: Column, forms: dict[str, Column], default: Column | None = None) -> Column:
    """The form of a row's task: one branch for each, null or ``default`` for others."""
    out = None
    for name, form in forms.items():
        out = F.when(task == name, form) if out is None else out.when(task == name, form)
    return out if out is None or default is None else out.otherwise(default)


def standardize(df: DataFrame, questions: dict[str, Column], answers: dict[str, Column], task: str = "task_type") -> DataFrame:
    """Adds question and answer by the task's formatters; rows of other tasks are dropped."""
    t = F.col(task)
    return df.withColumn("question", dispatch(t, questions)).withColumn("answer", dispatch(t, answers)).where("question is not null and answer is not null")


def augment(df: DataFrame, key: str, variants: dict[str, list[str]], rubric: dict[str, str], task: str = "task_type") -> DataFrame:
    """Adds question_variant (a template of the task picked by the row's hash, {q} standing for the question) and rubric."""
    pick = dispatch(F.col(task), {k: stable_pick(F.array(*map(F.lit, v)), F.col(key)) for k, v in variants.items()}, F.lit("{q}"))
    return df.withColumn("question_variant", F.replace(pick, F.lit("{q}"), F.col("question"))).withColumn("rubric", dispatch(F.col(task), {k: F.lit(v) for k, v in rubric.items()}))


def build_questions(df: DataFrame, key: list[str], specs: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """One row for each (task, question, correct text, distractors) that a row can serve (all non-null): options shuffled by the row's key."""
    each = F.array(*(F.struct(F.lit(t).alias("task_type"), q.alias("question"), c.alias("correct"), d.alias("distractors")) for t, q, c, d in specs))
    rows = df.select(*key, F.explode(each).alias("x")).select(*key, "x.*").where("question is not null and correct is not null")
    made = rows.withColumn("__o", options_with_answer(F.col("correct"), F.col("distractors"), *map(F.col, key), F.col("task_type")))
    return made.select(*key, "task_type", "question", F.col("__o.options").alias("options"), F.col("__o.answer").alias("answer"), F.col("correct").alias("answer_text"))


def drop_rule_checks(question: Column, bad_names: list[str]) -> list[tuple[str, Column]]:
    """Curation rules over quoted names: none bad, none twice once normalised."""
    names = F.transform(quoted_names(question), lambda n: normalize_name(n))
    return [("bad_name", F.exists(names, lambda n: n.isin(*bad_names))), ("duplicate_name", F.size(F.array_distinct(names)) < F.size(names))]


def with_drop_reason(df: DataFrame, question: str, bad_names: list[str]) -> DataFrame:
    return df.withColumn("reason", first_reason(drop_rule_checks(F.col(question), bad_names)))


def main_turn_rows(df: DataFrame, turns: str, margin: float) -> DataFrame:
    """Adds quarter and reason: where the turning happens, unless it has none or lies within ``margin`` of a border."""
    t = df.withColumn("__f", turn_fraction(F.col(turns)))
    f = F.col("__f.fraction") * 4
    near = F.abs(f - F.round(f)) / 4 < margin
    inner = near & F.round(f).between(1, 3)
    reason = F.when(F.col("__f").isNull(), "no_turn").when(inner, "near_border")
    return t.withColumn("reason", reason).withColumn("quarter", F.when(reason.isNull(), F.col("__f.quarter"))).drop("__f")


def revisit_rows(pairs: DataFrame, slots: DataFrame, scene: str, slot: str, x: str, y: str, *, least_distance: float = 1.5, n: int = 3) -> DataFrame:
    """Per scene its clearest revisit (i, j) and up to ``n`` slots far from i as distractors, nearest slot numbers first."""
    best = pairs.groupBy(scene).agg(F.min_by(F.struct("i", "j"), F.struct("distance", "i", "j")).alias("b")).select(scene, "b.i", "b.j")
    at = slots.select(scene, F.col(slot).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    far = best.join(at, [scene, "i"]).join(slots.select(scene, F.col(slot).alias("s"), F.col(x).alias("xs"), F.col(y).alias("ys")), scene).where(F.hypot(F.col("xi") - F.col("xs"), F.col("yi") - F.col("ys")) >= least_distance)
    picked = far.groupBy(scene, "i", "j").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.abs(F.col("s") - F.col("j")).alias("d"), "s"))), 1, n).alias("o"))
    return picked.select(scene, "i", "j", F.col("o.s").alias("others"))


def fraction_windows(df: DataFrame, start: str, end: str, fractions: list[tuple[float, float]]) -> DataFrame:
    """One row for each part of a segment: from and to, as slots at given fractions of it."""
    length = F.col(end) - F.col(start)
    each = F.array(*(F.struct((F.col(start) + F.bround(length * a)).cast("long").alias("from"), (F.col(start) + F.bround(length * b)).cast("long").alias("to")) for a, b in fractions))
    return df.withColumn("__w", F.explode(each)).select(*df.columns, "__w.*")
