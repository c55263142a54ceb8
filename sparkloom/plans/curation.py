"""The curation plan: normalise, level, deduplicate, validate, sample, split, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import collapse_spaces
from sparkloom.operators import aggregate, normalize, select, validate
from sparkloom.tables import written

LEVELS = {"en": "l1", "de": "l2", "fr": "l2", "es": "l3"}


def select_corpus(docs: DataFrame, labels: DataFrame, *, seed: int = 20, share: int = 2, val_fraction: float = 0.05) -> DataFrame:
    """(doc_id, lang, source, n_chars, level, split): one document of each text, none that is labelled toxic or short,
    1/share of them in proportion to the levels."""
    level = normalize.curriculum_level(F.when(F.col("n_chars") > 20000, "l3"), F.col("lang"), LEVELS)
    digest = F.md5(collapse_spaces(F.col("text")).cast("binary"))
    narrow = docs.where("text is not null").select("doc_id", "lang", "source", "n_chars", digest.alias("digest"), level.alias("level"))
    unique = select.first_by(narrow, ["digest"], ["doc_id"])
    reasons = validate.first_reason([("toxic", F.col("toxic") == 1), ("short", F.col("n_chars") < 100)])
    kept = unique.join(labels, "doc_id", "left").withColumn("reason", reasons).where("reason is null").drop("reason", "quality", "toxic", "digest")
    kept = written(kept, "kept")  # a few narrow columns; three passes follow
    limit = kept.count() // share
    sample = select.stratified_sample(kept, "level", "doc_id", limit, seed)
    return select.hash_split(sample, F.concat_ws(":", "source", "doc_id"), seed, val_fraction)


def curate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of the selected corpus by level and split, and by language."""
    return aggregate.multi_grain_counts(select_corpus(docs, labels), [["level", "split"], ["level", "split", "lang"]])
