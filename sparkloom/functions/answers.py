"""Parsing of model answers and verifiable rewards, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of answers.
ANSWER = r"(?is)<answer>(.*?)</answer>"
COT = r"(?is)<COT>(.*?)</COT>"
NATIVE = r"(?is)\bAnswer\s*:\s*(.+)\z"
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
CHOICE = r"(?i)(?:answer|option|choice)\s*(?:is|:|=)\s*([A-E])\b"
LETTER = r"(?i)\b([A-E])\b"
FORMAT_WEIGHT = 0.1


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def choice_letter(c: Column) -> Column:
    """The letter that is the whole text, else the last announced one."""
    t = F.trim(c)
    return F.upper(F.when(t.rlike(r"(?i)\A[A-E]\z"), t).otherwise(F.try_element_at(F.regexp_extract_all(c, F.lit(CHOICE), F.lit(1)), F.lit(-1))))


def letter(c: Column) -> Column:
    """The letter that is the whole text, else the first that stands alone."""
    t = F.trim(c)
    return F.upper(F.when(t.rlike(r"(?i)\A[A-E]\z"), t).otherwise(F.nullif(F.regexp_extract(t, LETTER, 1), F.lit(""))))


def last_number(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1)).cast("double")


def answer_text(response: Column) -> Column:
    """What stands in answer tags, or after 'Answer:'; '' without either."""
    r = F.coalesce(response, F.lit(""))
    return F.when(r.rlike(ANSWER), F.trim(F.regexp_extract(r, ANSWER, 1))).otherwise(F.trim(F.regexp_extract(r, NATIVE, 1)))


def json_map(c: Column) -> Column:
    """A JSON object's top-level fields as text; null if it isn't one."""
    return F.when(F.trim(c).rlike(r"(?s)\A\{.*\}\z") & F.try_parse_json(c).isNotNull(), F.from_json(c, "map<string,string>"))


def json_block(c: Column) -> Column:
    """The outermost {...} of a text, if it parses."""
    block = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(block).isNotNull(), block)


def canonical_json(c: Column) -> Column:
    """A JSON object with its keys sorted at every depth, values and their types as they are; other texts as they are."""
    return F.coalesce(F.when(F.trim(c).startswith("{"), F.to_json(F.try_parse_json(c))), c)


def prediction(response: Column) -> Column:
    """map<string,string> with choice, value or the fields of a JSON answer: tags, native form, legacy forms."""
    text = answer_text(response)
    one = lambda k, v: F.when(v.isNotNull(), F.create_map(F.lit(k), v.cast("string")))
    bare = F.trim(F.regexp_replace(F.coalesce(response, F.lit("")), COT, ""))
    whole = lambda t: F.when(t.rlike(r"(?i)\A[A-E]\z"), F.upper(t))
    tail = _some(F.regexp_extract(bare, r"(?is)\banswer\s*:\s*(.+)\z", 1))
    legacy_value = _some(F.regexp_extract(bare, rf'(?i)"?(?:answer|distance|displacement|value)"?\s*(?:is|:|=)\s*({NUMBER})', 1))
    legacy = F.coalesce(
        one("choice", whole(bare)),
        one("choice", F.upper(_some(F.regexp_extract(bare, CHOICE, 1)))),
        json_map(_some(F.regexp_extract(bare, r"(?is)(\{[^{}]*\})", 1))),
        one("value", last_number(tail)),
        one("value", legacy_value.cast("double")),
    )
    fields = F.regexp_extract_all(text, F.lit(r'(?i)"?(?:choice|straight|angle|path)"?\s*:\s*"?[A-E]\b'), F.lit(0))
    entries = F.transform(fields, lambda m: F.struct(F.lower(F.regexp_extract(m, r"([A-Za-z]+)", 1)).alias("key"), F.upper(F.regexp_extract(m, r'(?i):\s*"?([A-E])', 1)).alias("value")))
    lasting = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    loose_value = _some(F.regexp_extract(text, rf'(?i)"?(?:value|value_m|distance_m)"?\s*:\s*({NUMBER})', 1))
    loose = F.coalesce(one("value", F.when(F.size(entries) == 0, loose_value)), F.map_from_entries(lasting))
    tagged = F.coalesce(json_map(text), one("choice", whole(text)), one("value", F.when(text.rlike(rf"\A{NUMBER}\z"), text)), loose)
    return F.coalesce(F.when(text == "", legacy).otherwise(tagged), F.create_map().cast("map<string,string>"))


def number_of(fields: Column) -> Column:
    """The first of value, value_m, distance_m, answer that is a number; null if that is not finite."""
    found = F.coalesce(*(F.try_element_at(fields, F.lit(k)).try_cast("double") for k in ("value", "value_m", "distance_m", "answer")))
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


TRUTH = "reward_family string, value string, choice_gold string, fields map<string,string>"


def with_score(df: DataFrame, response: str, truth: str, out: str = "score") -> DataFrame:
    """Adds struct(overall, task, format, cot_format, answer_format) of a response, given the truth as JSON text.

    Choices score by equal letters, numbers by relative accuracy, several
    choices by the share of equal fields; null equals null there. The steps are
    columns of their own, so that each is worked out once.
    """
    r = F.coalesce(F.col(response), F.lit(""))
    steps = df.withColumn("__t", F.from_json(truth, TRUTH)).withColumn("__text", answer_text(r)).withColumn("__said", prediction(r))
    t, text, said = F.col("__t"), F.col("__text"), F.col("__said")
    steps = steps.withColumn("__family", F.lower(F.coalesce(_some(t["reward_family"]), F.lit("choice")))).withColumn("__fields", F.coalesce(t["fields"], F.create_map().cast("map<string,string>"))).withColumn("__parsed", json_map(text)).withColumn("__value", number_of(said)).withColumn("__gold", t["value"].try_cast("double"))
    family, fields, parsed, value, gold = (F.col(c) for c in ("__family", "__fields", "__parsed", "__value", "__gold"))
    numeric = F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.abs(value - gold) / F.greatest(F.abs(gold), F.lit(1e-6))), F.lit(0.0))
    same = F.filter(F.map_entries(fields), lambda e: letter(F.try_element_at(said, e["key"])).eqNullSafe(letter(e["value"])))
    several = F.size(same) / F.greatest(F.size(F.map_entries(fields)), F.lit(1))
    want = letter(F.coalesce(_some(t["choice_gold"]), t["value"]))
    got = letter(F.coalesce(_some(F.try_element_at(said, F.lit("choice"))), F.try_element_at(said, F.lit("answer"))))
    task = F.when(family == "numeric_mra", numeric).when(family == "multi_choice", several).otherwise(F.coalesce((want == got).cast("double"), F.lit(0.0)))
    before = F.trim(F.regexp_replace(r, r"(?is)\bAnswer\s*:\s*.+\z", ""))
    reasoned = (F.trim(F.regexp_extract(r, COT, 1)) != "") | (r.rlike(NATIVE) & (before != ""))
    in_json = F.when(family == "multi_choice", F.forall(F.map_keys(fields), lambda k: F.array_contains(F.map_keys(parsed), k))).when(family == "numeric_mra", number_of(parsed).isNotNull()).otherwise(letter(F.coalesce(_some(F.try_element_at(parsed, F.lit("choice"))), F.try_element_at(parsed, F.lit("answer")))).isNotNull())
    plain = F.when(family == "numeric_mra", text.rlike(rf"\A{NUMBER}\z")).otherwise(text.rlike(r"(?i)\A[A-E]\z"))
    shaped = F.when(text == "", False).when(parsed.isNotNull(), in_json).otherwise(plain)
    steps = steps.withColumn("__task", task).withColumn("__cot", reasoned.cast("double")).withColumn("__answer", F.coalesce(shaped, F.lit(False)).cast("double"))
    overall = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - FORMAT_WEIGHT) * F.col("__task") + FORMAT_WEIGHT * F.col("__cot") * F.col("__answer")))
    made = F.struct(overall.alias("overall"), F.col("__task").alias("task"), (F.col("__cot") * F.col("__answer")).alias("format"), F.col("__cot").alias("cot_format"), F.col("__answer").alias("answer_format"))
    return steps.withColumn(out, made).select(*df.columns, out)


def reward_target(metadata: Column, answer: Column) -> Column:
    """The truth as JSON: fields of several choices, else a number, else the letter of the answer; null if none fits."""
    get = lambda k: F.get_json_object(metadata, f"$.{k}")
    fields = F.from_json(F.coalesce(get("correct_options"), get("gt.correct_options")), "map<string,string>")
    several = F.when(F.size(fields) > 0, F.to_json(F.struct(F.lit("multi_choice").alias("reward_family"), F.transform_values(fields, lambda _, v: F.upper(v)).alias("fields"))))
    value = F.coalesce(*(get(k).try_cast("double") for k in ("original_value_m", "value_m", "target_value", "value")))
    number = F.when(value.isNotNull(), F.to_json(F.struct(F.lit("numeric_mra").alias("reward_family"), value.alias("value"), F.lit("m").alias("unit"))))
    said = choice_letter(answer)
    one = F.when(said.isNotNull(), F.to_json(F.struct(F.lit("choice").alias("reward_family"), said.alias("choice_gold"))))
    explicit = F.when(F.get_json_object(metadata, "$.reward_spec.reward_family").isNotNull(), get("reward_spec"))
    return F.coalesce(explicit, several, number, one)
