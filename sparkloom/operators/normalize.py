"""Conversation, task, media and release normalisation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import PRIVATE, first_nonempty, lookup, portable_path

# Role names and the classes that ids encode.
ROLES = {"user": "human", "assistant": "gpt"}
KNOWN_ROLES = ("human", "gpt", "system")


def normalize_turns(turns: Column) -> Column:
    """array<struct<from,value>> from turns with from|role and value|content: roles renamed, unknown roles and null texts dropped."""
    def pick(t: Column, *names: str) -> Column:
        return F.coalesce(*(t[n] for n in names))

    role = lambda t: lookup(F.lower(pick(t, "from", "role")), ROLES)
    each = F.transform(turns, lambda t: F.struct(role(t).alias("from"), pick(t, "value", "content").alias("value")))
    return F.filter(each, lambda t: t["from"].isin(*KNOWN_ROLES) & t["value"].isNotNull())


def has_both_roles(turns: Column) -> Column:
    roles = F.transform(turns, lambda t: t["from"])
    return F.array_contains(roles, "human") & F.array_contains(roles, "gpt")


def collect_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: turns in order as array<struct<from,value>>, roles renamed."""
    named = lookup(F.lower(F.col(role)), ROLES)
    rows = df.withColumn("__t", F.struct(F.col(turn).alias("turn"), named.alias("from"), F.col(text).alias("value")))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("__t")), lambda t: F.struct(t["from"], t["value"])).alias("turns"))


def task_type(*sources: Column, default: str = "unknown") -> Column:
    """The first source that is not empty."""
    return F.coalesce(F.nullif(first_nonempty(*sources), F.lit("")), F.lit(default))


def source_name(c: Column, names: dict[str, str], prefixes: dict[str, str] | None = None) -> Column:
    """Display name of a source: exact entries first, then by prefix."""
    exact = lookup(c, names)
    out = exact
    for prefix, name in (prefixes or {}).items():
        out = F.when((exact == c) & c.startswith(prefix), name).otherwise(out)
    return out


def infer_task(row_id: Column, tasks: list[str], classes: dict[int, str] | None = None) -> Column:
    """The longest task name that the id contains, else the task of its classNN part; '' without either."""
    low = F.lower(row_id)
    names = F.array(*(F.lit(t) for t in sorted(tasks, key=len, reverse=True)))
    hit = F.try_element_at(F.filter(names, lambda t: F.contains(low, F.lower(t))), F.lit(1))
    number = F.nullif(F.regexp_extract(low, r"(?:^|__)class(\d{1,2})(?:__|$)", 1), F.lit("")).cast("int")
    pairs = [x for k, v in (classes or {0: ""}).items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(hit, F.try_element_at(F.create_map(*pairs), number), F.lit(""))


def curriculum_level(explicit: Column, task: Column, levels: dict[str, str]) -> Column:
    """An explicit level, else the one the task maps to; null if neither is known."""
    pairs = [F.lit(x) for kv in levels.items() for x in kv]
    return F.coalesce(F.lower(F.nullif(F.trim(explicit), F.lit(""))), F.try_element_at(F.create_map(*pairs), task))


def unify_media(images: Column, videos: Column, media: Column | None = None) -> Column:
    """struct(paths, type, ok): ok where exactly one kind is there."""
    empty = F.array().cast("array<string>")
    i, v = F.coalesce(images, empty), F.coalesce(videos, empty)
    given = empty if media is None else F.coalesce(media, empty)
    kind = F.when((F.size(i) > 0) & (F.size(v) == 0), "image").when((F.size(v) > 0) & (F.size(i) == 0), "video")
    paths = F.when(F.size(i) + F.size(v) > 0, F.concat(i, v)).otherwise(given)
    return F.struct(paths.alias("paths"), kind.alias("type"), ((F.size(i) > 0) != (F.size(v) > 0)).alias("ok"))


def release_rows(df: DataFrame, *, root: str = "/data", full: bool = False) -> DataFrame:
    """Release form of QA rows (id, conversations, images, videos, metadata JSON): portable paths, compact metadata.

    ``full`` adds metadata_json; a row that has it already keeps it, so the form is idempotent.
    """
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    media = unify_media(F.col("images"), F.col("videos"), F.col("media_paths") if "media_paths" in df.columns else None)
    meta = F.struct(get("curriculum_level").alias("curriculum_level"), get("task_type").alias("task_type"), first_nonempty(get("source"), get("dataset")).alias("source"), get("scene").alias("scene"), F.coalesce(get("used_in_reported_sft").try_cast("boolean"), F.lit(False)).alias("used_in_reported_sft"))
    out = df.withColumn("__m", media).select("id", "conversations", meta.alias("compact"), F.transform("__m.paths", lambda p: portable_path(p, root)).alias("media_paths"), F.coalesce(F.col("__m.type"), F.lit("none")).alias("media_type"), *(["metadata_json"] if full and "metadata_json" in df.columns else [F.col("metadata").alias("metadata_json")] if full else []))
    return out.withColumnRenamed("compact", "metadata")


def opd_rows(df: DataFrame, clause: Column, instruction: str) -> DataFrame:
    """prompt and privileged_prompt of rows with question and trace text: the tag is replaced once, at the front."""
    prompt = F.concat_ws("\n", F.col("question"), clause)
    hint = F.concat(F.lit("<video>\n"), F.lit(instruction), F.lit("\n"), F.col("trace_text"))
    return df.withColumn("prompt", prompt).withColumn("privileged_prompt", F.when(prompt.startswith("<video>"), F.concat(hint, F.substring(prompt, F.lit(len("<video>") + 1), F.length(prompt)))).otherwise(F.concat(hint, F.lit("\n"), prompt)))


def strip_private_columns(df: DataFrame) -> DataFrame:
    """Without columns whose names begin with an underscore."""
    return df.select(*(c for c in df.columns if not c.startswith("_")))


def redact_json(df: DataFrame, column: str, pattern: str = PRIVATE, replace_root: tuple[str, str] | None = None) -> DataFrame:
    """JSON texts without the string values that match ``pattern``, at any depth; paths below a root rewritten first.

    Free-form nesting has no expression; Arrow-batched.
    """
    found = re.compile(pattern)

    def clean(v):
        if isinstance(v, dict):
            return {k: w for k, x in v.items() if (w := clean(x)) is not None}
        if isinstance(v, list):
            return [w for x in v if (w := clean(x)) is not None]
        if isinstance(v, str):
            if replace_root and v.startswith(replace_root[0].rstrip("/") + "/"):
                v = replace_root[1].rstrip("/") + v[len(replace_root[0].rstrip("/")) :]
            return None if found.search(v) else v
        return v

    @F.pandas_udf("string")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(clean(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        for v in values:
            yield pd.Series([one(x if isinstance(x, str) else None) for x in v], dtype=object)

    return df.withColumn(column, run(column))


def json_names(column: Column, keys: tuple[str, ...] = ("name", "object_name", "object_type")) -> Column:
    """String values of some keys anywhere in a JSON text, in order, each once."""
    pattern = r'"(?:' + "|".join(keys) + r')"\s*:\s*"([^"\\]*)"'
    return F.array_distinct(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)))


def explode_candidates(df: DataFrame, candidates: str, keep: list[str]) -> DataFrame:
    """One row for each element of an array of candidates, with its position as letter."""
    letter = F.substring(F.lit("ABCDEFGH"), F.col("at") + 1, F.lit(1))
    return df.select(*keep, F.posexplode(candidates).alias("at", "c")).select(*keep, letter.alias("label"), "c.*")


def instruction_row(df: DataFrame, question: str = "question", options: str = "options", answer: str = "answer", images: str = "images") -> DataFrame:
    """(instruction, output): image tags, question and lettered options; the answer."""
    tags = F.repeat(F.lit("<image>"), F.size(images))
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(". "), o)), "\n")
    return df.withColumn("instruction", F.concat_ws("\n", F.concat(tags, F.col(question)), lines)).withColumn("output", F.concat(F.lit("Answer: "), F.col(answer)))


def fallback_locator(gt_json: Column, row_id: Column, scene: Column) -> Column:
    """map of where a row comes from: non-empty keys of its ground truth, else what its id names, else its scene."""
    given = F.map_filter(F.from_json(gt_json, "map<string,string>"), lambda k, v: k.isin("video", "scene", "scene_id", "episode", "frame_start", "frame_end") & v.isNotNull() & (v != ""))
    named = F.nullif(F.regexp_extract(row_id, r"^([A-Za-z0-9]+(?:_[A-Za-z0-9]+)*?)__", 1), F.lit(""))
    return F.when(F.size(given) > 0, given).when(named.isNotNull(), F.create_map(F.lit("id_prefix"), named)).when(scene.isNotNull() & (scene != ""), F.create_map(F.lit("scene"), scene))
