"""Dialog converters, encoding, packing, blocks and batches for training."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.hashing import order_key
from sparkloom.operators.validate import alternation_ok

IGNORE = -100


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def from_alpaca(df: DataFrame) -> DataFrame:
    """prompt, response, system of rows with instruction, input, output, history array<array<string>>, system."""
    query = F.concat_ws("\n", F.nullif("instruction", F.lit("")), F.nullif("input", F.lit("")))
    history = F.flatten(F.transform(F.coalesce("history", F.array().cast("array<array<string>>")), lambda h: F.array(_message("user", h[0]), _message("assistant", h[1]))))
    return df.withColumn("prompt", F.concat(history, F.array(_message("user", query)))).withColumn("response", F.array(_message("assistant", F.col("output")))).withColumn("system", F.coalesce("system", F.lit("")))


def from_sharegpt(df: DataFrame, turns: str = "turns") -> DataFrame:
    """prompt, response, system, reason: a leading system turn is taken out; broken dialogs get empty prompts and a reason."""
    t = F.col(turns)
    has = F.coalesce(t[0]["from"] == "system", F.lit(False))
    rest = F.when(has, F.slice(t, F.lit(2), F.size(t))).otherwise(t)
    good = F.coalesce((F.size(rest) > 0) & alternation_ok(F.transform(rest, lambda x: x["from"])), F.lit(False))
    role = lambda x: F.when(x["from"] == "human", "user").when(x["from"] == "gpt", "assistant").otherwise(x["from"])
    all_ = F.transform(rest, lambda x: F.struct(role(x).alias("role"), x["value"].alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return df.withColumn("system", F.when(has, t[0]["value"]).otherwise("")).withColumn("prompt", F.when(good, F.slice(all_, F.lit(1), F.greatest(F.size(all_) - 1, F.lit(0)))).otherwise(none)).withColumn("response", F.when(good, F.slice(all_, F.greatest(F.size(all_), F.lit(1)), F.lit(1))).otherwise(none)).withColumn("reason", F.when(~good, "broken_dialog"))


def merge_tool_turns(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, at, role, text): consecutive tool turns of a dialog joined by newlines."""
    w = Window.partitionBy(key).orderBy(order)
    new = (F.col(role) != "tool") | F.coalesce(F.lag(role).over(w) != "tool", F.lit(True))
    island = df.withColumn("__g", F.sum(new.cast("int")).over(w))
    return island.groupBy(key, "__g").agg(F.min(order).alias("at"), F.min(role).alias("role"), F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("t")).select(key, "at", "role", F.array_join("t", "\n").alias("text"))


def from_openai(df: DataFrame, key: str, order: str, role: str, text: str, calls: str) -> DataFrame:
    """As merge_tool_turns, with an assistant's tool calls (JSON) as a function turn."""
    call = F.col(calls).isNotNull() & (F.col(role) == "assistant")
    named = df.withColumn(text, F.when(call, F.col(calls)).otherwise(F.col(text))).withColumn(role, F.when(call, "function").otherwise(F.col(role)))
    return merge_tool_turns(named, key, order, role, text)


def with_loss_weights(turns: Column, trained: str = "gpt") -> Column:
    return F.transform(turns, lambda t: F.struct(t["from"].alias("role"), t["value"].alias("content"), F.when(t["from"] == trained, 1.0).otherwise(0.0).alias("loss_weight")))


CONVERTERS = {"alpaca": from_alpaca, "sharegpt": from_sharegpt}


def register_converter(name: str, function) -> None:
    """Make a DataFrame -> DataFrame converter known by name."""
    CONVERTERS[name] = function


def align(df: DataFrame, formatting: str) -> DataFrame:
    """Rows in the common form by a registered converter, malformed ones (no prompt or response) dropped."""
    out = CONVERTERS[formatting](df)
    return out.where((F.size("prompt") % 2 == 1) & (F.size("response") == 1))


def fill_template(template: str, **slots: Column) -> Column:
    """A chat template with {{slot}} places."""
    out, rest = [], template
    while "{{" in rest:
        before, _, tail = rest.partition("{{")
        name, _, rest = tail.partition("}}")
        out += [F.lit(before), slots[name]]
    return F.concat(*out, F.lit(rest))


def tool_calls(text: Column) -> Column:
    """array<struct<name,arguments>> from 'Action: x / Action Input: {...}' passages."""
    pattern = r"(?s)Action:\s*([A-Za-z0-9_]+)\s*Action Input:\s*(\{.*?\})\s*(?=Action:|\z)"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("name"), F.regexp_extract(m, pattern, 2).alias("arguments")))


def encode_pair(source: Column, target: Column, cutoff: int, *, train_on_prompt: bool = False) -> Column:
    """struct(input_ids, labels): both sides cut to the budget, the source masked."""
    from sparkloom.functions.numeric import truncation_budget

    budget = truncation_budget(F.size(source), F.size(target), cutoff)
    s, t = F.slice(source, F.lit(1), budget["source"]), F.slice(target, F.lit(1), budget["target"])
    masked = s if train_on_prompt else F.transform(s, lambda _: F.lit(IGNORE))
    return F.struct(F.concat(s, t).alias("input_ids"), F.concat(masked, t).alias("labels"))


def encode_turns(turns: Column, cutoff: int, *, mask_history: bool = False) -> Column:
    """struct(input_ids, labels) of a dialog given as array<struct<source array<int>, target array<int>>>.

    Turns share the budget in order: each is cut to what the turns before it
    have left, by the rule of a single pair; turns without room left go.
    Sources are masked, and with ``mask_history`` all targets but the last one.
    """
    from sparkloom.functions.numeric import truncation_budget

    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<int>").alias("labels"))
    last = F.size(turns) - 1
    placed = F.transform(turns, lambda t, i: F.struct(t["source"].alias("source"), t["target"].alias("target"), (i == last).alias("last")))

    def step(acc: Column, t: Column) -> Column:
        room = truncation_budget(F.size(t["source"]), F.size(t["target"]), F.lit(cutoff) - acc["used"])
        s, r = F.slice(t["source"], F.lit(1), room["source"]), F.slice(t["target"], F.lit(1), room["target"])
        hidden = lambda x: F.transform(x, lambda _: F.lit(IGNORE))
        told = F.when(t["last"], r).otherwise(hidden(r)) if mask_history else r
        grown = F.struct((acc["used"] + F.size(s) + F.size(r)).alias("used"), F.concat(acc["ids"], s, r).alias("ids"), F.concat(acc["labels"], hidden(s), told).alias("labels"))
        return F.when(acc["used"] < cutoff, grown).otherwise(acc)

    return F.aggregate(placed, zero, step, lambda acc: F.struct(acc["ids"].alias("input_ids"), acc["labels"].alias("labels")))


def encode_preference(prompt: Column, chosen: Column, rejected: Column, cutoff: int) -> Column:
    """struct(chosen_input_ids, chosen_labels, rejected_input_ids, rejected_labels): both answers cut by the longer one's budget, the prompt alike."""
    from sparkloom.functions.numeric import truncation_budget

    budget = truncation_budget(F.size(prompt), F.greatest(F.size(chosen), F.size(rejected)), F.lit(cutoff))
    p = F.slice(prompt, F.lit(1), budget["source"])
    cut = lambda x: F.slice(x, F.lit(1), budget["target"])
    hidden = F.transform(p, lambda _: F.lit(IGNORE))
    sides = (("chosen", cut(chosen)), ("rejected", cut(rejected)))
    return F.struct(*(x for name, a in sides for x in (F.concat(p, a).alias(f"{name}_input_ids"), F.concat(hidden, a).alias(f"{name}_labels"))))


def encode_feedback(df: DataFrame, group: str, order: str, prompt: str, answer: str, tag: str, cutoff: int) -> DataFrame:
    """Adds pair and kl_pair (struct(input_ids, labels)): the answer, and for the divergence the previous row's answer in the group; the first row's is the last one's."""
    w = Window.partitionBy(group).orderBy(order)
    whole = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.coalesce(F.lag(answer).over(w), F.last(answer).over(whole))
    paired = df.withColumn("other_", other)
    return paired.withColumn("pair", encode_pair(F.col(prompt), F.col(answer), cutoff)).withColumn("kl_pair", encode_pair(F.col(prompt), F.col("other_"), cutoff)).withColumn("tag", F.col(tag).cast("boolean")).drop("other_")


def collate(df: DataFrame, batch: str, key: str, ids: str, labels: str, *, pad_id: int = 0, multiple: int = 8) -> DataFrame:
    """Rows of a batch padded to its longest, up to a ``multiple``: input_ids, labels, attention_mask."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    width = (F.ceil(longest / multiple) * multiple).cast("int")
    ones = F.transform(ids, lambda _: F.lit(1))
    return df.withColumn("width_", width).select(batch, key, pad(F.col(ids), F.col("width_"), pad_id).alias("input_ids"), pad(F.col(labels), F.col("width_"), IGNORE).alias("labels"), pad(ones, F.col("width_"), 0).alias("attention_mask"))


def collate_preference(df: DataFrame, batch: str, key: str, pair: str, **settings: int) -> DataFrame:
    """As collate, with every pair's chosen row in the batch's first half and its rejected one in the second: column side is 0 or 1."""
    sides = [df.select(batch, key, F.lit(i).alias("side"), F.col(f"{pair}.{n}_input_ids").alias("ids"), F.col(f"{pair}.{n}_labels").alias("labels")) for i, n in enumerate(("chosen", "rejected"))]
    both = sides[0].unionByName(sides[1]).withColumn("key_", F.struct("side", key))
    return collate(both, batch, "key_", "ids", "labels", **settings).select(batch, F.col(f"key_.{key}").alias(key), F.col("key_.side").alias("side"), "input_ids", "labels", "attention_mask")


def block_mask(segments: Column) -> Column:
    """array<array<int>>: 1 where a token may look at another: of the same segment (not 0) and not after it."""
    return F.transform(segments, lambda x, i: F.transform(segments, lambda y, j: ((x == y) & (x != 0) & (j <= i)).cast("int")))


def pair_feedback(turns: Column, chosen: Column, rejected: Column) -> Column:
    """struct(chosen, rejected) of messages with loss weights: the common turns with weight 0, then either answer with weight 1."""
    common = F.transform(turns, lambda t: F.struct(t["from"].alias("role"), t["value"].alias("content"), F.lit(0.0).alias("loss_weight")))
    end = lambda x: F.concat(common, F.array(F.struct(F.lit("gpt").alias("role"), x.alias("content"), F.lit(1.0).alias("loss_weight"))))
    return F.struct(end(chosen).alias("chosen"), end(rejected).alias("rejected"))


def pad(ids: Column, n: int | Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest((n if isinstance(n, Column) else F.lit(n)) - F.size(ids), F.lit(0))))


def greedy_pack(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length: bins are filled one by one with the largest remaining length that still fits; -1 if none can."""
    order = sorted((n, i) for i, n in enumerate(lengths) if n <= capacity)
    bins, now = [-1] * len(lengths), 0
    while order:
        room = capacity
        while order:
            at = bisect_right(order, (room, len(lengths))) - 1
            if at < 0:
                break
            n, i = order.pop(at)
            bins[i], room = now, room - n
        now += 1
    return bins


#: Lengths of a list up to which lists are packed side by side.
SIDE_BY_SIDE = 64


def greedy_pack_lists(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """``greedy_pack`` of many lists, given one after the other with their sizes: short ones side by side."""
    bins = np.full(len(lengths), -1, np.int64)
    starts = np.cumsum(counts) - counts
    for i in np.flatnonzero(counts > SIDE_BY_SIDE).tolist():
        bins[starts[i] : starts[i] + counts[i]] = greedy_pack(lengths[starts[i] : starts[i] + counts[i]].tolist(), capacity)
    short = np.flatnonzero((counts > 0) & (counts <= SIDE_BY_SIDE))
    for width in (4, 8, 16, SIDE_BY_SIDE):  # lists of like sizes together
        mine, short = short[counts[short] <= width], short[counts[short] > width]
        if not len(mine):
            continue
        places = np.minimum(starts[mine, None] + np.arange(width), len(lengths) - 1)
        n = np.where(np.arange(width) < counts[mine, None], lengths[places], capacity + 1)
        # the largest first, of equal ones the last: one pass over them fills a bin with what still fits
        order = np.lexsort((-np.tile(np.arange(width), (len(mine), 1)), -n))
        n, found = np.ascontiguousarray(np.take_along_axis(n, order, 1).T), np.full((width, len(mine)), -1)
        free, now = n <= capacity, 0
        while free.any():
            room = np.full(len(mine), capacity)
            for j in range(width):
                fits = free[j] & (n[j] <= room)
                found[j][fits] = now
                room -= np.where(fits, n[j], 0)
                free[j] &= ~fits
            now += 1
        back = np.full((len(mine), width), -1)
        np.put_along_axis(back, order, found.T, 1)
        real = np.arange(width) < counts[mine, None]
        bins[places[real]] = back[real]
    return bins


def pack_lists(df: DataFrame, lengths: str, capacity: int) -> DataFrame:
    """Adds bins, array<int>: each row's list of lengths packed by itself (-1 where longer than the capacity). For many short batches; see pack."""
    names = [*df.columns, "bins"]
    at = names.index(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            ends = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)[ends[0] : ends[-1]]
            bins = greedy_pack_lists(values, np.diff(ends), capacity)
            found = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(bins, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", bins array<int>"
    return df.mapInArrow(run, fields)


def pack(df: DataFrame, length: str, key: str, capacity: int, batch: list[str]) -> DataFrame:
    """Adds bin (null if longer than the capacity). Only lengths and keys of a batch meet in a task."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([length, key], kind="stable")
        found = pd.Series(greedy_pack(part[length].tolist(), capacity), index=part.index).astype("Int64")
        return part[[*batch, key]].assign(bin=found.where(found >= 0))

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*batch, key]) + ", bin long"
    dealt = df.select(*batch, key, length).groupBy(*batch).applyInPandas(run, fields)
    return df.join(dealt, [*batch, key])


def assemble_packed(df: DataFrame, group: list[str], key: str, ids: str, cutoff: int, pad_id: int = 0) -> DataFrame:
    """One row a bin: input_ids padded to cutoff + 1, position_ids from 0 in each part, segment numbers and boundaries."""
    parts = df.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct(key, ids))), lambda x: x[ids]).alias("p"))
    return parts.select(*group, *assembled(F.col("p"), cutoff, pad_id))


def assembled(p: Column, cutoff: int, pad_id: int = 0) -> list[Column]:
    """input_ids, position_ids, segments and boundaries of a bin's parts (arrays of ids, in order)."""
    sizes = F.transform(p, lambda x: F.size(x))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    flat = lambda f: F.flatten(F.transform(p, f))
    return [pad(F.flatten(p), cutoff + 1, pad_id).alias("input_ids"), pad(flat(lambda x: F.transform(x, lambda _, i: i)), cutoff + 1, 0).alias("position_ids"), pad(flat(lambda x, j: F.transform(x, lambda _: j + 1)), cutoff + 1, 0).alias("segments"), ends.alias("boundaries")]


def fixed_blocks(df: DataFrame, length: str, total_before: str, block: int) -> DataFrame:
    """(block, part of it): how rows laid end to end fall into blocks; from each row's start in the whole."""
    first, last = F.floor(F.col(total_before) / block), F.floor((F.col(total_before) + F.col(length) - 1) / block)
    each = df.where(F.col(length) > 0).withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block, F.col(total_before))
    end = F.least((F.col("block") + 1) * block, F.col(total_before) + F.col(length))
    return each.withColumn("part_tokens", end - begin).withColumn("part_start", begin - F.col(total_before))


def micro_batches(df: DataFrame, length: str, key: str, budget: int, group: list[str]) -> DataFrame:
    """Adds partition: as few length-balanced micro-batches as the budget asks for, by the group's total."""
    from sparkloom.operators.select import differencing

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([length, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        k = max(1, -(-int(part[length].sum()) // budget))
        return part.assign(partition=differencing(part[length].tolist(), k))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", partition int"
    return df.groupBy(*group).applyInPandas(run, fields)


def few_shot(df: DataFrame, support: DataFrame, subject: str, k: int, seed: int, question: str, answer: str) -> DataFrame:
    """Adds shots: k support rows of the subject by hash order, as 'question answer' texts joined by blank lines."""
    w = Window.partitionBy(subject).orderBy(order_key(seed, F.col(question)), question)
    few = support.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    shots = few.groupBy(subject).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", F.concat_ws("\n", question, answer).alias("t")))), lambda x: x["t"]), "\n\n").alias("shots"))
    return df.join(shots, subject, "left")


def overlong(df: DataFrame, text: str, limit: int, count=None) -> DataFrame:
    """Rows whose prompt is too long; words unless a token counter (Column -> Column) is given."""
    from sparkloom.functions.text import word_count

    return df.where((count or word_count)(F.col(text)) > limit)
