"""Hash-stable ids, orders, splits and picks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(*key: Column) -> Column:
    return F.concat_ws(":", *(k.cast("string") for k in key)).cast("binary")


def stable_id(c: Column, length: int = 40) -> Column:
    return F.substring(F.sha1(c.cast("string").cast("binary")), 1, length)


def order_key(seed: int | str, *key: Column) -> Column:
    """What stands in for a seeded shuffle: ordering by it."""
    return F.sha1(_bytes(F.lit(str(seed)), *key))


def unit_hash(seed: int | str, *key: Column) -> Column:
    """48 bits of the digest as a number from 0 to below 1."""
    return F.conv(F.substring(order_key(seed, *key), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def split_name(key: Column, seed: int | str, val_fraction: float) -> Column:
    """'val' or 'train', the same for all rows of a key."""
    return F.when(unit_hash(seed, key) < val_fraction, "val").otherwise("train")


def stable_shuffle(items: Column, *key: Column) -> Column:
    """An array in the order of its items' digests with the key."""
    keyed = F.transform(items, lambda x: F.struct(F.md5(_bytes(*key, x)).alias("h"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda s: s["x"])


def stable_pick(items: Column, *key: Column) -> Column:
    return F.try_element_at(stable_shuffle(items, *key), F.lit(1))


def options_with_answer(correct: Column, distractors: Column, *key: Column) -> Column:
    """(options, answer): the distinct texts shuffled by the key, and the letter of the correct one."""
    options = stable_shuffle(F.array_distinct(F.concat(F.array(correct), distractors)), *key)
    letter = F.substring(F.lit("ABCDEFGH"), F.array_position(options, correct).cast("int"), F.lit(1))
    return F.struct(options.alias("options"), letter.alias("answer"))
