"""Joins that Spark has no operator for, as equi-joins on derived keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multi_key_join(left: DataFrame, right: DataFrame, left_keys: list[Column], right_key: str, *, how: str = "left") -> DataFrame:
    """Left rows with the right row of their first key that matches: several spellings of a key, one equi-join.

    Left rows need a unique column; one is made here.
    """
    marked = left.withColumn("__row", F.monotonically_increasing_id())
    probes = marked.select("__row", F.posexplode(F.array(*left_keys)).alias("__at", "__key")).where("__key is not null")
    hit = probes.join(right.withColumnRenamed(right_key, "__key"), "__key").groupBy("__row").agg(F.min_by(F.struct(F.col("__key").alias(right_key), *(c for c in right.columns if c != right_key)), "__at").alias("__r"))
    return marked.join(hit, "__row", how).select(*left.columns, "__r.*")


#: Names up to which a table of them is broadcast, and the letters by which texts meet more of them.
BROADCAST_NAMES = 2_000
NAME_HEAD = 6


def contains_longest(df: DataFrame, text: str, names: DataFrame, name: str, key: str) -> DataFrame:
    """The longest name that each text contains, from a table of names.

    Up to BROADCAST_NAMES names are broadcast and tried one by one; of more,
    a text meets those that begin like one of its places.
    """
    few = names.select(name).where(F.col(name).isNotNull()).distinct()
    inside = F.contains(F.lower(F.col(text)), F.lower(F.col(name)))
    if few.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        hits = df.join(F.broadcast(few), inside)
    else:
        head = lambda c, at: F.substring(F.lower(c), at, F.lit(NAME_HEAD))
        low = F.lower(F.col(text))
        places = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: head(F.col(text), i))
        # heads shorter than the rest belong to short names: every shorter beginning of a place counts too
        heads = F.flatten(F.transform(places, lambda p: F.transform(F.sequence(F.lit(1), F.lit(NAME_HEAD)), lambda n: F.substring(p, F.lit(1), n))))
        keyed = few.withColumn("head_", head(F.col(name), F.lit(1)))
        hits = df.withColumn("head_", F.explode(F.array_distinct(heads))).join(keyed, "head_").where(inside)
    best = hits.groupBy(key).agg(F.max_by(name, F.struct(F.length(name), name)).alias(name))
    return df.join(best, key, "left")


#: Rows of a key of a pair join that a task takes at once, and the pairs tried in a partition, on average.
PAIR_TILE = 4096
PAIRS_TRIED = 8_000_000


def pairs_within(df: DataFrame, group: list[str], key: str, condition: Callable[[str, str], str], *, ordered: bool = False, band: tuple[str, float] | None = None) -> DataFrame:
    """Pairs of rows of a group, as columns a_* and b_*, that meet a condition on the prefixes.

    Unordered pairs come once (smaller key first). With ``band`` (column, width)
    only rows with abs(a - b) <= width of that column are tried: they meet by its
    values, a value with those in its reach. Partitions are as many as the pairs
    tried ask for (a small table makes many pairs), and the first rows of a key
    of more than PAIR_TILE are dealt out over tasks.
    """
    by = [*group, "x_"] if band else group
    rows = df.withColumn("x_", F.col(band[0]).cast("double") + 0.0).where(F.abs("x_") < float("inf")) if band else df
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    met = sizes.withColumn("at_", F.col("x_")) if band else sizes
    if band:
        met = _reach(sizes.select(*by), group, band[1]).join(sizes.hint("merge"), by)
        met = met.join(sizes.select(*group, F.col("x_").alias("at_"), F.col("n_").alias("m_")).hint("merge"), [*group, "at_"])
    tried = met.agg(F.sum(F.col("n_").cast("double") * F.col("m_" if band else "n_"))).first()[0] or 0.0
    spark = df.sparkSession
    many = int(min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), tried // PAIRS_TRIED + 1)))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in group]
    tiles = sizes.where(F.col("n_") > PAIR_TILE).select(*by, F.ceil(F.col("n_") / PAIR_TILE).cast("int").alias("tiles_"))
    # a first row meets every second one of each value in its reach, in the tile that its key falls in
    first, second = rows, rows
    if band:
        reach = _reach(sizes.select(*by), group, band[1])
        first = rows.join(reach.hint("merge"), by).drop("x_").withColumnRenamed("at_", "x_")
    n_tiles = F.coalesce("tiles_", F.lit(1))
    # as text: a join on doubles would shuffle once more, by their normal form, and drop the number of partitions
    keys = [*group, *([F.col("x_").cast("string").alias("x_")] if band else [])]
    first = first.join(tiles.hint("merge"), by, "left").select(*keys, F.pmod(F.xxhash64(key), n_tiles).cast("int").alias("tile_"), *side("a"))
    second = second.join(tiles.hint("merge"), by, "left").select(*keys, F.explode(F.sequence(F.lit(0), n_tiles - 1)).alias("tile_"), *side("b"))
    on = first.repartition(many, *by, "tile_").join(second.repartition(many, *by, "tile_").hint("shuffle_hash"), [*by, "tile_"])
    on = on.where(f"a_{key} {'<>' if ordered else '<'} b_{key}").where(condition("a_", "b_"))
    return on.drop("tile_", *(["x_"] if band else []))


def band_join(left: DataFrame, right: DataFrame, value_l: str, value_r: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Rows with abs(value_l - value_r) <= width: an equi-join on buckets of that width, the left row in three of them."""
    keys = keys or []
    l = left.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(value_l) / width) + d)))
    r = right.withColumn("__b", F.floor(F.col(value_r) / width))
    return l.join(r, [*keys, "__b"]).where(F.abs(F.col(value_l) - F.col(value_r)) <= width).drop("__b")


def _window(v: np.ndarray, mine: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the sorted ``v`` with abs(v - x) <= width, for each x of ``mine``, by differences as they are rounded: these keep the order of v."""
    def first(holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(v))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            good = holds(v[np.minimum(mid, len(v) - 1)])
            high, low = np.where(open_ & good, mid, high), np.where(open_ & ~good, mid + 1, low)
        return low

    return first(lambda x: mine - x <= width), first(lambda x: x - mine > width)


def _cell(c: str, width: float) -> Column:
    """Cells of twice the width: rounding can't put values that are near enough two cells apart. What is beyond 2 ** 52 shares the outermost ones."""
    edge = float(1 << 52)
    return F.floor(F.greatest(F.least(F.col(c) / (2 * width), F.lit(edge)), F.lit(-edge)))


def _reach(lines: DataFrame, group: list[str], width: float) -> DataFrame:
    """(*group, x_, at_): of distinct rows (*group, x_), each value with those of its group at most ``width`` from it."""
    cells = lines.select(*group, F.col("x_").alias("at_"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _cell("x_", width) + d)).alias("c_"))
    return lines.withColumn("c_", _cell("x_", width)).join(cells.hint("merge"), [*group, "c_"]).where(F.abs(F.col("x_") - F.col("at_")) <= width).drop("c_")


def _reached(values: DataFrame, by: list[str], width: float) -> DataFrame:
    """(*by, v, near) of rows (*by, v, n, home) at home: the n of all rows of a group with abs(v - other) <= width, added up."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("v", kind="stable")
        v, home = part["v"].to_numpy(), part["home"].to_numpy(bool)
        total = np.concatenate([[0], np.cumsum(part["n"].to_numpy())])
        first, end = _window(v, v[home], width)
        return part.loc[home, [*by, "v"]].assign(near=total[end] - total[first])

    fields = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in [*by, "v"]) + ", near long"
    return values.groupBy(*by).applyInPandas(run, fields)


def band_count(df: DataFrame, value: str, key: str, width: float, out: str = "neighbours") -> DataFrame:
    """Adds the number of rows of other keys with abs(value - other) <= width, in doubles and by that very expression; no pairs.

    Distinct values are counted first and meet in cells of twice the width.
    Rows without a key or a finite value have no neighbours and are none.
    """
    rows = df.withColumn("v", F.col(value).cast("double"))
    held = rows.where(F.col(key).isNotNull() & (F.abs("v") < float("inf"))).groupBy(F.col(key).alias("k"), "v").agg(F.count(F.lit(1)).alias("n"))
    near = held.groupBy("v").agg(F.sum("n").alias("n")).select("v", "n", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("d"))
    every = _reached(near.select((_cell("v", width) + F.col("d")).alias("cell"), "v", "n", (F.col("d") == 0).alias("home")), ["cell"], width).select("v", "near")
    several = held.groupBy("k").agg(F.sum("n").alias("m")).where("m > 1").select("k")
    own = _reached(held.join(several.hint("merge"), "k", "left_semi").withColumn("home", F.lit(True)), ["k"], width)
    found = rows.join(every.hint("merge"), "v", "left").join(own.select(F.col("k").alias(key), "v", F.col("near").alias("own")).hint("merge"), [key, "v"], "left")
    others = F.when(F.col(key).isNotNull() & F.col("near").isNotNull(), F.col("near") - F.coalesce("own", F.lit(1)))
    return found.select(*df.columns, F.coalesce(others, F.lit(0)).cast("long").alias(out))


def asof_nearest(left: DataFrame, right: DataFrame, time: str, keys: list[str], *, right_columns: list[str], tolerance: Column | None = None, gap: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Each left row with the right row nearest in time for its keys, the earlier one of two; columns near_<c>.

    Union and two window passes over one sort: no pairs are made.
    """
    distance = gap or (lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    found = F.struct(F.col(time).alias("t"), *(F.col(c) for c in right_columns))
    l = left.select(*keys, F.col(time).alias("__time"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType).alias("__r"))
    r = right.select(*keys, F.col(time).alias("__time"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), found.alias("__r"))
    both = l.unionByName(r)
    # both frames grow from one end, so each pass is linear in a key's rows
    nearest = lambda time: F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before, after = nearest(F.col("__time")), nearest(F.col("__time").desc())
    seen = both.withColumn("__b", before).withColumn("__a", after).where("__l is not null")
    d_b, d_a = distance(F.col("__time"), F.col("__b.t")), distance(F.col("__time"), F.col("__a.t"))
    near = F.when(d_a.isNull() | (d_b <= d_a), F.col("__b")).otherwise(F.col("__a"))
    picked = seen.withColumn("__n", near).withColumn("__d", F.least(d_b, d_a))
    if tolerance is not None:
        picked = picked.withColumn("__n", F.when(F.col("__d") <= tolerance, F.col("__n")))
    return picked.select("__l.*", F.col("__n.t").alias(f"near_{time}"), *(F.col(f"__n.{c}").alias(f"near_{c}") for c in right_columns))


def affine_time(df: DataFrame, index: str, time: str) -> DataFrame:
    """(slope, offset, worst): the straight line through frame numbers and times, and its largest residual."""
    fit = df.agg(F.regr_slope(F.col(time), F.col(index)).alias("slope"), F.regr_intercept(F.col(time), F.col(index)).alias("offset"))
    return df.crossJoin(F.broadcast(fit)).groupBy("slope", "offset").agg(F.max(F.abs(F.col(time) - (F.col("slope") * F.col(index) + F.col("offset")))).alias("worst"))


def interval_overlaps(df: DataFrame, group: list[str], key: str, start: str, end: str, span: int, least_iou: float = 0.0) -> DataFrame:
    """Pairs of intervals of a group that overlap, with iou: buckets of ``span`` instead of a range self join."""
    buckets = df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / span), F.floor(F.col(end) / span))))
    a, b = (buckets.select(*group, "__b", *(F.col(c).alias(f"{p}_{c}") for c in (key, start, end))) for p in "ab")
    met = a.join(b, [*group, "__b"]).where(f"a_{key} < b_{key} and a_{start} <= b_{end} and b_{start} <= a_{end}")
    once = met.where(F.col("__b") == F.floor(F.greatest(f"a_{start}", f"b_{start}") / span)).drop("__b")
    shared = F.least(f"a_{end}", f"b_{end}") - F.greatest(f"a_{start}", f"b_{start}") + 1
    union = F.greatest(f"a_{end}", f"b_{end}") - F.least(f"a_{start}", f"b_{start}") + 1
    return once.withColumn("iou", shared / union.cast("double")).where(F.col("iou") >= least_iou)


def bucket_near_duplicates(df: DataFrame, group: list[str], key: str, bands: dict[str, float], grid: dict[str, float]) -> DataFrame:
    """Pairs (a_key, b_key), a before b, of a group whose values lie within all bands, by 3 x 3 cells of a grid."""
    x, y = grid
    cell = lambda c: F.floor(F.col(c) / grid[c])
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = df.withColumn("__x", F.explode(F.transform(around, lambda d: cell(x) + d))).withColumn("__y", F.explode(F.transform(around, lambda d: cell(y) + d)))
    a = a.select(*group, "__x", "__y", F.col(key).alias(f"a_{key}"), *(F.col(c).alias(f"a_{c}") for c in bands))
    b = df.select(*group, cell(x).alias("__x"), cell(y).alias("__y"), F.col(key).alias(f"b_{key}"), *(F.col(c).alias(f"b_{c}") for c in bands))
    met = a.join(b, [*group, "__x", "__y"]).where(f"a_{key} < b_{key}")
    for c, width in bands.items():
        met = met.where(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= width)
    return met.drop("__x", "__y")


def earlier_near(df: DataFrame, group: list[str], key: str, x: str, wide: float, y: str, high: float, out: str) -> DataFrame:
    """Adds whether a smaller ``key`` (a number) of the group has abs(x - its x) <= wide and abs(y - its y) <= high; no pairs of rows.

    Rows of equal values are one class with its smallest key. A class asks each
    value of x in reach for the smallest key in its window of y; x should be
    the column of fewer values. No side is broadcast: its size isn't what the
    planner takes it for.
    """
    here = df.select(*group, F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_"), F.col(key).cast("long").alias("k_"))
    here = here.where(" and ".join([*(f"`{c}` is not null" for c in [*group, "k_"]), *(f"abs({c}) < double('infinity')" for c in ("x_", "y_"))]))
    classes = here.groupBy(*group, "x_", "y_").agg(F.min("k_").alias("k_"))
    reach = _reach(classes.select(*group, "x_").distinct(), group, wide)
    asked = classes.drop("k_").join(reach.hint("merge"), [*group, "x_"]).select(*group, "at_", "x_", "y_", F.lit(0).cast("long").alias("k_"), F.lit(True).alias("asks_"))
    others = classes.select(*group, F.col("x_").alias("at_"), "x_", "y_", "k_", F.lit(False).alias("asks_"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks_"].to_numpy(bool)
        line = part[~asks].sort_values("y_", kind="stable")
        table = [line["k_"].to_numpy(np.int64)]  # minima of 1, 2, 4, ... neighbours
        while 2 << (len(table) - 1) <= len(line):
            t, w = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(t[:-w], t[w:]))
        found = part.loc[asks, [*group, "x_", "y_"]]
        first, end = _window(line["y_"].to_numpy(), found["y_"].to_numpy(), high)
        least = np.zeros(len(found), np.int64)
        for level, t in enumerate(table):
            mine = (end - first >= 1 << level) & (end - first < 2 << level)
            least[mine] = np.minimum(t[first[mine]], t[end[mine] - (1 << level)])
        return found.assign(least_=least)[end > first]

    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group), "x_ double, y_ double, least_ long"])
    least = asked.unionByName(others).groupBy(*group, "at_").applyInPandas(run, fields).groupBy(*group, "x_", "y_").agg(F.min("least_").alias("least_"))
    valued = df.withColumn("x_", F.col(x).cast("double")).withColumn("y_", F.col(y).cast("double"))
    return valued.join(least.hint("merge"), [*group, "x_", "y_"], "left").select(*df.columns, F.coalesce(F.col("least_") < F.col(key), F.lit(False)).alias(out))


def lookup_all(df: DataFrame, key: str, items: Column, table: DataFrame, on: list[str], n: int) -> DataFrame:
    """Rows all of whose items (structs of ``on``) are in the table, with the found rows in order; any miss rejects."""
    each = df.select(key, F.posexplode(items).alias("at", "i")).select(key, "at", "i.*")
    found = each.join(table, on).groupBy(key).agg(F.count(F.lit(1)).alias("found"), F.sort_array(F.collect_list(F.struct("at", *(c for c in table.columns if c not in on)))).alias("rows"))
    return df.join(found.where(F.col("found") == n).drop("found"), key)


def shifted_pairs(df: DataFrame, batch: str, order: str, column: str, out: str) -> DataFrame:
    """Adds the previous row's value within a batch; the first row gets the last one's."""
    w = Window.partitionBy(batch).orderBy(order)
    last = F.last(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(F.lag(column).over(w), last))


def horizontal_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both, row by row; a shared column must agree, else the job fails."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    joined = a.join(b.withColumnsRenamed({c: f"__{c}" for c in shared}), key)
    for c in shared:
        joined = joined.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs"))))
    return joined.drop(*(f"__{c}" for c in shared))


def pivot_required(df: DataFrame, key: str, task: str, value: str, tasks: list[str]) -> DataFrame:
    """One row a key with a column for each task; only keys that have all of them."""
    wide = df.groupBy(key).pivot(task, tasks).agg(F.first(value))
    return wide.where(" and ".join(f"`{t}` is not null" for t in tasks))


def greedy_near_duplicates(df: DataFrame, group: list[str], order: list[str], same: Callable[[dict, dict], bool]) -> DataFrame:
    """Exact greedy form: in order, a row is dropped if it is the same as a kept one of its group."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        flags = []
        for row in part.sort_values(order, kind="stable").to_dict("records"):
            good = not any(same(row, k) for k in kept)
            kept += [row] * good
            flags.append(good)
        return part.sort_values(order, kind="stable")[flags]

    return df.groupBy(*group).applyInPandas(run, df.schema)
