"""Ranking, deduplication, quotas, sampling, splits and shards."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.tables import written

from sparkloom.functions.hashing import order_key


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order: an aggregate of whole rows, combined before the shuffle.

    No key's rows meet in one task, however many there are.
    """
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return best.select("__r.*")


def last_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return best.select("__r.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each partition's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def best_per_signature(df: DataFrame, signature: list[str], cap_key: list[str], order: list[Column], cap: int) -> DataFrame:
    """The best row of each signature, then at most ``cap`` rows of each cap key."""
    one = top_k(df, signature, order, 1, "__first").drop("__first")
    return top_k(one, cap_key, order, cap)


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """Rows of ranked groups in turns: all first ones, all second ones, ..."""
    out = df.withColumn("turn_no", F.row_number().over(Window.partitionBy(group).orderBy(*order))).orderBy("turn_no", group)
    return out if limit is None else out.limit(limit)


def largest_remainder(df: DataFrame, stratum: str, limit: int) -> DataFrame:
    """(stratum, n, quota): proportional quotas, leftovers to the largest deficits and then by name, one each.

    Works on the strata's counts alone.
    """
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    share = F.lit(limit) * F.col("n") / F.col("total")
    base = counts.withColumn("total", total).withColumn("base", F.least(F.col("n"), F.floor(share))).withColumn("deficit", share - F.col("base"))
    left = F.lit(limit) - F.sum("base").over(Window.partitionBy())
    ranked = base.withColumn("left", left).withColumn("r", F.row_number().over(Window.orderBy((F.col("base") >= F.col("n")).cast("int"), F.desc("deficit"), stratum)))
    return ranked.select(stratum, "n", F.least(F.col("n"), F.col("base") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).alias("quota"))


#: Hexadecimal digits of a hash by which rows are counted before any are ranked.
DIGITS = 4


def first_by_hash(df: DataFrame, group: str, key: str, quotas: DataFrame, seed: int | str) -> DataFrame:
    """Of each group its ``quota`` rows (a column of ``quotas``) that come first in hash order of the key.

    Rows are counted by group and the first digits of their hashes; where a
    quota ends within such a cell, that cell's rows alone are ranked. A group of
    any size is never in one task.
    """
    hashed = df.withColumn("order_", order_key(seed, F.col(key))).withColumn("cell_", F.substring("order_", 1, DIGITS))
    counts = hashed.groupBy(group, "cell_").agg(F.count(F.lit(1)).alias("n_"))
    to = F.sum("n_").over(Window.partitionBy(group).orderBy("cell_"))
    ends = counts.withColumn("to_", to).join(quotas.select(F.col(group).alias("group_"), F.col("quota").alias("quota_")), F.col(group).eqNullSafe(F.col("group_")))
    ends = ends.groupBy("group_", "quota_").agg(F.min(F.when(F.col("to_") >= F.col("quota_"), F.col("cell_"))).alias("edge_"), F.coalesce(F.max(F.when(F.col("to_") < F.col("quota_"), F.col("to_"))), F.lit(0)).alias("before_"))
    near = hashed.join(ends, F.col(group).eqNullSafe(F.col("group_"))).where((F.col("quota_") > 0) & (F.col("edge_").isNull() | (F.col("cell_") <= F.col("edge_"))))
    inside = near.where(F.col("edge_").isNull() | (F.col("cell_") < F.col("edge_")))
    ranked = near.where(F.col("cell_") == F.col("edge_")).withColumn("rank_", F.row_number().over(Window.partitionBy(group).orderBy("order_", key)))
    edge = ranked.where(F.col("rank_") <= F.col("quota_") - F.col("before_"))
    return inside.select(*df.columns).unionByName(edge.select(*df.columns))


def stratified_sample(df: DataFrame, stratum: str, key: str, limit: int | Column, seed: int | str) -> DataFrame:
    """``limit`` rows in proportion to the strata, in each by hash order of the key."""
    return first_by_hash(df, stratum, key, largest_remainder(df, stratum, limit), seed)


def even_quotas(keys: list, total: int) -> dict:
    """``total`` dealt evenly, the first keys one more."""
    base, more = divmod(total, len(keys))
    return {k: base + (i < more) for i, k in enumerate(keys)}


def capped_quotas(available: dict, total: int) -> dict:
    """Water-filling: as even as the available numbers allow, by key order; at most what there is."""
    left, quotas = min(total, sum(available.values())), dict.fromkeys(available, 0)
    while left:
        open_ = [k for k in available if quotas[k] < available[k]]
        share = max(1, left // len(open_))
        for k in open_:
            take = min(share, available[k] - quotas[k], left)
            quotas[k] += take
            left -= take
    return quotas


def capped_balanced(df: DataFrame, group: str, order: list[Column], total: int) -> DataFrame:
    """At most ``total`` rows, groups as even as their sizes allow. Only the groups' counts reach the driver."""
    sizes = {r[0]: r[1] for r in df.groupBy(group).count().orderBy(group).collect()}
    quotas = capped_quotas(sizes, total)
    table = df.sparkSession.createDataFrame(list(quotas.items()) or [(None, 0)], f"`{group}` {df.schema[group].dataType.simpleString()}, quota int")
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.join(table, group).where("__r <= quota").drop("__r", "quota")


def capped_with_backfill(df: DataFrame, group: str, order: list[Column], caps: dict, target: int, key: str) -> DataFrame:
    """Up to each group's cap, then the next rows in order until ``target``."""
    pairs = [F.lit(x) for kv in caps.items() for x in kv]
    cap = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(group)), F.lit(0))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    late = ranked.withColumn("__late", (F.col("__r") > cap).cast("int"))
    return late.orderBy("__late", *order, key).limit(target).drop("__r", "__late")


def modulo_shard(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds row_no (from 0) in a global order and shard = row_no % n.

    Global numbers without one task for all rows: partitions are ranged by the
    order, counted, and numbered from their offsets.
    """
    return global_row_number(df, order).withColumn("shard", F.pmod("row_no", F.lit(n)))


def global_row_number(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds row_no (from 0) in a total order of the rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33)).withColumn("__i", F.col("__id") - F.shiftleft(F.col("__p"), 33))
    marked = written(marked, "ranked")
    sizes = marked.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("before"))
    return marked.join(F.broadcast(offsets), "__p").withColumn("row_no", F.col("before") + F.col("__i")).drop("__id", "__p", "__i", "before")


def running_total(df: DataFrame, size: Column, order: list[str], out: str = "total_before") -> DataFrame:
    """Adds the sum of the sizes of all rows before, in a global order, from sums by range partition."""
    ranged = df.withColumn("__s", size).repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sums = ranged.groupBy("__p").agg(F.sum("__s").alias("n"))
    offsets = sums.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("before"))
    inside = F.sum("__s").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(offsets), "__p").withColumn(out, F.col("before") + F.coalesce(inside, F.lit(0))).drop("__s", "__p", "before")


def size_shards(df: DataFrame, size: Column, limit: int, order: list[str], *, group: list[str] | None = None) -> DataFrame:
    """Adds shard (from 0): rows in order, a new shard where the size would pass ``limit``; a larger row alone.

    The reset is sequential: only (order, size) of a group is folded, in one
    task each; without groups all of these narrow rows in one.
    """
    keys = group or []
    names = [*keys, *order]

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        shards, used, now = [], 0, 0
        for s in part["__s"]:
            if used and used + s > limit:
                now, used = now + 1, 0
            used += s
            shards.append(now)
        return part[names].assign(shard=shards)

    narrow = df.select(*names, size.cast("long").alias("__s"))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + ", shard long"
    if any(t == "timestamp_ntz" for c, t in df.dtypes if c in names):
        raise ValueError("order by a number, a text or a timestamp with zone")
    dealt = narrow.groupBy(*keys).applyInPandas(fold, fields)
    return df.join(dealt, names)


def even_slots(n: Column, k: int) -> Column:
    """k indices spread evenly over 0 .. n-1, both ends among them; all if there are no more."""
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(max(k - 1, 1)))).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(F.array_distinct(at))


def resample(df: DataFrame, key: str, n: int, seed: int | str, weight: Column | None = None) -> DataFrame:
    """n rows: a hash order, or its beginning; beyond the table's size, further ones drawn with replacement. Adds copy_no from 1.

    The j-th further draw takes the row where a hash of seed and j falls on the
    rows laid end to end in hash order, each as wide as its ``weight`` (1 unless
    given; with weights all n are such draws). Draws meet rows by ranges of
    their places, so no row order is held in one task.
    """
    total = df.count()
    if not total:
        return df.withColumn("copy_no", F.lit(1))
    hashed = df.withColumn("order_", order_key(seed, F.col(key)))
    whole = 0 if weight is not None else min(n, total)
    placed = running_total(hashed, F.lit(1) if weight is None else weight, ["order_", key], "from_")
    placed = written(placed.withColumn("to_", F.col("from_") + (F.lit(1) if weight is None else weight)), "resample")
    first = placed.where(F.col("from_") < whole).withColumn("copy_no", F.lit(1)) if whole else None
    out = first
    if n > whole:
        spark, end = df.sparkSession, placed.agg(F.max("to_")).first()[0]
        unit = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.lit("draw"), F.col("id")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
        draws = spark.range(whole, n).select(F.col("id").cast("string").alias("id")).select((unit * F.lit(float(end))).alias("at_")).groupBy(F.floor("at_").alias("cell_"), "at_").count()
        cells = placed.withColumn("cell_", F.explode(F.sequence(F.floor("from_"), F.greatest(F.floor("from_"), F.ceil("to_") - 1))))
        hit = cells.join(draws, "cell_").where("at_ >= from_ and at_ < to_")
        counts = hit.groupBy(key, "from_").agg(F.sum("count").alias("times_"))
        again = placed.join(counts, [key, "from_"]).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("times_").cast("int"))))
        again = again.drop("times_").withColumn("copy_no", F.col("copy_no") + (1 if whole else 0))
        out = again if first is None else first.unionByName(again)
    return out.select(*df.columns, "copy_no")


def hash_split(df: DataFrame, key: Column, seed: int | str, val_fraction: float, out: str = "split") -> DataFrame:
    """Adds 'val' or 'train' by the key's hash; if none fell to val, its last key does."""
    from sparkloom.functions.hashing import split_name

    named = df.withColumn("key_", key).withColumn(out, split_name(F.col("key_"), seed, val_fraction))
    seen = named.agg(F.max((F.col(out) == "val").cast("int")).alias("any_"), F.max("key_").alias("last_"))
    fallen = (F.col("any_") == 0) & F.col("key_").eqNullSafe(F.col("last_"))
    return named.crossJoin(F.broadcast(seen)).withColumn(out, F.when(fallen, "val").otherwise(F.col(out))).drop("key_", "any_", "last_")


def grouped_greedy(df: DataFrame, group: list[str], order: list[str], pick: Callable[[pd.DataFrame], list[bool]]) -> DataFrame:
    """Rows that a sequential rule accepts, group by group in order: ``pick`` gets a group's rows and tells which stay."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        return part[pick(part)]

    return df.groupBy(*group).applyInPandas(run, df.schema)


def pick_non_overlapping(start: str, end: str, most_iou: float, limit: int) -> Callable[[pd.DataFrame], list[bool]]:
    """Greedy: a window stays if its overlap over union with every kept one is below ``most_iou``."""
    def pick(part: pd.DataFrame) -> list[bool]:
        kept, flags = [], []
        for a, b in zip(part[start], part[end], strict=True):
            good = len(kept) < limit and all(_iou(a, b, c, d) < most_iou for c, d in kept)
            kept += [(a, b)] * good
            flags.append(good)
        return flags

    return pick


def _iou(a, b, c, d) -> float:
    shared = max(0, min(b, d) - max(a, c) + 1)
    return shared / ((b - a + 1) + (d - c + 1) - shared)


def pick_separated(columns: list[str], gap: float, limit: int) -> Callable[[pd.DataFrame], list[bool]]:
    """Greedy: a row stays if it is at least ``gap`` from every kept one."""
    def pick(part: pd.DataFrame) -> list[bool]:
        kept, flags = [], []
        for p in part[columns].to_numpy(float):
            good = len(kept) < limit and all(((p - q) ** 2).sum() ** 0.5 >= gap for q in kept)
            kept += [p] * good
            flags.append(good)
        return flags

    return pick


def pick_capped(unique: str, label: str, per_label: int, limit: int) -> Callable[[pd.DataFrame], list[bool]]:
    """Greedy in order: each ``unique`` value once, at most ``per_label`` rows of a label, ``limit`` in all."""
    def pick(part: pd.DataFrame) -> list[bool]:
        seen, counts, total, flags = set(), {}, 0, []
        for u, v in zip(part[unique], part[label], strict=True):
            good = u not in seen and counts.get(v, 0) < per_label and total < limit
            if good:
                seen.add(u)
                counts[v], total = counts.get(v, 0) + 1, total + 1
            flags.append(good)
        return flags

    return pick


def diversity_greedy(df: DataFrame, cell: list[str], counters: list[str], score: str, key: str, quota: int) -> DataFrame:
    """``quota`` picks a cell, cells in order; each pick is the row whose counters have been picked least so far, in any cell, then of the best score, then the first key.

    Rows of a cell that agree in all counters are picked in the order of score,
    so ``quota`` of them are enough: these alone meet in the one task that a
    rule with counters across cells needs.
    """
    same = Window.partitionBy(*cell, *counters).orderBy(score, key)
    few = df.withColumn("rank_", F.row_number().over(same)).where(F.col("rank_") <= quota).drop("rank_")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import heapq

        picked: dict[tuple, int] = {}
        out = []
        for _, rows in part.sort_values([*cell, score, key], kind="stable").groupby(cell, sort=True, dropna=False):
            # a row's place in the queue only falls back as counters grow: what comes up is judged again
            rank = lambda r: (*(picked.get((c, r[c]), 0) for c in counters), r[score], r[key])
            queue = [(rank(r), i, r) for i, r in enumerate(rows.to_dict("records"))]
            heapq.heapify(queue)
            left = quota
            while queue and left:
                was, i, row = heapq.heappop(queue)
                now = rank(row)
                if now != was:
                    heapq.heappush(queue, (now, i, row))
                    continue
                out.append(row)
                left -= 1
                for c in counters:
                    picked[c, row[c]] = picked.get((c, row[c]), 0) + 1
        return pd.DataFrame(out, columns=part.columns)

    return few.groupBy().applyInPandas(run, df.schema)


def balanced_targets(counts: dict, total: int) -> dict:
    """Even shares of ``total``, none above its count; what that leaves is shared again among the others."""
    out, open_ = dict.fromkeys(counts, 0), sorted(counts)
    while open_ and total > 0:
        share = max(1, total // len(open_))
        for k in open_:
            more = min(share, counts[k] - out[k], total)
            out[k], total = out[k] + more, total - more
        open_ = [k for k in open_ if out[k] < counts[k]]
    return out


def deficit_greedy(df: DataFrame, bins: dict[str, float], owner: str, key: str, total: int, *, rare: dict[str, float] | None = None, penalty: float = 0.35, caps: tuple[int, ...] = (3, 4, 6, 8, 12), batch: int = 300) -> DataFrame:
    """``total`` rows that fill balanced targets of several binned columns, rare bins first, owners capped.

    ``bins`` weighs each column; a row's score is the weighted share of its bins'
    targets that is still open, less ``penalty`` for each row its owner has. Rows
    of bins no larger than their targets (weights ``rare``) are taken first, as
    scored at the start; then rounds under growing owner ``caps`` take the best
    ``batch`` of those left, scored when the round begins, again and again. Ties go by a hash of the key. One sequential task by contract:
    rows of one bin combination and owner beyond ``total`` can't be picked and
    stay out.
    """
    same = Window.partitionBy(*bins, owner).orderBy(F.xxhash64(key), key)
    few = df.withColumn("rank_", F.row_number().over(same)).where(F.col("rank_") <= total).withColumn("rank_", F.xxhash64(key))
    counts = {c: {r[0]: r[1] for r in df.groupBy(c).count().collect()} for c in bins}
    targets = {c: balanced_targets(n, total) for c, n in counts.items()}
    rare = rare or {}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["rank_", key], kind="stable").to_dict("records")
        have, owned, out = {c: {} for c in bins}, {}, []

        def score(r: dict) -> float:
            open_ = ((w, max(targets[c].get(r[c], 1), 1), have[c].get(r[c], 0)) for c, w in bins.items())
            return sum(w * max(0.0, (t - h) / t) for w, t, h in open_) - penalty * owned.get(r[owner], 0)

        def take(r: dict) -> None:
            out.append(r)
            owned[r[owner]] = owned.get(r[owner], 0) + 1
            for c in bins:
                have[c][r[c]] = have[c].get(r[c], 0) + 1

        extra = lambda r: sum(w for c, w in rare.items() if counts[c][r[c]] <= targets[c].get(r[c], 0))
        first = sorted((r for r in rows if extra(r) > 0), key=lambda r: -(extra(r) + score(r)))[:total]
        for r in first:
            take(r)
        taken = {id(r) for r in first}
        left = [r for r in rows if id(r) not in taken]
        for cap in (*caps, len(rows) + 1):
            while len(out) < total:
                able = sorted((r for r in left if owned.get(r[owner], 0) < cap), key=lambda r: -score(r))
                if not able:
                    break
                chosen = able[: min(batch, total - len(out))]
                for r in chosen:
                    take(r)
                gone = {id(r) for r in chosen}
                left = [r for r in left if id(r) not in gone]
        return pd.DataFrame(out, columns=part.columns)[names]

    names, schema = df.columns, df.schema
    return few.groupBy().applyInPandas(run, schema)


def balanced_partitions(df: DataFrame, length: str, key: str, k: int, *, equal_size: bool = False, group: list[str] | None = None) -> DataFrame:
    """Adds partition: sums of lengths kept near each other by largest differencing; sizes too if ``equal_size``."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([length, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        return part.assign(partition=differencing(part[length].tolist(), k, equal_size))

    keys = group or []
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", partition int"
    return df.groupBy(*keys).applyInPandas(run, fields)


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[int]:
    """Karmarkar-Karp: states of k sums are merged largest spread first, large sums with small ones."""
    import heapq

    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    start = [order[i : i + k] for i in range(0, len(order), k)] if equal_size else [[i] for i in order]
    heap = []
    for n, items in enumerate(start):
        parts = sorted(([(lengths[i], [i]) for i in items] + [(0, [])] * (k - len(items))), key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), n, parts))
    n = len(start)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        n += 1
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), n, parts))
    out = [0] * len(lengths)
    for j, (_, items) in enumerate(heap[0][2] if heap else []):
        for i in items:
            out[i] = j
    return out
