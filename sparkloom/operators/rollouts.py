"""Advantages, returns, divergences and losses over groups of rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_advantage(df: DataFrame, group: str, score: str, eps: float = 1e-6) -> DataFrame:
    """(x - mean) / (sample std + eps) of each group; 0 in a group of one."""
    w = Window.partitionBy(group)
    x = F.col(score).cast("double")
    return df.withColumn("advantage", F.coalesce((x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + eps), F.lit(0.0)))


def pass_at_k_advantage(df: DataFrame, group: str, score: str, key: str, eps: float = 1e-6) -> DataFrame:
    """Only a group's best row gets (best - second) / (std + eps); 0 elsewhere."""
    w = Window.partitionBy(group)
    ordered = w.orderBy(F.desc(score), key)
    x = F.col(score).cast("double")
    best = F.row_number().over(ordered) == 1
    gap = (x - F.lead(x).over(ordered)) / (F.stddev_samp(x).over(w) + eps)
    return df.withColumn("advantage", F.when(best, F.coalesce(gap, F.lit(0.0))).otherwise(0.0))


def leave_one_out_advantage(df: DataFrame, group: str, score: str) -> DataFrame:
    """x less the mean of the group's other rows; x itself in a group of one."""
    w = Window.partitionBy(group)
    x = F.col(score).cast("double")
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("advantage", x - F.coalesce(F.try_divide(F.sum(x).over(w) - x, (n - 1).cast("double")), F.lit(0.0)))


def discounted_returns(rewards: Column, gamma: float, mask: Column | None = None) -> Column:
    """Array of reverse discounted sums; where the mask is 0 the running sum starts anew."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), (mask if mask is not None else F.transform(rewards, lambda _: F.lit(1.0))).alias("m")))
    zero = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        run = (x["r"] + gamma * acc["run"]).cast("double")
        return F.struct((run * x["m"]).cast("double").alias("run"), F.concat(F.array(run), acc["out"]).alias("out"))

    return F.aggregate(pairs, zero, step)["out"]


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """struct(advantages, returns) of a sequence by generalised advantage estimation; the value after the end is 0."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v")))
    zero = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("adv"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        adv = (x["r"] + gamma * acc["next"] - x["v"] + gamma * lam * acc["adv"]).cast("double")
        return F.struct(x["v"].cast("double").alias("next"), adv.alias("adv"), F.concat(F.array(adv), acc["out"]).alias("out"))

    adv = F.aggregate(pairs, zero, step)["out"]
    return F.struct(adv.alias("advantages"), F.zip_with(adv, values, lambda a, v: a + v).alias("returns"))


def reverse_cumulative(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def kl(log_p: Column, log_q: Column, kind: str) -> Column:
    """Divergence estimates of one token: kl, abs, mse, low_var."""
    d = log_p - log_q
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var":
        back = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -d))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(back) - back - 1.0))
    raise ValueError(kind)


def full_kl(log_p: Column, log_q: Column) -> Column:
    """Sum over a distribution given as arrays of log probabilities."""
    return F.aggregate(F.zip_with(log_p, log_q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def topk_forward_kl(teacher: Column, student: Column, clip: float | None = None) -> Column:
    """Sum of p (log p - log q) over the teacher's top tokens, not below 0, at most ``clip``."""
    total = F.greatest(F.lit(0.0), full_kl(teacher, student))
    return total if clip is None else F.least(total, F.lit(float(clip)))


def penalised(score: Column, log_p: Column, log_q: Column, beta: float) -> Column:
    return score - beta * kl(log_p, log_q, "kl")


def average_loss(df: DataFrame, sequence: str, loss: str, mask: str, mode: str) -> DataFrame:
    """One row: the mean over all tokens, or the mean of the sequences' means or sums."""
    x, m = F.col(loss) * F.col(mask), F.col(mask)
    if mode == "token":
        return df.agg((F.sum(x) / F.greatest(F.sum(m), F.lit(1e-6))).alias("loss"))
    one = F.sum(x) if mode == "seq_sum" else F.sum(x) / F.greatest(F.sum(m), F.lit(1e-6))
    return df.groupBy(sequence).agg(one.alias("l")).agg(F.avg("l").alias("loss"))


def policy_loss(old: Column, new: Column, advantage: Column, low: float = 0.2, high: float = 0.3, dual: float = 3.0) -> Column:
    """Clipped surrogate loss of one token, with a bound for negative advantages."""
    ratio = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), new - old)))
    clipped = F.greatest(F.lit(1.0 - low), F.least(F.lit(1.0 + high), ratio))
    worst = F.greatest(-advantage * ratio, -advantage * clipped)
    return F.when(advantage < 0, F.least(worst, -advantage * dual)).otherwise(worst)


def sequence_policy_losses(old: Column, new: Column, advantage: Column, mask: Column, kind: str = "default", *, low: float = 0.2, high: float = 0.3, dual: float = 3.0, tau_positive: float = 1.0, tau_negative: float = 1.05) -> Column:
    """Array of the losses of a sequence's tokens, from arrays; tokens that the mask leaves out have one too.

    default: clipped surrogate with a bound for negative advantages. gspo: the
    same with the sequence's mean log ratio at every token that counts;
    gspo_token: at every token. cispo: the clipped ratio weighs the log
    probability. sapo: a sigmoid gate of the ratio, of its own temperature for
    negative advantages.
    """
    if kind not in ("default", "gspo", "gspo_token", "cispo", "sapo"):
        raise ValueError(kind)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    logs = F.zip_with(new, old, lambda n, o: n - o)
    if kind.startswith("gspo"):
        mean = add(F.zip_with(logs, mask, lambda x, m: x * m)) / (add(F.transform(mask, lambda m: m.cast("double"))) + 1e-8)
        logs = F.transform(mask, lambda m: mean * m if kind == "gspo" else mean)
    tokens = F.transform(F.arrays_zip(logs.alias("l"), new.alias("n"), advantage.alias("a")), lambda x: F.struct(x["a"].alias("a"), x["n"].alias("n"), F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x["l"]))).alias("r")))
    near = lambda r: F.greatest(F.lit(1.0 - low), F.least(F.lit(1.0 + high), r))
    if kind == "cispo":
        return F.transform(tokens, lambda t: -t["a"] * t["n"] * near(t["r"]))
    if kind == "sapo":
        gate = lambda r, tau: 4.0 / tau / (1.0 + F.exp(-tau * (r - 1.0)))
        return F.transform(tokens, lambda t: -t["a"] * F.when(t["a"] >= 0, gate(t["r"], tau_positive)).otherwise(gate(t["r"], tau_negative)))
    worst = lambda t: F.greatest(-t["a"] * t["r"], -t["a"] * near(t["r"]))
    return F.transform(tokens, lambda t: F.when(t["a"] < 0, F.least(worst(t), -t["a"] * dual)).otherwise(worst(t)))


def clip_fractions(df: DataFrame, old: str, new: str, advantage: str, mask: str, low: float = 0.2, high: float = 0.3, dual: float = 3.0) -> DataFrame:
    """One row over the tokens that count: mean divergence, and shares of tokens clipped above, and bounded below."""
    a, r = F.col(advantage), F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col(new) - F.col(old))))
    plain, near = -a * r, -a * F.greatest(F.lit(1.0 - low), F.least(F.lit(1.0 + high), r))
    counts = F.when(F.col(mask) != 0, 1.0)
    share = lambda c: F.avg(counts * c.cast("double"))
    return df.agg(F.avg(counts * (F.col(old) - F.col(new))).alias("kl"), share(plain < near).alias("clipped_above"), share((a < 0) & (F.greatest(plain, near) > -a * dual)).alias("bounded_below"))


def group_fractions(df: DataFrame, flags: dict[str, Column], tokens: str) -> DataFrame:
    """One row: for each flag the share of rows that have it, and the share of all tokens that those rows hold."""
    n = F.col(tokens).cast("double")
    parts = [x for k, f in flags.items() for x in (F.avg(f.cast("double")).alias(f"{k}_rows"), F.try_divide(F.sum(F.when(f, n).otherwise(0.0)), F.sum(n)).alias(f"{k}_tokens"))]
    return df.agg(F.count(F.lit(1)).alias("rows"), *parts)


def validation_rollup(df: DataFrame, task: str, level: str, scores: list[str]) -> DataFrame:
    """Means of the scores by task, by level and over all (null names), each with its number of rows; 'macro' is the mean of the tasks' means."""
    sets = df.groupingSets([[F.col(task)], [F.col(level)], []], F.col(task), F.col(level)).agg(F.count(F.lit(1)).alias("rows"), *(F.avg(c).alias(c) for c in scores))
    tasks = df.groupBy(task).agg(*(F.avg(c).alias(c) for c in scores))
    macro = tasks.agg(F.lit("macro").alias(task), F.lit(None).cast("string").alias(level), F.count(F.lit(1)).alias("rows"), *(F.avg(c).alias(c) for c in scores))
    return sets.unionByName(macro)


REWARDS: dict = {}


def register_reward(name: str, function) -> None:
    """Make a reward known by name: a function (response, truth) -> struct or number Column; a table of rewards can be scored by several."""
    REWARDS[name] = function


def reward_from_file(path: str, function: str = "score"):
    """The reward function of that name in a Python file of Column expressions."""
    import runpy

    return runpy.run_path(path)[function]


def scored(df: DataFrame, reward: str, response: str, truth: str, out: str = "reward") -> DataFrame:
    """Adds the registered reward's value."""
    return df.withColumn(out, REWARDS[reward](F.col(response), F.col(truth)))


def value_loss(value: Column, target: Column, old: Column, clip: float) -> Column:
    near = F.greatest(old - clip, F.least(old + clip, value))
    return 0.5 * F.greatest((value - target) * (value - target), (near - target) * (near - target))


def online_filter(df: DataFrame, group: str, score: str, low: float, high: float) -> DataFrame:
    """Rows of the groups whose mean lies strictly between."""
    mean = F.avg(score).over(Window.partitionBy(group))
    return df.withColumn("__m", mean).where((F.col("__m") > low) & (F.col("__m") < high)).drop("__m")


def rank_in_group(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)))


def ema(values: Column) -> Column:
    """Smoothed array, seeded with the first value; the weight follows the length: 1.8 (sigmoid(0.05 n) - 0.5)."""
    weight = 1.8 * (1.0 / (1.0 + F.exp(-0.05 * F.size(values))) - 0.5)
    zero = F.struct(F.try_element_at(values, F.lit(1)).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        y = (acc["last"] * weight + (1.0 - weight) * x).cast("double")
        return F.struct(y.alias("last"), F.concat(acc["out"], F.array(y)).alias("out"))

    return F.aggregate(values, zero, step)["out"]


def adaptive_kl(current: float, target: float, coefficient: float, steps: int, horizon: float) -> float:
    """The next coefficient of an adaptive penalty: the error is clipped to 0.2 either way."""
    error = max(-0.2, min(0.2, current / target - 1))
    return coefficient * (1 + error * steps / horizon)


def reasoning_mask(tokens: Column, start: Column, end: Column) -> Column:
    """Array of 1 for the tokens strictly between the first start and the next end token, else 0."""
    a = F.array_position(tokens, start)
    b = F.array_position(F.slice(tokens, F.greatest(a, F.lit(1)).cast("int"), F.size(tokens)), end) + a - 1
    return F.transform(tokens, lambda _, i: F.when((a > 0) & (b > a) & (i + 1 > a) & (i + 1 < b), 1).otherwise(0))
