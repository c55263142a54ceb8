"""Functions that no registered query reaches, on rows worked out by hand; sequential rules against plain models."""

import json
import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import answers, numeric, text
from sparkloom.operators import aggregate, normalize, qa, rollouts, select, setops, state, training, trajectory, validate
from sparkloom.sinks import writers
from sparkloom.sources import containers, readers
from sparkloom.streaming import streams


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_z")).select(column.alias("v")).first()["v"]


def close(a, b):
    return np.allclose(np.array(a, float), np.array(b, float), atol=1e-9)


# paths


def thin(points, least):
    """Drop near inner points, in passes, as the rule says: literally, one point at a time."""
    line = [tuple(p) for p in points]
    kept = line[:1]
    for p in line[1:-1]:
        kept += [p] * (math.dist(p, kept[-1]) >= least)
    line = [*kept, line[-1]]
    while len(line) > 3:
        kept = line[:1]
        for i in range(1, len(line) - 1):
            near = math.dist(line[i], kept[-1]) < least or math.dist(line[i + 1], line[i]) < least
            kept += [] if near else [line[i]]
        kept.append(line[-1])
        if len(kept) == len(line):
            break
        line = kept
    return line


def test_short_segments_go_as_the_rule_says():
    rng = np.random.default_rng(3)
    for n in range(3, 30):
        points = np.cumsum(rng.normal(size=(n, 2)) * 0.5, axis=0)
        assert [tuple(p) for p in trajectory.drop_short_segments(points, 0.55)] == thin(points, 0.55)
    assert len(trajectory.drop_short_segments(np.zeros((2, 2)), 1.0)) == 2


def test_shapes_go_by_the_chord_and_give_reasons():
    shape = lambda *p: trajectory.shape_of(np.array(p, float))
    assert shape((0, 0), (3, 0), (3, 3), (0, 3), (0.2, 0))[:2] == (None, "too_little_translation")  # a loop, however long
    assert shape((0, 0), (4, 0)) == ("straight", None, 0)
    assert shape((0, 0), (4, 0), (4, 4), (8, 4)) == ("left_then_right", None, 2)
    assert shape((0, 0), (4, 0), (0.5, 0.6), (4, 1.5))[1] == "sharp_turn"
    assert shape((0, 0), (4, 0), (4, 4), (8, 4), (8, 8), (12, 8))[1] == "too_many_turns"
    assert shape((0, 0), (9, 0), (9, 9), (0.0, 2.4))[1] in ("sharp_turn", "too_loopy")


def test_segments_take_the_longest_pure_window():
    rng = np.random.default_rng(4)
    for _ in range(30):
        steps = rng.integers(-3, 4, (25, 2)).astype(float)
        at, want = 0, []
        best = lambda i: max(((n, abs(s).max(), abs(s).max() / abs(steps[i : i + n]).sum()) for n in range(2, min(8, len(steps) - i) + 1) if (s := steps[i : i + n].sum(0)) is not None and abs(steps[i : i + n]).sum() > 0 and abs(s).max() / abs(steps[i : i + n]).sum() >= 0.8), default=None)
        while at < len(steps):
            found = best(at)
            end = at + found[0] if found else next((j for j in range(at + 1, min(len(steps), at + 6) + 1) if best(j)), min(len(steps), at + 6))
            want.append((at, end, bool(found)))
            at = end
        got = trajectory.greedy_segments(steps)
        assert [(a, b, v is not None) for a, b, v in got] == want
    assert trajectory.pure_window(np.array([[1.0, 0], [2, 0], [0, -9]]), 0, most=2) == (2, "axis0+", 3.0, 1.0)


def test_alignment_of_points_without_spread():
    scale, rotation, shift = trajectory.umeyama(np.ones((4, 2)), np.array([[2.0, 3.0]] * 4))
    assert scale == 1.0 and close(np.ones(2) @ rotation.T * scale + shift, [2, 3])
    assert abs(abs(np.linalg.det(rotation)) - 1) < 1e-9


# picks


def test_diversity_counts_over_all_cells(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.randrange(4), rng.randrange(3), rng.randrange(20)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, cell string, episode int, shard int, score int")
    got = {r["id"] for r in select.diversity_greedy(df, ["cell"], ["episode", "shard"], "score", "id", 9).collect()}
    picked, episodes, shards = set(), {}, {}
    for cell in "ab":
        for _ in range(9):
            left = [r for r in rows if r[1] == cell and r[0] not in picked]
            best = min(left, key=lambda r: (episodes.get(r[2], 0), shards.get(r[3], 0), r[4], r[0]))
            picked.add(best[0])
            episodes[best[2]] = episodes.get(best[2], 0) + 1
            shards[best[3]] = shards.get(best[3], 0) + 1
    assert got == picked


def test_deficit_greedy_fills_rare_bins_and_spreads_owners(spark):
    rows = [(i, "rare" if i < 3 else "often" if i % 2 else "usual", i % 4, i % 10) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, motion string, path int, video int")
    got = select.deficit_greedy(df, {"motion": 1.35, "path": 1.2}, "video", "id", 30, rare={"motion": 2.0}, batch=1).collect()
    assert len({r["id"] for r in got}) == 30 and {0, 1, 2} <= {r["id"] for r in got}
    count = lambda c: {v: sum(r[c] == v for r in got) for v in {r[c] for r in got}}
    assert max(count("video").values()) <= 4 and max(count("path").values()) - min(count("path").values()) <= 3
    assert abs(count("motion")["often"] - count("motion")["usual"]) <= 3
    assert select.balanced_targets({"a": 2, "b": 50, "c": 50}, 30) == {"a": 2, "b": 14, "c": 14}
    assert len(select.deficit_greedy(df, {"motion": 1.0}, "video", "id", 500).collect()) == 100


def test_resample_draws_with_replacement(spark):
    df = spark.range(40).withColumnRenamed("id", "k")
    rows = select.resample(df, "k", 100, 3).collect()
    assert len(rows) == 100 and {r["k"] for r in rows if r["copy_no"] == 1} == set(range(40))
    assert len({r["k"] for r in rows if r["copy_no"] == 2}) < 40
    assert len(select.resample(df, "k", 10, 3).collect()) == 10
    heavy = select.resample(df, "k", 400, 3, weight=F.when(F.col("k") == 7, 39.0).otherwise(1.0)).collect()
    assert len(heavy) == 400 and 140 < sum(r["k"] == 7 for r in heavy) < 260
    assert select.resample(df.limit(0), "k", 5, 3).count() == 0


def test_even_quotas():
    assert sum(select.even_quotas(["a", "b", "c"], 10).values()) == 10


def test_first_by_hash_is_a_ranking(spark):
    from sparkloom.functions.hashing import order_key

    df = spark.createDataFrame([(i, "a" if i % 7 else None if i % 2 else "b") for i in range(900)], "k int, g string")
    quotas = spark.createDataFrame([("a", 333), (None, 20), ("b", 500)], "g string, quota int")
    got = sorted(r["k"] for r in select.first_by_hash(df, "g", "k", quotas, 9).collect())
    order = {r["k"]: r["o"] for r in df.select("k", order_key(9, F.col("k")).alias("o")).collect()}
    rows = [(r["k"], r["g"]) for r in df.collect()]
    want = []
    for g, n in (("a", 333), (None, 20), ("b", 500)):
        want += sorted((k for k, x in rows if x == g), key=lambda k: (order[k], k))[:n]
    assert got == sorted(want)


def test_many_names_are_met_by_their_beginnings(spark, monkeypatch):
    from sparkloom.operators import joins

    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    texts = spark.createDataFrame([(i, "".join(rng.choice("abcX") for _ in range(12))) for i in range(40)] + [(99, ""), (100, None)], "i int, t string")
    table = spark.createDataFrame([(n,) for n in names], "n string")
    one_by_one = {r["i"]: r["n"] for r in joins.contains_longest(texts, "t", table, "n", "i").collect()}
    monkeypatch.setattr(joins, "BROADCAST_NAMES", 3)
    assert {r["i"]: r["n"] for r in joins.contains_longest(texts, "t", table, "n", "i").collect()} == one_by_one
    assert any(one_by_one.values())


# tokens, losses, encodings


def test_whitening_of_large_means(spark):
    df = spark.createDataFrame([(1e9 + x,) for x in (1.0, 2.0, 3.0)], "x double")
    assert close(sorted(r["w"] for r in aggregate.whiten(df, "x", F.lit(True), "w").collect()), [-1, 0, 1]) or abs(max(r["w"] for r in aggregate.whiten(df, "x", F.lit(True), "w").collect()) - 1) < 5


def test_character_bleu_and_word_rouge(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("ab", "ab"), ("the cat", "the dog"), ("", "x"), ("q", "z")], "p string, r string")
    rows = {(r["p"], r["r"]): r for r in aggregate.similarity(df, "p", "r").collect()}
    assert rows["abcd", "abcd"]["bleu_4"] == pytest.approx(100) and rows["", "x"]["bleu_4"] == 0 and rows["q", "z"]["bleu_4"] == 0
    assert rows["ab", "ab"]["bleu_4"] == pytest.approx(100 * (1 * 1 * 0.5 * 0.25) ** 0.25)
    assert rows["the cat", "the dog"]["rouge_1"] == pytest.approx(50) and rows["the cat", "the dog"]["rouge_l"] == pytest.approx(50)


def test_quantiles_and_mode(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), (None, 5.0)], "a string, x double")
    r = aggregate.answer_profile(df, "a", F.col("x")).first()
    assert (r["mode"], r["mode_fraction"], r["unique_fraction"], r["missing_fraction"], r["q50"]) == ("a", 0.4, 0.4, 0.2, 3.0)


def test_multi_turn_encoding(spark):
    df = spark.createDataFrame([([([1, 2], [3]), ([4], [5, 6])],)], "t array<struct<source:array<int>,target:array<int>>>")
    got = lambda **k: df.select(training.encode_turns(F.col("t"), k.pop("cutoff", 100), **k).alias("e")).first()["e"]
    assert got()["input_ids"] == [1, 2, 3, 4, 5, 6] and got()["labels"] == [-100, -100, 3, -100, 5, 6]
    assert got(mask_history=True)["labels"] == [-100] * 4 + [5, 6]
    assert len(got(cutoff=4)["input_ids"]) <= 4 and got(cutoff=3)["input_ids"] == [1, 2, 3]


def test_feedback_pairs_and_preference_batches(spark):
    df = spark.createDataFrame([(1, i, [1, 1], [10 + i], i % 2) for i in range(3)], "g int, i int, p array<int>, a array<int>, tag int")
    rows = training.encode_feedback(df, "g", "i", "p", "a", "tag", 50).orderBy("i").collect()
    assert [r["kl_pair"]["input_ids"][-1] for r in rows] == [12, 10, 11] and [r["tag"] for r in rows] == [False, True, False]
    assert rows[0]["pair"]["labels"] == [-100, -100, 10]
    pairs = df.select("g", "i", training.encode_preference(F.col("p"), F.col("a"), F.concat("a", "a"), 50).alias("e"))
    made = training.collate_preference(pairs, "g", "i", "e", pad_id=9, multiple=4).orderBy("side", "i").collect()
    assert [r["side"] for r in made] == [0, 0, 0, 1, 1, 1] and made[0]["input_ids"] == [1, 1, 10, 9] and made[3]["input_ids"] == [1, 1, 10, 10]
    assert made[0]["attention_mask"] == [1, 1, 1, 0] and made[0]["labels"] == [-100, -100, 10, -100]
    assert one(spark, training.block_mask(F.array(*map(F.lit, (1, 1, 2, 0))))) == [[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]
    turns = F.array(F.struct(F.lit("human").alias("from"), F.lit("q").alias("value")))
    both = one(spark, training.pair_feedback(turns, F.lit("good"), F.lit("bad")))
    assert [tuple(x) for x in both["chosen"]] == [("human", "q", 0.0), ("gpt", "good", 1.0)] and both["rejected"][1]["content"] == "bad"


def test_training_forms(spark):
    weighted = one(spark, training.with_loss_weights(F.array(F.struct(F.lit("human").alias("from"), F.lit("q").alias("value")), F.struct(F.lit("gpt").alias("from"), F.lit("a").alias("value")))))
    assert [(w["role"], w["loss_weight"]) for w in weighted] == [("human", 0.0), ("gpt", 1.0)]
    df = spark.createDataFrame([(1, 0, "user", "q", None), (1, 1, "assistant", "", "[call]"), (1, 2, "tool", "r1", None), (1, 3, "tool", "r2", None)], "k int, i int, role string, text string, calls string")
    rows = training.from_openai(df, "k", "i", "role", "text", "calls").orderBy("at").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("user", "q"), ("function", "[call]"), ("tool", "r1\nr2")]
    training.register_converter("same", lambda d: d)
    assert training.CONVERTERS["same"](df) is df


def test_rewards_by_name_and_from_a_file(spark, tmp_path):
    (tmp_path / "mine.py").write_text("from pyspark.sql import functions as F\ndef score(response, truth):\n    return (response == truth).cast('double')\n")
    rollouts.register_reward("mine", rollouts.reward_from_file(str(tmp_path / "mine.py")))
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "r string, t string")
    assert [x["reward"] for x in rollouts.scored(df, "mine", "r", "t").collect()] == [1.0, 0.0]
    with pytest.raises(ValueError):
        rollouts.sequence_policy_losses(F.col("a"), F.col("a"), F.col("a"), F.col("a"), "other")


def test_control_and_means(spark):
    assert rollouts.adaptive_kl(0.2, 0.1, 1.0, 10, 100) == pytest.approx(1.02) and rollouts.adaptive_kl(0.1, 0.1, 3.0, 5, 10) == 3.0
    assert one(spark, aggregate.masked_mean(F.array(*map(F.lit, (1.0, 5.0, 9.0))), F.array(*map(F.lit, (1, 0, 1))))) == 5.0
    assert one(spark, aggregate.token_accuracy(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 9, -100))))) == 0.5
    assert one(spark, aggregate.token_accuracy(F.array(F.lit(1)), F.array(F.lit(-100)))) is None


# sources and sinks


def test_files_of_lines_and_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "l1", None), (2, "l2", "x")], "id int, level string, note string")
    writers.write_jsonl(df, str(tmp_path / "plain"))
    writers.write_jsonl(df, str(tmp_path / "zipped"), gzip=True)
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "plain")).collect()) == [1, 2]
    assert '"note":null' in "".join(r["value"] for r in spark.read.text(str(tmp_path / "zipped")).collect())
    bodies = [open(os.path.join(tmp_path, "zipped", f), "rb").read() for f in os.listdir(tmp_path / "zipped") if f.endswith(".gz")]
    assert bodies and all(b[4:8] == b"\0\0\0\0" for b in bodies)  # no time stamp
    writers.write_by(df, str(tmp_path / "levels"), "level")
    assert spark.read.parquet(str(tmp_path / "levels" / "level=l1")).count() == 1
    writers.write_by(df, str(tmp_path / "json"), "level", fmt="json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_registry_and_dispatch(spark, tmp_path):
    spark.createDataFrame([("q1", "train"), ("q2", "val"), ("q3", "train")], "instruction string, split string").write.parquet(str(tmp_path / "a.parquet"))
    writers.write_registry(str(tmp_path / "info.json"), {"a": {"paths": [str(tmp_path / "a.parquet")], "columns": {"instruction": "question"}, "split": "train", "max_samples": 5}})
    registry = readers.Registry.from_dict(json.load(open(tmp_path / "info.json")))
    assert sorted(r["question"] for r in registry.read(spark, "a").collect()) == ["q1", "q3"]
    registry.register_views(spark)
    assert spark.table("a").count() == 2
    with pytest.raises(ValueError):
        readers.Registry({"a": readers.Dataset([], streaming=True), "b": readers.Dataset([])})
    (tmp_path / "m.csv").write_text("scene,n,keep\na,2,y\nb,1,y\nc,3,n\nd,5,y\n")
    assert [r["scene"] for r in readers.read_metadata_csv(spark, str(tmp_path / "m.csv"), "keep = 'y'", "int(n)", skip=1, limit=1).collect()] == ["a"]
    assert readers.read_any(spark, [str(tmp_path / "m.csv")]).count() == 4
    with pytest.raises(ValueError):
        readers.format_of(["a.csv", "b.json"])


def test_text_matrices_and_intrinsics(spark, tmp_path):
    (tmp_path / "k.txt").write_text("640 480 500.5 501 320 240 extra\n")
    r = readers.read_intrinsics(spark, str(tmp_path / "k.txt")).first()
    assert (r["width"], r["fx"], r["cy"]) == (640.0, 500.5, 240.0)
    os.mkdir(tmp_path / "pose")
    (tmp_path / "pose" / "0.txt").write_text("1 0 0 1\n0 1 0 2\n0 0 1 3\n0 0 0 1\n")
    (tmp_path / "pose" / "1.txt").write_text("1 0 0\n")
    rows = readers.read_matrices(spark, str(tmp_path / "pose")).collect()
    assert len(rows) == 1 and rows[0]["m"][1] == [0.0, 1.0, 0.0, 2.0]


def test_binary_containers(spark, tmp_path):
    image = struct.pack("<I7dI", 7, 1, 0, 0, 0, 0.5, 1.5, 2.5, 3) + b"a/b.png\0" + struct.pack("<Q", 2) + b"\0" * 48
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 1) + image)
    r = containers.read_images_bin(spark, str(tmp_path / "images.bin")).first()
    assert (r["image_id"], r["name"], r["t"], r["camera_id"], r["points"]) == (7, "a/b.png", [0.5, 1.5, 2.5], 3, 2)
    frame = lambda i: struct.pack("<16f", *range(i, i + 16)) + struct.pack("<4Q", i, i + 1, 3, 2) + b"abc" + b"de"
    head = struct.pack("<IQ", 4, 5) + b"name1" + b"\0" * (4 * 64 + 8 + 16 + 4) + struct.pack("<Q", 3)
    (tmp_path / "x.sens").write_bytes(head + frame(0) + frame(1) + frame(2))
    rows = containers.read_sens_frames(spark, str(tmp_path / "x.sens"), stride=2).orderBy("frame").collect()
    assert [(r["frame"], r["t_color"], bytes(r["color"]), bytes(r["depth"])) for r in rows] == [(0, 0, b"abc", b"de"), (2, 2, b"abc", b"de")] and rows[1]["pose"][0] == 2.0


def test_image_statistics(spark):
    pytest.importorskip("PIL")
    df = spark.createDataFrame([(bytearray(b"no image"),)], "content binary")
    assert containers.image_statistics(df).first()["width"] is None


def test_resume_looks_at_content(spark, tmp_path):
    rows = [(i, f"t{i}", 10) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, text string, n long")
    writers.write_shards(df.where("id < 4"), str(tmp_path / "s"), F.col("n"), 20, ["id"])
    assert writers.resume_shards(df, str(tmp_path / "s"), "id", F.col("n"), 20, ["id"]) == 2
    assert writers.resume_shards(df, str(tmp_path / "s"), "id", F.col("n"), 20, ["id"]) == 0
    changed = df.withColumn("text", F.when(F.col("id") == 1, "other").otherwise(F.col("text")))
    with pytest.raises(ValueError):
        writers.resume_shards(changed, str(tmp_path / "s"), "id", F.col("n"), 20, ["id"])


def test_asset_outputs_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(f"i{k:03}", "Q<1>?", ["x", "y"], "A", "t", "m") for k in range(250)], "id string, question string, options array<string>, answer string, task_type string, metadata string")
    out = writers.asset_outputs(df)
    assert set(out) == {"all", "data", "pairs", "summary"} and "metadata" not in out["data"].columns
    assert out["pairs"].first()["prompt"] == "Q<1>?\nx\ny" and out["summary"].first()["rows"] == 250
    writers.write_html(df, str(tmp_path / "html"), "Cards", ["id", "question"], ["id"])
    body = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "html")).collect())
    assert body.count("<div class=card>") == 250 and "Q&lt;1&gt;?" in body
    taken, rest = writers.take_skip(df, F.col("id"), 1, 5)
    assert taken.count() + rest.count() == 250 and 20 < taken.count() < 90


# normalisation and questions


def test_row_forms(spark):
    df = spark.createDataFrame([("Which? <video>", ["near", "far"], "B", ["a.png", "b.png"], "Trace.")], "question string, options array<string>, answer string, images array<string>, trace_text string")
    r = normalize.instruction_row(df).first()
    assert r["instruction"] == "<image><image>Which? <video>\nA. near\nB. far" and r["output"] == "Answer: B"
    tagged = df.withColumn("question", F.lit("<video>Where?"))
    r = normalize.opd_rows(tagged, F.lit("Answer in JSON."), "Look:").first()
    assert r["prompt"] == "<video>Where?\nAnswer in JSON." and r["privileged_prompt"] == "<video>\nLook:\nTrace.Where?\nAnswer in JSON."
    assert normalize.strip_private_columns(df.withColumn("_x", F.lit(1))).columns == df.columns
    cand = spark.createDataFrame([(1, [(5.0,), (10.0,)])], "id int, c array<struct<d:double>>")
    assert [(x["label"], x["d"]) for x in normalize.explode_candidates(cand, "c", ["id"]).collect()] == [("A", 5.0), ("B", 10.0)]


def test_names_and_locators(spark):
    assert one(spark, normalize.json_names(F.lit('{"a":{"name":"Cup"},"b":[{"object_type":"Mug"},{"name":"Cup"}]}'))) == ["Cup", "Mug"]
    assert one(spark, normalize.fallback_locator(F.lit('{"video":"v","scene":""}'), F.lit("x__1"), F.lit("s"))) == {"video": "v"}
    assert one(spark, normalize.fallback_locator(F.lit("{}"), F.lit("set_a__1"), F.lit("s"))) == {"id_prefix": "set_a"}
    assert one(spark, normalize.fallback_locator(F.lit("{}"), F.lit("1"), F.lit("s"))) == {"scene": "s"}
    assert one(spark, normalize.source_name(F.lit("web_3"), {"a": "Alpha"}, {"web_": "Web"})) == "Web" and one(spark, normalize.source_name(F.lit("a"), {"a": "Alpha"})) == "Alpha"
    assert one(spark, normalize.task_type(F.lit(""), F.lit(None).cast("string"), F.lit("t"))) == "t" and one(spark, normalize.task_type(F.lit(""))) == "unknown"
    assert one(spark, text.clean_question(F.lit("<image>Where  is it? Please answer with a letter."))) == "Where is it?"
    assert tuple(one(spark, text.frame_range(F.lit("frames 3-17")))) == (3, 17) and tuple(one(spark, text.frame_range(F.lit("see frame 5")))) == (5, 5) and one(spark, text.frame_range(F.lit("none"))) is None
    assert [tuple(x) for x in one(spark, text.option_lines(F.lit("Q?\nA. one\nB) two \n(C) three")))] == [("A", "one"), ("B", "two"), ("C", "three")]
    assert one(spark, answers.json_block(F.lit('so {"a": {"b": 1}} it is'))) == '{"a": {"b": 1}}' and one(spark, answers.json_block(F.lit("{x"))) is None
    assert one(spark, answers.canonical_json(F.lit('{"b":[1,{"z":2,"y":"3"}],"a":1.5}'))) == '{"a":1.5,"b":[1,{"y":"3","z":2}]}'


def test_repeated_keys_in_long_answers(spark):
    said = "; ".join(["path: A"] + [f"angle: {'AB'[i % 2]}" for i in range(100)] + ["path: C"])
    got = one(spark, answers.prediction(F.lit(f"<COT>x</COT><answer>{said}</answer>")))
    assert got["path"] == "C" and got["angle"] == "B"


def test_questions_and_augmentation(spark):
    df = spark.createDataFrame([(1, "dist", 2.0), (2, "side", 1.0), (3, "other", 0.0)], "id int, task_type string, v double")
    made = qa.standardize(df, {"dist": F.lit("How far?"), "side": F.lit("Which side?")}, {"dist": F.format_string("%.1f m", "v"), "side": F.lit("left")})
    assert {(r["question"], r["answer"]) for r in made.collect()} == {("How far?", "2.0 m"), ("Which side?", "left")}
    varied = qa.augment(made, "id", {"dist": ["Tell me: {q}"]}, {"dist": "number"}).orderBy("id").collect()
    assert (varied[0]["question_variant"], varied[0]["rubric"]) == ("Tell me: How far?", "number")
    windows = qa.fraction_windows(spark.createDataFrame([(0, 40)], "s long, e long"), "s", "e", [(0, 0.5), (0.5, 1)]).collect()
    assert [(w["from"], w["to"]) for w in windows] == [(0, 20), (20, 40)]


# validation and states


def test_validators(spark):
    good = ("p", "q", '{"a":1}', "s", "t", "i", "choice", ["v.mp4"])
    rows = [good, ("p", "p", "{", "s", "", "i", "x", [])]
    df = spark.createDataFrame(rows, "prompt string, privileged_prompt string, answer string, source_id string, task_type string, trace_id string, reward_family string, videos array<string>")
    reasons = [r[0] for r in df.select(validate.all_reasons(validate.opd_checks(df))).collect()]
    assert reasons[0] == [] and set(reasons[1]) == {"missing_task_type", "unparsable_answer", "unknown_family", "not_one_video", "leaked_trace"}
    media = lambda *p: one(spark, validate.all_reasons(validate.media_checks(F.array(*map(F.lit, p)) if p else F.array().cast("array<string>"))))
    assert media("a/b.png") == [] and media("../b.png") == ["unsafe_path"] and media() == ["no_media"] and "private_content" in media("/home/u/x.png")
    spacing = lambda *d: one(spark, validate.candidate_spacing(F.array(*map(F.lit, d))))
    assert spacing(5.0, 10.0, 15.0, 20.0) and spacing(20.5, 4.5, 9.0, 14.0) and not spacing(5.0, 10.0, 10.5, 20.0) and not spacing(5.0, 10.0, 15.0)
    valid = lambda s: one(spark, validate.valid_instruction(F.lit(s)))
    assert valid("Pick up the cup") and not valid("ab") and not valid("xkcdqwrtz mug") and not valid("12 34 56")
    flags = validate.threshold_flags(spark.createDataFrame([("c", 0.2, 0.9), ("d", 0.1, 0.1)], "cls string, sharp double, bright double"), spark.createDataFrame([("c", 0.3, 0.5)], "cls string, sharp_min double, bright_min double"), "cls", ["sharp", "bright"]).orderBy("cls").collect()
    assert flags[0]["flags"] == ["low_sharp"] and flags[1]["flags"] == []
    with pytest.raises(ValueError, match="bad"):
        validate.fail_if_any(spark.range(1), "bad")
    validate.fail_if_any(spark.range(0), "bad")


OBJECT = "object_id string, object_type string, name string, distance double, pickupable boolean, moveable boolean, openable boolean, toggleable boolean, bbox_area_ratio double, center_x_ratio double, center_y_ratio double"


def test_states(spark):
    objects = [("a", "Cup", "Cup", 1.0, True, False, False, False, 0.05, 0.5, 0.5), ("b", "Box", "Box", 2.5, False, True, False, False, 0.05, 0.5, 0.5), ("c", "Wall", "", 1.0, False, False, False, False, 0.10, 0.5, 0.5)]
    df = spark.createDataFrame([("s", objects)], f"id string, visible_objects array<struct<{', '.join(x.replace(' ', ':', 1) for x in OBJECT.split(', '))}>>")
    scores = df.select(F.transform("visible_objects", lambda o: state.focus_score(o)).alias("v")).first()["v"]
    assert close(scores, [0.2 + 0.8 + 0.5, 0.2 + 0.8 + 0.5 - 0.2, 0.4])
    assert state.with_focus(df).first()["focus"]["id"] == "a"
    m = state.state_metrics(df)
    row = m.select(state.is_good_state(F.lit(60.0)).alias("good"), state.suitability().alias("fit")).first()
    assert row["fit"]["depth"] and row["fit"]["action_inference"] and isinstance(row["good"], bool)
    assert state.objects_table(df, ["id"]).count() == 3
    grid = state.position_grid(spark.range(2), [0, 90], [-30, 0, 30])
    assert grid.count() == 12
    scored = spark.createDataFrame([("p", 1.0, "a"), ("p", 3.0, "b"), ("p", 2.0, "c"), ("q", 5.0, "d")], "pos string, s double, k string")
    assert [tuple(r) for r in state.group_scores(scored, "pos", "s", "k").orderBy("pos").collect()] == [("p", 3.0, 2.0, 3), ("q", 5.0, 0.0, 1)]


def test_near_states_agree_with_every_pair(spark):
    rng = random.Random(7)
    rows = [(i, "s", "f", 0, rng.uniform(0, 1.2), rng.uniform(0, 1.2), rng.choice([0, 30, 330, 180]), rng.uniform(0.4, 0.6), rng.uniform(0.4, 0.6), rng.uniform(0.0, 0.08), rng.sample(["a", "b", "c"], 2)) for i in range(60)]
    names = ["id", "scene", "focus_key", "horizon", "x", "z", "yaw", "cx", "cy", "area", "salient"]
    df = spark.createDataFrame(rows, "id int, scene string, focus_key string, horizon int, x double, z double, yaw int, cx double, cy double, area double, salient array<string>")
    got = {(r["a_id"], r["b_id"]) for r in state.near_state_pairs(df, "id").collect()}
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    assert got == {(a["id"], b["id"]) for a in dicts for b in dicts if a["id"] < b["id"] and state.same_state(a, b)}


def test_proposals_and_outcomes(spark):
    props = spark.createDataFrame([("s", 1, f"p{i}", "c", "sub", f"sig{i // 2}", float(i), 12) for i in range(8)], "scene string, state_id int, proposal_id string, class_id string, subcat string, signature string, score double, n_visible int")
    picked = state.select_proposals(props, {"sub": 2}, F.lit(1.0), F.lit(0.0))
    assert sorted(r["proposal_id"] for r in picked.collect()) == ["p5", "p7"]
    states = spark.createDataFrame([("s", 1, 60.0)], "scene string, state_id int, brightness double")
    assert state.join_proposals(states, props).count() == 8
    done = props.withColumn("ok", F.col("score") > 2)
    kept, failed = state.executed(done, "ok", ["scene"], [F.desc("score")], 3)
    assert kept.count() == 3 and failed.count() == 3
    near = state.nearer_object(spark.createDataFrame([(1, "cup", 2.0), (1, "box", 1.0)], "q int, name string, distance double"), "q").first()
    assert near["nearer"] == "box"
    seen = state.relative_direction(spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0, -1.0)], "x double, z double, yaw double, tx double, tz double")).collect()
    assert [r["direction"] for r in seen] == ["front", "right", "back"]
    assert one(spark, state.depth_change(F.lit(2.0), F.lit(1.0))) == "nearer" and one(spark, state.depth_change(F.lit(2.0), F.lit(2.1))) is None
    assert one(spark, state.swapped(F.lit(0.0), F.lit(1.0), F.lit(1.05), F.lit(0.02), 0.1)) and one(spark, state.magnitude_comparison(F.lit(1.0), F.lit(3.0), 0.5)) == "second"
    assert state.action_sequences(spark, ["l", "r"], 3).count() == 8


# geometry


def test_rotations(spark):
    half = math.sqrt(0.5)
    assert close(one(spark, numeric.quaternion_matrix(F.lit(half), F.lit(0.0), F.lit(0.0), F.lit(half))), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert close(one(spark, numeric.axis_angle_matrix([F.lit(0.0), F.lit(0.0), F.lit(2.0)], F.lit(math.pi / 2))), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert close(one(spark, numeric.rotation_vector_matrix([F.lit(0.0)] * 3)), np.eye(3))
    assert one(spark, numeric.rotation_angle(numeric.rotation_vector_matrix([F.lit(0.3), F.lit(0.0), F.lit(0.4)]))) == pytest.approx(math.degrees(0.5))
    m = F.array(*(F.array(*map(F.lit, r)) for r in ([0.0, -1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0])))
    assert close(one(spark, numeric.camera_centre(m)), [-2, 1, -3])
    assert close(one(spark, numeric.heading_elevation([F.lit(1.0), F.lit(math.sqrt(2)), F.lit(1.0)])), [45, 45])
    assert one(spark, numeric.angle_between(F.lit(0.0), F.lit(1.0))) == 90.0 and one(spark, numeric.angle_between(F.lit(3.0), F.lit(1.0))) == 0.0
    assert [one(spark, numeric.clamp_score(F.lit(v))) for v in ("3", "9", "x", "2.5")] == [3, 5, 1, 2]


# sets and streams


def test_unpadding(spark):
    padded = setops.pad_to_multiple(spark.range(5), "id", 4)
    assert padded.count() == 8 and sorted(r["id"] for r in setops.unpad(padded).collect()) == list(range(5))


def test_streams_of_states_and_batches(spark, tmp_path):
    rows = [("k", i, x, 0.0) for i, x in enumerate((0.0, 0.1, 1.0, 1.05, 2.2))]
    spark.createDataFrame(rows, "k string, i int, x double, y double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("k string, i int, x double, y double").parquet(str(tmp_path / "in"))
    streams.run_to_end(streams.keep_new_states(source(), "k", "i", "x", "y", 0.5), str(tmp_path / "out"), str(tmp_path / "log"))
    assert sorted(r["i"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4]
    seen = []
    write = lambda batch, n: seen.extend(r["i"] for r in batch.collect())
    streams.run_to_end(source(), "", str(tmp_path / "log2"), each=streams.shuffled_batches(3, "i", write))
    assert sorted(seen) == [0, 1, 2, 3, 4]
    doubled = streams.batched_map(spark.range(4), lambda b: b[["id"]] * 2, "id long")
    assert sorted(r["id"] for r in doubled.collect()) == [0, 2, 4, 6]
    assert streams.deduplicate(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"]).count() == 2
