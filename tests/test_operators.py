"""Behaviour on small fixtures: parsing, selection, packing, trajectories, sources, sinks, streams."""

import gzip
import json
import os
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import answers, numeric, text
from sparkloom.operators import normalize, rollouts, select, training, trajectory, validate
from sparkloom.sinks import writers
from sparkloom.sources import containers, readers
from sparkloom.streaming import streams


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_rewards_follow_their_formula(spark):
    """Numbers score by relative accuracy, letters by equality, fields by their share; a tenth is for form."""
    rows, weight = [], answers.FORMAT_WEIGHT
    for said, gold in ((12.0, 10.0), (9.0, 10.0), (30.0, 10.0), (-4.0, 5.0)):
        task = max(0.0, 1 - abs(said - gold) / abs(gold))
        rows.append((f"<COT>measured</COT><answer>{said}</answer>", {"reward_family": "numeric_mra", "value": gold}, task, 1))
        rows.append((f"answer: {said}", {"reward_family": "numeric_mra", "value": gold}, task, 0))
    for said in "ABE":
        rows.append((f"<COT>I compared them.</COT><answer>{said.lower()}</answer>", {"reward_family": "choice", "choice_gold": "E"}, float(said == "E"), 1))
        rows.append((said, {"choice_gold": "E"}, float(said == "E"), 0))
    for right in range(4):
        said = {k: "D" if i < right else "A" for i, k in enumerate(("straight", "angle", "path"))}
        rows.append((f"<COT>three parts</COT><answer>{json.dumps(said)}</answer>", {"reward_family": "multi_choice", "fields": dict.fromkeys(said, "D")}, right / 3, 1))
    rows += [("", {"choice_gold": "B"}, 0.0, 0), (None, {"reward_family": "numeric_mra", "value": 3}, 0.0, 0)]
    df = spark.createDataFrame([(i, r, json.dumps(t)) for i, (r, t, _, _) in enumerate(rows)], "i int, r string, t string")
    for row in answers.with_score(df, "r", "t").orderBy("i").collect():
        _, _, task, form = rows[row["i"]]
        assert row["score"]["task"] == pytest.approx(task), rows[row["i"]]
        assert row["score"]["overall"] == pytest.approx((1 - weight) * task + weight * form), rows[row["i"]]


def test_trace_and_paths(spark):
    good = "\n".join(f"[{a}-{b}]: " + "word " * 30 for a, b in text.TRACE_SPANS)
    assert one(spark, text.trace_is_valid(F.lit(good)))
    assert not one(spark, text.trace_is_valid(F.lit(good.replace("[09-16]", "[09-17]"))))
    assert one(spark, text.canonical_path(F.lit("a/./b//../c"))) == "a/c"
    assert one(spark, text.canonical_path(F.lit("../a"))) is None
    assert one(spark, text.unsafe_path(F.lit("a/../b")))


def test_normalised_turns(spark):
    df = spark.createDataFrame([(1, [("user", None, "hi", None), (None, "assistant", None, "yo"), ("robot", None, "x", None)])], "id int, t array<struct<`from`:string,role:string,value:string,content:string>>")
    turns = df.select(normalize.normalize_turns(F.col("t")).alias("t")).first()["t"]
    assert [tuple(x) for x in turns] == [("human", "hi"), ("gpt", "yo")]


def test_redaction_is_recursive(spark):
    df = spark.createDataFrame([(1, '{"a":["/home/u/x","ok"],"b":{"c":"/home/y"}}'), (2, None)], "i int, j string")
    rows = {r["i"]: r["j"] for r in normalize.redact_json(df, "j").collect()}
    assert json.loads(rows[1]) == {"a": ["ok"], "b": {}} and rows[2] is None


def test_release_rows_are_idempotent(spark):
    meta = '{"task_type":"x","source":"s"}'
    df = spark.createDataFrame([("a", [("human", "q")], ["/data/p/a.png"], None, meta)], "id string, conversations array<struct<`from`:string,value:string>>, images array<string>, videos array<string>, metadata string")
    row = normalize.release_rows(df, full=True).first()
    assert row["media_paths"] == ["p/a.png"] and row["media_type"] == "image" and row["metadata_json"] == meta


def test_option_checks_give_the_first_reason(spark):
    options = [("A", "x"), ("B", "y"), ("C", "z"), ("D", "x")]
    df = spark.createDataFrame([("q", options, "A", "x"), ("q", [("A", "x"), ("B", "y"), ("C", "z"), ("D", "w")], "B", "y")], "q string, o array<struct<label:string,text:string>>, a string, t string")
    got = [r[0] for r in df.select(validate.first_reason(validate.option_checks(F.col("q"), F.col("o"), F.col("a"), F.col("t")))).collect()]
    assert got == ["duplicate_options", None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(20, 60))
def test_packing_fits_and_keeps_all(lengths, capacity):
    bins = training.greedy_pack(lengths, capacity)
    for b in set(bins) - {-1}:
        assert sum(n for n, x in zip(lengths, bins, strict=True) if x == b) <= capacity
    assert all((b == -1) == (n > capacity) for n, b in zip(lengths, bins, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=8, max_size=60), st.integers(2, 5))
def test_differencing_keeps_all_and_sizes(lengths, k):
    parts = select.differencing(lengths, k)
    assert len(parts) == len(lengths) and set(parts) <= set(range(k))
    n = len(lengths) // k * k
    sizes = np.bincount(select.differencing(lengths[:n], k, True), minlength=k)
    assert sizes.max() == sizes.min()
    sums = [sum(x for x, p in zip(lengths, parts, strict=True) if p == j) for j in range(k)]
    assert max(sums) - min(sums) <= max(lengths)


@given(st.dictionaries(st.text(max_size=3), st.integers(0, 30), min_size=1, max_size=6), st.integers(0, 100))
def test_capped_quotas(available, total):
    q = select.capped_quotas(available, total)
    assert sum(q.values()) == min(total, sum(available.values())) and all(q[k] <= available[k] for k in q)


def test_line_simplification_bounds_the_error():
    points = np.cumsum(np.random.default_rng(2).normal(size=(80, 2)), axis=0)
    kept = trajectory.rdp(points, 0.8)
    for a, b in zip(kept[:-1], kept[1:], strict=True):
        chord = points[b] - points[a]
        for p in points[a : b + 1] - points[a]:
            assert abs(chord[0] * p[1] - chord[1] * p[0]) / max(np.hypot(*chord), 1e-9) <= 0.8 + 1e-9


def test_shapes():
    left = np.array([[0, 0], [1, 0], [2, 0], [2, 1], [2, 2]], float)
    assert trajectory.shape_of(left)[0] == "left"
    assert trajectory.shape_of(left * [1, -1])[0] == "right"
    assert trajectory.shape_of(np.array([[0, 0], [3, 0]], float))[0] == "straight"
    assert trajectory.shape_of(np.array([[0, 0], [0.1, 0]], float))[1] == "too_little_translation"


def test_similarity_is_recovered():
    a = np.random.default_rng(1).normal(size=(20, 3))
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    scale, rotation, shift = trajectory.umeyama(a, 2.5 * a @ q.T + [1, 2, 3])
    assert scale == pytest.approx(2.5) and np.allclose(rotation, q) and np.allclose(shift, [1, 2, 3])


def test_divergences_are_not_negative(spark):
    rng = random.Random(4)
    for _ in range(5):
        p, q = ([rng.random() + 0.01 for _ in range(6)] for _ in range(2))
        logs = [[float(np.log(x / sum(v))) for x in v] for v in (p, q)]
        value = one(spark, rollouts.topk_forward_kl(F.array(*map(F.lit, logs[0])), F.array(*map(F.lit, logs[1]))))
        assert value >= 0
    assert one(spark, rollouts.topk_forward_kl(F.array(F.lit(-1.0)), F.array(F.lit(-1.0)))) == 0


def test_bins_and_standards(spark):
    assert [one(spark, numeric.bin_index(F.lit(v), [0, 3, 6])) for v in (-1.0, 2.9, 3.0, 99.0)] == [0, 0, 1, 2]
    assert one(spark, numeric.nearest_standard(F.lit(7.5), [5, 10], 3.0)) == 5.0
    assert one(spark, numeric.nearest_standard(F.lit(25.0), [5, 10], 2.0)) is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1"}\n\n{"id":"2"}\nnope\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id":"3"}\n')
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id string")
    rows, rejects = readers.read_rows_or_rejects(spark, str(tmp_path), schema)
    assert sorted((r["id"], r["line_no"]) for r in rows.collect()) == [("1", 1), ("2", 3), ("3", 1)]
    assert [r["line_no"] for r in rejects.collect()] == [4]
    with pytest.raises(Exception, match="is not an object"):
        readers.read_rows(spark, str(tmp_path / "a.jsonl"), schema).collect()
    with pytest.raises(ValueError):
        readers.format_of(["a.csv", "b.parquet"])
    (tmp_path / "p.json").write_text('{"data":[{"id":"x"},{"id":"y"}]}')
    assert readers.read_payloads(spark, str(tmp_path / "p.json"), schema).count() == 2
    (tmp_path / "t.traj").write_text("0 1 2 3 4 5 6\nbad line\n1 1 2 3 4 5 7\n")
    assert [r["z"] for r in readers.read_trajectory(spark, str(tmp_path / "t.traj")).orderBy("t").collect()] == [6.0, 7.0]
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("f/0012.jpg", b"abc")
    assert containers.read_zip_members(spark, str(tmp_path / "v.zip")).first()["number"] == 12
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, str(tmp_path) + "/s{shard}of{n}.jsonl", 2, schema)


def test_sharded_write_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (10 + i)) for i in range(20)], "id int, t string")
    path = str(tmp_path / "out")
    writers.write_shards(df.where("id < 12"), path, F.length("t").cast("long"), 60, ["id"])
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum(F.length("t")).alias("s")).collect()
    assert all(r["s"] <= 60 for r in sizes)
    assert writers.resume_shards(df, path, "id", F.length("t").cast("long"), 60, ["id"]) == 8
    assert writers.resume_shards(df, path, "id", F.length("t").cast("long"), 60, ["id"]) == 0
    assert spark.read.parquet(path).count() == 20
    with pytest.raises(ValueError):
        writers.resume_shards(df.where("id > 0"), path, "id", F.length("t").cast("long"), 60, ["id"])
    assert writers.append_missing(df.select("id"), _table(spark, tmp_path, df.where("id < 5").select("id")), "id") == 15


def _table(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "ids"))
    return str(tmp_path / "ids")


def test_tar_shards_and_summary(spark):
    files = spark.createDataFrame([("b", bytearray(b"22")), ("a", bytearray(b"1")), ("c", bytearray(b"333"))], "n string, c binary")
    rows = writers.tar_shards(files, "n", "c", 3).orderBy("shard").collect()
    assert [r["members"] for r in rows] == [2, 1]
    row = writers.summary(spark.createDataFrame([("x", 1), ("x", 2), ("y", 2)], "k string, v int"), ["k", "v"]).first()
    assert row["rows"] == 3 and json.loads(row["k"]) == {"x": 2, "y": 1} and json.loads(row["v"]) == {"1": 1, "2": 2}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("k", f"i{i}", 10) for i in range(7)] + [("k", "i0", 10)], "k string, i string, n int").coalesce(1).write.parquet(src)
    stream = streams.file_stream(spark, src, spark.read.parquet(src).schema)
    out = str(tmp_path / "out")
    streams.run_to_end(stream, out, str(tmp_path / "log"), each=streams.append_new(out, "i"))
    assert spark.read.parquet(out).count() == 7
    streams.run_to_end(stream, out, str(tmp_path / "log2"), each=streams.append_new(out, "i"))
    assert spark.read.parquet(out).count() == 7
    batches = streams.token_batches(stream, "k", "i", "n", 30)
    streams.run_to_end(batches, str(tmp_path / "b"), str(tmp_path / "log3"))
    assert [r["tokens"] for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [30, 30]


def test_first_wins_and_split(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, k string")
    assert sorted(r["i"] for r in select.first_by(df, ["k"], ["i"]).collect()) == [1, 3]
    split = select.hash_split(df, F.col("k"), 1, 0.0)
    assert {r["k"] for r in split.where("split = 'val'").collect()} == {"b"}


def test_tool_calls_and_masks(spark):
    calls = one(spark, training.tool_calls(F.lit('Action: look\nAction Input: {"x": 1}\nAction: go\nAction Input: {}')))
    assert [tuple(c) for c in calls] == [("look", '{"x": 1}'), ("go", "{}")]
    mask = one(spark, rollouts.reasoning_mask(F.array(*map(F.lit, [5, 1, 7, 8, 2, 9])), F.lit(1), F.lit(2)))
    assert mask == [0, 0, 1, 1, 0, 0]


def test_packed_sequences_hold_every_line(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    rows = __spark_entry__.queries()["packed_sequences"](spark, sf).collect()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.sum(F.col("l_quantity").cast("int")).alias("tokens"), F.count_distinct("l_orderkey").alias("orders")).first()
    ends = [[int(x) for x in r["boundaries"].split(",")] for r in rows]
    assert sum(e[-1] for e in ends) == lines["tokens"] and max(e[-1] for e in ends) <= 32
    assert len({r["l_orderkey"] for r in rows}) == lines["orders"]


def test_text_similarity_reads_whole_texts(spark, tmp_path):
    import __spark_entry__

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)) for n in (5, 60, 300, 700)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in __spark_entry__.queries()["text_similarity"](spark, str(tmp_path)).collect():
        a, b = texts[r["doc_id"]].split(), texts[r["doc_id"]][49:].split()
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
        assert r["rouge_l"] == (round(200 * row[-1] / (len(a) + len(b)), 4) if b else 0.0)
