"""Queries against their SQL on tables that the driver's small ones don't hold: copies, exact distances, nulls."""

import random

import duckdb

import __spark_entry__


def same_as_sql(spark, folder, name, **tables):
    """The query's rows over these tables (rows, schema) equal its SQL's; returns them."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        path = f"{folder}/{t}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"create view {t} as select * from '{path}/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert got == want
    return want


def test_band_neighbors_by_exact_distances(spark, tmp_path):
    rng = random.Random(3)
    # many pairs are 150.00 apart, where subtracting from either side rounds differently
    values = [round(rng.randrange(-200, 900) * 50 + rng.randrange(3) / 100 + rng.choice([0.07, 0.29]), 2) for _ in range(1500)]
    want = same_as_sql(spark, tmp_path, "band_neighbors", supplier=(list(enumerate(values)), "s_suppkey long, s_acctbal double"))
    assert len(want) == 1500


def test_band_neighbors_of_odd_rows(spark, tmp_path):
    rows = [(1, 150.0), (2, -1e-20), (3, None), (None, 10.0), (4, float("nan")), (5, float("inf")), (6, 1e300), (7, 10.0), (7, 20.0), (7, 500.0)]
    want = same_as_sql(spark, tmp_path, "band_neighbors", supplier=(rows, "s_suppkey long, s_acctbal double"))
    assert (1, 3) in want and (7, 4) in want and len(want) == 8


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_near_dup_flag_of_copies_and_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(10_000), "n", rng.choice("ab"), "t", rng.randrange(50), round(rng.randrange(900) * 3 + rng.randrange(3) / 100 + rng.choice([0.07, 0.29]), 2)) for _ in range(600)]
    rows += [(10_000 + k, *r) for k, *r in rows[:200]]
    rows += [(1, "n", "c", "t", 5, 6.0), (2, "n", "c", "t", 5, -1e-20), (2, "n", "c", "t", 40, 100.0), (3, "n", None, "t", 5, 6.0), (4, "n", "c", "t", None, 6.0), (5, "n", "c", "t", 5, None)]
    rows += [(6 + i, "n", "d", "t", 5, x) for i, x in enumerate([float("nan"), float("nan"), float("inf"), float("inf"), 1e300, 1e300])]
    want = same_as_sql(spark, tmp_path, "bucket_near_dup_flag", part=(rows, PART))
    assert len(want) == len(rows) and (2, True) in want and (2, False) in want


def test_near_dup_flag_broadcasts_nothing(spark, tmp_path):
    """What cells make of a table is many times what the planner takes it for."""
    spark.createDataFrame([(i, "n", "a", "t", i % 50, i / 7) for i in range(200)], PART).write.parquet(f"{tmp_path}/part.parquet")
    df = __spark_entry__.queries()["bucket_near_dup_flag"](spark, str(tmp_path))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_copies_in_many_partitions(spark, tmp_path, monkeypatch):
    """A small table makes many pairs: partitions go by these, and a key's rows are dealt out."""
    from sparkloom.operators import joins

    monkeypatch.setattr(joins, "PAIR_TILE", 20)
    monkeypatch.setattr(joins, "PAIRS_TRIED", 1000)
    rng = random.Random(6)
    rows = [(i, "n", rng.choice("ab"), rng.choice("tu"), rng.randrange(8), 900 + rng.randrange(1000) / 10) for i in range(150)]
    rows += [(1000 * k + i, *r) for k in (1, 2, 3) for i, *r in rows]
    rows += [(7, "n", "a", "t", 3, 5000.0), (8, "n", None, "t", 3, 1.0), (9, "n", "a", "t", None, 1.0), (None, "n", "a", "t", 3, 1.0)]
    want = same_as_sql(spark, tmp_path, "self_pair_depth", part=(rows, PART))
    assert len(want) > 10_000
    assert __spark_entry__.queries()["self_pair_depth"](spark, str(tmp_path)).rdd.getNumPartitions() > 40


def test_pack_lists_as_one_by_one():
    import numpy as np

    from sparkloom.operators.training import greedy_pack, greedy_pack_lists

    rng = random.Random(7)
    lists = [[rng.randrange(0, 40) for _ in range(rng.choice([0, 1, 3, 7, 14, 30, 64, 65, 90]))] for _ in range(400)]
    found = greedy_pack_lists(np.array([x for r in lists for x in r], np.int64), np.array([len(r) for r in lists]), 32)
    assert found.tolist() == [x for r in lists for x in greedy_pack(r, 32)]


def test_packed_sequences_without_a_task_call_per_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(o, rng.randrange(100), rng.randrange(9), i, float(rng.randrange(1, 51))) for o in range(300) for i in range(1, rng.randrange(2, 9))]
    rows += [(1000, 1, 1, i, float(q)) for i, q in enumerate([33, 50, 100, 32, 0, 31] * 40, 1)] + [(1001, 1, 1, 1, None), (1002, 1, 1, 1, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = __spark_entry__.queries()["packed_sequences"](spark, str(tmp_path))
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    found = df.collect()
    from sparkloom.operators.training import greedy_pack

    want = set()
    for o in {r[0] for r in rows}:
        pieces = [min(32, int(q) - i) for *_, q in sorted((r for r in rows if r[0] == o), key=lambda r: r[3]) if q for i in range(0, int(q), 32)]
        bins = greedy_pack(pieces, 32)
        for b in set(bins):
            ends = [0]
            for n, at in zip(pieces, bins, strict=True):
                ends += [ends[-1] + n] if at == b else []
            want.add((o, b, 33, ",".join(map(str, ends))))
    assert {tuple(r) for r in found} == want and len(found) == len(want)
