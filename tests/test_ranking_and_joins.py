import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.functions import columns as C
from fieldmark.operators import joins, profile
from fieldmark.operators import ranking
from fieldmark.operators.ranking import encode_labels, exact_quantiles, rank_by_hash, running_total


def hashed(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def test_rank_by_hash_matches_a_sort(rows):
    known = rows.where("identity is not null").select("image_id", "identity")
    got = {r["image_id"]: (r["rank"], r["group_size"]) for r in rank_by_hash(known, "image_id", 5, within=["identity"]).collect()}
    groups = {}
    for r in known.collect():
        groups.setdefault(r["identity"], []).append(r["image_id"])
    want = {}
    for ids in groups.values():
        for place, i in enumerate(sorted(ids, key=lambda i: hashed(5, i)), 1):
            want[i] = (place, len(ids))
    assert got == want


def test_global_and_weighted_rank(spark):
    df = spark.range(1000).withColumn("w", F.col("id") % 7)
    ordered = sorted(range(1000), key=lambda i: hashed(1, i))
    got = {r["id"]: r["rank"] for r in rank_by_hash(df, "id", 1).collect()}
    assert [got[i] for i in ordered] == list(range(1, 1001))
    weighted = {r["id"]: (r["rank"], r["group_size"]) for r in rank_by_hash(df, "id", 1, weight="w").collect()}
    total = np.cumsum([i % 7 for i in ordered])
    assert [weighted[i] for i in ordered] == [(int(t), int(total[-1])) for t in total]


def test_hot_group_is_spread_over_slices(spark):
    """No window of the plan may be partitioned by the group alone on row level."""
    df = spark.range(10).withColumn("g", F.lit("hot"))
    plan = rank_by_hash(df, "id", 1, within=["g"])._jdf.queryExecution().executedPlan().toString()
    rows_window = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert rows_window and all("_slice" in line for line in rows_window)


def test_running_total_and_label_codes(spark):
    values = [f"v{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, n long").repartition(7)
    got = [r["running"] for r in running_total(df, ["v"], "n").orderBy("v").collect()]
    assert got == list(np.cumsum(range(300)))
    labels = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "label string")
    assert {(r[0], r[1]) for r in encode_labels(labels, "label").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_exact_quantiles_by_group(spark):
    rng = np.random.default_rng(3)
    data = [(g, float(v)) for g, n in ((1, 41), (2, 100), (5, 1)) for v in rng.integers(0, 9, n)]
    df = spark.createDataFrame(data, "g int, v double")
    probs = {"low": 0.1, "mid": 0.5, "high": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs, by="g").collect()}
    for g in (1, 2, 5):
        values = [v for h, v in data if h == g]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p))


def test_exact_quantiles_of_any_doubles_write_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    wide = np.concatenate([
        rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), np.full(400, 2.5), [-0.0, 0.0, 5e-324, -5e-324],
        1.0 + rng.integers(0, 9, 300) * 2.0**-52,
    ])
    data = [(None if i % 3 == 0 else "a", float(v)) for i, v in enumerate(wide)] + [("a", None), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    monkeypatch.setattr(ranking, "stage", None)
    probs = {"least": 0.0, "low": 0.013, "q1": 0.25, "mid": 0.5, "q3": 0.75, "most": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs, by="g").collect()}
    assert set(got) == {None, "a"}
    got["all"] = exact_quantiles(df, "v", probs).first()
    for g in got:
        values = [v for h, v in data if v is not None and g in ("all", h)]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    nothing = df.where("v is null")
    assert exact_quantiles(nothing, "v", {"mid": 0.5}).collect() == [(None,)]
    assert exact_quantiles(nothing, "v", {"mid": 0.5}, by="g").count() == 0


def test_group_count_counts_null_keys_as_one_group(rows):
    got = joins.group_count(rows, "identity", "image_id").select("identity", "identity_count").distinct().collect()
    want = rows.groupBy("identity").count().collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
    assert joins.group_count(rows, "identity", "image_id").count() == rows.count()


def test_heavy_keys_are_found_and_the_others_shuffle(spark):
    # One key with a third of all rows among 20,000 others, and NULL.
    data = spark.range(30_000).selectExpr(
        "id AS image_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id) END AS identity"
    )
    assert joins.heavy_keys(data, "identity") == ["hot"]
    assert joins.heavy_keys(data.limit(0), "identity") == []
    counted = joins.group_count(data, "identity", "image_id")
    got = {tuple(r) for r in counted.groupBy("identity", "identity_count").count().collect()}
    assert got == {(r[0], r[1], r[1]) for r in data.groupBy("identity").count().collect()}
    # The rows of heavy keys are not shuffled: every exchange of rows is behind the filter on light ones.
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan
    numbers = spark.createDataFrame([("hot", 1), (None, 2), ("k2", 3), ("nobody", 4)], "identity string, x int")
    left = joins.attach_by_key(data, numbers, "identity")
    want = {1: 10_000, 2: data.where("identity is null").count(), 3: 1}
    assert {r[0]: r[1] for r in left.where("x is not null").groupBy("x").count().collect()} == want
    assert left.count() == 30_000 and joins.attach_by_key(data, numbers, "identity", "inner").count() == sum(want.values())


def test_attach_by_key(rows, spark):
    table = spark.createDataFrame([("LynxID2025_hot", 1), ("nobody", 2)], "identity string, x int")
    left = joins.attach_by_key(rows, table, "identity")
    assert left.count() == rows.count()
    assert left.where("x = 1").count() == rows.where("identity = 'LynxID2025_hot'").count()
    inner = joins.attach_by_key(rows, table, "identity", "inner")
    assert inner.count() == left.where("x = 1").count()


def test_overlap_and_difference(spark):
    parts = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("b", None), ("a", "x")], "part string, k string"
    )
    got = {(r[0], r[1]): r[2] for r in joins.key_overlap(parts, "part", "k").collect()}
    assert got == {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 2}
    lost = joins.key_difference(parts.where("part = 'b'"), parts.where("part = 'a'"), "k").collect()
    assert [r["k"] for r in lost] == ["z"]


def test_hash_bucket_is_crc32(spark):
    got = [r[0] for r in spark.range(50).select(C.hash_bucket("id", 10)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 10 for i in range(50)]


@pytest.mark.parametrize("block", [3, 1000])
def test_run_lengths(spark, block):
    names = list("aaabbaaaaaaaaac") + [None, None, "d"]
    df = spark.createDataFrame(list(enumerate(names)), "p long, n string").repartition(4)
    got = sorted(tuple(r) for r in profile.run_lengths(df, "p", "n", block).collect())
    assert got == [(0, "a", 3), (3, "b", 2), (5, "a", 9), (14, "c", 1), (15, None, 2), (17, "d", 1)]


def test_counts_and_top(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",), (None,)], "k string")
    assert {tuple(r) for r in profile.count_by(df, "k").collect()} == {("a", 2), ("b", 1), ("c", 2), (None, 1)}
    assert {tuple(r) for r in profile.frequency_of_frequencies(df, "k").collect()} == {(1, 1), (2, 2)}
    assert [tuple(r) for r in profile.top_values(df, "k", 2).collect()] == [("a", 2), ("c", 2)]
    assert [tuple(r) for r in profile.top_values(df, "k", 5, skip=2).collect()] == [("b", 1)]
    assert profile.distinct_counts(df, "k").first().asDict() == {"with_null": 4, "without_null": 3}
    row = profile.describe_counts(df, "k").first()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (4, 1.5, 1, 2)
    assert row["stddev"] == pytest.approx(np.std([2, 1, 2, 1], ddof=1))
