import math

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import metrics, split


def edge_rows(spark, sizes):
    data = [(f"{name}-{i}", name) for name, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "image_id string, identity string")


SIZES = {f"id{i:02d}": [1, 2, 3, 5, 11][i % 5] for i in range(40)}


def test_openset_split_counts(spark):
    rows = edge_rows(spark, SIZES)
    got = split.openset_split(rows).toPandas()
    assert sorted(got.image_id) == sorted(r["image_id"] for r in rows.collect())
    by = got.groupby("identity").part.value_counts().unstack(fill_value=0)
    known = [i for i in by.index if by.loc[i, "train"] > 0]
    assert len(known) == math.floor(0.6 * 40)
    held = [i for i in by.index if i not in known]
    assert sum(by.loc[i, "val"] > 0 for i in held) == 8
    assert all((by.loc[i, "val"] == 0) != (by.loc[i, "test"] == 0) for i in held)
    for i in known:
        n = SIZES[i]
        train = n if n == 1 else math.floor(0.8 * n)
        rest = n - train
        test = 0 if rest <= 1 else math.ceil(rest / 2)
        assert tuple(by.loc[i, ["train", "val", "test"]]) == (train, rest - test, test)


def test_split_ignores_layout(spark):
    rows = edge_rows(spark, SIZES)
    a = split.openset_split(rows.repartition(1)).collect()
    b = split.openset_split(rows.repartition(13)).collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}
    c = split.openset_split(rows, seed=7).collect()
    assert {tuple(r) for r in a} != {tuple(r) for r in c}


def test_split_with_a_hot_identity(spark):
    rows = edge_rows(spark, {**{f"i{k}": 4 for k in range(9)}, "hot": 3000})
    got = split.openset_split(rows).where("identity = 'hot'").groupBy("part").count().collect()
    counts = {r["part"]: r["count"] for r in got}
    assert counts in ({"train": 2400, "val": 300, "test": 300}, {"val": 3000}, {"test": 3000})


def test_empty_part_fails(spark):
    with pytest.raises(Exception, match="leaves a part empty"):
        split.openset_split(edge_rows(spark, {"a": 3})).collect()
    with pytest.raises(Exception, match="leaves a part empty"):
        split.openset_split(edge_rows(spark, {"a": 3, "b": 3})).collect()


def test_early_split(spark):
    rows = edge_rows(spark, {f"id{i:02d}": [1, 3, 4, 7][i % 4] for i in range(40)})
    got = split.early_split(rows).toPandas()
    by = got.groupby("identity").part.value_counts().unstack(fill_value=0)
    for i, line in by.iterrows():
        n = int(line.sum())
        if line["train"]:
            queries = math.ceil(0.5 * n)
            assert line["train"] == n - queries
            assert line["test"] == math.ceil(queries / 2)
    with pytest.raises(Exception, match="one query image"):
        split.early_split(edge_rows(spark, {f"i{k}": 2 for k in range(40)})).collect()


def test_identity_split(spark):
    rows = edge_rows(spark, SIZES)
    got = split.identity_split(rows).toPandas()
    assert len(got) == rows.count()
    assert (got.groupby("identity").part.nunique() == 1).all()
    per_part = got.drop_duplicates("identity").part.value_counts()
    assert dict(per_part) == {"train": 24, "val": 8, "test": 8}


def test_stratified_split(spark):
    sizes = {"a": 10, "b": 11, "c": 27, "d": 5}
    rows = edge_rows(spark, sizes)
    got = split.stratified_split(rows, "identity", "image_id").toPandas()
    assert len(got) == 53
    tests = got[got.part == "test"].identity.value_counts()
    assert tests.sum() == math.ceil(0.2 * 53)
    for name, n in sizes.items():
        assert abs(tests[name] - 0.2 * n) < 1
    with pytest.raises(ValueError):
        split.stratified_split(edge_rows(spark, {"a": 10, "b": 1}), "identity", "image_id")


def test_split_summary(spark):
    parts = spark.createDataFrame(
        [("1", "a", "train"), ("2", "a", "train"), ("3", "b", "train"), ("1", "a", "val"), ("4", "c", "val"), ("5", "d", "test")],
        "image_id string, identity string, part string",
    )
    got = {r["split"]: r for r in split.split_summary(parts).collect()}
    val = got["val"]
    assert (val["num_individuals"], val["num_images"]) == (2, 2)
    assert (val["train_image_overlap"], val["val_image_overlap"], val["test_image_overlap"]) == (1, 2, 0)
    assert got["val"]["train_image_pct"] == 33.33
    assert (val["known_individuals"], val["unknown_individuals"]) == (1, 1)
    assert got["train"]["unknown_individuals"] == 0
    assert got["test"]["unknown_individuals"] == 1


ROWS = [
    ("1", "A_1", "A_1", "a", False), ("2", "A_1", "A_2", "a", False), ("3", "A_2", "A_2", "a", False),
    ("4", "A_9", "new_individual", "a", True), ("5", "A_9", "A_1", "a", True), ("6", "B_1", "B_1", "b", False),
]


def scored(spark):
    return spark.createDataFrame(
        ROWS, "image_id string, identity string, prediction string, dataset string, new_identity boolean"
    )


def test_balanced_accuracies(spark):
    df = scored(spark)
    unknown = df.where("new_identity").select("identity")
    assert metrics.baks(df, unknown).first()["baks"] == pytest.approx((0.5 + 1 + 1) / 3)
    assert metrics.baus(df, unknown).first()["baus"] == pytest.approx(0.5)
    known_only = df.where("not new_identity")
    row = metrics.balanced_accuracies(known_only, unknown).first()
    assert row["baks"] is not None and row["baus"] is None
    row = metrics.balanced_accuracies(df.where("new_identity"), unknown).first()
    assert row["baks"] is None and row["baus"] == 0.5


def solution_and_submission(spark, prefix="LynxID2025_"):
    df = scored(spark).withColumns(
        {c: F.when(F.col(c) == "new_individual", F.col(c)).otherwise(F.concat(F.lit(prefix), F.col(c))) for c in ("identity", "prediction")}
    )
    solution = df.select("image_id", "identity", "dataset", "new_identity")
    return solution, df.select("image_id", F.col("prediction").alias("identity"))


def test_competition_score(spark):
    solution, submission = solution_and_submission(spark)
    got = metrics.competition_score(solution, submission).first()["score"]
    # Dataset b has no unknown identity, so its side counts as 0.
    assert got == pytest.approx((math.sqrt(0.75 * 0.5) + 0) / 2)


def test_unknown_set_is_global(spark):
    solution = spark.createDataFrame(
        [("1", "LynxID2025_x", "a", True), ("2", "LynxID2025_x", "b", False)],
        "image_id string, identity string, dataset string, new_identity boolean",
    )
    submission = solution.select("image_id", "identity")
    scores = {r["dataset"]: r for r in metrics.dataset_scores(solution, submission).collect()}
    assert scores["b"]["baks"] == 0.0 and scores["b"]["baus"] == 0.0


def violations(solution, submission):
    return {r["rule"]: r["violations"] for r in metrics.submission_violations(solution, submission).collect() if r["violations"]}


def test_submission_rules(spark):
    solution, good = solution_and_submission(spark)
    assert violations(solution, good) == {}
    fewer = good.where("image_id <> '1'")
    assert violations(solution, fewer) == {"row count differs": 1, "image_id missing": 1}
    other = fewer.unionByName(spark.createDataFrame([("77", "LynxID2025_A_1")], "image_id string, identity string"))
    assert violations(solution, other) == {"image_id missing": 1, "image_id not in solution": 1}
    twice = good.unionByName(good.where("image_id = '2'"))
    assert violations(solution, twice) == {"row count differs": 1, "image_id repeated": 1}
    bad = good.withColumn("identity", F.when(F.col("image_id") == "3", "Fox_1").otherwise(F.col("identity")))
    assert violations(solution, bad) == {"identity prefix": 1}
    with pytest.raises(metrics.SubmissionError, match="identity prefix: 1"):
        metrics.competition_score(solution, bad)
    with pytest.raises(metrics.SubmissionError, match="column identity"):
        metrics.competition_score(solution, good.drop("identity"))
    with pytest.raises(metrics.SubmissionError, match="must be a string"):
        metrics.competition_score(solution, good.withColumn("identity", F.lit(1)))
    lost = {tuple(r) for r in metrics.unmatched_rows(solution, other).collect()}
    assert lost == {("1", "submission"), ("77", "solution")}


def test_flawed_submission_counts_every_solution_row_once(spark):
    solution, good = solution_and_submission(spark)
    full = {r["dataset"]: r["baks"] for r in metrics.dataset_scores(solution, good).collect()}
    twice = {r["dataset"]: r["baks"] for r in metrics.dataset_scores(solution, good.unionByName(good)).collect()}
    none = metrics.dataset_scores(solution, good.limit(0)).collect()
    assert twice == full
    assert all(r["baks"] == 0.0 and r["baus"] == 0.0 for r in none)
