"""Sweeps and votes against a plain-Python reading of their definition."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.functions.columns import NEW_INDIVIDUAL, linspace
from fieldmark.operators import grid as tiles
from fieldmark.operators import predict, sweep
from fieldmark.operators.neighbors import nearest
from fieldmark.operators.stats import null_distances

SCALE = 1.4826


def neighbors_frame(spark, lists):
    data = [(q, r, d, r, label) for q, cells in lists.items() for r, (d, label) in enumerate(cells, 1)]
    return spark.createDataFrame(
        data, "image_id long, rank int, distance double, neighbor_id int, neighbor_identity string"
    )


def predicted(cells, accepts):
    kept = [label for d, label in cells if accepts(d)]
    return Counter(kept).most_common(1)[0][0] if kept else NEW_INDIVIDUAL


def scores(labels, predictions, unknown):
    def side(keep, right):
        by = {}
        for y, p in zip(labels, predictions):
            if (y in unknown) == keep:
                by.setdefault(y, []).append(right(y, p))
        return np.mean([np.mean(v) for v in by.values()]) if by else None

    return side(False, lambda y, p: y == p), side(True, lambda y, p: p == NEW_INDIVIDUAL)


LISTS = {
    1: [(1.0, "a"), (1.0, "b"), (2.0, "b"), (3.0, "a"), (9.0, "c")],
    2: [(0.5, "c"), (4.0, "a"), (4.0, "a"), (4.5, "c"), (5.0, "b")],
    3: [(8.0, "a"), (8.5, "b")],
}


def test_vote_ties_and_gate(spark):
    found = neighbors_frame(spark, LISTS)
    got = {r[0]: r[1] for r in predict.vote(found).collect()}
    assert got == {q: predicted(c, lambda d: True) for q, c in LISTS.items()} == {1: "a", 2: "c", 3: "a"}
    for threshold in (-1.0, 0.0, 0.5, 1.0, 3.0):
        got = {r[0]: r[1] for r in predict.predict_gated(found, 2.0, 1.5, threshold).collect()}
        assert got == {
            q: predicted(c, lambda d: (d - 2.0) / (1.5 * SCALE) < threshold) for q, c in LISTS.items()
        }
    zero = {r[0]: r[1] for r in predict.predict_gated(found, 4.0, 0.0, 1.0).collect()}
    assert zero == {q: predicted(c, lambda d: d < 4.0) for q, c in LISTS.items()}


def test_scalar_columns_as_statistics(spark):
    stats = spark.createDataFrame([(2.0, 1.5)], "median double, mad double")
    found = neighbors_frame(spark, LISTS)
    a = predict.predict_gated(found, stats.select("median").scalar(), stats.select("mad").scalar(), 0.5)
    b = predict.predict_gated(found, 2.0, 1.5, 0.5)
    assert sorted(a.collect()) == sorted(b.collect())


def test_absolute_closed_and_counts(spark):
    found = neighbors_frame(spark, LISTS)
    got = {r[0]: r[1] for r in predict.predict_by_distance(found, 1.0).collect()}
    assert got == {1: "a", 2: "c", 3: NEW_INDIVIDUAL}
    assert {r[0]: r[1] for r in predict.predict_closed_set(found).collect()} == {1: "a", 2: "c", 3: "a"}
    counts = predict.prediction_counts(predict.predict_by_distance(found, 1.0)).first().asDict()
    assert counts == {"unknown": 1, "known": 2, "total": 3}


def check_sweep(got, lists, labels, train_labels, k, median, mad, thresholds):
    unknown = set(labels.values()) - train_labels
    assert [r["threshold"] for r in got] == thresholds
    for r in got:
        def accepts(d):
            return d - median < r["threshold"] * mad * SCALE

        predictions = [predicted(lists[q][:k], accepts) for q in labels]
        baks, baus = scores(list(labels.values()), predictions, unknown)
        assert r["baks"] == (None if baks is None else pytest.approx(baks, abs=1e-12))
        assert r["baus"] == (None if baus is None else pytest.approx(baus, abs=1e-12))
        if baks is not None and baus is not None:
            assert r["score"] == pytest.approx(np.sqrt(baks * baus))
            assert r["crossover_score"] == pytest.approx(1 - abs(baks - baus))
        else:
            assert r["score"] is None


@pytest.mark.parametrize("names, mad", [("abcx", 0.7), ("abc", 0.7), ("xyz", 0.7), ("abcx", 0.0)])
def test_sweep_matches_repeated_prediction(spark, names, mad):
    rng = np.random.default_rng(11)
    k_max, lists, labels = 6, {}, {}
    for q in range(70):
        cells = sorted(((float(d), str(c)) for d, c in zip(rng.integers(0, 12, k_max) / 4, rng.choice(list("abc"), k_max))), key=lambda c: c[0])
        lists[q] = cells
        labels[q] = str(rng.choice(list(names)))
    found = neighbors_frame(spark, lists)
    others = spark.createDataFrame(list(labels.items()), "image_id long, identity string")
    found = found.join(others, "image_id")
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "identity string")
    thresholds = linspace(-4, 4, 33)
    stats = [(k, 1.5, mad) for k in (1, 3, 6)]
    got = sweep.sweep_neighbors(found, others, train, stats, thresholds).orderBy("num_neighbors", "threshold").collect()
    assert len(got) == 99
    for i, (k, median, _) in enumerate(stats):
        check_sweep(got[i * 33 : i * 33 + 33], lists, labels, {"a", "b", "c"}, k, median, mad, thresholds)


def test_sweep_plan_has_no_window_and_no_copies_by_count(spark):
    found = neighbors_frame(spark, LISTS).withColumn("identity", F.lit("a"))
    others = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "image_id long, identity string")
    swept = sweep.sweep_neighbors(found, others, others, [(1, 1.0, 1.0), (5, 1.0, 1.0)], [0.0, 1.0])
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    # Intervals, their positions and the threshold grid; never the neighbours.
    assert plan.count("Generate ") == 3


def test_running_winners(spark):
    rng = np.random.default_rng(5)
    lists = [[str(x) for x in rng.choice(list("abcd"), rng.integers(1, 12))] for _ in range(80)]
    df = spark.createDataFrame([(x,) for x in lists], "labels array<string>")
    for row in df.select("labels", sweep.running_winners(F.col("labels")).alias("w")).collect():
        # Of equal counts the first that was counted stays in front.
        assert row["w"] == [Counter(row["labels"][: i + 1]).most_common(1)[0][0] for i in range(len(row["labels"]))]


def test_distance_sweep(spark):
    found = neighbors_frame(spark, LISTS)
    others = spark.createDataFrame([(1, "a"), (2, "x"), (3, "b")], "image_id long, identity string")
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "identity string")
    got = sweep.sweep_distances(found.join(others, "image_id"), others, train, [0.4, 1.0, 8.0]).orderBy("threshold").collect()
    assert [(r["baks"], r["baus"]) for r in got] == [(0.0, 1.0), (0.5, 0.0), (0.5, 0.0)]


def test_best_row_prefers_first_and_skips_null(spark):
    df = spark.createDataFrame(
        [(0.0, None), (1.0, 0.5), (2.0, 0.7), (3.0, 0.7)], "threshold double, score double"
    )
    assert sweep.best_row(df).first()["threshold"] == 2.0


def test_experiment_end_to_end(rows, monkeypatch):
    monkeypatch.setattr(tiles, "MAX_BLOCK_ROWS", 64)
    known = rows.where("identity is not null")
    train, others = known.where("image_id % 3 <> 1"), known.where("image_id % 3 = 1")
    swept, summary = sweep.experiment(train, others, [1, 4], [-2.0, 0.0, 2.0])
    distances = null_distances(train, [1, 4])
    assert summary.count() == 2
    got = swept.orderBy("num_neighbors", "threshold").collect()
    assert len(got) == 6
    found = nearest(others, train, 4).toPandas()
    lists = {q: list(zip(g.sort_values("rank").distance, g.sort_values("rank").neighbor_identity)) for q, g in found.groupby("image_id")}
    labels = {r["image_id"]: r["identity"] for r in others.collect()}
    train_labels = {r["identity"] for r in train.collect()}
    for i, k in enumerate((1, 4)):
        d = distances.where(F.col("num_neighbors") == k).toPandas().distance
        median, mad = np.median(d), np.median(np.abs(d - np.median(d)))
        part = got[i * 3 : i * 3 + 3]
        assert part[0]["median"] == pytest.approx(median) and part[0]["mad"] == pytest.approx(mad)
        check_sweep(part, lists, labels, train_labels, k, part[0]["median"], part[0]["mad"], [-2.0, 0.0, 2.0])


def test_accepted_rows_only_grow_with_the_threshold(rows):
    known = rows.where("identity is not null")
    found = nearest(rows.where("identity is null"), known, 3)
    previous = -1
    for threshold in (-3.0, -1.0, 0.0, 1.0, 3.0):
        accepted = predict.predict_gated(found, 6.0, 2.0, threshold).where("prediction <> 'new_individual'").count()
        assert accepted >= previous
        previous = accepted
