import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import grid, report, triplets


def test_classification_report(spark):
    data = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "d"), ("c", "a")]
    df = spark.createDataFrame(data, "y string, p string")
    got = {r["class"]: r for r in report.classification_report(df, "y", "p").collect()}
    assert got["a"]["precision"] == 0.5 and got["a"]["recall"] == 0.5 and got["a"]["support"] == 2
    assert got["b"]["precision"] == pytest.approx(2 / 3) and got["b"]["recall"] == 1.0
    assert got["c"]["f1_score"] == 0.0 and got["d"]["support"] == 0
    assert got["accuracy"]["f1_score"] == 0.5 and got["accuracy"]["precision"] is None
    assert got["macro avg"]["precision"] == pytest.approx((0.5 + 2 / 3) / 4)
    assert got["weighted avg"]["recall"] == pytest.approx((2 * 0.5 + 2 * 1.0) / 6)
    assert got["weighted avg"]["support"] == 6
    cells = {(r[0], r[1]): r[2] for r in report.confusion_matrix(df, "y", "p").collect()}
    assert cells[("b", "b")] == 2 and ("d", "a") not in cells
    assert report.accuracy(df, "y", "p").first()["accuracy_pct"] == 50.0


def plain_silhouette(vectors, labels):
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1))
    out = []
    for i, y in enumerate(labels):
        same = (labels == y).sum()
        if same == 1:
            out.append(0.0)
            continue
        a = d[i][labels == y].sum() / (same - 1)
        b = min(d[i][labels == z].mean() for z in set(labels) if z != y)
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("block_rows, piece", [(65_536, None), (40, None), (40, 9)])
def test_silhouette(rows, monkeypatch, block_rows, piece):
    monkeypatch.setattr(grid, "MAX_BLOCK_ROWS", block_rows)
    known = rows.where("identity is not null")
    pdf = known.toPandas().sort_values("image_id")
    want = plain_silhouette(np.array(pdf.embeddings.tolist()), pdf.identity.to_numpy())
    got = report.silhouette_samples(known, "identity", piece_rows=piece).toPandas().sort_values("image_id")
    assert list(got.image_id) == list(pdf.image_id)
    np.testing.assert_allclose(got.silhouette, want, rtol=1e-9, atol=1e-12)
    assert report.silhouette_score(known, "identity").first()[0] == pytest.approx(want.mean())


def test_silhouette_needs_two_labels(rows):
    with pytest.raises(ValueError):
        report.silhouette_samples(rows.withColumn("identity", F.lit("one")), "identity")


def test_silhouette_of_copies_and_singletons(spark):
    data = [(1, "a", [0.0]), (2, "a", [0.0]), (3, "b", [0.0]), (4, "b", [0.0]), (5, "c", [1.0])]
    df = spark.createDataFrame(data, "image_id long, identity string, embeddings array<double>")
    got = [r["silhouette"] for r in report.silhouette_samples(df, "identity").orderBy("image_id").collect()]
    assert got == [0.0] * 5


def database(rows):
    return rows.where("identity is not null").withColumn("split", F.lit("database"))


def test_triplet_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", "database"), (2, "a", "database"), (3, "b", "database"), (4, "b", "query"), (5, None, "database"), (6, None, "database")],
        "image_id long, identity string, split string",
    )
    assert [r["image_id"] for r in triplets.triplet_rows(df).orderBy("image_id").collect()] == [1, 2]


def test_positives(rows):
    df = database(rows)
    label = {r["image_id"]: r["identity"] for r in df.collect()}
    got = triplets.sample_positives(df, n=3).collect()
    sizes = {}
    for y in label.values():
        sizes[y] = sizes.get(y, 0) + 1
    assert len(got) == 3 * sum(n for n in sizes.values() if n > 1)
    assert all(label[r["anchor_id"]] == label[r["positive_id"]] and r["anchor_id"] != r["positive_id"] for r in got)
    again = triplets.sample_positives(df.repartition(5), n=3).collect()
    assert set(got) == set(again)
    # With replacement over a hot identity, draws should reach most of its rows.
    hot = {r["positive_id"] for r in got if label[r["anchor_id"]] == "LynxID2025_hot"}
    assert len(hot) > 0.8 * sizes["LynxID2025_hot"]


@pytest.mark.parametrize("same_dataset", [False, True])
def test_negatives(rows, same_dataset):
    df = database(rows)
    info = {r["image_id"]: (r["identity"], r["dataset"]) for r in df.collect()}
    got = triplets.sample_negatives(df, n=4, same_dataset=same_dataset).collect()
    assert got
    for r in got:
        a, b = info[r["anchor_id"]], info[r["negative_id"]]
        assert a[0] != b[0]
        assert not same_dataset or a[1] == b[1]
    has = {i for i, (y, d) in info.items() if any(z != y and (e == d or not same_dataset) for z, e in info.values())}
    assert len(got) == 4 * len(has)
    if not same_dataset:
        hit = {r["negative_id"] for r in got}
        assert len(hit) > 0.9 * len(info)


def test_candidate_counts(rows):
    df = database(rows)
    info = {r["image_id"]: (r["identity"], r["dataset"]) for r in df.collect()}
    for r in triplets.candidate_counts(df).collect():
        y, d = info[r["image_id"]]
        assert r["positives"] == sum(z == y for z, _ in info.values()) - 1
        assert r["negatives"] == sum(z != y for z, _ in info.values())
        assert r["negatives_same_dataset"] == sum(z != y and e == d for z, e in info.values())


def test_batches_are_exact(rows):
    sizes = sorted(r["count"] for r in triplets.assign_batches(rows, 64).groupBy("batch").count().collect())
    assert sizes == [48, 64, 64, 64]


def test_batch_distances(rows):
    batched = triplets.assign_batches(rows, 50)
    pdf = batched.toPandas()
    got = triplets.batch_distances(batched).toPandas().set_index("image_id")
    for _, group in pdf.groupby("batch"):
        v = np.array(group.embeddings.tolist())
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
        for i, image in enumerate(group.image_id):
            others = np.delete(d[i], i)
            line = got.loc[image]
            assert line["others"] == len(others)
            assert [line["nearest"], line["farthest"], line["mean"]] == pytest.approx([others.min(), others.max(), others.mean()])


def test_semi_hard(rows):
    df = database(rows)
    margin, eps = 0.8, 1e-6
    info = {r["image_id"]: (r["identity"], np.array(r["embeddings"])) for r in df.collect()}
    batch = {r["image_id"]: r["batch"] for r in triplets.assign_batches(df, 60).collect()}
    drawn = triplets.sample_positives(df, 2).collect()
    want = set()
    for r in drawn:
        y, a = info[r["anchor_id"]]
        dp = np.sqrt(((a - info[r["positive_id"]][1] + eps) ** 2).sum())
        cells = [
            (np.sqrt(((a - v) ** 2).sum()), i)
            for i, (z, v) in info.items() if z != y and batch[i] == batch[r["anchor_id"]]
        ]
        cells = [c for c in cells if dp < c[0] < dp + margin]
        if cells:
            want.add((r["anchor_id"], r["draw"], r["positive_id"], min(cells)[1]))
    mined = triplets.mine_semi_hard(df, margin=margin, batch_size=60, triplets_per_anchor=2)
    got = {(r["anchor_id"], r["draw"], r["positive_id"], r["negative_id"]) for r in mined.collect()}
    assert got == want and 0 < len(want) < len(drawn)
    vectors = triplets.with_vectors(mined, df)
    assert vectors.count() == len(want)


def test_losses(spark):
    df = spark.createDataFrame(
        [(0, [0.0, 0.0, 1.0], [0.0, 1.0, 1.0], [2.0, 0.0, 1.0]), (1, [0.0, 0.0, 0.0], [3.0, 0.0, 0.0], [1.0, 0.0, 0.0])],
        "batch long, anchor array<double>, positive array<double>, negative array<double>",
    )
    full = [max(1 - 2 + 1, 0), max(3 - 1 + 1, 0)]
    assert triplets.triplet_loss(df, eps=0.0).first().asDict() == {"loss": np.mean(full), "triplets": 2}
    first = [max(0 - 2 + 1, 0), max(3 - 1 + 1, 0)]
    # The prefix of 3 equals the vector: skipped, though its weight still divides.
    got = triplets.nested_triplet_loss(df, nested_dims=[3, 1], loss_weights=[1, 2, 4], eps=0.0).first()["loss"]
    assert got == pytest.approx((np.mean(full) + 4 * np.mean(first)) / 7)
    plain = triplets.nested_triplet_loss(df, nested_dims=[1], eps=0.0).first()["loss"]
    assert plain == pytest.approx((np.mean(full) + np.mean(first)) / 2)
    with pytest.raises(ValueError):
        triplets.nested_hinge([1, 2], [1.0])
    row = triplets.epoch_loss(df, eps=0.0).first().asDict()
    assert row == {"loss": np.mean(full), "batches": 2, "triplets": 2}
    near = triplets.triplet_loss(df.limit(1), margin=1.0, eps=1e-6).first()["loss"]
    assert math.isclose(near, full[0], abs_tol=1e-5)
