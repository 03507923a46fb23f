import json
import math
import os

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from fieldmark.operators import embedding
from fieldmark.operators.neighbors import nearest
from fieldmark.operators.split import openset_split
from fieldmark.sources.staging import FOLDER, staging_root
from fieldmark.plans import preparation
from fieldmark.plans.prediction import leaderboard, run_prediction, score_by_epoch, top_runs
from fieldmark.plans.preparation import embed_images, prepare_images, project_embeddings
from fieldmark.sources.tables import METADATA_COLUMNS


def byte_factory():
    """A stand-in for a vision model: 768 numbers from the bytes of a file.

    Defined inside a function, so that it travels to the workers by value.
    """

    def factory(name):
        def predict(batch):
            sizes = np.array([len(b) for b in batch], dtype="float32")
            first = np.array([b[0] for b in batch], dtype="float32")
            return {
                "cls": np.repeat(sizes[:, None], 768, axis=1),
                "avg_patch": np.repeat(first[:, None], 768, axis=1),
            }

        return predict

    return factory


@pytest.fixture
def image_df(spark):
    return spark.createDataFrame(
        [("1", bytearray(b"\x05abc")), ("2", bytearray(b"\x07abcdef"))], "image_id string, content binary"
    )


def check_tokens(df):
    assert df.count() == 2
    assert df.select("image_id", "token.cls", "token.avg_patch").columns == ["image_id", "cls", "avg_patch"]
    row = df.orderBy("image_id").first()
    assert row.token.cls == [4.0] * 768 and row.token.avg_patch == [5.0] * 768


def test_embedder(image_df):
    stage = embedding.BatchEmbedder(factory=byte_factory(), batchSize=1)
    check_tokens(stage.transform(image_df))
    with pytest.raises(ValueError, match="module:function"):
        embedding.BatchEmbedder().transform(image_df)


def test_embedder_is_saved_and_loaded(image_df, tmp_path):
    stage = embedding.BatchEmbedder(
        factory="json:loads", modelName='"base"', batchSize=7, inputCol="content", outputCol="token"
    )
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = embedding.BatchEmbedder.load(str(tmp_path / "stage"))
    assert (again.getModelName(), again.getBatchSize(), again.getOutputCol()) == ('"base"', 7, "token")
    assert Pipeline(stages=[again]).fit(image_df).transform(image_df).columns[-1] == "token"


@pytest.mark.parametrize("sample", [None, 0])
def test_embedding_job(spark, image_df, tmp_path, sample):
    source = str(tmp_path / "images")
    image_df.write.parquet(source)
    stage = embedding.BatchEmbedder(factory=byte_factory())
    path = embed_images(spark, source, str(tmp_path / "out"), stage, sample, num_sample_ids=1)
    assert path.endswith("sample_id=0") == (sample is not None)
    check_tokens(spark.read.parquet(str(tmp_path / "out")))


def erf_gelu(x):
    return 0.5 * x * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


@pytest.mark.parametrize("kind", ["linear", "nonlinear"])
def test_projection(rows, tmp_path, kind):
    rng = np.random.default_rng(2)
    if kind == "linear":
        arrays = {"weight": rng.normal(size=(3, 6)), "bias": rng.normal(size=3)}
    else:
        arrays = {
            "first_weight": rng.normal(size=(5, 6)), "first_bias": rng.normal(size=5),
            "second_weight": rng.normal(size=(3, 5)), "second_bias": rng.normal(size=3),
        }
    np.savez(tmp_path / "head.npz", **arrays)
    head = embedding.load_head(str(tmp_path / "head.npz"))
    out = str(tmp_path / "projected")
    project_embeddings(rows.where("image_id < 100"), rows.select("image_id", "embeddings"), head, out)
    got = rows.sparkSession.read.parquet(out).toPandas().sort_values("image_id")
    assert len(got) == 100
    pdf = rows.toPandas().sort_values("image_id").head(100)
    x = np.array(pdf.embeddings.tolist())
    if kind == "linear":
        z = x @ arrays["weight"].T + arrays["bias"]
    else:
        z = erf_gelu(x @ arrays["first_weight"].T + arrays["first_bias"]) @ arrays["second_weight"].T + arrays["second_bias"]
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    np.testing.assert_allclose(np.array(got.embeddings.tolist()), z, atol=1e-6)


def test_pca(rows):
    got = embedding.pca_scores(rows, 2).select("image_id", "scores").toPandas().sort_values("image_id")
    x = np.array(rows.toPandas().sort_values("image_id").embeddings.tolist(), dtype=float)
    x = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    v = vt[:2].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), [0, 1]])
    np.testing.assert_allclose(np.array(got.scores.tolist()), x @ v, atol=1e-8)


def test_prepare_images(spark, tmp_path):
    root = tmp_path / "raw"
    lines = [",".join(METADATA_COLUMNS)]
    for i, (dataset, part) in enumerate([("LynxID2025", "database"), ("LynxID2025", "query"), ("SeaTurtleID2022", "database")]):
        folder = root / "images" / dataset / part
        folder.mkdir(parents=True)
        (folder / f"{i} x.png").write_bytes(bytes([i]) * (i + 1))
        lines.append(f"{i},id{i},images/{dataset}/{part}/{i} x.png,,,,{part},{dataset}")
    (root / "metadata.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    prepare_images(spark, str(root), out, 4)
    images = spark.read.parquet(f"{out}/parquet/images")
    assert {(r["image_id"], bytes(r["content"])) for r in images.collect()} == {("0", b"\0"), ("1", b"\1\1"), ("2", b"\2\2\2")}
    assert images.where("split = 'query'").count() == 1
    (root / "images" / "stray.png").write_bytes(b"!")
    with pytest.raises(ValueError, match="3 and 4"):
        prepare_images(spark, str(root), out, 4)


def read_json(path):
    name = next(f for f in os.listdir(path) if f.startswith("part-"))
    return json.loads(open(os.path.join(path, name)).read())


@pytest.mark.parametrize("recalibrate", [False, True])
def test_run_prediction(rows, spark, tmp_path, recalibrate):
    out = str(tmp_path / "model" / "epoch=020")
    # Pull rows towards their identity, so that known rows can be recognised.
    center = F.when(F.col("identity").isNotNull(), F.pmod(F.xxhash64("identity"), F.lit(50))).otherwise(F.col("image_id") % 50)
    near = rows.withColumn("embeddings", F.transform("embeddings", lambda x: x * 0.05 + center.cast("double")))
    embeddings = near.select("image_id", "embeddings")
    staged = os.path.join(staging_root(spark), FOLDER)
    before = set(os.listdir(staged)) if os.path.isdir(staged) else set()
    predictions = run_prediction(rows.drop("embeddings"), embeddings, out, 1, recalibrate=recalibrate)
    # Only the result is left.
    assert len(set(os.listdir(staged)) - before) == 1
    queries = rows.where("identity is null").count()
    assert predictions.count() == queries
    assert {"prediction.csv", "reid_split_summary.csv", "val_thresholds.csv", "test_thresholds.csv"} <= set(os.listdir(out))
    counts = read_json(f"{out}/test_known_counts.json")
    assert counts["total"] == queries == counts["known"] + counts["unknown"]
    best = read_json(f"{out}/test_best_threshold.json")
    sweep = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/test_thresholds.csv").toPandas()
    assert len(sweep) == 100
    assert best["threshold"] == pytest.approx(sweep.threshold[sweep.score.idxmax()])
    summary = read_json(f"{out}/test_distance_summary.json")
    assert summary["median"] == best["median"] and summary["mad"] == best["mad"]
    if not recalibrate:
        found = nearest(near.where("identity is null"), near.where("identity is not null"), 1).collect()
        limit = best["threshold"] * best["mad"] * 1.4826
        want = {
            r["image_id"]: r["neighbor_identity"] if r["distance"] - best["median"] < limit else "new_individual"
            for r in found
        }
        assert {r["image_id"]: r["identity"] for r in predictions.collect()} == want
    runs = leaderboard(spark, f"{tmp_path}/*/*/test_best_threshold.json")
    row = runs.first()
    assert (row["model"], row["epoch"], row["epoch_number"]) == ("model", "epoch=020", 20)


def test_one_dataset(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = [
        (i, None if i % 9 == 0 else f"LynxID2025_{i % 11}", "one" if i < 150 else "two",
         [float(x) for x in rng.normal(size=3) * 0.01 + i % 11])
        for i in range(220)
    ]
    df = spark.createDataFrame(data, "image_id long, identity string, dataset string, embeddings array<double>")
    got = run_prediction(
        df.drop("embeddings"), df.select("image_id", "embeddings"), str(tmp_path / "o"), 1, dataset="one"
    )
    assert {r["image_id"] for r in got.collect()} == {i for i in range(150) if i % 9 == 0}


def test_leaderboard(spark, tmp_path):
    scores = {("dino-linear", "epoch=010"): 0.2, ("dino-linear", "epoch=002"): 0.4, ("megadescriptor", "head"): 0.9}
    for (model, epoch), score in scores.items():
        folder = tmp_path / model / epoch
        folder.mkdir(parents=True)
        (folder / "best.json").write_text(json.dumps({"score": score, "threshold": 1.0}, indent=2))
    runs = leaderboard(spark, f"{tmp_path}/*/*/best.json")
    assert [tuple(r) for r in top_runs(runs, 2).collect()] == [("megadescriptor", "head", 0.9), ("dino-linear", "epoch=002", 0.4)]
    assert top_runs(runs, 1, best=False).first()["score"] == 0.2
    assert [tuple(r) for r in score_by_epoch(runs).collect()] == [("dino-linear", 2, 0.4), ("dino-linear", 10, 0.2)]
    assert score_by_epoch(runs, "%mega%").count() == 0


def test_split_then_vectors_keep_every_row(rows):
    known = rows.where("identity is not null").select("image_id", "identity")
    parts = openset_split(known)
    assert parts.join(rows.select("image_id", "embeddings"), "image_id").count() == known.count()


@pytest.mark.parametrize("num_partitions", [None, 3])
def test_bytes_of_images_move_once(spark, tmp_path, num_partitions):
    rows = [(f"images/{i}.jpg", bytes([i]) * 50) for i in range(40)]
    images = spark.createDataFrame(rows, "path string, content binary")
    spark.createDataFrame(
        [(str(i), f"images/{i}.jpg", f"d{i % 2}", "query" if i % 3 else "database") for i in range(38)],
        "image_id string, path string, dataset string, split string",
    ).write.parquet(f"{tmp_path}/keys")
    keys = spark.read.parquet(f"{tmp_path}/keys")
    found = {}
    # Before the sink a broadcast moves no bytes and a shuffle moves them once.
    for narrow, moves in ((preparation.NARROW_BYTES, 0), (0, 1)):
        out = f"{tmp_path}/images-{narrow}"
        joined = preparation.write_images(images, keys, out, num_partitions, narrow)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hashpartitioning" in line for line in plan.split("\n")) == 2 * moves
        found[narrow] = {(r.path, bytes(r.content), r.image_id, r.dataset, r.split) for r in spark.read.parquet(out).collect()}
    assert found[0] == found[preparation.NARROW_BYTES] and len(found[0]) == 40
