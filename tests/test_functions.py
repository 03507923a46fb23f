import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.functions import columns as C
from fieldmark.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, root",
    [
        ("file:/data/root/images/a/b.png", "/data/root"),
        ("file:///data/root/images/a/b.png", "file:/data/root/"),
        ("s3a://bucket/root/images/a/b.png", "s3a://bucket/root"),
    ],
)
def test_relative_path(spark, path, root):
    assert one(spark, C.relative_path(F.lit(path), root)) == "images/a/b.png"


def test_path_outside_root_fails(spark):
    with pytest.raises(Exception, match="is not below"):
        one(spark, C.relative_path(F.lit("file:/other/b.png"), "/data"))
    assert one(spark, C.relative_path(F.lit(None).cast("string"), "/data")) is None


@pytest.mark.parametrize(
    "path, suffix",
    [("a/b.tar.gz", ".gz"), ("a/.hidden", ""), ("a.b/c", ""), ("x.jpg", ".jpg"), ("x.jpg/", ".jpg"), ("x.", "")],
)
def test_suffix(spark, path, suffix):
    assert one(spark, C.file_suffix(F.lit(path))) == suffix


def test_path_parts_and_pairs(spark):
    path = F.lit("file:///runs/dino/epoch=050/best.json")
    assert one(spark, C.path_part(path, -3)) == "dino"
    assert one(spark, C.path_part(path, -2)) == "epoch=050"
    assert one(spark, C.path_part(path, -30)) is None
    assert one(spark, C.key_value_int(F.lit("epoch=050"))) == 50
    assert one(spark, C.key_value_int(F.lit("final"))) is None
    assert one(spark, C.name_prefix(F.lit("LynxID2025_a_3"))) == "LynxID2025"


def test_relabelling(spark):
    df = spark.createDataFrame(
        [("i1", "lynx", "database"), (None, "lynx", "query"), ("i3", "fox", "database"), ("i4", None, "database")],
        "identity string, species string, split string",
    ).select(C.query_label("identity", "species", "split"), C.known_species("species", ["lynx"]))
    assert [tuple(r) for r in df.collect()] == [
        ("i1", "lynx"), ("lynx_query", "lynx"), ("i3", "unknown"), ("i4", "unknown"),
    ]


def test_gate_with_and_without_spread(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "d double")
    zero = df.select(C.within_gate("d", F.lit(2.0), F.lit(0.0), 5.0)).collect()
    assert [r[0] for r in zero] == [True, False, False]
    strict = df.select(C.within_gate("d", F.lit(0.0), F.lit(1 / 1.4826), 2.0)).collect()
    assert [r[0] for r in strict] == [True, False, False]
    assert df.select(C.modified_z("d", F.lit(2.0), F.lit(0.0))).first()[0] is None


@pytest.mark.parametrize("low, high, n", [(-8, 8, 100), (-2, 8, 100), (10, 1000, 20), (-3, 3, 100), (1, 2, 1)])
def test_linspace(low, high, n):
    assert C.linspace(low, high, n) == list(np.linspace(low, high, n))


def test_scores(spark):
    assert one(spark, C.geometric_mean(F.lit(0.25), F.lit(1.0))) == 0.5
    assert one(spark, C.crossover(F.lit(0.25), F.lit(1.0))) == 0.25
    assert one(spark, C.round_half_even(F.lit(0.125))) == 0.12
    assert one(spark, C.hinge(F.lit(-1.0))) == 0.0
    assert one(spark, C.joined_text([F.lit("a"), F.lit("b")])) == "a,b"


def test_vectors(spark):
    v = F.array(*[F.lit(x) for x in (3.0, 4.0)])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.l2_normalize(v)) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(zero)) == [0.0, 0.0]
    assert one(spark, V.squared_l2(v, zero)) == 25.0
    assert one(spark, V.l2(v, zero)) == 5.0
    assert one(spark, V.l2(v, v, 1e-6)) == pytest.approx(math.sqrt(2) * 1e-6)
    assert one(spark, V.prefix(v, 1)) == [3.0]
    assert one(spark, V.as_float32(F.array(F.lit(0.1)))) == [float(np.float32(0.1))]


def test_tokens(spark):
    tokens = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 4.0], [5.0, 8.0]],), ([[1.0, 2.0]],)], "t array<array<float>>"
    )
    got = tokens.select(V.first_token("t"), V.mean_of_rest("t")).collect()
    assert [tuple(r) for r in got] == [([1.0, 2.0], [4.0, 6.0]), ([1.0, 2.0], None)]


def test_fold_and_centroids(spark):
    wide = spark.createDataFrame([("a", 1, 2.5), ("a", 3, 3.5), ("b", 5, 6.0)], "k string, embed_0 int, embed_1 double")
    folded = V.fold_columns(wide, "embed_")
    assert folded.columns == ["k", "embeddings"]
    got = {r["k"]: r["centroid"] for r in V.centroids(folded, "k").collect()}
    assert got == {"a": [2.0, 3.0], "b": [5.0, 6.0]}
    with pytest.raises(ValueError):
        V.fold_columns(wide, "none_")
