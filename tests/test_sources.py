import os
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.sources import positions, staging
from fieldmark.sources.positions import positional_zip, row_numbers
from fieldmark.sources.tables import (
    METADATA_COLUMNS,
    key_differences,
    read_columns,
    read_files,
    read_metadata,
    read_records,
    require_equal_counts,
    sample_bucket,
    sample_path,
    write_csv,
    write_files,
    write_partitioned,
    write_record,
    write_samples,
)


def files_in(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_metadata(spark, tmp_path):
    path = tmp_path / "metadata.csv"
    path.write_text(",".join(METADATA_COLUMNS) + "\n1,LynxID2025_1,a.png,2020-01-01,left,lynx,database,LynxID2025\n2,,b.png,,,,query,LynxID2025\n")
    df = read_metadata(spark, str(path))
    assert df.columns == list(METADATA_COLUMNS) and {t for _, t in df.dtypes} == {"string"}
    assert df.where("identity is null").first()["image_id"] == "2"
    assert dict(read_metadata(spark, str(path), schema=None).dtypes)["image_id"] == "int"


def test_wrong_header_is_an_error(spark, tmp_path):
    path = tmp_path / "metadata.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="header|schema"):
        read_metadata(spark, str(path)).collect()


def test_binary_files(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.png").write_bytes(b"one")
    (tmp_path / "x" / "y" / "b.png").write_bytes(b"three")
    (tmp_path / "x" / "y" / "c.txt").write_bytes(b"no")
    df = read_files(spark, str(tmp_path), "*.png")
    assert sorted((r["length"], bytes(r["content"])) for r in df.collect()) == [(3, b"one"), (5, b"three")]
    assert read_files(spark, str(tmp_path)).count() == 3


def test_column_pruning_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    write_files(spark.range(10).withColumn("v", F.array(F.lit(1.0))), path, 2)
    assert len(files_in(path)) == 2
    plan = read_columns(spark, path, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_partitioned_sink(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).select("id", F.lit("d").alias("dataset"), (F.col("id") % 2).alias("split"))
    write_partitioned(df, path, ["dataset", "split"], 4)
    assert sorted(os.listdir(path + "/dataset=d"))[:2] == ["split=0", "split=1"]
    assert spark.read.parquet(path).count() == 100
    write_partitioned(df, path, ["dataset", "split"], 4, spread="id")
    assert len(files_in(path)) > 2 and spark.read.parquet(path).count() == 100


def test_samples(spark, tmp_path):
    df = spark.range(200)
    whole, alone = str(tmp_path / "a"), str(tmp_path / "b")
    write_samples(df, whole, "id", 4)
    for i in range(4):
        write_files(sample_bucket(df, "id", i, 4), sample_path(alone, i), 1)
    a, b = (spark.read.parquet(p).collect() for p in (whole, alone))
    assert {tuple(r) for r in a} == {tuple(r) for r in b} and len(a) == 200
    # A second run of one sample replaces that sample only.
    write_samples(sample_bucket(df, "id", 2, 4), whole, "id", 4)
    assert spark.read.parquet(whole).count() == 200


def test_hot_sample_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(setting, "16k")
    try:
        df = spark.range(0, 40_000, 1, 8).select(F.lit(7).alias("id"), F.xxhash64("id").alias("v"))
        write_samples(df, path, "id", 4)
    finally:
        spark.conf.unset(setting)
    (folder,) = [f for f in os.listdir(path) if f.startswith("sample_id=")]
    assert len(files_in(f"{path}/{folder}")) > 1 and spark.read.parquet(path).count() == 40_000


def test_records_and_csv(spark, tmp_path):
    for model, epoch, score in (("linear", "epoch=010", 0.25), ("other", "last", 0.5)):
        folder = tmp_path / model / epoch
        folder.mkdir(parents=True)
        (folder / "best.json").write_text('{\n  "score": %s,\n  "threshold": 1\n}' % score)
    df = read_records(spark, f"{tmp_path}/*/*/best.json", "score double, threshold double")
    assert sorted(r["score"] for r in df.collect()) == [0.25, 0.5]
    assert df.where("filename like '%/linear/epoch=010/best.json'").count() == 1
    row = spark.createDataFrame([(1.0, None)], "a double, b double")
    write_record(row, str(tmp_path / "r.json"))
    assert spark.read.json(str(tmp_path / "r.json")).first().asDict() == {"a": 1.0, "b": None}
    write_csv(df.select("score"), str(tmp_path / "c.csv"), single_file=True)
    assert len(files_in(tmp_path / "c.csv")) == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c.csv")).columns == ["score"]
    assert os.path.exists(tmp_path / "c.csv" / "_SUCCESS")


def test_reconciliation(spark):
    a, b = spark.range(5), spark.range(1, 6)
    require_equal_counts(a, b)
    with pytest.raises(ValueError, match="5 and 4"):
        require_equal_counts(a, b.limit(4))
    assert {tuple(r) for r in key_differences(a, b, "id").collect()} == {(0, 1, 0), (5, 0, 1)}


@pytest.mark.parametrize("few", [positions.FEW_FILES, 0])
def test_positions_follow_file_order(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(positions, "FEW_FILES", few)
    rng = np.random.default_rng(0)
    values = [int(v) for v in rng.permutation(5000)]
    path = str(tmp_path / "rows")
    spark.sparkContext.parallelize(values, 5).map(lambda v: (v,)).toDF("v long").write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = row_numbers(spark, path).orderBy("row_number").collect()
            assert [r["row_number"] for r in got] == list(range(5000))
            assert [r["v"] for r in got] == values
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_positional_zip_with_split(spark, tmp_path):
    data = {"database": [[1.0], [2.0]], "query": [[3.0]]}
    frames = []
    for name, vectors in data.items():
        path = str(tmp_path / name)
        spark.createDataFrame([(v,) for v in vectors], "embeddings array<double>").coalesce(1).write.parquet(path)
        frames.append(row_numbers(spark, path).withColumn("split", F.lit(name)))
    metadata = spark.createDataFrame(
        [("a", 0, "database"), ("b", 1, "database"), ("c", 0, "query")], "image_id string, row_number long, split string"
    )
    zipped = positional_zip(metadata, frames[0].unionByName(frames[1]), ["row_number", "split"])
    assert {r["image_id"]: r["embeddings"] for r in zipped.collect()} == {"a": [1.0], "b": [2.0], "c": [3.0]}


def test_staging_uses_the_session_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert staging.staging_root(spark) == root
    staged = staging.stage(spark.range(3).where("id > 5"))
    assert staged.columns == ["id"] and staged.count() == 0
    assert root in staged.inputFiles()[0] if staged.inputFiles() else True


def folders(spark):
    root = os.path.join(staging.staging_root(spark), staging.FOLDER)
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_an_owner_leaves_no_folder(spark):
    before = folders(spark)
    with staging.Owner() as outer:
        kept = staging.stage(spark.range(5))
        with staging.Owner() as inner:
            first = staging.stage(spark.range(7))
            second = staging.stage(first.join(kept, "id"), readers=2)
            assert len(folders(spark) - before) == 3
            inner.done(first)
            inner.done(second)
            assert len(folders(spark) - before) == 2 and second.count() == 5
            result = inner.hand_over(staging.stage(second.where("id > 1")))
        # What was handed over belongs to the owner outside now.
        assert len(folders(spark) - before) == 2 and result.count() == 3
        with pytest.raises(ValueError):
            with staging.Owner():
                staging.stage(spark.range(2))
                raise ValueError
        assert len(folders(spark) - before) == 2
        outer.done(kept)
        assert len(folders(spark) - before) == 1
    assert folders(spark) == before


def test_sessions_without_the_setting():
    def session(master):
        conf = {"spark.sql.warehouse.dir": "file:/w/"}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, *d: conf.get(name, *d)), sparkContext=SimpleNamespace(master=master))

    assert staging.staging_root(session("local[4]")) == "file:/w"
    with pytest.raises(ValueError, match="every executor"):
        staging.staging_root(session("spark://host:7077"))


def test_staging_leaves_no_shuffle_files(spark):
    """A staged write frees what it shuffled, and leaves the setting of the session alone."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffled():
        return {f for folder in folders for _, _, names in os.walk(folder.getPath()) for f in names if f.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(staging.CLEANUP)
    rows = staging.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert rows.count() == 7 and spark.conf.get(staging.CLEANUP) == setting
