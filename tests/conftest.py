import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("fieldmark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Labelled and unlabelled vectors over three datasets, with one hot identity."""
    import numpy as np

    rng = np.random.default_rng(7)
    data = []
    for i in range(240):
        if i % 8 == 0:
            identity = None
        elif i % 3 == 0:
            identity = "LynxID2025_hot"
        else:
            identity = f"{['SeaTurtleID2022', 'SalamanderID2025'][i % 2]}_{i % 17}"
        dataset = (identity or "LynxID2025_").split("_")[0]
        data.append((i, identity, dataset, [float(x) for x in rng.normal(size=6).astype("float32")]))
    return spark.createDataFrame(
        data, "image_id long, identity string, dataset string, embeddings array<float>"
    )
