import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators import cells, grid, kernels
from fieldmark.operators.neighbors import Wanted, nearest, nearest_lists, row_medians
from fieldmark.operators.stats import distance_summary, median_and_mad, null_distances


def brute(queries, gallery, k, other_label_only=False):
    found = []
    for q in queries.itertuples():
        cells = []
        for g in gallery.itertuples():
            if other_label_only and q.identity is not None and q.identity == g.identity:
                continue
            gap = np.array(q.embeddings, "f8") - np.array(g.embeddings, "f8")
            cells.append((float((gap * gap).sum()), g.image_id, g.identity))
        cells.sort(key=lambda c: c[:2])
        found += [(q.image_id, r + 1, *c) for r, c in enumerate(cells[:k])]
    return found


def as_list(df):
    columns = ["image_id", "rank", "distance", "neighbor_id", "neighbor_identity"]
    return [tuple(r) for r in df.select(*columns).orderBy("image_id", "rank").collect()]


def same(a, b):
    assert [(x[0], x[1], x[3], x[4]) for x in a] == [(x[0], x[1], x[3], x[4]) for x in b]
    np.testing.assert_allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("block_rows, partitions", [(65_536, 1000), (37, 1000), (37, 5)])
@pytest.mark.parametrize("other", [False, True])
def test_nearest_matches_brute_force(rows, monkeypatch, block_rows, partitions, other):
    """One cell; many cells, a tile per partition; several tiles per partition."""
    monkeypatch.setattr(grid, "MAX_BLOCK_ROWS", block_rows)
    monkeypatch.setattr(cells, "MAX_PARTITIONS", partitions)
    known = rows.where("identity is not null")
    queries = known if other else rows.where("identity is null")
    found = nearest(queries, known, 4, other_label_only=other)
    same(as_list(found), brute(queries.toPandas(), known.toPandas(), 4, other))
    if other:
        # The same rows as two tables.
        apart = nearest(known.select("*"), known, 4, other_label_only=True, query_columns=["dataset"])
        assert sorted(as_list(apart)) == sorted(as_list(found))
        carried = nearest(known, known, 4, other_label_only=True, query_columns=["dataset", "identity"])
        same_rows = carried.join(known.select("image_id", "dataset", "identity"), ["image_id", "dataset", "identity"])
        assert same_rows.count() == found.count()


def test_copies_and_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(grid, "MAX_BLOCK_ROWS", 16)
    # A third of the gallery are copies of one vector; two others are mirrored.
    data = [(i, "a" if i % 2 else "b", [1.0, 1.0]) for i in range(0, 40)]
    data += [(i, f"c{i}", [float(i), 0.0]) for i in range(40, 100)]
    data += [(200, "p", [0.0, 1.0]), (201, "q", [0.0, -1.0])]
    gallery = spark.createDataFrame(data, "image_id long, identity string, embeddings array<double>")
    queries = spark.createDataFrame(
        [(1000, "a", [1.0, 1.0]), (1001, "p", [0.0, 0.0])],
        "image_id long, identity string, embeddings array<double>",
    )
    for other in (False, True):
        found = nearest(queries, gallery, 5, other_label_only=other)
        same(as_list(found), brute(queries.toPandas(), gallery.toPandas(), 5, other))


@pytest.fixture(scope="module")
def clusters(spark):
    """Twenty groups far apart, each of one identity; the first has a third of all rows and many copies."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 10
    data = []
    for i in range(900):
        group = 0 if i % 3 == 0 else 1 + i % 19
        vector = centres[group] + rng.normal(size=8) * (0.0 if i % 6 == 0 else 0.1)
        role = ["a", "b", "c"][i % 5 % 3]
        data.append((i, None if i % 11 == 0 else f"id{group}", role, [float(x) for x in vector]))
    return spark.createDataFrame(data, "image_id long, identity string, role string, embeddings array<double>")


@pytest.mark.parametrize("other", [False, True])
def test_clusters_leave_most_pairs_out(spark, clusters, monkeypatch, other):
    monkeypatch.setattr(grid, "MAX_BLOCK_ROWS", 40)
    pairs = spark.sparkContext.accumulator(0)
    found = nearest_lists(clusters, clusters, 3, [Wanted("all", other_label_only=other)], pairs=pairs)
    same(as_list(found), brute(clusters.toPandas(), clusters.toPandas(), 3, other))
    # Copies of the hot group are pairs of their own, so they are not counted as saved.
    assert 0 < pairs.value < 0.5 * 900 * 900


def test_lists_by_role(clusters, monkeypatch):
    wanted = [
        Wanted("plain", frozenset("a"), frozenset("b")), Wanted("other", frozenset("ab"), frozenset("ab"), True),
        Wanted("none", frozenset("c"), frozenset("x")), Wanted("all", None, frozenset("c")),
    ]
    pdf = clusters.toPandas()
    for rows in (65_536, 40):
        monkeypatch.setattr(grid, "MAX_BLOCK_ROWS", rows)
        got = nearest_lists(clusters, clusters, 2, wanted, role="role", query_columns=["role"])
        got = got.cache()
        for one in wanted:
            asked = pdf[pdf.role.isin(one.queries or set("abc"))]
            answers = pdf[pdf.role.isin(one.gallery or set("abc"))]
            same(as_list(got.where(F.col("list") == one.name)), brute(asked, answers, 2, one.other_label_only))
        got.unpersist()


def test_queries_far_from_every_cell(spark, clusters, monkeypatch):
    monkeypatch.setattr(grid, "MAX_BLOCK_ROWS", 50)
    far = [(10_000 + i, "id1", [float(100 * i)] * 8) for i in range(-3, 4)] + [(99, None, None)]
    queries = spark.createDataFrame(far, "image_id long, identity string, embeddings array<double>")
    gallery = clusters.where("role <> 'b'")
    for other in (False, True):
        found = nearest(queries, gallery, 4, other_label_only=other)
        same(as_list(found), brute(queries.where("embeddings is not null").toPandas(), gallery.toPandas(), 4, other))


def test_tiles_fill_their_partitions(spark):
    left = spark.range(400).selectExpr("id as k", "id % 23 as _tile")
    right = spark.range(230).selectExpr("id as k", "id % 23 as _tile")
    schema = "l long, r long, tile_rows long"

    def tile(q, g):
        import pyarrow as pa

        return pa.table({"l": [q.num_rows], "r": [g.num_rows], "tile_rows": [q.num_rows * g.num_rows]})

    done = cells.on_tiles(left, right, 23, tile, T._parse_datatype_string(schema))
    held = done.groupBy(F.spark_partition_id()).count().collect()
    assert sorted(row["count"] for row in held) == [1] * 23


def test_fewer_than_k(spark):
    gallery = spark.createDataFrame(
        [(1, "a", [0.0]), (2, "b", [1.0])], "image_id long, identity string, embeddings array<float>"
    )
    assert len(as_list(nearest(gallery, gallery, 9))) == 4
    assert len(as_list(nearest(gallery, gallery, 9, other_label_only=True))) == 2
    assert as_list(nearest(gallery, gallery.where("false"), 3)) == []


def test_query_columns_and_string_keys(rows):
    text = rows.withColumn("image_id", F.col("image_id").cast("string"))
    known = text.where("identity is not null")
    found = nearest(known, known, 1, query_columns=["identity", "dataset"])
    assert found.columns == [
        "image_id", "identity", "dataset", "rank", "distance", "neighbor_id", "neighbor_identity",
    ]
    assert found.where("image_id <> neighbor_id OR distance <> 0").count() == 0


def test_far_from_origin_is_still_exact(spark):
    """Large offsets ruin the fast product; the exact pass has to repair it."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(120, 5)) * 1e-3 + 1000.0
    data = [(i, str(i % 5), [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "image_id long, identity string, embeddings array<double>")
    same(as_list(nearest(df, df, 3)), brute(df.toPandas(), df.toPandas(), 3))


def test_uneven_or_invalid_vectors_fail(spark):
    bad = spark.createDataFrame(
        [(1, "a", [0.0, 1.0]), (2, "b", [1.0])], "image_id long, identity string, embeddings array<float>"
    )
    with pytest.raises(Exception, match="differ in length"):
        nearest(bad, bad, 1).collect()
    nan = spark.createDataFrame(
        [(1, "a", [float("nan")])], "image_id long, identity string, embeddings array<float>"
    )
    with pytest.raises(Exception, match="NaN"):
        nearest(nan, nan, 1).collect()


def test_row_medians_and_null_statistics(rows):
    known = rows.where("identity is not null")
    pdf = known.toPandas()
    distances = null_distances(known, [1, 3, 4])
    for k in (1, 3, 4):
        found = pd.DataFrame(brute(pdf, pdf, k, True), columns=["id", "rank", "d", "n", "l"])
        want = found.groupby("id")["d"].median()
        got = distances.where(F.col("num_neighbors") == k).toPandas().set_index("image_id")["distance"]
        np.testing.assert_allclose(got.sort_index(), want.sort_index(), rtol=1e-12)
        median = np.median(want)
        stats = median_and_mad(distances).where(F.col("num_neighbors") == k).first()
        assert stats["median"] == pytest.approx(median, rel=1e-12)
        assert stats["mad"] == pytest.approx(np.median(np.abs(want - median)), rel=1e-12)


def test_distance_summary(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "distance double").repartition(5)
    row = distance_summary(df).first().asDict()
    a = np.array(values)
    q1, q2, q3 = np.percentile(a, [25, 50, 75])
    want = dict(
        min_distance=a.min(), max_distance=a.max(), mean_distance=a.mean(), std_distance=a.std(),
        iqr=q3 - q1, q1=q1, q3=q3, median=q2, mad=np.median(np.abs(a - q2)),
    )
    assert row == pytest.approx(want)


def test_leading_copies_keep_enough_per_label():
    vectors = np.array([[1.0], [1.0], [2.0], [1.0], [1.0]])
    assert list(kernels._leading_copies(vectors, None, 2)) == [0, 1, 2]
    codes = np.array([0, 0, 0, 1, 0])
    assert list(kernels._leading_copies(vectors, codes, 1)) == [0, 2, 3]
    many = np.arange(5)
    assert list(kernels._leading_copies(np.ones((5, 1)), many, 1)) == [0, 1]


@pytest.mark.parametrize("codes", [False, True])
@pytest.mark.parametrize("k", [1, 3, 40])
def test_tile_against_brute_force(codes, k):
    """Small integer vectors give many copies and ties."""
    rng = np.random.default_rng(k)
    for n, width, high in ((700, 2, 6), (900, 3, 40), (30, 1, 3)):
        q, g = rng.integers(0, high, (60, width)).astype("f4"), rng.integers(0, high, (n, width)).astype("f4")
        a, b = rng.integers(0, 4, 60), rng.choice([0, 1, 2, 3, 3, 3, 7], n)
        given = (a, b) if codes else (None, None)
        row, place, rank, distance = kernels.nearest_in_tile(q, g, k, *given)
        want = []
        for i in range(60):
            d = ((q[i] - g) ** 2).sum(axis=1)
            ids = [j for j in np.lexsort((np.arange(n), d)) if not codes or a[i] != b[j]][:k]
            want += [(i, j, r + 1, d[j]) for r, j in enumerate(ids)]
        assert list(zip(row, place, rank, distance)) == want


def test_row_medians_use_prefixes(spark):
    n = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 9.0)], "image_id long, rank int, distance double")
    got = {r["num_neighbors"]: r["distance"] for r in row_medians(n, [1, 2, 3]).collect()}
    assert got == {1: 1.0, 2: 1.5, 3: 2.0}


def peak_bytes(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("k", [1, 2, 9])
def test_tile_holds_few_cells_at_a_time_and_finds_the_same(k):
    rng = np.random.default_rng(3)
    # Whole numbers make many ties; the count is no multiple of the strip.
    gallery = rng.integers(-2, 3, (20_011, 6)).astype("f4")
    queries = rng.integers(-2, 3, (1_000, 6)).astype("f4")
    codes = rng.integers(0, 5, len(gallery)), rng.integers(0, 6, len(queries))
    for own, others in ((None, None), (codes[1], codes[0])):
        row, place, rank, distance = kernels.nearest_in_tile(queries, gallery, k, own, others)
        for i in range(0, len(queries), 97):
            gaps = ((gallery - queries[i]) ** 2).sum(axis=1).astype("f8")
            allowed = np.arange(len(gallery)) if own is None else np.flatnonzero(others != own[i])
            best = allowed[np.lexsort((allowed, gaps[allowed]))][:k]
            mine = row == i
            assert place[mine].tolist() == best.tolist() and distance[mine].tolist() == gaps[best].tolist()
            assert rank[mine].tolist() == list(range(1, k + 1))
    wide = rng.normal(size=(32_768, 8)).astype("f4")
    assert peak_bytes(lambda: kernels.nearest_in_tile(wide[:2_000], wide, k)) < 32 << 20


def test_tiles_are_cut_by_rows_too():
    # Rows of a tile are bounded below what narrow vectors would allow by their bytes.
    assert cells.TILE_ROWS < grid.block_rows_of(64)
    pivots = kernels.Pivots(np.eye(1_000), None, None, np.zeros(1_000), np.ones(1_000))
    rows = np.zeros((20_000, 1_000), "f4")
    assert peak_bytes(lambda: pivots.nearest(rows[:20_000])) < 240 << 20
