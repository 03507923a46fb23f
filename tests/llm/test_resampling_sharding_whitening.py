"""Resampling, sharding and whitening against brute force, on small and awkward inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from fieldmark.llm import hashing, resampling, sharding, whitening

SCHEMA = "doc_id long, text string, rank int, shard int, class string, `key` string, slice int, n_words int"
EXTRA = (7, 8, "c", "k", 9, 10)


def sample_texts():
    rng = random.Random(11)
    words = "Alpha beta GAMMA delta4 eps naïve 日本 zeta".split()

    def prose(n):
        return "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "-", "\n"]) for _ in range(n))

    copied = prose(40)
    texts = [None, "", " .,!\n", "one", "x" * 5000, copied, copied, copied, "É" * 40, prose(3000)]
    return texts + [prose(rng.randint(1, 70)) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *EXTRA) for i, t in enumerate(sample_texts())]
    return spark.createDataFrame([*rows, rows[12], rows[12], (None, "no id " * 30, *EXTRA)], SCHEMA).cache()


@pytest.fixture(scope="module")
def target(spark):
    texts = ["alpha beta gamma. alpha", "ZETA zeta; 日本", None, ""]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def runs_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), found


def resampled(rows, target, percent, least, buckets, seed=42):
    def bucket(run):
        return zlib.crc32(run.encode()) % buckets

    s, t = collections.Counter(), collections.Counter()
    for counts, texts in ((s, [text for _, text in rows]), (t, target)):
        for text in texts:
            counts.update(bucket(run) for run in runs_of(text)[1])
    every, aim = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (every + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in range(buckets)
    ]
    out, pool = [], []
    for key, text in rows:
        n, found = runs_of(text)
        weight = sum(gain[bucket(run)] for run in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None])
        if n >= least:
            pool.append(out[-1])
    pool.sort(key=lambda row: (-row[3], row[0] is not None, row[0] or 0))
    for rank, row in enumerate(pool[: len(pool) * percent // 100], start=1):
        row[4] = rank
    return out


def in_order(rows):
    return sorted((tuple(row) for row in rows), key=str)


@pytest.mark.parametrize("percent, slice_words", [(5, 1 << 16), (40, 50)])
def test_resampling_equals_brute_force(docs, target, monkeypatch, percent, slice_words):
    raw = [(row.doc_id, row.text) for row in docs.collect()]
    want = resampled(raw, [row.text for row in target.collect()], percent, 20, 50)
    # Tasks see a changed slice length only if the modules travel, so slices are tried on the class too.
    monkeypatch.setattr(resampling, "SLICE_WORDS", slice_words)
    words = resampling.Words(resampling.pa.array([text for _, text in raw]))
    counted = collections.Counter()
    for table, _ in resampling.tables(words, 50):
        for bucket, count in zip(table.bucket.tolist(), table.count.tolist()):
            counted[bucket] += count
    assert sum(counted.values()) == sum(row[1] for row in want)
    got = resampling.resample(docs, target, percent, 20, 50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert in_order(got.collect()) == in_order(want)


def test_runs_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(resampling, "xxhash64", lambda data, starts, lengths: np.full(len(starts), 5, dtype=np.uint64))
    words = resampling.Words(resampling.pa.array(["a b a b", "c abcdefgh1 abcdefgh2 abcdefgh1", ""]))
    ((table, text),) = resampling.tables(words, 1 << 30)
    runs = [run for t in ("a b a b", "c abcdefgh1 abcdefgh2 abcdefgh1") for run in runs_of(t)[1]]
    want = collections.Counter(zlib.crc32(run.encode()) % (1 << 30) for run in runs)
    used = table.count > 0
    assert dict(zip(table.bucket[used].tolist(), table.count[used].tolist())) == dict(want)
    assert np.bincount(text).tolist() == [9, 9]


def test_hashes_equal_the_libraries():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    lengths = np.concatenate([np.arange(300), rng.integers(0, 3000, 50)])
    starts = rng.integers(0, 3990 - lengths)
    raw = [data[s : s + n].tobytes() for s, n in zip(starts, lengths)]
    assert hashing.xxhash64(data, starts, lengths).tolist() == [xxhash.xxh64_intdigest(x) for x in raw]
    assert hashing.crc32(data, starts, lengths).tolist() == [zlib.crc32(x) for x in raw]
    none = np.empty(0, dtype=np.int64)
    assert len(hashing.xxhash64(data, none, none)) == len(hashing.crc32(data, none, none)) == 0


def test_resampling_of_nothing(spark, docs, target):
    nothing = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(nothing, target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == docs.count()
    assert resampling.resample(docs.limit(3), target).where("rank IS NOT NULL").count() == 0


def test_tree_of_rooms_finds_the_tightest():
    rng = random.Random(5)
    rooms, held = sharding.Rooms(), []
    for step in range(4000):
        if held and rng.random() < 0.5:
            size = rng.randint(0, 130)
            fits = [room for room, _ in held if room >= size]
            assert rooms.tightest(size) == (min(fits) if fits else None)
            if fits:
                number = rooms.take(min(fits))
                held.remove((min(fits), number))
        else:
            room = rng.randint(0, 120)
            rooms.add(room, step)
            held.append((room, step))


def best_fit_decreasing(sizes, capacity):
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] >= size]
        chosen = min(fits) if fits else [capacity]
        if not fits:
            bins.append(chosen)
        chosen[0] -= size
    return sorted(capacity - room for (room,) in bins)


def test_counts_are_packed_like_single_groups():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 120))]
        counts = sorted(collections.Counter(sizes).items(), reverse=True)
        runs, bins = sharding.best_fit_decreasing(counts, 100)
        held = [[] for _ in range(bins)]
        for size, placed in runs.items():
            for n, number in placed:
                held[number] += [size] * n
        # Bins with equal room are alike, so which of them a group enters is open.
        assert sorted(size for b in held for size in b) == sorted(sizes)
        assert sorted(map(sum, held)) == best_fit_decreasing(sizes, 100)


def checked_shards(docs, rows):
    """Size, checksum and place of every row are right, and equal texts are together."""
    raw = sorted((str(row.doc_id), len((row.text or "").encode()) + 8, zlib.crc32((row.text or "").encode())) for row in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == raw
    homes, slots, load = {}, collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert homes.setdefault((r.size, r.text_crc32), r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(places) == list(range(len(places))) for places in slots.values())
    return load


def test_equal_shards(docs, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 7)
    rows = sharding.equal_shards(docs, 4).collect()
    load = checked_shards(docs, rows)
    assert set(load) <= set(range(4))
    # The two longest texts are larger than a fair share and stay alone.
    large = sorted(load.values())[-1]
    assert [r.size for r in rows if load[r.shard] == large] == [max(r.size for r in rows)]
    # The others are as equal as their sizes allow.
    many = docs.where("length(text) < 1000")
    load = checked_shards(many, sharding.equal_shards(many, 3).collect())
    assert len(load) == 3 and max(load.values()) - min(load.values()) <= 8


def test_shards_of_capacity(spark, docs):
    rows = sharding.shards_of_capacity(docs, 3000).collect()
    load = checked_shards(docs, rows)
    groups = collections.Counter()
    for r in rows:
        groups[(r.size, r.text_crc32)] += r.size
    assert all(n <= 3000 or n in groups.values() for n in load.values())
    large = [n for n in groups.values() if n > 3000]
    assert len(load) == len(large) + len(best_fit_decreasing([n for n in groups.values() if n <= 3000], 3000))
    nothing = spark.createDataFrame([], SCHEMA)
    assert sharding.shards_of_capacity(nothing, 3000).count() == 0
    assert sharding.equal_shards(nothing, 3).count() == 0


def test_sizes_are_rounded_up_a_little(spark):
    sizes = [8, 9, 8191, 8192, 8193, 8194, 16384, 16385, 10**6 + 1, 10**12 + 7]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(sharding.size_class(sharding.F.col("n")).alias("c"))
    for n, row in zip(sizes, rows.collect()):
        assert n <= row.c < n * (1 + 2**-12) + (0 if n > 8192 else 1)


@pytest.mark.parametrize("scale", [1.0, 3e9])
def test_whitening_equals_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * scale
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(mixed)]
    rows += [rows[4], (900, None, "x"), (901, [None] * 6, "x"), (902, [float("nan")] + [0.0] * 5, "x")]
    rows += [(903, [float("-inf")] * 6, "x"), (904, [], "x"), (None, [1.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(3)
    got = whitening.whiten(df, 4).collect()
    kept = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = {r[0]: sum((n * a - b) ** 2 for a, b in zip(v, s)) for r, v in zip(kept, x)}
    centred = (np.array(x, dtype=object) * n - np.array(s, dtype=object)).astype(float) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors[:, :4] / np.sqrt(values[:4])
    table = collections.defaultdict(dict)
    for r in got:
        table[r.vec_id][r.component] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        assert r.identity_error < 1e-9
    assert len(got) == 4 * n
    ids = [r[0] for r in kept]
    assert set(table) == set(ids)
    for c in range(4):
        column = np.array([table[i][c + 1] for i in ids])
        assert min(np.abs(column - want[:, c]).max(), np.abs(column + want[:, c]).max()) < 1e-6


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], schema)).collect()
    assert [(r.component, abs(round(r.whitened, 9))) for r in two] == [(1, 1.0), (1, 1.0)]
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], schema)).collect()
