"""Near-duplicate documents: an exact Jaccard join of word n-gram sets, by prefix trees.

A document's set holds the fingerprints of its n-grams. All sets are ordered alike, rare n-grams first, by a
table of counts over the whole corpus. Two sets that are similar enough share n-grams within the rare third
of both (the prefix; how many, ``least_shared`` tells), so only prefixes meet:

1. count n-grams into a table of fixed size (the global order);
2. count prefix n-grams, and note the bands of set sizes that they occur in; an n-gram and a band go into a set
   filter of fixed size if another set of that band or a neighbouring one may have the n-gram too, since sets
   of unlike size are not similar;
3. write each document's set id, and for documents with company their prefix n-grams and their whole set.

Documents with equal sets are one class. In each bucket of a prefix n-gram a hub is drawn; every other class
is compared with the hub it meets most often, linked classes become one component, and only buckets that
still hold several components go on. After ``HUB_ROUNDS`` draws, all pairs of classes of different components
that share a bucket, and pass the length and position filters, are compared. So no link that could join two
components is left out, while a group of thousands of near copies costs a few comparisons a member.

A comparison is a walk: the partners of one class, cut into chunks of bounded size, are stored as a prefix
tree (frequent n-grams first, where near copies run together), and the walk keeps the overlap of the path it
shares with the partner before, and leaves a branch when the elements left cannot reach the overlap needed.

Null and empty texts, and texts of white space, have an empty set and no link. A text with fewer words than
``size`` has one n-gram, all its words. Repeated rows and copies are in one class and so linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm import bloom
from fieldmark.llm.components import connected
from fieldmark.llm.frames import fresh
from fieldmark.llm.rolling import CHUNK, mix, running_sums, windows
from fieldmark.sources.staging import Owner, freeing, stage

#: Cells of the count table that orders n-grams, and cells in one row of it on its way to the driver.
CELLS = 1 << 20
SEGMENT = 1 << 12
#: Highest bits of a key of (n-gram, band) that name its segment, and keys that a task sorts at a time.
KEY_BITS = 12
RUN_KEYS = 1_000_000
HUB_ROUNDS = 2
#: N-grams of partners in one chunk of comparisons.
CHUNK_GRAMS = 500_000
#: Elements that a walk takes at a time before it looks at the bound.
STRIDE = 64


#: For each byte, itself with A to Z in lower case, and whether it parts words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case."""
    return LOWER[data]


def word_ids(data: np.ndarray) -> np.ndarray:
    """Fingerprints of the words of a byte string, in order, a bounded part of the text at a time."""
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = BLANK[data]
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = turns[0::2], turns[1::2]
    if len(data) <= CHUNK:
        return windows(running_sums(data), first, last)
    out = np.empty(len(first), dtype=np.uint64)
    at = 0
    while at < len(first):
        begin = int(first[at])
        upto = int(np.searchsorted(last, begin + CHUNK, side="right"))
        if upto == at:
            out[at] = xxhash.xxh64_intdigest(data[begin : last[at]].tobytes())
            at += 1
            continue
        sums = running_sums(data[begin : last[upto - 1]])
        out[at:upto] = windows(sums, first[at:upto] - begin, last[at:upto] - begin)
        at = upto
    return out


def gram_set(data: np.ndarray, size: int) -> np.ndarray:
    """The distinct n-gram fingerprints of a text, sorted."""
    words = word_ids(lower(data))
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    grams = np.full(count, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            grams *= np.uint64(0x9E3779B97F4A7C15)
            grams += words[i : i + count]
    grams = mix(grams)
    grams.sort()
    first = np.ones(count, dtype=bool)
    np.not_equal(grams[1:], grams[:-1], out=first[1:])
    return grams[first]


def least_shared(n: int) -> int:
    """How many common n-grams the long prefixes of two similar sets are made to share, by the smaller size."""
    return max(1, n // 10)


def size_band(n: int, percent: int) -> int:
    """One of 32 bands of sizes, in a ring; sets that the length filter lets meet are in one band or in neighbours."""
    # A hair wider than the filter, so that rounding cannot put two bands between such sets.
    width = math.log(100 / percent) * (1 + 1e-9) or 1.0
    return int(math.log(n) / width) & (BANDS - 1)


#: Bands of set sizes, and one mark for each, which turns an n-gram into the key of (n-gram, band).
BANDS = 32
BAND_MARKS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def with_company(counted: DataFrame) -> DataFrame:
    """Keys of (n-gram, band) that several sets of this band and its neighbours may share.

    ``counted`` has gram, n (sets) and bands (a bit for each band that they are in). With more sets than bands
    some band holds two; which one is not known, so all of them count.
    """
    bands = F.col("bands")
    beside = (
        F.shiftleft(bands, 1).bitwiseOR(F.shiftright(bands, 1))
        .bitwiseOR(F.shiftleft(bands, BANDS - 1)).bitwiseOR(F.shiftright(bands, BANDS - 1))
    )
    met = F.when(F.col("n") > F.bit_count(bands), bands).otherwise(bands.bitwiseAND(beside))
    marks = F.array(*(F.lit(int(m)) for m in BAND_MARKS.view(np.int64)))
    # From the lowest bit to the highest one, or one more: the logarithm is rounded.
    lowest = F.bit_count((F.col("met") - 1).bitwiseAND(F.bitwise_not("met")))
    highest = F.least(F.floor(F.log2("met")).cast("int") + 1, F.lit(BANDS - 1))
    rows = counted.where("n > 1").select("gram", met.alias("met")).where("met <> 0")
    rows = rows.select("gram", "met", F.explode(F.sequence(lowest, highest)).alias("band"))
    return rows.where(F.getbit("met", F.col("band")) == 1).select(
        F.col("gram").bitwiseXOR(F.get(marks, F.col("band"))).alias("code")
    )


def prefix_length(n: int, percent: int) -> int:
    """Elements, in the global order, among which a set has ``least_shared`` of those it shares.

    A similar set holds at least ``percent`` of this one, so at most the rest comes in between.
    """
    return n - -(-n * percent // 100) + least_shared(n)


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b for ``percent`` similarity."""
    return -(-percent * (a + b) // (100 + percent))


def in_order(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rare n-grams first; equal counts by fingerprint."""
    # Count and place are one number, as sorting numbers is quicker than ordering by them.
    keys = counts[grams & np.uint64(CELLS - 1)] << 32
    keys += np.arange(len(grams))
    keys.sort()
    return grams[keys & 0xFFFFFFFF]


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    for batch in batches:
        body = batch.column("body").cast(pa.binary())
        keys = batch.column("key") if "key" in batch.schema.names else [None] * len(body)
        for i in range(len(body)):
            yield keys[i], gram_set(np.frombuffer(body[i].as_buffer(), dtype=np.uint8), size)


def global_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many documents have an n-gram of each cell; each task adds up its own table first."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, dtype=np.int64)
        cells, held = [], 0
        for _, grams in _texts(batches, size):
            cells.append((grams & np.uint64(CELLS - 1)).view(np.int64))
            held += len(grams)
            if held >= RUN_KEYS:
                table += np.bincount(np.concatenate(cells), minlength=CELLS)
                cells, held = [], 0
        if held:
            table += np.bincount(np.concatenate(cells), minlength=CELLS)
        parts = table.astype(np.int32).reshape(-1, SEGMENT)
        used = np.nonzero(parts.any(axis=1))[0]
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())],
                names=["segment", "counts"],
            )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, part in zip(batch.column("segment").to_pylist(), batch.column("counts"), strict=True):
                values = np.frombuffer(part.as_buffer(), dtype=np.int32).astype(np.int64)
                sums[segment] = sums[segment] + values if segment in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                names=["segment", "counts"],
            )

    schema = "segment int, counts binary"
    table = np.zeros(CELLS, dtype=np.int64)
    with freeing(texts.sparkSession):
        rows = texts.select("body").mapInArrow(local, schema).repartition("segment").mapInArrow(total, schema)
        for row in rows.collect():
            table[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(row["counts"], dtype=np.int64)
    return table


def company_keys(grams: np.ndarray, band: int) -> np.ndarray:
    """N-grams as the company filter sees them: their lowest bits make room for the band of the set's size."""
    return (grams & ~np.uint64(BANDS - 1)) | np.uint64(band)


def at_most_twice(keys: np.ndarray) -> np.ndarray:
    """Sorted ``keys`` without the third and later copies of each."""
    again = keys[2:] == keys[:-2]
    return keys[np.concatenate(([True] * min(2, len(keys)), ~again))] if again.any() else keys


def count_company(texts: DataFrame, size: int, percent: int, counts: Broadcast) -> DataFrame:
    """gram, n and bands, as ``with_company`` wants them, of the prefix n-grams that several sets may share.

    Keys of (n-gram, band) travel as sorted runs, one row for each segment of their range that a task has keys of.
    Whether a band holds two sets is all that is asked, so a run keeps two copies of a key at most, and
    an n-gram that most documents have sends no more than that.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(parts)
            keys.sort()
            keys = at_most_twice(keys)
            cuts = np.searchsorted(keys >> np.uint64(64 - KEY_BITS), np.arange((1 << KEY_BITS) + 1, dtype=np.uint64))
            used = np.nonzero(np.diff(cuts))[0]
            runs = [keys[cuts[i] : cuts[i + 1]].tobytes() for i in used]
            return pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(runs, pa.binary())], names=["segment", "keys"]
            )

        for _, grams in _texts(batches, size):
            if len(grams):
                own = in_order(grams, counts.value)[: prefix_length(len(grams), percent)]
                parts.append(company_keys(own, size_band(len(grams), percent)))
                held += len(own)
            if held >= RUN_KEYS:
                yield flush()
                parts, held = [], 0
        if parts:
            yield flush()

    def several(runs: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(runs)
        keys.sort()
        own = keys & ~np.uint64(BANDS - 1)
        first = np.nonzero(np.concatenate(([True], own[1:] != own[:-1])))[0]
        n = np.diff(np.append(first, len(own)))
        bands = np.bitwise_or.reduceat(np.uint64(1) << (keys & np.uint64(BANDS - 1)), first)
        more = n > 1
        columns = mix(own[first[more]]).view(np.int64), n[more], bands[more].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "n", "bands"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, runs = None, []
        for batch in batches:
            for segment, keys in zip(batch.column("segment").to_pylist(), batch.column("keys"), strict=True):
                if segment != current and runs:
                    yield several(runs)
                    runs = []
                current = segment
                runs.append(np.frombuffer(keys.as_buffer(), dtype=np.uint64))
        if runs:
            yield several(runs)

    runs = texts.select("body").mapInArrow(prefixes, "segment int, keys binary")
    runs = runs.repartition("segment").sortWithinPartitions("segment")
    return runs.mapInArrow(together, "gram long, n long, bands long")


def write_sets(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document: key, uid, n, s1 and s2 (128 bits of the set), and for those with enough company hits, places and grams.

    ``hits`` are the prefix n-grams that other documents may have too, ``places`` their places in the set's
    order; ``grams`` is the whole set in that order.
    """
    context = texts.sparkSession.sparkContext
    counts = context.broadcast(global_counts(texts, size))

    counted = count_company(texts, size, percent, counts)
    shared = bloom.build(with_company(counted), "code")
    kind = texts.schema["key"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], key_type), *(pa.array(columns[i], pa.int64()) for i in range(1, 5)),
                    pa.array(columns[5], pa.list_(pa.int64())), pa.array(columns[6], pa.list_(pa.int32())),
                    pa.array(columns[7], pa.binary()),
                ],
                names=["key", "uid", "n", "s1", "s2", "hits", "places", "grams"],
            )

        key_type = None
        for key, grams in _texts(batches, size):
            key_type = key_type or key.type
            n, hits, places, whole = len(grams), None, None, None
            ids = np.zeros(2, dtype=np.uint64)
            if n:
                mixed = mix(grams)
                with np.errstate(over="ignore"):
                    ids[0] = mixed.sum(dtype=np.uint64)
                    ids[1] = mix(mixed ^ BAND_MARKS[0]).sum(dtype=np.uint64)
                    ids = mix(ids + np.uint64(n))
                ordered = in_order(grams, counts.value)
                own = ordered[: prefix_length(n, percent)]
                seen = mix(company_keys(own, 0)) ^ BAND_MARKS[size_band(n, percent)]
                found = np.nonzero(bloom.holds(shared.value, seen))[0]
                # A similar set has at least percent of this one's size.
                if len(found) >= least_shared(-(-n * percent // 100)):
                    hits, whole = own[found].view(np.int64), ordered.tobytes()
                    places = found.astype(np.int32)
            rows.append((key.as_py(), uid, n, *ids.view(np.int64).tolist(), hits, places, whole))
            uid += 1
            held += n + 50
            if held >= CHUNK_GRAMS:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    schema = f"key {kind}, uid long, n long, s1 long, s2 long, hits array<long>, places array<int>, grams binary"
    return stage(texts.mapInArrow(sets, schema))


def walk(partners: list[np.ndarray], probe: np.ndarray, percent: int) -> np.ndarray:
    """Which partner sets are similar to ``probe``; all sets are in the global order.

    The partners, read from their frequent end, are sorted like the leaves of a prefix tree. ``path[d]`` is
    the overlap of the first d elements of the current path.
    """
    ranks = np.unique(np.concatenate([*partners, probe]), return_inverse=True)[1]
    cuts = np.cumsum([len(p) for p in partners])
    paths = [part[::-1] for part in np.split(ranks[: cuts[-1]], cuts[:-1])]
    member = np.zeros(ranks.max() + 1, dtype=bool)
    member[ranks[cuts[-1] :]] = True
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">i8").tobytes())
    similar = np.zeros(len(paths), dtype=bool)
    before, path, known = paths[order[0]][:0], np.zeros(1, dtype=np.int64), 0
    for i in order:
        own = paths[i]
        n = len(own)
        least = needed(n, len(probe), percent)
        length = min(known, n, len(before))
        apart = np.nonzero(own[:length] != before[:length])[0]
        depth = int(apart[0]) if len(apart) else length
        grown = np.empty(n + 1, dtype=np.int64)
        grown[: depth + 1] = path[: depth + 1]
        while depth < n and grown[depth] + n - depth >= least:
            upto = min(depth + STRIDE, n)
            grown[depth + 1 : upto + 1] = grown[depth] + np.cumsum(member[own[depth:upto]])
            depth = upto
        similar[i] = depth == n and grown[n] >= least
        before, path, known = own, grown, depth
    return similar


def only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose node may be among ``nodes``: a filter of fixed size, before any shuffle."""
    wanted = bloom.build(nodes.distinct().select(F.xxhash64("node").alias("mark")), "mark")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(bloom.holds(wanted.value, marks))).drop_columns(["mark"])

    return sets.select("node", "grams", F.xxhash64("node").alias("mark")).mapInArrow(choose, "node long, grams binary")


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, n_b: nodes, and the size of b's set) that are similar.

    ``sets`` has node and grams; a partner's set travels once for each of its pairs.
    """
    chunks = pairs.groupBy("a").agg((F.floor(F.sum("n_b") / CHUNK_GRAMS) + 1).alias("chunks"))
    placed = stage(
        pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    )
    ends = placed.select(F.col("a").alias("node")).unionAll(placed.select(F.col("b").alias("node")))
    chosen = only(sets, ends)
    probes = placed.select("a", "chunk").distinct().join(chosen.select(F.col("node").alias("a"), "grams"), "a").select(
        "a", "chunk", F.lit(None).cast("long").alias("b"), "grams"
    )
    partners = placed.join(chosen.select(F.col("node").alias("b"), "grams"), "b").select("a", "chunk", "b", "grams")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, probe, names, stored, found = None, None, [], [], []

        def settle() -> None:
            if probe is not None and stored:
                similar = walk(stored, probe, percent)
                found.extend((current[0], b) for b, alike in zip(names, similar, strict=True) if alike)

        def flush() -> pa.RecordBatch:
            ends = np.array(found, dtype=np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            a, chunk, b = (batch.column(c).to_pylist() for c in ("a", "chunk", "b"))
            for i, grams in enumerate(batch.column("grams")):
                if (a[i], chunk[i]) != current:
                    settle()
                    current, probe, names, stored = (a[i], chunk[i]), None, [], []
                own = np.frombuffer(grams.as_buffer(), dtype=np.uint64)
                if b[i] is None:
                    probe = own
                else:
                    names.append(b[i])
                    stored.append(own)
            if found:
                yield flush()
        settle()
        if found:
            yield flush()

    # The probe comes first, then the partners of its chunk.
    rows = probes.unionByName(partners).repartition("a", "chunk")
    rows = rows.sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return rows.mapInArrow(decide, "a long, b long")


def relabel(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """``nodes`` with their ``component`` carried on by ``merged`` (node, component)."""
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return nodes.join(moved, "component", "left").select(
        "node", F.coalesce("_to", "component").alias("component")
    )


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, n_shingles and component_id, the smallest key that links lead to, of every row."""
    with Owner() as mine:
        return mine.hand_over(stage(_near_duplicates(docs, size, percent, key, text)))


def _near_duplicates(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    rows = write_sets(texts, size, percent)
    classes = stage(
        rows.where("n > 0").groupBy("s1", "s2").agg(F.min("uid").alias("uid"), F.min("key").alias("rep"))
    )
    # One row, the node, stands for a class; only its n-grams are looked at.
    sets = rows.where("grams IS NOT NULL").select(F.col("uid").alias("node"), "grams")
    nodes = stage(
        rows.where("hits IS NOT NULL").select("uid", "n", "hits", "places")
        .join(classes.select("uid"), "uid", "left_semi").withColumnRenamed("uid", "node")
    )
    central = (1000 * F.size("hits") / F.col("n")).cast("int")
    prefix = nodes.select("node", "n", central.alias("central"), F.explode(F.arrays_zip("hits", "places")).alias("hit"))
    prefix = prefix.select(F.col("hit.hits").alias("gram"), "node", "n", F.col("hit.places").alias("place"), "central")
    several = prefix.groupBy("gram").agg(F.min("node").alias("c0"), F.max("node").alias("c1")).where("c0 <> c1")
    buckets = stage(prefix.join(several.select("gram"), "gram").withColumn("component", F.col("node")))
    labels = stage(nodes.select("node", F.col("node").alias("component")))

    def still_open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """Buckets that hold several components; one that does not never will again."""
        # Few nodes are in a component named after another one, so only these are carried over.
        moved = stage(labels.where("node <> component").withColumnRenamed("component", "_to"))
        labelled = buckets.join(moved, "node", "left").withColumn("component", F.coalesce("_to", "node")).drop("_to")
        ends = labelled.groupBy("gram").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
        return stage(labelled.join(ends.where("c0 <> c1").select("gram"), "gram"))

    def alike(a: Column, b: Column) -> Column:
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def least(a: Column, b: Column) -> Column:
        """``least_shared`` of two sets."""
        return F.greatest(F.lit(1), F.floor(F.least(a, b) / 10))

    for number in range(HUB_ROUNDS):
        # A set whose prefix is met by others nearly everywhere is close to many, so it makes a good hub;
        # later draws are by chance.
        central = -F.col("central") if number == 0 else F.lit(0)
        drawn = F.struct(
            central.alias("central"), F.xxhash64("node", F.lit(number)).alias("draw"), "node", "n", "component"
        )
        hubs = buckets.groupBy("gram").agg(F.min(drawn).alias("hub"))
        met = (
            buckets.join(hubs, "gram")
            .where((F.col("component") != F.col("hub.component")) & alike(F.col("n"), F.col("hub.n")))
            .groupBy(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"))
            .agg(F.count(F.lit(1)).alias("shared"))
            .where(F.col("shared") >= least(F.col("n_a"), F.col("n_b")))
        )
        # Each node is compared with the hub that it shares most with.
        pairs = met.groupBy("b", "n_b").agg(F.max(F.struct("shared", "a")).alias("best")).select("best.a", "b", "n_b")
        links = stage(compare(stage(pairs), sets, percent))
        if not links.isEmpty():
            labels = merge(labels, links)
            buckets = still_open(buckets, labels)
    left, right = (
        buckets.select("gram", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "place", "component")))
        for side in "ab"
    )
    # What two sets can share from their first common n-gram on bounds their overlap.
    reach = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = (
        left.join(right, "gram")
        .where((F.col("component_a") != F.col("component_b")) & (F.col("node_a") < F.col("node_b")))
        .where(alike(F.col("n_a"), F.col("n_b")))
        .where((100 + percent) * reach >= percent * (F.col("n_a") + F.col("n_b")))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_b")
        .distinct()
    )
    labels = merge(labels, compare(stage(pairs), sets, percent))
    of_node = labels.select(F.col("node").alias("uid"), "component")
    known = classes.join(of_node, "uid", "left").select(
        "s1", "s2", "rep", F.coalesce("component", "uid").alias("component")
    )
    smallest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = known.join(smallest, "component").select("s1", "s2", "component_id")
    out = rows.select("key", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, size: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id.

    Of rows with one id and one text one stays as well; documents with an empty set are in no group and stay.
    """
    own, k1, k2, rows = fresh(docs, "own", "k1", "k2", "rows")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marks = {k1: F.xxhash64(F.col(f"`{key}`")), k2: F.xxhash64(body)}
    identified = docs.select(
        F.struct(F.col(f"`{key}`").alias("key"), marks[k2].alias("k2")).alias(own), body.alias("body")
    )
    found = near_duplicates(identified, size, percent, own, "body")
    stays = (
        found.where(F.col(own) == F.col("component_id"))
        .groupBy(F.xxhash64(f"{own}.key").alias(k1), F.col(f"{own}.k2").alias(k2))
        .agg(F.count(F.lit(1)).alias(rows))
    )
    kept = docs.withColumns(marks).join(stays.hint("shuffle_hash"), [k1, k2])
    single = kept.where(F.col(rows) == 1)
    # Repeated rows are the exception; only they are sorted to find one of each.
    repeated = kept.where(F.col(rows) > 1).dropDuplicates([k1, k2])
    return single.unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components of linked classes have become one."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b"
    )
    merged = connected(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return stage(relabel(labels, merged))
