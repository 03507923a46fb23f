"""Shards of near-equal bytes, by best-fit-decreasing packing of indivisible groups.

Rows with equal texts are one group and stay together; a null text counts as an empty one. Groups are taken from the
largest down, and each enters the bin with the least room that still holds it; a balanced tree of the rooms finds
that bin. ``shards_of_capacity`` opens bins of a fixed capacity as needed, as few as this order gives.
``equal_shards`` fixes the number of bins and looks for the smallest capacity with which they suffice. A group
larger than a fair share of what is left gets a shard of its own first, so that it does not raise the capacity of the
others; so copies that are a third of all bytes leave the other shards equal.

Groups of one size are alike, so packing works on counts by size. Sizes from 2**13 on are rounded up to 13
leading bits, which bounds that table by 4,096 rows per doubling whatever the corpus holds, and overstates a group
by less than a four-thousandth: a bin never gets more than its capacity. Only this table reaches the driver;
groups are numbered within their size by slices of a hash, and documents meet the shard of their group in a join whose
large side Spark can split. Everything else is built-in functions.

Repeated rows are copies like others and get places of their own. An empty table gives an empty one. Other columns
are ignored, whatever their names. Equal texts are told by 64 bits and their size; a clash would only tie two groups
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.sources.staging import stage

#: Bytes that every row takes beside its text.
ROW_BYTES = 8
#: Leading bits of a size that packing looks at.
SIZE_BITS = 13
#: Rows that one task numbers.
SLICE_ROWS = 100_000
#: The capacity is looked for to this share of itself, as a power of two.
CAPACITY_BITS = 16


class Rooms:
    """Bins by room in an AA tree: a balanced search tree, each node a room with its bins."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    # A node is [room, bins, level, left, right].

    @staticmethod
    def _skew(node):
        left = node[3]
        if left and left[2] == node[2]:
            node[3], left[4] = left[4], node
            return left
        return node

    @staticmethod
    def _split(node):
        right = node[4]
        if right and right[4] and right[4][2] == node[2]:
            node[4], right[3] = right[3], node
            right[2] += 1
            return right
        return node

    def add(self, room: int, number: int) -> None:
        def into(node):
            if node is None:
                return [room, [number], 1, None, None]
            if room == node[0]:
                node[1].append(number)
                return node
            side = 3 if room < node[0] else 4
            node[side] = into(node[side])
            return self._split(self._skew(node))

        self.root = into(self.root)

    def tightest(self, size: int) -> int | None:
        """The least room that holds ``size``."""
        node, best = self.root, None
        while node:
            if node[0] < size:
                node = node[4]
            else:
                best, node = node[0], node[3]
        return best

    def take(self, room: int) -> int:
        """Take out a bin with exactly this room."""
        node = self.root
        while node[0] != room:
            node = node[3] if room < node[0] else node[4]
        number = node[1].pop()
        if not node[1]:
            self.root = self._drop(self.root, room)
        return number

    def _drop(self, node, room):
        if room < node[0]:
            node[3] = self._drop(node[3], room)
        elif room > node[0]:
            node[4] = self._drop(node[4], room)
        elif node[3] is None:
            return node[4]
        else:
            # The nearest smaller room takes this node's place.
            low = node[3]
            while low[4]:
                low = low[4]
            node[0], node[1] = low[0], low[1]
            node[3] = self._drop(node[3], low[0])
        level = 1 + min(node[3][2] if node[3] else 0, node[4][2] if node[4] else 0)
        if level < node[2]:
            node[2] = level
            if node[4] and node[4][2] > level:
                node[4][2] = level
        node = self._skew(node)
        if node[4]:
            node[4] = self._skew(node[4])
            if node[4][4]:
                node[4][4] = self._skew(node[4][4])
        node = self._split(node)
        if node[4]:
            node[4] = self._split(node[4])
        return node


Runs = dict[int, list[tuple[int, int]]]


def best_fit_decreasing(counts: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[Runs, int] | None:
    """Runs of bins for (size, count) pairs with falling sizes, and how many bins there are.

    The groups of a size, numbered from 0, go to the bins of its runs (count, bin) in turn. With ``most`` the
    answer is None if more bins than that were needed.
    """
    rooms, bins, runs = Rooms(), 0, {}
    for size, count in counts:
        placed = runs.setdefault(size, [])
        while count:
            room = rooms.tightest(size)
            if room is None:
                if most is not None and bins >= most or size > capacity:
                    return None
                room, number = capacity, bins
                bins += 1
            else:
                number = rooms.take(room)
            # The bin stays the tightest one as long as it holds another group of this size.
            n = min(count, room // size)
            placed.append((n, number))
            count -= n
            rooms.add(room - n * size, number)
    return runs, bins


def least_capacity(counts: list[tuple[int, int]], bins: int) -> tuple[Runs, int]:
    """The packing into at most ``bins`` bins of the smallest capacity that bisection finds, and that capacity.

    Above 2**16 bytes the search ends within a 2**-16 of the capacity, finer than sizes are told apart.
    """
    total = sum(size * count for size, count in counts)
    low = max([-(-total // bins), *(size for size, _ in counts[:1])])
    # Twice as much is always enough: a bin is opened only if none has room for the group.
    high, best = max(2 * low, 1), None
    while best is None:
        best = best_fit_decreasing(counts, high, bins)
        high = high if best else 2 * high
    found = high
    while found - low > low >> CAPACITY_BITS:
        middle = (low + found) // 2
        packed = best_fit_decreasing(counts, middle, bins)
        if packed:
            best, found = packed, middle
        else:
            low = middle + 1
    return best[0], found


def size_class(size: Column) -> Column:
    """The size rounded up to its ``SIZE_BITS`` leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size - 1)) - SIZE_BITS)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return F.ceil(size / step).cast("long") * step


def text_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, size, text_crc32 and ``group``, a number of the text."""
    data = text_bytes(F.col(f"`{text}`"))
    size = (F.octet_length(data) + ROW_BYTES).cast("long")
    return docs.select(
        F.col(f"`{key}`").alias("key"), size.alias("size"), F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("group"),
    )


def number_within(df: DataFrame, by: str, order: list[str], rows: int, out: str) -> DataFrame:
    """``df`` with ``out``, numbers from 0 within each ``by``, in slices of bounded size.

    Which row gets which number follows from a hash of ``order`` and, in a slice, from ``order`` itself.
    """
    slices = 1 + rows // SLICE_ROWS
    sliced = df.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    counted = sliced.groupBy(by, "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(by, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy(by, "slice").orderBy(*order)
    numbered = sliced.withColumn("within", F.row_number().over(within) - 1)
    return (
        numbered.join(before, [by, "slice"])
        .withColumn(out, (F.col("before") + F.col("within")).cast("long"))
        .drop("slice", "within", "before")
    )


def _counts(groups: DataFrame) -> list[tuple[int, int]]:
    counted = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((row["class"], row["n"]) for row in counted), reverse=True)


def take_out_large(counts: list[tuple[int, int]], shards: int) -> tuple[Runs, list[tuple[int, int]], int]:
    """Groups larger than a fair share of the rest, each with a shard of its own; what is left; shards used."""
    alone, used = {}, 0
    rest = list(counts)
    total = sum(size * count for size, count in rest)
    while rest and used < shards - 1:
        size, count = rest[0]
        if size * (shards - used) <= total:
            break
        alone.setdefault(size, []).append((1, used))
        used += 1
        total -= size
        rest[0] = (size, count - 1)
        if count == 1:
            rest.pop(0)
    return alone, rest, used


def place_groups(groups: DataFrame, runs: Runs, n_groups: int) -> DataFrame:
    """``groups`` (group, size, class) with the ``shard`` that the runs of their class give them."""
    rows = []
    for size, placed in runs.items():
        upto, ends = 0, []
        for n, _ in placed:
            upto += n
            ends.append(upto)
        rows.append((size, ends, [number for _, number in placed]))
    schema = "class long, ends array<long>, shards array<int>"
    table = groups.sparkSession.createDataFrame(rows, schema)
    ranked = number_within(groups, "class", ["group", "size"], n_groups, "rank")
    run = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    return ranked.join(table, "class").select("group", "size", F.get("shards", run).alias("shard"))


def _sharded(docs: DataFrame, key: str, text: str, pack) -> DataFrame:
    rows = stage(describe(docs, key, text))
    # Copies are combined before the shuffle; what goes on is a row per text.
    groups = rows.groupBy("group", "size").agg((F.count(F.lit(1)) * F.first("size")).alias("bytes"))
    groups = stage(groups.select("group", "size", size_class(F.col("bytes")).alias("class")))
    counts = _counts(groups)
    runs = pack(counts)
    placed = stage(place_groups(groups, runs, sum(n for _, n in counts)))
    joined = rows.join(placed, ["group", "size"])
    return number_within(stage(joined), "shard", ["key", "group"], rows.count(), "slot").select(
        F.col("key").alias(key), "size", "text_crc32", "shard", "slot"
    )


def equal_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard (from 0, below ``shards``) and slot (from 0 within its shard)."""

    def pack(counts: list[tuple[int, int]]) -> Runs:
        alone, rest, used = take_out_large(counts, shards)
        packed, _ = least_capacity(rest, shards - used) if rest else ({}, 0)
        for size, placed in packed.items():
            alone.setdefault(size, []).extend((n, number + used) for n, number in placed)
        return alone

    return _sharded(docs, key, text, pack)


def shards_of_capacity(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same with as few shards of at most ``capacity`` bytes as best fit, largest first, finds.

    A group larger than the capacity has a shard of its own.
    """

    def pack(counts: list[tuple[int, int]]) -> Runs:
        runs, used = {}, 0
        for size, count in counts:
            if size > capacity:
                runs[size] = [(1, used + i) for i in range(count)]
                used += count
        packed, _ = best_fit_decreasing([c for c in counts if c[0] <= capacity], capacity)
        for size, placed in packed.items():
            runs[size] = [(n, number + used) for n, number in placed]
        return runs

    return _sharded(docs, key, text, pack)
