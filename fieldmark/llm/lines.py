"""Removal of repeated lines by an exact set-similarity join.

A line is the set of its words, as sorted fingerprints. Lines with equal sets are one class, known by its first line
in the order of (id, line number). Sets that are similar enough differ in few words, d at most. So the range of
fingerprints is cut into more than d parts, and two such sets agree in all words of at least one part: classes meet
in the buckets of equal parts. How many parts there are depends on the size of the larger set, on one of a few levels;
a class is at home on the level of its own size and a guest on that of the largest set that the length filter lets it
meet, where that is another one. Parts hold several words, frequent or not, so few classes meet that are not similar.
The length filter and, for classes with company, a parity filter (sets that differ in d words differ in at most d of
64 parities) drop most of these before Jaccard similarities are computed. Sets so small that one word more or less is
too much have equal sets only, and no bucket. A class needs one earlier partner only. In a bucket of up to ``HEAVY``
classes all meet; in a larger one all meet the earliest class first, then the earliest that is not similar to it, and
only classes that are still open meet all earlier ones. So a group of thousands of near copies costs a few comparisons
a member, and no removal is missed.

A line goes if an equal or similar line comes earlier in the input, whether that one stays or not; so the
outcome does not depend on the order of work. Lines of fewer than ``least_words`` distinct words are left alone.

Only built-in functions run. Sets are told apart by 128 bits. Copies are combined before the shuffle and are one
row after it, so a line that a third of all documents have is one class. Words are hashed in one pass; a second one
reads only lines of classes with company. Texts move once, and only those that lose a line.

Null texts stay null. Rows with one id and one text are one document: their lines stay or go alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.frames import SPACE_CLASS, SPACES, fresh
from fieldmark.sources.staging import Owner, stage

#: Bits of the filters of keys, at least and at most, kept in 64-bit words. Beyond the bound a semi-join does their work.
FILTER_BITS = 16
MOST_FILTER_BITS = 25
#: Bits for a key.
FILTER_SHARE = 16
HUB_ROUNDS = 2
#: Buckets of more classes than this meet a hub first; in others all meet at once.
HEAVY = 32
#: Sets cut into more parts than this take the way whose time does not grow with the number of parts.
FEW_PARTS = 16


def spaced(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` whose white space other than the end of a line is the space: a split at a single character needs no pattern."""
    for space in SPACES.replace(" ", "").replace("\n", ""):
        # The look for the character is quicker than the look for what to replace.
        docs = docs.withColumn(text, F.when(F.contains(text, F.lit(space)), F.replace(text, F.lit(space), F.lit(" "))).otherwise(F.col(text)))
    return docs


def words_of(line: Column) -> Column:
    """Fingerprints of the distinct words of a spaced line, sorted; they are odd numbers."""
    odd = lambda word: F.xxhash64(word).bitwiseOR(F.lit(1))
    # Neighbouring spaces have the empty word between them.
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(F.split(line, " "), odd)), odd(F.lit(""))))


def _in_filter(table: Column, code: Column, bits: int) -> Column:
    place = code.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    word = F.get(table, F.shiftright(place, 6))
    return F.getbit(word, place.bitwiseAND(F.lit(63))) == 1


def _filter_of(codes: DataFrame, bits: int) -> Column:
    """A set filter of fixed size, as an array that a subquery gives; it only spares work.

    As a constant it would stand in every plan, and in the driver's memory as often.
    """
    place = F.col("code").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    held = codes.select(F.shiftright(place, 6).alias("word"), one.alias("bits"))
    every = codes.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = held.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("listed"))
    return listed.select("listed.bits").scalar()


def parity(words: Column) -> Column:
    """64 bits, each the parity of the words that fall on it: sets that differ in d words differ in at most d bits."""
    bit = lambda word: F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, word: bits.bitwiseXOR(bit(word)))


def parts_for(n: Column, percent: int) -> Column:
    """Into how many parts sets of at most ``n`` words are cut: more than the words in which similar ones differ.

    There are few such numbers, 1, 2, 3, 4, 6, 8, 12, 16 and so on. Between neighbours lies at least the ratio of sizes
    that the length filter allows, so a set meets those on its own level and the next.
    """
    differ = F.floor(2 * n.cast("long") * (100 - percent) / (100 + percent))
    bits = F.length(F.bin(differ))
    one = F.lit(1).cast("long")
    if percent >= 75:
        low = F.greatest(bits - 2, F.lit(0))
        return F.call_function("shiftleft", F.call_function("shiftright", differ, low) + 1, low)
    step = math.ceil(math.log2(100 / percent))
    return F.when(differ == 0, one).otherwise(F.call_function("shiftleft", one, F.ceil(bits / step).cast("int") * step))


def _limits(parts: Column) -> Column:
    """What parts the range of words; limits are even, words are odd."""
    cuts = [[(i * (((1 << 63) - 1) // n) - (1 << 62)) * 2 for i in range(1, n)] for n in range(1, FEW_PARTS + 1)]
    table = F.array(*(F.array(*map(F.lit, listed)).cast("array<bigint>") for listed in cuts))
    half = F.call_function("div", F.lit((1 << 63) - 1), parts)
    many = F.transform(F.sequence(F.lit(1).cast("long"), parts - 1), lambda i: (F.lit(-(1 << 62)) + i * half) * 2)
    return F.when(parts <= FEW_PARTS, F.get(table, (parts - 1).cast("int"))).when(parts > 1, many)


def with_parts(sets: DataFrame, words: str, parts: str, out: str) -> DataFrame:
    """``sets`` with ``out``: the fingerprint of each of the ``parts`` of the range of words; null for a single part."""
    limits, merged, ends = fresh(sets, "limits", "merged", "ends")
    n = F.col(parts)
    sets = sets.withColumn(limits, _limits(n)).withColumn(merged, F.when(n > 1, F.sort_array(F.concat(words, limits))))
    # A few parts are slices between the limits, all of it compiled code; lambdas are not.
    behind = [
        F.coalesce(F.array_position(merged, F.get(limits, F.lit(i))).cast("int"), F.size(merged) + 1) for i in range(FEW_PARTS)
    ]
    sets = sets.withColumn(ends, F.when((n > 1) & (n <= FEW_PARTS), F.array(F.lit(0), *behind)))
    end = lambda i: F.get(ends, F.lit(i))
    part = lambda i: F.slice(merged, end(i) + 1, end(i + 1) - end(i) - 1)
    few = F.slice(F.array(*(F.when(n > i, F.xxhash64(n, F.lit(i), part(i))) for i in range(FEW_PARTS))), F.lit(1), n.cast("int"))
    # The text of many parts is built and cut in one pass, so that time grows with the length of a line and not with
    # its square.
    listed = F.transform(
        merged, lambda value: F.when(value.bitwiseAND(F.lit(1)) == 0, F.lit(";")).otherwise(value.cast("string"))
    )
    many = F.transform(F.split(F.array_join(listed, ","), ";"), lambda part, i: F.xxhash64(parts, i, part))
    hashes = F.when(n <= FEW_PARTS, few).otherwise(many)
    return sets.withColumn(out, F.when(n > 1, hashes)).drop(limits, merged, ends)


def _with_company(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """``tokens`` whose key is in ``keys`` (distinct), and few others where a filter of bounded size can tell."""
    wanted = keys.count()
    bits = max(FILTER_BITS, (FILTER_SHARE * wanted).bit_length())
    if bits > MOST_FILTER_BITS:
        return tokens.join(keys, "code", "left_semi")
    return tokens.where(_in_filter(_filter_of(keys, bits), F.col("code"), bits))


def removed_lines(
    docs: DataFrame, percent: int = 90, least_words: int = 5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """k1, k2 (of the row) and ``removed``: numbers of the lines that go, from 0. Other rows are not listed."""
    with Owner() as mine:
        return mine.hand_over(stage(_removed_lines(mine, docs, percent, least_words, key, text)))


def _removed_lines(mine: Owner, docs: DataFrame, percent: int, least_words: int, key: str, text: str) -> DataFrame:
    slim = docs.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("k2"), F.col(f"`{text}`").alias("body")
    )

    def lines_of(docs: DataFrame) -> DataFrame:
        return spaced(docs, "body").select("key", "k2", F.posexplode(F.split("body", "\n")).alias("line", "content"))

    where = F.struct("key", "k2", "line")
    ids = ["s1", "s2"]
    # There is no filter on the number of words here: it would be pushed down and hash every word once more.
    sets = lines_of(slim).select(where.alias("where"), words_of(F.col("content")).alias("words"))
    n = F.size("words")
    sets = sets.select("where", "words", n.alias("n"), F.when(100 * n >= percent * (n + 1), n).alias("joins"))
    widest = F.floor(F.col("joins") * 100 / percent)
    sets = sets.withColumns({"own": parts_for(F.col("joins"), percent), "next": parts_for(widest, percent)})
    sets = sets.withColumn("next", F.when(F.col("next") > F.col("own"), F.col("next")))
    sets = with_parts(with_parts(sets, "words", "own", "home"), "words", "next", "away")
    listed = stage(
        sets.select(
            "where", F.when(F.col("n") >= max(1, least_words), F.xxhash64("words")).alias("s1"),
            F.xxhash64(F.lit(1), "words").alias("s2"), "n", "home", "away",
        )
    ).where("s1 IS NOT NULL")
    classes = stage(
        listed.groupBy(*ids, "n", "home", "away").agg(F.min("where").alias("first"), F.count(F.lit(1)).alias("copies"))
    )

    # A class is at home in the buckets of its own level and a guest in those of the next one.
    none = F.array().cast("array<bigint>")
    homes = F.coalesce(F.size("home"), F.lit(0))
    placed = classes.select(
        *ids, "n", "first", homes.alias("homes"), F.posexplode(F.concat(F.coalesce("home", none), F.coalesce("away", none))).alias("at", "code")
    )
    tokens = placed.select("code", "n", "first", *ids, (F.col("at") >= F.col("homes")).cast("int").alias("guest"))
    # Keys are counted alone, combined before the shuffle; those of a single class go no further.
    shared = stage(
        tokens.groupBy("code").agg(F.count(F.lit(1)).alias("c"), F.min("guest").alias("guest"))
        .where("c > 1 AND guest = 0").select("code", "c")
    )
    met = stage(_with_company(tokens, shared.select("code")).join(shared.select("code"), "code", "left_semi"))
    # The words of classes with company, from the one line that stands for each.
    wanted = stage(met.select("first").distinct())
    of_docs = _with_company(
        slim.withColumn("code", F.xxhash64("key", "k2")), wanted.select(F.xxhash64("first.key", "first.k2").alias("code")).distinct()
    )
    chosen = _with_company(
        lines_of(of_docs).select(F.xxhash64(where).alias("code"), where.alias("first"), "content"),
        wanted.select(F.xxhash64("first").alias("code")),
    )
    # Rows that are the same document twice give the same words.
    words = stage(chosen.select("first", words_of(F.col("content")).alias("words")).dropDuplicates(["first"]))
    buckets = stage(met.join(words.select("first", parity(F.col("words")).alias("bits")), "first"))
    mine.done(met)
    large = shared.where(F.col("c") > HEAVY).select("code")

    def later_of(pairs: DataFrame, decided: DataFrame | None) -> DataFrame:
        """``decided`` and those ``late`` classes of ``pairs`` that are similar to their ``early`` one."""
        a = words.select(F.col("first").alias("early"), F.col("words").alias("words_a"))
        b = words.select(F.col("first").alias("late"), F.col("words").alias("words_b"))
        both = F.size(F.array_intersect("words_a", "words_b"))
        either = F.size("words_a") + F.size("words_b") - both
        found = pairs.join(a, "early").join(b, "late").where(100 * both >= percent * either)
        found = found.select(F.col("late").alias("first"), *ids)
        return stage((found if decided is None else found.unionByName(decided)).distinct())

    def candidates(early: DataFrame, late: DataFrame) -> DataFrame:
        """Pairs that share a bucket and pass the length and the parity filter."""
        carried = ("n", "first", "bits", "guest")
        left = early.select("code", *(F.col(c).alias(f"{c}_a") for c in carried))
        right = late.select("code", *ids, *(F.col(c).alias(f"{c}_b") for c in carried))
        na, nb = F.col("n_a"), F.col("n_b")
        unlike = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))
        return (
            left.join(right, "code")
            .where((F.col("first_a") < F.col("first_b")) & (F.col("guest_a") + F.col("guest_b") < 2))
            .where(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            .where((100 + percent) * unlike <= (100 - percent) * (na + nb))
            .select(F.col("first_a").alias("early"), F.col("first_b").alias("late"), *ids)
            .distinct()
        )

    # In small buckets all meet at once, in large ones first the hub: the earliest class at home there that is open
    # and has not been a hub. What is still open after that meets every earlier class of its bucket.
    small = buckets.join(large, "code", "left_anti")
    heavy = stage(buckets.join(large, "code", "left_semi"))
    later, open_lines, fresh_hubs = None, heavy, heavy
    for turn in range(HUB_ROUNDS):
        hub = F.min(F.struct("first", "n", "bits", "guest")).alias("hub")
        hubs = stage(fresh_hubs.where("guest = 0").groupBy("code").agg(hub).select("code", "hub.*"))
        pairs = candidates(hubs, open_lines)
        later = later_of(pairs if turn else pairs.unionByName(candidates(small, small)).distinct(), later)
        if not turn:
            mine.done(buckets)
        gone = later.select("first")
        open_lines = stage(heavy.join(gone, "first", "left_anti"))
        fresh_hubs = fresh_hubs.join(gone, "first", "left_anti").join(hubs.select("code", "first"), ["code", "first"], "left_anti")
        if open_lines.isEmpty():
            break
    else:
        later = later_of(candidates(heavy, open_lines), later)
    # Classes of one line that is not a later one lose nothing.
    several = classes.where("copies > 1").select(*ids, "first", F.lit(False).alias("later"))
    fate = stage(
        several.unionByName(later.select(*ids, "first", F.lit(True).alias("later")))
        .groupBy(*ids).agg(F.min("first").alias("first"), F.max("later").alias("later"))
    )
    marked = _with_company(
        listed.select("where", *ids, F.xxhash64(*ids).alias("code")), fate.select(F.xxhash64(*ids).alias("code")).distinct()
    )
    gone = marked.drop("code").join(fate, ids).where(F.col("later") | (F.col("where") != F.col("first")))
    return gone.groupBy(F.xxhash64("where.key").alias("k1"), F.col("where.k2").alias("k2")).agg(
        F.collect_set("where.line").alias("removed")
    )


def drop_repeated_lines(
    docs: DataFrame, percent: int = 90, least_words: int = 5, key: str = "doc_id", text: str = "text",
    out: str | None = None,
) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and with ``out`` the numbers of the removed lines."""
    k1, k2, removed = fresh(docs, "k1", "k2", "removed")
    found = removed_lines(docs, percent, least_words, key, text).select(
        F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("removed").alias(removed)
    )
    marked = docs.withColumns({k1: F.xxhash64(F.col(f"`{key}`")), k2: F.xxhash64(F.col(f"`{text}`"))})
    joined = marked.join(found.hint("shuffle_hash"), [k1, k2], "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    (split_lines,) = fresh(joined, "lines")
    joined = joined.withColumn(split_lines, F.when(F.col(removed).isNotNull(), lines))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split_lines) - 1), F.col(removed))
    kept = F.when(
        F.col(removed).isNull(), F.col(f"`{text}`")
    ).otherwise(
        F.when(F.size(stay) == 0, F.lit("")).otherwise(
            F.array_join(F.transform(stay, lambda i: F.get(split_lines, i)), "\n")
        )
    )
    columns = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if out:
        columns.append(F.coalesce(F.col(removed), F.array().cast("array<int>")).alias(out))
    return joined.select(*columns)
