"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document. Its outcome is a bit (1: failed) and the numbers behind
it are kept, so that a policy is only a mask over the bits: a new version of a policy, or the question
what a policy without one of its rules would keep, reads the ledger and never a text.

Only built-in functions run here. A document is measured inside its row, without a shuffle; the texts
are not moved. Null and empty texts have no words, so they fail ``few_words``. Rows that share an id are
measured one by one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.frames import SPACE_CLASS, SPACES, fresh

SYMBOLS = "#*$%&|<>"

#: Rule name -> the condition under which it fails, over the measured numbers. The place in this table
#: is the rule's bit, so new rules are only ever added at its end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "many_symbols": "100 * n_symbols > 40 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
}

#: Version of a policy -> the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols"),
    "v2": tuple(RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(rules: Sequence[str]) -> int:
    """The bits of some rules."""
    places = list(RULES)
    return sum(1 << places.index(rule) for rule in set(rules))


def add_ledger(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """``docs`` and a struct ``out`` of all measures and ``bits``.

    A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage
    return. A line counts if it has a word; it is a repeat if an earlier line is equal. A word counts as
    repeated if it stands in a window of three words that occurs twice or more, the first one included.
    """
    trimmed, words, lines, hashes = fresh(docs, "trimmed", "words", "lines", "hashes")
    ordered, places = fresh(docs, "ordered", "places")
    n = F.size(words)
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.withColumn(trimmed, F.btrim(source, F.lit(SPACES)))
    df = df.withColumns(
        {
            words: F.when(F.col(trimmed) == "", F.array().cast("array<string>")).otherwise(
                F.split(trimmed, f"{SPACE_CLASS}+")
            ),
            lines: F.filter(F.split(source, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""),
        }
    )
    df = df.withColumn(
        hashes,
        F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(
                    F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)
                ),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Most texts repeat no window; only the others sort theirs.
    df = df.withColumn(
        ordered,
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.sort_array(
                F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("place")))
            ),
        ),
    )
    def twin(x: Column, i: Column) -> Column:
        before, after = F.get(ordered, i - 1)["h"], F.get(ordered, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    df = df.withColumn(
        places,
        F.when(
            F.col(ordered).isNotNull(),
            F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["place"])),
        ),
    )
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")),
        lambda a, p: F.struct(
            (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum"), p.alias("last")
        ),
        lambda a: a["sum"],
    )

    def count(column: Column) -> Column:
        return column.cast("long")

    measures = {
        "n_words": count(n),
        "word_chars": count(F.length(F.translate(trimmed, SPACES, ""))),
        "n_symbols": count(F.length(source) - F.length(F.translate(source, SYMBOLS, ""))),
        "n_lines": count(F.size(lines)),
        "n_dup_lines": count(F.size(lines) - F.size(F.array_distinct(lines))),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    }
    (measured,) = fresh(docs, "measured")
    df = df.withColumn(measured, F.struct(*(c.alias(name) for name, c in measures.items())))
    bits = F.lit(0).cast("long")
    for place, condition in enumerate(RULES.values()):
        failed = F.expr(re.sub(r"\b[a-z]\w+\b", lambda m: f"{measured}.{m[0]}", condition))
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    ledger = F.struct(*(F.col(f"{measured}.{name}").alias(name) for name in MEASURES), bits.alias("bits"))
    return df.select(*(F.col(f"`{c}`") for c in docs.columns), ledger.alias(out))


def apply_policy(bits: Column, version: str, policies: Mapping[str, Sequence[str]] = POLICIES) -> Column:
    """True where no rule of the policy failed."""
    return bits.bitwiseAND(F.lit(mask(policies[version]))) == 0


def ablations(ledger: DataFrame, version: str, bits: str = "bits") -> DataFrame:
    """For every rule of a policy: documents that fail it, and those that would stay without it.

    The ledger is first counted by its bits, so at most 2**rules rows are looked at per rule.
    """
    policy = mask(POLICIES[version])
    counted = ledger.groupBy(F.col(bits).bitwiseAND(F.lit(policy)).alias("bits")).agg(
        F.count(F.lit(1)).alias("docs")
    )
    rules = F.array(
        *(F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[version])
    )
    each = counted.select("bits", "docs", F.explode(rules).alias("r")).select("bits", "docs", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("docs")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("docs")).otherwise(0)).alias("failed_alone"),
    )
