"""Secret scans with a ledger of what has been scanned.

A text is stored under the SHA-256 of its bytes. The ledger says which pairs of blob and rule version have
been scanned and what was found; a run scans only the pairs that the ledger lacks, each blob once however
many paths hold it, and the findings are joined back to every path. With no ledger all blobs are unseen.

Only built-in functions run. The blobs' ids are grouped without their texts; then every text goes through
one shuffle, to the row that stands for its blob. A blob that a third of all paths share is one row there,
and the join back is keyed on the blob with one finding per key, so its large side can be split.
Null texts are empty ones and have no finding; repeated rows each get their findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.frames import fresh
from fieldmark.sources.staging import stage

#: Kinds in the order in which findings at one place are listed: pattern, group that is measured, least
#: length. Version 1 holds the first three, version 2 all.
ASSIGN_PATTERN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (ASSIGN_PATTERN, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
}
RULES: dict[int, tuple[str, ...]] = {1: ("assign", "access", "hex"), 2: tuple(KINDS)}
BASE = RULES[1]

SPAN = "struct<start:long,place:int,end:long>"


def _spans(text: str, kind: str) -> Column:
    """Array of (start, place of the kind, end) in code points, of matches long enough.

    The pieces between matches and the matches themselves alternate, so running lengths give the places.
    """
    pattern, group, least = KINDS[kind]
    place = list(KINDS).index(kind)
    matches = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else matches
    parts = F.arrays_zip(
        F.split(F.col(text), pattern).alias("gap"), matches.alias("whole"), measured.alias("value")
    )
    empty = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("found")
    )

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["whole"]), F.lit(0))
        span = F.struct(
            begin.cast("long").alias("start"), F.lit(place).alias("place"), end.cast("long").alias("end")
        )
        kept = F.coalesce(F.length(part["value"]) >= least, F.lit(False))
        return F.struct(
            end.cast("long").alias("at"),
            F.when(kept, F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"),
        )

    found = F.aggregate(parts, empty, step, lambda state: state["found"])
    return F.when(F.col(text).rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def add_blob(docs: DataFrame, text: str = "text", out: str = "blob") -> DataFrame:
    """The content address of every row's text: SHA-256 of its UTF-8 bytes."""
    return docs.withColumn(out, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))


def scan_blobs(
    docs: DataFrame, rule_version: int, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Findings of the blobs that ``ledger`` lacks under this version: blob, rule_version, spans.

    ``spans`` is an array of (start, place in KINDS, end), by start and place. Blobs without a finding are
    listed too, with no span: they have been scanned. Of a blob that ``ledger`` has under an earlier version
    only the kinds that this version adds are scanned; what was found is kept.
    """
    path = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    slim = docs.select(path.alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    slim = add_blob(slim, "body")
    unseen = slim.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        unseen = unseen.join(seen, "blob", "left_anti")
    base = max((v for v in RULES if v < rule_version and set(RULES[v]) <= set(RULES[rule_version])), default=None)
    if ledger is not None and base is not None:
        known = ledger.where(F.col("rule_version") == base).select("blob", F.col("spans").alias("known"))
        unseen = unseen.join(known, "blob", "left")
    standing = slim.join(unseen.hint("shuffle_hash"), ["path", "blob"])
    if "known" in standing.columns:
        old = F.flatten(F.array(*(_spans("body", kind) for kind in RULES[base])))
        added = [_spans("body", kind) for kind in RULES[rule_version] if kind not in RULES[base]]
        found = F.concat(F.coalesce(F.col("known"), old), *added)
    else:
        found = F.flatten(F.array(*(_spans("body", kind) for kind in RULES[rule_version])))
    scanned = standing.select("blob", F.array_sort(found).alias("spans"))
    # A path that is listed twice with one text stands twice for its blob.
    return scanned.groupBy("blob").agg(F.first("spans").alias("spans")).select(
        "blob", F.lit(rule_version).alias("rule_version"), "spans"
    )


def extend_ledger(ledger: DataFrame | None, findings: DataFrame) -> DataFrame:
    """The ledger with this run's pairs of blob and rule version."""
    return findings if ledger is None else ledger.unionByName(findings)


def build_ledger(docs: DataFrame, rule_version: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger after a run of each version up to ``rule_version``; earlier ones are written before the next."""
    ledger = None
    for version in sorted(v for v in RULES if v <= rule_version):
        ledger = stage(ledger) if ledger is not None else None
        ledger = extend_ledger(ledger, scan_blobs(docs, version, ledger, key, text))
    return ledger


def join_findings(docs: DataFrame, ledger: DataFrame, rule_version: int, text: str = "text") -> DataFrame:
    """``docs`` without its texts, and the ``spans`` that the ledger has for each row's blob."""
    blob, spans = fresh(docs, "blob", "spans")
    slim = add_blob(docs, text, blob).drop(text)
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select(
        F.col("blob").alias(blob), F.col("spans").alias(spans)
    )
    joined = slim.join(found, blob, "left").withColumn(
        spans, F.coalesce(F.col(spans), F.array().cast(f"array<{SPAN}>"))
    )
    return joined.select(*(F.col(f"`{c}`") for c in slim.columns if c != blob), F.col(spans).alias("spans"))


def redact_found(docs: DataFrame, ledger: DataFrame, rule_version: int, text: str = "text") -> DataFrame:
    """``docs`` with every finding of the ledger blotted out; other texts, null ones too, stay as they are."""
    blob, spans = fresh(docs, "blob", "spans")
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select(
        F.col("blob").alias(blob), F.col("spans").alias(spans)
    )
    joined = add_blob(docs, text, blob).join(found, blob, "left")
    clean = F.when(F.col(spans).isNull(), F.col(f"`{text}`")).otherwise(redact(f"`{text}`", spans))
    return joined.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def listed(spans: str, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """The spans of some kinds as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(kind) for kind in KINDS))
    places = [list(KINDS).index(kind) for kind in kinds]
    wanted = F.filter(spans, lambda s: s["place"].isin(places))
    return F.array_join(
        F.transform(
            wanted,
            lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def count_kind(spans: str, kind: str) -> Column:
    place = list(KINDS).index(kind)
    return F.size(F.filter(spans, lambda s: s["place"] == place)).cast("long")


def redact(text: str, spans: str) -> Column:
    """``text`` with every span replaced by ``[REDACTED]``; overlapping spans become one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def step(state: Column, span: Column) -> Column:
        inside = span["start"] < state["at"]
        gap = F.substring(F.col(text), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(inside, state["done"]).otherwise(F.concat(state["done"], gap, F.lit("[REDACTED]"))).alias("done"),
        )

    def finish(state: Column) -> Column:
        rest = F.substring(F.col(text), (state["at"] + 1).cast("int"), F.length(F.col(text)))
        return F.concat(state["done"], rest)

    return F.aggregate(spans, start, step, finish)
