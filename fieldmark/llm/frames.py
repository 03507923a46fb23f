"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: White space that parts words: the space and the control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, whatever the letter case."""
    taken = {name.lower() for name in df.columns}
    names = []
    for name in wanted:
        candidate = f"_{name}"
        while candidate.lower() in taken:
            candidate = f"_{candidate}"
        taken.add(candidate.lower())
        names.append(candidate)
    return names
