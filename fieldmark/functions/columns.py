"""Scalar column helpers: paths, predicates, relabelling and score arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label of a row that matches no known individual.
NEW_INDIVIDUAL = "new_individual"

# Identity prefixes that a submission may use.
IDENTITY_PREFIXES = ("SeaTurtleID2022_", "SalamanderID2025_", "LynxID2025_")

# Fixed value: makes the MAD of normal data estimate its standard deviation.
MAD_TO_SIGMA = 1.4826

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:/+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- paths -----------------------------------------------------------------


def relative_path(path: str | Column, root: str) -> Column:
    """Path below ``root``; a path outside ``root`` fails the query.

    Works for any URI scheme, because scheme and leading slashes are dropped
    from both sides before the prefix is compared.
    """
    prefix = re.sub(_SCHEME, "/", root).rstrip("/") + "/"
    plain = F.regexp_replace(_col(path), _SCHEME, "/")
    outside = F.raise_error(F.concat(plain, F.lit(f" is not below {prefix}")))
    return (
        F.when(plain.isNull(), F.lit(None).cast("string"))
        .when(plain.startswith(prefix), plain.substr(F.lit(len(prefix) + 1), F.length(plain)))
        .otherwise(outside.cast("string"))
    )


def file_suffix(path: str | Column) -> Column:
    """Last suffix with its dot, or an empty string; dot files have none."""
    return F.regexp_extract(_col(path), r"[^/](\.[^./]+)/*$", 1)


def path_part(path: str | Column, index: int) -> Column:
    """Path component by 1-based index; negative counts from the end."""
    trimmed = F.regexp_replace(_col(path), "/+$", "")
    return F.try_element_at(F.split(trimmed, "/+"), F.lit(index))


def name_prefix(name: str | Column, separator: str = "_") -> Column:
    return F.substring_index(_col(name), separator, 1)


def key_value_int(c: str | Column) -> Column:
    """Integer right of the first ``=``; NULL where there is no ``=``."""
    c = _col(c)
    return F.when(c.like("%=%"), F.split(c, "=").getItem(1).cast("int"))


# --- predicates ------------------------------------------------------------


def is_known(identity: str | Column = "identity") -> Column:
    return _col(identity).isNotNull()


def is_frequent(
    identity: str | Column = "identity",
    count: str | Column = "identity_count",
    more_than: int = 2,
) -> Column:
    """Labelled rows whose identity has more than ``more_than`` images."""
    return is_known(identity) & (_col(count) > more_than)


def within_gate(
    distance: str | Column,
    median: str | Column,
    mad: str | Column,
    threshold: str | Column | float,
) -> Column:
    """True where the modified z-score is strictly below ``threshold``.

    Multiplied out rather than divided, so that ``mad = 0`` neither fails nor
    needs infinities: the accepted rows are then those below the median.
    """
    limit = _col(threshold) if isinstance(threshold, (str, Column)) else F.lit(float(threshold))
    return (_col(distance) - _col(median)) < limit * _col(mad) * F.lit(MAD_TO_SIGMA)


# --- labels and samples ----------------------------------------------------


def hash_bucket(key: str | Column, buckets: int) -> Column:
    """CRC-32 bucket of the key's text; the same for every run and layout."""
    return F.crc32(_col(key).cast("string")) % F.lit(buckets)


def query_label(
    identity: str | Column, species: str | Column, split: str | Column
) -> Column:
    """``<species>_query`` for query rows, the identity otherwise."""
    return F.when(
        _col(split) == "query", F.concat(_col(species), F.lit("_query"))
    ).otherwise(_col(identity))


def known_species(species: str | Column, allowed: list[str]) -> Column:
    """Species outside ``allowed``, NULL included, become ``unknown``."""
    c = _col(species)
    return F.when(c.isin(*allowed), c).otherwise(F.lit("unknown"))


def joined_text(columns: list[str], separator: str = ",") -> Column:
    return F.concat_ws(separator, *columns)


# --- score arithmetic ------------------------------------------------------


def modified_z(
    distance: str | Column, median: str | Column, mad: str | Column
) -> Column:
    """Modified z-score; NULL where the MAD is 0."""
    return F.try_divide(
        _col(distance) - _col(median), _col(mad) * F.lit(MAD_TO_SIGMA)
    )


def geometric_mean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(_col(a) * _col(b))


def crossover(a: str | Column, b: str | Column) -> Column:
    return F.lit(1.0) - F.abs(_col(a) - _col(b))


def round_half_even(c: str | Column, digits: int = 2) -> Column:
    return F.bround(_col(c), digits)


def hinge(c: str | Column) -> Column:
    return F.greatest(_col(c), F.lit(0.0))


def linspace(low: float, high: float, n: int) -> list[float]:
    """``n`` evenly spaced values with both ends included."""
    if n < 1:
        return []
    if n == 1:
        return [float(low)]
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [float(high)]
