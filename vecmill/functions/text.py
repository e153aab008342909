"""String helpers of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def method_key(name: Column) -> Column:
    """Lower case without spaces, hyphens and underscores."""
    return F.lower(F.regexp_replace(name, "[ _-]", ""))


def neighbourhood_size(label: Column) -> Column:
    """The number after a final L; an error where there is none."""
    found = F.regexp_extract(label, r"L(\d+)$", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no L-value in "), label))).otherwise(found.cast("int"))


def relabel(name: Column, old: str, new: str) -> Column:
    return F.replace(name, F.lit(old), F.lit(new))


def fixed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", x)


def nearest_value(keys: Column, values: Column, wanted: float) -> Column:
    """The value whose key is nearest to ``wanted``, the first on a tie; keys and values are parallel arrays."""
    pairs = F.transform(keys, lambda k, i: F.struct(F.abs(k - wanted).alias("gap"), i.alias("i"), F.get(values, i).alias("v")))
    return F.array_min(pairs)["v"]


def exact_value(keys: Column, values: Column, wanted) -> Column:
    """The value under a key; null where it is missing."""
    at = F.array_position(keys, F.lit(wanted))
    return F.when(at > 0, F.get(values, (at - 1).cast("int")))
