"""The dialect's scalar functions as columns: all are Spark built-ins, none runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """True division; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; NULL for a zero divisor."""
    return F.try_mod(F.try_mod(a, b) + b, b)


def like_ci(a: Column, pattern: str) -> Column:
    """LIKE without regard to case."""
    return a.ilike(pattern)


def round_half_even(a: Column, digits: int = 0) -> Column:
    return F.bround(a.cast("double"), digits).cast("double")


def trim_space(a: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(a, r"^\s+|\s+$", "")


def concat_op(*parts: Column) -> Column:
    """``||``: NULL if any part is NULL."""
    return F.concat(*[p.cast("string") for p in parts])


def to_integer(a: Column, numeric: bool = True) -> Column:
    """Truncating cast; what cannot be cast, text with a fraction included, is NULL."""
    return a.try_cast("bigint")


def to_real(a: Column) -> Column:
    return a.try_cast("double")


def to_text(a: Column) -> Column:
    return a.cast("string")


def to_boolean(a: Column) -> Column:
    return a.try_cast("boolean")


#: Names that the dialect gives to Spark's types.
TYPE_NAMES = {"void": "null", "boolean": "integer", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "real", "double": "real", "string": "text", "binary": "blob"}


def type_name(a: Column) -> Column:
    """null, integer, real, text or blob."""
    spark_type = F.typeof(a)
    found = F.when(a.isNull(), F.lit("null"))
    for theirs, ours in TYPE_NAMES.items():
        found = found.when(spark_type == theirs, F.lit(ours))
    return found.otherwise(F.when(spark_type.startswith("decimal"), F.lit("real")).otherwise(spark_type))


def nulls_last(a: Column, descending: bool = False) -> Column:
    """A sort key with NULLs behind all values, in either direction."""
    return a.desc_nulls_last() if descending else a.asc_nulls_last()


def kleene(condition: Column) -> Column:
    """What a filter makes of a condition: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def shard_number(key: Column, shards: int) -> Column:
    """md5(key), as one 128-bit number, modulo ``shards``: Horner's scheme over four 32-bit parts."""
    digest = F.md5(key.cast("string"))
    number = F.lit(0).cast("bigint")
    for i in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        number = (number * F.lit((1 << 32) % shards) + part) % F.lit(shards)
    return number.cast("int")
