"""Canonical text of a cell, the form that row digests are taken over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_SEPARATOR = "\x1f"


def float_text(value: Column) -> Column:
    """Shortest round-trip text: ``1.0``, ``12345678.5``, ``1e-05``; null for NaN and null."""
    number = value.cast("double")
    shortest = number.cast("string")
    size = F.abs(number)
    whole = F.concat(number.try_cast("bigint").cast("string"), F.lit(".0"))
    plain = F.rtrim(shortest.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    mantissa = F.regexp_replace(F.regexp_extract(shortest, r"^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(shortest, r"E-?(\d+)$", 1)
    scientific = F.concat(
        mantissa,
        F.when(shortest.contains("E-"), F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent),
    )
    return (
        F.when(F.isnan(number), F.lit(None).cast("string"))
        .when((size < 1e16) & (number == F.floor(number)), F.when((number == 0) & shortest.startswith("-"), F.lit("-0.0")).otherwise(whole))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(size < float("inf"), scientific)
        .otherwise(F.when(number > 0, F.lit("inf")).otherwise(F.lit("-inf")))
    )


def timestamp_text(value: Column) -> Column:
    """ISO text with six fraction digits, none when the fraction is zero."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(value, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def sorted_json(value: Column) -> Column:
    """Compact JSON text with object keys sorted at every level; text that is no JSON stays as it is.

    A variant value keeps its object fields in key order, so printing it back sorts them.
    """
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def cell_text(column: Column, data_type: T.DataType, is_json: bool = False) -> Column:
    """Text of one cell by type; null becomes the empty string."""
    if is_json:
        text = sorted_json(column.cast("string"))
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = float_text(column)
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        text = timestamp_text(column)
    elif isinstance(data_type, T.BooleanType):
        text = F.when(column, F.lit("True")).when(~column, F.lit("False"))
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def row_text(columns: list[tuple[Column, T.DataType, bool]]) -> Column:
    return F.concat_ws(CELL_SEPARATOR, *[cell_text(c, t, j) for c, t, j in columns])
