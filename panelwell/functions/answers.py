"""Survey answer expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce_answer(answer: Column) -> Column:
    """yes → 1, no → 0 (any case, outer blanks ignored), numbers as numbers, the rest null."""
    text = F.trim(answer.cast("string"))
    # a cast reads Java literals such as 1d, 0x1p3 and Infinity, too; numbers end with a digit or a point
    last = F.substring(text, -1, 1)
    plain = (last.between("0", "9") | (last == ".")) & ~F.contains(F.lower(text), F.lit("x"))
    number = F.when(plain, text.try_cast("double"))
    return (
        F.when(F.lower(text) == "yes", F.lit(1.0))
        .when(F.lower(text) == "no", F.lit(0.0))
        .otherwise(number)
    )


def coerce_timestamp(text: Column) -> Column:
    """Text to a naive timestamp; text that is no timestamp becomes null instead of failing the job."""
    return text.try_cast("timestamp_ntz")
