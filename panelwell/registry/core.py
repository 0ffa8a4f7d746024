"""The registry: query name → (Spark callable, check SQL or none)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwell.registry.views import VIEWS
from panelwell.session import require_utc

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def with_views(body: str, needs: tuple[str, ...]) -> str:
    """Puts the needed views (and what they need) in front of ``body`` as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in VIEWS[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    # computed once: several of them are read more than once
    parts = [f"{name} AS MATERIALIZED (\n{VIEWS[name][1]}\n)" for name in ordered]
    # a body may bring common table expressions of its own, recursive ones among them
    text = body.lstrip()
    for opening, head in (("WITH RECURSIVE ", "WITH RECURSIVE "), ("WITH ", "WITH ")):
        if text.startswith(opening):
            return head + ",\n".join(parts) + ",\n" + text[len(opening):]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the time grid is in UTC; the session of a check may come with another zone
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            require_utc(spark)
            return fn(spark, sf_dir)

        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(run, None if sql is None else with_views(sql, needs))
        return fn

    return add


#: Added before rounding: means of two-decimal values hit exact halves of the sixth decimal, and
#: which way those round would depend on the order of summation. It also avoids negative zero.
NUDGE = 2.3e-8


def r6(column: Column | str) -> Column:
    """Six decimals, the same in both engines."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double") + F.lit(NUDGE), 6)


def q6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE!r}::DOUBLE, 6)"
