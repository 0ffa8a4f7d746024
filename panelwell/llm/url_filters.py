"""URL filters by a temporal join with dated lists.

List entries (pattern, category, action, day) become validity intervals: from an entry's day to the
next day on which the state of its pattern and category changes. A capture is judged by the intervals
that hold its fetch day. Patterns are hosts, which cover their subdomains, or a host with the first
step of a path. Only the distinct (host, step, day) of the captures are joined with the list, month by
month, so a host with very many captures is judged once a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: scheme, user and port are left out; the host ends at a slash, query, fragment or port
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
STEP = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    """The lower-cased host without a trailing dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def step_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, STEP, 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, action, valid_from, valid_to (exclusive; null: open) of the entries in force.

    ``entries`` has pattern, category, action (``block``, ``allow`` or ``remove``) and day. Entries with
    a null in any of these take no part; repeated ones count once. Of several actions of one pattern and
    category on one day the alphabetically last holds: remove over block over allow. An entry that
    repeats the state before it changes nothing.
    """
    known = entries.where(" AND ".join(f"{c} IS NOT NULL" for c in ("pattern", "category", "action", "day")))
    daily = known.groupBy("pattern", "category", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern", "category").orderBy("day")
    changes = daily.withColumn("before", F.lag("action").over(order)).where(~F.col("action").eqNullSafe(F.col("before")))
    return changes.withColumn("valid_to", F.lead("day").over(order)).where(F.col("action") != "remove").select(
        "pattern", "category", "action", F.col("day").alias("valid_from"), "valid_to"
    )


def suffixes(host: Column) -> Column:
    """The host and its parents, down to two labels (a host of one label stands for itself)."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (with ``url`` and ``fetched``, a date) and url_host, url_blocked, url_pattern, url_categories.

    Among the entries active on the fetch day the longest pattern decides (ties: the alphabetically
    first; of one pattern ``block`` over ``allow``): ``url_pattern`` is that pattern, ``url_blocked``
    whether it blocks, ``url_categories`` the sorted categories of all its active entries of that action.
    Captures without a match, without a host or without a fetch day are not blocked (pattern null, no
    categories). Repeated captures are judged each; other columns stay, columns with the four names are
    replaced. With an empty list nothing is blocked.
    """
    own = ["url_host", "url_blocked", "url_pattern", "url_categories"]
    kept = [c for c in captures.columns if c not in own]
    rows = captures.select(*kept).withColumns({"url_host": host_of(F.col("url")), "__step": step_of(F.col("url"))})
    keys = rows.where(F.col("url_host").isNotNull() & F.col("fetched").isNotNull()).select("url_host", "__step", "fetched").distinct()
    with_step = F.when(F.col("__step") != "", F.array(F.concat("url_host", F.lit("/"), "__step"))).otherwise(F.array().cast("array<string>"))
    patterns = F.concat(with_step, suffixes(F.col("url_host")))
    asked = keys.select("url_host", "__step", "fetched", F.explode(patterns).alias("pattern"), F.trunc("fetched", "month").alias("month"))
    # an interval is repeated for each month it touches, open ones up to the last fetch day; a state
    # lasts a day at least, so a pattern and category has at most 31 of them in a month
    last = rows.agg(F.max("fetched")).first()[0]
    end = F.coalesce(F.date_sub("valid_to", 1), F.greatest(F.lit(last).cast("date"), F.col("valid_from")))
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    active = intervals(entries).withColumn("month", F.explode(months))
    met = asked.join(active, ["pattern", "month"]).where((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    ranked = met.groupBy("url_host", "__step", "fetched", "pattern", "action").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    order = F.struct((-F.char_length("pattern")).alias("a"), "pattern", (F.col("action") == "allow").alias("c"))
    verdict = ranked.groupBy("url_host", "__step", "fetched").agg(F.min_by(F.struct("pattern", "action", "categories"), order).alias("v"))
    right = verdict.select(F.col("url_host").alias("__h"), F.col("__step").alias("__s"), F.col("fetched").alias("__d"), "v")
    same = (F.col("url_host") == F.col("__h")) & (F.col("__step") == F.col("__s")) & (F.col("fetched") == F.col("__d"))
    return rows.join(right, same, "left").select(
        *kept, "url_host", F.coalesce(F.col("v.action") == "block", F.lit(False)).alias("url_blocked"), F.col("v.pattern").alias("url_pattern"),
        F.coalesce("v.categories", F.array().cast("array<string>")).alias("url_categories"),
    )
