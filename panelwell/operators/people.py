"""Participant tables: wide demographics, one-hot features, user numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.operators.cleaning import device_source_onehot, exact_quantile
from panelwell.operators.ordered import ordered_columns

# Keywords of the demographic table, defaults for age, fallback categories.
KEYWORDS = ("age", "gender at birth", "gender identity", "lgbt")
RENAMED = {"gender identity": "gender", "gender at birth": "gender_at_birth"}
AGE_DEFAULTS = (30.0, 30.0, 10.0)
GENDERS = ("female", "male", "nonbinary")
LGBT = ("no", "yes")


def eav_pivot(demographic: DataFrame, keywords: Sequence[str] = KEYWORDS, rest: str | None = None) -> DataFrame:
    """Keyword rows to one row per user; gender falls back to gender at birth.

    ``keywords`` become columns; all others are kept in a map column named ``rest``, if given. Of
    several values of one keyword the largest counts.
    """
    columns = [F.max(F.when(F.col("keyword") == k, F.col("value"))).alias(RENAMED.get(k, k)) for k in keywords]
    if rest is not None:
        single = demographic.groupBy("app_user_id", "keyword").agg(F.max("value").alias("value"))
        other = F.col("keyword").isNotNull() & ~F.col("keyword").isin(*keywords)
        # collect_list leaves out the nulls of the named keywords
        pairs = F.collect_list(F.when(other, F.struct("keyword", "value")))
        wide = single.groupBy("app_user_id").agg(*columns, F.map_from_entries(pairs).alias(rest))
    else:
        wide = demographic.groupBy("app_user_id").agg(*columns)
    if "gender" not in wide.columns:
        wide = wide.withColumn("gender", F.lit(None).cast("string"))
    if "gender_at_birth" in wide.columns:
        wide = wide.withColumn("gender", F.coalesce("gender", "gender_at_birth"))
    return wide


def user_index_lookup(df: DataFrame, train: DataFrame, max_group: int | None = None) -> DataFrame:
    """Adds ``user_index``: train users 1..n in order of appearance, everyone else 0.

    The master table is in (user, time) order, so appearance order is the order of user ids.
    """
    users = train.select("app_user_id").distinct()
    numbered = ordered_columns(users, [], [F.col("app_user_id")], position="__pos", max_group=max_group)
    index = numbered.select("app_user_id", (F.col("__pos") + 1).alias("user_index"))
    return df.join(index, "app_user_id", "left").withColumn("user_index", F.coalesce("user_index", F.lit(0).cast("bigint")))


def age_stats(demographics: DataFrame, train_users: DataFrame, max_group: int | None = None) -> DataFrame:
    """One row: train median, mean and sample deviation of age, defaults where undefined."""
    ages = (
        demographics.join(train_users.select("app_user_id").distinct(), "app_user_id", "left_semi")
        .select(F.col("age").try_cast("double").alias("age"))
        .filter("age is not null")
    )
    median = exact_quantile(ages.withColumn("__all", F.lit(1)), ["__all"], "age", 0.5, "age_median", max_group)
    moments = ages.agg(F.avg("age").alias("__m"), F.stddev_samp("age").alias("__s")).withColumn("__all", F.lit(1))
    d_median, d_mean, d_std = AGE_DEFAULTS
    return moments.join(median, "__all", "left").select(
        F.coalesce("age_median", F.lit(d_median)).alias("age_median"),
        F.coalesce("__m", F.lit(d_mean)).alias("age_mean"),
        F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.lit(d_std)).alias("age_std"),
    )


def _clean(column: str) -> Column:
    return F.lower(F.trim(F.col(column)))


def onehot(column: str, categories: Sequence[str]) -> dict[str, Column]:
    value = F.coalesce(_clean(column), F.lit(""))
    flags = {f"{column}_{c}": (value == c).cast("double") for c in categories}
    return {**flags, f"{column}_unknown": (~value.isin(*categories)).cast("double")}


def fit_demographics(
    demographics: DataFrame,
    train_users: DataFrame,
    genders: Sequence[str] = GENDERS,
    lgbt: Sequence[str] = LGBT,
    max_group: int | None = None,
) -> DataFrame:
    """Per user scaled age and one-hot gender and lgbt, all fitted on train users only.

    Category lists fix the columns; other values set the unknown flag.
    """
    stats = age_stats(demographics, train_users, max_group)
    # the statistics are a single row, taken in as scalar subqueries
    number = F.coalesce(F.col("age").try_cast("double"), stats.select("age_median").scalar())
    scaled = (number - stats.select("age_mean").scalar()) / stats.select("age_std").scalar()
    return demographics.select(
        "app_user_id", scaled.alias("age_scaled"),
        *[c.alias(n) for n, c in {**onehot("gender", genders), **onehot("lgbt", lgbt)}.items()],
    )


def demographics_by_fold(
    rows: DataFrame, demographics: DataFrame, genders: Sequence[str] = GENDERS, lgbt: Sequence[str] = LGBT, max_group: int | None = None,
    by: Sequence[str] = ("fold_index",),
) -> DataFrame:
    """Attaches age, gender and lgbt features to fold rows, the age scaled by the fold's train participants.

    Participants without demographics get 0 and "unknown" flags 1.
    """
    person = demographics.select("app_user_id", F.col("age").try_cast("double").alias("age"), "gender", "lgbt")
    trained = rows.filter("role = 'train'").select(*by, "app_user_id").distinct()
    ages = trained.join(person.filter("age is not null").select("app_user_id", "age"), "app_user_id")
    median = exact_quantile(ages, list(by), "age", 0.5, "__median", max_group)
    moments = ages.groupBy(*by).agg(F.avg("age").alias("__m"), F.stddev_samp("age").alias("__s")).join(median, list(by), "left")
    flags = {**onehot("gender", genders), **onehot("lgbt", lgbt)}
    known = person.select("app_user_id", F.lit(True).alias("__known"), "age", *[c.alias(n) for n, c in flags.items()])
    d_median, d_mean, d_std = AGE_DEFAULTS
    number = F.coalesce("age", "__median", F.lit(d_median))
    scaled = (number - F.coalesce("__m", F.lit(d_mean))) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.lit(d_std))
    # one row per fold meets all rows
    joined = rows.join(F.broadcast(moments), list(by), "left").join(known, "app_user_id", "left")
    filled = [F.coalesce(F.col(n), F.lit(1.0 if n.endswith("_unknown") else 0.0)).alias(n) for n in flags]
    return joined.select(*rows.columns, F.when(F.col("__known"), scaled).otherwise(0.0).alias("age_scaled"), *filled)


def demographics_lookup(df: DataFrame, features: DataFrame, sensors: DataFrame | None = None) -> DataFrame:
    """Attaches demographic (and device) features; a user without them gets 0 and "unknown" flags 1."""
    columns = [c for c in features.columns if c != "app_user_id"]
    joined = df.join(features, "app_user_id", "left")
    if sensors is not None:
        device = device_source_onehot(sensors)
        columns += [c for c in device.columns if c != "app_user_id"]
        joined = joined.join(device, "app_user_id", "left")
    filled = [F.coalesce(F.col(c), F.lit(1.0 if c.endswith("_unknown") else 0.0)).alias(c) for c in columns]
    return joined.select(*df.columns, *filled)
