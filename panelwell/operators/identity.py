"""Fingerprints of cohorts and test folds.

The fingerprint of a set of users is the sum of per-user hashes modulo 2^32: no order, no
duplicates (users are made distinct first), and no list of users in any single place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SPACE = 1 << 32


def user_number(user: str = "app_user_id") -> Column:
    return F.conv(F.substring(F.md5(F.col(user).cast("string")), 1, 8), 16, 10).cast("bigint")


def fingerprint() -> Column:
    """The aggregate over distinct users."""
    total = F.sum(user_number().cast("decimal(38,0)"))
    return F.coalesce(F.pmod(total, F.lit(HASH_SPACE)).cast("bigint"), F.lit(0).cast("bigint"))


def user_set_hash(df: DataFrame, by: Sequence[str] = (), name: str = "user_hash") -> DataFrame:
    """Fingerprint (below 2^32) and number of the distinct users per group."""
    users = df.select(*by, "app_user_id").distinct()
    return users.groupBy(*by).agg(fingerprint().alias(name), F.count(F.lit(1)).alias("n_users"))


def fold_identity(cohort: DataFrame, tested: DataFrame, by: Sequence[str] = ("fold_index",)) -> DataFrame:
    """Per fold the fingerprint, users and rows of the cohort and of the fold's test rows."""
    users = cohort.groupBy("app_user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))
    # one pass over the cohort gives all three of its numbers
    whole = users.agg(F.struct(fingerprint().alias("h"), F.count(F.lit(1)).alias("users"), rows.alias("rows")).alias("c"))
    folds = user_set_hash(tested, by, "test_user_hash").withColumnRenamed("n_users", "test_n_users")
    sizes = tested.groupBy(*by).agg(F.count(F.lit(1)).alias("test_n_responses"))
    return folds.join(sizes, list(by)).withColumn("c", whole.scalar()).select(
        *by,
        F.col("c.h").alias("cohort_hash"),
        F.col("c.users").alias("cohort_n_users"),
        F.col("c.rows").alias("cohort_n_responses"),
        "test_user_hash", "test_n_users", "test_n_responses",
    )


def cohort_drift_check(cohorts: DataFrame, by: Sequence[str] = ("fold_index",)) -> DataFrame:
    """One row: distinct cohort fingerprints over the units, and whether the cohort changed."""
    hashes = user_set_hash(cohorts, by)
    return hashes.agg(
        F.count(F.lit(1)).alias("n_units"), F.countDistinct("user_hash").alias("n_cohorts")
    ).withColumn("drifted", F.col("n_cohorts") > 1)
