"""Study tables derived from the driver's tables (``FIXTURES.md`` §2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwell.sources.tables import scan_table

# Fixed values of the derived study: question ids of the answer table.
SCALE_QUESTIONS = (2, 3, 5, 7)
YES_NO_QUESTIONS = (8, 12, 13)
SLEEP_QUESTIONS = (54, 55)
ALL_QUESTIONS = (2, 3, 5, 7, 8, 12, 13, 54, 55)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, data_type) for name, data_type in columns.items()])


# Explicit schemas: no job reads file footers before the query runs.
EVENTS = _schema(
    event_id=T.LongType(), ts=T.TimestampNTZType(), user_id=T.LongType(), event_type=T.StringType(),
    value=T.DoubleType(), props=T.StringType(),
)
ORDERS = _schema(
    o_orderkey=T.LongType(), o_custkey=T.LongType(), o_orderstatus=T.StringType(), o_totalprice=T.DoubleType(),
    o_orderdate=T.TimestampNTZType(), o_orderpriority=T.StringType(),
)
CUSTOMER = _schema(
    c_custkey=T.LongType(), c_name=T.StringType(), c_nationkey=T.IntegerType(), c_acctbal=T.DoubleType(),
    c_mktsegment=T.StringType(),
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/events.parquet", EVENTS)


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sensor table: clicks are steps, views are distances."""
    device = (
        F.when(F.col("user_id") % 5 == 0, "iPhone 13")
        .when(F.col("user_id") % 5 == 1, "health.connect.androidx")
        .when(F.col("user_id") % 5 == 2, "Apple Watch")
        .when(F.col("user_id") % 5 == 3, F.when(F.col("event_id") % 2 == 0, "iPhone 13").otherwise("androidx.health"))
        .otherwise("Health")
    )
    minutes = (F.col("event_id") % 7 * 5).cast("int")
    return (
        events(spark, sf_dir)
        .filter(F.col("event_type").isin("click", "view"))
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("app_user_id"),
            F.when(F.col("event_type") == "click", "step").otherwise("distance").alias("modality"),
            F.col("ts").alias("start_timestamp"),
            (F.col("ts") + F.make_dt_interval(mins=minutes)).cast("timestamp_ntz").alias("end_timestamp"),
            "value",
            device.alias("app_source"),
        )
    )


def survey_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    survey = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return (
        events(spark, sf_dir)
        .filter(F.col("event_type").isin("signup", "error", "purchase"))
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("app_user_id"),
            F.col("ts").alias("timestamp"),
            survey.cast("int").alias("survey_id"),
        )
    )


def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, even = F.col("k"), F.col("event_id") % 2 == 0

    def text(question: int) -> F.Column:
        if question in SCALE_QUESTIONS:
            return (1 + F.greatest(F.lit(0), (k + 13 * question) % 61 - 57)).cast("string")
        if question in YES_NO_QUESTIONS:
            return F.when((k + 7 * question) % 53 == 0, "Yes").when(even, "no").otherwise(" No")
        if question == 54:
            return F.concat((9 + k % 3).cast("string"), F.when(even, ":00").otherwise(":30"), F.lit(" PM"))
        return F.concat((5 + k % 5).cast("string"), F.lit(":15 AM"))

    # the texts are made before the rows, so that filters on them do not parse the props anew for each reference
    answers = F.array(*[F.struct(F.lit(i).alias("question_id"), text(i).alias("answer")) for i in ALL_QUESTIONS])
    return (
        events(spark, sf_dir)
        .filter(F.col("event_type").isin("signup", "error", "purchase"))
        .select("event_id", _k().alias("k"))
        .select("event_id", F.explode(answers).alias("__a"))
        .select("event_id", "__a.question_id", "__a.answer")
        .filter((F.col("event_id") + F.col("question_id")) % 11 != 0)
        .select(
            (F.col("event_id") * 100 + F.col("question_id")).alias("id"),
            F.col("event_id").alias("survey_response_id"), "question_id", "answer",
        )
    )


def question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question styles, one row per question that the answers mention."""
    q = F.col("id")
    style = (
        F.when(q.isin(2, 3, 5), "5-scale-much").when(q == 7, "5-scale-intense")
        .when(q.isin(*YES_NO_QUESTIONS), "yes-no").otherwise("time")
    )
    return answer(spark, sf_dir).select(F.col("question_id").alias("id")).distinct().select("id", style.alias("style"))


def demographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    birth = F.when(key % 2 == 0, "female").otherwise("male")
    identity = F.when(key % 4 == 0, F.lit(None)).when(key % 3 == 0, "nonbinary").otherwise(birth)
    lgbt = F.when(F.col("c_mktsegment") == "BUILDING", "yes").otherwise("no")
    pairs = F.array(
        F.struct(F.lit("age").alias("keyword"), (18 + key % 50).cast("string").alias("value")),
        F.struct(F.lit("gender at birth").alias("keyword"), birth.alias("value")),
        F.struct(F.lit("gender identity").alias("keyword"), identity.alias("value")),
        F.struct(F.lit("lgbt").alias("keyword"), lgbt.alias("value")),
    )
    return (
        scan_table(spark, f"{sf_dir}/customer.parquet", CUSTOMER)
        .select(key.alias("app_user_id"), F.explode(pairs).alias("kv"))
        .select("app_user_id", "kv.keyword", "kv.value")
        .filter("value is not null")
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger response history out of orders; its timestamps have ties within a user."""
    return scan_table(spark, f"{sf_dir}/orders.parquet", ORDERS).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("app_user_id"),
        F.col("o_orderdate").alias("record_timestamp"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("answer"),
    )
