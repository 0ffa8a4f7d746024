"""Table scans, the long sensor table, and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Naive timestamps keep their microseconds in text.
CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark orders NaN above all numbers; missing measures are nulls here."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def scan_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Whole-table read. Columns and filters of later steps reach the Parquet scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_to_null(reader.parquet(path))


def scan_jdbc(
    spark: SparkSession, url: str, table: str, lower_id: int, upper_id: int, partitions: int, **options: str
) -> DataFrame:
    """The same from a database: parallel reads over ranges of the ``id`` key."""
    return nan_to_null(
        spark.read.jdbc(
            url, table, column="id", lowerBound=lower_id, upperBound=upper_id,
            numPartitions=partitions, properties=dict(options),
        )
    )


def modality_union(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One long sensor table out of several; ``tables`` maps modality → (table, value column).

    Optional columns (``id``, ``app_source``) are null where a table lacks them; a table without
    ``end_timestamp`` has records that end where they start. Text that is no time becomes null.
    """
    if not tables:
        raise ValueError("modality_union needs at least one table")
    parts = []
    for modality in sorted(tables):
        table, value_column = tables[modality]

        def optional(name: str, data_type: str) -> Column:
            return F.col(name).cast(data_type) if name in table.columns else F.lit(None).cast(data_type)

        parts.append(
            table.select(
                optional("id", "bigint").alias("id"),
                F.col("app_user_id").cast("bigint").alias("app_user_id"),
                F.lit(modality).alias("modality"),
                F.col("start_timestamp").try_cast("timestamp_ntz").alias("start_timestamp"),
                F.col("end_timestamp" if "end_timestamp" in table.columns else "start_timestamp").try_cast("timestamp_ntz").alias("end_timestamp"),
                F.col(value_column).cast("double").alias("value"),
                optional("app_source", "string").alias("app_source"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_shared(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes a table once and returns the read of it, so that folds and settings share one scan."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sink_predictions(df: DataFrame, path: str | None, file_format: str = "csv") -> bool:
    """Writes pooled predictions; nothing is written without a path or without rows."""
    if not path or df.isEmpty():
        return False
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.parquet(path)
    return True


def fold_metrics_wide(long_metrics: DataFrame, tags: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per fold from long ``(tags…, metric, value)`` rows; the metric list is fixed, so no extra pass."""
    return long_metrics.groupBy(*tags).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )


def sink_fold_metrics(wide: DataFrame, path: str, tags: Mapping[str, str] | None = None, identity: DataFrame | None = None, by: Sequence[str] = ("fold_index",)) -> DataFrame:
    """Appends one row per fold: tags, fingerprints and sizes of its rows (``identity``), metrics. Returns the whole table.

    Tags are columns of text with one value each; a fold without an identity has nulls there.
    """
    rows = wide if identity is None else wide.join(identity, list(by), "left")
    rows = rows.select(*[F.lit(value).cast("string").alias(name) for name, value in (tags or {}).items()], *rows.columns)
    rows.write.mode("append").parquet(path)
    return wide.sparkSession.read.schema(rows.schema).parquet(path)
