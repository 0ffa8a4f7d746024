"""Scans, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwell.operators.cleaning import clip_upper_quantile
from panelwell.operators.identity import fold_identity
from panelwell.operators.metrics import binary_metrics, melt_metrics, score_table
from panelwell.registry import frames
from panelwell.registry.core import q6, query, r6
from panelwell.session import shared_path
from panelwell.sources import study
from panelwell.sources.manifest import (
    canonical_row,
    changed_chunks,
    digest_tree,
    id_ranges,
    manifest_audit,
    pinned_scan,
    read_manifest_ranges,
    table_digest,
    write_by_id,
    write_manifest,
)
from panelwell.sources.tables import CSV_OPTIONS, fold_metrics_wide, modality_union, scan_table, sink_fold_metrics, sink_predictions, write_shared

PINNED = [(100, 2_999), (4_000, 4_499), (6_000, 4_000_000_000)]

VALUE_TEXT = (
    "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(value AS VARCHAR) END"
)
TIME_TEXT = (
    "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE '.' || strftime({0}, '%f') END"
)
EVENT_TEXT = (
    "concat_ws(chr(31), CAST(event_id AS VARCHAR), " + TIME_TEXT.format("ts")
    + f", CAST(user_id AS VARCHAR), event_type, {VALUE_TEXT}, CAST(json(props) AS VARCHAR))"
)
LANES = ", ".join(
    f"CAST(coalesce(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)), 0) AS VARCHAR)" for i in range(4)
)


def nodes_sql(level: int, source: str, key: str, rows: str) -> str:
    """Nodes of one level of the digest tree from a source of children with their hashes ``h``."""
    name = "coalesce(CAST(any_value(node) AS VARCHAR), 'none')"
    return (
        f"SELECT node, {rows} AS n, sha256(concat_ws(chr(10), '{level}', {name}, CAST({rows} AS VARCHAR), {LANES})) AS h "
        f"FROM (SELECT *, CAST(floor({key}) AS BIGINT) AS node FROM ({source}) children) GROUP BY node"
    )


def leaves_sql(source: str, row_text: str) -> str:
    return nodes_sql(0, f"SELECT id, sha256({row_text}) AS h FROM {source}", "id / 4096", "count(*)")


def digest_sql(source: str, row_text: str, columns: list[str]) -> str:
    head = " || chr(31) || ".join(f"'{c}'" for c in columns)
    nodes = leaves_sql(source, row_text)
    for level in (1, 2):
        nodes = nodes_sql(level, f"SELECT node AS child, n, h FROM ({nodes}) below", "child / 256", "sum(n)")
    return (
        f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS \"rows\", "
        f"sha256(concat_ws(chr(10), {head}, CAST(coalesce(sum(n), 0) AS VARCHAR), {LANES})) AS digest FROM ({nodes}) top"
    )


SENSOR_COLUMNS = ["id", "app_user_id", "modality", "start_timestamp", "end_timestamp", "value", "app_source"]
SENSOR_TEXT = (
    "concat_ws(chr(31), CAST(id AS VARCHAR), CAST(app_user_id AS VARCHAR), modality, "
    + TIME_TEXT.format("start_timestamp") + ", " + TIME_TEXT.format("end_timestamp") + f", {VALUE_TEXT}, app_source)"
)


def _events_as_table(spark, sf):
    return study.events(spark, sf).withColumnRenamed("event_id", "id")


@query("scan_table", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(spark, sf):
    return scan_table(spark, f"{sf}/events.parquet")


@query(
    "pinned_scan",
    "SELECT event_id AS id, user_id, value FROM events WHERE event_id BETWEEN 100 AND 2999 "
    "OR event_id BETWEEN 4000 AND 4499 OR event_id BETWEEN 6000 AND 4000000000",
)
def _(spark, sf):
    return pinned_scan(_events_as_table(spark, sf), PINNED).select("id", "user_id", "value")


@query("pinned_scan_blocks", "SELECT id, app_user_id, value FROM v_sensor WHERE modality = 'step'", ("v_sensor",))
def _(spark, sf):
    """The ids of one modality, read from a table laid out by id blocks."""
    laid = write_by_id(study.sensor(spark, sf), shared_path(spark, "by-id"), 1 << 10)
    recorded = id_ranges(study.sensor(spark, sf).filter("modality = 'step'"))
    return pinned_scan(laid, recorded.select("first_id", "last_id"), 1 << 10).select("id", "app_user_id", "value")


@query("pinned_scan_many_ranges", "SELECT id, app_user_id, value FROM v_sensor WHERE modality = 'step'", ("v_sensor",))
def _(spark, sf):
    # the ids of the step rows are the manifest; it has thousands of ranges
    recorded = id_ranges(study.sensor(spark, sf).filter("modality = 'step'"))
    return pinned_scan(study.sensor(spark, sf), recorded.select("first_id", "last_id")).select("id", "app_user_id", "value")


@query(
    "id_ranges",
    "SELECT min(id) AS first_id, max(id) AS last_id, count(*) AS n_ids FROM "
    "(SELECT id, id - row_number() OVER (ORDER BY id) AS island FROM v_sensor) GROUP BY island",
    ("v_sensor",),
)
def _(spark, sf):
    return id_ranges(study.sensor(spark, sf))


@query("canonical_row", f"SELECT event_id AS id, {EVENT_TEXT} AS row_text FROM events")
def _(spark, sf):
    return canonical_row(_events_as_table(spark, sf), ["props"])


@query("table_digest", digest_sql("(SELECT *, event_id AS id FROM events)", EVENT_TEXT, ["id", "ts", "user_id", "event_type", "value", "props"]))
def _(spark, sf):
    return table_digest(_events_as_table(spark, sf), ["props"])


RESPONSE_COLUMNS = ["id", "app_user_id", "timestamp", "survey_id"]
RESPONSE_TEXT = (
    "concat_ws(chr(31), CAST(id AS VARCHAR), CAST(app_user_id AS VARCHAR), " + TIME_TEXT.format("timestamp") + ", CAST(survey_id AS VARCHAR))"
)
#: Table -> (rows found, rows recorded, row text, columns): one as recorded, one with rows lost, one with rows altered.
AUDITED = {
    "step": ("(SELECT * FROM v_sensor WHERE modality = 'step')", "(SELECT * FROM v_sensor WHERE modality = 'step')", SENSOR_TEXT, SENSOR_COLUMNS),
    "distance": (
        "(SELECT * FROM v_sensor WHERE modality = 'distance' AND id % 499 <> 3)", "(SELECT * FROM v_sensor WHERE modality = 'distance')",
        SENSOR_TEXT, SENSOR_COLUMNS,
    ),
    "survey_response": (
        "v_response", "(SELECT * REPLACE (CAST(survey_id + (id % 499 = 3)::INTEGER AS INTEGER) AS survey_id) FROM v_response)",
        RESPONSE_TEXT, RESPONSE_COLUMNS,
    ),
}


def _audited(spark, sf):
    """(table, rows found, rows recorded), as in ``AUDITED``."""
    sensors, responses = study.sensor(spark, sf), study.survey_response(spark, sf)
    step, distance = sensors.filter("modality = 'step'"), sensors.filter("modality = 'distance'")
    altered = responses.withColumn("survey_id", F.col("survey_id") + (F.col("id") % 499 == 3).cast("int"))
    return [("step", step, step), ("distance", distance.filter("id % 499 <> 3"), distance), ("survey_response", responses, altered)]


@query(
    "manifest_audit",
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", f.\"rows\", r.\"rows\" AS pinned_rows, CASE WHEN f.\"rows\" <> r.\"rows\" THEN 'deleted' "
        f"WHEN f.digest <> r.digest THEN 'changed' ELSE 'match' END AS status "
        f"FROM ({digest_sql(found, text, columns)}) f, ({digest_sql(recorded, text, columns)}) r"
        for name, (found, recorded, text, columns) in AUDITED.items()
    ) + " UNION ALL SELECT 'answer', (SELECT count(*) FROM v_answer), NULL, 'unpinned'",
    ("v_sensor", "v_response", "v_answer"),
)
def _(spark, sf):
    def named(table, df):
        return table_digest(df).select(F.lit(table).alias("table"), "rows", "digest")

    found, recorded = named("answer", study.answer(spark, sf)), None
    for table, now, then in _audited(spark, sf):
        found = found.unionByName(named(table, now))
        recorded = named(table, then) if recorded is None else recorded.unionByName(named(table, then))
    return manifest_audit(found, recorded)


@query(
    "manifest_changed_chunks",
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", CAST(node * 4096 AS BIGINT) AS first_id, CAST(node * 4096 + 4095 AS BIGINT) AS last_id, "
        f"coalesce(f.n, 0) AS \"rows\", coalesce(r.n, 0) AS pinned_rows, "
        f"CASE WHEN r.h IS NULL THEN 'added' WHEN f.h IS NULL THEN 'deleted' ELSE 'changed' END AS status "
        f"FROM ({leaves_sql(found, text)}) f FULL JOIN ({leaves_sql(recorded, text)}) r USING (node) WHERE f.h IS DISTINCT FROM r.h"
        for name, (found, recorded, text, columns) in AUDITED.items()
    ),
    ("v_sensor", "v_response"),
)
def _(spark, sf):
    def named(table, df):
        return digest_tree(df).select(F.lit(table).alias("table"), "level", "node", "rows", "digest")

    found = recorded = None
    for table, now, then in _audited(spark, sf):
        found = named(table, now) if found is None else found.unionByName(named(table, now))
        recorded = named(table, then) if recorded is None else recorded.unionByName(named(table, then))
    return changed_chunks(found, recorded)


RANGES_SQL = (
    "SELECT min(id) AS first_id, max(id) AS last_id FROM "
    "(SELECT id, id - row_number() OVER (ORDER BY id) AS island FROM (SELECT DISTINCT id FROM v_sensor)) GROUP BY island"
)


@query(
    "write_manifest",
    "SELECT 'sensor' AS \"table\", first_id, last_id, \"rows\", digest FROM (" + digest_sql("v_sensor", SENSOR_TEXT, SENSOR_COLUMNS) + f"), ({RANGES_SQL})",
    ("v_sensor",),
)
def _(spark, sf):
    path = shared_path(spark, "manifest")
    head = write_manifest(study.sensor(spark, sf), path, "sensor")
    # every range that was written, read back beside the table's row count and digest (one row)
    ranges = read_manifest_ranges(spark, path, "sensor").withColumn("table", F.lit("sensor"))
    return ranges.join(F.broadcast(head), "table").select("table", "first_id", "last_id", "rows", "digest")


@query("modality_union", "SELECT * FROM v_sensor", ("v_sensor",))
def _(spark, sf):
    sensors = study.sensor(spark, sf)
    step = sensors.filter("modality = 'step'").withColumnRenamed("value", "steps").drop("modality")
    distance = sensors.filter("modality = 'distance'").withColumnRenamed("value", "distance").drop("modality")
    return modality_union({"step": (step, "steps"), "distance": (distance, "distance")})


@query(
    "shared_cohort",
    f"SELECT modality, count(*) AS n, count(DISTINCT app_user_id) AS n_users, {q6('sum(value)')} AS total FROM v_sensor GROUP BY modality",
    ("v_sensor",),
)
def _(spark, sf):
    shared = write_shared(study.sensor(spark, sf), shared_path(spark, "cohort"), ["modality"])
    return shared.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("app_user_id").alias("n_users"), r6(F.sum("value")).alias("total")
    )


@query(
    "sink_predictions",
    f"SELECT fold_index, survey_response_id, app_user_id, record_timestamp, y_true, {q6('prob_class_0')} AS prob_class_0, "
    f"{q6('prob_class_1')} AS prob_class_1 FROM v_predictions",
    ("v_predictions",),
)
def _(spark, sf):
    table = frames.predictions(spark, sf).withColumns({c: r6(c) for c in ("prob_class_0", "prob_class_1")})
    path = shared_path(spark, "predictions")
    sink_predictions(table, path)
    return spark.read.schema(table.schema).options(**CSV_OPTIONS).csv(path)


FOLD_COUNTS = """
SELECT fold_index, count_if(y_true = 1 AND prob_class_1 > 0.5) AS tp, count_if(y_true = 0 AND prob_class_1 > 0.5) AS fp,
  count_if(y_true = 1 AND NOT prob_class_1 > 0.5) AS fn, count_if(y_true = 0 AND NOT prob_class_1 > 0.5) AS tn
FROM v_predictions GROUP BY fold_index"""
FOLD_USERS = """
SELECT fold_index, CAST(sum(number) % 4294967296 AS BIGINT) AS test_user_hash, CAST(sum(n) AS BIGINT) AS test_n_responses FROM (
  SELECT fold_index, CAST('0x' || substr(md5(CAST(app_user_id AS VARCHAR)), 1, 8) AS BIGINT) AS number, count(*) AS n
  FROM v_predictions GROUP BY fold_index, app_user_id) GROUP BY fold_index"""


@query(
    "sink_fold_metrics",
    f"SELECT 'protocol' AS pipeline, fold_index, test_user_hash, test_n_responses, {q6('CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END')} AS precision, {q6('tp / (tp + fn)')} AS recall, "
    f"{q6('tn / (tn + fp)')} AS specificity FROM ({FOLD_COUNTS}) JOIN ({FOLD_USERS}) USING (fold_index)",
    ("v_predictions",),
)
def _(spark, sf):
    metrics = ["precision", "recall", "specificity"]
    # read by the metrics and twice by the identity
    tested = frames.stored_predictions(spark, sf)
    wide = binary_metrics(score_table(tested, ["fold_index"]), ["fold_index"], max_group=frames.in_all(spark, sf))
    long = melt_metrics(wide, ["fold_index"], metrics)
    rows = fold_metrics_wide(long, ["fold_index"], metrics)
    known = fold_identity(frames.master(spark, sf), tested)
    written = sink_fold_metrics(rows, shared_path(spark, "fold-metrics"), {"pipeline": "protocol"}, known)
    return written.select("pipeline", "fold_index", "test_user_hash", "test_n_responses", *[r6(m).alias(m) for m in metrics])


@query(
    "clip_upper_quantile_approximate",
    None,
)
def _(spark, sf):
    return clip_upper_quantile(study.sensor(spark, sf), 0.99, approximate=True)
