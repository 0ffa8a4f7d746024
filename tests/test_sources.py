import json

from pyspark.sql import functions as F

from panelwell.functions.text import float_text, sorted_json
from panelwell.sources import manifest
from panelwell.sources.tables import sink_predictions

SCHEMA = "id bigint, app_user_id bigint, timestamp timestamp_ntz, additional_data string, status string"


def table(spark, ts, extra='{"a": 1, "b": {"y": 2, "x": 3}}', order=1):
    rows = [(1, 7, ts("2026-01-01 10:00:00"), extra, None), (2, 8, ts("2026-01-01 10:00:00.5"), "{}", "ok")]
    return spark.createDataFrame(rows[::order], SCHEMA)


def digest(df):
    return tuple(manifest.table_digest(df, ["additional_data"]).first())


def test_digest_ignores_row_and_key_order(spark, ts):
    base = digest(table(spark, ts))
    assert base == digest(table(spark, ts, order=-1).repartition(5))
    assert base == digest(table(spark, ts, '{"b": {"x": 3, "y": 2}, "a": 1}'))
    assert base != digest(table(spark, ts, '{"a": 2}'))
    assert base != digest(table(spark, ts).unionByName(table(spark, ts)))


LONG = "id bigint, value double"


def named(df):
    return manifest.digest_tree(df).select(F.lit("t").alias("table"), "level", "node", "rows", "digest")


def test_changed_chunks_are_named(spark):
    ids = list(range(0, 3_000_000, 1_000)) + [-1, -5_000, None, None]
    base = spark.createDataFrame([(i, float(n)) for n, i in enumerate(ids)], LONG)
    later = base.filter("id is null or id <> 1000000").withColumn(
        "value", F.when(F.col("id").isin(-5_000, 2_000_000) | (F.col("id").isNull() & (F.col("value") > 3_002.5)), -1.0).otherwise(F.col("value"))
    ).unionByName(spark.createDataFrame([(9_000_000, 1.0)], LONG))
    found = {tuple(r)[1:] for r in manifest.changed_chunks(named(later.repartition(5)), named(base)).collect()}
    size = manifest.CHUNK_IDS
    chunks = {c: [i for i in ids if i is not None and i // size == c] for c in (-2, 2_000_000 // size, 1_000_000 // size)}
    expected = {(c * size, c * size + size - 1, len(rows), len(rows), "changed") for c, rows in chunks.items()}
    c = 1_000_000 // size
    expected -= {(c * size, c * size + size - 1, len(chunks[c]), len(chunks[c]), "changed")}
    expected |= {(c * size, c * size + size - 1, len(chunks[c]) - 1, len(chunks[c]), "changed"), (None, None, 2, 2, "changed")}
    c = 9_000_000 // size
    assert found == expected | {(c * size, c * size + size - 1, 1, 0, "added")}
    assert manifest.changed_chunks(named(base), named(base.orderBy(F.desc("value")))).isEmpty()


def test_tree_root_is_the_table_digest_and_empty_tables_have_one(spark, tmp_path):
    base = spark.createDataFrame([(1, 2.0), (70_000_000_000, 3.0)], LONG)
    root = manifest.digest_tree(base).filter(F.col("level") == manifest.ROOT).select("rows", "digest").first()
    assert root == manifest.table_digest(base).first()
    empty = manifest.table_digest(base.limit(0)).first()
    assert empty["rows"] == 0 and len(empty["digest"]) == 64
    gone = manifest.changed_chunks(named(base.limit(0)), named(base)).collect()
    assert sorted((r["first_id"], r["rows"], r["pinned_rows"], r["status"]) for r in gone) == [
        (0, 0, 1, "deleted"), (70_000_000_000 // 4096 * 4096, 0, 1, "deleted"),
    ]
    head = manifest.write_manifest(base, str(tmp_path / "m"), "t").first()
    assert (head["table"], head["rows"], head["digest"]) == ("t", *root)
    assert manifest.changed_chunks(named(base), manifest.read_manifest_tree(spark, str(tmp_path / "m"))).isEmpty()


def test_float_text_is_shortest_round_trip(spark):
    values = [1.0, -0.0, 0.1, 1e-05, 12345678.5, 1e22, 123456789012.25, 0.0001, 2.5e-7, 1e16, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(float_text(F.col("v")))
    assert [r[0] for r in df.collect()] == [repr(v) for v in values]


def test_json_text(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"d": [1, 2], "c": null}}',), ("plain",)], "j string")
    got = [r[0] for r in df.select(sorted_json(F.col("j"))).collect()]
    assert json.loads(got[0]) == {"a": {"c": None, "d": [1, 2]}, "b": 1} and got[0].index('"a"') < got[0].index('"b"')
    assert got[1] == "plain"


def test_empty_predictions_are_not_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "y_true int, prob_class_1 double")
    assert not sink_predictions(df.limit(0), str(tmp_path / "a")) and not sink_predictions(df, None)
    assert sink_predictions(df, str(tmp_path / "b"), "parquet") and spark.read.parquet(str(tmp_path / "b")).count() == 1
