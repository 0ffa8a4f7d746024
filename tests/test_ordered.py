import random

from pyspark.sql import functions as F

from panelwell.operators.cleaning import exact_quantile
from panelwell.operators.ordered import ordered_columns
from panelwell.operators.metrics import binary_metrics, score_table
from panelwell.sources.manifest import id_ranges, merge_ranges, pinned_scan, write_by_id

SCHEMA = "g int, t int, id int, v double"


def rows(n=90):
    draw = random.Random(7)
    # one group holds most rows, and many of its rows share one time
    return [(1 if i % 3 else draw.randint(2, 4), draw.choice([5, 5, 5, draw.randint(0, 40)]), i, float(draw.randint(0, 9))) for i in range(n)]


def compute(df, **kw):
    out = ordered_columns(
        df, ["g"], [F.col("t"), F.col("id")], position="p", group_size="n", sums={"s": F.col("v")},
        totals={"w": F.col("v")}, lags={"l": F.col("v")}, maxima={"m": F.col("v")}, **kw,
    )
    return sorted(tuple(r) for r in out.select("g", "t", "id", "p", "n", "s", "w", "l", "m").collect())


def test_segmented_equals_plain(spark, tiny_groups):
    df = spark.createDataFrame(rows(), SCHEMA)
    segmented = compute(df)
    spark.conf.set("spark.panelwell.groupRows", "1000")
    assert segmented == compute(df)
    assert compute(df, max_group=80) == segmented


def test_partition_count_does_not_matter(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert compute(df.repartition(1)) == compute(df.repartition(64))


def test_exact_quantile_matches_linear_interpolation(spark, tiny_groups):
    import numpy as np

    data = rows()
    found = {r["g"]: r["q"] for r in exact_quantile(spark.createDataFrame(data, SCHEMA), ["g"], "v", 0.9, "q").collect()}
    for g in found:
        assert abs(found[g] - np.quantile([r[3] for r in data if r[0] == g], 0.9)) < 1e-12


def test_metrics_are_equal_when_the_score_order_is_segmented(spark, tiny_groups):
    draw = random.Random(3)
    data = [(i % 2, draw.randint(0, 60) / 60.0, int(draw.random() < 0.3)) for i in range(200)]
    table = score_table(spark.createDataFrame(data, "f int, prob_class_1 double, y_true int"), ["f"])
    segmented = sorted(map(tuple, binary_metrics(table, ["f"]).collect()))
    plain = sorted(map(tuple, binary_metrics(table, ["f"], max_group=0).collect()))
    for a, b in zip(segmented, plain):
        assert all(abs(x - y) < 1e-12 for x, y in zip(a, b))


def test_id_ranges(spark, tiny_groups):
    ids = spark.createDataFrame([(i,) for i in (3, 1, 2, 7, 8, 10, 10, 2)], "id bigint")
    got = sorted((r["first_id"], r["last_id"]) for r in id_ranges(ids, block_rows=2).collect())
    assert got == [(1, 3), (7, 8), (10, 10)]
    assert id_ranges(ids.filter("id < 0")).count() == 0


def test_pinned_scan_by_ranges_table(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "id bigint")
    ranges = [(0, 4), (3, 9), (20, 20), (95, 10_000_000_000)]
    by_list = sorted(r["id"] for r in pinned_scan(df, ranges).collect())
    table = spark.createDataFrame(ranges, "first_id bigint, last_id bigint")
    by_table = sorted(r["id"] for r in pinned_scan(df, table).collect())
    assert by_list == by_table == [*range(10), 20, *range(95, 100)]
    assert sorted(map(tuple, merge_ranges(table).collect()))[0] == (0, 9)
    assert pinned_scan(df, None).count() == 100 and pinned_scan(df, []).count() == 0


def test_a_layout_by_id_blocks_is_read_from_the_wanted_folders(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("value")).unionByName(
        spark.createDataFrame([(None, 7), (-3, -6)], "id bigint, value bigint")
    )
    laid = write_by_id(df, str(tmp_path / "laid"), 10)
    ranges = [(10 * i, 10 * i + 3) for i in range(0, 60)] + [(5, 12), (-5, -2), (995, 10**15)]
    expected = sorted({i for a, b in ranges for i in range(a, min(b, 999) + 1) if i >= 0 or i == -3})
    for given in (ranges, spark.createDataFrame(ranges, "first_id bigint, last_id bigint")):
        scan = pinned_scan(laid, given, 10)
        assert sorted(r["id"] for r in scan.collect()) == expected
        plan = scan._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan
    short = pinned_scan(laid, ranges[:2], 10)
    assert sorted(r["id"] for r in short.collect()) == [0, 1, 2, 3, 10, 11, 12, 13]
    assert "PartitionFilters: [" in short._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: []", "")
    empty = write_by_id(df.limit(0), str(tmp_path / "none"), 10)
    assert pinned_scan(empty, ranges, 10).count() == 0
