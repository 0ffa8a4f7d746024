import datetime
import os
import pathlib
import random

from panelwell.operators.dedup import kept_responses
from panelwell.operators.windows import bin_sum
from panelwell.streaming.bins import stream_bin_sum
from panelwell.streaming.dedup import stream_dedup

SENSOR = "app_user_id bigint, modality string, start_timestamp timestamp_ntz, value double"
RESPONSE = "id bigint, app_user_id bigint, survey_id int, timestamp timestamp_ntz, fingerprint string"
AT = datetime.datetime(2026, 1, 1)


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_bins_equal_batch(spark, tmp_path):
    rows = [(i % 3, "step", AT + datetime.timedelta(hours=i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, SENSOR)
    df.write.parquet(str(tmp_path / "in"))
    drain(stream_bin_sum(spark.readStream.schema(SENSOR).parquet(str(tmp_path / "in")), 4), "bins", "complete")
    assert sorted(map(tuple, spark.table("bins").collect())) == sorted(map(tuple, bin_sum(df, 4).collect()))


def feed(spark, batches, path, name, delay):
    """Runs the batches in the given order; returns the kept ids and the keys left in the state."""
    for n, part in enumerate(batches):
        spark.createDataFrame(part, RESPONSE).coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
        # files are read in order of their time
        for file in pathlib.Path(f"{path}/{n:03d}").glob("*.parquet"):
            os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    query = stream_dedup(stream, 10, delay).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    return sorted(r["id"] for r in spark.table(name).select("id").collect()), left


def later(minutes, key):
    """A row of another key that moves the watermark on."""
    return [(10_000 + minutes, 99 + key, 0, AT + datetime.timedelta(minutes=minutes), "z")]


def test_dedup_keeps_its_anchor_between_batches(spark, tmp_path):
    minutes = [0, 4, 9, 12, 19, 24, 40, 45]
    rows = [(i, 1, 0, AT + datetime.timedelta(minutes=m), "a") for i, m in enumerate(minutes)]
    kept, left = feed(spark, [rows[:3], rows[3:6], rows[6:], later(500, 0), later(1000, 1)], tmp_path / "in", "kept", "5 minutes")
    # anchors: 0, then 12 (over ten minutes later), 24, 40; the state of the first key has gone
    assert [k for k in kept if k < 10_000] == [0, 3, 5, 6] and left <= 2


def test_shuffled_batches_equal_the_batch_form(spark, tmp_path):
    draw = random.Random(3)
    rows = [
        (i, draw.randint(1, 3), draw.randint(0, 1), AT + datetime.timedelta(seconds=draw.randint(0, 7200)), draw.choice("aab"))
        for i in range(150)
    ]
    rows += [(200 + i, 1, 0, rows[0][3], "a") for i in range(4)]
    draw.shuffle(rows)
    responses = spark.createDataFrame(rows, RESPONSE)
    answers = spark.createDataFrame([(r[0], r[0], 2, r[4]) for r in rows], "id bigint, survey_response_id bigint, question_id int, answer string")
    expected = sorted(r["id"] for r in kept_responses(responses, answers, 10).collect())
    # any order within two hours of delay; every key settles once the clock has moved on
    batches = [rows[:60], rows[60:61], rows[61:130], rows[130:], later(600, 0), later(1200, 1)]
    kept, left = feed(spark, batches, tmp_path / "in", "shuffled", "2 hours")
    assert [k for k in kept if k < 10_000] == expected and left <= 2


def test_rows_behind_the_watermark_and_without_time(spark, tmp_path):
    rows = [(1, 1, 0, AT, "a"), (2, 1, 0, None, "a"), (3, 1, 0, AT + datetime.timedelta(minutes=3), None)]
    late = [(4, 1, 0, AT + datetime.timedelta(minutes=1), "late")]
    kept, _ = feed(spark, [rows, later(300, 0), later(600, 1), late, later(900, 2)], tmp_path / "in", "late", "5 minutes")
    assert [k for k in kept if k < 10_000] == [1, 3]
