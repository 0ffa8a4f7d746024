"""Filters, joins, labels and the cohort build."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwell.functions.timegrid import clock_to_hours, floor_time
from panelwell.operators import cleaning, labels, people
from panelwell.operators.dedup import dedup_responses
from panelwell.operators.labels import Rule
from panelwell.operators.splits import distinct_users
from panelwell.plans.cohort import CohortSettings, StudyTables, build_cohort
from panelwell.registry import frames
from panelwell.registry.core import q6, query, r6
from panelwell.registry.views import H, coerce
from panelwell.session import cut_lineage
from panelwell.sources import study

EXCLUDED = ", ".join(str(u) for u in cleaning.DEFAULT_EXCLUDED_USERS)
CUTOFF = "2024-01-10"
SENSOR_KEYS = "app_user_id, modality, start_timestamp, end_timestamp, value, app_source"


def step(spark, sf):
    return study.sensor(spark, sf).filter("modality = 'step'")


def distance(spark, sf):
    return study.sensor(spark, sf).filter("modality = 'distance'")


def repeated(df):
    """Every row twice with another id, so that duplicate removal has work to do."""
    return df.unionByName(df.withColumn("id", F.col("id") + 10_000_000))


REPEATED = "SELECT * FROM v_sensor UNION ALL SELECT * REPLACE (id + 10000000 AS id) FROM v_sensor"


@query(
    "eav_pivot_all_keywords",
    """SELECT app_user_id, max(value) FILTER (keyword = 'age') AS age,
  coalesce(string_agg(keyword || '=' || value, ';' ORDER BY keyword) FILTER (keyword <> 'age'), '') AS rest
FROM v_demographic GROUP BY app_user_id""",
    ("v_demographic",),
)
def _(spark, sf):
    wide = people.eav_pivot(study.demographic(spark, sf), ["age"], rest="rest")
    pairs = F.array_sort(F.transform(F.map_entries("rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return wide.select("app_user_id", "age", F.array_join(pairs, ";").alias("rest"))


@query(
    "drop_duplicates_no_id",
    "SELECT DISTINCT app_user_id, modality, start_timestamp, end_timestamp, value, app_source FROM v_sensor",
    ("v_sensor",),
)
def _(spark, sf):
    sensors = study.sensor(spark, sf).drop("id")
    return cleaning.drop_duplicates_first(sensors.unionByName(sensors)).select("app_user_id", "modality", "start_timestamp", "end_timestamp", "value", "app_source")


@query("eav_pivot", "SELECT app_user_id, age, gender_at_birth, gender, lgbt FROM v_people", ("v_people",))
def _(spark, sf):
    return people.eav_pivot(study.demographic(spark, sf))


@query("exclude_users", f"SELECT id, app_user_id, modality, value FROM v_sensor WHERE app_user_id NOT IN ({EXCLUDED})", ("v_sensor",))
def _(spark, sf):
    return cleaning.exclude_users(study.sensor(spark, sf)).select("id", "app_user_id", "modality", "value")


@query("exclude_users_table", "SELECT id, app_user_id FROM v_response WHERE app_user_id NOT IN (SELECT app_user_id FROM v_people WHERE gender = 'nonbinary')", ("v_response", "v_people"))
def _(spark, sf):
    gone = people.eav_pivot(study.demographic(spark, sf)).filter("gender = 'nonbinary'")
    return cleaning.exclude_users(study.survey_response(spark, sf), gone).select("id", "app_user_id")


@query(
    "drop_zero_duration_positive",
    "SELECT id, value FROM v_sensor WHERE modality = 'step' AND NOT (start_timestamp = end_timestamp AND value > 0)",
    ("v_sensor",),
)
def _(spark, sf):
    return step(spark, sf).transform(cleaning.drop_zero_duration_positive).select("id", "value")


@query("drop_same_start_end", "SELECT id, value FROM v_sensor WHERE modality = 'distance' AND start_timestamp <> end_timestamp", ("v_sensor",))
def _(spark, sf):
    return distance(spark, sf).transform(cleaning.drop_same_start_end).select("id", "value")


@query("study_start_cutoff", f"SELECT id, start_timestamp FROM v_sensor WHERE modality = 'distance' AND start_timestamp >= TIMESTAMP '{CUTOFF}'", ("v_sensor",))
def _(spark, sf):
    return distance(spark, sf).transform(cleaning.study_start_cutoff, CUTOFF).select("id", "start_timestamp")


@query(
    "drop_duplicates_first",
    f"SELECT min(id) AS id, {SENSOR_KEYS} FROM ({REPEATED}) WHERE modality = 'step' GROUP BY {SENSOR_KEYS}",
    ("v_sensor",),
)
def _(spark, sf):
    return repeated(step(spark, sf)).transform(cleaning.drop_duplicates_first)


@query(
    "rename_source_for_user",
    "SELECT id, app_user_id, CASE WHEN app_user_id = 26 AND app_source = 'Health' THEN 'Apple Watch' "
    "WHEN app_user_id = 24 AND app_source = 'Health' THEN 'Apple Watch' ELSE app_source END AS app_source FROM v_sensor",
    ("v_sensor",),
)
def _(spark, sf):
    # user 24 records "Health" in the derived study, user 26 does not
    rules = [*cleaning.RENAME_RULES, cleaning.SourceRule(24, "Health", "Apple Watch")]
    return cleaning.rename_source_for_user(study.sensor(spark, sf), rules).select("id", "app_user_id", "app_source")


@query(
    "drop_source_for_user",
    "SELECT id, app_user_id, app_source FROM v_sensor WHERE NOT (app_user_id IN (22, 13) AND lower(app_source) LIKE '%android%')",
    ("v_sensor",),
)
def _(spark, sf):
    rules = [*cleaning.DROP_RULES, cleaning.SourceRule(13, "android")]
    return cleaning.drop_source_for_user(study.sensor(spark, sf), rules).select("id", "app_user_id", "app_source")


STAMP_TEXT = "CASE WHEN event_id % 5 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END"


@query("coerce_timestamps", f"SELECT event_id, try_cast({STAMP_TEXT} AS TIMESTAMP) AS ts FROM events")
def _(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    as_text = study.events(spark, sf).select("event_id", text.alias("ts"))
    return cleaning.coerce_timestamps(as_text, ["ts", "absent"])


@query("daily_survey_filter", "SELECT id, app_user_id, timestamp, survey_id FROM v_daily", ("v_daily",))
def _(spark, sf):
    return labels.daily_surveys(study.survey_response(spark, sf))


@query("question_filter", "SELECT * FROM v_answer WHERE question_id IN (2, 3, 5, 7, 8, 12, 13)", ("v_answer",))
def _(spark, sf):
    return labels.question_filter(study.answer(spark, sf), labels.question_ids(labels.RISK_RULES))


@query("coerce_answer", "SELECT id, survey_response_id, question_id, answer, answer_num FROM v_coerced", ("v_coerced",))
def _(spark, sf):
    return labels.coerced_answers(study.answer(spark, sf))


@query(
    "clip_upper_quantile",
    f"SELECT id, modality, {q6('least(value, lim)')} AS value FROM v_sensor JOIN "
    "(SELECT modality, quantile_cont(value, 0.99) AS lim FROM v_sensor GROUP BY modality) USING (modality)",
    ("v_sensor",),
)
def _(spark, sf):
    return cleaning.clip_upper_quantile(study.sensor(spark, sf)).select("id", "modality", r6("value").alias("value"))


@query(
    "clip_upper_quantile_by_fold",
    f"""WITH spans AS (
  SELECT fold_index, app_user_id, max(CASE WHEN role = 'train' THEN epoch_us(record_timestamp) END) AS train_to,
    min(CASE WHEN role = 'test' THEN epoch_us(record_timestamp) END) - {72 * 3600 * 10**6} AS held_from,
    max(CASE WHEN role = 'test' THEN epoch_us(record_timestamp) END) AS held_to
  FROM v_cyclic GROUP BY fold_index, app_user_id),
limits AS (
  SELECT fold_index, modality, quantile_cont(value, 0.99) AS upper FROM v_sensor JOIN spans USING (app_user_id)
  WHERE epoch_us(start_timestamp) < train_to AND NOT coalesce(epoch_us(start_timestamp) BETWEEN held_from AND held_to, false)
  GROUP BY fold_index, modality)
SELECT fold_index, modality, {q6('max(upper)')} AS upper, CAST(count_if(value > upper) AS BIGINT) AS n_clipped, {q6('sum(least(value, upper))')} AS total
FROM v_sensor JOIN limits USING (modality) GROUP BY fold_index, modality""",
    ("v_sensor", "v_cyclic"),
)
def _(spark, sf):
    sensors = study.sensor(spark, sf)
    limits = cut_lineage(cleaning.fold_upper_quantiles(sensors, frames.cyclic(spark, sf)))
    raw = sensors.withColumn("__raw", F.col("value"))
    return (
        cleaning.clip_by_fold(raw, limits)
        .groupBy("fold_index", "modality")
        .agg(F.count_if(F.col("__raw") > F.col("value")).alias("n_clipped"), r6(F.sum("value")).alias("total"))
        .join(F.broadcast(limits), ["fold_index", "modality"])
        .select("fold_index", "modality", r6("upper").alias("upper"), "n_clipped", "total")
    )


OS_SQL = """SELECT app_user_id, CASE WHEN ios AND NOT android THEN 'ios' WHEN android AND NOT ios THEN 'android' ELSE 'both' END AS os
FROM (SELECT app_user_id, bool_or(app_source LIKE '%iPhone%' OR app_source LIKE '%Apple Watch%' OR app_source LIKE '%HealthKit%') AS ios,
  bool_or(app_source LIKE '%androidx%') AS android FROM v_sensor GROUP BY app_user_id)"""


@query("os_class", OS_SQL, ("v_sensor",))
def _(spark, sf):
    return cleaning.os_class(study.sensor(spark, sf))


@query("os_filter", f"SELECT id, app_user_id FROM v_response WHERE app_user_id IN (SELECT app_user_id FROM ({OS_SQL}) WHERE os = 'ios')", ("v_response", "v_sensor"))
def _(spark, sf):
    return cleaning.os_filter(study.survey_response(spark, sf), study.sensor(spark, sf), "ios").select("id", "app_user_id")


DEVICE_SQL = """SELECT app_user_id, CAST(d = 'android' AS DOUBLE) AS device_android, CAST(d = 'iphone' AS DOUBLE) AS device_iphone,
  CAST(d = 'watch' AS DOUBLE) AS device_watch, CAST(d = 'unknown' AS DOUBLE) AS device_unknown FROM (
  SELECT app_user_id, CASE WHEN bool_or(contains(app_source, 'Apple Watch')) THEN 'watch'
    WHEN bool_or(contains(app_source, 'iPhone') OR contains(app_source, 'Iphone')) THEN 'iphone'
    WHEN bool_or(contains(app_source, 'androidx') OR contains(app_source, 'health.connect')) THEN 'android' ELSE 'unknown' END AS d
  FROM v_sensor WHERE modality = 'step' GROUP BY app_user_id)"""


@query("device_source_onehot", DEVICE_SQL, ("v_sensor",))
def _(spark, sf):
    return cleaning.device_source_onehot(study.sensor(spark, sf))


@query(
    "require_strings",
    f"SELECT id, question_id, answer, CASE WHEN question_id NOT IN (54, 55) THEN {coerce('answer')} END AS answer_num FROM v_answer "
    f"WHERE CASE WHEN question_id IN (54, 55) THEN answer IS NOT NULL ELSE {coerce('answer')} IS NOT NULL END",
    ("v_answer",),
)
def _(spark, sf):
    return labels.coerced_answers(study.answer(spark, sf), (54, 55)).select("id", "question_id", "answer", "answer_num")


WINDOWS_SQL = f"""SELECT app_user_id, make_timestamp(CAST(epoch_us(min(timestamp)) - {7 * 24 * H} AS BIGINT)) AS window_start,
  make_timestamp(CAST(epoch_us(max(timestamp)) + {24 * H} AS BIGINT)) AS window_end FROM v_daily GROUP BY app_user_id"""


@query("enrollment_windows", WINDOWS_SQL, ("v_daily",))
def _(spark, sf):
    return cleaning.enrollment_windows(study.survey_response(spark, sf))


@query(
    "enrollment_join",
    f"""SELECT s.id, s.app_user_id, s.start_timestamp FROM v_sensor s JOIN
  (SELECT app_user_id, make_timestamp(CAST(epoch_us(min(timestamp)) - {12 * H} AS BIGINT)) AS a,
    make_timestamp(CAST(epoch_us(max(timestamp)) - {48 * H} AS BIGINT)) AS b FROM v_daily GROUP BY app_user_id) w
  USING (app_user_id) WHERE s.start_timestamp BETWEEN w.a AND w.b""",
    ("v_sensor", "v_daily"),
)
def _(spark, sf):
    windows = cleaning.enrollment_windows(study.survey_response(spark, sf), lead_days=0.5, trail_days=-2.0)
    return cleaning.enrollment_join(study.sensor(spark, sf), windows).select("id", "app_user_id", "start_timestamp")


@query("answers_semi_responses", "SELECT * FROM v_answer WHERE survey_response_id IN (SELECT id FROM v_daily)", ("v_answer", "v_daily"))
def _(spark, sf):
    return frames.daily_answers(spark, sf).select("id", "survey_response_id", "question_id", "answer")


@query("labels_join_responses", "SELECT survey_response_id, answer, app_user_id, record_timestamp, survey_id FROM v_master", ("v_master",))
def _(spark, sf):
    return frames.master(spark, sf)


@query(
    "sleep_hours",
    f"SELECT survey_response_id, {q6('sleep_hours')} AS sleep_hours FROM v_sleep",
    ("v_sleep",),
)
def _(spark, sf):
    return labels.sleep_hours(study.answer(spark, sf)).select("survey_response_id", r6("sleep_hours").alias("sleep_hours"))


@query("sleep_category", "SELECT survey_response_id, sleep_category FROM v_sleep", ("v_sleep",))
def _(spark, sf):
    return labels.sleep_hours(study.answer(spark, sf)).select("survey_response_id", "sleep_category")


@query(
    "sleep_left_join",
    f"SELECT m.survey_response_id, m.app_user_id, m.answer, {q6('s.sleep_hours')} AS sleep_hours, s.sleep_category FROM v_master m LEFT JOIN v_sleep s USING (survey_response_id)",
    ("v_master", "v_sleep"),
)
def _(spark, sf):
    joined = labels.sleep_left_join(frames.master(spark, sf), labels.sleep_hours(study.answer(spark, sf)))
    return joined.select("survey_response_id", "app_user_id", "answer", r6("sleep_hours").alias("sleep_hours"), "sleep_category")


@query(
    "answers_by_user_day",
    "SELECT a.id, a.survey_response_id, a.question_id, a.answer, d.app_user_id, CAST(d.timestamp AS DATE) AS date FROM v_answer a JOIN v_daily d ON d.id = a.survey_response_id",
    ("v_answer", "v_daily"),
)
def _(spark, sf):
    return labels.answers_by_user_day(study.answer(spark, sf), frames.daily(spark, sf))


REP_SQL = "SELECT app_user_id, CAST(timestamp AS DATE) AS date, arg_max(id, (timestamp, id)) AS id, max(timestamp) AS timestamp, arg_max(survey_id, (timestamp, id)) AS survey_id FROM v_daily GROUP BY ALL"


@query("daily_representative", REP_SQL, ("v_daily",))
def _(spark, sf):
    return labels.daily_representative(frames.daily(spark, sf))


DAY_SQL = """SELECT a.question_id, d.app_user_id, CAST(d.timestamp AS DATE) AS date, a.id, a.answer, a.answer_num
FROM v_coerced a JOIN v_daily d ON d.id = a.survey_response_id"""


@query(
    "representative_join",
    f"SELECT r.id AS survey_response_id, x.app_user_id, x.date, x.question_id, {q6('x.m')} AS answer FROM "
    f"(SELECT app_user_id, date, question_id, avg(answer_num) AS m FROM ({DAY_SQL}) GROUP BY ALL) x JOIN ({REP_SQL}) r USING (app_user_id, date)",
    ("v_coerced", "v_daily"),
)
def _(spark, sf):
    placed = labels.answers_by_user_day(labels.coerced_answers(study.answer(spark, sf)), frames.daily(spark, sf))
    means = placed.groupBy("app_user_id", "date", "question_id").agg(r6(F.avg("answer_num")).alias("answer"))
    return labels.representative_join(means, labels.daily_representative(frames.daily(spark, sf)))


@query(
    "answers_pivot",
    "SELECT survey_response_id, " + ", ".join(f"max(answer_num) FILTER (question_id = {i}) AS q{i}" for i in (2, 3, 5, 7, 8, 12, 13))
    + " FROM v_coerced GROUP BY survey_response_id",
    ("v_coerced",),
)
def _(spark, sf):
    return labels.answers_pivot(labels.coerced_answers(study.answer(spark, sf)), (2, 3, 5, 7, 8, 12, 13))


TARGETS = "SELECT * FROM v_coerced WHERE survey_response_id IN (SELECT id FROM v_daily) AND question_id IN (2, 3, 5, 7, 8, 12, 13)"
SCALE = "(question_id IN (2, 3, 5, 7))"
YESNO = "(question_id IN (8, 12, 13))"

# one rule per operation: (query, rule, SQL condition over a response's answers)
RULE_QUERIES = [
    ("rule_mean", Rule((2, 3, 5, 7), "mean", 1.5), f"coalesce(avg(answer_num) FILTER {SCALE} >= 1.5, false)"),
    ("rule_sum", Rule((2, 3, 5, 7), "sum", 6), f"coalesce(sum(answer_num) FILTER {SCALE}, 0) >= 6"),
    ("rule_sum_le", Rule((8, 12, 13), "sum_le", 0), f"coalesce(sum(answer_num) FILTER {YESNO}, 0) <= 0"),
    ("rule_max", Rule((2, 3, 5, 7), "max", 3), f"coalesce(max(answer_num) FILTER {SCALE} >= 3, false)"),
    ("rule_ge", Rule((2, 3, 5, 7), "ge", 2.0), f"coalesce(bool_or(answer_num >= 2) FILTER {SCALE}, false)"),
    ("rule_any_eq", Rule((8, 12, 13), "any_eq", 1), f"coalesce(bool_or(answer_num = 1) FILTER {YESNO}, false)"),
    ("rule_any_eq_text", Rule((8, 12, 13), "any_eq", " No"), f"coalesce(bool_or(answer = ' No') FILTER {YESNO}, false)"),
    ("rule_any_gt", Rule((8, 12, 13), "any_gt", 0), f"coalesce(bool_or(answer_num > 0) FILTER {YESNO}, false)"),
]


def _register_rule(name: str, rule: Rule, condition: str) -> None:
    @query(name, f"SELECT survey_response_id, CAST({condition} AS INTEGER) AS answer FROM ({TARGETS}) GROUP BY survey_response_id", ("v_coerced", "v_daily"))
    def _(spark, sf):
        return labels.combine_rules(frames.target_answers(spark, sf), [rule])


for _name, _rule, _condition in RULE_QUERIES:
    _register_rule(_name, _rule, _condition)


@query("combine_rules_any", "SELECT survey_response_id, answer FROM v_labels", ("v_labels",))
def _(spark, sf):
    return labels.combine_rules(frames.target_answers(spark, sf))


@query(
    "combine_rules_all",
    # the third rule's questions appear nowhere, so it is skipped
    f"SELECT survey_response_id, CAST(coalesce(max(answer_num) FILTER {SCALE} >= 2, false) AND coalesce(sum(answer_num) FILTER {YESNO}, 0) <= 1 AS INTEGER) AS answer "
    f"FROM ({TARGETS}) GROUP BY survey_response_id",
    ("v_coerced", "v_daily"),
)
def _(spark, sf):
    rules = [Rule((2, 3, 5, 7), "max", 2), Rule((8, 12, 13), "sum_le", 1), Rule((90, 91), "ge", 1)]
    return labels.combine_rules(frames.target_answers(spark, sf), rules, "all")


@query(
    "mean_label",
    f"SELECT survey_response_id, CAST(avg(answer_num) >= 0.75 AS INTEGER) AS answer FROM ({TARGETS}) GROUP BY survey_response_id",
    ("v_coerced", "v_daily"),
)
def _(spark, sf):
    return labels.mean_label(frames.target_answers(spark, sf), 0.75)


@query("max_label", f"SELECT survey_response_id, max(answer_num) AS answer FROM ({TARGETS}) GROUP BY survey_response_id", ("v_coerced", "v_daily"))
def _(spark, sf):
    return labels.max_label(frames.target_answers(spark, sf))


@query(
    "target_type",
    "SELECT survey_response_id, CAST(answer AS BIGINT) AS answer, CAST(answer AS FLOAT) AS regression_answer FROM v_labels",
    ("v_labels",),
)
def _(spark, sf):
    made = labels.combine_rules(frames.target_answers(spark, sf))
    regression = labels.target_type(made, True).withColumnRenamed("answer", "regression_answer")
    return labels.target_type(made).join(regression, "survey_response_id")


COLLAPSE_STATS = {
    "mean": "avg(answer_num)", "max": "max(answer_num)", "min": "min(answer_num)",
    "first": "arg_min(answer_num, id)", "last": "arg_max(answer_num, id)",
}
COLLAPSE_DAY = f"""SELECT * FROM (SELECT a.*, d.app_user_id, CAST(d.timestamp AS DATE) AS date,
  CASE WHEN a.question_id NOT IN (54, 55) THEN {coerce('a.answer')} END AS answer_num
  FROM v_answer a JOIN v_daily d ON d.id = a.survey_response_id) WHERE question_id IN (54, 55) OR answer_num IS NOT NULL"""


def _register_collapse(strategy: str, stat: str) -> None:
    @query(
        f"collapse_daily_{strategy}",
        f"""SELECT r.id AS survey_response_id, x.question_id, x.text_answer, {q6('x.answer_num')} AS answer_num FROM (
  SELECT app_user_id, date, question_id, CASE WHEN question_id IN (54, 55) THEN arg_max(answer, id) END AS text_answer,
    CASE WHEN question_id IN (54, 55) THEN NULL WHEN question_id IN (8, 12, 13) THEN max(answer_num) ELSE {stat} END AS answer_num
  FROM ({COLLAPSE_DAY}) GROUP BY app_user_id, date, question_id) x JOIN ({REP_SQL}) r USING (app_user_id, date)""",
        ("v_answer", "v_daily"),
    )
    def _(spark, sf):
        _, answers = labels.collapse_daily(
            frames.daily(spark, sf), frames.daily_answers(spark, sf), strategy, study.question(spark, sf), (54, 55)
        )
        text = F.when(F.col("question_id").isin(54, 55), F.col("answer"))
        return answers.select("survey_response_id", "question_id", text.alias("text_answer"), r6("answer_num").alias("answer_num"))


for _strategy, _stat in COLLAPSE_STATS.items():
    _register_collapse(_strategy, _stat)


@query("collect_sources", "SELECT DISTINCT app_user_id, app_source FROM v_sensor", ("v_sensor",))
def _(spark, sf):
    return cleaning.collect_sources(study.sensor(spark, sf))


@query(
    "referent_window",
    f"SELECT survey_response_id, app_user_id, answer, record_timestamp, survey_id, prev_record_timestamp, {q6('referent_hours')} AS referent_hours, is_morning FROM v_referent",
    ("v_referent",),
)
def _(spark, sf):
    return frames.referents(spark, sf).withColumn("referent_hours", r6("referent_hours"))


def dedup_ctes(gap_minutes: float, responses: str = "v_daily", prefix: str = "d") -> str:
    """Recursive walk over each (user, survey): the state is the last kept row."""
    gap = int(gap_minutes * 60_000_000)
    return f"""{prefix}_print AS (
  SELECT survey_response_id, string_agg(question_id || '=' || answer, '|' ORDER BY question_id) AS f FROM v_answer GROUP BY 1),
{prefix}_rows AS (
  SELECT r.id, r.app_user_id, r.survey_id, epoch_us(r.timestamp) AS t, coalesce(f, '') AS f,
    row_number() OVER (PARTITION BY r.app_user_id, r.survey_id ORDER BY r.timestamp, r.id) AS n
  FROM {responses} r LEFT JOIN {prefix}_print p ON p.survey_response_id = r.id),
{prefix}_walk AS (
  SELECT id, app_user_id, survey_id, n, t AS anchor, f AS mark, true AS keep FROM {prefix}_rows WHERE n = 1
  UNION ALL
  SELECT r.id, r.app_user_id, r.survey_id, r.n,
    CASE WHEN r.t - w.anchor <= {gap} AND r.f = w.mark THEN w.anchor ELSE r.t END,
    CASE WHEN r.t - w.anchor <= {gap} AND r.f = w.mark THEN w.mark ELSE r.f END,
    NOT (r.t - w.anchor <= {gap} AND r.f = w.mark)
  FROM {prefix}_walk w JOIN {prefix}_rows r ON r.app_user_id = w.app_user_id AND r.survey_id = w.survey_id AND r.n = w.n + 1)"""


def _register_dedup(name: str, minutes: float, scale_only: bool) -> None:
    # over the scale questions alone, equal answers are common and the anchor matters
    answers = "(SELECT * FROM v_answer WHERE question_id IN (2, 3, 5, 7))" if scale_only else "v_answer"
    ctes = dedup_ctes(minutes).replace("FROM v_answer", f"FROM {answers}")

    @query(name, f"WITH RECURSIVE {ctes} SELECT id, app_user_id, survey_id FROM d_walk WHERE keep", ("v_daily", "v_answer"))
    def _(spark, sf):
        given = study.answer(spark, sf)
        if scale_only:
            given = labels.question_filter(given, (2, 3, 5, 7))
        responses, _ = dedup_responses(frames.daily(spark, sf), given, minutes, frames.per_user(spark, sf))
        return responses.select("id", "app_user_id", "survey_id")


_register_dedup("dedup_responses", 10, False)
_register_dedup("dedup_responses_12h", 12 * 60, True)
_register_dedup("dedup_responses_5d", 5 * 24 * 60, True)


@query(
    "clock_to_hours",
    f"""SELECT id, answer, {q6("CASE WHEN question_id IN (54, 55) THEN hour(strptime(answer, '%I:%M %p')) + minute(strptime(answer, '%I:%M %p')) / 60.0::DOUBLE ELSE try_cast(trim(answer) AS DOUBLE) END")} AS hours FROM v_answer""",
    ("v_answer",),
)
def _(spark, sf):
    return study.answer(spark, sf).select("id", "answer", r6(clock_to_hours(F.col("answer"))).alias("hours"))


@query(
    "floor_time",
    "SELECT event_id, " + ", ".join(f"make_timestamp(CAST(epoch_us(ts) // {h * H} * {h * H} AS BIGINT)) AS floor_{h}h" for h in (4, 6, 8, 12)) + " FROM events",
)
def _(spark, sf):
    return study.events(spark, sf).select("event_id", *[floor_time(F.col("ts"), h).alias(f"floor_{h}h") for h in (4, 6, 8, 12)])


@query("stable_order", "SELECT survey_response_id, row_number() OVER (PARTITION BY app_user_id ORDER BY record_timestamp, survey_response_id) AS n FROM v_master", ("v_master",))
def _(spark, sf):
    from panelwell.operators.ordered import ordered_columns

    order = [F.col("record_timestamp"), F.col("survey_response_id")]
    placed = ordered_columns(frames.master(spark, sf), ["app_user_id"], order, position="p", max_group=frames.per_user(spark, sf))
    return placed.select("survey_response_id", (F.col("p") + 1).alias("n"))


@query(
    "union_answers",
    "SELECT id, question_id, answer FROM v_coerced WHERE question_id NOT IN (54, 55) UNION ALL SELECT id, question_id, answer FROM v_answer WHERE question_id IN (54, 55)",
    ("v_coerced", "v_answer"),
)
def _(spark, sf):
    answers = study.answer(spark, sf)
    numeric = labels.coerced_answers(answers.filter(~F.col("question_id").isin(54, 55)))
    text = labels.coerced_answers(answers.filter(F.col("question_id").isin(54, 55)), (54, 55))
    return numeric.unionByName(text).select("id", "question_id", "answer")


@query("distinct_users", "SELECT DISTINCT app_user_id FROM v_master", ("v_master",))
def _(spark, sf):
    return distinct_users(frames.master(spark, sf))


# The whole build on the derived study: 12-hour repeats, daily maximum, sleep, iOS users, coverage.
CLEAN = f"""step_clean AS (
  SELECT min(id) AS id, app_user_id, modality, start_timestamp, end_timestamp, value, app_source FROM v_sensor
  WHERE modality = 'step' AND NOT (start_timestamp = end_timestamp AND value > 0) GROUP BY ALL),
step_named AS (SELECT * REPLACE (CASE WHEN app_user_id = 26 AND app_source = 'Health' THEN 'Apple Watch' ELSE app_source END AS app_source) FROM step_clean
  WHERE NOT (app_user_id = 22 AND lower(app_source) LIKE '%android%')),
distance_clean AS (
  SELECT min(id) AS id, app_user_id, modality, start_timestamp, end_timestamp, value, app_source FROM v_sensor
  WHERE modality = 'distance' AND start_timestamp <> end_timestamp AND start_timestamp >= TIMESTAMP '{CUTOFF}' GROUP BY ALL),
enrolled AS (SELECT s.* FROM (SELECT * FROM step_named UNION ALL SELECT * FROM distance_clean) s
  JOIN ({WINDOWS_SQL}) w USING (app_user_id)
  WHERE s.start_timestamp BETWEEN w.window_start AND w.window_end AND s.app_user_id NOT IN ({EXCLUDED})),
clipped AS (SELECT e.* REPLACE (least(e.value, l.lim) AS value) FROM enrolled e
  JOIN (SELECT modality, quantile_cont(value, 0.99) AS lim FROM enrolled GROUP BY modality) l USING (modality))"""

STUDY_SETTINGS = dict(study_start=CUTOFF)


def study_tables(spark, sf) -> StudyTables:
    return StudyTables(
        study.sensor(spark, sf), study.survey_response(spark, sf), study.answer(spark, sf),
        study.question(spark, sf), study.demographic(spark, sf),
    )


@query(
    "cohort_sensors",
    f"WITH {CLEAN} SELECT id, app_user_id, modality, start_timestamp, app_source, {q6('value')} AS value FROM clipped",
    ("v_sensor", "v_daily"),
)
def _(spark, sf):
    cohort = build_cohort(study_tables(spark, sf), CohortSettings(**STUDY_SETTINGS))
    return cohort.sensors.select("id", "app_user_id", "modality", "start_timestamp", "app_source", r6("value").alias("value"))


MASTER_BUILD = f"""included AS (SELECT * FROM v_daily WHERE app_user_id NOT IN ({EXCLUDED})),
{dedup_ctes(12 * 60, 'included')},
left_over AS (SELECT i.* FROM included i JOIN d_walk w ON w.id = i.id AND w.keep),
rep AS (SELECT app_user_id, CAST(timestamp AS DATE) AS date, arg_max(id, (timestamp, id)) AS id, max(timestamp) AS timestamp, arg_max(survey_id, (timestamp, id)) AS survey_id FROM left_over GROUP BY ALL),
day_answers AS (SELECT r.app_user_id, CAST(r.timestamp AS DATE) AS date, a.question_id, a.id, a.answer, CASE WHEN a.question_id NOT IN (54, 55) THEN {coerce('a.answer')} END AS answer_num
  FROM v_answer a JOIN left_over r ON r.id = a.survey_response_id),
collapsed AS (SELECT rep.id AS survey_response_id, question_id, arg_max(answer, day_answers.id) AS answer, max(answer_num) AS answer_num
  FROM day_answers JOIN rep USING (app_user_id, date) WHERE question_id IN (54, 55) OR answer_num IS NOT NULL GROUP BY ALL),
labelled AS (SELECT survey_response_id, CAST(bool_or((question_id IN (2, 3, 5, 7) AND answer_num >= 2) OR (question_id IN (8, 12, 13) AND answer_num > 0)) AS INTEGER) AS answer
  FROM collapsed WHERE question_id IN (2, 3, 5, 7, 8, 12, 13) GROUP BY 1),
slept AS (SELECT survey_response_id, CASE WHEN w >= a THEN w - a ELSE w - a + 24 END AS sleep_hours FROM (
  SELECT survey_response_id, max(h) FILTER (question_id = 54) AS a, max(h) FILTER (question_id = 55) AS w FROM (
    SELECT *, hour(strptime(answer, '%I:%M %p')) + minute(strptime(answer, '%I:%M %p')) / 60.0::DOUBLE AS h FROM collapsed WHERE question_id IN (54, 55)) GROUP BY 1)),
built AS (SELECT l.survey_response_id, l.answer, rep.app_user_id, rep.timestamp AS record_timestamp, rep.survey_id,
  (epoch_us(rep.timestamp) - lag(epoch_us(rep.timestamp)) OVER (PARTITION BY rep.app_user_id ORDER BY rep.timestamp, rep.id)) / {float(H)!r}::DOUBLE AS referent_hours
  FROM labelled l JOIN rep ON rep.id = l.survey_response_id)"""


@query(
    "cohort_build",
    f"""WITH RECURSIVE {CLEAN}, {MASTER_BUILD},
kinds AS (SELECT app_user_id, bool_or(app_source LIKE '%iPhone%' OR app_source LIKE '%Apple Watch%' OR app_source LIKE '%HealthKit%') AS ios, bool_or(app_source LIKE '%androidx%') AS android FROM clipped GROUP BY 1)
SELECT b.survey_response_id, b.answer, b.app_user_id, b.record_timestamp, b.survey_id, {q6('b.referent_hours')} AS referent_hours, {q6('s.sleep_hours')} AS sleep_hours
FROM built b LEFT JOIN slept s USING (survey_response_id)
WHERE b.app_user_id IN (SELECT app_user_id FROM kinds WHERE ios AND NOT android)
  AND EXISTS (SELECT 1 FROM clipped c WHERE c.app_user_id = b.app_user_id
    AND epoch_us(c.end_timestamp) > epoch_us(b.record_timestamp) // {6 * H} * {6 * H} - {72 * H}
    AND epoch_us(c.start_timestamp) < epoch_us(b.record_timestamp) // {6 * H} * {6 * H})""",
    ("v_sensor", "v_daily", "v_answer"),
)
def _(spark, sf):
    settings = CohortSettings(
        dedup_minutes=12 * 60, collapse="max", os="ios", use_sleep=True, sampler=frames.SAMPLER, **STUDY_SETTINGS
    )
    master = build_cohort(study_tables(spark, sf), settings).master
    return master.select(
        "survey_response_id", "answer", "app_user_id", "record_timestamp", "survey_id",
        r6("referent_hours").alias("referent_hours"), r6("sleep_hours").alias("sleep_hours"),
    )
