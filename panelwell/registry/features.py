"""Scaling, context, demographics and assembled features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwell.operators import features as feats
from panelwell.operators import labels, people, scaling
from panelwell.operators.splits import split_by_user
from panelwell.operators.windows import cyclic_time, window_bin_join
from panelwell.plans.walk_forward import fold_matrix
from panelwell.registry import frames
from panelwell.registry.core import q6, query, r6
from panelwell.registry.cohort import DEVICE_SQL
from panelwell.session import store
from panelwell.sources import study

MODALITIES, SAMPLER = frames.MODALITIES, frames.SAMPLER

# users split into roles, windows attached: held-out users have no train rows
USER_WINDOW = """users AS (SELECT app_user_id, CASE WHEN p < n - held THEN 'train' WHEN p < n - held + floor(held * (0.15::DOUBLE / (0.15::DOUBLE + 0.15::DOUBLE))) THEN 'val' ELSE 'test' END AS role
  FROM (SELECT app_user_id, p, n, ceil(n * (1.0::DOUBLE - 0.7::DOUBLE)) AS held FROM (
    SELECT app_user_id, row_number() OVER (ORDER BY md5('42:' || app_user_id), app_user_id) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT app_user_id FROM v_master)))),
long AS MATERIALIZED (SELECT w.survey_response_id, w.app_user_id, w.bin_idx, w.modality AS channel, w.value, u.role FROM v_window w JOIN users u USING (app_user_id))"""


def user_windows(spark, sf):
    long = window_bin_join(frames.windows(spark, sf), SAMPLER, MODALITIES)
    roles = split_by_user(frames.master(spark, sf), max_group=frames.in_all(spark, sf)).select("survey_response_id", "app_user_id", "role")
    rows = roles.join(long, "survey_response_id").select(
        "survey_response_id", "app_user_id", "bin_idx", F.col("modality").alias("channel"), "value", "role"
    )
    # scalers read the windows more than once, so they are written as a cohort's windows would be
    return store(rows, "windows")


@query(
    "fit_global_scaler",
    f"SELECT fold_index, channel, {q6('avg(value)')} AS mean, {q6('stddev_pop(value)')} AS std FROM v_fold_window WHERE role = 'train' GROUP BY ALL",
    ("v_fold_window",),
)
def _(spark, sf):
    return scaling.fit_global_scaler(frames.fold_windows(spark, sf)).withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "fit_subject_scaler",
    f"SELECT fold_index, app_user_id, channel, {q6('avg(value)')} AS mean, {q6('stddev_pop(value)')} AS std FROM v_fold_window WHERE role = 'train' GROUP BY ALL",
    ("v_fold_window",),
)
def _(spark, sf):
    return scaling.fit_subject_scaler(frames.fold_windows(spark, sf)).withColumns({"mean": r6("mean"), "std": r6("std")})


def scaled(mean: str, std: str) -> str:
    return f"(value - {mean}) / CASE WHEN {std} = 0 OR {std} IS NULL THEN 1 ELSE {std} END"


SUBJECT = "SELECT app_user_id, channel, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY ALL"


@query(
    "transform_by_subject",
    f"WITH {USER_WINDOW} SELECT survey_response_id, bin_idx, channel, role, {q6(scaled('x.m', 'x.s'))} AS scaled FROM long JOIN ({SUBJECT}) x USING (app_user_id, channel)",
    ("v_window", "v_master"),
)
def _(spark, sf):
    rows = scaling.transform_by_subject(user_windows(spark, sf), by=[])
    return rows.select("survey_response_id", "bin_idx", "channel", "role", r6("scaled").alias("scaled"))


@query(
    "dual_scale",
    f"""WITH {USER_WINDOW}, g AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM long WHERE role = 'train' GROUP BY ALL), x AS ({SUBJECT})
SELECT survey_response_id, bin_idx, channel, 'global' AS block, {q6(scaled('g.m', 'g.s'))} AS scaled FROM long JOIN g USING (channel)
UNION ALL SELECT survey_response_id, bin_idx, channel, 'subject', {q6(scaled('x.m', 'x.s'))} FROM long JOIN x USING (app_user_id, channel)
UNION ALL SELECT survey_response_id, bin_idx, 'sin_hour', 'time', {q6('sin(2 * pi() * hour(bin_start) / 24.0)')} FROM v_window WHERE modality = 'step'""",
    ("v_window", "v_master"),
)
def _(spark, sf):
    long = user_windows(spark, sf)
    bins = window_bin_join(frames.windows(spark, sf), SAMPLER, ["step"]).select("survey_response_id", "bin_idx", "bin_start")
    roles = long.select("survey_response_id", "app_user_id", "role").distinct()
    clock = cyclic_time(bins, ["sin_hour"]).join(roles, "survey_response_id").select(
        "survey_response_id", "app_user_id", "bin_idx", F.lit("sin_hour").alias("channel"), F.col("sin_hour").alias("value"), "role"
    )
    rows = scaling.dual_scale(long.unionByName(clock), ["sin_hour"], by=[])
    return rows.select("survey_response_id", "bin_idx", "channel", "block", r6("scaled").alias("scaled"))


@query(
    "select_channels",
    f"WITH {USER_WINDOW}, x AS ({SUBJECT}) SELECT survey_response_id, channel, {q6('sum(' + scaled('x.m', 'x.s') + ')')} AS total FROM long JOIN x USING (app_user_id, channel) GROUP BY ALL",
    ("v_window", "v_master"),
)
def _(spark, sf):
    rows = scaling.dual_scale(user_windows(spark, sf), by=[])
    doubled = [f"{block}:{m}" for block in ("global", "subject") for m in MODALITIES]
    chosen = feats.select_channels(doubled, "subject", len(MODALITIES))
    kept = rows.filter(F.concat_ws(":", "block", "channel").isin(*chosen))
    return kept.groupBy("survey_response_id", "channel").agg(r6(F.sum("scaled")).alias("total"))


FOLD_SLEEP = """rows AS (SELECT c.*, s.sleep_hours, s.sleep_category FROM v_cyclic c LEFT JOIN v_sleep s USING (survey_response_id)),
fit AS (SELECT fold_index, coalesce(avg(sleep_hours), 7) AS m, CASE WHEN stddev_samp(sleep_hours) > 0 THEN stddev_samp(sleep_hours) ELSE 2 END AS s
  FROM rows WHERE role = 'train' GROUP BY fold_index)"""


def fold_sleep(spark, sf):
    return labels.sleep_left_join(frames.cyclic(spark, sf), labels.sleep_hours(study.answer(spark, sf)))


@query(
    "scale_sleep",
    f"""WITH {FOLD_SLEEP} SELECT fold_index, survey_response_id, role, {q6('(coalesce(sleep_hours, m) - m) / s')} AS sleep_hours_scaled,
  coalesce(CAST(sleep_category = 0 AS DOUBLE), 0.0) AS sleep_class_0, coalesce(CAST(sleep_category = 1 AS DOUBLE), 0.0) AS sleep_class_1,
  coalesce(CAST(sleep_category = 2 AS DOUBLE), 0.0) AS sleep_class_2, CAST(sleep_category IS NULL AS DOUBLE) AS sleep_unknown FROM rows JOIN fit USING (fold_index)""",
    ("v_cyclic", "v_sleep"),
)
def _(spark, sf):
    rows = scaling.scale_sleep(fold_sleep(spark, sf)).withColumn("sleep_hours_scaled", r6("sleep_hours_scaled"))
    return rows.select("fold_index", "survey_response_id", "role", *scaling.SLEEP_MODES["both"])


@query(
    "survey_context",
    f"""SELECT fold_index, survey_response_id, role, is_morning, {q6('(coalesce(referent_hours, m) - m) / s')} AS referent_hours_scaled, CAST(referent_hours IS NULL AS DOUBLE) AS referent_missing
FROM v_cyclic JOIN (SELECT fold_index, coalesce(avg(referent_hours), 12) AS m, CASE WHEN stddev_samp(referent_hours) > 0 THEN stddev_samp(referent_hours) ELSE 6 END AS s
  FROM v_cyclic WHERE role = 'train' GROUP BY fold_index) USING (fold_index)""",
    ("v_cyclic",),
)
def _(spark, sf):
    rows = scaling.survey_context(frames.cyclic(spark, sf)).withColumn("referent_hours_scaled", r6("referent_hours_scaled"))
    return rows.select("fold_index", "survey_response_id", "role", *scaling.CONTEXT_MODES["both"])


@query(
    "feature_modes",
    """SELECT fold_index, survey_response_id, coalesce(CAST(sleep_category = 0 AS DOUBLE), 0.0) AS sleep_class_0, coalesce(CAST(sleep_category = 1 AS DOUBLE), 0.0) AS sleep_class_1,
  coalesce(CAST(sleep_category = 2 AS DOUBLE), 0.0) AS sleep_class_2, CAST(sleep_category IS NULL AS DOUBLE) AS sleep_unknown,
  0.0::DOUBLE AS referent_hours_scaled, 1.0::DOUBLE AS referent_missing FROM v_cyclic LEFT JOIN v_sleep USING (survey_response_id)""",
    ("v_cyclic", "v_sleep"),
)
def _(spark, sf):
    # the referent columns are absent here, so their fill values are seen
    rows = scaling.scale_sleep(fold_sleep(spark, sf))
    return scaling.feature_mode(rows, "category_only", "referent_only", keep=["fold_index", "survey_response_id"])


PEOPLE_SQL = f"""SELECT app_user_id, {q6('(coalesce(try_cast(age AS DOUBLE), med) - m) / s')} AS age_scaled,
  CAST(lower(trim(gender)) = 'female' AS DOUBLE) AS gender_female, CAST(lower(trim(gender)) = 'male' AS DOUBLE) AS gender_male,
  CAST(lower(trim(gender)) = 'nonbinary' AS DOUBLE) AS gender_nonbinary, CAST(lower(trim(gender)) NOT IN ('female', 'male', 'nonbinary') AS DOUBLE) AS gender_unknown,
  CAST(lower(trim(lgbt)) = 'no' AS DOUBLE) AS lgbt_no, CAST(lower(trim(lgbt)) = 'yes' AS DOUBLE) AS lgbt_yes, CAST(lower(trim(lgbt)) NOT IN ('no', 'yes') AS DOUBLE) AS lgbt_unknown
FROM v_people, (SELECT quantile_cont(CAST(age AS DOUBLE), 0.5) AS med, avg(CAST(age AS DOUBLE)) AS m, stddev_samp(CAST(age AS DOUBLE)) AS s
  FROM v_people WHERE app_user_id IN (SELECT app_user_id FROM v_cyclic WHERE fold_index = 0 AND role = 'train'))"""


def fold_people(spark, sf):
    train = frames.cyclic(spark, sf).filter("fold_index = 0 and role = 'train'")
    rows = people.fit_demographics(people.eav_pivot(study.demographic(spark, sf)), train, people.GENDERS, people.LGBT, frames.in_all(spark, sf))
    return rows.withColumn("age_scaled", r6("age_scaled"))


@query("fit_demographics", PEOPLE_SQL, ("v_people", "v_cyclic"))
def _(spark, sf):
    return fold_people(spark, sf)


PEOPLE_COLUMNS = [
    "age_scaled", "gender_female", "gender_male", "gender_nonbinary", "gender_unknown", "lgbt_no", "lgbt_yes", "lgbt_unknown",
    "device_android", "device_iphone", "device_watch", "device_unknown",
]


@query(
    "demographics_lookup",
    "SELECT h.id, h.app_user_id, " + ", ".join(f"coalesce({c}, {'1.0' if c.endswith('_unknown') else '0.0'}::DOUBLE) AS {c}" for c in PEOPLE_COLUMNS)
    # every third participant has no demographics, so the default vector is seen
    + f" FROM v_response h LEFT JOIN (SELECT * FROM ({PEOPLE_SQL}) WHERE app_user_id % 3 <> 0) p USING (app_user_id) LEFT JOIN ({DEVICE_SQL}) d USING (app_user_id)",
    ("v_response", "v_people", "v_cyclic", "v_sensor"),
)
def _(spark, sf):
    known = fold_people(spark, sf).filter(F.col("app_user_id") % 3 != 0)
    surveys = study.survey_response(spark, sf).select("id", "app_user_id")
    return people.demographics_lookup(surveys, known, study.sensor(spark, sf))


@query(
    "user_index_lookup",
    """SELECT survey_response_id, app_user_id, coalesce(i, 0) AS user_index FROM v_master LEFT JOIN (
  SELECT app_user_id, row_number() OVER (ORDER BY app_user_id) AS i FROM (SELECT DISTINCT app_user_id FROM v_master WHERE app_user_id % 4 <> 0)) USING (app_user_id)""",
    ("v_master",),
)
def _(spark, sf):
    master = frames.master(spark, sf)
    train = master.filter(F.col("app_user_id") % 4 != 0)
    return people.user_index_lookup(master, train, frames.in_all(spark, sf)).select("survey_response_id", "app_user_id", "user_index")


@query(
    "class_weights",
    f"""SELECT fold_index, label, CAST(n AS BIGINT) AS n, {q6('total / (2.0 * n)')} AS weight FROM (
  SELECT fold_index, label, greatest(count_if(answer = label), 1) AS n, sum(greatest(count_if(answer = label), 1)) OVER (PARTITION BY fold_index) AS total
  FROM v_cyclic, (VALUES (0), (1)) l(label) WHERE role = 'train' GROUP BY fold_index, label)""",
    ("v_cyclic",),
)
def _(spark, sf):
    return scaling.class_weights(frames.cyclic(spark, sf)).withColumn("weight", r6("weight"))


ASSEMBLED = [f"{m}__{s}" for m in MODALITIES for s in ("mean", "max")]


@query(
    "assemble_features",
    f"""WITH w AS (SELECT survey_response_id, {', '.join(f"{'avg' if s == 'mean' else 'max'}(value) FILTER (modality = '{m}') AS {m}__{s}" for m in MODALITIES for s in ('mean', 'max'))} FROM v_window GROUP BY 1)
SELECT survey_response_id, CAST(pos AS INTEGER) AS pos, {q6('v')} AS value FROM (
  SELECT m.survey_response_id, unnest([{', '.join('w.' + c for c in ASSEMBLED)}, CAST(coalesce(p.lgbt = 'yes', false) AS DOUBLE), coalesce(s.sleep_hours, 7), CAST(m.survey_id = 0 AS DOUBLE)]) AS v,
    generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) - 1 AS pos
  FROM v_master m JOIN w USING (survey_response_id) LEFT JOIN v_people p USING (app_user_id) LEFT JOIN v_sleep s USING (survey_response_id))""",
    ("v_window", "v_master", "v_people", "v_sleep"),
)
def _(spark, sf):
    stats = feats.summary_stats(frames.windows(spark, sf), MODALITIES, ["mean", "max"])
    person = people.eav_pivot(study.demographic(spark, sf)).select("app_user_id", (F.col("lgbt") == "yes").alias("__yes"))
    sleep = labels.sleep_hours(study.answer(spark, sf)).select("survey_response_id", "sleep_hours")
    rows = (
        frames.master(spark, sf).join(stats, "survey_response_id").join(person, "app_user_id", "left").join(sleep, "survey_response_id", "left")
        .withColumns({
            "lgbt_yes": F.coalesce(F.col("__yes"), F.lit(False)).cast("double"),
            "hours": F.coalesce("sleep_hours", F.lit(7.0)),
            "is_morning": (F.col("survey_id") == 0).cast("double"),
        })
    )
    made = feats.assemble_features(rows, ASSEMBLED, ["lgbt_yes"], ["hours"], ["is_morning"])
    return made.select("survey_response_id", F.posexplode("features").alias("pos", "value")).withColumn("value", r6("value"))


# the features of the whole protocol: windows scaled per fold, demographics, sleep and context
MATRIX = f"""{FOLD_SLEEP},
t AS (SELECT fold_index, channel, avg(value) AS m, stddev_pop(value) AS s FROM v_fold_window WHERE role = 'train' GROUP BY ALL),
u AS (SELECT fold_index, app_user_id, channel, avg(value) AS m, stddev_pop(value) AS s FROM v_fold_window WHERE role = 'train' GROUP BY ALL),
z AS (SELECT f.fold_index, f.role, f.survey_response_id, f.bin_idx, CAST(f.channel = '{MODALITIES[1]}' AS INTEGER) AS ci, b.block,
    CASE WHEN b.block = 0 THEN {scaled('t.m', 't.s')} ELSE {scaled('u.m', 'u.s')} END AS v
  FROM v_fold_window f JOIN t USING (fold_index, channel) JOIN u USING (fold_index, app_user_id, channel), (VALUES (0), (1)) b(block)),
ages AS (SELECT fold_index, quantile_cont(CAST(age AS DOUBLE), 0.5) AS med, avg(CAST(age AS DOUBLE)) AS am, stddev_samp(CAST(age AS DOUBLE)) AS asd
  FROM (SELECT DISTINCT fold_index, app_user_id FROM v_cyclic WHERE role = 'train') JOIN v_people USING (app_user_id) GROUP BY fold_index),
context AS (SELECT fold_index, coalesce(avg(referent_hours), 12) AS rm, CASE WHEN stddev_samp(referent_hours) > 0 THEN stddev_samp(referent_hours) ELSE 6 END AS rs
  FROM v_cyclic WHERE role = 'train' GROUP BY fold_index),
x AS (SELECT fold_index, role, survey_response_id, unnest([
    CASE WHEN p.app_user_id IS NULL THEN 0.0::DOUBLE ELSE (coalesce(try_cast(p.age AS DOUBLE), ages.med) - ages.am) / ages.asd END,
    {', '.join(f"coalesce(CAST(lower(trim(p.gender)) = '{g}' AS DOUBLE), 0.0)" for g in people.GENDERS)}, coalesce(CAST(lower(trim(p.gender)) NOT IN ('female', 'male', 'nonbinary') AS DOUBLE), 1.0),
    {', '.join(f"coalesce(CAST(lower(trim(p.lgbt)) = '{g}' AS DOUBLE), 0.0)" for g in people.LGBT)}, coalesce(CAST(lower(trim(p.lgbt)) NOT IN ('no', 'yes') AS DOUBLE), 1.0),
    (coalesce(sleep_hours, fit.m) - fit.m) / fit.s, {', '.join(f'coalesce(CAST(sleep_category = {k} AS DOUBLE), 0.0)' for k in (0, 1, 2))}, CAST(sleep_category IS NULL AS DOUBLE),
    CAST(is_morning AS DOUBLE), (coalesce(referent_hours, rm) - rm) / rs, CAST(referent_hours IS NULL AS DOUBLE)]) AS v, unnest(range(16)) AS pos
  FROM rows JOIN fit USING (fold_index) JOIN ages USING (fold_index) JOIN context USING (fold_index) LEFT JOIN v_people p USING (app_user_id))"""
MATRIX_NEEDS = ("v_cyclic", "v_sleep", "v_fold_window", "v_people")


def matrix_rows(spark, sf, featurizer):
    # the folds and windows are read several times
    folds = store(fold_sleep(spark, sf), "folds")
    windows = store(frames.windows(spark, sf).select("survey_response_id", *MODALITIES), "packed-windows")
    made = fold_matrix(windows, folds, MODALITIES, featurizer, True, people.eav_pivot(study.demographic(spark, sf)), "both", "both")
    return made.select("fold_index", "role", "survey_response_id", F.posexplode("features").alias("pos", "value")).withColumn("value", r6("value"))


@query(
    "fold_matrix_raw",
    f"""WITH {MATRIX} SELECT fold_index, role, survey_response_id, CAST(bin_idx * 4 + block * 2 + ci AS INTEGER) AS pos, {q6('v')} AS value FROM z
UNION ALL SELECT fold_index, role, survey_response_id, CAST({4 * 12} + pos AS INTEGER), {q6('v')} FROM x""",
    MATRIX_NEEDS,
)
def _(spark, sf):
    return matrix_rows(spark, sf, "raw")


@query(
    "fold_matrix_stats",
    f"""WITH {MATRIX}, w AS (SELECT fold_index, role, survey_response_id, block, ci, [avg(v), quantile_cont(v, 0.5), stddev_pop(v), min(v), max(v)] AS five FROM z GROUP BY ALL)
SELECT fold_index, role, survey_response_id, CAST(block * 10 + ci * 5 + k AS INTEGER) AS pos, {q6('five[k + 1]')} AS value FROM w, range(5) r(k)
UNION ALL SELECT fold_index, role, survey_response_id, CAST(20 + pos AS INTEGER), {q6('v')} FROM x""",
    MATRIX_NEEDS,
)
def _(spark, sf):
    return matrix_rows(spark, sf, "stats")
