"""Study views and shared intermediate results in the SQL of the check engine.

``VIEWS`` maps a name to (names it needs, SQL). They state the semantics a second time, in
another engine and as plainly as possible: row by row joins, no packing, no segments.
"""

from __future__ import annotations

H = 3_600_000_000  # microseconds per hour


def us(ts: str) -> str:
    return f"epoch_us({ts})"


def ts_of(micros: str) -> str:
    return f"make_timestamp(CAST({micros} AS BIGINT))"


def coerce(text: str) -> str:
    return (
        f"CASE WHEN lower(trim({text})) = 'yes' THEN 1.0::DOUBLE WHEN lower(trim({text})) = 'no' THEN 0.0::DOUBLE "
        f"ELSE try_cast(trim({text}) AS DOUBLE) END"
    )


def numbered(source: str, by: str = "app_user_id", ts: str = "record_timestamp", tie: str = "survey_response_id") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {ts}, {tie}) - 1 AS position, "
        f"count(*) OVER (PARTITION BY {by}) AS n_history FROM {source}"
    )


def cyclic(source: str, cuts: list[tuple], width: float, purge_hours: float, by: str = "app_user_id",
           ts: str = "record_timestamp", tie: str = "survey_response_id", columns: str = "*") -> str:
    """Cyclic folds of a history view; ``cuts`` are (fold, test start, test end, train start)."""
    values = ", ".join(f"({f}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for f, a, b, c in cuts)
    purge = int(purge_hours * H)
    keys = ", ".join(f"r.{k.strip()}" for k in by.split(","))
    return f"""
SELECT {columns} FROM (
  SELECT *, count_if(kind <> 'test') OVER (PARTITION BY {by}, fold_index) AS n_train FROM (
    SELECT * FROM (
      SELECT *, CASE WHEN kind = 'test' THEN 'test' ELSE 'train' END AS role,
        min(CASE WHEN kind = 'test' THEN epoch_us({ts}) END) OVER (PARTITION BY {by}, fold_index) AS test_first,
        max(CASE WHEN kind = 'test' THEN epoch_us({ts}) END) OVER (PARTITION BY {by}, fold_index) AS test_last
      FROM (
        SELECT h.*, f.fold_index,
          CASE WHEN round_even(n_history * f.b, 0) <= round_even(n_history * f.a, 0) THEN NULL
               WHEN position >= round_even(n_history * f.a, 0) AND position < round_even(n_history * f.b, 0) THEN 'test'
               WHEN f.c < 0 AND position < round_even(n_history * f.a, 0) THEN 'near'
               WHEN f.c < 0 AND position >= round_even(n_history * (1.0::DOUBLE + f.c), 0) THEN 'far'
               WHEN f.c >= 0 AND position >= round_even(n_history * f.c, 0) AND position < round_even(n_history * f.a, 0) THEN 'near'
          END AS kind
        FROM ({numbered(source, by, ts, tie)}) h, (VALUES {values}) f(fold_index, a, b, c)
        WHERE n_history >= round_even(n_history * {width!r}::DOUBLE, 0) + 1
      ) WHERE kind IS NOT NULL
    )
    WHERE kind = 'test' OR {purge} = 0
       OR (kind = 'near' AND epoch_us({ts}) < test_first - {purge})
       OR (kind = 'far' AND epoch_us({ts}) > test_last + {purge})
  )
) WHERE n_train > 0"""


CUTS_80_20 = [(0, 0.0, 0.2, -0.8), (1, 0.2, 0.4, -0.6), (2, 0.4, 0.6, -0.4), (3, 0.6, 0.8, -0.2), (4, 0.8, 1.0, 0.0)]

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_sensor": ((), """
SELECT event_id AS id, user_id AS app_user_id, CASE WHEN event_type = 'click' THEN 'step' ELSE 'distance' END AS modality,
  ts AS start_timestamp, ts + CAST(event_id % 7 AS INTEGER) * INTERVAL 5 MINUTE AS end_timestamp, value,
  CASE user_id % 5 WHEN 0 THEN 'iPhone 13' WHEN 1 THEN 'health.connect.androidx' WHEN 2 THEN 'Apple Watch'
    WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'iPhone 13' ELSE 'androidx.health' END ELSE 'Health' END AS app_source
FROM events WHERE event_type IN ('click', 'view')"""),
    "v_response": ((), """
SELECT event_id AS id, user_id AS app_user_id, ts AS timestamp,
  CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS INTEGER) AS survey_id
FROM events WHERE event_type IN ('signup', 'error', 'purchase')"""),
    "v_answer": ((), """
SELECT event_id * 100 + q AS id, event_id AS survey_response_id, q AS question_id,
  CASE WHEN q IN (2, 3, 5, 7) THEN CAST(1 + greatest(0, (k + 13 * q) % 61 - 57) AS VARCHAR)
       WHEN q IN (8, 12, 13) THEN CASE WHEN (k + 7 * q) % 53 = 0 THEN 'Yes' WHEN event_id % 2 = 0 THEN 'no' ELSE ' No' END
       WHEN q = 54 THEN CAST(9 + k % 3 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN ':00' ELSE ':30' END || ' PM'
       ELSE CAST(5 + k % 5 AS VARCHAR) || ':15 AM' END AS answer
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
      WHERE event_type IN ('signup', 'error', 'purchase')) e,
     (VALUES (2), (3), (5), (7), (8), (12), (13), (54), (55)) t(q)
WHERE (event_id + q) % 11 <> 0"""),
    "v_demographic": ((), """
SELECT * FROM (
  SELECT c_custkey AS app_user_id, keyword,
    CASE keyword WHEN 'age' THEN CAST(18 + c_custkey % 50 AS VARCHAR)
      WHEN 'gender at birth' THEN CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END
      WHEN 'gender identity' THEN CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'nonbinary'
        WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END
      ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN 'yes' ELSE 'no' END END AS value
  FROM customer, (VALUES ('age'), ('gender at birth'), ('gender identity'), ('lgbt')) k(keyword)
) WHERE value IS NOT NULL"""),
    "v_people": (("v_demographic",), """
SELECT app_user_id, max(value) FILTER (keyword = 'age') AS age,
  max(value) FILTER (keyword = 'gender at birth') AS gender_at_birth,
  coalesce(max(value) FILTER (keyword = 'gender identity'), max(value) FILTER (keyword = 'gender at birth')) AS gender,
  max(value) FILTER (keyword = 'lgbt') AS lgbt
FROM v_demographic GROUP BY app_user_id"""),
    "v_history": ((), """
SELECT o_orderkey AS id, o_custkey AS app_user_id, o_orderdate AS record_timestamp,
  CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS answer FROM orders"""),
    "v_daily": (("v_response",), "SELECT * FROM v_response WHERE survey_id IN (0, 1)"),
    "v_coerced": (("v_answer",), f"SELECT * FROM (SELECT *, {coerce('answer')} AS answer_num FROM v_answer) WHERE answer_num IS NOT NULL"),
    "v_labels": (("v_coerced", "v_daily"), """
SELECT survey_response_id,
  CAST(bool_or((question_id IN (2, 3, 5, 7) AND answer_num >= 2) OR (question_id IN (8, 12, 13) AND answer_num > 0)) AS INTEGER) AS answer
FROM v_coerced WHERE question_id IN (2, 3, 5, 7, 8, 12, 13) AND survey_response_id IN (SELECT id FROM v_daily)
GROUP BY survey_response_id"""),
    "v_master": (("v_labels", "v_daily"), """
SELECT l.survey_response_id, l.answer, d.app_user_id, d.timestamp AS record_timestamp, d.survey_id
FROM v_labels l JOIN v_daily d ON d.id = l.survey_response_id"""),
    "v_referent": (("v_master",), f"""
SELECT *, (epoch_us(record_timestamp) - epoch_us(prev_record_timestamp)) / {float(H)!r}::DOUBLE AS referent_hours,
  CAST(survey_id = 0 AS DOUBLE) AS is_morning
FROM (SELECT *, lag(record_timestamp) OVER (PARTITION BY app_user_id ORDER BY record_timestamp, survey_response_id) AS prev_record_timestamp FROM v_master)"""),
    "v_sleep": (("v_answer",), """
SELECT survey_response_id, CASE WHEN w >= a THEN w - a ELSE w - a + 24 END AS sleep_hours,
  CAST(CASE WHEN w IS NULL OR a IS NULL THEN NULL WHEN CASE WHEN w >= a THEN w - a ELSE w - a + 24 END < 5 THEN 0
    WHEN CASE WHEN w >= a THEN w - a ELSE w - a + 24 END <= 10 THEN 1 ELSE 2 END AS INTEGER) AS sleep_category
FROM (SELECT survey_response_id, max(h) FILTER (question_id = 54) AS a, max(h) FILTER (question_id = 55) AS w FROM (
  SELECT survey_response_id, question_id,
    hour(strptime(answer, '%I:%M %p')) + minute(strptime(answer, '%I:%M %p')) / 60.0::DOUBLE AS h
  FROM v_answer WHERE question_id IN (54, 55)) GROUP BY survey_response_id)"""),
    "v_bins6": (("v_sensor",), f"""
SELECT app_user_id, modality, epoch_us(start_timestamp) // {6 * H} AS b, sum(value) AS value
FROM v_sensor GROUP BY ALL"""),
    # rolling 72 h / 6 h windows, one row per survey, modality and bin
    "v_window": (("v_master", "v_bins6"), f"""
SELECT m.survey_response_id, m.app_user_id, m.record_timestamp, m.answer, mo.modality, CAST(i.bin_idx AS INTEGER) AS bin_idx,
  make_timestamp(CAST((epoch_us(m.record_timestamp) // {6 * H} - 12 + i.bin_idx) * {6 * H} AS BIGINT)) AS bin_start,
  coalesce(s.value, 0.0::DOUBLE) AS value
FROM v_master m CROSS JOIN (VALUES ('distance'), ('step')) mo(modality) CROSS JOIN (SELECT unnest(range(12)) AS bin_idx) i
LEFT JOIN v_bins6 s ON s.app_user_id = m.app_user_id AND s.modality = mo.modality
  AND s.b = epoch_us(m.record_timestamp) // {6 * H} - 12 + i.bin_idx"""),
    "v_cyclic": (("v_referent",), cyclic("v_referent", CUTS_80_20, 0.8, 24)),
    "v_predictions": (("v_cyclic",), """
SELECT c.fold_index, c.survey_response_id, c.app_user_id, c.record_timestamp, c.answer AS y_true,
  1.0::DOUBLE - (CAST(json_extract_string(e.props, '$.k') AS INTEGER) + 20 * c.answer)::DOUBLE / 140.0::DOUBLE AS prob_class_0,
  (CAST(json_extract_string(e.props, '$.k') AS INTEGER) + 20 * c.answer)::DOUBLE / 140.0::DOUBLE AS prob_class_1
FROM v_cyclic c JOIN events e ON e.event_id = c.survey_response_id WHERE c.role = 'test'"""),
    # samples of the scaling queries: windows of each fold's rows
    "v_fold_window": (("v_cyclic", "v_window"), """
SELECT c.fold_index, c.role, w.survey_response_id, w.app_user_id, w.bin_idx, w.modality AS channel, w.value
FROM v_cyclic c JOIN v_window w USING (survey_response_id)"""),
}
