"""Day relations made from the driver's tables.

The SQL is plain enough for any engine; only the calendar differs, so tests can make the same rows elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_CALENDAR = "explode(sequence(first_day, last_day, interval 1 day))"
OTHER_CALENDAR = "unnest(generate_series(first_day, last_day, interval 1 day))"
#: Days from 1995-01-01 to an order.
SPARK_ORDINAL = "datediff(cast(o_orderdate AS date), date '1995-01-01')"
OTHER_ORDINAL = "(cast(o_orderdate AS date) - date '1995-01-01')"

#: One dense row per person and calendar day, from two tables. Events: person user_id % 16, 30 days, a day without
#: early events is not valid. Orders: person 100 + region, ten days of orders make a night, about 240 nights with later
#: ones at weekends, a ninth of them not valid.
DAYS = """
WITH e AS (
  SELECT event_id, ts, user_id % 16 AS person, cast(ts AS date) AS day, event_type, value,
         row_number() OVER (PARTITION BY user_id % 16, cast(ts AS date) ORDER BY ts, event_id) AS rn,
         lag(event_type) OVER (PARTITION BY user_id % 16, cast(ts AS date) ORDER BY ts, event_id) AS before
  FROM {events}),
ge AS (
  SELECT person, day, count(*) AS n,
    max(CASE WHEN rn = 1 THEN hour(ts) + minute(ts) / 60e0 END) AS fh,
    avg(CASE WHEN event_type IN ('view', 'click') THEN 1e0 ELSE 0e0 END) AS seen,
    avg(CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END) AS deep,
    avg(CASE WHEN event_type IN ('purchase', 'signup') THEN 1e0 ELSE 0e0 END) AS light,
    avg(CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END) AS rem,
    avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) AS awake,
    avg(CASE WHEN event_type = 'signup' THEN 1e0 ELSE 0e0 END) AS signups,
    percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS p50,
    percentile_disc(0.1) WITHIN GROUP (ORDER BY value) AS p10,
    min(value) AS least,
    min(CASE WHEN event_type = 'error' THEN hour(ts) END) AS error_hour,
    sum(CASE WHEN rn BETWEEN 2 AND 10 AND event_type <> before THEN 1 ELSE 0 END) AS changes,
    sum(CASE WHEN event_type = 'click' THEN value ELSE 0e0 END) AS minutes,
    sum(CASE WHEN event_type = 'click' AND hour(ts) >= 18 THEN value ELSE 0e0 END) AS recent,
    sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks,
    sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases,
    max(CASE WHEN event_type = 'purchase' AND value > 100 THEN 1 ELSE 0 END) AS dear,
    max(CASE WHEN event_type = 'view' AND hour(ts) >= 18 THEN 1 ELSE 0 END) AS late_view,
    sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors
  FROM e GROUP BY person, day),
x AS (
  SELECT 100 + cast(n_regionkey AS bigint) AS person, cast(floor({ordinal} / 10e0) AS int) AS k, o_orderkey,
         o_totalprice / 2000e0 AS value, substr(o_orderpriority, 1, 1) AS p
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey),
xr AS (SELECT *, row_number() OVER (PARTITION BY person, k ORDER BY o_orderkey) AS rn, lag(p) OVER (PARTITION BY person, k ORDER BY o_orderkey) AS before FROM x),
go AS (
  SELECT person, date '2023-01-01' + k AS day, count(*) AS n,
    max(CASE WHEN k % 7 IN (0, 6) THEN 2.2e0 ELSE 0e0 END) + 2 * avg(CASE WHEN p IN ('1', '2') THEN 1e0 ELSE 0e0 END) AS fh,
    avg(CASE WHEN p IN ('4', '5') THEN 1e0 ELSE 0e0 END) AS seen,
    avg(CASE WHEN p = '5' THEN 1e0 ELSE 0e0 END) AS deep,
    avg(CASE WHEN p IN ('3', '4') THEN 1e0 ELSE 0e0 END) AS light,
    avg(CASE WHEN p = '2' THEN 1e0 ELSE 0e0 END) AS rem,
    avg(CASE WHEN p = '1' THEN 1e0 ELSE 0e0 END) AS awake,
    avg(CASE WHEN value > 100 THEN 1e0 ELSE 0e0 END) AS signups,
    percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS p50,
    percentile_disc(0.1) WITHIN GROUP (ORDER BY value) AS p10,
    min(value) AS least,
    min(CASE WHEN p = '1' THEN o_orderkey % 9 END) AS error_hour,
    sum(CASE WHEN rn BETWEEN 2 AND 10 AND p <> before THEN 1 ELSE 0 END) AS changes,
    sum(CASE WHEN p = '3' THEN value ELSE 0e0 END) AS minutes,
    sum(CASE WHEN p = '3' AND o_orderkey % 4 = 0 THEN value ELSE 0e0 END) AS recent,
    sum(CASE WHEN p = '3' THEN 1 ELSE 0 END) AS clicks,
    sum(CASE WHEN p = '4' THEN 1 ELSE 0 END) AS purchases,
    max(CASE WHEN p = '4' AND value > 100 THEN 1 ELSE 0 END) AS dear,
    max(CASE WHEN p = '5' AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS late_view,
    sum(CASE WHEN p = '1' THEN 1 ELSE 0 END) AS errors,
    min(o_orderkey) % 9 <> 0 AS good
  FROM xr GROUP BY person, k),
g AS (SELECT *, fh < 3 AS good FROM ge UNION ALL SELECT * FROM go),
s AS (SELECT person, cast(on_day AS date) AS day FROM (SELECT person, {calendar} AS on_day FROM (SELECT person, min(day) AS first_day, max(day) AS last_day FROM g GROUP BY person) b) c),
v AS (SELECT s.person, s.day, coalesce(good, false) AS valid, g.n, fh, seen, deep, light, rem, awake, signups, p50, p10, least, error_hour, changes, minutes, recent, clicks, purchases, dear, late_view, errors
      FROM s LEFT JOIN g ON s.person = g.person AND s.day = g.day)
SELECT person, day, valid,
  CASE WHEN valid THEN 22 + fh END AS bed,
  CASE WHEN valid THEN 22 + fh + 6 + 3 * seen + 0.3e0 END AS wake,
  CASE WHEN valid THEN 6 + 3 * seen END AS duration,
  CASE WHEN valid THEN 6 + 3 * seen + 0.3e0 END AS in_bed,
  CASE WHEN valid THEN signups >= 0.3e0 END AS nap,
  CASE WHEN valid AND signups >= 0.3e0 THEN signups END AS nap_hours,
  CASE WHEN valid THEN least(greatest(1 - awake, 0.35e0), 1e0) END AS quality,
  CASE WHEN valid THEN deep END AS deep, CASE WHEN valid THEN light END AS light, CASE WHEN valid THEN rem END AS rem, CASE WHEN valid THEN awake END AS awake,
  CASE WHEN valid THEN 45 + p50 / 5 END AS median_bpm,
  CASE WHEN valid THEN 45 + p10 / 5 END AS low_bpm,
  CASE WHEN valid AND n % 2 = 0 THEN 50 + least END AS resting_bpm,
  CASE WHEN valid AND error_hour IS NOT NULL THEN cast(least(90, 10 * error_hour) AS double) END AS settling,
  CASE WHEN valid THEN cast(changes AS double) END AS disruption,
  CASE WHEN valid THEN clicks > 0 END AS exercise_known,
  CASE WHEN valid THEN minutes END AS minutes,
  CASE WHEN valid THEN recent >= 15 END AS evening_exercise,
  CASE WHEN valid THEN minutes >= 60 END AS high_load,
  CASE WHEN valid THEN purchases > 0 END AS food_reported,
  CASE WHEN valid THEN cast(purchases AS bigint) END AS meals,
  CASE WHEN valid THEN late_view = 1 END AS dinner,
  CASE WHEN valid THEN dear = 1 END AS alcohol,
  CASE WHEN valid THEN cast(purchases AS double) END AS fluid,
  CASE WHEN valid THEN errors > 0 END AS wellness_reported,
  CASE WHEN valid THEN 1e0 + errors % 5 END AS stress
FROM v
"""

#: Heart-rate samples and nights of the same people: (person, ts, bpm, confidence) and (person, night, start, end).
SAMPLES = "SELECT user_id % 16 AS person, event_id, ts, cast(30 + floor(value) % 200 AS int) AS bpm, cast(event_id % 4 AS int) AS confidence FROM {events}"
#: Each event as a burst of an hour: a sample every 45 seconds, so that a night of eight hours may have enough of them.
DENSE_SAMPLES = """
SELECT user_id % 16 AS person, event_id * 80 + i AS event_id, ts + {seconds} AS ts,
       cast(45 + (floor(value) + i * 7 + event_id) % 60 AS int) AS bpm, cast((event_id + i) % 4 AS int) AS confidence
FROM {events} {each}
"""
NIGHTS = "SELECT DISTINCT user_id % 16 AS person, cast(ts AS date) AS night FROM {events}"
EXERCISE = "SELECT user_id % 16 AS person, event_id, ts AS start_ts, value AS minutes, event_type AS kind FROM {events} WHERE event_type = 'click'"


#: Stage segments of nights that run from midnight to eight: an event is a segment of 10 to 60 minutes.
SEGMENTS = """
SELECT user_id % 16 AS person, cast(ts AS date) AS night, event_id, ts AS seg_start, 60 * (10 + event_id % 50) AS seconds,
       CASE event_type WHEN 'view' THEN 'deep' WHEN 'click' THEN 'light' WHEN 'purchase' THEN 'rem' WHEN 'signup' THEN 'other' ELSE 'wake' END AS level,
       event_id % 5 = 0 AS short
FROM {events}
"""


def _sql(spark: SparkSession, sf_dir: str, text: str, own: dict[str, DataFrame] | None = None, **more: str) -> DataFrame:
    names = [n for n in ("events", "orders", "customer", "nation") if "{" + n + "}" in text]
    return spark.sql(text.format(**{n: "{" + n + "}" for n in names}, **more), **{n: own[n] if own and n in own else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DAYS, calendar=SPARK_CALENDAR, ordinal=SPARK_ORDINAL)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SAMPLES)


def dense_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events count once a person and id, before they become samples; this also spreads them evenly."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "ts", "user_id", "value", "user_id % 16 AS person").dropDuplicates(["person", "event_id"])
    return _sql(spark, sf_dir, DENSE_SAMPLES.replace("{seconds}", "make_dt_interval(0, 0, 0, i * 45)").replace("{each}", "LATERAL VIEW explode(sequence(0, 79)) AS i"), {"events": events})


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, NIGHTS)


def exercise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EXERCISE)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SEGMENTS)
