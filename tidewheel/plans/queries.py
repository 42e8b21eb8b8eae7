"""Queries over the driver's tables, each with SQL for another engine where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import associations, clustering, ingest, patterns, periodicity, sleep_days, windows
from ..operators.windows import FEATURES, KEY
from ..sources import adapters, synthetic
from ..scratch import kept
from .oracle import sql, upto

FLAGSHIP = "emg1_patterns"
_MEASURES = ["bed", "wake", "duration", "in_bed", "nap_hours", "quality", "deep", "light", "rem", "awake", "median_bpm", "low_bpm", "resting_bpm", "minutes"]


def _rounded(df: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    """df with these columns rounded; doubles as SQL engines do that scale them first."""
    double = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.withColumns({c: fn.rounded(F.col(c), digits) if c in double else F.round(c, digits) for c in columns})


def _rounds(columns: list[str], digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_days(adapters.days(spark, d))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return patterns.membership(patterns.rule_labels(windows.features(_windowed(spark, d))))


def _patterns(spark: SparkSession, d: str, days: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    days = adapters.days(spark, d) if days is None else days
    members = _members(spark, d) if members is None else members
    return patterns.published(patterns.emergence(members, patterns.window_counts(days)))


def _shared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(days, members) as tables, for queries whose plans read them more than once."""
    days = kept(adapters.days(spark, d), "days")
    return days, kept(patterns.membership(patterns.rule_labels(windows.features(windows.window_days(days)))), "members")


def src_days(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(adapters.days(spark, d), _MEASURES)


def win1_rolling_counts(spark: SparkSession, d: str) -> DataFrame:
    return windows.rolling_counts(adapters.days(spark, d))


def agg13_scales(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(windows.scales(_windowed(spark, d)), [f"{m}_{x}" for m, _, _ in windows.METRICS for x in ("center", "scale")], 12)


def agg14_extra_sleep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(windows.extra_sleep(_windowed(spark, d)), ["nap_share"])


def prj7_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(windows.features(_windowed(spark, d)).drop("bed", "quality"), FEATURES)


def mem1_membership(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_members(spark, d).select(*KEY, "day", "cluster", "membership", "d", "clarity", "weight"), ["d", "clarity", "weight"])


def emg1_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_patterns(spark, d), ["n_eff", "median_bed", "support", "recurrence", "compactness", "separation", "temporal_stability", "recent_continuity"])


def flt5_published(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d).where("shown").select(*KEY, "cluster", "rank", "status", "emergence", "confidence")


def agg29_windows_by_shown(spark: SparkSession, d: str) -> DataFrame:
    per = _patterns(spark, d).groupBy(*KEY).agg(F.count_if("shown").alias("shown"))
    return per.groupBy("shown").agg(F.count("*").alias("windows"))


def ctx1_associations(spark: SparkSession, d: str) -> DataFrame:
    days, members = _shared(spark, d)
    found = associations.associations(windows.window_days(days), members)
    return _rounded(found, ["log_odds", "strength", "coverage", "confidence"])


def srt3_top_associations(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    days, members = _shared(spark, d)
    found = associations.associations(windows.window_days(days), members).where("shown")
    w = Window.partitionBy(*KEY, "cluster").orderBy(F.desc(F.round(F.col("confidence") * F.col("strength"), 9)), "definition")
    return found.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select(*KEY, "cluster", "definition", "place")


def win10_discovery_control(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg over the share of orders' prices above each customer's nation mean, as stand-in p values."""
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg((F.count_if(F.col("o_totalprice") > 150000) / (F.count("*") + 1.0)).alias("p"))
    return _rounded(periodicity.discovery_control(o.withColumn("family", F.col("o_custkey") % 7), "p", ["family"]), ["p", "q"])


def clu1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster(windows.features(_windowed(spark, d))).select(*KEY, "day", "cluster", "selected_k", F.round("stability", 9).alias("stability"))


def clu6_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return clustering.diagnostics(windows.features(_windowed(spark, d)))


def wnd1_clustered_patterns(spark: SparkSession, d: str) -> DataFrame:
    labelled = clustering.cluster(windows.features(_windowed(spark, d))).drop("selected_k")
    return patterns.published(patterns.emergence(patterns.membership(labelled), patterns.window_counts(adapters.days(spark, d)))).select(*KEY, "cluster", "rank", "status", "emergence", "confidence", "shown")


def _nights(spark: SparkSession, d: str) -> DataFrame:
    n = kept(adapters.nights(spark, d), "nights")  # of known size, so that few nights go to the samples and not the samples to them
    start = F.col("night").cast("timestamp_ntz")
    return n.select("person", "night", start.alias("start_ts"), (start + F.expr("interval 8 hours")).alias("end_ts"))


def join1_samples_in_nights(spark: SparkSession, d: str) -> DataFrame:
    return ingest.once(ingest.samples_in_nights(adapters.samples(spark, d), _nights(spark, d))).select("person", "event_id", "night", "bpm")


def agg4_heart_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Nights of samples that events spread; with 120 samples and half of the minutes seen, a night has its metrics."""
    joined = ingest.samples_in_nights(adapters.dense_samples(spark, d), _nights(spark, d))
    return _rounded(ingest.heart_metrics(joined).withColumns({c: F.col(c).cast("double") for c in ("median_bpm", "low_bpm")}), ["coverage", "confident"])


def agg7_settling(spark: SparkSession, d: str) -> DataFrame:
    joined = ingest.once(ingest.samples_in_nights(adapters.samples(spark, d), _nights(spark, d)))
    return _rounded(ingest.settling(joined).withColumn("settling_minutes", F.col("settling_minutes").cast("double")), ["first_coverage", "opening_delta", "high_share"])


def join2_exercise(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ingest.exercise_before(_nights(spark, d), adapters.exercise(spark, d)), ["minutes", "recent_minutes", "intensity_minutes"])


def join17_profile(spark: SparkSession, d: str) -> DataFrame:
    """Depth at 29 instants of nights whose stages are events."""
    return sleep_days.profiles(adapters.segments(spark, d))


def agg8_first_minutes(spark: SparkSession, d: str) -> DataFrame:
    return sleep_days.opening(adapters.segments(spark, d))


def prj3_night_dates(spark: SparkSession, d: str) -> DataFrame:
    """Evening, end after start, stage shares and extended hours, each event being a short sleep that ends up to a day off."""
    start = F.col("ts")
    end = sleep_days.end_after(start, F.expr("ts + make_dt_interval(0, cast(event_id % 7 AS int) - 3)"))
    e = spark.read.parquet(f"{d}/events.parquet")
    shares = sleep_days.mix({"deep": (F.col("event_id") % 3).cast("double"), "light": (F.col("event_id") % 4).cast("double"), "rem": (F.col("event_id") % 6).cast("double"), "wake": F.lit(None).cast("double")})
    return e.select("event_id", sleep_days.context_date(start).alias("context_date"), F.round(fn.extended_hour(end), 4).alias("wake_hour"), sleep_days.seconds(end).alias("end_second"), *(v.alias(k) for k, v in shares.items()), sleep_days.depth_of(F.col("event_type")).alias("depth"))


def fn_labels(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    h = F.col("value") / 7
    return e.select(
        "event_id", fn.clock_label(h).alias("clock"), fn.duration_label(h).alias("length"), fn.monday(F.col("ts")).alias("monday"), fn.is_rest_day(F.col("ts")).alias("rest_day"),
        F.round(fn.extended_hour(F.col("ts")), 9).alias("extended_hour"), fn.half_up(-h).alias("half_up"), fn.pairs_of(F.col("event_id") % 100).alias("pairs"), F.date_format("ts", "MMM d").alias("short_date"),
    )


def gen1_synthetic_days(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.days(spark)


def src10_early_share(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.round(synthetic.early_share(F.col("event_id") % 16, F.col("event_id") % 181), 9).alias("share"))


def fn20_text_seed(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_type").distinct().select("event_type", fn.text_seed(F.col("event_type")).alias("seed"), fn.text_seed(F.col("event_type"), 7919).alias("salted"))


_N = "nights AS (SELECT DISTINCT user_id % 16 AS person, cast(ts AS date) AS night, cast(cast(ts AS date) AS timestamp) AS start_ts, cast(cast(ts AS date) AS timestamp) + INTERVAL 8 HOURS AS end_ts FROM events)"
_S = f"samples AS ({adapters.SAMPLES.format(events='events')})"
_J = "jn AS (SELECT * FROM (SELECT s.person, event_id, ts, bpm, confidence, night, start_ts, end_ts, row_number() OVER (PARTITION BY s.person, event_id ORDER BY start_ts, night) AS r FROM samples s JOIN nights n ON s.person = n.person AND ts >= start_ts AND ts < end_ts WHERE bpm BETWEEN 30 AND 220 AND confidence >= 1) WHERE r = 1)"
_COVER = "least(1, greatest(0, count(DISTINCT date_trunc('minute', ts)) / 480.0))"
_ENOUGH = f"count(*) >= 120 AND {_COVER} >= 0.5"
_DENSE = "samples AS (" + adapters.DENSE_SAMPLES.replace("{seconds}", "to_seconds(i * 45)").replace("{each}", ", (SELECT unnest(range(0, 80)) AS i)").format(events="events") + ")"

_ASSOC = """
rest AS (SELECT person, window_end, day, dayofweek(day) IN (0, 6) AS rest, exercise_known, evening_exercise, high_load, coalesce(food_reported, false) AS food, dinner, alcohol, fluid, coalesce(wellness_reported, false) AS well, stress FROM wd WHERE valid),
df AS (
  SELECT person, window_end, day, rest, 'inferred_rest_day' AS definition, 'calendar' AS source, true AS observed, rest AS exposed FROM rest UNION ALL
  SELECT person, window_end, day, rest, 'evening_exercise', 'exercise', exercise_known, evening_exercise FROM rest UNION ALL
  SELECT person, window_end, day, rest, 'high_exercise_load', 'exercise', exercise_known, high_load FROM rest UNION ALL
  SELECT person, window_end, day, rest, 'late_dinner', 'food', food, dinner FROM rest UNION ALL
  SELECT person, window_end, day, rest, 'alcohol', 'food', food, alcohol FROM rest UNION ALL
  SELECT person, window_end, day, rest, 'low_hydration', 'food', food AND fluid IS NOT NULL, fluid < 5 FROM rest UNION ALL
  SELECT person, window_end, day, rest, 'high_stress', 'wellness', well AND stress IS NOT NULL, stress >= 4 FROM rest),
core AS (SELECT person, window_end, cluster, day FROM me WHERE membership = 'core'),
cp AS (SELECT person, window_end, cluster, count(*) AS core_days FROM core GROUP BY ALL),
sd AS (SELECT cp.*, df.day, definition, source, coalesce(exposed, false) AS exposed, core.day IS NOT NULL AS own, CASE WHEN source = 'calendar' THEN NULL ELSE rest END AS stratum
       FROM cp JOIN df USING (person, window_end) LEFT JOIN core ON cp.person = core.person AND cp.window_end = core.window_end AND cp.cluster = core.cluster AND df.day = core.day WHERE coalesce(observed, false)),
st AS (SELECT person, window_end, cluster, core_days, definition, source, stratum, count_if(own AND exposed)::BIGINT AS a, count_if(own AND NOT exposed)::BIGINT AS b, count_if(NOT own AND exposed)::BIGINT AS c, count_if(NOT own AND NOT exposed)::BIGINT AS d FROM sd GROUP BY ALL),
st2 AS (SELECT *, a + b > 0 AND c + d > 0 AS ok, max(CASE WHEN a + b > 0 AND c + d > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY person, window_end, cluster, definition) = 1 AS both_seen FROM st),
su AS (SELECT person, window_end, cluster, core_days, definition, source, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d, sum((a + 0.5) * (d + 0.5) / (a + b + c + d + 2)) AS up, sum((b + 0.5) * (c + 0.5) / (a + b + c + d + 2)) AS down, any_value(both_seen) AS both_seen
       FROM st2 WHERE ok OR NOT both_seen OR source = 'calendar' GROUP BY person, window_end, cluster, core_days, definition, source),
lo AS (SELECT *, CASE WHEN source = 'calendar' OR NOT both_seen THEN ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) ELSE ln(up / greatest(1e-6, down)) END AS x FROM su),
tu AS (SELECT person, window_end, cluster, core_days, CASE WHEN t THEN 'before_inferred_work_day' ELSE definition END AS definition, source, CASE WHEN t THEN b ELSE a END AS a, CASE WHEN t THEN a ELSE b END AS b, CASE WHEN t THEN d ELSE c END AS c, CASE WHEN t THEN c ELSE d END AS d, CASE WHEN t THEN -x ELSE x END AS log_odds
       FROM (SELECT *, source = 'calendar' AND x < 0 AS t FROM lo)),
sg AS (SELECT *, tanh(abs(log_odds) / 2) AS strength, (a + b) / core_days AS coverage, CASE WHEN log_odds >= 0 THEN a ELSE b END AS support, c + d AS comparison FROM tu),
cf AS (SELECT *, least(1, greatest(0, coverage * (1 - exp(-support / 4)) * (1 - exp(-comparison / 6)) * (0.45 + 0.55 * strength))) AS confidence FROM sg),
ac AS (SELECT *, support >= 2 AND comparison >= 3 AND log_odds > 0 AND strength >= 0.15 AND confidence >= 0.25 AS shown FROM cf)"""


QUERIES = {f.__name__: f for f in (
    src_days, win1_rolling_counts, agg13_scales, agg14_extra_sleep, prj7_features, mem1_membership, emg1_patterns, flt5_published, agg29_windows_by_shown, ctx1_associations, srt3_top_associations,
    win10_discovery_control, clu1_clusters, clu6_diagnostics, wnd1_clustered_patterns, join1_samples_in_nights, agg4_heart_metrics, agg7_settling, join2_exercise, join17_profile, agg8_first_minutes, prj3_night_dates, fn_labels, gen1_synthetic_days, src10_early_share, fn20_text_seed,
)}

ORACLES = {
    "src_days": sql("SELECT * EXCLUDE (" + ", ".join(_MEASURES) + "), " + _rounds(_MEASURES) + " FROM days", *upto("days")),
    "win1_rolling_counts": sql("SELECT person, day AS window_end, count(*) OVER w AS available, (count_if(valid) OVER w)::BIGINT AS valid_days FROM days WINDOW w AS (PARTITION BY person ORDER BY day RANGE BETWEEN INTERVAL 41 DAYS PRECEDING AND CURRENT ROW)", *upto("days")),
    "agg13_scales": sql("SELECT person, window_end, valid_days, " + _rounds([f"{m}_{x}" for m, _, _ in windows.METRICS for x in ("center", "scale")], 12) + " FROM sc", *upto("scales")),
    "agg14_extra_sleep": sql("SELECT person, window_end, naps, round(nap_share, 9) AS nap_share, nap_weeks, nap_eligible, nap_defining FROM ex", *upto("extra")),
    "prj7_features": sql("SELECT person, window_end, day, " + _rounds(FEATURES) + " FROM ft", *upto("featured")),
    "mem1_membership": sql("SELECT person, window_end, day, cluster, membership, " + _rounds(["d", "clarity", "weight"]) + " FROM me", *upto("members")),
    "emg1_patterns": sql("SELECT person, window_end, cluster, days, core_days, shape_days, emergence, confidence, status, shown, rank, " + _rounds(["n_eff", "median_bed", "support", "recurrence", "compactness", "separation", "temporal_stability", "recent_continuity"]) + " FROM pb", *upto("published")),
    "flt5_published": sql("SELECT person, window_end, cluster, rank, status, emergence, confidence FROM pb WHERE shown", *upto("published")),
    "agg29_windows_by_shown": sql("SELECT shown, count(*) AS windows FROM (SELECT person, window_end, count_if(shown)::BIGINT AS shown FROM pb GROUP BY ALL) GROUP BY shown", *upto("published")),
    "ctx1_associations": sql("SELECT person, window_end, cluster, core_days, definition, source, a, b, c, d, support, comparison, shown, " + _rounds(["log_odds", "strength", "coverage", "confidence"]) + " FROM ac", *upto("members"), _ASSOC),
    "srt3_top_associations": sql("SELECT person, window_end, cluster, definition, place FROM (SELECT *, row_number() OVER (PARTITION BY person, window_end, cluster ORDER BY round(confidence * strength, 9) DESC, definition) AS place FROM ac WHERE shown) WHERE place <= 3", *upto("members"), _ASSOC),
    "win10_discovery_control": "WITH o AS (SELECT o_custkey, count_if(o_totalprice > 150000) / (count(*) + 1.0) AS p FROM orders GROUP BY 1), r AS (SELECT *, o_custkey % 7 AS family, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY p) AS k, count(*) OVER (PARTITION BY o_custkey % 7) AS m FROM o) SELECT o_custkey, family, round(p, 9) AS p, round(least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r",
    "join1_samples_in_nights": sql("SELECT person, event_id, night, bpm FROM jn", _N, _S, _J),
    "agg4_heart_metrics": sql(f"SELECT person, night, count(*) AS n, round({_COVER}, 9) AS coverage, round(avg(CASE WHEN confidence >= 2 THEN 1.0 ELSE 0.0 END), 9) AS confident, CASE WHEN {_ENOUGH} THEN quantile_disc(bpm, 0.5)::DOUBLE END AS median_bpm, CASE WHEN {_ENOUGH} THEN quantile_disc(bpm, 0.1)::DOUBLE END AS low_bpm FROM jn GROUP BY person, night", _N, _DENSE, _J),
    "agg7_settling": sql("""SELECT person, night, round(observed / 90, 9) AS first_coverage, (CASE WHEN observed / 90 >= 0.6 THEN m END)::DOUBLE AS settling_minutes, CASE WHEN observed / 90 >= 0.6 THEN m < 90 END AS settled, CASE WHEN observed / 90 >= 0.6 THEN round(greatest(0, coalesce(opening - baseline, 0)), 9) END AS opening_delta, CASE WHEN observed / 90 >= 0.6 THEN round(high, 9) END AS high_share
        FROM (SELECT person, night, any_value(baseline) AS baseline, any_value(observed) AS observed, coalesce(min(CASE WHEN minute <= 70 AND seen >= 12 AND calm >= 0.8 * seen THEN minute END), 90) AS m, median(CASE WHEN minute < 15 THEN bpm END) AS opening, avg(CASE WHEN bpm IS NOT NULL THEN CASE WHEN bpm > baseline + 3 THEN 1.0 ELSE 0.0 END END) AS high FROM fr GROUP BY person, night)""", _N, _S, _J,
        "mi AS (SELECT person, night, floor(epoch(ts - start_ts) / 60)::BIGINT AS minute, median(bpm) AS bpm FROM jn GROUP BY ALL), ba AS (SELECT person, night, quantile_cont(bpm, 0.25) AS baseline, count_if(minute < 90) AS observed FROM mi GROUP BY ALL), sn AS (SELECT ba.*, unnest(range(0, 90)) AS minute FROM ba), sj AS (SELECT sn.*, mi.bpm FROM sn LEFT JOIN mi ON sn.person = mi.person AND sn.night = mi.night AND sn.minute = mi.minute), fr AS (SELECT *, count(bpm) OVER w AS seen, count_if(bpm <= baseline + 3) OVER w AS calm FROM sj WINDOW w AS (PARTITION BY person, night ORDER BY minute ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))"),
    "join2_exercise": sql("""SELECT person, night, count(*) AS exercises, round(sum(minutes), 9) AS minutes, round(sum(CASE WHEN recent THEN minutes ELSE 0 END), 9) AS recent_minutes, 0.0::DOUBLE AS intensity_minutes, round((epoch_us(any_value(start_ts)) - epoch_us(max(x_end))) / 3.6e9, 2) AS last_end_hours, 'click' AS kinds, sum(CASE WHEN recent THEN minutes ELSE 0 END) >= 15 AS evening, sum(minutes) >= 60 AS high_load
        FROM (SELECT n.person, n.night, n.start_ts, x.minutes, x.start_ts + to_seconds(floor(x.minutes * 60)::BIGINT) AS x_end, x.start_ts + to_seconds(floor(x.minutes * 60)::BIGINT) >= n.start_ts - INTERVAL 6 HOURS AS recent FROM nights n JOIN x ON n.person = x.person AND x.start_ts < n.start_ts AND x.start_ts >= n.start_ts - INTERVAL 18 HOURS) GROUP BY person, night""", _N, f"x AS ({adapters.EXERCISE.format(events='events')})"),
    "join17_profile": f"""WITH sg AS ({adapters.SEGMENTS.format(events='events')}), ni AS (SELECT DISTINCT person, night FROM sg), pt AS (SELECT *, i, night + to_seconds(28800 * i / 28) AS t FROM ni, (SELECT unnest(range(0, 29)) AS i)),
        hit AS (SELECT pt.person, pt.night, i, arg_min(level, (NOT short, seg_start, event_id)) AS level FROM pt JOIN sg ON pt.person = sg.person AND pt.night = sg.night AND date_trunc('second', seg_start) <= t AND t < date_trunc('second', seg_start) + to_seconds(seconds) GROUP BY ALL)
        SELECT pt.person, pt.night, i, CASE level WHEN 'deep' THEN 3.0 WHEN 'light' THEN 2.0 WHEN 'rem' THEN 1.0 WHEN 'wake' THEN 0.0 WHEN 'other' THEN 1.5 ELSE CASE WHEN i IN (0, 28) THEN 0.0 ELSE 2.0 END END::DOUBLE AS depth FROM pt LEFT JOIN hit USING (person, night, i)""",
    "agg8_first_minutes": f"""WITH sg AS (SELECT *, date_trunc('second', seg_start) AS s FROM ({adapters.SEGMENTS.format(events='events')})), ni AS (SELECT DISTINCT person, night FROM sg), mi AS (SELECT *, night + to_seconds(60 * m + 30) AS t FROM ni, (SELECT unnest(range(0, 90)) AS m)),
        hit AS (SELECT mi.person, mi.night, m, arg_min(level, (seg_start, event_id)) AS level FROM mi JOIN sg ON mi.person = sg.person AND mi.night = sg.night AND NOT short AND s <= t AND t < s + to_seconds(seconds) GROUP BY ALL),
        al AS (SELECT mi.person, mi.night, m, level, lag(level) OVER (PARTITION BY mi.person, mi.night ORDER BY m) AS before FROM mi LEFT JOIN hit USING (person, night, m)),
        br AS (SELECT person, night, count_if(short AND s >= night AND s < night + INTERVAL 90 MINUTES)::BIGINT AS brief FROM sg GROUP BY ALL),
        co AS (SELECT person, night, count(level) AS seen, count_if(level <> before)::BIGINT AS changes, count_if(level = 'wake')::BIGINT AS awake FROM al GROUP BY ALL)
        SELECT person, night, CASE WHEN seen >= 60 THEN changes END AS transitions, CASE WHEN seen >= 60 THEN awake END AS wake_minutes, CASE WHEN seen >= 60 THEN brief END AS brief_wakes, CASE WHEN seen >= 60 THEN changes + brief END AS disruption, round(seen / 90, 3) AS stage_coverage FROM co JOIN br USING (person, night)""",
    "prj3_night_dates": """SELECT event_id, CASE WHEN hour(ts) < 12 THEN ts::DATE - 1 ELSE ts::DATE END AS context_date, round(CASE WHEN h < 18 THEN h + 24 ELSE h END, 4) AS wake_hour, floor(epoch(e))::BIGINT AS end_second,
        round(d / coalesce(nullif(d + l + r, 0), 1), 4) AS deep, round(l / coalesce(nullif(d + l + r, 0), 1), 4) AS light, round(r / coalesce(nullif(d + l + r, 0), 1), 4) AS rem, 0.0::DOUBLE AS wake, 1.5::DOUBLE AS depth
        FROM (SELECT *, hour(e) + minute(e) / 60 + second(e) / 3600 AS h, event_id % 3 AS d, event_id % 4 AS l, event_id % 6 AS r FROM (SELECT *, CASE WHEN x <= ts THEN x + INTERVAL 1 DAY ELSE x END AS e FROM (SELECT *, ts + to_hours(event_id % 7 - 3) AS x FROM events)))""",
    "fn_labels": """SELECT event_id, concat(CASE WHEN (floor(t / 60) % 12) = 0 THEN 12 ELSE (floor(t / 60) % 12)::INT END, ':', lpad((t % 60)::INT::VARCHAR, 2, '0'), CASE WHEN floor(t / 60) < 12 THEN ' AM' ELSE ' PM' END) AS clock,
        concat(floor(r / 60)::INT, 'h ', lpad((r % 60)::INT::VARCHAR, 2, '0'), 'm') AS length, date_trunc('week', ts)::DATE AS monday, dayofweek(ts) IN (0, 6) AS rest_day,
        round(CASE WHEN h < 18 THEN h + 24 ELSE h END, 9) AS extended_hour, floor(-value / 7 + 0.5)::BIGINT AS half_up, (event_id % 100) * (event_id % 100 - 1) / 2 AS pairs, strftime(ts, '%b %-d') AS short_date
        FROM (SELECT *, floor(value / 7 * 60 + 0.5) AS r, floor(value / 7 * 60 + 0.5) % 1440 AS t, hour(ts) + minute(ts) / 60 + second(ts) / 3600 AS h FROM events)""",
    "src10_early_share": """SELECT event_id, round(CASE WHEN p = 0 THEN CASE WHEN d < 42 THEN 0.2 WHEN d < 92 THEN 0.82 ELSE 0.64 + sin(d / 11) * 0.08 END
        ELSE least(0.9, greatest(0.12, 0.42 + (p * 17 % 31) / 100 + sin(d / (13 + p % 5) + p) * 0.2 + CASE WHEN d > 82 THEN (p % 3 - 1) * 0.1 ELSE 0 END)) END, 9)::DOUBLE AS share FROM (SELECT event_id, event_id % 16 AS p, event_id % 181 AS d FROM events)""",
    "fn20_text_seed": """WITH RECURSIVE k AS (SELECT DISTINCT event_type FROM events), s AS (SELECT event_type, 0 AS i, 2166136261::HUGEINT AS a, xor(2166136261::BIGINT, 7919::BIGINT)::HUGEINT AS b FROM k
        UNION ALL SELECT event_type, i + 1, xor(a::BIGINT, ascii(substr(event_type, i + 1, 1))::BIGINT)::HUGEINT * 16777619 % 4294967296, xor(b::BIGINT, ascii(substr(event_type, i + 1, 1))::BIGINT)::HUGEINT * 16777619 % 4294967296 FROM s WHERE i < length(event_type))
        SELECT event_type, a::BIGINT AS seed, b::BIGINT AS salted FROM s WHERE i = length(event_type)""",
}
