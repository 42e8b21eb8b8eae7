"""Queries of insights, history, replay and landscapes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import asof, associations, cluster_quality, history, insights, pattern_rows, patterns, windows
from ..operators.windows import KEY
from ..scratch import kept
from ..sources import adapters
from .oracle import _distance, sql, upto
from .queries import _ASSOC, _patterns, _rounded, _rounds, _shared

_BPM = ("median_bpm", "low_bpm", "resting_bpm")

_NUMBERS = ["share", "contrast", "confidence", "strength"]
_COUNTS = "pattern_days, comparison_days, support, comparison_support, settling_difference, disruption_difference"


def ctx3_insights(spark: SparkSession, d: str) -> DataFrame:
    days, members = _shared(spark, d)
    return _rounded(insights.signals(windows.window_days(days), members).drop("late", "limited"), _NUMBERS)


#: Measures of a day that stand in for movement and noise.
_FURTHER = {"minutes": "exercise", "awake": "time awake"}


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, insights of with_calendar(), associations)."""
    days, members = _shared(spark, d)
    windowed = kept(windows.window_days(days), "windowed")
    found = kept(associations.associations(windowed, members), "associations")
    return members, insights.with_calendar(insights.signals(windowed, members, tuple(_FURTHER)), found), found


def ctx2_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Chosen insights with the flags of two further measures, the calendar's id, what is inferred, and their words."""
    own = _evidence(spark, d)[1]
    return own.select(*KEY, "cluster", "scope", *(f"high_{m}" for m in _FURTHER), "late", "limited", "calendar_id", "inferred", "adjusted_for", insights.statement(_FURTHER).alias("statement"))


def srt5_leads(spark: SparkSession, d: str) -> DataFrame:
    """What is said first of each pattern."""
    members, own, found = _evidence(spark, d)
    return insights.leads(members.where("membership = 'core'").select(*KEY, "cluster").distinct(), own, found, _FURTHER)


def prj18_bpm_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The heart rates of each pattern as words."""
    days, members = _shared(spark, d)
    rows = pattern_rows.rows(members, days, _patterns(spark, d, days, members))
    return rows.select(*KEY, "cluster", *(scalar.bpm_range(F.col(f"{m}_count"), F.col(f"{m}_low"), F.col(f"{m}_high")).alias(m) for m in _BPM))


def clu3_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Silhouettes of windows whose days are labelled by rule."""
    labelled = kept(patterns.rule_labels(windows.features(windows.window_days(adapters.days(spark, d)))), "labelled")
    return _rounded(cluster_quality.silhouette(labelled), ["silhouette"], 7)


def clu4_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two rules of each window: earlier or later to bed, shorter or longer asleep."""
    labelled = patterns.rule_labels(windows.features(windows.window_days(adapters.days(spark, d))))
    length = F.percentile("f2", 0.5).over(Window.partitionBy(*KEY))
    labelled = kept(labelled.withColumn("length", F.when(F.col("f2") < length, "shorter").otherwise("longer")).select(*KEY, "day", "cluster", "length"), "labelled")
    return _rounded(cluster_quality.agreement(labelled, "cluster", "length"), ["agreement"], 7)


def fn17_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """The value of each person's events of a day at 29 instants of it, between the event before and the one after."""
    e = spark.read.parquet(f"{d}/events.parquet")
    second = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp")))
    series = e.select((F.col("user_id") % 16).alias("person"), F.col("ts").cast("date").alias("day"), second.alias("at"), "value")
    asked = kept(adapters.nights(spark, d).select("person", F.col("night").alias("day"), F.explode(F.sequence(F.lit(0), F.lit(28))).alias("i")), "asked")
    points = asked.withColumn("at", F.col("i").cast("long") * 3085)
    return _rounded(asof.interpolated(points, series, ["person", "day"]).select("person", "day", F.col("i").cast("long").alias("i"), "value"), ["value"], 10)


def his1_history(spark: SparkSession, d: str) -> DataFrame:
    days, members = _shared(spark, d)
    found = history.history(_patterns(spark, d, days, members), history.anchors(days))
    return found.select("person", "selected_end", "k", "window_end", "period_start", "cluster", "rank", "status", "emergence")


def rpl1_windows(spark: SparkSession, d: str) -> DataFrame:
    days, members = _shared(spark, d)
    return history.replay_windows(_patterns(spark, d, days, members), members, history.replay_ends(days))


_SIGNALS = """
ob AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY person, window_end) AS seen FROM wd WHERE valid AND settling IS NOT NULL AND disruption IS NOT NULL) WHERE seen >= 10),
cr AS (SELECT person, window_end, cluster, day FROM me WHERE membership = 'core'),
cp AS (SELECT DISTINCT person, window_end, cluster FROM cr),
sd AS (SELECT ob.person, ob.window_end, cp.cluster, settling, disruption, cr.day IS NOT NULL AS own, unnest(CASE WHEN dayofweek(ob.day) IN (0, 6) THEN ['sleep_day'] ELSE ['sleep_day', 'work'] END) AS scope
  FROM ob JOIN cp USING (person, window_end) LEFT JOIN cr ON cp.person = cr.person AND cp.window_end = cr.window_end AND cp.cluster = cr.cluster AND ob.day = cr.day),
md AS (SELECT person, window_end, cluster, scope, median(settling) FILTER (WHERE own) AS os, median(settling) FILTER (WHERE NOT own) AS cs, median(disruption) FILTER (WHERE own) AS od, median(disruption) FILTER (WHERE NOT own) AS cd FROM sd GROUP BY ALL),
jo AS (SELECT *, coalesce(settling >= least(90, cs + 5) AND disruption >= cd + 1, false) AS joint FROM sd JOIN md USING (person, window_end, cluster, scope)),
cn AS (SELECT person, window_end, cluster, scope, count_if(own)::BIGINT AS pattern_days, count_if(NOT own)::BIGINT AS comparison_days, count_if(own AND joint)::BIGINT AS support, count_if(NOT own AND joint)::BIGINT AS comparison_support,
  floor(any_value(os - cs) + 0.5)::BIGINT AS settling_difference, floor(any_value(od - cd) + 0.5)::BIGINT AS disruption_difference FROM jo GROUP BY ALL),
c1 AS (SELECT *, CASE WHEN pattern_days > 0 THEN support / pattern_days END AS share, CASE WHEN pattern_days > 0 THEN support / pattern_days END - CASE WHEN comparison_days > 0 THEN comparison_support / comparison_days END AS contrast FROM cn),
c2 AS (SELECT *, CASE WHEN contrast IS NOT NULL THEN least(1, greatest(0, contrast / 0.6)) ELSE 0 END AS strength,
  least(1, greatest(0, (1 - exp(-support / 4)) * (1 - exp(-comparison_days / 5)) * (0.58 + 0.42 * coalesce(least(1, greatest(0, contrast)), 0)))) AS confidence FROM c1),
c3 AS (SELECT *, coalesce(pattern_days >= 5 AND comparison_days >= 3 AND support >= 3 AND share >= CASE WHEN scope = 'work' THEN 0.5 ELSE 0.45 END AND contrast >= 0.15 AND confidence >= 0.28 AND settling_difference >= 5 AND disruption_difference >= 1, false) AS shown FROM c2),
ins AS (SELECT *, shown AND row_number() OVER (PARTITION BY person, window_end, cluster ORDER BY shown DESC, scope DESC) = 1 AS chosen FROM c3)"""

_REPLAY = """
nu AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY day) AS pos, max(CASE WHEN valid THEN day END) OVER (PARTITION BY person) AS last_valid FROM days),
re AS (SELECT person, day AS window_end FROM nu WHERE (pos >= 42 AND (pos - 42) % 14 = 0 AND day <= last_valid) OR day = last_valid),
wm AS (SELECT person, window_end, count(*) AS valid_days, count_if(membership = 'core')::BIGINT AS core, count_if(membership = 'boundary')::BIGINT AS boundary, count_if(membership = 'unassigned')::BIGINT AS unassigned FROM me JOIN re USING (person, window_end) GROUP BY ALL),
wp AS (SELECT person, window_end, count(*) AS candidates, count_if(shown)::BIGINT AS visible FROM pb JOIN re USING (person, window_end) GROUP BY ALL)"""

# The signals again with two further measures; names of shared CTEs that clash with those of the associations are set apart.
_SIGNALS_TOO = _SIGNALS.replace("cp AS (", "cp_s AS (").replace("JOIN cp USING", "JOIN cp_s USING").replace("cp.", "cp_s.").replace("sd AS (", "sd_s AS (").replace("FROM sd ", "FROM sd_s ")
_CLAUSES = ", ".join(f"coalesce(any_value(n_{m}) >= 8 AND count(CASE WHEN own AND joint THEN {m} END) >= greatest(3, ceil(count_if(own AND joint) * 0.6)) AND median({m}) FILTER (WHERE own AND joint) >= any_value(q_{m}), false) AS high_{m}" for m in _FURTHER)
_CHOSEN = f"""bars AS (SELECT person, window_end, {", ".join(f"count({m}) AS n_{m}, quantile_cont({m}, 0.6) AS q_{m}" for m in _FURTHER)} FROM ob GROUP BY ALL),
sx AS (SELECT ob.person, ob.window_end, cp_s.cluster, settling, disruption, {", ".join(_FURTHER)}, cr.day IS NOT NULL AS own, unnest(CASE WHEN dayofweek(ob.day) IN (0, 6) THEN ['sleep_day'] ELSE ['sleep_day', 'work'] END) AS scope
  FROM ob JOIN cp_s USING (person, window_end) LEFT JOIN cr ON cp_s.person = cr.person AND cp_s.window_end = cr.window_end AND cp_s.cluster = cr.cluster AND ob.day = cr.day),
jx AS (SELECT *, coalesce(settling >= least(90, cs + 5) AND disruption >= cd + 1, false) AS joint FROM sx JOIN md USING (person, window_end, cluster, scope) JOIN bars USING (person, window_end)),
hi AS (SELECT person, window_end, cluster, scope, coalesce(any_value(os) >= 90, false) AS late, {_CLAUSES} FROM jx GROUP BY ALL),
cal AS (SELECT person, window_end, cluster, definition AS calendar_id FROM ac WHERE shown AND source = 'calendar'),
ev2 AS (SELECT ins.*, hi.* EXCLUDE (person, window_end, cluster, scope), calendar_id, NOT ({" AND ".join(f"high_{m}" for m in _FURTHER)}) AS limited, scope = 'work' OR calendar_id IS NOT NULL AS inferred, CASE WHEN scope = 'work' THEN 'inferred_rest_day' END AS adjusted_for,
  concat(support, ' of ', pattern_days, CASE WHEN scope = 'work' THEN ' inferred work nights' ELSE ' nights' END, ' show both signals; the heart settles ', settling_difference, CASE WHEN late THEN ' minutes or more' ELSE ' minutes' END, ' later, with ', disruption_difference,
    CASE WHEN disruption_difference = 1 THEN ' interruption' ELSE ' interruptions' END, ' more.', {", ".join(f"CASE WHEN high_{m} THEN ' {words} is high as well.' ELSE '' END" for m, words in _FURTHER.items())},
    CASE WHEN calendar_id = 'before_inferred_work_day' THEN ' Mostly before inferred work days.' WHEN calendar_id IS NOT NULL THEN ' Mostly before inferred rest days.' ELSE '' END) AS statement
  FROM ins JOIN hi USING (person, window_end, cluster, scope) LEFT JOIN cal USING (person, window_end, cluster) WHERE chosen)"""
_EVIDENCE = (*upto("members"), _ASSOC, _SIGNALS_TOO, _CHOSEN)
_LEADS = """ld AS (SELECT person, window_end, cluster, concat('signals_', scope) AS id, 'signals' AS source, statement, 1.0 AS weight, 0 AS kind FROM ev2 UNION ALL
SELECT person, window_end, cluster, definition, source, concat('More often with ', replace(definition, '_', ' '), ': ', a, ' of ', a + b, ' nights, else ', c, ' of ', comparison, '.'), round(confidence * strength, 9), 1 FROM ac WHERE shown),
le AS (SELECT * FROM ld QUALIFY row_number() OVER (PARTITION BY person, window_end, cluster ORDER BY kind, weight DESC, id) = 1)"""
_whole = lambda m, e: f"floor(floor(round({m}_{e} * 10, 6) + 0.5) / 10 + 0.5)::BIGINT"
_BPM_SQL = ", ".join(f"CASE WHEN {m}_count > 0 THEN concat(CASE WHEN {_whole(m, 'lo')} = {_whole(m, 'hi')} THEN {_whole(m, 'lo')}::VARCHAR ELSE concat({_whole(m, 'lo')}, '–', {_whole(m, 'hi')}) END, ' bpm') ELSE 'not enough data' END AS {m}" for m in _BPM)
_PAIRED = f"""pr AS (SELECT a.person, a.window_end, a.day, a.cluster AS own, b.cluster AS other, avg({_distance("a.", "b.")}) AS mean FROM lb a JOIN lb b ON a.person = b.person AND a.window_end = b.window_end AND a.day <> b.day GROUP BY ALL),
si AS (SELECT person, window_end, day, max(CASE WHEN own = other THEN mean END) AS within, min(CASE WHEN own <> other THEN mean END) AS nearest FROM pr GROUP BY ALL),
sl AS (SELECT lb.person, lb.window_end, count(*) AS days, count(DISTINCT cluster) AS clusters, avg(CASE WHEN within IS NULL OR greatest(within, nearest) = 0 THEN 0.0 ELSE (nearest - within) / greatest(within, nearest) END) AS score FROM lb LEFT JOIN si USING (person, window_end, day) GROUP BY ALL)"""
_PAIRS = lambda n: f"({n} * ({n} - 1) / 2)"
_RAND = f"""l2 AS (SELECT person, window_end, cluster AS a, CASE WHEN f2 < median(f2) OVER (PARTITION BY person, window_end) THEN 0 ELSE 1 END AS b FROM lb),
ce2 AS (SELECT person, window_end, a, b, count(*) AS n FROM l2 GROUP BY ALL),
ra AS (SELECT person, window_end, sum({_PAIRS("n")}) AS s FROM (SELECT person, window_end, a, sum(n) AS n FROM ce2 GROUP BY ALL) GROUP BY ALL),
rb AS (SELECT person, window_end, sum({_PAIRS("n")}) AS s FROM (SELECT person, window_end, b, sum(n) AS n FROM ce2 GROUP BY ALL) GROUP BY ALL),
rn AS (SELECT person, window_end, sum(n)::BIGINT AS n, sum({_PAIRS("n")}) AS both_same FROM ce2 GROUP BY ALL),
rx AS (SELECT rn.*, (ra.s + rb.s) / 2 AS most, CASE WHEN n > 1 THEN ra.s * rb.s / {_PAIRS("n")} ELSE 0 END AS expected FROM rn JOIN ra USING (person, window_end) JOIN rb USING (person, window_end))"""
_AT = """es AS (SELECT user_id % 16 AS person, cast(ts AS date) AS day, floor(epoch(ts))::BIGINT - floor(epoch(cast(cast(ts AS date) AS timestamp)))::BIGINT AS sec, value FROM events WHERE value IS NOT NULL),
ins2 AS (SELECT person, day, i, i * 3085 AS sec FROM (SELECT DISTINCT person, day FROM es), (SELECT unnest(range(0, 29)) AS i)),
nb2 AS (SELECT q.person, q.day, q.i, q.sec, arg_max(s.value, (s.sec, s.value)) FILTER (WHERE s.sec < q.sec) AS lv, max(s.sec) FILTER (WHERE s.sec < q.sec) AS ls, arg_min(s.value, (s.sec, s.value)) FILTER (WHERE s.sec >= q.sec) AS rv, min(s.sec) FILTER (WHERE s.sec >= q.sec) AS rs
  FROM ins2 q JOIN es s ON s.person = q.person AND s.day = q.day GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (ctx3_insights, ctx2_evidence, srt5_leads, prj18_bpm_ranges, clu3_silhouette, clu4_agreement, fn17_interpolated, his1_history, rpl1_windows)}
ORACLES = {
    "ctx3_insights": sql(f"SELECT person, window_end, cluster, scope, {_COUNTS}, shown, chosen, {_rounds(_NUMBERS)} FROM ins", *upto("members"), _SIGNALS),
    "ctx2_evidence": sql(f"SELECT person, window_end, cluster, scope, {', '.join(f'high_{m}' for m in _FURTHER)}, late, limited, calendar_id, inferred, adjusted_for, statement FROM ev2", *_EVIDENCE),
    "srt5_leads": sql("SELECT cp.person, cp.window_end, cp.cluster, id, source, statement FROM cp LEFT JOIN le USING (person, window_end, cluster)", *_EVIDENCE, _LEADS),
    "clu3_silhouette": sql("SELECT person, window_end, days, clusters, CASE WHEN clusters > 1 THEN round(score, 7) END AS silhouette FROM sl", *upto("labelled"), _PAIRED),
    "clu4_agreement": sql("SELECT person, window_end, n, round(CASE WHEN most = expected THEN 1 ELSE (both_same - expected) / (most - expected) END, 7)::DOUBLE AS agreement FROM rx", *upto("labelled"), _RAND),
    "fn17_interpolated": sql("SELECT person, day, i, round(CASE WHEN lv IS NULL THEN rv WHEN rv IS NULL THEN lv ELSE lv * (1 - (sec - ls) / (rs - ls)) + rv * ((sec - ls) / (rs - ls)) END, 10) AS value FROM nb2", _AT),
    "his1_history": sql("""SELECT person, selected_end, k, window_end, greatest(first_day, window_end - 41) AS period_start, cluster, rank, status, emergence
        FROM (SELECT d.person, d.day AS selected_end, k::BIGINT AS k, (d.day - 42 * k::INT) AS window_end, first_day FROM days d JOIN (SELECT person, min(day) AS first_day FROM days GROUP BY person) f ON d.person = f.person, (SELECT unnest([1, 2, 3]) AS k)) a JOIN pb USING (person, window_end) WHERE shown AND window_end >= first_day""", *upto("published")),
    "rpl1_windows": sql("SELECT person, window_end, valid_days, core, boundary, unassigned, coalesce(candidates, 0) AS candidates, coalesce(visible, 0) AS visible, coalesce(candidates, 0) - coalesce(visible, 0) AS hidden FROM wm LEFT JOIN wp USING (person, window_end)", *upto("published"), _REPLAY),
}
