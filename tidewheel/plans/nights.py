"""Queries of nights against patterns, of pattern rows and of display series, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import display, history, night_fit, pattern_rows
from ..operators.patterns import window_counts
from ..operators.windows import KEY
from ..scratch import kept, scratch_dir
from ..sources import adapters
from ..streaming import nightly
from .oracle import sql, upto
from .queries import _patterns, _rounded, _rounds, _shared

#: Stand-in profiles of 29 depths, from the day's number.
PROFILE = "transform(sequence(0, 28), i -> ((unix_date(day) * 7 + i * i * (1 + person)) % 31) / 10e0)"
_DIMENSIONS = ["timing", "duration_fit", "landscape", "composition", "physiology", "early_night"]
_BAND = ["low", "high"]


def _profiled(days: DataFrame) -> DataFrame:
    return days.withColumn("profile", F.when(F.col("valid"), F.expr(PROFILE)))


def _compared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(days with profiles, patterns, references, landscape)."""
    days, members = _shared(spark, d)
    days = _profiled(days)
    shapes = night_fit.landscape(days.where("valid").select("person", "day", "profile"), members)
    return days, _patterns(spark, d, days, members), night_fit.references(days, members), shapes


def res1_landscape(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_compared(spark, d)[3].select(*KEY, "day", "cluster", "landscape"), ["landscape"], 7)


def res4_fits(spark: SparkSession, d: str) -> DataFrame:
    got = night_fit.fits(*_compared(spark, d)).drop("quality", "emergence", "rank", "cores")
    return _rounded(got, [*_DIMENSIONS, "coverage", "raw", "reliability"], 7)


def res5_resonance(spark: SparkSession, d: str) -> DataFrame:
    return night_fit.resonance(*_compared(spark, d))


def srt6_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The three best patterns of each night."""
    return night_fit.ranked(night_fit.fits(*_compared(spark, d))).where("place <= 3").select("person", "day", "place", "cluster", "score")


def str1_streamed_fits(spark: SparkSession, d: str) -> DataFrame:
    """Fits of all nights as a stream gives them that reads days and snapshots file by file until both are read."""
    days, members = _shared(spark, d)
    published, days = _patterns(spark, d, days, members), _profiled(days)
    shared = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = {"nights": days, "snapshots": nightly.snapshots(days, members, published)}
    for name, rows in source.items():
        rows.write.parquet(f"{shared}/{name}")
    streams = [spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{shared}/{name}") for name, rows in source.items()]
    out = nightly.scores(*streams).withColumn("person", F.col("person").cast("long")).drop("quality", "emergence", "rank", "cores")
    with nightly.keyed_state(spark):
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{shared}/checkpoint").option("path", f"{shared}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return _rounded(spark.read.schema(out.schema).parquet(f"{shared}/out"), [*_DIMENSIONS, "coverage", "raw", "reliability"], 7)


def agg32_past_nights(spark: SparkSession, d: str) -> DataFrame:
    return adapters.days(spark, d).select("person", "day", night_fit.past_nights().alias("past_nights"))


_ROW_NUMBERS = ["nap_share", "band_left", "band_width", *(f"{s}_{p}" for s in pattern_rows.STAGES for p in ("p15", "p50", "p85")), *(f"{x}_{e}" for x in ("start", "wake", "duration") for e in ("low", "high"))]


def prj10_pattern_rows(spark: SparkSession, d: str) -> DataFrame:
    days, members = _shared(spark, d)
    return _rounded(pattern_rows.rows(members, days, _patterns(spark, d, days, members)), _ROW_NUMBERS)


def srt2_evidence(spark: SparkSession, d: str) -> DataFrame:
    texts = {c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in ("core", "boundary", "every")}
    return pattern_rows.evidence(_shared(spark, d)[1]).withColumns(texts)


def set1_variation(spark: SparkSession, d: str) -> DataFrame:
    return pattern_rows.variation(_shared(spark, d)[1])


def srt4_history(spark: SparkSession, d: str) -> DataFrame:
    """History rows with their place: latest period first, then by emergence and bed time."""
    from pyspark.sql import Window

    days, members = _shared(spark, d)
    rows = history.history(_patterns(spark, d, days, members), history.anchors(days))
    order = Window.partitionBy("person", "selected_end").orderBy(F.desc("window_end"), F.desc("emergence"), "rank")
    return rows.select("person", "selected_end", "window_end", "cluster", "emergence", F.row_number().over(order).cast("long").alias("place"))


def _latest(days: DataFrame) -> DataFrame:
    """(person, window_end): windows that end with the latest valid day, as a chart opens."""
    return days.where("valid").groupBy("person").agg(F.max("day").alias("window_end"))


def _cores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    days, members = _shared(spark, d)
    days = kept(_profiled(days), "days")
    return days, members, kept(display.core_nights(members, days, _latest(days)), "cores")


def viz1_stage_band(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(display.stage_band(_cores(spark, d)[2]), ["hour", *_BAND], 7)


def viz2_pattern_density(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(display.pattern_density(_cores(spark, d)[2]), ["hour", "level", "density"], 7)


def viz4_landscape_density(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(display.landscape_density(_cores(spark, d)[2]), ["level", "density"], 7)


def _series(spark: SparkSession, d: str) -> DataFrame:
    """The latest night of each person against the patterns of its window."""
    days, _, core = _cores(spark, d)
    nights = core.select(*KEY, "cluster").distinct().join(days.select("person", F.col("day").alias("window_end"), "bed", "wake", "profile"), KEY)
    return display.landscape_series(nights.withColumn("day", F.col("window_end")), core)


def viz3_landscape(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_series(spark, d).drop("bed", "wake"), ["actual", *_BAND], 7)


def viz5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return display.overlaps(_series(spark, d))


def viz6_calendar(spark: SparkSession, d: str) -> DataFrame:
    days, members = _shared(spark, d)
    return display.coverage_calendar(_patterns(spark, d, days, members).where("shown"), members, days, window_counts(days))


def viz8_overview(spark: SparkSession, d: str) -> DataFrame:
    days, members = _shared(spark, d)
    return display.overview(window_counts(days), members, _patterns(spark, d, days, members), days)


_DAILY = ["asleep", "in_bed", "deep_hours", "light_hours", "rem_hours", "left", "width"]


def prj14_daily(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import adapters

    return _rounded(display.daily(adapters.days(spark, d)), _DAILY)


def _close(m: str, floor: float) -> str:
    return f"exp(-0.5 * (abs(dd.{m} - {m}_50) / greatest({floor}, ({m}_85 - {m}_15) / 2)) ** 2)"


def _avg(*xs: str) -> str:
    return f"list_avg([{', '.join(xs)}])"


_LEVEL = "((((day - DATE '1970-01-01') * 7 + {k} * {k} * (1 + person)) % 31) / 10.0)::DOUBLE"
_SHAPES = f"""
pts AS (SELECT i, floor(i * 28 / 35)::BIGINT AS lo, least(28, floor(i * 28 / 35)::BIGINT + 1) AS hi, i * 28 / 35 - floor(i * 28 / 35) AS mix FROM (SELECT unnest(range(0, 36)) AS i)),
rp AS (SELECT person, day, i, {_LEVEL.format(k='lo')} + ({_LEVEL.format(k='hi')} - {_LEVEL.format(k='lo')}) * mix AS v FROM days, pts WHERE valid),
rm AS (SELECT me.person, me.window_end, me.cluster, i, median(v) AS m FROM me JOIN rp ON me.person = rp.person AND me.day = rp.day WHERE membership = 'core' GROUP BY ALL),
gp2 AS (SELECT rp.person, rm.window_end, rp.day, rm.cluster, rp.i, v - m AS g FROM rp JOIN rm ON rp.person = rm.person AND rp.day - 1 = rm.window_end AND rp.i = rm.i),
gl AS (SELECT *, g - lag(g) OVER (PARTITION BY person, window_end, day, cluster ORDER BY i) AS c FROM gp2)"""

_LANDS = "la AS (SELECT person, window_end, day, cluster, least(1, greatest(0, 1 - (avg(abs(g) / 3) * 0.78 + avg(abs(c) / 3) * 0.22))) AS landscape FROM gl GROUP BY ALL)"
_SP = night_fit.SPREADS
_QS = ", ".join(f"quantile_cont({m}, {q / 100}) AS {m}_{q}" for m in _SP for q in (15, 50, 85))
_REFS = f"""rf AS (SELECT core.person, core.window_end, core.cluster, count(*) AS cores, {_QS}, {", ".join(f"median({s}) AS s_{s}" for s in night_fit.STAGES)}
  FROM days JOIN (SELECT person, window_end, cluster, day FROM me WHERE membership = 'core') core ON days.person = core.person AND days.day = core.day GROUP BY ALL)"""
_COMP = _avg(*(f"least(1, greatest(0, 1 - abs(dd.{s} - s_{s}) / 0.18))" for s in night_fit.STAGES))
_W = night_fit.WEIGHTS
_USED = " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE {w} END" for m, w in _W.items())
_GOT = " + ".join(f"coalesce({m} * {w}, 0)" for m, w in _W.items())
_FITS = f"""f0 AS (SELECT dd.person, dd.day - 1 AS window_end, dd.day, dd.quality, rf.cluster, pb.confidence, pb.emergence, pb.rank, cores, landscape,
  {_avg(_close('bed', _SP['bed']), _close('wake', _SP['wake']))} AS timing, {_close('duration', _SP['duration'])} AS duration_fit, {_COMP} AS composition,
  {_avg(*(_close(m, _SP[m]) for m in ('median_bpm', 'low_bpm', 'resting_bpm', 'settling')))} AS physiology, {_close('disruption', _SP['disruption'])} AS early_night
  FROM days dd JOIN rf ON dd.person = rf.person AND dd.day - 1 = rf.window_end JOIN pb ON rf.person = pb.person AND rf.window_end = pb.window_end AND rf.cluster = pb.cluster
  LEFT JOIN la ON la.person = dd.person AND la.day = dd.day AND la.cluster = rf.cluster WHERE dd.valid AND pb.shown),
f1 AS (SELECT *, ({_USED})::DOUBLE AS coverage, {_GOT} AS got FROM f0),
f2 AS (SELECT *, got / coverage * 100 AS raw, 0.45 * coverage + 0.55 * (0.65 * confidence / 100 + 0.35 * least(1, cores / 12)) AS reliability FROM f1),
fits AS (SELECT *, floor(least(100, greatest(0, 50 + (raw - 50) * (0.78 + 0.22 * reliability))) + 0.5)::BIGINT AS score FROM f2),
fr AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second, lead(cluster) OVER w AS other FROM fits WINDOW w AS (PARTITION BY person, day ORDER BY score DESC, emergence DESC, rank))"""
_TOP = f"greatest({', '.join(_W)})"
_BEST = f"""b0 AS (SELECT *, coalesce(score - second, 100) AS margin FROM fr WHERE place = 1),
b1 AS (SELECT *, CASE WHEN score < 58 THEN 'different' WHEN coalesce(second, 0) >= 58 AND margin < 6 THEN 'mixed' ELSE 'matched' END AS state FROM b0),
b2 AS (SELECT *, CASE WHEN state = 'different' THEN concat('closest_', CASE {_TOP} {' '.join(f"WHEN {m} THEN '{m}'" for m in _W)} ELSE 'few' END) WHEN state = 'mixed' THEN 'between'
   WHEN coalesce(timing, 0) >= 0.78 AND coalesce(landscape, 0) >= 0.72 THEN 'timing_and_landscape' WHEN coalesce(physiology, 0) >= 0.74 AND coalesce(landscape, 0) < 0.68 THEN 'physiology'
   WHEN coalesce(timing, 0) >= coalesce(landscape, 0) THEN 'timing' ELSE 'landscape' END AS reason,
  CASE WHEN state = 'mixed' THEN 'between' WHEN score >= 82 THEN 'strong' WHEN score >= 70 THEN 'clear' WHEN score >= 58 THEN 'partial' ELSE 'weak' END AS label,
  floor(0.6 * confidence + 0.25 * floor(100 * reliability + 0.5) + 15 * coalesce(quality, 0.8) + 0.5)::BIGINT AS sure FROM b1),
re AS (SELECT d.person, d.day, CASE WHEN NOT d.valid THEN 'unavailable' ELSE coalesce(state, 'learning') END AS state, coalesce(count_if(d.valid) OVER (PARTITION BY d.person ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS past_nights,
  b2.cluster, CASE WHEN state = 'mixed' THEN other END AS second_cluster, score, margin, label, sure, reason, cores AS evidence, floor(100 * coverage + 0.5)::BIGINT AS signal_coverage FROM days d LEFT JOIN b2 ON d.person = b2.person AND d.day = b2.day)"""
_NIGHTS = (*upto("published"), _SHAPES, _LANDS, _REFS, _FITS)

_P = "person, window_end, cluster"
_MS = pattern_rows.METRICS


def _q(m: str, q: float) -> str:
    return f"quantile_cont({m}, {q}) FILTER (WHERE shape)"


def _clock(h: str) -> str:
    t = f"(floor(({h}) * 60 + 0.5) % 1440)"
    return f"concat(CASE WHEN (floor({t} / 60) % 12) = 0 THEN 12 ELSE (floor({t} / 60) % 12)::INT END, ':', lpad(({t} % 60)::INT::VARCHAR, 2, '0'), CASE WHEN floor({t} / 60) < 12 THEN ' AM' ELSE ' PM' END)"


def _length(h: str) -> str:
    return f"concat(floor(floor(({h}) * 60 + 0.5) / 60)::INT, 'h ', lpad((floor(({h}) * 60 + 0.5) % 60)::INT::VARCHAR, 2, '0'), 'm')"


_SHAPE_COLUMNS = ", ".join(f"dd.{c}" for c in ("bed", "wake", "duration", "nap", *_MS, *pattern_rows.STAGES))
_ROWS = f"""ow AS (SELECT me.person, me.window_end, me.cluster, me.day, membership, {_SHAPE_COLUMNS}, count_if(membership = 'core') OVER (PARTITION BY me.person, me.window_end, me.cluster) AS cores,
  median(dd.duration) OVER (PARTITION BY me.person, me.window_end) AS usual FROM me JOIN days dd ON me.person = dd.person AND me.day = dd.day WHERE membership <> 'unassigned'),
os AS (SELECT *, cores < 2 OR membership = 'core' AS shape FROM ow),
pr AS (SELECT {_P}, median(bed) AS usual_bed, median(duration) AS own_duration, any_value(usual) AS usual, count_if(shape) AS n,
  {', '.join(f'{_q(m, q)} AS {m}_{n}' for m in ('bed', 'wake', 'duration', *_MS) for q, n in ((0.2, 'lo'), (0.5, 'mid'), (0.8, 'hi')))},
  {', '.join(f'count({m}) FILTER (WHERE shape) AS {m}_count' for m in _MS)}, {', '.join(f'{_q(s, q / 100)} AS {s}_p{q}' for s in pattern_rows.STAGES for q in (15, 50, 85))},
  (count_if(shape AND coalesce(nap, false)))::BIGINT AS naps, count(DISTINCT CASE WHEN shape AND nap THEN date_trunc('week', day) END) AS nap_weeks FROM os GROUP BY {_P}),
pn AS (SELECT pr.*, pb.rank, pb.emergence, pb.confidence, pb.status, pb.shown, pb.core_days, count(*) OVER (PARTITION BY pr.person, pr.window_end) AS patterns, row_number() OVER (PARTITION BY pr.person, pr.window_end ORDER BY pb.emergence DESC, pb.rank) AS place FROM pr JOIN pb USING ({_P})),
pt2 AS (SELECT *, CASE WHEN patterns = 1 THEN CASE WHEN usual_bed < 24.35 THEN 'earlier' ELSE 'later' END WHEN rank = 1 THEN 'earlier' WHEN rank = patterns THEN 'later' ELSE 'middle' END AS timing,
  CASE WHEN own_duration - usual >= 0.18 THEN 'longer' WHEN own_duration - usual <= -0.18 THEN 'shorter' ELSE 'steady' END AS length FROM pn)"""
_ROWS_OUT = ", ".join(
    [_P, "CASE timing WHEN 'earlier' THEN 'earlier-sleep' WHEN 'later' THEN 'later-longer-sleep' ELSE concat('middle-sleep-', rank - 1) END AS pattern_id", "timing", "length", "rank", "place", "emergence", "confidence", "status", "shown", "core_days"]
    + [f"concat({label(f'{m}_lo - {pad}')}, '–', {label(f'{m}_hi + {pad}')}) AS {n}_range" for m, n, label, pad in (("bed", "start", _clock, 0.03), ("wake", "wake", _clock, 0.03), ("duration", "duration", _length, 0))]
    + [f"round({m}_{e}, 9) AS {n}_{x}" for m, n in (("bed", "start"), ("wake", "wake"), ("duration", "duration")) for e, x in (("lo", "low"), ("hi", "high"))]
    + [f"{m}_count" for m in _MS] + [f"floor(round({m}_{e} * 10, 6) + 0.5) / 10 AS {m}_{x}" for m in _MS for e, x in (("lo", "low"), ("mid", "typical"), ("hi", "high"))]
    + [f"round({s}_p{q}, 9) AS {s}_p{q}" for s in pattern_rows.STAGES for q in (15, 50, 85)]
    + [f"greatest({', '.join(f'{m}_count' for m in _MS[:4])}) AS physiology_nights", "naps", "round(naps / n, 9) AS nap_share", "nap_weeks", "naps >= greatest(3, ceil(n * 0.2)) AND naps / n >= 0.2 AND nap_weeks >= 2 AS nap_defining"]
    + ["round((bed_lo - 18) / 24 * 100, 9) AS band_left", "round((wake_hi - bed_lo) / 24 * 100, 9) AS band_width"]
)

_LV = "((((day - DATE '1970-01-01') * 7 + {k} * {k} * (1 + person)) % 31) / 10.0)::DOUBLE"


def _depth(hour: str) -> str:
    x = f"(least(1, greatest(0, ({hour} - bed) / greatest(0.01, wake - bed))) * 28)"
    lo, hi = f"floor({x})::BIGINT", f"least(28, floor({x})::BIGINT + 1)"
    return f"CASE WHEN {hour} >= bed AND {hour} <= wake THEN {_LV.format(k=lo)} * (1 - ({x} - floor({x}))) + {_LV.format(k=hi)} * ({x} - floor({x})) ELSE 0 END"


def _smooth(v: str, keys: str, radius: int) -> str:
    import math

    sigma = max(1.0, radius * 0.62)
    parts = [(math.exp(-(o * o) / (2 * sigma * sigma)), f"lead({v}, {o})" if o >= 0 else f"lag({v}, {-o})") for o in range(-radius, radius + 1)]
    over = f"OVER (PARTITION BY {keys} ORDER BY hour)"
    return "(" + " + ".join(f"coalesce({f} {over} * {w}, 0)" for w, f in parts) + ") / greatest(1e-6, " + " + ".join(f"CASE WHEN {f} {over} IS NULL THEN 0 ELSE {w} END" for w, f in parts) + ")"


_CORES = f"""le AS (SELECT person, max(day) AS window_end FROM days WHERE valid GROUP BY person),
cn AS (SELECT me.person, me.window_end, me.cluster, me.day, dd.bed, dd.wake FROM me JOIN le USING (person, window_end) JOIN days dd ON me.person = dd.person AND me.day = dd.day WHERE membership = 'core')"""
_SAMPLED = f"""he AS (SELECT {_P}, quantile_cont(bed, 0.03) AS lo, quantile_cont(wake, 0.97) AS hi FROM cn GROUP BY {_P}),
hh AS (SELECT {_P}, lo AS hour FROM he UNION ALL SELECT {_P}, hi FROM he UNION ALL SELECT {_P}, h FROM (SELECT *, unnest(range(ceil(lo * 8)::BIGINT, ceil(hi * 8)::BIGINT)) / 8 AS h FROM he) WHERE h > lo + 1e-6),
sa AS (SELECT {_P}, hour, day, {_depth('hour')} AS depth FROM hh JOIN cn USING ({_P}))"""
_BANDS = f"""s0 AS (SELECT {_P}, hour, quantile_cont(depth, 0.15) AS low, quantile_cont(depth, 0.85) AS high FROM sa GROUP BY {_P}, hour),
s1 AS (SELECT {_P}, hour, {_smooth('low', _P, 4)} AS low, {_smooth('high', _P, 4)} AS high FROM s0),
s2 AS (SELECT {_P}, hour, {_smooth('low', _P, 3)} AS low, {_smooth('high', _P, 3)} AS high FROM s1)"""
_GRID = f"""gd AS (SELECT i * 0.125::DOUBLE + 18 AS hour FROM (SELECT unnest(range(0, 193)) AS i)),
cg AS (SELECT {_P}, day, hour, {_depth('hour')} AS depth FROM cn, gd)"""
_LEVELS = "lv AS (SELECT i * 3.0::DOUBLE / 12 AS level FROM (SELECT unnest(range(0, 13)) AS i))"
_SERIES_SQL = f"""y0 AS (SELECT DISTINCT cn.person, cn.window_end, cn.cluster, cn.window_end AS day, dd.bed, dd.wake FROM cn JOIN days dd ON cn.person = dd.person AND cn.window_end = dd.day),
y1 AS (SELECT {_P}, day, bed, wake, hour, {_depth('hour')} AS actual FROM y0, gd),
y2 AS (SELECT * EXCLUDE (actual), {_smooth('actual', 'person, day, cluster', 3)} AS actual FROM y1), y3 AS (SELECT * EXCLUDE (actual), {_smooth('actual', 'person, day, cluster', 2)} AS actual FROM y2),
y4 AS (SELECT {_P}, hour, quantile_cont(depth, 0.15) AS low, quantile_cont(depth, 0.85) AS high FROM cg GROUP BY {_P}, hour),
y5 AS (SELECT {_P}, hour, {_smooth('low', _P, 3)} AS low, {_smooth('high', _P, 3)} AS high FROM y4),
ls AS (SELECT y3.person, y3.day, y3.cluster, y3.hour, actual, low, high, bed, wake FROM y3 JOIN y5 ON y3.person = y5.person AND y3.window_end = y5.window_end AND y3.cluster = y5.cluster AND y3.hour = y5.hour)"""
_TO_MEMBERS = (*upto("members"), _CORES)

QUERIES = {f.__name__: f for f in (
    res1_landscape, res4_fits, res5_resonance, srt6_top_candidates, str1_streamed_fits, agg32_past_nights, prj10_pattern_rows, srt2_evidence, set1_variation, srt4_history,
    viz1_stage_band, viz2_pattern_density, viz3_landscape, viz4_landscape_density, viz5_overlaps, viz6_calendar, viz8_overview, prj14_daily,
)}
ORACLES = {
    "res1_landscape": sql("SELECT person, window_end, day, cluster, round(landscape, 7) AS landscape FROM la", *upto("members"), _SHAPES, _LANDS),
    "res4_fits": sql("SELECT person, window_end, day, cluster, confidence, score, " + _rounds([*_DIMENSIONS, "coverage", "raw", "reliability"], 7) + " FROM fits", *_NIGHTS),
    "str1_streamed_fits": sql("SELECT person, window_end, day, cluster, confidence, score, " + _rounds([*_DIMENSIONS, "coverage", "raw", "reliability"], 7) + " FROM fits", *_NIGHTS),
    "res5_resonance": sql("SELECT * FROM re", *_NIGHTS, _BEST),
    "srt6_top_candidates": sql("SELECT person, day, place, cluster, score FROM fr WHERE place <= 3", *_NIGHTS),
    "agg32_past_nights": sql("SELECT person, day, coalesce(count_if(valid) OVER (PARTITION BY person ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS past_nights FROM days", *upto("days")),
    "prj10_pattern_rows": sql(f"SELECT {_ROWS_OUT} FROM pt2", *upto("published"), _ROWS),
    "srt2_evidence": sql(f"SELECT {_P}, " + ", ".join(f"coalesce(string_agg(day::VARCHAR, ',' ORDER BY day DESC) {f}, '') AS {n}" for n, f in (("core", "FILTER (WHERE membership = 'core')"), ("boundary", "FILTER (WHERE membership = 'boundary')"), ("every", ""))) + f" FROM me WHERE membership <> 'unassigned' GROUP BY {_P}", *upto("members")),
    "set1_variation": sql("SELECT person, window_end, day, membership, row_number() OVER (PARTITION BY person, window_end ORDER BY day DESC) AS place FROM me WHERE membership <> 'core'", *upto("members")),
    "srt4_history": sql("""SELECT person, selected_end, window_end, cluster, emergence, row_number() OVER (PARTITION BY person, selected_end ORDER BY window_end DESC, emergence DESC, rank) AS place
        FROM (SELECT d.person, d.day AS selected_end, (d.day - 42 * k::INT) AS window_end, first_day FROM days d JOIN (SELECT person, min(day) AS first_day FROM days GROUP BY person) f ON d.person = f.person, (SELECT unnest([1, 2, 3]) AS k)) a JOIN pb USING (person, window_end) WHERE shown AND window_end >= first_day""", *upto("published")),
    "viz1_stage_band": sql(f"SELECT {_P}, {_rounds(['hour', *_BAND], 7)} FROM s2", *_TO_MEMBERS, _SAMPLED, _BANDS),
    "viz2_pattern_density": sql(f"SELECT {_P}, round(hour, 7) AS hour, round(level, 7) AS level, round(avg(exp(-0.5 * ((level - depth) / 0.23) ** 2)), 7) AS density FROM sa, lv GROUP BY {_P}, sa.hour, lv.level", *_TO_MEMBERS, _SAMPLED, _LEVELS),
    "viz3_landscape": sql("SELECT person, day, cluster, hour, " + _rounds(["actual", *_BAND], 7) + " FROM ls", *_TO_MEMBERS, _GRID, _SERIES_SQL),
    "viz4_landscape_density": sql(f"SELECT {_P}, hour, round(level, 7) AS level, round(avg(exp(-0.5 * ((level - depth) / 0.24) ** 2)), 7) AS density FROM cg, lv GROUP BY {_P}, hour, lv.level", *_TO_MEMBERS, _GRID, _LEVELS),
    "viz5_overlaps": sql("SELECT person, day, cluster, min(hour) AS start, max(hour) AS end, count(*) AS points FROM (SELECT *, count_if(NOT inside) OVER (PARTITION BY person, day, cluster ORDER BY hour) AS island FROM (SELECT *, actual >= low - 0.025 AND actual <= high + 0.025 AS inside FROM ls WHERE hour >= bed AND hour <= wake)) WHERE inside GROUP BY person, day, cluster, island HAVING count(*) > 1", *_TO_MEMBERS, _GRID, _SERIES_SQL),
    "viz6_calendar": sql(f"""SELECT c.person, c.window_end, c.cluster, floor(i / 7)::BIGINT AS week, (i % 7)::BIGINT AS weekday, c.date, CASE WHEN c.date < window_start OR c.date > c.window_end THEN 'outside' WHEN dd.day IS NULL THEN 'missing' ELSE coalesce(membership, 'rest') END AS state,
        c.date >= window_start AND c.date <= c.window_end AND dd.day IS NOT NULL AND coalesce(membership, '') = 'core' AND coalesce(dd.nap, false) AS nap
        FROM (SELECT *, (monday + i::INT) AS date FROM (SELECT {_P}, window_start, date_trunc('week', window_start)::DATE AS monday, unnest(range(0, 7 * ceil((window_end - date_trunc('week', window_start)::DATE + 1) / 7)::BIGINT)) AS i FROM pb JOIN co USING (person, window_end) WHERE shown)) c
        LEFT JOIN (SELECT * FROM days WHERE valid) dd ON dd.person = c.person AND dd.day = c.date LEFT JOIN (SELECT * FROM me WHERE membership <> 'unassigned') m ON m.person = c.person AND m.window_end = c.window_end AND m.cluster = c.cluster AND m.day = c.date""", *upto("published")),
    "viz8_overview": sql("""SELECT co.person, co.window_end, CASE WHEN ever < 4 THEN 'ineligible' WHEN coalesce(visible, 0) > 0 THEN 'visible' ELSE 'learning' END AS state, coalesce(visible, 0) AS visible, coalesce(candidates, 0) - coalesce(visible, 0) AS hidden, coalesce(boundary, 0) AS boundary, coalesce(unassigned, 0) AS unassigned, coalesce(boundary, 0) + coalesce(unassigned, 0) AS variation,
        least(6, ceil(available / 7))::BIGINT AS weeks, available = 42 AS full FROM co JOIN (SELECT person, count_if(valid) AS ever FROM days GROUP BY person) e ON co.person = e.person
        LEFT JOIN (SELECT person, window_end, count_if(membership = 'boundary')::BIGINT AS boundary, count_if(membership = 'unassigned')::BIGINT AS unassigned FROM me GROUP BY ALL) m ON co.person = m.person AND co.window_end = m.window_end
        LEFT JOIN (SELECT person, window_end, count(*) AS candidates, count_if(shown)::BIGINT AS visible FROM pb GROUP BY ALL) p ON co.person = p.person AND co.window_end = p.window_end""", *upto("published")),
    "prj14_daily": sql("""SELECT person, day, round(duration + coalesce(nap_hours, 0), 9) AS asleep, round(in_bed + coalesce(nap_hours, 0), 9) AS in_bed, floor((duration + coalesce(nap_hours, 0)) / greatest(0.01, in_bed + coalesce(nap_hours, 0)) * 100 + 0.5)::BIGINT AS efficiency,
        round(in_bed * deep, 9) AS deep_hours, round(in_bed * light, 9) AS light_hours, round(in_bed * rem, 9) AS rem_hours, CASE WHEN exercise_known THEN floor(minutes + 0.5)::BIGINT END AS exercise_minutes, meals, fluid, stress,
        CASE WHEN evening_exercise THEN 'exercise' WHEN alcohol THEN 'alcohol' WHEN nap THEN 'nap' END AS tag, round((bed - 18) / 24 * 100, 9) AS "left", round((wake - bed) / 24 * 100, 9) AS width FROM days WHERE valid""", *upto("days")),
}
