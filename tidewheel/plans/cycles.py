"""Queries of cycles and of the replay, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, seeded
from ..operators import associations, history, insights, pattern_rows, periodicity, reports, windows
from ..operators.windows import KEY
from ..scratch import kept
from ..sources import adapters
from .context import _REPLAY, _SIGNALS
from .oracle import sql, upto
from .queries import _ASSOC, _patterns, _rounded, _rounds, _shared

FEW_RUNS = 40
_SPLIT = ["first_explained", "second_explained", "agreement"]


def _series(spark: SparkSession, d: str) -> DataFrame:
    return kept(periodicity.series_of(adapters.days(spark, d)), "series")


def per3_scan(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(periodicity.scan(_series(spark, d)), ["explained"], 5).drop("amplitude", "phase")


def srt9_best_period(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(periodicity.best_period(periodicity.scan(_series(spark, d))), ["explained"], 5).drop("amplitude", "phase")


def per5_split(spark: SparkSession, d: str) -> DataFrame:
    """Halves of each series at its own best period, their own best periods and phase agreement."""
    series = _series(spark, d)
    return _rounded(periodicity.split(series, periodicity.best_period(periodicity.scan(series))), _SPLIT, 5)


def agg12_moments(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(periodicity.moments(_series(spark, d)), ["mean", "deviation"], 7)


def per4_permutation(spark: SparkSession, d: str) -> DataFrame:
    return periodicity.permutation_p(_series(spark, d))


def _feature_tests(spark: SparkSession, d: str) -> DataFrame:
    series = _series(spark, d)
    tests = kept(periodicity.discovery_control(kept(periodicity.permutation_p(series), "tests")), "tests")
    halves = periodicity.split(series, tests)
    return periodicity.publishable_features(tests.join(halves, "series"))


def flt10_feature_cycles(spark: SparkSession, d: str) -> DataFrame:
    return _feature_tests(spark, d)


def srt8_strongest(spark: SparkSession, d: str) -> DataFrame:
    return periodicity.strongest(_feature_tests(spark, d))


def agg34_counters(spark: SparkSession, d: str) -> DataFrame:
    return periodicity.counters(_feature_tests(spark, d))


def _tiles(days: DataFrame) -> DataFrame:
    """Windows that do not overlap: every 42nd day from the first full one."""
    at = F.row_number().over(Window.partitionBy("person").orderBy("day"))
    return days.withColumn("at", at).where("at >= 42 AND (at - 42) % 42 = 0").select("person", F.col("day").alias("window_end"))


def win11_tiles(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(adapters.days(spark, d))


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    days, members = _shared(spark, d)
    published = kept(_patterns(spark, d, days, members), "patterns")
    return kept(periodicity.core_series(members, published, _tiles(days), pattern_rows.names(published)), "series")


def per8_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of the days on which a pattern occurs, over periods from 2 to 10."""
    g = periodicity.fit_periods(periodicity.with_span(_occurrences(spark, d)), ["series"], 2, 10, 0)
    return _rounded(g.select("series", "period", "explained"), ["explained"], 5)


def per4_few_runs(spark: SparkSession, d: str) -> DataFrame:
    """Permutation tests of occurrence series with FEW_RUNS runs in three parts, few enough for SQL to follow every shuffle."""
    tests = periodicity.permutation_p(_occurrences(spark, d), 2, 10, 0, FEW_RUNS, parts=3)
    return _rounded(tests, ["explained", "standardized"], 5).withColumn("p", F.round("p", 9)).drop("amplitude")


def join19_pattern_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Permutation tests of occurrence series, with their replication in another window of the person."""
    series = _occurrences(spark, d)
    own = series.select("series", *KEY, "cluster", "pattern_id").distinct()
    tests = kept(periodicity.permutation_p(series, 2, 10, 0), "tests")
    return periodicity.publishable_patterns(periodicity.discovery_control(tests).join(own, "series"))


def fn21_uniforms(spark: SparkSession, d: str) -> DataFrame:
    """For each event the value of the generator that its id seeds, at a place given by its user."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.round(seeded.uniform(F.col("event_id") * 2654435 + 4294960000, F.col("user_id") * 77777777 + 1), 12).alias("value"))


def fn23_block_orders(spark: SparkSession, d: str) -> DataFrame:
    """For each user, whose events are a series, the order of blocks of three in a run of the stream that the user's name seeds."""
    n = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    seed = scalar.text_seed(F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    order = seeded.block_order(F.col("n"), 3, seed, F.pmod("user_id", F.lit(5000)))
    return n.select("user_id", "n", F.array_join(order.cast("array<string>"), ",").alias("positions"))


def _observed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(replayed windows, shown patterns of them, published associations and insights of those)."""
    days, members = _shared(spark, d)
    published = kept(_patterns(spark, d, days, members), "patterns")
    ends = kept(history.replay_ends(days), "ends")
    windowed = kept(windows.window_days(days, ends=ends), "windowed")
    near = members.join(ends, KEY, "left_semi")
    found = associations.associations(windowed, near)
    signals = insights.with_calendar(insights.signals(windowed, near), found)
    shown = published.where("shown").join(ends, KEY, "left_semi")
    both = insights.united(signals, insights.unfolded(found, signals)).join(shown.select(*KEY, "cluster"), [*KEY, "cluster"], "left_semi")
    return history.replay_windows(published, members, ends), shown, both


_BOTH = ["strength", "confidence"]


def set2_united(spark: SparkSession, d: str) -> DataFrame:
    """Insights and the associations that they do not already carry, for the shown patterns of replayed windows."""
    return _rounded(_observed(spark, d)[2], _BOTH)


def agg29_replay(spark: SparkSession, d: str) -> DataFrame:
    windows_, shown, both = _observed(spark, d)
    return history.replay_totals(windows_, shown, both)


def agg30_by_source(spark: SparkSession, d: str) -> DataFrame:
    both = _observed(spark, d)[2]
    return both.groupBy("source").agg(F.count("*").alias("observations"), F.countDistinct("person").alias("persons"))


def srt7_strongest_associations(spark: SparkSession, d: str) -> DataFrame:
    both = _rounded(_observed(spark, d)[2], _BOTH)
    return both.orderBy(F.desc(F.round(F.col("strength") * F.col("confidence"), 9)), *KEY, "cluster", "id").limit(20)


def snk2_associations_report(spark: SparkSession, d: str) -> DataFrame:
    """The replay's report, line by line."""
    windows_, shown, both = _observed(spark, d)
    both = kept(both, "observed")
    return reports.associations_report(history.replay_totals(windows_, shown, both), both)


def snk3_cycles_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of feature cycles and of pattern cycles, line by line."""
    return reports.cycles_report(kept(_feature_tests(spark, d), "features"), kept(join19_pattern_cycles(spark, d), "patterns"))


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT concat(person, '-{k}') AS series, day, {c}::DOUBLE AS y FROM days WHERE valid AND {c} IS NOT NULL" for k, c in periodicity.CATALOGUE.items()) + ")"
_SERIES = f"{_LONG}, se AS (SELECT *, count(*) OVER w AS n, max(day) OVER w - min(day) OVER w + 1 AS span FROM long WINDOW w AS (PARTITION BY series) QUALIFY count(*) OVER w >= 50)"


def _fits(source: str, keys: str, values: str = "y") -> str:
    """e7: fitted sums and e9: residuals of the rows (keys, period, day, y) of source, by elimination of the normal equations with their ridge, a CTE a pivot.

    The equations are positive definite, so rows need no exchange here.
    """
    by = f"{keys}, period"
    weekdays = range(1, 7)
    design = ["1.0", "t", *(f"(CASE WHEN wk = {k} THEN 1.0 ELSE 0.0 END)" for k in weekdays)]
    rows = ", ".join("[" + ", ".join([*(f"sum({a} * {b})" + (" + 1e-8" if i == j else "") for j, b in enumerate(design)), *(f"sum({a} * {v})" for v in ("y", "s", "c"))]) + "]" for i, a in enumerate(design))
    steps = []
    for k in range(8):
        steps.append(f"q{k} AS MATERIALIZED (SELECT {by}, m, list_transform(m[{k + 1}], lambda x: x / m[{k + 1}][{k + 1}]) AS own FROM m{k})")
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT {by}, list_transform(m, lambda row, r: CASE WHEN r = {k + 1} THEN own ELSE list_transform(list_zip(row, own), lambda z: z[1] - row[{k + 1}] * z[2]) END) AS m FROM q{k})")
    fitted = lambda j: f"(m[1][{j}] + t * m[2][{j}] + CASE WHEN wk > 0 THEN m[2 + greatest(wk, 1)][{j}] ELSE 0 END)"
    steps_sql = ",\n".join(steps)
    return f"""e0 AS (SELECT {by}, day, y, dayofweek(day) AS wk, (day - DATE '1970-01-01') AS o FROM {source}),
e1 AS (SELECT *, sin(o * 2 * pi() / period) AS s, cos(o * 2 * pi() / period) AS c, (o - min(o) OVER w)::DOUBLE / greatest(1, max(o) OVER w - min(o) OVER w) AS t FROM e0 WINDOW w AS (PARTITION BY {by})),
m0 AS MATERIALIZED (SELECT {by}, [{rows}] AS m FROM e1 GROUP BY {by}),
{steps_sql},
e9 AS MATERIALIZED (SELECT {by}, day, e1.y AS raw, e1.y - {fitted(9)} AS y, s - {fitted(10)} AS s, c - {fitted(11)} AS c FROM e1 JOIN m8 USING ({by})),
e5 AS (SELECT {by}, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(s * y) AS sy, sum(c * y) AS cy, sum(y * y) AS yy FROM e9 GROUP BY {by}),
e6 AS (SELECT *, (sy * cc - cy * sc) / greatest(1e-9, ss * cc - sc * sc) AS sine, (cy * ss - sy * sc) / greatest(1e-9, ss * cc - sc * sc) AS cosine FROM e5),
e7 AS MATERIALIZED (SELECT *, least(1.0, greatest(0.0, sy * sine + cy * cosine) / greatest(1e-9, yy)) AS explained FROM e6)"""


_EACH = f"{_SERIES}, pe AS (SELECT series, day, y, period FROM se, (SELECT unnest(range(2, 22)) AS period) WHERE span / period >= 4)"
_HALVES = f"""{_SERIES}, hf AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY day) <= floor(n / 2) THEN 1 ELSE 2 END AS half FROM se),
pe AS (SELECT series, half, day, y, period FROM hf, (SELECT unnest(range(2, 22)) AS period) WHERE span / period >= 4)"""
_SPLIT_SQL = """hb AS (SELECT series, half, arg_min(period, (-round(explained, 9), period)) AS best FROM e7 GROUP BY ALL),
ha AS (SELECT e7.*, best FROM e7 JOIN hb USING (series, half) JOIN be USING (series) WHERE period = chosen)"""


def _product(a: str, b: str) -> str:
    return f"(({a})::HUGEINT * ({b})::HUGEINT % 4294967296)::BIGINT"


def _uniform_sql(source: str, keys: str, seed: str, place: str) -> str:
    """uv: rows of source with value, the generator's at a place."""
    return f"""u0 AS (SELECT {keys}, ((({seed})::HUGEINT + ({place})::HUGEINT * {seeded.STEP}) % 4294967296)::BIGINT AS st FROM {source}),
u1 AS (SELECT *, {_product("xor(st, st >> 15)", "st | 1")} AS a FROM u0),
u2 AS (SELECT *, xor(a, (a + {_product("xor(a, a >> 7)", "a | 61")}) % 4294967296) AS b FROM u1),
uv AS MATERIALIZED (SELECT {keys}, xor(b, b >> 14) / 4294967296.0::DOUBLE AS value FROM u2)"""


def _text_seed_sql(text: str) -> str:
    fold = f"list_reduce(list_concat([2166136261::HUGEINT], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::HUGEINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296)"
    return f"({fold})::BIGINT"


#: bo: (sid, run, positions) for rows (sid, n, seed, run) of ru: the blocks' exchanges as a fold over the list of their places.
_ORDERS = """nb AS (SELECT *, ceil(n / 3)::BIGINT AS k FROM ru),
sp0 AS (SELECT sid, run, k, seed, unnest(range(1, greatest(k, 1))) AS step FROM nb),
{uniforms},
xc AS (SELECT sid, run, k, list([k - step, floor(value * (k - step + 1))::BIGINT] ORDER BY step) AS swaps FROM uv GROUP BY sid, run, k),
bo0 AS (SELECT nb.sid, nb.run, nb.n, list_reduce(list_prepend(range(nb.k), coalesce(swaps, [])), lambda o, x: list_transform(o, lambda v, p: CASE WHEN p = x[1] + 1 THEN o[x[2] + 1] WHEN p = x[2] + 1 THEN o[x[1] + 1] ELSE v END)) AS blocks FROM nb LEFT JOIN xc USING (sid, run)),
bo AS MATERIALIZED (SELECT sid, run, n, list_filter(flatten(list_transform(blocks, lambda b: [3 * b, 3 * b + 1, 3 * b + 2])), lambda i: i < n) AS positions FROM bo0)""".replace("{uniforms}", _uniform_sql("sp0", "sid, run, k, step", "seed", "run * (k - 1) + step"))
_NULL_RUNS = f"""ld AS (SELECT series AS sid, count(*) AS n, {_text_seed_sql("series")} AS seed FROM oc GROUP BY series),
ru AS (SELECT *, unnest(range(0, {FEW_RUNS})) AS run FROM ld),
{_ORDERS},
rs AS (SELECT series, period, y, s, c, row_number() OVER (PARTITION BY series, period ORDER BY day) AS pos FROM e9),
mv AS (SELECT sid AS series, run, unnest(positions) + 1 AS was, generate_subscripts(positions, 1) AS pos FROM bo),
nu AS (SELECT w.series, run, w.period, sum(w.s * v.y) AS sy, sum(w.c * v.y) AS cy FROM rs w JOIN mv ON mv.series = w.series AND mv.pos = w.pos JOIN rs v ON v.series = w.series AND v.period = w.period AND v.pos = mv.was GROUP BY ALL),
ne AS (SELECT series, run, max(least(1.0, greatest(0.0, nu.sy * (nu.sy * cc - nu.cy * sc) + nu.cy * (nu.cy * ss - nu.sy * sc)) / greatest(1e-9, ss * cc - sc * sc) / greatest(1e-9, yy))) AS share FROM nu JOIN e7 USING (series, period) GROUP BY series, run),
bs AS (SELECT series, arg_min(period, (-round(explained, 9), period)) AS period FROM e7 GROUP BY series),
pv AS (SELECT e7.series, e7.period, e7.explained, (SELECT count(*) FROM ne WHERE ne.series = e7.series AND share >= e7.explained - 1e-12) AS beaten, sqrt(sine * sine + cosine * cosine) AS size FROM e7 JOIN bs USING (series, period))"""
_TILES_SQL = "ti AS (SELECT person, day AS window_end FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY day) AS pos FROM days) WHERE pos >= 42 AND (pos - 42) % 42 = 0)"
_OCCUR = f"""{_TILES_SQL}, vn AS (SELECT me.*, count(*) OVER (PARTITION BY person, window_end) AS n FROM me JOIN ti USING (person, window_end)),
nm AS (SELECT *, count(*) OVER (PARTITION BY person, window_end) AS many FROM pb), pi AS (SELECT *, CASE WHEN many = 1 THEN CASE WHEN median_bed < 24.35 THEN 'earlier-sleep' ELSE 'later-longer-sleep' END WHEN rank = 1 THEN 'earlier-sleep' WHEN rank = many THEN 'later-longer-sleep' ELSE concat('middle-sleep-', rank - 1) END AS pattern_id FROM nm),
oc AS (SELECT concat_ws('-', vn.person, vn.window_end::VARCHAR, pattern_id) AS series, vn.day, CASE WHEN vn.cluster = pb.cluster AND membership = 'core' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM vn JOIN pi pb ON vn.person = pb.person AND vn.window_end = pb.window_end WHERE pb.shown AND n >= 30 AND core_days >= 5 AND n - core_days >= 8),
pe AS (SELECT series, day, y, period FROM oc, (SELECT unnest(range(2, 11)) AS period))"""
_UNITED = """rp AS (SELECT pb.* FROM pb JOIN re USING (person, window_end) WHERE shown),
ic AS (SELECT ins.*, ac.definition AS calendar_id FROM ins LEFT JOIN (SELECT * FROM ac WHERE shown AND source = 'calendar') ac USING (person, window_end, cluster) WHERE chosen),
un AS (SELECT u.* FROM (
  SELECT person, window_end, cluster, concat('signals_', scope) AS id, 'signals' AS source, support, comparison_days AS comparison, strength, confidence FROM ic
  UNION ALL SELECT person, window_end, cluster, definition, source, support, comparison, strength, confidence FROM ac a WHERE shown AND NOT EXISTS (SELECT 1 FROM ic WHERE ic.person = a.person AND ic.window_end = a.window_end AND ic.cluster = a.cluster AND ic.calendar_id = a.definition)) u
  JOIN rp USING (person, window_end, cluster))"""
_OBSERVED = (*upto("published"), _ASSOC, _SIGNALS.replace("cp AS (", "cp_s AS (").replace("JOIN cp USING", "JOIN cp_s USING").replace("cp.", "cp_s.").replace("sd AS (", "sd_s AS (").replace("FROM sd ", "FROM sd_s "), _REPLAY, _UNITED)
_U = "person, window_end, cluster, id, source, support, comparison, " + _rounds(_BOTH)
_SOURCES = ("calendar", "exercise", "food", "wellness", "signals")

QUERIES = {f.__name__: f for f in (
    per3_scan, srt9_best_period, per5_split, agg12_moments, per4_permutation, per4_few_runs, fn21_uniforms, fn23_block_orders, flt10_feature_cycles, srt8_strongest, agg34_counters, win11_tiles, per8_occurrences, join19_pattern_cycles,
    snk2_associations_report, snk3_cycles_report, set2_united, agg29_replay, agg30_by_source, srt7_strongest_associations,
)}
_TOTALS = (
    "SELECT count(*) AS windows, count(DISTINCT wm.person) AS persons, " + ", ".join(f"count_if(coalesce(visible, 0) = {k})::BIGINT AS visible_{k}" for k in range(5)) + ", (SELECT count(*) FROM rp) AS snapshots, (SELECT count(DISTINCT (person, window_end, cluster)) FROM un) AS explained, (SELECT count(*) FROM un) AS observations, (SELECT count(DISTINCT person) FROM un) AS explained_persons, "
    + ", ".join(f"(SELECT count(*) FROM un WHERE source = '{s}') AS from_{s}" for s in _SOURCES) + ", sum(valid_days)::BIGINT AS valid_days, sum(core)::BIGINT AS core, sum(boundary)::BIGINT AS boundary, sum(unassigned)::BIGINT AS unassigned, count_if(boundary > 0)::BIGINT AS with_boundary, count_if(unassigned > 0)::BIGINT AS with_unassigned FROM wm LEFT JOIN wp USING (person, window_end)"
)
_WORDS = {
    "windows": "windows", "persons": "persons", **{f"visible_{k}": f"windows with {k} shown patterns" for k in range(5)}, "snapshots": "shown patterns", "explained": "of them with an observation",
    "observations": "observations", "from_calendar": "of the calendar", "from_exercise": "of exercise", "from_food": "of food", "from_wellness": "of wellness", "from_signals": "of joint signals",
    "valid_days": "valid days", "core": "core days", "boundary": "boundary days", "unassigned": "unassigned days",
}
_FIGURES = " UNION ALL ".join(f"SELECT 1 AS part, {i} AS place, concat('- {text}: ', {c}) AS line FROM tot" for i, (c, text) in enumerate(_WORDS.items()))
_REPORT = f"""SELECT 0 AS part, 0 AS place, '# Context of patterns' AS line UNION ALL {_FIGURES}
UNION ALL SELECT 2, -1, '| person | window end | pattern | context | support | strength | confidence |' UNION ALL SELECT 2, 0, '|-|-|-|-|-|-|-|'
UNION ALL SELECT 2, place::INT, concat('| ', person, ' | ', window_end, ' | ', cluster, ' | ', replace(id, '_', ' '), ' | ', support, ' | ', floor(round(strength * 100, 6) + 0.5)::BIGINT, ' | ', floor(round(confidence * 100, 6) + 0.5)::BIGINT, ' |') FROM tp WHERE place <= 12"""
_TOP = "tp AS (SELECT *, row_number() OVER (ORDER BY round(strength * confidence, 9) DESC, person, window_end, cluster, id) AS place FROM un)"
_BEST = sql("SELECT series, arg_min(period, (-round(explained, 9), period)) AS period FROM e7 GROUP BY series", _EACH.replace(_SERIES, "pe0 AS (SELECT 1)"), _fits("pe", "series"))
ORACLES = {
    "per3_scan": sql("SELECT series, period, round(explained, 5) AS explained FROM e7", *upto("days"), _EACH, _fits("pe", "series")),
    "srt9_best_period": sql("SELECT series, arg_min(period, (-round(explained, 9), period)) AS period, round(max(explained), 5) AS explained FROM e7 GROUP BY series", *upto("days"), _EACH, _fits("pe", "series")),
    "per5_split": sql("""SELECT a.series, round(a.explained, 5) AS first_explained, round(b.explained, 5) AS second_explained, a.best AS first_best, b.best AS second_best,
        round(CASE WHEN sqrt((a.sine ** 2 + a.cosine ** 2) * (b.sine ** 2 + b.cosine ** 2)) > 1e-9 THEN (a.sine * b.sine + a.cosine * b.cosine) / sqrt((a.sine ** 2 + a.cosine ** 2) * (b.sine ** 2 + b.cosine ** 2)) ELSE 0 END, 5) AS agreement
        FROM ha a JOIN ha b ON a.series = b.series AND a.half = 1 AND b.half = 2""", *upto("days"), _HALVES, _fits("pe", "series, half"), f"be AS (SELECT series, period AS chosen FROM ({_BEST}))", _SPLIT_SQL),
    "agg12_moments": sql("SELECT series, round(avg(y), 7) AS mean, round(stddev_pop(y), 7) AS deviation FROM se GROUP BY series", *upto("days"), _SERIES),
    "win11_tiles": sql("SELECT * FROM ti", *upto("days"), _TILES_SQL),
    "per8_occurrences": sql("SELECT series, period, round(explained, 5) AS explained FROM e7", *upto("published"), _OCCUR, _fits("pe", "series")),
    "per4_few_runs": sql(f"""SELECT pv.series, n, period, round(explained, 5) AS explained, round((beaten + 1) / {FEW_RUNS + 1}, 9) AS p, round(size / greatest(1e-9, (SELECT stddev_pop(y) FROM oc WHERE oc.series = pv.series)), 5) AS standardized FROM pv JOIN ld ON ld.sid = pv.series""", *upto("published"), _OCCUR, _fits("pe", "series"), _NULL_RUNS),
    "fn21_uniforms": sql("SELECT event_id, round(value, 12) AS value FROM uv", _uniform_sql("events", "event_id", "event_id * 2654435 + 4294960000", "user_id * 77777777 + 1")),
    "fn23_block_orders": sql("SELECT sid AS user_id, n, array_to_string(positions, ',') AS positions FROM bo", f"ru AS (SELECT user_id AS sid, count(*) AS n, {_text_seed_sql("concat('user-', user_id)")} AS seed, user_id % 5000 AS run FROM events GROUP BY user_id)", _ORDERS),
    "set2_united": sql(f"SELECT {_U} FROM un", *_OBSERVED),
    "snk2_associations_report": sql(_REPORT, *_OBSERVED, f"tot AS ({_TOTALS})", _TOP),
    "agg29_replay": sql(_TOTALS, *_OBSERVED),
    "agg30_by_source": sql("SELECT source, count(*) AS observations, count(DISTINCT person) AS persons FROM un GROUP BY source", *_OBSERVED),
    "srt7_strongest_associations": sql(f"SELECT {_U} FROM un ORDER BY round(round(strength, 9) * round(confidence, 9), 9) DESC, person, window_end, cluster, id LIMIT 20", *_OBSERVED),
}
