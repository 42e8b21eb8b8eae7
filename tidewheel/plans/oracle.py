"""SQL of the registered queries, for any engine that knows unnest and generate_series."""

from __future__ import annotations

from ..operators.windows import CLOCK, FEATURES, METRICS
from ..sources import adapters

_NAMES = {n: n for n in ("events", "orders", "customer", "nation")}
DAYS = f"days AS ({adapters.DAYS.format(**_NAMES, calendar=adapters.OTHER_CALENDAR, ordinal=adapters.OTHER_ORDINAL)})"

WINDOWED = """ends AS (SELECT person, day AS window_end FROM days),
wd AS (SELECT d.*, e.window_end FROM days d JOIN ends e ON d.person = e.person AND d.day <= e.window_end AND d.day > e.window_end - 42)"""


def _scale(m: str, floor: float) -> str:
    q = lambda p: f"quantile_cont({m}, {p})"
    return f"CASE WHEN count({m}) >= greatest(6, ceil(count(*) * 0.5)) THEN {q(0.5)} END AS {m}_center, CASE WHEN count({m}) >= greatest(6, ceil(count(*) * 0.5)) THEN greatest({floor}, ({q(0.8)} - {q(0.2)}) / 1.28) END AS {m}_scale"


SCALES = "sc AS (SELECT person, window_end, count(*) AS valid_days, " + ", ".join(_scale(m, f) for m, f, _ in METRICS) + " FROM wd WHERE valid GROUP BY person, window_end)"

EXTRA = """ex0 AS (SELECT person, window_end, count(*) AS n, count_if(nap) AS naps, count(DISTINCT CASE WHEN nap THEN date_trunc('week', day) END) AS nap_weeks FROM wd WHERE valid GROUP BY person, window_end),
ex AS (SELECT person, window_end, naps::BIGINT AS naps, naps / n AS nap_share, nap_weeks, naps >= 3 AND naps / n >= 0.1 AND nap_weeks >= 2 AS nap_eligible,
         naps >= greatest(3, ceil(n * 0.2)) AND naps / n >= 0.2 AND nap_weeks >= 2 AS nap_defining FROM ex0)"""

_CLOCK = ", ".join(f"({c} - {m}) / {s} AS f{i}" for i, (c, m, s) in enumerate(CLOCK))
_TERMS = ", ".join(f"CASE WHEN {m} IS NULL OR {m}_center IS NULL THEN 0.0 ELSE least(greatest(({m} - {m}_center) / {m}_scale, -2.5), 2.5) * {w} END AS f{4 + i}" for i, (m, _, w) in enumerate(METRICS))
FEATURED = f"ft AS (SELECT person, window_end, day, bed, quality, {_CLOCK}, CASE WHEN nap AND nap_eligible THEN 0.8 ELSE 0.0 END AS f3, {_TERMS} FROM wd JOIN sc USING (person, window_end) JOIN ex USING (person, window_end) WHERE valid)"


def _distance(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}{f} - {b}{f}) * ({a}{f} - {b}{f})" for f in FEATURES) + ")"


LABELLED = "lb AS (SELECT ft.*, CASE WHEN bed < median(bed) OVER (PARTITION BY person, window_end) THEN 0 ELSE 1 END AS cluster FROM ft)"
_K = "person, window_end, cluster"
_MEDIANS = ", ".join(f"median({f}) AS c_{f}" for f in FEATURES)
_F = ", ".join(f"lb.{f}" for f in FEATURES)


def means(prefix: str) -> str:
    return ", ".join(f"avg({f}) AS {prefix}{f}" for f in FEATURES)


MEMBERS = f"""ce AS (SELECT {_K}, {_MEDIANS} FROM lb GROUP BY {_K}),
ds AS (SELECT lb.person, lb.window_end, lb.day, lb.bed, lb.quality, {_F}, ce.cluster, {_distance('lb.', 'ce.c_')} AS d FROM lb JOIN ce USING (person, window_end)),
nr AS (SELECT *, row_number() OVER w AS r, lead(d) OVER w AS d2 FROM ds WINDOW w AS (PARTITION BY person, window_end, day ORDER BY d, cluster)),
n1 AS (SELECT *, CASE WHEN d2 IS NULL THEN 1.0 ELSE (d2 - d) / greatest(d2, 1e-6) END AS clarity FROM nr WHERE r = 1),
ty AS (SELECT {_K}, median(d) AS typical, quantile_cont(d, 0.8) AS p80, quantile_cont(d, 0.92) AS p92 FROM n1 GROUP BY {_K}),
ma AS (SELECT {_K}, median(abs(d - typical)) AS mad FROM n1 JOIN ty USING ({_K}) GROUP BY {_K}),
li AS (SELECT {_K}, greatest(0.62, p80, typical + 2.2 * greatest(0.08, mad)) AS core_limit, p92, typical, mad FROM ty JOIN ma USING ({_K})),
me0 AS (SELECT n1.*, core_limit, greatest(0.92, p92, typical + 4 * greatest(0.08, mad), 1.35 * core_limit) AS edge_limit FROM n1 JOIN li USING ({_K})),
me1 AS (SELECT *, CASE WHEN d <= core_limit AND clarity >= 0.12 THEN 'core' WHEN d <= edge_limit AND clarity >= 0.03 THEN 'boundary' ELSE 'unassigned' END AS membership FROM me0),
me AS (SELECT *, CASE membership WHEN 'core' THEN 1.0 WHEN 'boundary' THEN least(greatest(0.65 - 0.22 * d / greatest(edge_limit, 1e-6), 0.35), 0.65) ELSE 0.0 END AS weight FROM me1)"""

EMERGED = f"""co AS (SELECT person, day AS window_end, count(*) OVER w AS available, count_if(valid) OVER w AS valid_days, min(day) OVER w AS window_start FROM days
  WINDOW w AS (PARTITION BY person ORDER BY day RANGE BETWEEN INTERVAL 41 DAYS PRECEDING AND CURRENT ROW)),
sp AS (SELECT *, greatest(1, ceil(available / 7)) AS weeks FROM co),
ev AS (SELECT *, quality * weight AS w FROM me WHERE membership <> 'unassigned'),
sh AS (SELECT * FROM (SELECT *, count_if(membership = 'core') OVER (PARTITION BY {_K}) AS cores FROM ev) WHERE cores < 2 OR membership = 'core'),
cm AS (SELECT {_K}, {means('m_')} FROM sh GROUP BY {_K}),
tc AS (SELECT {_K}, median(x) AS q50, quantile_cont(x, 0.8) AS q80 FROM (SELECT {_K}, {_distance('sh.', 'cm.m_')} AS x FROM sh JOIN cm USING ({_K})) GROUP BY {_K}),
mm AS (SELECT {_K}, count(*) AS days, count_if(membership = 'core')::BIGINT AS core_days, least(sum(w) ** 2 / greatest(1e-6, sum(w * w)), sum(w)) AS n_eff, median(bed) AS median_bed FROM ev GROUP BY {_K}),
bw AS (SELECT {_K}, sum(w) AS week_mass FROM (SELECT {_K}, floor((day - window_start) / 7) AS week, max(weight) AS w FROM ev JOIN sp USING (person, window_end) GROUP BY ALL) GROUP BY {_K}),
rc AS (SELECT {_K}, sum(CASE WHEN day >= window_end - 13 THEN weight ELSE 0 END) AS recent, sum(CASE WHEN day >= window_end - 13 THEN 0 ELSE weight END) AS prior FROM ev GROUP BY {_K}),
rk AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY day) AS a, row_number() OVER (PARTITION BY {_K} ORDER BY day DESC) AS b, count(*) OVER (PARTITION BY {_K}) AS size FROM sh),
h1 AS (SELECT {_K}, any_value(size) AS shape_days, {means('a_')} FROM rk WHERE a <= greatest(2, floor(size / 2)) GROUP BY {_K}),
h2 AS (SELECT {_K}, {means('b_')} FROM rk WHERE b <= greatest(2, floor(size / 2)) GROUP BY {_K}),
dr AS (SELECT {_K}, shape_days, CASE WHEN shape_days >= 2 THEN exp(-0.65 * {_distance('a_', 'b_')}) ELSE 0.72 END AS structural FROM h1 JOIN h2 USING ({_K})),
bg AS (SELECT cm.* FROM cm JOIN mm USING ({_K}) WHERE days >= 3),
gp AS (SELECT cm.person, cm.window_end, cm.cluster, min({_distance('cm.m_', 'bg.m_')}) AS nearest FROM cm JOIN bg ON cm.person = bg.person AND cm.window_end = bg.window_end AND cm.cluster <> bg.cluster GROUP BY ALL),
p0 AS (SELECT {_K}, days, core_days, shape_days, n_eff, median_bed, weeks, valid_days, available, recent, prior, 1 - exp(-n_eff / 5) AS support,
  greatest(0.05, least(1, week_mass / weeks * (0.52 + 0.48 * greatest(0, least(1, (weeks - 1) / 4))))) AS recurrence,
  greatest(0.05, least(1, exp(-(0.72 * q50 + 0.32 * q80)))) AS compactness,
  greatest(0.05, least(1, coalesce(nearest, 1.05) / (coalesce(nearest, 1.05) + q80 + 0.08))) AS separation,
  greatest(0.05, least(1, structural * (0.52 + 0.48 * greatest(0, least(1, weeks / 4))))) AS temporal_stability
  FROM mm JOIN tc USING ({_K}) JOIN bw USING ({_K}) JOIN rc USING ({_K}) JOIN dr USING ({_K}) LEFT JOIN gp USING ({_K}) JOIN sp USING (person, window_end)),
p1 AS (SELECT *, greatest(0.05, least(1, recent / greatest(2.0, prior / greatest(1, weeks - 2) * 2) * (0.75 + 0.25 * compactness))) AS recent_continuity FROM p0),
pt AS (SELECT *, floor(100 * exp(0.2 * (ln(greatest(support, 0.05)) + ln(recurrence) + ln(compactness) + ln(separation)) + 0.1 * (ln(temporal_stability) + ln(recent_continuity))) + 0.5)::BIGINT AS emergence,
  floor(100 * greatest(0.05, least(1, (0.46 + 0.38 * least(1, weeks / 6) + 0.16 * valid_days / available) * (0.7 + 0.3 * compactness))) + 0.5)::BIGINT AS confidence FROM p1)"""

PUBLISHED = f"pb AS (SELECT *, CASE WHEN emergence >= 70 THEN 'clear' WHEN emergence >= 55 THEN 'emerging' ELSE 'early' END AS status, core_days >= 4 AND n_eff >= 4 AND emergence >= 55 AND confidence >= 55 AS shown, row_number() OVER (PARTITION BY person, window_end ORDER BY median_bed, cluster) AS rank FROM pt)"


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def upto(name: str) -> tuple[str, ...]:
    order = {"days": DAYS, "windowed": WINDOWED, "scales": SCALES, "extra": EXTRA, "featured": FEATURED, "labelled": LABELLED, "members": MEMBERS, "emerged": EMERGED, "published": PUBLISHED}
    names = list(order)
    return tuple(order[n] for n in names[: names.index(name) + 1])
