"""Insights, history, replay and landscapes against DuckDB; raw archives on small files."""

import datetime as dt
import decimal
import glob
import json
import os

import duckdb
import pytest

from tidewheel.operators import insights
from tidewheel.plans import ORACLES, context
from tidewheel.sources import archive

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else float(value) if isinstance(value, decimal.Decimal) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", list(context.QUERIES))
def test_agrees_with_sql(spark, duck, name):
    df, found = context.QUERIES[name](spark, DATA), duck.execute(ORACLES[name])
    got = rows(df.columns, df.collect())
    want = rows([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_planted_signal_is_chosen_once(spark):
    end = dt.date(2024, 2, 11)
    days = [end - dt.timedelta(k) for k in range(42)]
    core = {d for k, d in enumerate(days) if k % 2}
    wd = spark.createDataFrame([(1, end, d, True, 80.0 if d in core else 20.0, 6.0 if d in core else 1.0) for d in days], "person int, window_end date, day date, valid boolean, settling double, disruption double")
    me = spark.createDataFrame([(1, end, d, 0, "core") for d in core], "person int, window_end date, day date, cluster int, membership string")
    chosen = insights.signals(wd, me).where("chosen").collect()
    assert [(r["scope"], r["settling_difference"], r["disruption_difference"]) for r in chosen] == [("work", 60, 5)]


def test_archive(spark, tmp_path):
    own = tmp_path / "p2"
    for d in ("fitbit", "googledocs", "pmsys"):
        (own / d).mkdir(parents=True)
    (own / "fitbit/resting_heart_rate.json").write_text(json.dumps([{"dateTime": "2024-01-01T00:00:00", "value": {"value": 55.123}}, {"dateTime": "2024-01-01T00:00:00Z", "value": {"value": 56.789}}, {"dateTime": "x", "value": {"value": 50}}, {"dateTime": "2024-01-02T00:00:00", "value": {"value": 0}}]))
    (own / "googledocs/reporting.csv").write_text("date,meals,glasses_of_fluid,alcohol_consumed\n1/2/2024,\"Lunch, Dinner,\",,Yes\nbad,,,\n01/02/2024,Dinner,oops,no\n", encoding="utf-8-sig")
    (own / "pmsys/wellness.csv").write_text("effective_time_frame,fatigue,mood,stress\n2024-01-05T08:00:00.000Z,3,,oops\n")
    (own / "fitbit/exercise.json").write_text(json.dumps([{"startTime": "2024-01-01T18:00:00Z", "duration": 1800000, "activityLevel": [{"minutes": 10, "name": "fairly"}, {"minutes": 5, "name": "lightly"}]}]))
    root = str(tmp_path)
    assert [tuple(r) for r in archive.resting(spark, root).collect()] == [("p2", dt.date(2024, 1, 1), 56.79)]
    assert [tuple(r) for r in archive.food(spark, root).collect()] == [("p2", dt.date(2024, 2, 1), True, ["Dinner"], 0.0, False)]
    well = archive.wellness(spark, root).first()
    assert (well["day"], well["fatigue"], well["mood"], well["stress"], well["soreness"]) == (dt.date(2024, 1, 5), 3.0, 0.0, None, 0.0)
    trip = archive.exercise(spark, root).first()
    assert (trip["end_ts"], trip["minutes"], trip["intensity_minutes"], trip["kind"]) == (dt.datetime(2024, 1, 1, 18, 30), 30.0, 10.0, "Activity")
    assert archive.heart(spark, root).isEmpty()
    archive.write_days(archive.resting(spark, root), f"{root}/out")
    assert spark.read.parquet(f"{root}/out").count() == 1
