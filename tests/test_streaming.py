"""Nights of a stream have the scores of the batch; late, repeated and early ones; the generator of nights."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import night_fit, patterns, windows
from tidewheel.sources import synthetic
from tidewheel.streaming import nightly


class _Map(dict):
    """A map state in memory."""

    def getValue(self, k):  # noqa: N802
        return self.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def containsKey(self, k):  # noqa: N802
        return k in self

    def removeKey(self, k):  # noqa: N802
        self.pop(k, None)


class _Handle:
    def getMapState(self, *_):  # noqa: N802
        return _Map()


@pytest.fixture
def matcher():
    import pandas as pd

    m = nightly.Matcher()
    m.init(_Handle())
    return lambda *items: [tuple(r) for r in next(m.handleInputRows(("p",), iter([pd.DataFrame(items, columns=["n", "kind", "content"])]), None)).itertuples(index=False)]


def test_nights_and_snapshots_meet_in_any_order(matcher):
    assert matcher((11, "night", "a")) == []  # its snapshot is to come
    assert matcher((10, "patterns", "P10"), (11, "patterns", "P11")) == [("p", 11, "a", "P10")]
    assert matcher((12, "night", "b")) == [("p", 12, "b", "P11")]
    assert matcher((12, "patterns", "P12"), (13, "night", "c")) == [("p", 13, "c", "P12")]


def test_repeated_late_and_changed_nights(matcher):
    matcher((10, "patterns", "P10"), (11, "night", "a"))
    assert matcher((11, "night", "a")) == []
    assert matcher((11, "night", "a2")) == [("p", 11, "a2", "P10")]
    assert matcher((11, "patterns", "P11")) == []  # its own day's snapshot does not touch it
    assert matcher((10 + nightly.KEPT, "patterns", "late")) == []
    assert matcher((11, "night", "a3")) == [("p", 11, "a3", "P10")]
    matcher((12 + nightly.KEPT, "patterns", "later"))
    assert matcher((11, "night", "a4")) == []  # what it needs is gone, and it with the next purge


def test_a_stream_scores_as_the_batch_does(spark, tmp_path):
    days = synthetic.days(spark, 2, 75).withColumns({"awake": F.lit(0.1), **{m: (F.col("bed") * k + F.dayofmonth("day")).cast("double") for k, m in enumerate(("median_bpm", "low_bpm", "resting_bpm", "settling", "disruption"), 1)}})
    days = days.withColumn("resting_bpm", F.when(F.dayofmonth("day") % 2 == 0, F.col("resting_bpm"))).withColumn("profile", F.when(F.dayofmonth("day") % 5 > 0, F.col("profile")))
    path = f"{tmp_path}/days"
    days.write.parquet(path)
    days = spark.read.parquet(path)
    labelled = patterns.rule_labels(windows.features(windows.window_days(days)))
    members = patterns.membership(labelled)
    published = patterns.published(patterns.emergence(members, patterns.window_counts(days)))
    found = nightly.snapshots(days, members, published)
    found.write.parquet(f"{tmp_path}/all")
    found = spark.read.parquet(f"{tmp_path}/all")
    cut = [dt.date(2025, 11, 1) + dt.timedelta(k) for k in (0, 30, 55, 75)]
    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        days.where((F.col("day") >= a) & (F.col("day") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        found.where((F.col("window_end") >= a) & (F.col("window_end") < b)).coalesce(1).write.parquet(f"{tmp_path}/snap/{k}")
    read = lambda d, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{d}/*")
    out = nightly.scores(read("in", days.schema), read("snap", found.schema))
    with nightly.keyed_state(spark):
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    got = {(r.person, r.day, r.cluster): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    land = night_fit.landscape(days.where("valid").select("person", "day", "profile"), members)
    want = night_fit.fits(days, published, night_fit.references(days, members), land).collect()
    assert len(want) == len(got) > 50
    for r in want:
        g = got[(r.person, r.day, r.cluster)]
        assert g.score == r.score
        assert all(getattr(g, d) == pytest.approx(getattr(r, d), abs=1e-9) for d in (*night_fit.WEIGHTS, "raw", "coverage"))
    assert {len(json.loads(r.patterns)) for r in found.collect()} >= {0, 1}


def test_generator(spark):
    rows = synthetic.days(spark).collect()
    assert len(rows) == 16 * 181 and {len(r.profile) for r in rows} == {29}
    share = sum(r.valid for r in rows) / len(rows)
    assert 0.88 < share < 0.95 and all(0.12 <= min(r.profile) and max(r.profile) <= 3 for r in rows)
    first = [r for r in rows if r.person == "p01"]
    early = lambda a, b: sum(r.early for r in first if a <= (r.day - synthetic.FIRST).days < b) / (b - a)
    assert early(0, 42) < 0.4 < 0.65 < early(42, 92)
    assert sorted(map(str, rows)) == sorted(map(str, synthetic.days(spark).repartition(7).collect()))
