"""Known answers of the seeded parts, states of nights by hand, and an archive from files to day rows."""

import datetime as dt
import json

import numpy as np
import pytest

from tidewheel.operators import clustering, night_fit, periodicity, sleep_days
from tidewheel.sources import archive


def test_public_generators():
    assert clustering.seed_of(["a"], 0) == 0xE40C292C and clustering.seed_of([""], 0) == 0x811C9DC5  # FNV-1a's published values
    u = clustering.Uniforms(1)
    assert [u(), u(), u()] == pytest.approx([0.6270739405881613, 0.002735721180215478, 0.5274470399599522], abs=1e-12)
    assert periodicity._uniforms(77, 50).tolist() == [v() for v in [clustering.Uniforms(77)] for _ in range(50)]


def test_block_orders_by_hand():
    def plain(n, block, runs, seed):
        u, out = clustering.Uniforms(seed), []
        for _ in range(runs):
            blocks = [list(range(a, min(n, a + block))) for a in range(0, n, block)]
            for i in range(len(blocks) - 1, 0, -1):
                j = int(u() * (i + 1))
                blocks[i], blocks[j] = blocks[j], blocks[i]
            out.append(sum(blocks, []))
        return out

    for n in (1, 3, 10, 31):
        assert periodicity.block_orders(n, 3, 7, 12345).tolist() == plain(n, 3, 7, 12345)


def test_stability_looks_at_sampled_days_only(monkeypatch):
    x = np.array([[0.0], [0.1], [0.2], [0.3], [5.0], [5.1], [5.2], [5.3], [2.6], [2.7]])
    seen = []
    plain = clustering.adjusted_rand
    monkeypatch.setattr(clustering, "adjusted_rand", lambda a, b: seen.append((len(a), len(b))) or plain(a, b))
    clustering.stability(x, [f"2024-01-{i + 1:02d}" for i in range(10)], (x[:, 0] > 2.5).astype(int), 2)
    assert set(seen) == {(8, 8)}


def test_empty_cluster_takes_the_farthest_row():
    x = np.array([[0.0], [0.0], [0.0], [9.0]])
    for seed in range(30):  # whatever rows it starts from, equal seeds leave a cluster empty at first
        labels, centres, sse = clustering.k_means(x, 2, clustering.Uniforms(seed))
        assert sse == 0 and len(set(labels.tolist())) == 2


def _pattern(day, cluster, shift):
    """Days of a pattern's core around bed 23 + shift, wake 31 + shift."""
    return [("p1", day - dt.timedelta(40 - i - 6 * cluster), cluster, 23.0 + shift + 0.01 * i, 31.0 + shift, 7.5) for i in range(6)]


def test_states_of_nights(spark):
    day = dt.date(2024, 3, 1)
    core = _pattern(day, 0, 0.0) + _pattern(day, 1, 6.0)
    schema = "person string, day date, valid boolean, bed double, wake double, duration double, quality double, deep double, light double, rem double, median_bpm double, low_bpm double, resting_bpm double, settling double, disruption double, profile array<double>"
    rest = (None,) * 8
    flat = [2.0] * 29
    days = {(p, d): (p, d, True, b, w, n, 0.9, *rest, flat) for p, d, _, b, w, n in core}
    # Hidden patterns, a night that isn't valid, one without a profile, and three nights against the same window.
    own = [("p1", day, 23.02, 31.0), ("p2", day, 26.0, 34.0), ("p3", day, 33.0, 45.0)]
    for p, d, b, w in own:
        days[(p, d)] = (p, d, True, b, w, 7.5, 0.9, *rest, flat)
    days[("p4", day)] = ("p4", day, False, *(None,) * 12, None)
    days[("p5", day)] = ("p5", day, True, 23.0, 31.0, 7.5, 0.9, *rest, None)
    days[("p6", day)] = ("p6", day, True, 23.0, 31.0, 7.5, 0.9, *rest, flat)
    d = spark.createDataFrame(list(days.values()), schema)
    window = day - dt.timedelta(1)
    members = [(p, window, c, x, "core") for p in ("p1", "p2", "p3", "p5", "p6") for _, x, c, *_ in core]
    extra = [(p, x, True, b, w, n, 0.9, *rest, flat) for p in ("p2", "p3", "p5", "p6") for _, x, _, b, w, n in core]
    d = d.unionAll(spark.createDataFrame(extra, schema)).dropDuplicates(["person", "day"])
    m = spark.createDataFrame(members, "person string, window_end date, cluster int, day date, membership string").dropDuplicates(["person", "window_end", "day"])
    found = [(p, window, c, 80, 70, c + 1, p != "p6") for p in ("p1", "p2", "p3", "p5", "p6") for c in (0, 1)]
    pats = spark.createDataFrame(found, "person string, window_end date, cluster int, confidence long, emergence long, rank long, shown boolean")
    shapes = night_fit.landscape(d.where("valid").select("person", "day", "profile"), m)
    out = {r.person: r for r in night_fit.resonance(d, pats, night_fit.references(d, m), shapes).where(f"day = '{day}'").collect()}
    assert out["p1"].state == "matched" and out["p1"].reason == "timing_and_landscape" and out["p1"].past_nights > 0
    assert out["p3"].state in ("different", "matched") and out["p3"].score < out["p1"].score
    assert (out["p4"].state, out["p4"].score) == ("unavailable", None)
    assert (out["p5"].state, out["p6"].state) == ("unavailable", "learning")


def _record(day, start, end, minutes, main=True, **more):
    data = more.pop("data", [{"dateTime": f"{start}", "level": "light", "seconds": 3600}])
    return {"logId": 1, "dateOfSleep": day, "startTime": start, "endTime": end, "mainSleep": main, "type": "stages", "minutesAsleep": minutes, "timeInBed": minutes + 20, "efficiency": 92, "levels": {"data": data, "shortData": more.pop("short", []), "summary": {k: {"minutes": v} for k, v in (("deep", 60), ("light", 240), ("rem", 90), ("wake", 10))}}} | more


def test_from_files_to_day_rows(spark, tmp_path):
    for p in ("p2", "p10"):
        (tmp_path / p / "fitbit").mkdir(parents=True)
    start = "2024-01-02T00:10:00"
    stages = [{"dateTime": "2024-01-02T00:10:00", "level": "wake", "seconds": 1800}, {"dateTime": "2024-01-02T00:40:00", "level": "deep", "seconds": 7200}]
    sleep = [
        _record("2024-01-02", start, "2024-01-02T08:00:00", 400, data=stages, short=[{"dateTime": "2024-01-02T01:00:00", "level": "wake", "seconds": 60}]),
        _record("2024-01-02", "2024-01-01T23:00:00", "2024-01-02T05:00:00", 400),
        _record("2024-01-02", "2024-01-02T14:00:00", "2024-01-02T14:30:00", 30, main=False),
        _record("2024-01-04", "2024-01-03T23:30:00", "2024-01-03T07:00:00", 430, data=[]),
        _record("2024-01-05", "2024-01-04T22:00:00", "2024-01-04T06:00:00", 440),
    ]
    (tmp_path / "p2/fitbit/sleep.json").write_text(json.dumps(sleep))
    heart = [{"dateTime": f"2024-01-02 {h:02d}:{m:02d}:{s:02d}", "value": {"bpm": 60 if h else 80, "confidence": 2}} for h in range(8) for m in range(60) for s in (0, 30)]
    (tmp_path / "p2/fitbit/heart_rate.json").write_text(json.dumps(heart, indent=1))
    (tmp_path / "p2/fitbit/exercise.json").write_text(json.dumps([{"startTime": "2024-01-01T21:00:00", "duration": 3_600_000, "activityName": "Run", "activityLevel": [{"minutes": 12, "name": "very"}]}]))
    (tmp_path / "p2/googledocs").mkdir()
    (tmp_path / "p2/googledocs/reporting.csv").write_text("meals,date,alcohol_consumed,glasses_of_fluid\n\"Lunch, Late dinner\",01/01/2024,No,4\n", encoding="utf-8-sig")
    (tmp_path / "p10/googledocs").mkdir()
    (tmp_path / "p10/googledocs/reporting.csv").write_text("date,meals,glasses_of_fluid,alcohol_consumed\n01/01/2024,Lunch,2,yes\n")
    root = str(tmp_path)
    assert [r.person for r in archive.folders(spark, root).collect()] == ["p2", "p10"]
    assert {(r.person, r.fluid, r.alcohol) for r in archive.food(spark, root).collect()} == {("p2", 4.0, False), ("p10", 2.0, True)}
    days = archive.day_rows(spark, root)
    out = {(r.person, str(r.day)): r for r in days.collect()}
    assert sorted(out) == [("p10", "2019-11-01"), ("p2", "2024-01-02"), ("p2", "2024-01-03"), ("p2", "2024-01-04"), ("p2", "2024-01-05")]
    first = out[("p2", "2024-01-02")]
    assert (first.valid, first.bed, first.wake, first.duration, first.in_bed) == (True, 24.1667, 32.0, 6.6667, 7.0)
    assert (first.nap, first.nap_hours, first.nap_start, str(first.context_date)) == (True, 0.5, 14.0, "2024-01-01")
    assert (first.deep, first.light, first.rem, first.awake) == (0.15, 0.6, 0.225, 0.025)
    assert first.profile[0] == 0.0 and first.profile[3] == 0.0 and first.profile[4] == 3.0 and first.profile[28] == 0.0 and first.profile[20] == 2.0
    assert (first.transitions, first.wake_minutes, first.brief_wakes, first.disruption, first.stage_coverage) == (1, 30, 1, 2, 1.0)
    assert (first.median_bpm, first.settling, first.food_reported, first.fluid, first.dinner) == (60, 46.0, True, 4.0, True)
    assert (first.exercises, first.minutes, first.evening_exercise, first.intensity_minutes, first.last_end_hours, first.kinds) == (1, 60.0, True, 12.0, 2.17, "Run")
    assert not out[("p2", "2024-01-03")].valid and not out[("p2", "2024-01-04")].valid
    last = out[("p2", "2024-01-05")]
    assert (last.valid, last.bed, last.wake, last.nap, last.exercise_known, last.disruption) == (True, 22.0, 30.0, False, False, 1 - 1)
    counted = sleep_days.counters(days, archive.sleep(spark, root), archive.exercise(spark, root), archive.food(spark, root), archive.wellness(spark, root))
    p2 = counted.where("person = 'p2'").first()
    assert (p2.valid_nights, p2.complete_records, p2.context_nights, p2.coverage, p2.food_days) == (2, 3, 1, 50, 1)
    assert {tuple(r) for r in sleep_days.special(counted).collect()} == {("p2", "fewer_than_4_valid_stage_nights"), ("p10", "fewer_than_4_valid_stage_nights")}
    assert sleep_days.totals(counted, 1).first().with_context == ["p2"]


def test_envelope_round_trip(spark, tmp_path):
    whole = {"schemaVersion": "1", "participants": [{"id": "p1", "label": "P", "coverage": 50, "days": [{"id": "p1-2024-01-01", "date": "2024-01-01", "valid": True, "bed": 24.0, "profile": [0.0, 2.0]}, {"id": "p1-2024-01-02", "date": "2024-01-02", "valid": False}]}]}
    (tmp_path / "e.json").write_text(json.dumps(whole))
    rows = archive.read_envelope(spark, str(tmp_path / "e.json"))
    assert [(r.person, str(r.day), r.valid, r.bed, r.profile) for r in rows.orderBy("day").collect()] == [("p1", "2024-01-01", True, 24.0, [0.0, 2.0]), ("p1", "2024-01-02", False, None, None)]
    archive.write_envelope(rows, spark.createDataFrame([(2,)], "persons long"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/participants")).count() == 2 and spark.read.json(str(tmp_path / "out/validation")).first().persons == 2


def test_opening_of_crowded_nights(spark):
    import random

    from pyspark.sql import functions as F

    rng, night = random.Random(5), dt.datetime(2024, 1, 2)
    rows = []
    for person in range(3):
        for i in range(40 if person < 2 else 3):
            at = night + dt.timedelta(seconds=rng.randrange(-1200, 7000))
            rows.append((person, night.date(), len(rows), at, rng.choice([0, 30, 60, 600, 1800]), rng.choice(["wake", "light", "deep", "other", ""]), rng.random() < 0.3))
    got = sleep_days.opening(df := spark.createDataFrame(rows, "person long, night date, event_id long, seg_start timestamp_ntz, seconds int, level string, short boolean"))
    item = F.struct("seg_start", "event_id", F.struct(sleep_days.seconds(F.col("seg_start")).alias("s"), (sleep_days.seconds(F.col("seg_start")) + F.col("seconds")).alias("e"), "level").alias("x"))
    pick = lambda own: F.transform(F.sort_array(F.collect_list(F.when(own, item))), lambda y: y["x"])
    whole = df.groupBy("person", "night").agg(pick(~F.col("short")).alias("data"), pick(F.col("short")).alias("short")).withColumn("start", sleep_days.night_start(F.col("night")))
    want = whole.select("person", "night", sleep_days.first_minutes(F.col("data"), F.col("short"), F.col("start")).alias("x")).select("person", "night", "x.*")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and len({r.disruption for r in want.collect()}) > 1
    depths = whole.select("person", "night", F.posexplode(sleep_days.profile(F.col("data"), F.col("short"), F.col("start"), F.col("start") + 8 * 3600)))
    assert {tuple(r) for r in sleep_days.profiles(df).collect()} == {tuple(r) for r in depths.collect()}


def test_no_night_is_gathered_in_one_array(spark):
    from tidewheel.plans import QUERIES

    for name in ("agg8_first_minutes", "join17_profile"):
        assert "collect_list" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_nights_own_their_samples_and_counts_alone_are_shuffled(spark):
    from tidewheel.operators import ingest

    t = dt.datetime(2024, 1, 1)
    at = lambda h: t + dt.timedelta(hours=h)
    spans = [("a", 0, 10), ("a", 4, 6), ("a", 8, 14), ("a", 13.5, 15.25), ("b", 1, 3)]
    nights = spark.createDataFrame([(p, t.date() + dt.timedelta(k), at(s), at(e)) for k, (p, s, e) in enumerate(spans)], "person string, night date, start_ts timestamp_ntz, end_ts timestamp_ntz")
    rows = [(p, i, at(i * 0.01), 40 + i * 7 % 61, i % 4) for p in "ab" for i in range(1600)]
    samples = spark.createDataFrame(rows, "person string, event_id long, ts timestamp_ntz, bpm int, confidence int")
    want: dict = {}
    for p, i, ts, bpm, sure in rows:
        hit = sorted((s, k) for k, (q, s, e) in enumerate(spans) if q == p and at(s) <= ts < at(e))
        if sure and hit:
            want.setdefault((p, t.date() + dt.timedelta(hit[0][1])), []).append((i, ts, bpm, sure))
    joined = ingest.samples_in_nights(samples, nights)
    assert sorted((r.person, r.night, r.event_id) for r in joined.collect()) == sorted((*k, i) for k, v in want.items() for i, *_ in v)
    found = ingest.heart_metrics(joined, 100, 0.5)
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString() and "row_number" not in joined._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        v = want.pop((r.person, r.night))
        bpm = sorted(x[2] for x in v)
        assert (r.n, r.confident) == (len(v), pytest.approx(sum(x[3] >= 2 for x in v) / len(v)))
        enough = len(v) >= 100 and r.coverage >= 0.5
        assert (r.median_bpm, r.low_bpm) == ((bpm[-(-len(v) // 2) - 1], bpm[-(-len(v) // 10) - 1]) if enough else (None, None))
    assert not want
