"""Heart-rate logs cut anywhere, envelopes there and back, reports as lines."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import reports
from tidewheel.sources import archive, heart_rate


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    """Two persons' logs, one written with wide spacing, with records that are none among them."""
    root = tmp_path_factory.mktemp("logs")
    for person, space in (("p1", ""), ("p2", "\n   ")):
        (root / person / "fitbit").mkdir(parents=True)
        records = [f'{{{space}"dateTime":{space}"2024-01-01T00:{i // 60:02d}:{i % 60:02d}",{space}"value": {{"bpm": {25 + i % 200}, "confidence": {i % 4}}}{space}}}' for i in range(300)]
        records[7] = '{"dateTime": "2024-01-01T00:00:07", "value": {"bpm": null, "confidence": 1}}'
        records[9] = '{"dateTime": "nothing", "value": {"bpm": 70, "confidence": 1}}'
        (root / person / "fitbit" / "heart_rate.json").write_text("[" + ",\n".join(records) + "]")
    (root / "notes").mkdir()
    return str(root)


@pytest.mark.parametrize("split", [1_000_000, 5_000, 97])
def test_rows_do_not_depend_on_where_files_are_cut(spark, logs, split):
    rows = heart_rate.samples(spark, logs, split).drop("event_id").collect()
    want = archive.heart(spark, logs).where("bpm BETWEEN 30 AND 220 AND confidence >= 1").drop("event_id").collect()
    assert len(want) > 300
    assert sorted(rows) == sorted(want)
    ids = heart_rate.samples(spark, logs, split).select("person", "event_id").distinct().count()
    assert ids == len(rows)


def test_bounds_are_checked_in_the_reader_where_filters_are_pushed(spark, logs):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        got = heart_rate.samples(spark, logs, 700, 60, 61, 2)
        assert sorted(got.drop("event_id").collect()) == sorted(archive.heart(spark, logs).where("bpm BETWEEN 60 AND 61 AND confidence >= 2").drop("event_id").collect())
    finally:
        spark.conf.set(name, before)
    reader = heart_rate.BoundedReader({"root": logs, "split": "500"})
    left = list(reader.pushFilters([heart_rate.GreaterThanOrEqual(("bpm",), 60), heart_rate.EqualTo(("confidence",), 3), heart_rate.EqualTo(("person",), "p1")]))
    assert [f.attribute for f in left] == [("person",)]
    assert all(b >= 60 and c == 3 for p in reader.partitions() for batch in reader.read(p) for b, c in zip(batch["bpm"].to_pylist(), batch["confidence"].to_pylist(), strict=True))


def test_no_logs_no_rows(spark, tmp_path):
    assert heart_rate.samples(spark, str(tmp_path)).count() == 0
    assert heart_rate.samples(spark, str(tmp_path / "nowhere")).count() == 0


def test_an_envelope_reads_back_as_it_was_written(spark, tmp_path):
    days = [{"id": f"{p}-{i}", "date": f"2024-01-{i + 1:02d}", "valid": i != 1, **({} if i == 1 else {"bed": 23.5 + i, "nap": False, "stages": {"deep": 0.2, "light": 0.5, "rem": 0.2, "wake": 0.1}, "profile": [0.0, 1.5]})} for p in ("p1",) for i in range(4)]
    (tmp_path / "e.json").write_text(json.dumps({"schemaVersion": "1", "participants": [{"id": p, "label": p, "coverage": 75, "days": days} for p in ("p1", "p2", "p10")]}))
    rows = archive.read_envelope(spark, f"{tmp_path}/e.json")
    archive.export_envelopes(rows, spark.createDataFrame([(3,)], "persons long"), f"{tmp_path}/out")
    back = archive.read_envelope(spark, f"{tmp_path}/out/participants")
    assert back.schema == rows.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    one = json.loads(archive.envelopes(rows).where("person = 'p1'").first().content)
    assert one["participants"][0]["coverage"] == 75
    assert [d["date"] for d in one["participants"][0]["days"]] == sorted(d["date"] for d in days)
    assert spark.read.json(f"{tmp_path}/out/validation").first().persons == 3


def test_report_lines_in_order_and_as_text(spark, tmp_path):
    tests = spark.createDataFrame([(f"s{i:02d}", 2 + i, 0.5 - i / 100, 0.001 * (i // 2), 0.01 * i, i < 3, i < 2) for i in range(15)], "series string, period int, explained double, p double, q double, split_stable boolean, publishable boolean")
    lines = reports.cycles_report(tests)
    reports.write_text(lines, f"{tmp_path}/r")
    text = [r.value for r in spark.read.text(f"{tmp_path}/r", wholetext=False).select("value", F.monotonically_increasing_id().alias("i")).orderBy("i").collect()]
    assert text[:5] == ["# Cycles", "- series tested: 15", "- p of 0.05 or less: 15", "- q of 0.1 or less: 11", "- publishable: 2"]
    assert text[5] == "| series | days | explained | p | q | both halves |"
    assert text[7:9] == ["| s00 | 2 | 50.0% | 0.0000 | 0.000 | yes |", "| s01 | 3 | 49.0% | 0.0000 | 0.010 | yes |"]
    assert len(text) == 7 + reports.ROWS


def test_day_of_an_envelope_without_an_id_gets_one(spark):
    rows = spark.createDataFrame([("p1", dt.date(2024, 5, 1), True, 23.0)], "person string, day date, valid boolean, bed double")
    day = json.loads(archive.envelopes(rows).first().content)["participants"][0]["days"][0]
    assert day == {"date": "2024-05-01", "id": "p1-2024-05-01", "valid": True, "bed": 23.0}
