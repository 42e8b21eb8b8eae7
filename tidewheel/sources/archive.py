"""Raw archives: JSON logs and CSV diaries in one folder a person, read with fixed schemas.

root holds folders p1, p2, ...; every reader takes the path below such a folder, reads all persons at once and adds
person. Where no such file exists the result is empty. A file is read in order by one task, so that of several rows of
a day the last one wins.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SCORES = ("fatigue", "mood", "readiness", "sleep_quality", "soreness", "stress")
TRUE_WORDS = ("yes", "y", "true", "1")
INTENSE = ("fairly", "very")
RESTING = "dateTime string, value struct<value: string>"
HEART = "dateTime string, value struct<bpm: int, confidence: int>"
EXERCISE = "startTime string, duration string, activityLevel array<struct<minutes: double, name: string>>, calories double, steps double, activityName string"


_STAGES = "array<struct<dateTime: string, level: string, seconds: double>>"
_SUMMARY = ", ".join(f"{k}: struct<minutes: double>" for k in ("deep", "light", "rem", "wake"))
SLEEP = (
    "logId string, dateOfSleep string, startTime string, endTime string, mainSleep boolean, type string, minutesAsleep double, timeInBed double, efficiency double, "
    f"levels struct<data: {_STAGES}, shortData: {_STAGES}, summary: struct<{_SUMMARY}>>"
)


ENVELOPE_DAY = (
    "id: string, date: string, valid: boolean, bed: double, wake: double, duration: double, timeInBed: double, nap: boolean, napStart: double, napDuration: double, "
    "stages: struct<deep: double, light: double, rem: double, wake: double>, profile: array<double>, quality: double"
)


def _person() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"/(p\d+)/", 1).alias("person")


def moment(text: Column) -> Column:
    """A local time without zone: T becomes a space, a Z at the end goes, nothing is shifted; null if it is none."""
    return F.regexp_replace(F.regexp_replace(text, "T", " "), "Z", "").try_cast("timestamp_ntz")


def read_json(spark: SparkSession, root: str, below: str, schema: str) -> DataFrame:
    """One row for each element of the arrays in root/p*/below, with person and ord."""
    try:
        found = spark.read.schema(schema).json(f"{root}/p*/{below}", multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    if found is None:
        return spark.createDataFrame([], f"person string, ord long, {schema}")
    return found.select(_person(), F.monotonically_increasing_id().alias("ord"), *found.columns)


#: Columns of a CSV file, at most.
WIDEST = 64


def read_csv(spark: SparkSession, root: str, below: str, columns: tuple[str, ...]) -> DataFrame:
    """The named columns as text, null where a file has none of that name, with person and ord.

    Each file's own first row names its columns, so files may order them differently; a byte-order mark is no part of a name.
    """
    names = [f"c{i}" for i in range(WIDEST)]
    try:
        found = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(f"{root}/p*/{below}", header=False, multiLine=True, enforceSchema=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "person string, ord long, " + ", ".join(f"{c} string" for c in columns))
    rows = found.select(_person(), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.array(*names).alias("cells"))
    clean = lambda x: F.trim(F.regexp_replace(x, "^\ufeff", ""))
    heads = rows.groupBy("file").agg(F.min("ord").alias("top"), F.transform(F.min_by("cells", "ord"), clean).alias("head"))
    own = rows.join(heads, "file").where("ord > top")
    return own.select("person", "ord", *(F.get("cells", F.array_position("head", F.lit(c)).cast("int") - 1).alias(c) for c in columns))


def _last(rows: DataFrame, values: list[str]) -> DataFrame:
    """The last row of each person and day."""
    picked = rows.where(F.col("day").isNotNull()).groupBy("person", "day").agg(F.max_by(F.struct(*values), "ord").alias("x"))
    return picked.select("person", "day", "x.*")


def persons(rows: DataFrame) -> DataFrame:
    """(person, number) by the number in the folder's name."""
    return rows.select("person").distinct().withColumn("number", F.regexp_extract("person", r"(\d+)", 1).cast("int"))


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """Day rows of an exported envelope, one file or a folder of files: participants, each with its days. Missing members are null."""
    whole = spark.read.schema(f"schemaVersion string, participants array<struct<id: string, label: string, coverage: double, days: array<struct<{ENVELOPE_DAY}>>>>").json(path, multiLine=True)
    people = whole.select("schemaVersion", F.explode("participants").alias("p"))
    rows = people.select("schemaVersion", F.col("p.id").alias("person"), F.explode("p.days").alias("d")).select("schemaVersion", "person", "d.*")
    return rows.withColumn("day", F.to_date("date")).withColumn("valid", F.coalesce("valid", F.lit(False)))


def envelopes(days: DataFrame, version: str = "1") -> DataFrame:
    """(person, content): for each person an envelope of one participant as JSON, its days in order of their dates.

    Columns of a day that ENVELOPE_DAY names go out, missing ones as nulls that are left out; coverage is the rounded percentage of valid days.
    """
    wanted = [part.split(":")[0].strip() for part in re.split(r", (?![^<]*>)", ENVELOPE_DAY)]
    have = days.withColumn("date", F.date_format("day", "yyyy-MM-dd"))
    have = have.withColumn("id", F.concat_ws("-", F.col("person").cast("string"), "date")) if "id" not in days.columns else have
    day = F.struct(*(F.col(c) for c in ["date", *(c for c in wanted if c != "date")] if c in have.columns))
    people = have.groupBy("person").agg(F.sort_array(F.collect_list(day)).alias("days"), F.round(100 * F.avg(F.col("valid").cast("double"))).alias("coverage"))
    own = F.struct(F.col("person").cast("string").alias("id"), F.concat(F.lit("Person "), F.col("person").cast("string")).alias("label"), "coverage", "days")
    return people.select("person", F.to_json(F.struct(F.lit(version).alias("schemaVersion"), F.array(own).alias("participants"))).alias("content"))


def export_envelopes(days: DataFrame, validation: DataFrame, path: str) -> None:
    """Envelopes that read_envelope() reads, a file a person, and one JSON file of validation figures beside their folder.

    A person's days are one aggregation, so they are one row; persons are written in parallel.
    """
    envelopes(days).select("content").write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{path}/participants")
    validation.coalesce(1).write.mode("overwrite").json(f"{path}/validation")


def write_envelope(days: DataFrame, validation: DataFrame, path: str) -> None:
    """Day rows as JSON lines, a folder a person, and one JSON file of validation figures beside them."""
    write_days(days, f"{path}/participants", "json")
    validation.coalesce(1).write.mode("overwrite").json(f"{path}/validation")


def resting(spark: SparkSession, root: str, below: str = "fitbit/resting_heart_rate.json") -> DataFrame:
    """(person, day, resting_bpm): values from 30 to 120, two digits."""
    rows = read_json(spark, root, below, RESTING).select("person", "ord", moment(F.col("dateTime")).cast("date").alias("day"), F.col("value.value").try_cast("double").alias("x"))
    return _last(rows.where("x BETWEEN 30 AND 120").withColumn("resting_bpm", F.round("x", 2)), ["resting_bpm"])


def heart(spark: SparkSession, root: str, below: str = "fitbit/heart_rate.json") -> DataFrame:
    """(person, event_id, ts, bpm, confidence), as the interval join takes them.

    Files are long arrays of flat objects with keys in one order, so they are cut at closing braces and read by pieces,
    several tasks a file; what does not look like a sample goes.
    """
    try:
        text = spark.read.text(f"{root}/p*/{below}", lineSep="}").select(_person(), F.monotonically_increasing_id().alias("event_id"), "value")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "person string, event_id long, value string")
    part = lambda pattern: F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))
    rows = text.select("person", "event_id", moment(part(r'"dateTime"\s*:\s*"([^"]*)"')).alias("ts"), part(r'"bpm"\s*:\s*(\d+)').try_cast("int").alias("bpm"), part(r'"confidence"\s*:\s*(\d+)').try_cast("int").alias("confidence"))
    return rows.where("ts IS NOT NULL AND bpm IS NOT NULL")


def sleep(spark: SparkSession, root: str, below: str = "fitbit/sleep.json") -> DataFrame:
    """Sleep records as they are, with person and ord."""
    return read_json(spark, root, below, SLEEP)


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(person, number) of all folders p1, p2, ... that hold a file, in the order of their numbers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/p*").select(F.col("path"))
    own = files.select(F.regexp_extract("path", r"/(p\d+)/", 1).alias("person")).where("person <> ''")
    return persons(own).orderBy("number")


def day_rows(spark: SparkSession, root: str) -> DataFrame:
    """From files to day rows: nights, naps, exercise, food, wellness and heart rate joined on one dense calendar."""
    from ..operators import ingest, sleep_days
    from ..scratch import kept

    records = sleep(spark, root)
    nights = kept(sleep_days.main_nights(records), "nights")
    inside = kept(ingest.samples_in_nights(heart(spark, root), nights.select("person", "night", "start_ts", "end_ts")), "samples")
    calendar = sleep_days.spine(records, folders(spark, root))
    trained = ingest.exercise_before(nights, exercise(spark, root))
    return sleep_days.assembled(calendar, nights, sleep_days.naps(records), trained, food(spark, root), wellness(spark, root), resting(spark, root), ingest.heart_metrics(inside), ingest.settling(inside))


def food(spark: SparkSession, root: str, below: str = "googledocs/reporting.csv") -> DataFrame:
    """(person, day, food_reported, meals, fluid, alcohol). Empty and unreadable amounts are 0."""
    rows = read_csv(spark, root, below, ("date", "meals", "glasses_of_fluid", "alcohol_consumed"))
    meals = F.filter(F.transform(F.split(F.coalesce("meals", F.lit("")), ","), F.trim), lambda m: m != "")
    return _last(rows.select(
        "person", "ord", F.try_to_timestamp(F.trim("date"), F.lit("d/M/yyyy")).cast("date").alias("day"), F.lit(True).alias("food_reported"), meals.alias("meals"),
        F.coalesce(F.col("glasses_of_fluid").try_cast("double"), F.lit(0.0)).alias("fluid"), F.coalesce(F.lower(F.trim("alcohol_consumed")).isin(*TRUE_WORDS), F.lit(False)).alias("alcohol"),
    ), ["food_reported", "meals", "fluid", "alcohol"])


def wellness(spark: SparkSession, root: str, below: str = "pmsys/wellness.csv") -> DataFrame:
    """(person, day, wellness_reported, six scores). Empty scores are 0, unreadable ones null."""
    rows = read_csv(spark, root, below, ("effective_time_frame", *SCORES))
    score = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(0.0)).otherwise(F.col(c).try_cast("double")).alias(c)
    return _last(rows.select("person", "ord", moment(F.col("effective_time_frame")).cast("date").alias("day"), F.lit(True).alias("wellness_reported"), *map(score, SCORES)), ["wellness_reported", *SCORES])


def exercise(spark: SparkSession, root: str, below: str = "fitbit/exercise.json") -> DataFrame:
    """(person, event_id, start_ts, end_ts, minutes, intensity_minutes, calories, steps, kind); rows without a start go."""
    intense = F.aggregate(F.filter(F.coalesce("activityLevel", F.array()), lambda x: x["name"].isin(*INTENSE)), F.lit(0.0), lambda s, x: s + F.coalesce(x["minutes"], F.lit(0.0)))
    ms = F.coalesce(F.col("duration").try_cast("double"), F.lit(0.0))
    rows = read_json(spark, root, below, EXERCISE).withColumns({"start_ts": moment(F.col("startTime")), "ms": ms}).where("start_ts IS NOT NULL")
    return rows.select(
        "person", F.col("ord").alias("event_id"), "start_ts", F.expr("start_ts + make_dt_interval(0, 0, 0, ms / 1000)").alias("end_ts"), (F.col("ms") / 60000).alias("minutes"), intense.alias("intensity_minutes"),
        F.coalesce("calories", F.lit(0.0)).alias("calories"), F.coalesce("steps", F.lit(0.0)).alias("steps"), F.coalesce(F.nullif("activityName", F.lit("")), F.lit("Activity")).alias("kind"),
    )


def write_days(days: DataFrame, path: str, kind: str = "parquet") -> None:
    """Day relations by person: parquet, or json with one line a day."""
    days.repartition("person").write.partitionBy("person").format(kind).save(path)
