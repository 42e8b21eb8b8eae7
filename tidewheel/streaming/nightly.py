"""Nights scored as they arrive, each against the patterns of the window that ended the evening before.

Two streams meet by person: nights, and snapshots, what each window's patterns are once its last day has been learnt. State holds the
snapshots and the nights that wait for theirs; Python only matches the two. What is matched is scored by the columns of the batch operator. A night so never
meets a pattern that it has helped to form: it is scored first, and learnt by the snapshot of its own day.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import night_fit
from ..operators.windows import KEY, SPAN

#: Columns of a night that a score reads, beside its outline.
NIGHT = ("quality", *night_fit.SPREADS, *night_fit.STAGES)
#: Days behind a person's newest for which state is kept; a night or a snapshot may come so late.
KEPT = 2 * SPAN
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_Q = "".join(f", q_{m} array<double>" for m in night_fit.SPREADS)
_S = "".join(f", s_{s} double" for s in night_fit.STAGES)
PATTERN = f"cluster int, confidence long, emergence long, rank long, cores long{_Q}{_S}, middle array<double>"
ITEM = "person string, n int, kind string, content string"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a query starts, the state store that keyed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def snapshots(days: DataFrame, members: DataFrame, published: DataFrame) -> DataFrame:
    """(person, window_end, patterns): the shown patterns of each window with their references, as JSON; an empty list where there are none."""
    own = [*KEY, "cluster"]
    prior = published.where("shown").select(*own, "confidence", "emergence", "rank").join(night_fit.references(days, members), own).join(night_fit.shapes(days.where("valid"), members), own, "left")
    listed = prior.groupBy(*KEY).agg(F.to_json(F.collect_list(F.struct(*(c for c in prior.columns if c not in KEY)))).alias("patterns"))
    return days.select("person", F.col("day").alias("window_end")).join(listed, KEY, "left").withColumn("patterns", F.coalesce("patterns", F.lit("[]")))


def night_items(nights: DataFrame) -> DataFrame:
    """Valid nights as ITEMs. nights: (person, day, valid, profile and the columns of NIGHT)."""
    own = F.when(F.size("profile") > 0, night_fit.resample(F.col("profile"), night_fit.POINTS)).alias("own")
    content = F.to_json(F.struct(*(F.col(c).cast("double").alias(c) for c in NIGHT), own))
    return nights.where("valid AND day IS NOT NULL").select(F.col("person").cast("string").alias("person"), F.unix_date("day").alias("n"), F.lit("night").alias("kind"), content.alias("content"))


def snapshot_items(found: DataFrame) -> DataFrame:
    """Rows of snapshots() as ITEMs."""
    return found.select(F.col("person").cast("string").alias("person"), F.unix_date("window_end").alias("n"), F.lit("patterns").alias("kind"), F.col("patterns").alias("content"))


class Matcher(StatefulProcessor):
    """Brings each night together with the snapshot of the evening before, whichever comes first.

    A night that comes again unchanged is passed over, a changed one is matched anew. A later snapshot of an evening serves nights that come after it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        state = lambda name: handle.getMapState(name, "n int", "content string")
        self.known, self.waiting, self.done = state("known"), state("waiting"), state("done")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for n, kind, content in sorted((int(r.n), r.kind, r.content) for part in rows for r in part.itertuples()):
            if kind == "patterns":
                self.known.updateValue((n,), (content,))
                night = n + 1
                content = self.waiting.getValue((night,))[0] if self.waiting.containsKey((night,)) else None
                if content is not None:
                    self.waiting.removeKey((night,))
            elif self.done.containsKey((n,)) and self.done.getValue((n,))[0] == content:
                content = None
            else:
                night = n
            if content is None:
                continue
            if self.known.containsKey((night - 1,)):
                out.append((key[0], night, content, self.known.getValue((night - 1,))[0]))
                self.done.updateValue((night,), (content,))
            else:
                self.waiting.updateValue((night,), (content,))
        every = [(s, k[0]) for s in (self.known, self.waiting, self.done) for k in list(s.keys())]
        newest = max((n for _, n in every), default=0)
        for s, n in every:
            if n < newest - KEPT:
                s.removeKey((n,))
        yield pd.DataFrame(out, columns=["person", "n", "night", "patterns"])

    def close(self) -> None:
        pass


def scores(nights: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of night_fit.fits() for streams of nights and of snapshots(); a night without shown patterns has none. Start it within keyed_state()."""
    items = night_items(nights).unionByName(snapshot_items(found))
    matched = items.groupBy("person").transformWithStateInPandas(Matcher(), "person string, n int, night string, patterns string", "Append", "None")
    night = ", ".join(f"{c} double" for c in NIGHT)
    rows = matched.select("person", F.date_from_unix_date("n").alias("day"), F.from_json("night", f"{night}, own array<double>").alias("x"), F.explode(F.from_json("patterns", f"array<struct<{PATTERN}>>")).alias("p"))
    rows = rows.select("person", "day", F.date_sub("day", 1).alias("window_end"), "x.*", "p.*")
    return night_fit.scored(rows.withColumn("landscape", night_fit.resemblance(F.col("own"), F.col("middle"))))
