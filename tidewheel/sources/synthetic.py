"""A made-up day relation: seeded persons whose nights come in two shapes, for trials without records."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from ..operators.clustering import Uniforms

# Persons, days, first day, seeds.
PERSONS, DAYS, FIRST, SEED, STEP = 16, 181, dt.date(2025, 11, 1), 4100, 7919
POINTS = 29


def early_share(person: Column, day: Column) -> Column:
    """Chance of an early night: person 0 changes twice, the others swing around a share of their own."""
    own = 0.42 + ((person * 17) % 31) / 100
    wave = F.sin(day / (13 + person % 5) + person) * 0.2
    shift = F.when(day > 82, (person % 3 - 1) * 0.1).otherwise(0.0)
    first = F.when(day < 42, 0.2).when(day < 92, 0.82).otherwise(0.64 + F.sin(day / 11) * 0.08)
    return F.when(person == 0, first).otherwise(clamp(own + wave + shift, 0.12, 0.9))


def profile(later: bool, noise: np.ndarray) -> np.ndarray:
    """29 depths: two swells of deep sleep, a ripple, a rise to waking, and noise."""
    x = np.arange(POINTS) / (POINTS - 1)
    swell = 1.2 * np.exp(-(((x - 0.2) / 0.18) ** 2)) + 0.72 * np.exp(-(((x - 0.52) / 0.13) ** 2))
    ripple = 0.32 * np.sin(7 * np.pi * x + (0.45 if later else 0.0))
    return np.clip(1.42 + swell + ripple - np.where(x > 0.78, (x - 0.78) * 3.2, 0.0) + 0.1 * noise, 0.12, 3.0)


class Draws(Uniforms):
    def normal(self) -> float:
        """Box-Muller from two uniforms, both kept off zero."""
        u, v = max(self(), 1e-7), max(self(), 1e-7)
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


_SCHEMA = (
    "person string, day date, valid boolean, early boolean, bed double, wake double, duration double, in_bed double, nap boolean, nap_start double, nap_hours double, "
    "deep double, light double, rem double, profile array<double>, quality double"
)


def _night(draw: Draws, person: int, day: dt.date, share: float) -> dict:
    # The order of draws is what makes a seed's nights its own.
    early = draw() < share
    rest = 0.2 if day.weekday() >= 5 else 0.0
    bed = (23.82 if early else 24.78) + rest + draw.normal() * (0.24 if early else 0.32)
    duration = (7.35 if early else 8.02) + draw.normal() * 0.28
    wake = bed + duration + 0.35 + draw.normal() * 0.12
    nap = not early and draw() < 0.34
    valid = draw() > 0.085
    light = min(0.68, max(0.5, (0.6 if early else 0.59) + draw.normal() * 0.018))
    deep = min(0.2, max(0.1, (0.155 if early else 0.145) + draw.normal() * 0.014))
    start = 13.45 + draw.normal() * 0.32 if nap else None
    hours = min(0.8, max(0.2, 0.42 + draw.normal() * 0.11)) if nap else 0.0
    depths = profile(not early, np.array([draw.normal() for _ in range(POINTS)]))
    quality = min(1.0, max(0.45, 0.84 + draw.normal() * 0.09))
    return {"person": f"p{person + 1:02d}", "day": day, "valid": valid, "early": early, "bed": bed, "wake": wake, "duration": duration, "in_bed": wake - bed, "nap": nap, "nap_start": start,
            "nap_hours": hours, "deep": deep, "light": light, "rem": min(0.3, max(0.18, 1 - light - deep)), "profile": depths.tolist(), "quality": quality}


def days(spark: SparkSession, persons: int = PERSONS, n: int = DAYS) -> DataFrame:
    """Day rows of `persons` persons, one seeded stream of draws each; a person is one group of n days."""
    ids = spark.range(persons).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
    shares = ids.withColumn("share", early_share(F.col("k"), F.col("i")))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        person = int(pdf["k"].iloc[0])
        draw = Draws(SEED + person * STEP)
        return pd.DataFrame([_night(draw, person, FIRST + dt.timedelta(int(i)), float(s)) for i, s in zip(pdf["i"], pdf["share"], strict=True)])

    return shares.groupBy("k").applyInPandas(make, _SCHEMA)
