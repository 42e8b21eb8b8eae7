"""Column helpers: clamping, rounding, labels, seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def finite(x: Column) -> Column:
    """x, or null where it is no finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, below zero as well."""
    return F.floor(x + 0.5)


def rounded(x: Column, digits: int) -> Column:
    """x at so many digits, a half away from zero, as judged after scaling: digits that only the printed value has do not decide."""
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / 10.0**digits).otherwise(x)


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def is_rest_day(day: Column) -> Column:
    """Saturday or Sunday; a missing day is no rest day."""
    return F.coalesce(F.dayofweek(day).isin(1, 7), F.lit(False))


def clock_label(hours: Column) -> Column:
    """Decimal hours, of any day, as a 12-hour clock; 60 rounded minutes carry."""
    total = F.pmod(half_up(hours * 60), F.lit(1440))
    hour = F.floor(total / 60)
    twelve = F.when(F.pmod(hour, F.lit(12)) == 0, 12).otherwise(F.pmod(hour, F.lit(12)))
    return F.concat(twelve.cast("string"), F.lit(":"), F.lpad(F.pmod(total, F.lit(60)).cast("string"), 2, "0"), F.when(hour < 12, " AM").otherwise(" PM"))


def duration_label(hours: Column) -> Column:
    total = half_up(hours * 60)
    return F.concat(F.floor(total / 60).cast("string"), F.lit("h "), F.lpad((total % 60).cast("string"), 2, "0"), F.lit("m"))


def bpm_range(count: Column, low: Column, high: Column) -> Column:
    """Rounded beats a minute, as one number or a span; where nothing was counted, words that say so."""
    a, b = half_up(low), half_up(high)
    span = F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))
    return F.when(F.coalesce(count, F.lit(0)) > 0, F.concat(span, F.lit(" bpm"))).otherwise("not enough data")


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def distance(xs: list[Column], ys: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(x - y) * (x - y) for x, y in zip(xs, ys, strict=True)]))


def extended_hour(ts: Column) -> Column:
    """Hours since midnight; those before 18:00 belong to the evening before, and get 24 more."""
    h = F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600
    return F.when(h < 18, h + 24).otherwise(h)


def times32(a: Column, b: int) -> Column:
    """a * b modulo 2**32 without leaving 64 bits: the halves of b one at a time."""
    low, high = b & 0xFFFF, b >> 16
    return F.pmod(F.pmod(a * low, F.lit(1 << 32)) + F.pmod(F.pmod(a * high, F.lit(1 << 32)) * 65536, F.lit(1 << 32)), F.lit(1 << 32))


def text_seed(text: Column, salt: int = 0) -> Column:
    """A 32-bit multiply-xor hash of a text's code points."""
    start = F.lit((2166136261 ^ salt) & 0xFFFFFFFF).cast("bigint")
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(F.filter(codes, lambda c: c > 0), start, lambda h, c: times32(h.bitwiseXOR(c), 16777619))
