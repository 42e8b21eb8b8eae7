"""Seeded randomness as columns: any value of a published 32-bit generator by its place, and shuffles made of such values.

Every value can be had by itself, so streams need no state: a run of a long test starts where its place says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linear import let

_ALL = 1 << 32
# Fixed value: what the generator's state grows by.
STEP = 0x6D2B79F5


def product32(a: Column, b: Column) -> Column:
    """a * b modulo 2**32 of two values below 2**32, by 16-bit halves of b, so that no product leaves 64 bits."""
    low, high = a * b.bitwiseAND(F.lit(0xFFFF)), F.pmod(a * F.shiftright(b, 16), F.lit(_ALL)) * 65536
    return F.pmod(F.pmod(low, F.lit(_ALL)) + F.pmod(high, F.lit(_ALL)), F.lit(_ALL))


def uniform(seed: Column, place: Column) -> Column:
    """The value at a place, from 1, of the generator started with a 32-bit seed: a double from 0 to under 1."""
    wide = lambda v: F.lit(v).cast("bigint")
    state = F.pmod(seed.cast("bigint") + product32(wide(STEP), F.pmod(place.cast("bigint"), wide(_ALL))), wide(_ALL))
    first = lambda s: product32(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(wide(1)))
    second = lambda t: t.bitwiseXOR(F.pmod(t + product32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(wide(61))), wide(_ALL)))
    last = lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / float(_ALL)
    return let(state, lambda s: let(first(s), lambda t: let(second(t), last)))


def shuffled(n: Column, seed: Column, skip: Column) -> Column:
    """0 to n - 1, each place from the last one down exchanged with one at or before it; the stream's first `skip` values are passed over."""
    exchanged = lambda order, i, j: F.transform(order, lambda v, p: F.when(p == i, order[j]).when(p == j, order[i]).otherwise(v))
    step = lambda order, k: let(F.floor(uniform(seed, skip + k) * (n - k + 1)).cast("int"), lambda j: exchanged(order, (n - k).cast("int"), j))
    whole = F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1)
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int") - 1, F.lit(1))), whole, step)).when(n == 1, whole).otherwise(F.array().cast("array<int>"))


def block_order(n: Column, block: int, seed: Column, run: Column) -> Column:
    """0 to n - 1 in blocks of neighbours, the blocks shuffled; runs, from 0, follow one another in the seed's stream. The last block may be short."""
    count = F.ceil(n / block)
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(shuffled(count, seed, run * F.greatest(count - 1, F.lit(0))), lambda b: F.slice(every, b * block + 1, F.lit(block))))
