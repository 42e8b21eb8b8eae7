"""MinHash near-dedup: banded MinHash finds candidates, odd sketches weed them, full shingle sets confirm.

Documents with equal shingle sets are one class, stood for by its smallest id. Each class has PERMUTATIONS
MinHash values. BANDS groups of them are bucket keys; all of them folded by parity into BITS bits are its odd
sketch, whose XOR population count with another's estimates their similarity. A bucket is led by its most central
class, the one whose buckets hold the most rows. Candidates come in rounds, each only for what the one before has
left apart; none of them forms the pairs of a group:

1. Each class is held against the class that leads most of its buckets. That is one pair a class.
2. In buckets that still hold several components, each class is held against the bucket's leader.
3. In buckets that still hold several components, classes meet by what they have unlike the bucket's leader L.
   Sets A and B reach the threshold exactly if ``|A ^ B| <= (|A| + |B|) / 7`` (symmetric difference), so with
   ``x(A) = |A ^ L| - |A| / 7`` the differences A ^ L and B ^ L must share ``(x(A) + x(B)) / 2`` shingles. Each set
   therefore shows only the rarest of its differences, as many as such an overlap can't avoid (a prefix filter);
   differences that no other set of that leader has are shown to nobody. Neither independent edits of one text
   nor a passage that many texts hold make pairs.
4. Where more than APART classes outside the largest component show one difference, as texts filled from one template
   with few alternatives do, and their pairs outnumber what follows, no pairs are formed by it. Such classes are banded anew with as many
   MinHash values a key as leave a class a fraction of a chance partner, and as many keys as find a pair at the threshold.
   The keys of n classes grow as n^1.56, not as n^2. An eighth of the keys goes first, as what it joins need not meet again.

Every candidate is confirmed on full sets, so links are exact. A pair at the threshold shares
no bucket with probability (1 - 0.75^ROWS)^BANDS, 4e-6; more similar pairs less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, by_batch, drop_written, id_and_text, mixed, salted_join, words_of, written
from .components import components

SHINGLE = 5
ROWS, BANDS = 6, 64
PERMUTATIONS = ROWS * BANDS
BITS = 2048
#: Percent of the union that the intersection must reach.
PERCENT = 75
#: Sketches below this estimate are weeded: five standard deviations under the threshold.
LEAST_ESTIMATE = 0.63
#: Shingles of recent texts that a worker keeps, 8 bytes each and their texts.
KEPT = 1_000_000
#: Classes outside the largest component that may meet all others of a group by one difference.
APART = 64
#: Finer keys draw their values from so many; classes of a template are taken to be as similar as CHANCE.
POOL, CHANCE = 2048, 0.6
#: A pair at the threshold shares no finer key with probability exp(-SURE), 2e-6 (some 1e-5 as keys draw from one pool).
SURE = 13.0
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_POOL_A = _RNG.integers(0, 1 << 32, POOL, np.uint32) | np.uint32(1)
_POOL_B = _RNG.integers(0, 1 << 32, POOL, np.uint32)
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
_PLACE = np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of fewer words, one for all; empty without words."""
    h = hashes.of(words_of(text))
    n = min(len(h), SHINGLE)
    if not n:
        return h
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = s * _MULTIPLIERS[4] + mixed(h[k : len(h) - n + 1 + k] * _MULTIPLIERS[k])
    return np.unique(mixed(s))


def minhashes(s: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    step = (2048 * PERMUTATIONS) // len(a)
    for at in range(0, len(x), step):
        np.minimum(low, (x[at : at + step, None] * a + b).min(axis=0), out=low)
    return low


def finer_rows(level: int) -> int:
    """MinHash values a key so that 4^level classes of similarity CHANCE leave a class an eighth of a chance partner in each bucket."""
    return max(ROWS, int(np.ceil(np.log(8.0 * 4.0**level) / -np.log(CHANCE))))


def drawn(rows: int) -> np.ndarray:
    """The places in the pool that the finer keys of `rows` values are made of: a row for each key."""
    keys = int(np.ceil(SURE / (PERCENT / 100) ** rows))
    return np.random.Generator(np.random.PCG64(rows)).integers(0, POOL, (keys, rows))


def finer_keys(low: np.ndarray, places: np.ndarray, level: int) -> np.ndarray:
    key = mixed(np.arange(1, len(places) + 1, dtype=np.uint64) + np.uint64(level << 32))
    for k in range(places.shape[1]):
        key = mixed(key + low[places[:, k]].astype(np.uint64) * _MULTIPLIERS[k % len(_MULTIPLIERS)])
    return key


def band_keys(low: np.ndarray) -> np.ndarray:
    v = low.reshape(BANDS, ROWS // 2, 2).astype(np.uint64)
    key = _BAND
    for k in range(ROWS // 2):
        key = mixed(key + ((v[:, k, 0] << np.uint64(32)) | v[:, k, 1]) * _MULTIPLIERS[k])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """BITS bits, each the parity of the MinHash values that fall on it, as signed longs."""
    at = (mixed(low.astype(np.uint64) | _PLACE) % np.uint64(BITS)).astype(np.intp)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fingerprint, bands, sketch) for (doc_id, text, text_hash). Without words the last three are null."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, known = WordHashes(), {}
        for b in batches:
            n, prints, bands, sketches = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, hashes)
                n.append(len(s))
                if not len(s):
                    prints.append(None), bands.append(None), sketches.append(None)
                    continue
                own = xxhash.xxh3_128_digest(s.tobytes())
                found = known.get(own)
                if found is None:
                    low = minhashes(s)
                    if len(known) >= 5000:
                        known.clear()
                    known[own] = found = band_keys(low), odd_sketch(low)
                prints.append(own), bands.append(found[0]), sketches.append(found[1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)], ["doc_id", "text_hash", "n_shingles", "fingerprint", "bands", "sketch"])

    return by_batch(docs, run, "doc_id long, text_hash long, n_shingles long, fingerprint binary, bands array<long>, sketch array<long>")


def estimate(one: Column, other: Column) -> Column:
    """Similarity by two odd sketches: the XOR's population count gives the values that differ."""
    z = F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    differ = F.log(F.greatest(1 - 2 * z / F.lit(float(BITS)), F.lit(1e-3))) * (-BITS / 2)
    return 1 - differ / (2 * PERMUTATIONS)


def similar(one: Column, other: Column) -> Column:
    """Estimate at LEAST_ESTIMATE or more, as a bound on the population count."""
    most = int(np.ceil(BITS / 2 * (1 - np.exp(-2 * 2 * PERMUTATIONS * (1 - LEAST_ESTIMATE) / BITS))))
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) <= most


def fitting(n: Column, m: Column) -> Column:
    """Sizes that allow the threshold."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with text_a and text_b. pairs is a written table; an end of many pairs is dealt over several tasks."""
    one = salted_join(pairs.select("a", "b"), texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a", "b")
    return salted_join(one, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b", "a", pairs)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, set of a, set of b) of rows with texts. Sets are kept up to KEPT shingles, as leaders come again and again."""
    hashes, kept, held = WordHashes(), {}, 0
    for batch in batches:
        for a, b, *both in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            sets = []
            for text in both:
                if (s := kept.get(text)) is None:
                    s = shingle_set(text, hashes)
                    if held + len(s) > KEPT:
                        kept.clear()
                        held = 0
                    kept[text] = s
                    held += len(s)
                sets.append(s)
            yield a, b, *sets


def _tables(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """rows as batches that hold about a million values at most."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 4 + sum(len(x) for x in row if isinstance(x, np.ndarray))
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts' sets reach PERCENT, with both counts: (a, b, both, either)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple]:
            for a, b, s, t in _sets(batches):
                both = len(np.intersect1d(s, t, assume_unique=True))
                either = len(s) + len(t) - both
                if 100 * both >= PERCENT * either:
                    yield a, b, both, either

        yield from _tables(links(), [pa.int64()] * 4, ["a", "b", "both", "either"])

    return by_batch(_with_texts(pairs, texts), run, "a long, b long, both long, either long")


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, apart): the sizes of both shingle sets and the shingles that only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((a, b, len(s), len(t), np.setxor1d(s, t, assume_unique=True).view(np.int64)) for a, b, s, t in _sets(batches))
        yield from _tables(rows, [pa.int64()] * 4 + [pa.list_(pa.int64())], ["a", "b", "n_a", "n_b", "apart"])

    return by_batch(_with_texts(pairs, texts), run, "a long, b long, n_a long, n_b long, apart array<long>")


def _led(banded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets that hold several classes: (key, class_id, leader), and the leader (class_id, a) that most buckets of a class have.

    A bucket's leader is first its most central class, then the one that leads most buckets of that, so that the
    buckets of a group have few leaders; it need not be in the bucket.
    """
    sizes = written(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    held = written(salted_join(banded, sizes.select("key", F.col("n").alias("size")), "key", "class_id", sizes=sizes).distinct(), "held")
    central = held.groupBy("class_id").agg(F.sum("size").alias("weight"))
    leaders = held.join(central, "class_id").groupBy("key").agg(F.max_by("class_id", F.struct("weight", -F.col("class_id"))).alias("leader"))
    rows = written(salted_join(held.select("key", "class_id"), leaders, "key", "class_id"), "led")
    by = rows.groupBy("class_id", "leader").agg(F.count("*").alias("n"))
    lead = written(by.groupBy("class_id").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("a")), "lead")
    over = salted_join(rows, lead.select(F.col("class_id").alias("leader"), F.col("a").alias("over")), "leader", "class_id")
    shared = written(over.select("key", "class_id", F.col("over").alias("leader")), "shared")
    drop_written(sizes, held, rows)
    return shared, lead


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (key, class_id, leader) of buckets that hold several components, with root and the root of the bucket's leader."""
    own = lambda x, root: roots.select(F.col("node").alias(x), F.col("root").alias(root))
    rooted = rows.select("key", "class_id", "leader").join(own("class_id", "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    by = rooted.groupBy("key", "leader").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    by = by.join(own("leader", "leader_root"), "leader", "left").select("key", F.coalesce("leader_root", "leader").alias("leader_root"))
    return written(salted_join(rooted, by, "key", "class_id", rows), "open")


def _shown(open_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(leader, h, class_id, root, inside, short, rest, need): the differences to its leaders by which a class is to be found.

    inside: in the leader's component, so that a partner is outside and has x > |L| / 7. A class outside may meet
    one inside (x >= -|L| / 7) by any of its shown differences, one outside by those marked short. rest: the
    differences that come after h; need: 7 x.
    """
    stars = open_rows.where("class_id <> leader").groupBy("leader", "class_id").agg(F.first("root").alias("root"), F.first("leader_root").alias("leader_root"))
    stars = written(stars, "stars")
    pairs = written(stars.select(F.col("leader").alias("a"), F.col("class_id").alias("b")), "pairs")
    apart = written(differences(pairs, texts).withColumnsRenamed({"a": "leader", "b": "class_id"}), "apart")
    each = written(apart.select("leader", "class_id", F.explode("apart").alias("h")), "each")
    often = each.groupBy("leader", "h").agg(F.count("*").alias("df")).where("df > 1")
    common = salted_join(each.withColumn("at", F.struct("leader", "h")), often.select(F.struct("leader", "h").alias("at"), "df"), "at", "class_id")
    by = Window.partitionBy("leader", "class_id")
    ranked = common.select("leader", "class_id", "h", F.row_number().over(by.orderBy("df", "h")).alias("rank"), F.count("*").over(by).alias("common"))
    facts = apart.join(stars, ["leader", "class_id"]).select("leader", "class_id", "root", (F.col("root") == F.col("leader_root")).alias("inside"), F.size("apart").alias("size"), "n_a", "n_b", (7 * F.size("apart") - F.col("n_b")).alias("need"))
    # Twice the overlap at least, in sevenths: 7 |A ^ L| - |A| + |L| with a partner outside, - |L| with one inside.
    twice = lambda sign: F.col("need") + sign * F.col("n_a")
    most = lambda sign: F.col("size") - F.ceil(F.greatest(twice(sign), F.lit(0)) / 14) + 1
    placed = ranked.join(facts, ["leader", "class_id"]).withColumn("place", F.col("size") - F.col("common") + F.col("rank"))
    short = F.col("place") <= most(1)
    shown = placed.where(short | (~F.col("inside") & (F.col("place") <= most(-1))))
    out = written(shown.select("leader", "h", "class_id", "root", "inside", short.alias("short"), (F.col("size") - F.col("place")).alias("rest"), "need"), "shown")
    drop_written(stars, pairs, apart, each)
    return out


def _level(n: Column) -> Column:
    """The power of 4 that n classes need."""
    return F.ceil(F.log(n.cast("double")) / F.log(F.lit(4.0)) - 1e-9)


def _groups(shown: DataFrame) -> DataFrame:
    """shown with at (leader and difference), main (the largest component there) and apart (classes outside it), where several components meet.

    crowd: more than APART classes are outside, and over its leader such groups have more pairs than finer keys.
    """
    many = shown.groupBy("leader", "h", "root").agg(F.count("*").alias("n")).groupBy("leader", "h").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("apart"))
    few = many.where("roots > 1").select(F.struct("leader", "h").alias("at"), "main", "apart")
    held = written(salted_join(shown.withColumn("at", F.struct("leader", "h")), few, "at", "class_id"), "groups")
    by = held.where(F.col("apart") > APART).groupBy("leader").agg(F.sum("apart").alias("pairs"), F.count_distinct("class_id").alias("n"))
    keys = SURE / F.pow(F.lit(PERCENT / 100), F.ceil(F.log(8 * F.pow(F.lit(4.0), _level(F.col("n")))) / -np.log(CHANCE)))
    crowds = by.where(F.col("pairs") > F.col("n") * keys).select("leader", F.lit(True).alias("crowd"))
    return held.join(crowds, "leader", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)) & (F.col("apart") > APART))


def _met(groups: DataFrame, side: Callable[[str], DataFrame], near: Column) -> DataFrame:
    """(a, b): classes of different components that show one difference to one leader, where near holds.

    In each group one side leaves out the largest component. Crowds are left to finer keys.
    """
    half = lambda x, rows: rows.select("at", F.col("class_id").alias(x), F.col("root").alias(f"root_{x}"), F.col("inside").alias(f"inside_{x}"), F.col("short").alias(f"short_{x}"), F.col("rest").alias(f"rest_{x}"), F.col("need").alias(f"need_{x}"), (F.col("root") == F.col("main")).alias(f"main_{x}")).join(side(x), x)
    allowed = (F.col("inside_a") != F.col("inside_b")) | (F.col("short_a") & F.col("short_b"))
    # At the first difference that both show, what follows it must hold the rest of the overlap.
    allowed = allowed & (14 * (1 + F.least("rest_a", "rest_b")) >= F.col("need_a") + F.col("need_b"))
    once = F.col("main_b") | (F.col("root_a") < F.col("root_b"))
    cold = groups.where(~F.col("crowd"))
    both = salted_join(half("b", cold), half("a", cold.where("root <> main")), "at", "b", cold)
    return both.where((F.col("root_a") != F.col("root_b")) & once & allowed & near).select("a", "b").distinct()


def _finer(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, class_id, first) for the classes (leader, class_id) of crowds: keys as fine as the crowd of a leader needs.

    Classes of one leader share a fineness, and most of a class's leaders ask for the same. first marks an eighth of the keys. A written table.
    """
    sizes = crowd.groupBy("leader").agg(F.count("*").alias("n"))
    levels = salted_join(crowd, sizes, "leader", "class_id").groupBy("class_id").agg(F.collect_set(_level(F.col("n"))).alias("levels"))
    sized = levels.join(texts.withColumnRenamed("doc_id", "class_id"), "class_id").select("class_id", "levels", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = WordHashes(), {}
        for batch in batches:
            for class_id, levels, text in zip(*(batch.column(c).to_pylist() for c in ("class_id", "levels", "text")), strict=True):
                low = minhashes(shingle_set(text, hashes), _POOL_A, _POOL_B)
                for level in levels:
                    if level not in places:
                        places[level] = drawn(finer_rows(level))
                    keys = finer_keys(low, places[level], level).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), class_id)), pa.array(np.arange(len(keys)) % 8 == 0)], ["key", "class_id", "first"])

    return written(by_batch(sized, run, "key long, class_id long, first boolean"), "finer")


def _crowded(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): classes of different components that share a finer key; one side leaves out the bucket's largest component."""
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    held = salted_join(keys, shared, "key", "class_id").select("key", "class_id")
    rooted = written(held.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id")), "rooted")
    many = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1").select("key", "main")
    open_rows = written(salted_join(rooted, many, "key", "class_id"), "crowds")
    half = lambda x, rows: rows.select("key", F.col("class_id").alias(x), F.col("root").alias(f"root_{x}"), (F.col("root") == F.col("main")).alias(f"main_{x}"))
    both = salted_join(half("b", open_rows), half("a", open_rows.where("root <> main")), "key", "b", open_rows)
    pairs = written(both.where((F.col("root_a") != F.col("root_b")) & (F.col("main_b") | (F.col("root_a") < F.col("root_b")))).select("a", "b").distinct(), "pairs")
    drop_written(rooted, open_rows)
    return pairs


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, roots). rows: (doc_id, text_hash, n_shingles, class_id) for each input row; links between classes: (a, b, both, either);
    roots: (node, root) of classes with links.

    Rows of one id are one node. Null ids, null texts and texts without words have a null class.
    """
    own = id_and_text(docs, id_col, text_col)
    every = written(features(own.withColumn("text_hash", F.xxhash64("text"))), "features")
    can = every.where(F.col("doc_id").isNotNull() & F.col("fingerprint").isNotNull())
    classes = written(can.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "prints")
    stands = F.col("doc_id") == F.col("class_id")
    named = written(salted_join(every.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fingerprint")).alias("fingerprint")).where("fingerprint is not null"), classes, "fingerprint", "doc_id"), "rows")
    rows = named.select("doc_id", "text_hash", "n_shingles", "class_id").unionAll(every.where(F.col("doc_id").isNull() | F.col("fingerprint").isNull()).select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long")))
    first = named.where(stands).select(F.col("doc_id").alias("class_id"), "fingerprint").distinct()
    reps = written(can.withColumnRenamed("doc_id", "class_id").join(first, ["class_id", "fingerprint"], "left_semi").dropDuplicates(["class_id", "fingerprint"]).select("class_id", "n_shingles", "bands", "sketch"), "classes")

    # Nearly all keys are a class's own: they are counted as they are read, and only shared ones become a table.
    shared, lead = _led(reps.select("class_id", F.explode("bands").alias("key")))
    ids = shared.select(F.col("class_id").alias("doc_id")).distinct()
    texts = written(own.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    sketches = reps.select("class_id", "n_shingles", "sketch")
    side = lambda x: sketches.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    near = fitting(F.col("n_a"), F.col("n_b")) & similar(F.col("sketch_a"), F.col("sketch_b"))
    weeded = lambda pairs: written(pairs.join(side("b"), "b").join(side("a"), "a").where(near).select("a", "b"), "pairs")
    links = roots = None

    def found(pairs: DataFrame) -> bool:
        nonlocal links, roots
        more = written(confirmed(pairs, texts), "links")
        drop_written(pairs)
        if links is not None and more.isEmpty():
            return False
        known = more.select("a", "b") if links is None else roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(more.select("a", "b"))
        links = more if links is None else links.unionAll(more)
        roots = written(components(known), "roots")
        return True

    found(weeded(lead.where("a <> class_id").select("a", F.col("class_id").alias("b"))))
    open_rows = _open(shared, roots)
    second = open_rows.where("root <> leader_root").select(F.col("leader").alias("a"), F.col("class_id").alias("b")).distinct()
    if found(weeded(second)):
        open_rows = _open(open_rows, roots)
    shown = _shown(open_rows, texts)
    groups = written(_groups(shown), "groups")
    found(written(_met(groups, side, near), "pairs"))
    crowd = written(groups.where("crowd").select("leader", "class_id").distinct(), "crowd")
    if not crowd.isEmpty():
        keys = _finer(crowd, texts)
        for part in (F.col("first"), ~F.col("first")):
            found(weeded(_crowded(keys.where(part).select("key", "class_id"), roots)))
        drop_written(keys)
    drop_written(texts, shared, lead, open_rows, shown, groups, crowd)
    return rows, links, roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id, text_hash), a row for each input row; text_hash is xxhash64 of the text.

    component_id is the smallest id that links reach, the own id without a class; kept where both are equal.
    A null id has a null component and is kept, as nothing stands for it. An empty table stays empty.
    """
    rows, _, roots = link_classes(docs, id_col, text_col)
    found = rows.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    component = F.coalesce("root", "class_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"), "class_id", "text_hash")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
