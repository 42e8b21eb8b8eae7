"""Toxicity: class-conditional Kneser-Ney models of how words are spelled.

A word is read byte by byte between a start and an end mark, each byte after the ORDER - 1 before it. For each class

    P(byte | context) = max(c(context byte) - D, 0) / c(context) + D T(context) / c(context) * P(byte | shorter context)

with c the number of documents of the class whose words go on so, T the number of different bytes that follow and D = DISCOUNT.
The shorter contexts belong to both classes together and count by continuation,
by how many different bytes a string follows, each order with a discount estimated from its own counts; so rare expressions and unseen
inflections of toxic stems get their share from what the classes have in common. A context that a class has not
seen has the shared probability. All of these sum to one.

A word's value is the log ratio of its likelihoods, toxic over ordinary. A text is judged by length-normalised
log ratios, of itself and of its most toxic stretches of 1, 4 and 16 words, put together by a logistic
function fitted on rows that the models of the other fold have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, id_and_text, plain_words, remainder

#: Labelled rows of each class that the models are fitted on, at most; chosen by a hash.
MAX_PER_CLASS = 4000
#: Bytes that are read together.
ORDER = 12
#: Discount of the classes' own counts. High, so that what one document of a class holds says little of the class.
DISCOUNT = 0.9
CUTOFF = 0.3
CACHED_WORDS = 300_000
#: Words of a stretch.
STRETCHES = (1, 4, 16)
FEATURES = len(STRETCHES) + 1
_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that may follow: 256 and the end mark. The start mark is no byte either.
SYMBOLS = 257


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Strings:
    """Hashes of the strings of some words: symbols are bytes + 2, 1 at the start, 258 at the end."""

    def __init__(self, words: list[bytes]):
        n = np.fromiter(map(len, words), np.int64, len(words)) + 2
        flat = np.empty(int(n.sum()), np.uint64)
        first = np.cumsum(n) - n
        inside = np.ones(len(flat), np.bool_)
        inside[first] = inside[first + n - 1] = False
        flat[first], flat[first + n - 1] = 1, 258
        flat[inside] = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(2)
        self.word = np.repeat(np.arange(len(words)), n)
        self.at = np.arange(len(flat)) - first[self.word]
        powers = np.cumprod(np.full(int(n.max(initial=1)) + 1, _B, np.uint64))
        self.inverse = np.cumprod(np.full(int(n.max(initial=1)) + 1, _INVERSE, np.uint64))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat * powers[self.at])))
        self.read = np.flatnonzero(self.at > 0)  # places of symbols that are read

    def of(self, places: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        """Hashes of the k symbols that end at these places; the caller sees to it that they lie in one word."""
        start = self.at[places] - k + 1
        return _mixed((self.total[places + 1] - self.total[places + 1 - k]) * self.inverse[start] + np.uint64(0x51ED2701) * np.asarray(k, np.uint64))


def _discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), the usual estimate, kept off the ends."""
    one, two = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return float(np.clip(one / (one + 2 * two), 0.1, 0.9)) if one else 0.5


def _smoothed(c: np.ndarray, context: np.ndarray, m: int, lower: np.ndarray, d: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of strings with these counts, weight of the shorter context for each context)."""
    d = _discount(c) if d is None else d
    total, kinds = np.bincount(context, weights=c, minlength=m), np.bincount(context, weights=c > 0, minlength=m)
    rest = np.where(total > 0, d * kinds / np.maximum(total, 1e-300), 1.0)
    return np.maximum(c - d, 0) / np.maximum(total[context], 1e-300) + rest[context] * lower, rest


@dataclass
class Spelling:
    """Strings by hash with the log ratio of their last symbol; contexts by hash with that of a symbol never seen there."""

    keys: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    rests: np.ndarray

    def of(self, words: list[bytes]) -> np.ndarray:
        """Log ratio of each word, toxic over ordinary."""
        if not words or not len(self.keys):
            return np.zeros(len(words))
        s = Strings(words)
        k = np.minimum(s.at[s.read] + 1, ORDER)
        h = s.of(s.read, k)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        step = np.where(known, self.values[at], 0.0)
        new = np.flatnonzero(~known)
        if len(new):
            h = s.of(s.read[new] - 1, k[new] - 1)
            at = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
            step[new] = np.where(self.contexts[at] == h, self.rests[at], 0.0)
        return np.bincount(s.word[s.read], weights=step, minlength=len(words))


def fitted(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> dict:
    """Everything of both models: keys of the longest strings, p (2, strings), context of each, rest (2, contexts), lower, context keys.

    Strings that begin with the start mark are counted as they are, whatever their length; nothing can stand before them.
    """
    s = Strings(words)
    shared = None  # (sorted keys, probabilities) of the order below
    for k in range(1, ORDER):
        places = s.read[s.at[s.read] >= k]  # no start mark inside, and a symbol before
        longer = np.unique(s.of(places, k + 1), return_index=True)[1]
        places = places[longer]
        keys, first, at = np.unique(s.of(places, k), return_index=True, return_inverse=True)
        c = np.bincount(at, minlength=len(keys)).astype(float)  # different symbols before it
        own = places[first]
        if k == 1:
            p, _ = _smoothed(c, np.zeros(len(keys), np.int64), 1, np.full(len(keys), 1.0 / SYMBOLS))
        else:
            contexts, context = np.unique(s.of(own - 1, k - 1), return_inverse=True)
            p, _ = _smoothed(c, context, len(contexts), shared[1][np.searchsorted(shared[0], s.of(own, k - 1))])
        if k == 1:
            orders = [(keys, p)]
        else:
            orders.append((keys, p))
        shared = keys, p
    k = np.minimum(s.at[s.read] + 1, ORDER)
    keys, first, at = np.unique(s.of(s.read, k), return_index=True, return_inverse=True)
    own, k = s.read[first], k[first]
    lower = np.empty(len(keys))
    for n in range(2, ORDER + 1):
        rows = np.flatnonzero(k == n)
        lower[rows] = orders[n - 2][1][np.searchsorted(orders[n - 2][0], s.of(own[rows], n - 1))]
    contexts, context = np.unique(s.of(own - 1, k - 1), return_inverse=True)
    both = [_smoothed(np.bincount(at, weights=x[s.word[s.read]], minlength=len(keys)), context, len(contexts), lower, DISCOUNT) for x in (toxic, ordinary)]
    return {"keys": keys, "context": context, "contexts": contexts, "lower": lower, "p": np.stack([p for p, _ in both]), "rest": np.stack([r for _, r in both]), "orders": orders}


def spelling(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> Spelling:
    """Log ratios of both models from the numbers of toxic and ordinary documents that hold each word."""
    some = np.flatnonzero(toxic + ordinary > 0)
    words, toxic, ordinary = [words[i] for i in some], toxic[some], ordinary[some]
    if not words:
        return Spelling(*(np.zeros(0, t) for t in (np.uint64, np.float64, np.uint64, np.float64)))
    f = fitted(words, toxic, ordinary)
    ratio = lambda x: np.log(x[0]) - np.log(x[1])
    return Spelling(f["keys"], ratio(f["p"]), f["contexts"], ratio(f["rest"]))


def text_features(values: np.ndarray) -> tuple[float, ...]:
    """Mean log ratios for each word, of the most toxic stretch of each length and of the whole text; 0 without words."""
    n = len(values)
    if not n:
        return (0.0,) * FEATURES
    total = np.concatenate((np.zeros(1), np.cumsum(values)))
    best = [float((total[w:] - total[:-w]).max() / w) for w in (min(w, n) for w in STRETCHES)]
    return *best, float(total[-1] / n)


class Values(dict):
    """Words' values, kept for a bounded number of words; new words of several texts are looked up together."""

    def __init__(self, model: Spelling):
        super().__init__()
        self.model = model

    def features(self, texts: list[str | None]) -> Iterator[tuple[float, ...]]:
        for at in range(0, len(texts), 64):
            words = [plain_words(t) for t in texts[at : at + 64]]
            new = list(set().union(*words).difference(self))
            if len(self) + len(new) > CACHED_WORDS:
                self.clear()
                new = list(set().union(*words))
            self.update(zip(new, self.model.of(new).tolist(), strict=True))
            for ws in words:
                yield text_features(np.fromiter(map(self.__getitem__, ws), np.float64, len(ws)))


@dataclass
class Model:
    spelling: Spelling
    weights: np.ndarray

    def score(self, f: tuple[float, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + np.dot(self.weights[1:], f), -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the penalty keeps separable classes finite."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.01] + [penalty] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, g)
        w = w - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> Model:
    """Learns from rows of docs whose id has a label of 0 or 1; callers leave held-out rows out.

    An id with several labels is toxic if one is. Without rows of both classes every score is 0.01.
    """
    none = Model(spelling([], np.zeros(0), np.zeros(0)), np.append(np.log(0.01 / 0.99), np.zeros(FEATURES)))
    toxic = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = {r["y"]: r["count"] for r in toxic.groupBy("y").count().collect()}
    if len(n) < 2:
        return none
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    picked = toxic.where(h < F.when(F.col("y") == 1, min(1.0, max_per_class / n[1])).otherwise(min(1.0, max_per_class / n[0])))
    # At most twice max_per_class ids, about: a bounded side.
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [list(set(plain_words(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("fold"), pa.array(own, pa.list_(pa.binary()))], ["y", "fold", "words"])

    counted = by_batch(rows.select("y", "fold", "text"), words, "y int, fold int, words array<binary>").select("y", "fold", F.explode("words").alias("word"))
    n_of = lambda y, fold: F.sum(((F.col("y") == y) & (F.col("fold") == fold)).cast("long")).alias(f"n{y}{fold}")
    t = counted.groupBy("word").agg(*(n_of(y, f) for y in (0, 1) for f in (0, 1))).toArrow()
    every = t.column("word").to_pylist()
    c = {k: t.column(k).to_numpy().astype(float) for k in ("n00", "n01", "n10", "n11")}
    folds = [spelling(every, c[f"n1{f}"], c[f"n0{f}"]) if (c[f"n1{f}"].any() and c[f"n0{f}"].any()) else None for f in (0, 1)]
    whole = spelling(every, c["n10"] + c["n11"], c["n00"] + c["n01"])
    if None in folds:
        return none
    own = docs.sparkSession.sparkContext.broadcast(folds)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [Values(m) for m in own.value]
        for b in batches:
            texts, fold = b.column("text").to_pylist(), b.column("fold").to_pylist()
            got = [next(values[1 - f].features([x])) for x, f in zip(texts, fold, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array([g[k] for g in got], pa.float64()) for k in range(FEATURES))], ["y", *names])

    names = [f"x{k}" for k in range(FEATURES)]
    f = by_batch(rows.select("y", "fold", "text"), features, "y int, " + ", ".join(f"{c} double" for c in names)).toArrow()
    y = f.column("y").to_numpy().astype(float)
    x = np.column_stack([f.column(c).to_numpy() for c in names])
    if not len(y):
        return none
    share = n[1] / (n[0] + n[1])
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return Model(whole, _logistic(x, y, weight))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, word_ratio, stretch_ratio, text_ratio), a row for each input row; empty and null texts have ratios of 0.

    word_ratio and stretch_ratio are those of the most toxic word and stretch of 4 words.

    Repeated rows and null ids stay as they come; an empty table stays empty; other columns are not read.
    """
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own.value
        values = Values(m.spelling)
        for b in batches:
            f = list(values.features(b.column("text").to_pylist()))
            columns = [pa.array([m.score(x) for x in f], pa.float64()), *(pa.array([x[k] for x in f], pa.float64()) for k in (0, 1, FEATURES - 1))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "score", "word_ratio", "stretch_ratio", "text_ratio"])

    return by_batch(id_and_text(docs, id_col, text_col), run, "doc_id long, score double, word_ratio double, stretch_ratio double, text_ratio double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    keep = remainder("doc_id", 4) != 2
    found = score(docs, train(docs.where(keep), labels.where(keep)))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "word_ratio", "stretch_ratio", "text_ratio")
