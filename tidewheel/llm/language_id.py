"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training row. The regression is fitted by follow-the-regularised-leader
with an elastic net on at most MAX_PER_LANG rows a language, and its probabilities are calibrated by one
temperature on rows of that sample that it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, id_and_text, remainder

BUCKETS = 1 << 15
#: Rows of each language that the regression is fitted on, at most; chosen by a hash of the id.
MAX_PER_LANG = 1200
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
SCALE = 100.0
CHUNK = 1 << 20
UNDETERMINED = "und"

_LETTER = np.zeros(0x110000, np.bool_)
_LETTER[[i for i in range(0x30000) if chr(i).isalpha()]] = True


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams of lower-cased text, all else than letters read as a space; a chunk at a time."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), CHUNK):
        c = codes[max(0, at - 2) : at + CHUNK]
        c = np.where(_LETTER[c], c, 32).astype(np.uint32)
        h1 = c * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[1:] * np.uint32(0xC2B2AE3D)
        h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
        own = 0 if at == 0 else 2  # n-grams that the chunk before has already given
        for h, n in ((h1, 1), (h2, 2), (h3, 3)):
            h = h[max(0, own - n + 1) :]
            yield (((h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)) >> np.uint32(17)).astype(np.intp)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (languages, BUCKETS), inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        s, n = np.zeros(len(self.langs)), 0
        for codes in gram_codes(text):
            n += len(codes)
            for k, w in enumerate(self.weights):
                s[k] += w.take(codes).sum(dtype=np.float64)
        return softmax((s * (SCALE / max(n, 1)) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        p = self.probabilities(text)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text in b.column("text").to_pylist():
            seen = np.zeros(BUCKETS, np.bool_)
            for codes in gram_codes(text or ""):
                seen[codes] = True
            df[np.flatnonzero(seen)] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["bucket", "df"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, n = [], []
        for text in b.column("text").to_pylist():
            codes = np.concatenate(list(gram_codes(text)))
            i, c = np.unique(codes, return_counts=True)
            at.append(i.astype(np.int32).tobytes())
            n.append((c / c.sum()).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "h", "at", "tf"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = MAX_PER_LANG) -> Model:
    """Learns from every row of docs that has a language and a letter; callers leave held-out rows out.

    No such rows give a model without languages, which calls every text undetermined.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not by_lang:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0), 1.0)
    df = np.zeros(BUCKETS)
    for bucket, n in by_batch(rows.select("text"), _frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df")).collect():
        df[bucket] = n
    total = sum(by_lang.values())
    idf = np.log((1 + total) / (1 + df)) + 0.1

    # A row's hash decides whether it is in the sample: the same rows however the table is partitioned.
    h = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) / 1_000_003.0
    share = F.lit(0.0)
    for lang, n in by_lang.items():
        share = F.when(F.col("lang") == lang, min(1.0, max_per_lang / n)).otherwise(share)
    sample = by_batch(rows.where(h < share).select("lang", F.xxhash64("id", "text", F.lit(1)).alias("h"), "text"), _counts, "lang string, h long, at binary, tf binary").collect()
    sample.sort(key=lambda r: (r["h"], r["lang"]))
    langs = sorted(by_lang)
    place = {x: k for k, x in enumerate(langs)}
    x = [(place[r["lang"]], i := np.frombuffer(r["at"], np.int32), np.frombuffer(r["tf"], np.float32) * idf[i] * SCALE) for r in sample]
    weights, bias = _ftrl([r for k, r in enumerate(x) if k % 5 or len(x) < 20], len(langs))
    held = [r for k, r in enumerate(x) if not k % 5 or len(x) < 20]
    scores = np.array([weights[:, i] @ v + bias for _, i, v in held])
    return Model(langs, (weights * idf).astype(np.float32), bias, _temperature(scores, np.array([y for y, _, _ in held])))


def _ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    z, n = np.zeros((k, BUCKETS + 1)), np.zeros((k, BUCKETS + 1))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, at, v in rows:
            at, v = np.append(at, BUCKETS), np.append(v, 1.0)
            zi, ni = z[:, at], n[:, at]
            w = weights(zi, ni)
            p = softmax(w @ v)
            p[y] -= 1
            g = np.outer(p, v)
            z[:, at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[:, at] = ni + g * g
    w = weights(z, n)
    return w[:, :-1], w[:, -1]


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a fixed grid."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 60))

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return float(min(grid, key=loss))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row for each input row; ``und`` with score 0 for null texts and texts without a letter.

    Repeated rows and null ids stay as they come, an empty table stays empty, other columns are not read.
    """
    own = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own.value
        for b in batches:
            found = [m.predict(text) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return by_batch(id_and_text(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they were, whose language is determined with min_score or more."""
    own = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own.value
        for b in batches:
            found = [m.predict(text) for text in b.column(at).to_pylist()]
            yield b.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", 4) != 2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(learned_rows(docs)))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
