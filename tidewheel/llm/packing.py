"""Packing: cutting-stock column generation over a histogram of piece lengths.

Documents are cut into full sequences and one rest. Rests are counted by length in steps of STEP tokens;
the linear program over patterns of such lengths is solved by column generation, where a knapsack dynamic
program prices new patterns. Rounded patterns then take documents by their rank among those of equal length.
The histogram, the patterns and the plan have sizes set by STEP alone, never by the number of documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, id_and_text, written

CAPACITY = 2048
STEP = 8
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Rows of one rank group, about; larger groups of equal length are split by a hash.
GROUP_ROWS = 4_000
CACHED_WORDS = 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: its own if it shows, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


_LETTERS = byte_letters()


class Ids:
    """Token ids of texts as bytes (little-endian unsigned 32-bit), piece by piece with a bounded memory of pieces.

    The tokenizer lower-cases, drops white space and cuts a text into runs of letters, single digits, endings like 's and runs of marks; it never joins
    across a cut. Texts of Latin-1 characters are cut the same way here and a new piece goes to the model as it is, so a word has one entry whatever its case and
    the marks after it. Other texts are cut at spaces. Their new words are encoded together, with a special token between them.
    """

    MARK = "<|endoftext|>"
    #: Control characters, rare spaces and all beyond Latin-1.
    OTHER = re.compile("[^\t\n\r -~\xa1-\xff]")
    #: What may open a special token.
    SPECIAL = "<|"
    #: The tokenizer's cut of lower-cased Latin-1.
    PIECE = re.compile("[{0}]+|'(?:[stmd]|re|ve|ll)|[{1}]|[^\t\n\r {0}{1}]+".format("a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"))

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.mark = self.model.token_to_id(self.MARK)
        self.most = most
        self.known: dict[str, bytes] = {"": b""}

    def odd(self, text: str) -> bool:
        return self.SPECIAL in text or self.OTHER.search(text) is not None

    def cut(self, text: str | None) -> list[str]:
        """What a text's ids are the ids of, one after another."""
        if not text:
            return []
        return text.replace("\n", " ").split(" ") if self.odd(text) else self.PIECE.findall(text.lower())

    def piece(self, s: str) -> bytes:
        """Ids of one piece of a cut text, which the model takes as it is."""
        return np.array([t.id for t in self.model.model.tokenize(s if s.isascii() else "".join(map(_LETTERS.__getitem__, s.encode())))], "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        joined = []
        for w in words:
            if not self.odd(w):
                own = self.PIECE.findall(w.lower())
                for p in own:
                    if p not in self.known:
                        self.known[p] = self.piece(p)
                self.known[w] = b"".join(map(self.known.__getitem__, own))
            elif self.SPECIAL in w:
                self.known[w] = np.array(self.model.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                joined.append(w)
        for at in range(0, len(joined), 2000):
            part = joined[at : at + 2000]
            ids = np.array(self.model.encode(self.MARK.join(part), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            begin = 0
            for w, end in zip(part, ends.tolist(), strict=True):
                self.known[w] = ids[begin:end].tobytes()
                begin = end + 1

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 64):
            words = [self.cut(t) for t in texts[at : at + 64]]
            new = set().union(*words).difference(self.known)
            if len(self.known) + len(new) > self.most:
                self.known = {"": b""}
                new = set().union(*words).difference(self.known)
            self.learn(list(new))
            for ws in words:
                yield b"".join(map(self.known.__getitem__, ws))


@lru_cache(maxsize=1)
def _ids(path: str) -> Ids:
    """A worker's memory of pieces, over all its tasks."""
    return Ids(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full sequences and a rest. A null text is the end id alone."""
    path = path or tokenizer_path()
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for b in batches:
            out: list[tuple] = []
            for doc, own in zip(b.column("doc_id").to_pylist(), ids.of(b.column("text").to_pylist()), strict=True):
                own += end
                out += [(doc, at // 4, min(width, len(own) - at) // 4, zlib.crc32(own[at : at + width]), len(own) // 4) for at in range(0, len(own), width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return by_batch(id_and_text(docs, id_col, text_col), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of lengths 1..len(worth) of greatest worth that fit."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, len(worth))
        v = best[c - m : c][::-1] + worth[:m]
        k = int(v.argmax())
        best[c], last[c] = (v[k], k + 1) if v[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    a, c = np.zeros(len(worth)), capacity
    while c > 0:
        if last[c]:
            a[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), a


def patterns(demand: np.ndarray, capacity: int, most: int = 6000) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of the linear program's basis, by column generation with a revised simplex.

    demand[i] pieces of length i + 1. Each basis is feasible, so stopping after `most` columns still covers all.
    """
    rows = np.flatnonzero(demand)
    m = len(rows)
    if not m:
        return []
    lengths = rows + 1
    columns = [np.eye(m)[k] * (capacity // lengths[k]) for k in range(m)]
    inverse = np.diag([1.0 / c.sum() for c in columns])
    x = inverse @ demand[rows].astype(float)
    for _ in range(most):
        worth = np.zeros(capacity)
        worth[rows] = np.maximum(inverse.sum(axis=0), 0.0)
        value, full = price(worth[: lengths[-1]], capacity)
        if value <= 1 + 1e-7:
            break
        a = full[rows]
        d = inverse @ a
        able = d > 1e-9
        if not able.any():
            break
        ratios = np.where(able, x / np.where(able, d, 1), np.inf)
        k = int(ratios.argmin())
        step = max(ratios[k], 0.0)
        x = np.maximum(x - step * d, 0)
        x[k] = step
        inverse[k] /= d[k]
        others = np.arange(m) != k
        inverse[others] -= np.outer(d[others], inverse[k])
        columns[k] = a
    out = []
    for c, t in zip(columns, x, strict=True):
        p = np.zeros(capacity, np.int64)
        p[rows] = np.round(c).astype(np.int64)
        out.append((p, float(t)))
    return out


def plan(demand: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, pieces a sequence, first sequence): which ranks go to which sequences.

    Patterns are used the whole number of times below the program's; what is left, at most a few
    sequences for each length, is packed longest first into the fullest sequence that has room.
    """
    left, out, sequence = demand.astype(np.int64).copy(), [], 0
    taken = np.zeros(capacity, np.int64)

    def use(p: np.ndarray, times: int) -> None:
        nonlocal sequence
        for i in np.flatnonzero(p):
            n = int(p[i]) * times
            out.append((int(i) + 1, int(taken[i]), int(taken[i]) + n, int(p[i]), sequence))
            taken[i] += n
            left[i] -= n
        sequence += times

    for p, x in sorted(patterns(demand, capacity), key=lambda r: -r[1]):
        times = int(x + 1e-6)
        used = p > 0
        if used.any():
            times = min([times, *(left[used] // p[used]).tolist()])
            if times > 0:
                use(p, times)
    while left.any():
        # One pattern of what is left: longest first. Used as often as the rest allows.
        p, room = np.zeros(capacity, np.int64), capacity
        for i in np.flatnonzero(left)[::-1]:
            k = min(int(left[i]), room // (int(i) + 1))
            p[i], room = k, room - k * (int(i) + 1)
        used = p > 0
        use(p, int((left[used] // p[used]).min()))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """cut with sequence_id and offset. Pieces of a sequence lie without gaps from offset 0.

    Rows with equal ids and pieces are interchangeable, so ties leave the packing well defined.
    """
    spark, units = cut.sparkSession, capacity // step
    cut = written(cut.withColumn("units", F.ceil(F.col("length") / step).cast("int")), "pieces")
    counts = {r["units"]: r["n"] for r in cut.groupBy("units").agg(F.count("*").alias("n")).collect()}
    demand = np.array([counts.get(i + 1, 0) for i in range(units)], np.int64)
    full, demand[-1] = int(demand[-1]), 0
    rules = plan(demand, units)
    beyond = max([0, *(first + (b - a) // k for _, a, b, k, first in rules)])
    rules.append((units, 0, full, 1, beyond))
    salts = int(max([1, *counts.values()]) // GROUP_ROWS) + 1

    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("units", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("units", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("units", "salt").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
    ranked = salted.withColumn("own", own).join(base, ["units", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    # At most a few rules for each length step.
    table = F.broadcast(spark.createDataFrame(rules, "r_units int, first long, last long, each long, sequence long"))
    fits = (F.col("units") == F.col("r_units")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    placed = ranked.join(table, fits).withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
