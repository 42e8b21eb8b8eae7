"""LM scoring: a Brown class-based bigram model.

Exchange clustering assigns the CLUSTERED most frequent words to classes so that the likelihood of the class
bigrams grows; the number of classes grows with the vocabulary. All other words of the head are then placed, in parallel, in the class
that makes their neighbours' classes likeliest. The end token and the words outside the head have a class each. A
text's probability is the product of class transitions and word emissions. All counts cover every training text.

Counts of words are a table of their own. Words at or above a frequency that at most HEAD words reach are
looked up in memory; all others are joined with that table, so vocabularies of any size are scored exactly.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, id_and_text, remainder, words_of, written

#: Words looked up in memory, at most (about 50 MB in a worker).
HEAD = 300_000
#: Words that exchange moves, at most; their pair counts are what the driver gathers, CLUSTERED ** 2 numbers at most.
CLUSTERED = 1000
#: Classes, at least and at most; between them the cube root of the number of different words.
CLASSES = (16, 128)
SWEEPS = 4
#: Weight of the classes' own shares in a transition.
PRIOR = 5.0
#: The end token; no word holds white space.
END = b"\n"
_BUCKETS = 8  # of counts, for each doubling


def count_words(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """(word binary, n) of the column text, end tokens included; null texts are an end token alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            texts = b.column("text").to_pylist()
            n[END] += len(texts)
            for text in texts:
                n.update(words_of(text))
                if len(n) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], ["word", "n"])
                    n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], ["word", "n"])

    return by_batch(texts, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Head(dict):
    """Word to place; words outside have the last place + 1."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.other = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.other

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[list[bytes], np.ndarray, int]:
    """The words at or above the least frequency step that at most `most` words reach, most frequent first; their counts; and that step's share.

    A histogram of frequency steps, of a few hundred rows, gives the threshold; nothing is sorted as a whole.
    """
    step = F.floor(F.log2("n") * _BUCKETS).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        if total + n > most:
            break
        total, least = total + n, s
    if least is None:
        return [], np.zeros(0, np.int64), 0
    t = counts.where(step >= least).toArrow()
    n, words = t.column("n").to_numpy(), t.column("word").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order], least


def pair_counts(texts: DataFrame, symbols: list[bytes]) -> np.ndarray:
    """Counts of neighbouring symbols; the last row and column stand for all other words. Each text starts after an end."""
    k = len(symbols) + 1
    own = texts.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, n = Head(own.value), np.zeros(k * k, np.int64)
        end = head[END]
        for b in batches:
            ids = [np.array([end])]
            for text in b.column("text").to_pylist():
                ids += [head.of(words_of(text)), np.array([end])]
            x = np.concatenate(ids)
            n += np.bincount(x[:-1] * k + x[1:], minlength=k * k)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])

    t = by_batch(texts, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[t.column("pair").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(k, k)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, free: np.ndarray, fixed: int, classes: int = CLASSES[0], sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol. free symbols start dealt out by rank and move, one at a time, to the class that raises
    sum f(class pairs) - sum f(left classes) - sum f(right classes), f(x) = x log x; others keep a class each."""
    k = len(pairs)
    of = np.zeros(k, np.int64)
    moving = np.flatnonzero(free)
    c = min(classes, max(1, len(moving)))
    of[moving] = np.arange(len(moving)) % c
    of[~free] = c + np.arange(fixed)
    m = c + fixed
    member = np.zeros((k, m))
    member[np.arange(k), of] = 1
    t = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for w in moving:
            a = of[w]
            right = np.bincount(of, weights=pairs[w], minlength=m)
            left = np.bincount(of, weights=pairs[:, w], minlength=m)
            own = pairs[w, w]
            right[a] -= own
            left[a] -= own
            t[a, :] -= right
            t[:, a] -= left
            t[a, a] -= own
            rows, cols = t.sum(axis=1), t.sum(axis=0)
            n_right, n_left = right.sum() + own, left.sum() + own
            # Gain of each class: its row and column change, and its diagonal takes both and the word's own pair.
            gain_row = _f(t + right) - _f(t)
            gain_col = _f(t + left[:, None]) - _f(t)
            d = np.arange(m)
            gain = gain_row.sum(axis=1) - gain_row[d, d] + gain_col.sum(axis=0) - gain_col[d, d]
            gain += _f(t[d, d] + right + left + own) - _f(t[d, d])
            gain -= _f(rows + n_right) - _f(rows) + _f(cols + n_left) - _f(cols)
            b = int(gain[:c].argmax())
            t[b, :] += right
            t[:, b] += left
            t[b, b] += own
            moved += a != b
            of[w] = b
        if not moved:
            break
    return of


def classes_of(vocabulary: int) -> int:
    return int(np.clip(round(vocabulary ** (1 / 3)), *CLASSES))


def _placed(texts: DataFrame, words: list[bytes], of: np.ndarray, k: int, t: np.ndarray, free: int) -> np.ndarray:
    """Classes of all head words: of[i] for the first k, for others the likeliest of the first `free` classes.

    A word's neighbours' classes are counted in Spark by (word, side, class). Some thousand words at a time are then judged in a task: the
    class b is best of which ``sum n log P(right | b) + n log P(left | b)`` is greatest.
    """
    m = len(t)
    smooth = lambda x: np.log((x + PRIOR * (x.sum(axis=0) + 0.5) / (x.sum() + 0.5 * m)) / (x.sum(axis=1, keepdims=True) + PRIOR))
    logs = np.concatenate((smooth(t)[:free], smooth(t.T)[:free]), axis=1).T  # (right and left classes, free classes)
    known = np.append(np.where(np.arange(len(words)) < k, of[np.minimum(np.arange(len(words)), k)], of[k]), of[k])
    own = texts.sparkSession.sparkContext.broadcast((words, known))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = own.value
        head = Head(words)
        end = head[END]
        for b in batches:
            ids = [np.array([end])]
            for text in b.column("text").to_pylist():
                ids += [head.of(words_of(text)), np.array([end])]
            x = np.concatenate(ids)
            at = np.flatnonzero((x >= k) & (x < head.other))
            keys, n = np.unique(np.concatenate((x[at] * 2 * m + known[x[at + 1]], (x[at] * 2 + 1) * m + known[x[at - 1]])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    def judge(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        ids, at = np.unique(keys // (2 * m), return_inverse=True)
        counts = np.zeros((len(ids), 2 * m))
        counts[at, keys % (2 * m)] = table.column("n").to_numpy()
        return pa.table([pa.array(ids), pa.array((counts @ logs).argmax(axis=1))], ["id", "class"])

    counted = by_batch(texts, neighbours, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    some = F.floor(F.col("key") / (2 * m * 1000))
    found = counted.groupBy(some.alias("some")).applyInArrow(judge, "id long, class long").toArrow()
    known[found.column("id").to_numpy()] = found.column("class").to_numpy()
    return known


def class_pairs(texts: DataFrame, words: list[bytes], known: np.ndarray, m: int) -> np.ndarray:
    """Counts of neighbouring classes (m, m) over all texts; each text starts after an end."""
    own = texts.sparkSession.sparkContext.broadcast((words, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = own.value
        head, n = Head(words), np.zeros(m * m, np.int64)
        end = np.array([known[head[END]]])
        for b in batches:
            c = [end]
            for text in b.column("text").to_pylist():
                c += [known[head.of(words_of(text))], end]
            x = np.concatenate(c)
            n += np.bincount(x[:-1] * m + x[1:], minlength=m * m)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])

    t = by_batch(texts, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(m * m)
    out[t.column("pair").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(m, m)


def train(texts: DataFrame, counts: DataFrame, head: int = HEAD, clustered: int = CLUSTERED) -> dict:
    """The model: head words with class, base and emission logarithms, transitions, and what joined words need.

    texts: the column text; counts: rows of count_words(). Without texts all scores are 0.
    """
    words, n, _ = head_of(counts, head)
    v, total = counts.agg(F.count("*"), F.sum("n")).first()
    total = total or 0
    if END in words:  # never beyond what is clustered
        at = words.index(END)
        words.insert(min(at, clustered - 1), words.pop(at))
        n = np.insert(np.delete(n, at), min(at, clustered - 1), n[at])
    symbols = words[:clustered]
    base_norm = total + 0.5 * (v + 1)
    k = len(symbols)
    pairs = pair_counts(texts, symbols) if total else np.zeros((k + 1, k + 1))
    free = np.array([s != END for s in symbols] + [False])
    of = exchange(pairs, free, int((~free).sum()), classes_of(v))
    m, moving = int(of.max()) + 1, int(of.max()) + 1 - int((~free).sum())
    member = np.zeros((k + 1, m))
    member[np.arange(k + 1), of] = 1
    t = member.T @ pairs @ member
    known = np.append(of[: len(words)], of[k])
    if len(words) > k and moving:
        known = _placed(texts, words, of, k, t, moving)
        t = class_pairs(texts, words, known, m)
    share = (t.sum(axis=0) + 0.5) / (t.sum() + 0.5 * m)
    transition = np.log10((t + PRIOR * share) / (t.sum(axis=1, keepdims=True) + PRIOR))
    rare_norm = total - int(n.sum()) + 0.5 * (v - len(words) + 1)
    in_class = np.bincount(known[:-1], weights=n, minlength=m) if len(words) else np.zeros(m)
    emission = np.log10(np.maximum(n, 1) / np.maximum(in_class[known[:-1]], 1))
    return {
        "id": uuid.uuid4().hex, "words": words, "class": known.astype(np.int64), "base": np.append(np.log10((n + 0.5) / base_norm), 0.0), "emission": np.append(emission, 0.0),
        "transition": transition, "base_norm": float(base_norm), "rare_norm": float(rare_norm), "train_tokens": int(total), "end_class": int(known[words.index(END)]) if END in words else int(of[k]),
    }


_MODELS: dict = {}


def score(docs: DataFrame, model: dict, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each input row.

    Null and empty texts are the end token alone. Repeated rows and null ids stay. A model of no text gives scores of 0.
    """
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own.value
        if _MODELS.get("id") != m["id"]:  # one dictionary for all tasks of a worker
            _MODELS.clear()
            _MODELS.update(id=m["id"], head=Head(m["words"]))
        head, row = _MODELS["head"], TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "others"]
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                words.append(END)
                ids = head.of(words)
                c = m["class"][ids]
                p = m["transition"][np.concatenate(([m["end_class"]], c[:-1])), c].sum() + m["emission"][ids].sum()
                other = np.flatnonzero(ids == head.other)
                out.append((row, doc, len(ids), len(ids) - len(other), float(m["base"][ids].sum()), float(p), [words[i] for i in other]))
                row += 1
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)

    first = written(by_batch(id_and_text(docs, id_col, text_col), run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, others array<binary>"), "scored")
    n = F.coalesce("n", F.lit(0))
    others = first.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    joined = others.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((n + 0.5) / model["base_norm"])).alias("more_base"),
        F.sum(F.col("times") * F.log10((n + 0.5) / model["rare_norm"])).alias("more_score"),
    )
    some = model["train_tokens"] > 0
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))) if some else F.lit(0.0)
    return first.drop("others").join(joined, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model["train_tokens"]).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"),
    )


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.where(remainder("doc_id", 5) != 1).select("text")
    counts = written(count_words(texts), "words")
    found = score(docs, train(texts, counts), counts)
    return found.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
