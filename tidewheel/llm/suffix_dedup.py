"""Suffix-array dedup: bytes that a 100-byte string covers which also starts earlier are removed.

A suffix array of every byte would be as many strings as bytes. Equal 100-byte strings hold equal anchors, the
least hash of the K-byte strings in them, so only suffixes at anchors are sorted, about one in forty:

1. Of equal whole texts only the first is looked at: every string of the others starts earlier in it.
2. Anchors of all texts are counted by their K bytes; those that occur once in the corpus can't lie in a
   repeated string and go.
3. Some texts at a time sort the suffixes of their remaining anchors, and likewise what stands before them, and
   settle strings that repeat among them. That leaves one string of a kind.
4. What is left meets by anchor, a bounded bucket at a time, and is sorted and settled in the same way.
   Anchors of more than HOT places don't meet: their strings are compared one by one by 128-bit hashes, which
   Spark aggregates in part before the shuffle.

Sorting is deep-shallow: a multikey quicksort over 8-byte characters to SHALLOW of them, then a blind trie for
each group that is still equal. Ranks and common prefixes of both sorts say which strings are equal: one that
starts o bytes before its anchor equals another if o bytes agree to the left and LENGTH - o to the right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, drop_written, id_and_text, let_go, mixed, salted_join, written

LENGTH = 100
K = 24
WIDTH = LENGTH - K + 1  # places of an anchor in a string
SHALLOW = 4
#: Places of one anchor that may meet in a task.
HOT = 4096
#: Records of a bucket, about.
BUCKET = 8_000
#: Parts of the buckets that meet one after another, so that only a part of the records is shuffled at a time.
ROUNDS = 4
#: Anchors that are settled together, at most.
TOGETHER = 120_000
PIECE = 1 << 19
_LAST = (1 << 63) - 1
_B = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(PIECE + LENGTH, _B, np.uint64))
_INVERSE = np.cumprod(np.full(PIECE + LENGTH, pow(_B, -1, 1 << 64), np.uint64))
_PLACE = np.uint64((1 << 20) - 1)


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(K-byte hashes, places, first starts, last starts): for each anchor, the run of string starts that choose it."""
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE + LENGTH - 1, len(data) - at), at)
        n = len(b)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS[:n], out=total[1:])
        h = mixed((total[K:] - total[:-K]) * _INVERSE[: n - K + 1])
        m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= WIDTH:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: len(m) - (WIDTH - width)], m[WIDTH - width :])
        q = (m & _PLACE).astype(np.int64)
        cut = np.flatnonzero(q[1:] != q[:-1]) + 1
        lo = np.concatenate((np.zeros(1, np.int64), cut))
        hi = np.concatenate((cut, np.array([len(q)]))) - 1
        yield h[q[lo]].view(np.int64), q[lo] + at, lo + at, hi + at


class BlindTrie:
    """Order and common prefixes of a few long strings that agree far: a trie of the places where they part.

    Going down reads only those places; then one whole comparison with the leaf that is reached tells the
    place where the new string parts, and the edge to split.
    """

    def __init__(self, first: int, strings: list[bytes]):
        self.strings, self.root = strings, first

    def add(self, new: int) -> None:
        s = self.strings[new]
        node = self.root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]], next(iter(node[1].values())))
        other = self.strings[node]
        depth = next(i for i, (x, y) in enumerate(zip(s, other, strict=True)) if x != y)
        up, node = None, self.root
        while not isinstance(node, int) and node[0] < depth:
            up, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = new
            return
        split = (depth, {other[depth]: node, s[depth]: new})
        if up is None:
            self.root = split
        else:
            up[1][s[up[0]]] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(keys: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows by (key, string), and the bytes that each shares with the row before; -1 for another key.

    strings: (n, width) bytes, width a multiple of 8.
    """
    n, width = strings.shape
    words = strings.view(">u8").astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, np.bool_)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.cumsum(new)
    first_of_key = new.copy()
    for depth in range(min(SHALLOW, words.shape[1])):
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # rows whose group has others
        if not len(open_):
            break
        w = words[order[open_], depth]
        by = np.lexsort((w, group[open_]))
        order[open_] = order[open_[by]]
        w, g = w[by], group[open_]
        new[open_[1:]] |= (w[1:] != w[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    rest = words[:, SHALLOW:]
    for a, k in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        rows = order[a : a + k]
        tail = rest[rows]
        if (tail[1:] == tail[0]).all():
            continue
        kinds: dict[bytes, list[int]] = {}
        for r in rows.tolist():
            kinds.setdefault(strings[r].tobytes(), []).append(r)
        own = list(kinds)
        trie = BlindTrie(0, own)
        for i in range(1, len(own)):
            trie.add(i)
        order[a : a + k] = [r for i in trie.ordered() for r in kinds[own[i]]]
    common = np.full(n, -1)
    for at in range(1, n, 1 << 16):
        same = strings[order[at : at + (1 << 16)]] == strings[order[at - 1 : at - 1 + len(order[at : at + (1 << 16)])]]
        common[at : at + len(same)] = np.where(same.all(axis=1), width, (~same).argmax(axis=1))
    common[first_of_key] = -1
    return order, common


def repeated(keys: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray, right: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """(n, WIDTH) flags: the string that starts o bytes before the anchor also starts at a lesser place.

    place: ranks of (document, anchor) in whose order the rows come. lo and hi bound o, todo flags what is asked for.
    left: bytes before the anchor, nearest first; right: bytes from the anchor on.
    """
    n = len(keys)
    out = np.zeros((n, WIDTH), np.bool_)
    if n < 2:
        return out
    r_order, r_common = deep_shallow(keys, right)
    l_order, l_common = deep_shallow(keys, left)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(WIDTH):
        rows = np.flatnonzero((lo <= o) & (o <= hi) & todo[:, o])
        if len(rows) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < LENGTH - o)
        l_class[l_order] = np.cumsum(l_common < o)
        kind, _ = pd.factorize(r_class[rows] * (n + 1) + l_class[rows])  # numbered as they first come
        first = np.flatnonzero(kind > np.maximum.accumulate(np.append(-1, kind[:-1])))
        at = place[rows]
        out[rows, o] = at > at[first[kind]]
    return out


def _sides(parts: list[tuple[bytes, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """left and right of repeated() from (bytes, offset of the anchor in them, o's greatest, o's least)."""
    left, right = np.zeros((len(parts), 80), np.uint8), np.zeros((len(parts), 104), np.uint8)
    for i, (data, q, most, least) in enumerate(parts):
        if most:
            left[i, :most] = np.frombuffer(data, np.uint8, most, q - most)[::-1]
        right[i, : LENGTH - least] = np.frombuffer(data, np.uint8, LENGTH - least, q)
    return left, right


def _ranks(docs: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dense ranks of (doc, q), rows being in that order."""
    return np.cumsum(np.append(True, (docs[1:] != docs[:-1]) | (q[1:] != q[:-1])))


def _runs(flags: np.ndarray, row: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start + 1) of flagged strings, neighbouring runs of a row joined."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    a, b = q[i] - high + 1, q[i] - low + 1
    order = np.lexsort((a, row[i]))
    r, a, b = row[i][order], a[order], b[order]
    new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (a[1:] > b[:-1]))) if len(r) else np.zeros(0, np.int64)
    return (r[new], a[new], np.maximum.reduceat(b, new)) if len(r) else (r, a, b)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, rows = [], []
        for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
            for h, *_ in anchors(text.encode("utf-8", "surrogatepass")):
                keys.append(h)
                rows.append(np.full(len(h), row, np.int64))
        k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(r)], ["anchor", "row"])


_OUT = ["kind", "row", "doc_id", "anchor", "q", "lo", "hi", "todo", "data", "a", "b"]
_OUT_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_OUT_SCHEMA = "kind int, row long, doc_id long, anchor long, q long, lo int, hi int, todo binary, data binary, a long, b long"


def _batch(kind: int, n: int, **columns) -> pa.RecordBatch:
    filled = {"kind": np.full(n, kind, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(filled[c], t) if c in filled else pa.nulls(n, t) for c, t in zip(_OUT, _OUT_KINDS, strict=True)], _OUT)


class _Together:
    """Anchors of some texts, settled at once."""

    def __init__(self) -> None:
        self.n, self.parts, self.texts = 0, [], []

    def add(self, row: int, doc: int, data: bytes, padded: np.ndarray, own: np.ndarray, hot: np.ndarray, h: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Anchors h at q of a text; own: its sorted anchors that others share, hot for each."""
        if not self.texts or self.texts[-1] is not data:
            self.texts.append(data)
        one = lambda x: np.full(len(q), x, np.int64)
        at = np.searchsorted(own, h)
        middle = (q + 80)[:, None]
        self.parts.append((one(doc), q, one(row), h, q - hi, q - lo, hot[at], one(len(self.texts) - 1), padded[middle - 1 - np.arange(80)], padded[middle + np.arange(104)]))
        self.n += len(q)

    def settled(self) -> Iterator[pa.RecordBatch]:
        """kind 0: a repeated run a..b of a row; 1: a record that must meet others; 2: a hot string, its hash in data, its start in a."""
        doc, q, row, key, lo, hi, hot, text, left, right = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((row, q, doc))
        doc, q, row, key, lo, hi, hot, text, left, right = (x[order] for x in (doc, q, row, key, lo, hi, hot, text, left, right))
        flags = repeated(key, _ranks(doc, q), lo, hi, left, right, np.ones((len(q), WIDTH), np.bool_))
        r, a, b = _runs(flags, row, q)
        yield _batch(0, len(r), row=r, a=a, b=b)
        offsets = np.arange(WIDTH)
        over = ~flags & (offsets >= lo[:, None]) & (offsets <= hi[:, None])
        some = over.any(axis=1)
        at = np.flatnonzero(some & ~hot)
        data = [self.texts[t][x:y] for t, x, y in zip(text[at].tolist(), (q - hi)[at].tolist(), (q - lo + LENGTH)[at].tolist(), strict=True)]
        bits = np.packbits(over[at], axis=1)
        yield _batch(1, len(at), row=row[at], doc_id=doc[at], anchor=key[at], q=q[at], lo=lo[at], hi=hi[at], todo=[x.tobytes() for x in bits], data=data)
        at, o = np.nonzero(over & (some & hot)[:, None])
        start = q[at] - o
        data = [xxhash.xxh3_128_digest(self.texts[t][x : x + LENGTH]) for t, x in zip(text[at].tolist(), start.tolist(), strict=True)]
        yield _batch(2, len(at), row=row[at], doc_id=doc[at], data=data, a=start)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, text, keys, hot) as records of _Together, TOGETHER anchors at a time."""
    some = _Together()
    for batch in batches:
        lists = [batch.column(c) for c in ("keys", "hot")]
        (own, cut), (hots, hot_cut) = ((x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()) for x in lists)
        for i, (row, doc, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True)):
            data = text.encode("utf-8", "surrogatepass")
            padded = np.concatenate((np.zeros(80, np.uint8), np.frombuffer(data, np.uint8), np.zeros(104, np.uint8)))
            mine, hot = own[cut[i] : cut[i + 1]], hots[hot_cut[i] : hot_cut[i + 1]]
            for found in anchors(data):
                keep = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, found[0]), len(mine) - 1)] == found[0])
                for k in range(0, len(keep), TOGETHER):
                    some.add(row, doc, data, padded, mine, hot, *(x[keep[k : k + TOGETHER]] for x in found))
                    if some.n >= TOGETHER:
                        yield from some.settled()
                        some = _Together()
    if some.n:
        yield from some.settled()


def _meet(table: pa.Table) -> pa.Table:
    t = table.sort_by([("doc_id", "ascending"), ("q", "ascending"), ("row", "ascending")])
    doc, q, key, lo, hi, row = (t.column(c).to_numpy() for c in ("doc_id", "q", "anchor", "lo", "hi", "row"))
    todo = np.unpackbits(np.frombuffer(b"".join(t.column("todo").to_pylist()), np.uint8).reshape(len(doc), -1), axis=1)[:, :WIDTH].astype(np.bool_)
    left, right = _sides([(d, int(m), int(m), int(n)) for d, m, n in zip(t.column("data").to_pylist(), hi, lo, strict=True)])
    flags = repeated(key, _ranks(doc, q), lo, hi, left, right, todo)
    return pa.table(list(_runs(flags, row, q)), ["row", "a", "b"])


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(row, a, b): strings that start at a..b-1 of a row also start earlier. rows: (row, doc_id, text), a written table of distinct rows."""
    some = rows.where(F.octet_length("text") >= LENGTH)
    let_go(rows.sparkSession)
    pairs = written(by_batch(some.select("row", "text"), _pairs, "anchor long, row long"), "anchors")
    # Only anchors of two places or more come back.
    many = written(pairs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "many")
    let_go(rows.sparkSession)
    met = salted_join(pairs, many.select("anchor", (F.col("n") > HOT).alias("hot")), "anchor", "row", sizes=many)
    shared = met.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("anchor", "hot"))).alias("shared"))
    shared = shared.select("row", F.col("shared.anchor").alias("keys"), F.col("shared.hot").alias("hot"))
    settled = written(by_batch(some.join(shared, "row").select("row", F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "text", "keys", "hot"), _settle, _OUT_SCHEMA), "settled")
    drop_written(pairs, many)
    records = settled.where("kind = 1")
    buckets = records.count() // BUCKET + 1
    placed = records.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    met = []
    for part in range(ROUNDS):
        own = placed.where(F.col("bucket") % ROUNDS == part).groupBy("bucket").applyInArrow(_meet, "row long, a long, b long")
        met.append(written(own, "met"))
        let_go(rows.sparkSession)
    met = reduce(DataFrame.unionAll, met)
    hot = settled.where("kind = 2").select("row", "doc_id", "data", "a")
    first = hot.groupBy("data").agg(F.min(F.struct("doc_id", "a")).alias("first"))
    late = salted_join(hot, first, "data", "row").where(F.struct("doc_id", "a") > F.col("first")).select("row", "a", (F.col("a") + 1).alias("b"))
    return settled.where("kind = 0").select("row", "a", "b").unionAll(met).unionAll(late)


_SPANS = "array<struct<start:long,end:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for own, text, runs in zip(*(batch.column(c).to_pylist() for c in ("own", "text", "runs")), strict=True):
            data, kept, end, spans = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, []
            for a, b in sorted((x["a"], x["b"] + LENGTH - 1) for x in runs):
                if spans and a <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], b)
                else:
                    spans.append({"start": a, "end": b})
            for s in spans:
                kept.update(data[end : s["start"]])
                end = s["end"]
            kept.update(data[end:])
            out.append((own, kept.hexdigest(), spans))
        kinds = [pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)], ["own", "sha", "spans"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row for each input row; spans in bytes, end exclusive.

    Null texts are empty. Rows of one id are at one place: equal strings at equal starts don't remove each
    other, so of one text all rows of its first id are kept alike. Null ids come after all others, as one place.
    An empty table stays empty; a text may be of any length, and is cut into pieces only to look for anchors.
    """
    own = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(_LAST))
    # Equal texts by 128-bit hash; sums of lengths would not tell them apart, an id alone neither.
    hashed = own.select("doc_id", place.alias("place"), F.unhex(F.md5("text")).alias("own"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    hashed = written(hashed, "hashed")
    first = written(hashed.groupBy("own").agg(F.min("place").alias("first")), "firsts")
    whole = own.select(place.alias("place"), F.unhex(F.md5("text")).alias("own"), "doc_id", "text").where(F.octet_length("text") >= LENGTH)
    # Both sides are dealt by (own, place), which then also serves to drop repeated rows.
    texts = whole.join(first.select("own", F.col("first").alias("place")).hint("merge"), ["own", "place"], "left_semi").dropDuplicates(["own", "place"])
    texts = written(texts.select(F.monotonically_increasing_id().alias("row"), "own", "doc_id", "text"), "texts")
    runs = repeated_runs(texts.select("row", "doc_id", "text")).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    cut = written(by_batch(texts.join(runs, "row").select("own", "text", "runs"), _cut, f"own binary, sha string, spans {_SPANS}"), "cut")
    drop_written(texts)
    # Short rows only: every row with what became of its text.
    seen = first.join(cut.withColumnRenamed("sha", "cut_sha"), "own", "left")
    rows = salted_join(hashed, seen, "own", "doc_id")
    copy = (F.col("place") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(copy, every).otherwise(F.coalesce("spans", F.array().cast(_SPANS)))
    rows = rows.withColumn("spans", spans)
    sha = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), sha.alias("kept_sha256"), "spans")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
