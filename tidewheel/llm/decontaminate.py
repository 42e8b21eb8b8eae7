"""Benchmark decontamination by latent semantic retrieval.

1. Texts become 32-bit word hashes, a table that all later steps read. Document frequencies are counted on the
   way. They only weigh words, by 1 to 2: no word is too common to find an item by.
2. A randomised SVD of the TF-IDF rows of items and documents over the benchmark's words, by power iterations whose
   sums Spark adds up. The space is widened by what it misses of the items, so that it holds every item whole.
3. Documents are cut into overlapping passages of the sizes that the benchmark's items need. Each passage is embedded
   in the latent space, where its products with the items retrieve its candidates: from the least on that a match can have.
4. Candidates must share as many words as a match, whatever their order, and have a cosine above a threshold.
5. Longest common subsequences of words and of the item's answer confirm a candidate, so paraphrases that
   replace or drop words are found and passages that merely share a subject are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, by_batch, drop_written, id_and_text, mixed, plain_words, written

#: Hashed words.
BUCKETS = 1 << 18
#: Items searched at once, fewer if they hold more than ITEM_WORDS words each; larger benchmarks go in blocks, each over all documents.
BLOCK, ITEM_WORDS = 256, 64
RANK, OVERSAMPLE, POWERS = 128, 16, 1
#: Words whose passages are looked at together; a worker's memory follows SPAN * BLOCK.
SPAN = 1 << 13
#: Least IDF as a share of the greatest. It bounds how little the words that a match shares can weigh.
LEAST_IDF = 0.5
#: With weights of 1 to 2 and words that occur once, a share of 0.6 of an item's words gives a cosine of 0.107 at
#: least: 2 of 3 words of weight 1, all other words of item and 16-word passage of weight 2.
MIN_COSINE = 0.1
#: Longest passage whose products are kept in 16 bits, and what a product may be off by, in their units.
WIDEST, NOISE = 512, 1e-3
#: Numbers of one dense block of documents' rows.
DENSE = 1 << 20
#: Shares of the item's and of the answer's words in the longest common subsequence.
MIN_LCS, MIN_ANSWER = 0.6, 0.5


def word_ids(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """32-bit hashes of words; their low bits are the words' buckets."""
    return (hashes.of(words) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def hashed_texts(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(table of (doc_id, ids), documents that hold each bucket, all documents).

    The table also holds the counts of each task, BUCKETS rows at most, under a null doc_id.
    """
    names, kinds = ["doc_id", "ids", "word", "df"], [pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, df, n = WordHashes(), np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                ids = word_ids(plain_words(text), hashes)
                df[np.unique(ids & np.uint32(BUCKETS - 1))] += 1
                out.append(ids.tobytes())
            n += len(out)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64())], names)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at) + 1, k) for k in kinds[:2]] + [pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names)

    table = written(by_batch(docs, run, "doc_id long, ids binary, word long, df long"), "hashed")
    t = table.where("word IS NOT NULL").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    word, df = t.column("word").to_numpy(), t.column("df").to_numpy()
    out = np.zeros(BUCKETS)
    out[word[word >= 0]] = df[word >= 0]
    return table, out, int(df[word < 0].sum())


def answer_of(text: str) -> str:
    """What comes after a mark of an answer or after the last question mark, else the last third."""
    if m := re.search(r"(?is)\banswer\s*[:=]\s*(.+)$", text) or re.search(r"(?s)\?\s*([^?]*\w[^?]*)$", text):
        return m[1]
    words = text.split()
    return " ".join(words[-max(1, len(words) // 3) :])


def size_of(n: int) -> int:
    """The passage size for an item of n words: the next power of two or half above one, 16 at least."""
    up = 1 << max(4, (n - 1).bit_length())
    return up * 3 // 4 if 16 < up and n <= up * 3 // 4 else up


def lcs(bits: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of n words, given as bits by word, with words."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if u := v & bits.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def bits_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Space:
    """TF-IDF rows over the words of the benchmark, scaled by a passage's whole norm."""

    def __init__(self, items: list[tuple[int, str]], df: np.ndarray, n: int, min_lcs: float = MIN_LCS):
        self.idf = np.maximum(np.log((n + 1) / (df + 1)), LEAST_IDF * np.log(n + 1))
        hashes = WordHashes()
        self.items = []
        for item, text in items:
            ids = word_ids(plain_words(text), hashes)
            if len(ids):
                self.items.append((item, ids, word_ids(plain_words(answer_of(text)), hashes)))
        self.items.sort(key=lambda i: size_of(len(i[1])))  # a size's items are neighbours
        own = [ids & np.uint32(BUCKETS - 1) for _, ids, _ in self.items]
        self.words = np.unique(np.concatenate(own)) if own else np.zeros(0, np.intp)
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[self.words] = np.arange(len(self.words))
        self.rows = [self.row(i) for i in own]
        self.size_of = np.array([size_of(len(w)) for _, w, _ in self.items], np.int64)
        self.sizes = sorted(set(self.size_of.tolist()))
        self.of_size = {z: slice(*np.searchsorted(self.size_of, (z, z + 1)).tolist()) for z in self.sizes}
        self.need = np.ceil(np.array([len(w) for _, w, _ in self.items]) * min_lcs - 1e-6).astype(np.int64)
        self.least = {z: int(self.need[o].min()) for z, o in self.of_size.items()}
        #: Times that each item holds each word.
        self.times = np.zeros((len(self.words), len(self.items)), np.uint32)
        for j, i in enumerate(own):
            np.add.at(self.times[:, j], self.place[i], 1)
        self.has = (self.times > 0).astype(np.uint8)

    def row(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word, tf = np.unique(ids, return_counts=True)
        x = (1 + np.log(tf)) * self.idf[word]
        norm = max(float(np.sqrt((x * x).sum())), 1e-9)  # 0 where no document says which words are rare
        at = self.place[word]
        own = at >= 0
        return at[own], (x[own] / norm).astype(np.float32)


class Latent:
    """The latent space of a block: items in it, and what one occurrence of each word adds to a passage's products with them."""

    def __init__(self, space: Space, right: np.ndarray):
        self.right = right
        own = np.zeros((len(space.items), right.shape[1]))
        least = np.zeros(len(space.items))
        for j, (at, x) in enumerate(space.rows):
            own[j] = x @ right[at]
            share = np.repeat(x * space.idf[space.words[at]], space.times[at, j])
            least[j] = np.sort(share)[: space.need[j]].sum()
        self.unit = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        # A passage's vector is the sum of its words' vectors; products are linear, so they are taken once for each word, as whole numbers rounded up: sums are exact and may wrap.
        self.kind, most = (np.uint16, 1 << 16) if space.sizes[-1] <= WIDEST else (np.uint32, 1 << 32)
        terms = (space.idf[space.words][:, None] * right) @ own.T
        scale = (most // (2 * space.sizes[-1])) / np.maximum(terms.max(axis=0), 1e-9)
        self.terms = np.ceil(np.maximum(terms * scale - NOISE, 0)).astype(self.kind)
        #: The same for the items of each size, and last what a word adds that no item has.
        self.of_size = {z: np.vstack([self.terms[:, o], np.zeros((1, o.stop - o.start), self.kind)]) for z, o in space.of_size.items()}
        self.has_of_size = {z: np.vstack([space.has[:, o], np.zeros((1, o.stop - o.start), np.uint8)]).astype(np.min_scalar_type(2 * z)) for z, o in space.of_size.items()}
        self.least = np.maximum(np.floor(least * scale) - 1, 1).astype(self.kind)


def added(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of a table's rows, one for each column of words."""
    out = table.take(words[0], axis=0)
    for more in words[1:]:
        out += table.take(more, axis=0)
    return out


def retrieved(docs: list[np.ndarray], space: Space, latent: Latent) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(document's place, start, size, end, items): passages, and the items that they reach in the latent space.

    The products of a passage's latent vector, with the words around, and the items of its size decide: an item counts from the least product on
    that a match can have, that of its lightest `need` words. The space holds the items whole, so none is missed. What is retrieved is then counted: the passage's
    words that the item has, and the item's words that the passage has, must both be `need`. Documents are laid out in a row, at multiples of
    all steps and so far apart that no passage meets two.
    """
    unit = int(np.lcm.reduce([z // 2 for z in space.sizes]))
    room = [-(-(len(ids) + 2 * space.sizes[-1]) // unit) * unit for ids in docs]
    n, offset = sum(room), np.cumsum([0, *room])[:-1]
    none, edge = len(space.words), space.sizes[-1]
    row = np.full(n + 4 * edge, none, np.intp)  # position 0 is at `edge`
    for ids, o in zip(docs, offset.tolist(), strict=True):
        own = space.place[ids & np.uint32(BUCKETS - 1)]
        row[edge + o : edge + o + len(ids)] = np.where(own < 0, none, own)
    span = max(SPAN, 4 * edge)
    for low in range(0, n, span):
        first, last = max(0, low - edge), min(n, low + span + 2 * edge)
        place = row[edge + first : edge + last]
        at = np.flatnonzero(place < none)
        place, at = place[at], at + first
        if len(at) < space.need.min():
            continue
        before = None
        for size in space.sizes:
            own, step, quarter = space.of_size[size], size // 2, size // 4
            start = np.arange(-(-low // step) * step, min(low + span, n), step)
            if not len(start):
                continue
            # A passage with the words around is six quarters of its size. The products of each quarter are added up once, for all quarters at a time.
            begin, many = edge + int(start[0]) - quarter, 2 * len(start) + 4
            words = np.ascontiguousarray(row[begin : begin + many * quarter].reshape(many, quarter).T)
            sums = added(latent.of_size[size], words)
            halves = sums[1:-1:2] + sums[2::2]
            near = sums[:-5:2] + halves[:-1] + halves[1:] + sums[5::2] >= latent.least[own]
            window, item = np.divmod(np.flatnonzero(near), near.shape[1])
            if not len(window):
                continue
            counts = added(latent.has_of_size[size], words)
            held = sum(counts[2 * window + k, item] for k in range(6)) >= space.need[item + own.start]
            window, item = window[held], item[held] + own.start
            if not len(window):
                continue
            if before is None:
                before = np.full(len(place), -1)  # the place before of the same word
                order = np.argsort(place, kind="stable")
                again = np.flatnonzero(place[order[1:]] == place[order[:-1]])
                before[order[again + 1]] = order[again]
            a, e = np.searchsorted(at, start - quarter)[window], np.searchsorted(at, start + size + quarter)[window]
            length = e - a
            begin = np.cumsum(length) - length
            each = np.arange(begin[-1] + length[-1]) + np.repeat(a - begin, length)
            times = np.where(before[each] < np.repeat(a, length), space.times[place[each], np.repeat(item, length)], 0)  # each word once
            held = np.add.reduceat(times, begin, dtype=np.int64) >= space.need[item]
            for w in np.unique(window[held]).tolist():
                items = item[held & (window == w)]
                doc = int(np.searchsorted(offset, start[w], "right")) - 1
                at_word, n_words = int(start[w] - offset[doc]), len(docs[doc])
                if at_word < max(1, n_words - step):
                    yield doc, at_word, size, min(at_word + size, n_words), items


def _times(hashed: DataFrame, space: Space, right: np.ndarray) -> np.ndarray:
    """A' (A right) for the TF-IDF rows A of all documents over the benchmark's words, added up over all partitions: one row of sums for each word."""
    own = hashed.sparkSession.sparkContext.broadcast((space.place, space.idf[space.words].astype(np.float32), right.astype(np.float32)))
    n, k = right.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf, r = own.value
        y = np.zeros((n, k))
        for b in batches:
            texts = b.column("ids").to_pylist()
            step = max(1, DENSE // n)
            for low in range(0, len(texts), step):
                part = [place[np.frombuffer(t, np.uint32) & np.uint32(BUCKETS - 1)] for t in texts[low : low + step]]
                key = np.repeat(np.arange(len(part), dtype=np.int64) * n, [len(x) for x in part]) + np.concatenate(part)
                key = key[np.concatenate(part) >= 0]
                tf = np.bincount(key, minlength=len(part) * n)
                some = np.flatnonzero(tf)
                doc, word = np.divmod(some, n)
                v = (1 + np.log(tf[some].astype(np.float32))) * idf[word]
                x = np.zeros((len(part), n), np.float32)
                x[doc, word] = v / np.sqrt(np.bincount(doc, v * v, len(part)))[doc]
                y += x.T @ (x @ r)
        at = np.flatnonzero(y.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(y[at, j]) for j in range(k))], ["word", *(f"y{j}" for j in range(k))])

    schema = "word long, " + ", ".join(f"y{j} double" for j in range(k))
    t = by_batch(hashed.where("doc_id IS NOT NULL").select("ids"), run, schema).groupBy("word").agg(*(F.sum(f"y{j}").alias(f"y{j}") for j in range(k))).toArrow()
    out = np.zeros((n, k))
    if t.num_rows:
        out[t.column("word").to_numpy()] = np.column_stack([t.column(f"y{j}").to_numpy() for j in range(k)])
    return out


def latent_space(hashed: DataFrame, space: Space, n_docs: int, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of items and documents stacked, by randomised subspace iteration, and the items' residuals.

    The items' rows are weighted to the mass of all documents, so that a few hundred items are not lost among them.
    What the singular vectors miss of them follows as further directions, len(items) at most.
    """
    n = len(space.words)
    k = min(rank + OVERSAMPLE, n)
    items = np.zeros((len(space.rows), n))
    for j, (at, x) in enumerate(space.rows):
        items[j, at] = x
    weight = max(1.0, n_docs / max(1, len(items)))
    q = np.linalg.qr(np.random.default_rng(17).standard_normal((n, k)))[0]
    for _ in range(POWERS):
        y = _times(hashed, space, q) + weight * (items.T @ (items @ q))
        q = np.linalg.qr(y)[0]
    small = q.T @ (_times(hashed, space, q) + weight * (items.T @ (items @ q)))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:rank]
    right = q @ vectors[:, order]
    rest = items - (items @ right) @ right.T
    _, lengths, more = np.linalg.svd(rest, full_matrices=False)
    return np.hstack([right, more[lengths > 1e-6].T]).astype(np.float32)


def matches(hashed: DataFrame, space: Space, right: np.ndarray, min_cosine: float = MIN_COSINE, min_lcs: float = MIN_LCS, min_answer: float = MIN_ANSWER) -> DataFrame:
    """(doc_id, item_id, start, size, cosine, lcs_share, answer_share) of the retrieved passages that the subsequences confirm."""
    texts = [(i, len(w), bits_of(w.tolist()), len(a), bits_of(a.tolist())) for i, w, a in space.items]
    shared = hashed.sparkSession.sparkContext.broadcast((space, Latent(space, right), texts))  # BUCKETS numbers and a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, latent, texts = shared.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        for b in batches:
            out: list[tuple] = []
            names, docs = b.column("doc_id").to_pylist(), [np.frombuffer(data, np.uint32) for data in b.column("ids").to_pylist()]
            for doc, start, size, end, near in retrieved(docs, s, latent):
                at, x = s.row(docs[doc][start:end] & np.uint32(BUCKETS - 1))
                vector = x @ latent.right[at]
                cosine = latent.unit[near] @ (vector / max(float(np.linalg.norm(vector)), 1e-9))
                around = None
                for k in np.flatnonzero(cosine >= min_cosine).tolist():
                    item, n, bits, n_answer, answer = texts[near[k]]
                    around = docs[doc][max(0, start - size // 4) : end + size // 4].tolist() if around is None else around
                    share = lcs(bits, n, around) / n
                    if share >= min_lcs:
                        own_answer = lcs(answer, n_answer, around) / n_answer if n_answer else 1.0
                        if own_answer >= min_answer:
                            out.append((names[doc], item, start, size, float(cosine[k]), share, own_answer))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], ["doc_id", "item_id", "start", "size", "cosine", "lcs_share", "answer_share"])

    return by_batch(hashed.where("doc_id IS NOT NULL").select("doc_id", "ids"), run, "doc_id long, item_id long, start long, size int, cosine double, lcs_share double, answer_share double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, start, size, cosine, lcs_share, answer_share): the best passage of each document and item that match.

    Documents with null ids or texts, items without words and null items match nothing; repeated rows count
    once. Empty tables on either side give no rows. Items are searched in blocks of about `block`.
    """
    spark = docs.sparkSession
    own = id_and_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    n_items, n_words = items.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")))).first()
    blocks = max(-(-n_items // block), -(-(n_words or 0) // (block * ITEM_WORDS)))
    schema = "doc_id long, item_id long, start long, size int, cosine double, lcs_share double, answer_share double"
    found = spark.createDataFrame([], schema)
    if not blocks:
        return found
    hashed, df, n = hashed_texts(own)
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        pairs = sorted(zip(some.column("item_id").to_pylist(), some.column("text").to_pylist(), strict=True))
        space = Space(pairs, df, n)
        if not space.items:
            continue
        hits = written(matches(hashed, space, latent_space(hashed, space, n)), "matches")
        found = found.unionAll(hits)
    drop_written(hashed)
    best = F.max_by(F.struct("start", "size", "cosine", "lcs_share", "answer_share"), F.struct("lcs_share", "cosine", -F.col("start"), -F.col("size"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
