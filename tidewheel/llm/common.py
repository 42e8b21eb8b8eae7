"""What the operators of this subpackage share: inputs, scratch tables and tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_dir

#: ``[\x20\x09-\x0D]``, the white space of every word contract.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that further columns, whatever their names, can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and losing an executor loses nothing."""
    path = f"{scratch_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, and lets Spark's cleaner find the shuffles of finished steps."""
    session = tables[0].sparkSession
    for parent in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        drop_folder(session, parent)
    let_go(session)


def drop_folder(session: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one with all its files."""
    path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let_go(session: SparkSession) -> None:
    """Has the driver collect plans of finished steps: Spark's cleaner then deletes their shuffle files, which pile up on disks otherwise."""
    session.sparkContext._jvm.System.gc()


#: A key of more rows than this, or than a thousandth of all, is dealt over several tasks.
HOT_ROWS = 200


def salted_join(many: DataFrame, few: DataFrame, on: str, by: str, counted: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of many with few, few having one row (or a few) for a key, where one key may hold most rows of many.

    Rows are counted by key first. Where no key is hot, this is a plain join, without a list to broadcast. Else the rows of hot keys are dealt by a hash of column `by` over as many tasks as they need, and what few has for
    them goes to each. Hot keys are under a thousand whatever the input, so their list is broadcast. counted is what the
    keys are counted on (many, if not given): a written table, as it is read once more. sizes: (on, n), a written table of
    all keys that many and few share, where that is known.
    """
    n = (many if counted is None else counted).groupBy(on).agg(F.count("*").alias("n")) if sizes is None else sizes
    total, largest = n.agg(F.sum("n"), F.max("n")).first()
    most = max(HOT_ROWS, (total or 0) // 1000)
    if (largest or 0) <= most:
        return many.join(few, on)
    hot = F.broadcast(n.where(F.col("n") > most).select(F.col(on), F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    dealt = many.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = few.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return dealt.join(copies, [on, "_salt"]).drop("_salt")


#: Rows that an operator's Python sees at once; a worker's memory follows the texts of so many rows.
SLICE = 1000


def by_batch(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int | None = SLICE) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows; None leaves Spark's batches as they are."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    return df.mapInArrow((lambda batches: f(sliced(batches))) if rows else f, schema)


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash. It starts anew when it is full, so that a worker's memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at SPACE. bytes.lower and bytes.split know ASCII alone, which is the contract."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_MARKS = b".,;:!?#$%&*|()[]{}<>\"'`~_=+/\\-"


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _MARKS).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
