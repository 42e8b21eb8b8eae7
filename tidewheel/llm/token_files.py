"""Token ids of a corpus as Arrow files of equal-length sequences, and what a training job reads from them.

Texts are dealt by ranges of doc_id, sorted and encoded where they lie; each part streams its ids into one file in Arrow's file format, whose
batches hold fixed-size lists: sequences of SEQUENCE ids beside a mask of the same length, which is false only where the last sequence of a
file is filled up. A second file of the same format holds where each document starts. Lists of one length have no offsets, so a sequence is
a slice of the mapped file. Only the last sequence of a part is padded; a part is a file, whatever the size of the corpus.

A task writes under a name of its own and returns it as a row; the table of these rows names the files that count. What a lost or repeated task
has left is in no row, so losing executors does no harm.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, drop_folder, id_and_text, scratch_dir, table, written
from .packing import Ids, byte_letters, tokenizer_path

SEQUENCE = 2048
#: Sequences of one record batch.
BATCH = 64
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Rows of one batch of a document index.
INDEX_ROWS = 65_536
#: Pieces whose ids a worker remembers.
CACHED_WORDS = 800_000


class WordIds:
    """Ids of a text, as bytes, by the piece: encoded once, remembered in bounded memory.

    The tokenizer first cuts a text, and never joins ids across such a cut: into words, numbers and runs of marks, each with the space before it, endings like 's and
    other white space. Texts of Latin-1 characters are cut the same way here and a new piece goes to the model as it is, so a word has one entry whatever marks follow.
    Other texts are cut at single spaces and at one or two line feeds, if they have no other white space; the rest and texts with special tokens are encoded whole.
    A piece's ids are those of the piece as a text.
    """

    OTHER = Ids.OTHER
    OTHER_SPACE = re.compile("[^\\S \n]|[\x1c-\x1f\x85\u180e]")
    #: The tokenizer's cut of Latin-1.
    PIECE = re.compile(" ?[{0}]+|'(?:[stmd]|re|ve|ll)| ?[{1}]+| ?[^{2}{0}{1}]+|[{2}]+(?![^{2}])|[{2}]+".format("A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t\n\r "))
    #: The cut of other texts.
    SPACED = re.compile(" ?[^ \n]+|\n")

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.letters, self.most = byte_letters(), most
        self.type = np.dtype("<u2" if self.model.get_vocab_size() <= 2**16 else "<u4")
        self.known: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.type).tobytes()

    def encoded(self, text: str) -> bytes:
        return self.packed(self.model.encode(text, add_special_tokens=False).ids)

    def piece(self, s: str) -> bytes:
        """Ids of one piece of a Latin-1 text, written as the vocabulary writes it."""
        shown = s.replace(" ", self.letters[32]) if s.isascii() and s.isprintable() else "".join(map(self.letters.__getitem__, s.encode()))
        return self.packed([t.id for t in self.model.model.tokenize(shown)])

    def learn(self, pieces: set[str]) -> None:
        for s in pieces:
            if self.PIECE.fullmatch(s):
                self.known[s] = self.piece(s)
            elif self.OTHER.search(s):
                self.known[s] = self.encoded(s)
            else:
                own = self.PIECE.findall(s)
                for p in own:
                    if p not in self.known:
                        self.known[p] = self.piece(p)
                self.known[s] = b"".join(map(self.known.__getitem__, own))

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 64):
            part = texts[at : at + 64]
            cut = [self.pieces(t) for t in part]
            new = set().union(*cut).difference(self.known)
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = set().union(*cut)
            self.learn(new)
            for text, pieces in zip(part, cut, strict=True):
                yield b"".join(map(self.known.__getitem__, pieces)) if pieces or not text else self.encoded(text)

    def pieces(self, text: str | None) -> list[str]:
        """The pieces of a text; none if it is empty or has to be encoded whole."""
        if not text or "<|" in text:
            return []
        if not self.OTHER.search(text):
            return self.PIECE.findall(text)
        if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[0] in " \n" or text[-1] in " \n" or self.OTHER_SPACE.search(text):
            return []
        return self.SPACED.findall(text)


@lru_cache(maxsize=1)
def _words(path: str) -> WordIds:
    """A worker's memory of words, over all its tasks."""
    return WordIds(path)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def file_schema(kind: pa.DataType, sequence: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", kind, nullable=False), sequence), nullable=False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), sequence), nullable=False)])


INDEX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Part:
    """Writes the two files of one part."""

    def __init__(self, folder: str, kind: np.dtype, sequence: int):
        self.name, self.kind, self.sequence = uuid.uuid4().hex, kind, sequence
        self.system, path = _file_system(folder)
        self.system.create_dir(path, recursive=True)
        self.schema = file_schema(pa.from_numpy_dtype(kind), sequence)
        self.sinks = [self.system.open_output_stream(f"{path}/{self.name}{end}") for end in (".arrow", ".docs.arrow")]
        self.ids, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], INDEX_SCHEMA)
        self.held, self.size, self.docs, self.tokens, self.n_docs = [], 0, [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, whole = len(ids) // self.kind.itemsize, BATCH * self.sequence * self.kind.itemsize
        self.docs.append((doc_id, self.tokens, n))
        self.tokens += n
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= whole:
            joined = b"".join(self.held)
            cut = len(joined) // whole * whole
            for at in range(0, cut, whole):
                self.sequences(np.frombuffer(joined, self.kind, whole // self.kind.itemsize, at))
            self.held, self.size = [joined[cut:]], len(joined) - cut
        if len(self.docs) == INDEX_ROWS:
            self.flush_index()

    def sequences(self, ids: np.ndarray) -> None:
        """A batch of these ids, filled up to whole sequences."""
        full = -(-len(ids) // self.sequence) * self.sequence
        mask = np.arange(full) < len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((np.pad(ids, (0, full - len(ids))), mask), self.schema, strict=True)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def flush_index(self) -> None:
        self.n_docs += len(self.docs)
        if self.docs:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=INDEX_SCHEMA))
        self.docs = []

    def close(self) -> tuple[str, int, int, int]:
        """(name, documents, tokens, sequences)"""
        if self.size:
            self.sequences(np.frombuffer(b"".join(self.held), self.kind))
        self.flush_index()
        for x in (self.ids, self.index, *self.sinks):
            x.close()
        return self.name, self.n_docs, self.tokens, -(-self.tokens // self.sequence)


def token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of docs in ascending order of ids into `folder`, which driver and executors share; returns the table of its files.

    The table: (part, name, n_docs, n_tokens, n_sequences, before: tokens of all earlier parts, sequences_before). A null or empty text is its end id
    alone; a null id comes first; rows of one id are ordered by a hash of their text. An empty corpus has no files. `folder` is a path or a URI that Arrow knows.
    """
    path = path or tokenizer_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = _words(path), None
        end = words.packed([end_id])
        for b in batches:
            if b.num_rows and part is None:
                part = _Part(folder, words.type, sequence)
            for doc, ids in zip(b.column("doc_id").to_pylist(), words.of(b.column("text").to_pylist()), strict=True):
                part.add(doc, ids + end)
        if part:
            row = (TaskContext.get().partitionId(), *part.close())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "name", "n_docs", "n_tokens", "n_sequences"])

    # Ranges are found from a sample of the keys, so the keys hold no texts.
    by = [F.col("doc_id"), F.xxhash64("text")]
    dealt = id_and_text(docs, id_col, text_col).repartitionByRange(*by).sortWithinPartitions(*by)
    files = written(by_batch(dealt, run, "part long, name string, n_docs long, n_tokens long, n_sequences long"), "token-files")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file, not a row a document
    return written(files.select("*", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(a) for c, a in (("n_tokens", "before"), ("n_sequences", "sequences_before")))), "token-files")


class Sequences:
    """Random access to the sequences of one file. On a local path ids are slices of the mapped file: nothing is read or copied before its use."""

    def __init__(self, folder: str, name: str):
        system, path = _file_system(folder)
        local = system.type_name == "local"
        opened = [pa.memory_map(f"{path}/{name}{end}") if local else system.open_input_file(f"{path}/{name}{end}") for end in (".arrow", ".docs.arrow")]
        self.file, self.index = (pa.ipc.open_file(x) for x in opened)
        self.length = self.file.schema.field("ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """The ids of a record batch as one array, without a copy, and their mask."""
        b = self.file.get_batch(k)
        return b.column("ids").values.to_numpy(), b.column("mask").values

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k. All batches but the last have BATCH sequences, so its place is arithmetic."""
        ids, mask = self.batch(k // BATCH)
        at = k % BATCH * self.length
        return ids[at : at + self.length], mask.slice(at, self.length).to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in the file, tokens, crc32 of the ids as little-endian unsigned 32-bit integers), read from the masked ids in the file."""
        wide, at, ids, real = BATCH * self.length, -1, None, 0
        for k in range(self.index.num_record_batches):
            for doc, start, n in zip(*(c.to_pylist() for c in self.index.get_batch(k).columns), strict=True):
                crc, done = 0, 0
                while done < n:
                    if (start + done) // wide != at:
                        at = (start + done) // wide
                        ids, mask = self.batch(at)
                        real = mask.true_count
                    begin = (start + done) % wide
                    piece = ids[begin : min(begin + n - done, real)]
                    if not len(piece):
                        raise ValueError(f"document {doc} has {n} tokens, its file {done}")
                    crc, done = zlib.crc32(piece.astype("<u4").tobytes(), crc), done + len(piece)
                yield doc, start, n, crc


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files of a table that token_files() has returned. A file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before in zip(b.column("name").to_pylist(), b.column("before").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc, start, n, crc in Sequences(folder, name).documents():
                    rows.append((doc, before + start, n, crc))
                    if len(rows) == INDEX_ROWS:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return files.select("part", "name", "before").repartitionByRange(max(1, files.count()), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids start in the files of the whole corpus, how many there are and their checksum, all read back from the files.

    A null or empty text is its end id alone; null ids come first, rows of one id in the order of a hash of their texts, equal rows each by themselves; long texts are
    encoded whole. An empty table gives no rows, further columns are not read. The files go once the result is a table of its own.
    """
    folder = f"{scratch_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    found = written(read_documents(token_files(table(spark, sf_dir, "documents"), folder), folder), "token-documents")
    drop_folder(spark, folder)
    return found
