"""Arrow token files: ids against the tokenizer itself, round trips, random access, edges."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from tidewheel.llm import token_files as tf
from tidewheel.llm.packing import tokenizer_path

ODD = [
    "", None, " ", "\n", "a", " a", "a ", "a  b", "a   b", "a\nb", "a\n\nb", "a\n\n\nb", "a \nb", "a\n b", "a\tb", "a\u3000b c", "a\x85b", "a\x1cb c", "it's don't 'tis", "x <|endoftext|> y", "<|", "42 1,234.5 é2",
    "Ünïcödé, wörds; and... marks!!! 日本語テキスト 🙂 é", "word,\nword. word", "__init__ a_b-c/d", "y" * 5000, "\r\nline\r\n", "ends.\n", "\u200bzero width", "a\xa0b", "ß (x) #tag $5",
]


def plain(texts):
    model = Tokenizer.from_file(tokenizer_path(tf.TOKENIZER))
    return [[*model.encode(t or "", add_special_tokens=False).ids, tf.END_ID] for t in texts]


def expected(rows):
    out, start = [], 0
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    text_hash = lambda t: 42 if t is None else signed(xxhash.xxh64(t.encode(), 42).intdigest())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    for (doc, _), ids in zip(rows, plain([t for _, t in rows]), strict=True):
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_of_texts_have_the_ids_of_whole_texts():
    words = tf.WordIds(tokenizer_path(tf.TOKENIZER), most=7)
    for texts in ([t] for t in ODD):
        for text, got, ids in zip(texts, words.of(texts), plain(texts), strict=True):
            assert np.frombuffer(got, words.type).tolist() == ids[:-1], text
    many = [" ".join(f"wört{i * k % 97} and{chr(97 + i % 26)}{chr(97 + k % 26)}, x" for i in range(40)) for k in range(200)]
    for got, ids in zip(tf.WordIds(tokenizer_path(tf.TOKENIZER), most=60).of(many), plain(many), strict=True):
        assert np.frombuffer(got, words.type).tolist() == ids[:-1]
    assert list(tf.WordIds(tokenizer_path(tf.TOKENIZER)).of(ODD * 3)) == list(words.of(ODD * 3))


def test_generated_texts_have_the_ids_of_whole_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    words, model = tf.WordIds(tokenizer_path(tf.TOKENIZER)), Tokenizer.from_file(tokenizer_path(tf.TOKENIZER))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(["the", "Wörd", "x1", "'s", ".", "!?", " ", "  ", "\n", "\t", "é", "-", "_", "ing", "12", " ", "日", "<|"]), max_size=25).map("".join))
    def check(text):
        assert np.frombuffer(next(words.of([text])), words.type).tolist() == model.encode(text, add_special_tokens=False).ids

    check()


def test_query_equals_the_tokenizer_in_order_over_odd_rows(spark, tmp_path):
    rows = [(i * 3 % 31, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (5, "again"), (5, "again"), (5, None), (900, "long words " * 4000), (-4, "first")]
    spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, start long, name string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in tf.op11_token_files(spark, str(tmp_path)).collect()]
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tf.op11_token_files(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("sequence", [8, 64])
def test_any_sequence_is_a_slice_of_its_mapped_file(spark, tmp_path, sequence):
    rows = [(i, f"text number {i} " * (1 + i % 40) + "end") for i in range(300)]
    files = tf.token_files(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/ids", sequence=sequence).orderBy("part").collect()
    assert sum(f.n_docs for f in files) == 300
    ids, before = [], 0
    for f in files:
        assert f.before == len(ids)
        assert f.sequences_before == before
        before += f.n_sequences
        s = tf.Sequences(f"{tmp_path}/ids", f.name)
        for k in range(f.n_sequences):
            own, mask = s[k]
            assert len(own) == len(mask) == sequence
            assert mask.all() or k == f.n_sequences - 1
            ids += own[mask].tolist()
        first, _ = s[0]
        whole, _ = s.batch(0)
        assert not first.flags.owndata
        assert np.shares_memory(first, whole)
        held = s.file.get_batch(0).column("ids").values.buffers()[1]
        assert first.__array_interface__["data"][0] == held.address
    assert ids == [x for one in plain([t for _, t in rows]) for x in one]
    assert len(ids) == files[-1].before + files[-1].n_tokens


def test_a_file_that_misses_ids_is_an_error(spark, tmp_path):
    part = tf._Part(str(tmp_path), np.dtype("<u2"), 8)
    part.add(1, np.arange(5, dtype="<u2").tobytes())
    part.docs.append((2, 5, 3))
    name, *_ = part.close()
    with pytest.raises(ValueError, match="document 2 has 3 tokens"):
        list(tf.Sequences(str(tmp_path), name).documents())
