"""Ids of the packing operator: against the tokenizer itself, and what is encoded anew."""

from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from tidewheel.llm import packing

ODD = [
    "", None, " ", "\n\t x\r\n", "It's DON'T we'RE 'tis 'some x's.'s", "a1b22 3.4,5 ²x³ ½ ªº µ", "Ünïcödé, ÀÉÎÕÜ; ß... ×÷ \xad soft", "é café, Dž İstanbul ΣΑΣ ſ", "日本語テキスト 🙂 é word, Word.",
    "x <|endoftext|> y", "<| <|startoftext|>Z", "a\x85b\xa0c　d\x1ce\x0bf\x7f", "word,Word.WORD!###***", "y" * 3000, "​zero width", "#$%&*()|[]{}<>\"'`~_=+/\\-",
]


def plain(texts):
    model = Tokenizer.from_file(packing.tokenizer_path())
    return [model.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_equal_the_tokenizers():
    rng = random.Random(5)
    letters = [*map(chr, range(256)), *"'''  stmdrevl..", "́", "’", "ж", "<|"]
    texts = ODD + ["".join(rng.choices([c for c in letters if k % 2 or c.isprintable()], k=40)) for k in range(3000)]
    for most in (20, packing.CACHED_WORDS):
        ids = packing.Ids(packing.tokenizer_path(), most=most)
        for text, got, want in zip(texts, ids.of(texts), plain(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want, repr(text)


def test_a_word_is_encoded_once_whatever_its_case_and_marks_and_for_all_tasks_of_a_worker():
    ids = packing.Ids(packing.tokenizer_path())
    texts = ["Größe größe, GRÖSSE größe. (größe) größe! größe; Größe: größe? größe###", "größe... GRÖßE"]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.of(texts)] == plain(texts)
    assert sum("gr" in w.lower() for w in ids.known) == 2  # with ß and with ss
    assert packing._ids(packing.tokenizer_path()) is packing._ids(packing.tokenizer_path())
