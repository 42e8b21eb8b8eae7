"""Ids of the token files' words: against the tokenizer itself, and what is encoded anew."""

from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from tidewheel.llm import token_files as tf
from tidewheel.llm.packing import tokenizer_path


def plain(texts):
    model = Tokenizer.from_file(tokenizer_path(tf.TOKENIZER))
    return [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_any_latin_and_mixed_text_equal_the_tokenizers():
    rng = random.Random(7)
    letters = [*map(chr, range(256)), *"'''     \n\n\tstmdrevl..", "́", "’", "ж", "<|"]
    texts = ["".join(rng.choices([c for c in letters if k % 2 or c.isprintable() or c in "\n\t"], k=40)) for k in range(3000)]
    texts += [" ".join(rng.choices(["word", "жж,", "Größe;", "12", "日本", "x\ny", "it's"], k=9)) for _ in range(300)]
    for most in (20, tf.CACHED_WORDS):
        words = tf.WordIds(tokenizer_path(tf.TOKENIZER), most=most)
        for text, got, want in zip(texts, words.of(texts), plain(texts), strict=True):
            assert np.frombuffer(got, words.type).tolist() == want, repr(text)


def test_a_word_is_encoded_once_whatever_marks_follow():
    words = tf.WordIds(tokenizer_path(tf.TOKENIZER))
    texts = ["a größe, größe. größe! größe; größe: größe? größe### größe\tgröße", "a größe... größe  größe"]
    assert [np.frombuffer(x, words.type).tolist() for x in words.of(texts)] == plain(texts)
    assert sorted(w for w in words.known if "gr" in w) == [" größe", "größe"]  # after a space, after a tab
