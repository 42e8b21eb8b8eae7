"""Retrieval of passages in the latent space: against counts of every passage, and what it holds at once."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pytest

from tidewheel.llm import decontaminate as dc


def block(lengths, words, docs, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate(lengths)]
    texts = []
    for k in range(docs):
        text = rng.choices([*words, "other", "more"], k=rng.randrange(0, 300))
        own = rng.choice(items)[1].split()
        at = rng.randrange(len(text) + 1)
        texts.append(text[:at] + (rng.sample(own, math.ceil(0.7 * len(own))) if k % 2 else own) + text[at:] if k % 3 else text)
    hashes = dc.WordHashes()
    ids = [dc.word_ids(dc.plain_words(" ".join(t)), hashes) for t in texts]
    space = dc.Space(items, np.ones(dc.BUCKETS), len(ids))
    rows = np.zeros((len(space.rows), len(space.words)))
    for j, (at, x) in enumerate(space.rows):
        rows[j, at] = x
    return ids, space, dc.Latent(space, np.linalg.svd(rows, full_matrices=False)[2].T.astype(np.float32))


@pytest.mark.parametrize("lengths", [[9, 16, 20, 40, 60], [130, 180], [600, 30]])
def test_passages_that_hold_enough_of_an_item_are_retrieved(lengths, monkeypatch):
    monkeypatch.setattr(dc, "SPAN", 256)
    ids, space, latent = block(lengths, [f"w{i}" for i in range(400)], 60, len(lengths))
    want = set()
    for d, x in enumerate(ids):
        place = space.place[x & np.uint32(dc.BUCKETS - 1)]
        for j, size in enumerate(space.size_of.tolist()):
            for start in range(0, max(1, len(x) - size // 2), size // 2):
                own = place[max(0, start - size // 4) : start + size + size // 4]
                own = own[own >= 0]
                if space.has[own, j].sum() >= space.need[j] and space.times[np.unique(own), j].sum() >= space.need[j]:
                    want.add((d, start, size, j))
    got = {(d, begin, size, int(j)) for d, begin, size, _, found in dc.retrieved(ids, space, latent) for j in found}
    assert got == want
    assert want


def test_no_product_is_held_for_every_word_and_item():
    ids, space, latent = block([60] * 200, [f"w{i}" for i in range(3000)], 40, 1)
    ids = [np.concatenate(ids)]
    place = space.place[ids[0] & np.uint32(dc.BUCKETS - 1)]
    n = min(dc.SPAN, int((place >= 0).sum()))
    tracemalloc.start()
    list(dc.retrieved(ids, space, latent))
    assert tracemalloc.get_traced_memory()[1] < n * len(space.items) * latent.terms.itemsize
    tracemalloc.stop()
