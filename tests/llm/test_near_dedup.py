"""Near-dedup against all pairs, with groups that no round may multiply."""

import random

from tidewheel.llm import near_dedup
from tidewheel.llm.common import WordHashes


def brute(docs):
    sets = {i: set(near_dedup.shingle_set(t, WordHashes()).tolist()) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(120)]
    docs = []
    for _ in range(250):  # copies with independent edits, some of them with half the edits of another
        own = list(rng.choice(docs).split()) if docs and rng.random() < 0.2 else list(base)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[word()], [], [own[at], word()]])
        docs.append(" ".join(own))
    passage = [word() for _ in range(30)]
    docs += [" ".join([word() for _ in range(rng.randrange(25))] + passage + [word() for _ in range(rng.randrange(25))]) for _ in range(200)]
    docs += [" ".join(base[: rng.randrange(60, 120)]) for _ in range(60)]
    docs += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["a b c", "A  b\tc", "a b", "", None, "  \n "]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_as_all_pairs_from_few_candidates(spark, monkeypatch):
    """Components of all pairs; confirmed pairs grow with documents, not with pairs of a group."""
    docs = corpus()
    seen = []
    plain = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, texts: seen.append(pairs.count()) or plain(pairs, texts))
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out) and len(out) == len(docs)
    assert sum(seen) < 5 * len(docs)


def template(n):
    """n texts of one template of 400 words with 40 slots, each with 20 of 40 fixed alternatives; hardly any is near another."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    docs = []
    for i in range(n):
        own = list(base)
        for slot in rng.sample(range(40), 20):
            own[slot * 10 + 4] = f"alternative{slot}"
        docs.append((i, " ".join(own)))
    return docs


def test_texts_of_one_template(spark, monkeypatch):
    """No difference is rare: same components as all pairs, by crowds whose keys and pairs stay in the thousands a text (91,000 rows a text before)."""
    docs, seen = template(300), []
    met, finer, crowded = near_dedup._met, near_dedup._finer, near_dedup._crowded

    def counted(rows):
        seen.append(rows.count())
        return rows

    monkeypatch.setattr(near_dedup, "_met", lambda *a: counted(met(*a)))
    monkeypatch.setattr(near_dedup, "_finer", lambda *a: counted(finer(*a)))
    monkeypatch.setattr(near_dedup, "_crowded", lambda *a: counted(crowded(*a)))
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(docs)
    assert len(seen) == 4 and sum(seen) < 5000 * len(docs)


def test_finer_keys_find_pairs_at_the_threshold():
    """At each fineness a pair of similarity 0.75 shares a key, and one of 0.3 hardly ever."""
    rng = random.Random(3)
    places = {level: near_dedup.drawn(near_dedup.finer_rows(level)) for level in (1, 4, 6)}
    for _ in range(40):
        shingles = near_dedup.mixed(near_dedup.np.array(rng.sample(range(1 << 40), 1700), near_dedup.np.uint64))
        low = [near_dedup.minhashes(s, near_dedup._POOL_A, near_dedup._POOL_B) for s in (shingles[:700], shingles[100:800], shingles[323:1023])]
        for level, at in places.items():
            keys = [set(near_dedup.finer_keys(x, at, level).tolist()) for x in low]
            assert keys[0] & keys[1]
            assert level < 4 or len(keys[0] & keys[2]) < 3


def test_null_ids_repeats_clashing_columns_long_text(spark):
    text = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, text, "s"), (2, text + " y", "s"), (2, text + " y", "s"), (None, text, "s"), (5, "z " * 100_000, None), (6, "z " * 7, None), (7, None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (5, 5, True), (6, 5, False), (7, 7, True)]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
