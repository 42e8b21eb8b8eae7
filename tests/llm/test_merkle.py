"""The Merkle manifest against a plain recursion over lists."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest

from tidewheel.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*values) -> str:
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def joined(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str]) -> tuple[str, list[list[str]], list[list[tuple[int, list[str]]]]]:
    """The root; for each leaf its siblings, and (own place in the run, the run's others) level by level."""
    at, siblings, runs = list(range(len(nodes))), [[] for _ in nodes], [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
            others = run[: i % 2] + run[i % 2 + 1 :]
            siblings[leaf] += others
            runs[leaf].append((i % 2, others))
        nodes = [joined(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], siblings, runs


def brute(rows) -> list[tuple]:
    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest(*r), r))
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    inner = {k: climb([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order}
    root, outer_siblings, outer_runs = climb([inner[k][0] for k in order])
    out = []
    for k, own, steps in zip(order, outer_siblings, outer_runs, strict=True):
        subroot, siblings, runs = inner[k]
        for (_, _, leaf, r), s, run in zip(sorted(langs[k], key=lambda x: x[:3]), siblings, runs, strict=True):
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            f = digest(*r[:3], r[3] + 1, r[4]) if tampered else leaf
            for place, others in run + steps:
                f = joined(others[:place] + [f] + others[place:])
            out.append((r[0], leaf, subroot, root, joined(s + own), f, f == root))
    return sorted(out, key=str)


def tree_rows(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, COLUMNS)
    leaf = lambda n: merkle.hashed(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    return df.select(F.col("doc_id").alias("id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf(F.col("n_chars")).alias("h"), F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(F.col("n_chars") + 1)).alias("shown"))


def corpus(n: int, langs: int):
    return [(i, f"s{i % 3}", None if i % (langs + 1) == langs else f"l{i % (langs + 1)}", None if i % 11 == 0 else i, f"Text Ünï {i}") for i in range(n)]


@pytest.mark.parametrize(("n", "langs", "levels"), [(1, 1, 2), (2, 1, 2), (9, 2, 1), (70, 2, 2), (100, 1, 3), (45, 12, 2), (64, 1, 10)])
def test_blocks_of_any_size_give_the_tree_of_a_plain_recursion(spark, n, langs, levels):
    rows = corpus(n, langs)
    got = merkle.manifest(tree_rows(spark, rows), levels).collect()
    want = {(r[0], r[1]): r for r in brute(rows)}
    assert len(got) == len(rows)
    for r in got:
        doc, leaf, subroot, root, proof, folded_root, _ = want[(r.id, r.leaf)]
        assert (r.subroot, r.root) == (subroot, root)
        assert joined(s[1:] for s in r.steps) == proof
        assert (r.shown == leaf) == (folded_root == root)


def test_query_over_nulls_repeats_ties_and_odd_columns(spark, tmp_path):
    rows = corpus(40, 2) + [(3, None, None, None, None), (None, "x", "l0", 5, ""), (7, "s1", "", 2, ""), (7, "s1", "", 2, ""), (7, "s1", "l0", 9, "other"), (8, "s", "é", 1, "x" * 300_000)]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS + ", tree string, block int").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert {r.verified for r in got} == {True, False}


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op13_merkle_manifest(spark, str(tmp_path)).count() == 0
