"""Merkle manifest of a table: a binary tree a group, one over the groups' roots, and a proof for each row.

Rows get their places in a tree by a range sort and counts of its parts. Trees are cut into aligned blocks of 2**LEVELS nodes. Executors
hand whole blocks as Arrow tables to DuckDB, which works out each level by an ordered string_agg and sha256. Spark climbs: the roots of
blocks are nodes of the next, 2**LEVELS times smaller table, until a tree is one root. Back down, the proof of a block travels as one more row
among the block's own, so no row carries what its block shares. No step brings a tree to one task or to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, table, written

#: A block holds 2**LEVELS nodes.
LEVELS = 10
#: Nodes that DuckDB takes at once, as whole blocks, are this many or a block's.
CHUNK = 16_384


def hashed(*values: Column) -> Column:
    """H of values: lowercase hex sha256 of byte count, ``:`` and value of each, ``-`` for a null, all joined."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values))), 256)


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree, ...) as a table with i, the place in its tree by `order`, and n, the nodes of the tree.

    One range sort; places are those in a sorted part and what parts before it hold of the tree. Rows equal in `order` take neighbouring places.
    """
    parts = written(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)
    tree = Window.partitionBy("tree")
    runs = parts.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n")), "merkle-runs")
    found = parts.withColumn("_part", part).join(runs, ["tree", "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
    found = written(found, "merkle-placed")
    drop_written(parts, runs)
    return found


@lru_cache(maxsize=1)
def _engine():
    """A worker's DuckDB, with one thread and bounded memory."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '512MB'")
    return con


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some whole blocks each, of rows sorted by tree and block."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < CHUNK:
            continue
        t = pa.Table.from_batches(held)
        last = pc.and_(pc.equal(t["tree"], t["tree"][-1]), pc.equal(t["block"], t["block"][-1]))
        whole = t.num_rows - pc.sum(last).as_py()
        if whole:
            yield t.slice(0, whole)
        held = t.slice(whole).combine_chunks().to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t


def _climb(con, size: int, proofs: bool) -> None:
    """From the registered `chunk` to the table `node` of block roots (g, h); with proofs, to `proof` (g, ..., steps) as well.

    A step of a proof is the sibling's side, l or r, and digest, or '' where a node has none.
    """
    con.execute(f"""CREATE OR REPLACE TEMP TABLE node AS
        SELECT dense_rank() OVER (ORDER BY tree, block) AS g, i - block * {size} AS i, depth, h FROM chunk WHERE i >= 0""")
    if proofs:
        con.execute(f"""CREATE OR REPLACE TEMP TABLE proof AS
            SELECT dense_rank() OVER (ORDER BY tree, block) AS g, i - block * {size} AS i, depth, CAST([] AS VARCHAR[]) AS steps, tree, i AS place, id, h, shown FROM chunk WHERE i >= 0""")
    for level in range(con.execute("SELECT coalesce(max(depth), 0) FROM node").fetchall()[0][0]):
        if proofs:
            con.execute(f"""CREATE OR REPLACE TEMP TABLE proof AS
                SELECT p.* REPLACE (p.i // 2 AS i,
                    CASE WHEN p.depth > {level} THEN list_append(p.steps, CASE WHEN s.h IS NULL THEN '' WHEN p.i % 2 = 0 THEN 'r' || s.h ELSE 'l' || s.h END) ELSE p.steps END AS steps)
                FROM proof p LEFT JOIN node s ON s.g = p.g AND s.i = xor(p.i, 1)""")
        con.execute(f"""CREATE OR REPLACE TEMP TABLE node AS
            SELECT g, i // 2 AS i, any_value(depth) AS depth, CASE WHEN any_value(depth) > {level} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
            FROM node GROUP BY g, i // 2""")


def _roots(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for chunk in _blocks(batches):
            con.register("chunk", chunk)
            _climb(con, size, proofs=False)
            yield from con.sql(f"""SELECT b.tree, b.i, CAST(ceil(b.n / {size}) AS BIGINT) AS n, node.h
                FROM (SELECT tree, block AS i, any_value(n) AS n, dense_rank() OVER (ORDER BY tree, block) AS g FROM chunk GROUP BY tree, block) b JOIN node USING (g)""").to_arrow_table().to_batches()

    return run


def _proofs(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for chunk in _blocks(batches):
            con.register("chunk", chunk)
            _climb(con, size, proofs=True)
            yield from con.sql("""SELECT p.tree, p.place AS i, p.id, p.h, p.shown, list_concat(p.steps, o.steps) AS steps, o.subroot, o.root
                FROM proof p JOIN (SELECT steps, subroot, root, i, dense_rank() OVER (ORDER BY tree, block) AS g FROM chunk) o ON o.g = p.g AND o.i < 0""").to_arrow_table().to_batches()

    return run


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "i")


def _cut(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes with their block and the levels that a block of their tree has."""
    n = F.col("n")
    return nodes.withColumn("block", F.shiftright("i", levels)).withColumn("depth", F.when(n > 1, F.least(F.lit(levels), F.length(F.bin(n - 1)))).otherwise(0))


def climbed(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Tables of nodes (tree, i, n, h): the given one, then the roots of its blocks, and so on up to one root a tree."""
    tables = [nodes]
    while len(tables) == 1 or (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        cut = _cut(tables[-1], levels).select("tree", "block", "i", "n", "depth", "h")
        tables.append(written(_by_block(cut).mapInArrow(_roots(2**levels), "tree string, i long, n long, h string"), "merkle-nodes"))
    return tables


def proven(tables: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, i, id, h, shown, steps, subroot, root) of the lowest table. above: (tree, steps, subroot, root), what follows the root of each tree."""
    proofs = above.withColumn("i", F.lit(0).cast("long"))
    for nodes in reversed(tables[:-1]):
        own = _cut(nodes, levels)
        for name in ("id", "shown"):
            if name not in nodes.columns:
                own = own.withColumn(name, F.lit(None).cast("long" if name == "id" else "string"))
        own = own.select("tree", "block", "i", "depth", "id", "h", "shown", *(F.lit(None).cast(kind).alias(c) for c, kind in (("steps", "array<string>"), ("subroot", "string"), ("root", "string"))))
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("depth", "int"), ("id", "long"), ("h", "string"), ("shown", "string"))]
        shared = proofs.select("tree", F.col("i").alias("block"), F.lit(-1).cast("long").alias("i"), *none, "steps", "subroot", "root")
        proofs = _by_block(own.unionByName(shared)).mapInArrow(_proofs(2**levels), "tree string, i long, id long, h string, shown string, steps array<string>, subroot string, root string")
    return proofs


def folded(shown: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    digest = lambda s: F.substring(s, 2, 64)
    return F.aggregate(steps, shown, lambda f, s: F.sha2(F.when(s == "", f).when(s.startswith("l"), F.concat(digest(s), f)).otherwise(F.concat(f, digest(s))), 256))


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, tree, i, leaf, shown, steps, subroot, root) of rows (id long, tree string, h string, shown string).

    h: the digest of a row. shown: the digest that is later checked, as of tampered data; a null means h. Trees are in the order of their names as bytes.
    Rows of equal id in a tree are ordered by digest; equal rows keep a leaf each. A null id comes first. An empty table gives no rows.
    """
    inner = climbed(placed(rows, ["id", "h"]), levels)
    tops = placed(inner[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h"), ["name"])
    over = climbed(tops.select("tree", "i", "n", "h"), levels)
    root = over[-1].select("tree", F.expr("cast(array() as array<string>)").alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    outer = proven(over, root, levels).join(tops.select("i", "name"), "i")
    above = written(outer.select(F.col("name").alias("tree"), "steps", F.col("h").alias("subroot"), "root"), "merkle-above")
    return proven(inner, above, levels).select("id", "tree", "i", F.col("h").alias("leaf"), F.coalesce("shown", "h").alias("shown"), "steps", "subroot", "root")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of documents by language, each proof folded again; where crc32 of the id is a multiple of 7, from tampered data.

    A null or empty text, a null language, id or count each hash as stated by hashed(); null and empty languages are two trees. A null id is not tampered with.
    Repeated ids are ordered by leaf, equal rows keep a leaf each; further columns are not read. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    leaf = lambda n: hashed(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(F.col("n_chars") + 1))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf(F.col("n_chars")).alias("h"), tampered.alias("shown"))
    found = manifest(written(rows, "merkle-leaves"))
    siblings = F.array_join(F.transform("steps", lambda s: F.substring(s, 2, 64)), "")
    out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("shown"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL below follows: trees of up to 2**24 leaves and 2**10 languages.
_SQL_LEVELS, _SQL_OUTER = 24, 10


def _tree_sql(start: str, name: str, levels: int) -> str:
    """CTEs from `start` (tree, i, h): nodes of each level, and for each leaf the steps to its root, after the last level in {name}_p{levels}."""
    out = [f"{name}_n0 AS (SELECT tree, i, h FROM {start})", f"{name}_p0 AS (SELECT tree, i AS leaf, i, CAST([] AS VARCHAR[]) AS steps FROM {start})"]
    for k in range(levels):
        out.append(f"""{name}_c{k} AS (SELECT tree, count(*) AS n FROM {name}_n{k} GROUP BY tree)""")
        out.append(f"""{name}_n{k + 1} AS (SELECT tree, i // 2 AS i, CASE WHEN any_value(c.n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}_n{k} JOIN {name}_c{k} c USING (tree) GROUP BY tree, i // 2)""")
        out.append(f"""{name}_p{k + 1} AS (SELECT p.tree, p.leaf, p.i // 2 AS i, CASE WHEN c.n > 1 THEN list_append(p.steps, CASE WHEN s.h IS NULL THEN '' WHEN p.i % 2 = 0 THEN 'r' || s.h ELSE 'l' || s.h END) ELSE p.steps END AS steps
            FROM {name}_p{k} p JOIN {name}_c{k} c USING (tree) LEFT JOIN {name}_n{k} s ON s.tree = p.tree AND s.i = xor(p.i, 1))""")
    return ",\n".join(out)


def _oracle() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda n: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field(n)} || {field('text')})"
    crc = """xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))"""
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("n_chars")} AS h, CASE WHEN {crc} % 7 = 0 THEN {leaf("(n_chars + 1)")} END AS shown FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
{_tree_sql("numbered", "a", _SQL_LEVELS)},
tops AS (SELECT 0 AS tree, tree AS name, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM a_n{_SQL_LEVELS}),
{_tree_sql("tops", "b", _SQL_OUTER)},
found AS (
    SELECT l.doc_id, l.h AS leaf, t.h AS subroot, r.h AS root, coalesce(l.shown, l.h) AS shown, list_concat(p.steps, q.steps) AS steps
    FROM numbered l JOIN a_p{_SQL_LEVELS} p ON p.tree = l.tree AND p.leaf = l.i JOIN tops t ON t.name = l.tree JOIN b_p{_SQL_OUTER} q ON q.leaf = t.i, b_n{_SQL_OUTER} r
),
ends AS (
    SELECT *, list_reduce(list_prepend(shown, steps), lambda f, s: CASE WHEN s = '' THEN sha256(f) WHEN s[1] = 'l' THEN sha256(s[2:] || f) ELSE sha256(f || s[2:]) END) AS folded_root FROM found
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM ends
"""


ORACLE_OP13 = _oracle()
