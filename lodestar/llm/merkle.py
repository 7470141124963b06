"""A Merkle manifest of a dataset: one root over all sources, and for each row a proof that leads to it.

A row is a leaf: a digest of its fields. The leaves of a source stand in order of doc_id under a tree
of FANOUT children a node; the sources' tops, in order of source, stand under another one. Places
come from a range partitioning and counts of each part, so no source is ordered in one task.

Trees are cut into superblocks of BLOCK leaves. Upwards, each superblock is reduced to one node and
these are superblocks again, until a tree has one node. Downwards, subtrees are exchanged: the nodes
of a superblock and the outer nodes that it needs (the siblings on the way from its top to the root)
are cogrouped, so that one task reduces the block, joins the proofs and folds them. Superblocks share
groups by hash, so small sources cost no group each and a hot source has as many groups as blocks.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import discard, small_or_shuffled, stored, table

FANOUT, HEIGHT = 16, 2
#: Leaves of a superblock (a subtree of HEIGHT levels), and nodes of a group of superblocks, about.
BLOCK, GROUP = FANOUT**HEIGHT, 2048
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5
PATH = "array<struct<l: string, r: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as its length in UTF-8 bytes, a colon and its value; `-` if it is null."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]), 256)


def _tree(source: Column) -> Column:
    """A name for a source's tree that is never null and sorts like the source, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _placed(rows: DataFrame, label: str) -> DataFrame:
    """`rows` (tree, key, digest, ...) with `pos` in its tree by key and digest, and `n`, the rows of the tree.

    Equal rows have any order among themselves, which changes no digest; they are dealt out by a third key.
    """
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange("tree", "key", "digest", "_salt").sortWithinPartitions("tree", "key", "digest")
    held = stored(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), label)
    spans = held.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")  # a row for each part that holds rows of the tree
    starts = stored(spans.select("tree", "_part", "_first", (F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(tree).alias("n")), f"{label}-starts")
    out = stored(held.join(small_or_shuffled(starts), ["tree", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before"), f"{label}-nodes")
    discard(held)
    discard(starts)
    return out


def _levels(digests: list[str], n: int) -> list[list[str]]:
    """The levels of a superblock of a tree of `n` nodes, from its nodes to its top."""
    out = [digests]
    for _ in range(HEIGHT):
        if n == 1:
            break
        last = out[-1]
        out.append([digest("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
        n = -(-n // FANOUT)
    return out


def _grouped(nodes: DataFrame, groups: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("g", F.pmod(F.xxhash64("tree", "block"), F.lit(groups)))


def _reduced(nodes: DataFrame, groups: int, label: str) -> DataFrame:
    """The tops of all superblocks: (tree, pos, n, digest)."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (tree, block), own in pdf.sort_values("pos").groupby(["tree", "block"], sort=False):
            n = int(own["n"].iloc[0])
            rows.append((tree, int(block), -(-n // BLOCK), _levels(own["digest"].tolist(), n)[-1][0]))
        return pd.DataFrame(rows, columns=["tree", "pos", "n", "digest"])

    return stored(_grouped(nodes.select("tree", "pos", "n", "digest"), groups).groupBy("g").applyInPandas(reduce, "tree string, pos long, n long, digest string"), label)


def _finished(nodes: DataFrame, outer: DataFrame, groups: int, fold: bool) -> DataFrame:
    """Cogroups the nodes (tree, pos, n, digest; to fold also doc_id and forged) with what stands above their superblocks (tree, pos, path, subroot, root).

    Returns tree, pos, path, root for nodes; doc_id, leaf, subroot, root, proof_sha256, folded_root for leaves.
    """

    def join(blocks: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        tops = {(t, b): (path, sub, root) for t, b, path, sub, root in zip(above["tree"], above["block"], above["path"], above["subroot"], above["root"], strict=True)}
        rows = []
        for (tree, block), own in blocks.sort_values("pos").groupby(["tree", "block"], sort=False):
            path, subroot, root = tops[tree, block]
            over = [(x["l"], x["r"]) for x in path]
            levels = _levels(own["digest"].tolist(), int(own["n"].iloc[0]))
            for i, x in enumerate(own.itertuples(index=False)):
                way, at = [], i
                for level in levels[:-1]:
                    first = at - at % FANOUT
                    way.append(("".join(level[first:at]), "".join(level[at + 1 : first + FANOUT])))
                    at //= FANOUT
                way += over
                if not fold:
                    rows.append((tree, x.pos, [{"l": a, "r": b} for a, b in way], root))
                    continue
                folded = x.forged or x.digest
                for a, b in way:
                    folded = digest(a + folded + b)
                rows.append((x.key, x.digest, subroot, root, digest("".join(a + b for a, b in way)), folded))
        columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"] if fold else ["tree", "pos", "path", "root"]
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"doc_id": "Int64"}) if fold else out

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" if fold else f"tree string, pos long, path {PATH}, root string"
    tops = outer.withColumnRenamed("pos", "block").withColumn("g", F.pmod(F.xxhash64("tree", "block"), F.lit(groups)))
    return _grouped(nodes, groups).groupBy("g").cogroup(tops.groupBy("g")).applyInPandas(join, schema)


def _climb(nodes: DataFrame, label: str) -> tuple[list[DataFrame], int]:
    """All levels of superblocks of the trees, from `nodes` to one node a tree, and the number of groups."""
    size, most = nodes.agg(F.count("*"), F.max("n")).first()
    groups, levels = max(1, -(-size // GROUP)), [nodes]
    while (most or 0) > 1:
        levels.append(_reduced(levels[-1], groups, f"{label}-{len(levels)}"))
        most = -(-most // BLOCK)
    return levels, groups


def manifest(rows: DataFrame, forged: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of each row of `rows` (doc_id, source, what `fields` names).

    `forged` is a leaf to fold in place of the row's own; null folds the row's own. A null field of a
    row differs from an empty one. Rows without source have a tree of their own, the first; rows
    without doc_id stand first in their tree. Rows that agree in doc_id stand in order of their
    digests; equal rows have leaves of their own, of one digest, side by side. Other columns, whatever
    their names, take no part. An empty table has no rows and no root.
    """
    leaves = rows.select(_tree(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("key"), leaf([F.col(f) for f in fields]).alias("digest"), (F.lit(None).cast("string") if forged is None else forged).alias("forged"))
    placed = _placed(leaves, "merkle-leaves")
    levels, groups = _climb(placed, "merkle-up")
    subroots = levels[-1].select("tree", F.col("digest").alias("subroot"))
    over = _placed(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), "merkle-sources")
    tops, top_groups = _climb(over, "merkle-top")
    none = F.lit(None).cast("string").alias("subroot")
    outer = tops[-1].select("tree", "pos", F.array().cast(PATH).alias("path"), none, F.col("digest").alias("root"))
    for below in tops[-2::-1]:
        outer = _finished(below, outer, top_groups, False).withColumn("subroot", F.lit(None).cast("string"))
    named = outer.join(over.select("tree", "pos", F.col("key").alias("name")), ["tree", "pos"])
    roots = stored(named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root").join(subroots, "tree"), "merkle-roots")
    outer = roots
    for below in levels[-2:0:-1]:
        outer = _finished(below, outer, groups, False).join(small_or_shuffled(roots.select("tree", "subroot")), "tree")
    out = stored(_finished(placed, outer, groups, True), "merkle-proofs")
    for df in (*levels, *tops, roots):
        discard(df)
    return out


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for each row of `documents`, folded over the row as it would be with A-Z of its text lower-cased where 5 divides the CRC-32 of its doc_id.

    Nulls: a null text stays null when it is tampered with; a row without doc_id is never tampered with.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, leaf([F.translate("text", upper, upper.lower()) if f == "text" else F.col(f) for f in FIELDS]))
    return manifest(table(spark, sf_dir, "documents"), forged).withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs: the runs of each level of the trees of `leaves` (tree, pos, n, h), and `{name}_top` (tree, h)."""
    ctes = [f"{name}_0 AS (SELECT tree, pos, n, h FROM {leaves})"]
    for k in range(levels):
        ctes.append(f"{name}_r{k} AS MATERIALIZED (SELECT tree, pos // {FANOUT} AS pos, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, list(h ORDER BY pos) AS run FROM {name}_{k} WHERE n > 1 GROUP BY tree, pos // {FANOUT})")
        ctes.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT tree, pos, n, sha256(array_to_string(run, '')) AS h FROM {name}_r{k})")
    ctes.append(f"{name}_top AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, h FROM {name}_{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    return ",\n".join(ctes)


def _way_sql(name: str, source: str, levels: int) -> str:
    """CTEs that carry `source` (id, tree, pos, proof, folded) up the runs of `name`; the last is `{name}_w{levels}`."""
    ctes, last = [], source
    for k in range(levels):
        own = f"p.pos % {FANOUT}"
        left, right = f"array_to_string(run[1:{own}], '')", f"array_to_string(run[{own} + 2:], '')"
        ctes.append(f"{name}_w{k} AS MATERIALIZED (SELECT p.id, p.tree, p.pos // {FANOUT} AS pos, CASE WHEN run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN run IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded FROM {last} p LEFT JOIN {name}_r{k} r ON r.tree = p.tree AND r.pos = p.pos // {FANOUT})")
        last = f"{name}_w{k}"
    return ",\n".join(ctes)


#: Levels that the SQL unrolls: FANOUT ** 6 documents of a source, FANOUT ** 3 sources.
_DEEP, _TOP = 6, 3
_CRC = "(SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS x FROM range(256) r(i)))"


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if f == "text" else f) for f in FIELDS) + ")"


OP13_SQL = f"""WITH crc AS {_CRC},
lf AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql('text')} AS h, {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low,
  xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % {TAMPERED} = 0 AS forged FROM documents, crc),
lp AS MATERIALIZED (SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM lf),
{_tree_sql('s', 'lp', _DEEP)},
sp AS MATERIALIZED (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM s_top),
{_tree_sql('t', 'sp', _TOP)},
st AS (SELECT id, tree, pos, '' AS proof, CASE WHEN forged THEN low ELSE h END AS folded FROM lp),
{_way_sql('s', 'st', _DEEP)},
mi AS (SELECT w.id, '' AS tree, sp.pos, proof, folded FROM s_w{_DEEP - 1} w JOIN sp ON sp.name = w.tree),
{_way_sql('t', 'mi', _TOP)}
SELECT doc_id, lp.h AS leaf, s_top.h AS subroot, t_top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t_top.h AS verified
FROM lp JOIN t_w{_TOP - 1} w USING (id) JOIN s_top ON s_top.tree = lp.tree CROSS JOIN t_top"""
