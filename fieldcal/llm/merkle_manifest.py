"""Merkle manifest of a table: one tree of digests per language, one over their roots, and a proof for every row.

A leaf is the SHA-256 of a row's columns. Within a tree two consecutive nodes, or a last single one, become the digest of their
digests in hex. Nodes are numbered by a range sort (leaves by tree, doc_id and digest; counts per sorted partition give each
partition its first number), and trees grow in blocks of ``2 ** BLOCK_LEVELS`` neighbours, so a task holds one block, never a tree.

Proofs come from pointer jumping. Every node starts with the segment of siblings that leads to its parent: its one sibling, or null
where it has none. A round joins nodes with the nodes their pointers lead to, joins the two segments and so doubles the distance. Only
nodes whose level is a multiple of the distance are still jumped to, so the inner nodes kept shrink from round to round; leaves take
one join a round, until their pointer is the root. Their subroot's own segment in the upper tree is the last jump.

Defined results: null columns count as ``-``; a null doc_id sorts first; rows that share tree and doc_id are ordered by digest, and
equal rows have equal digests; a null tree key is a tree of its own and comes first; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.session import cut_lineage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 10
NODE = "tree string, level int, pos long, depth int, digest binary, sibling binary, top boolean, doc_id long, changed binary"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its length in bytes, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their number ``pos`` within ``tree``, and the tree's ``depth``. Ties of ``order`` are dealt out by row, so a
    repeated row spreads over several ranges."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    keys = ["tree", *order, "salt"]
    placed = cut_lineage(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    # one row per tree and sorted partition
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut_lineage(counts.select(
        "tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("n")))
    bits = F.length(F.bin(F.col("n") - 1))  # of n - 1: levels above the leaves, for n > 1
    return placed.join(shifts, ["tree", "part"]).select(
        *rows.columns, (F.col("row") + F.col("shift")).alias("pos"), F.when(F.col("n") > 1, bits).otherwise(0).alias("depth"))


def _grow(levels: int):
    """Nodes of one block with their siblings, up to ``levels`` levels or the root."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, depth, level = (table.column(c)[0].as_py() for c in ("tree", "depth", "level"))
        first = table.column("pos")[0].as_py()
        nodes = table.column("digest").to_pylist()
        done = []
        for up in range(level, min(depth, level + levels)):
            siblings = [nodes[i ^ 1] if i ^ 1 < len(nodes) else None for i in range(len(nodes))]
            done.append((up, first, nodes, siblings))
            texts = [d.hex().encode() for d in nodes]
            nodes = [hashlib.sha256(b"".join(texts[i : i + 2])).digest() for i in range(0, len(texts), 2)]
            first >>= 1
        if not done and level == 0:
            done.append((0, first, nodes, [None] * len(nodes)))
        above = min(depth, level + levels)
        sizes = [len(d[2]) for d in done]
        total = sum(sizes)

        def own(name, kind):
            there = table.column(name).combine_chunks()
            if level:
                return pa.nulls(total + 1, kind)
            return pa.concat_arrays([there.cast(kind), pa.nulls(total + 1 - len(there), kind)])

        return pa.table({
            "tree": pa.array([tree] * (total + 1), pa.string()),
            "level": pa.array([d[0] for d in done for _ in d[2]] + [above], pa.int32()),
            "pos": pa.array([d[1] + i for d in done for i in range(len(d[2]))] + [first], pa.int64()),
            "depth": pa.array([depth] * (total + 1), pa.int32()),
            "digest": pa.array([x for d in done for x in d[2]] + nodes, pa.binary()),
            "sibling": pa.array([x for d in done for x in d[3]] + [None], pa.binary()),
            "top": pa.array([False] * total + [True], pa.bool_()),
            "doc_id": own("doc_id", pa.int64()), "changed": own("changed", pa.binary()),
        })
    return run


def grow(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> tuple[DataFrame, int]:
    """All nodes of all trees, and the greatest depth. ``leaves``: tree, pos, depth, digest, doc_id, changed."""
    height = leaves.agg(F.max("depth")).first()[0] or 0
    current = leaves.withColumn("level", F.lit(0))
    nodes = None
    for level in range(0, max(height, 1), block_levels):
        blocks = current.withColumn("block", F.shiftright("pos", block_levels)).groupBy("tree", "block")
        made = cut_lineage(blocks.applyInArrow(_grow(block_levels), NODE))
        # tops below a root are the first level of the next blocks
        kept = made.where("not top or level = depth")
        nodes = kept if nodes is None else nodes.unionByName(kept)
        current = made.where("top and level < depth").drop("top", "sibling")
    return nodes, height


def _jump(near: DataFrame, far: DataFrame, distance: int) -> DataFrame:
    """``near`` with the segments of the nodes ``distance`` levels above."""
    far = far.select(F.col("tree").alias("f_tree"), F.col("level").alias("f_level"), F.col("pos").alias("f_pos"), F.col("segment").alias("f_segment"))
    meet = (
        (F.col("tree") == F.col("f_tree")) & (F.col("level") + distance == F.col("f_level"))
        & (F.shiftright("pos", distance) == F.col("f_pos"))
    )
    longer = F.concat("segment", F.coalesce("f_segment", F.array().cast("array<binary>")))
    return near.join(far, meet, "left").withColumn("segment", longer).drop("f_tree", "f_level", "f_pos", "f_segment")


def proofs(nodes: DataFrame, height: int) -> DataFrame:
    """The leaves with ``segment``: the sibling at each level up to the root of the tree, null where there is none."""
    started = nodes.where("not top").withColumn("segment", F.when(F.col("depth") > 0, F.array("sibling")).otherwise(F.array().cast("array<binary>")))
    leaves = started.where("level = 0").drop("sibling", "top")
    inner = started.where("level > 0").select("tree", "level", "pos", "segment")
    distance = 1
    while distance < height:
        leaves = _jump(leaves, inner.where(F.col("level") == distance), distance)
        if 2 * distance < height:
            double = F.col("level") % (2 * distance)
            inner = cut_lineage(_jump(inner.where(double == 0), inner.where(double == distance), distance))
        distance *= 2
    return leaves


def fold(digest: Column, pos: Column, segment: Column) -> Column:
    """The root that a leaf's digest, its number and its siblings lead to."""
    def up(state, sibling):
        own, other = hex_text(state["digest"]), hex_text(sibling)
        odd = state["pos"] % 2 == 1
        text = F.when(sibling.isNull(), own).when(odd, F.concat(other, own)).otherwise(F.concat(own, other))
        return F.struct(F.unhex(F.sha2(text, 256)).alias("digest"), F.shiftright(state["pos"], 1).alias("pos"))

    return F.aggregate(segment, F.struct(digest.alias("digest"), pos.alias("pos")), up, lambda state: state["digest"])


def prove(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per leaf with its ``segment``, and of its tree ``subroot``, ``upper_pos``, ``upper_segment`` and ``root``.

    ``leaves``: tree (null is a tree too), doc_id, digest, changed (the digest to be checked, null for the same).
    """
    named = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("")))
    nodes, height = grow(numbered(named, ["doc_id", "digest"]), block_levels)
    roots = nodes.where("top").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    ranked = cut_lineage(numbered(roots, ["name"]))
    upper, upper_height = grow(ranked.select("tree", "pos", "depth", "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed")), block_levels)
    root = upper.where("top").select(F.col("digest").alias("root"), "tree")
    # one row per tree
    trees = (
        proofs(upper, upper_height).join(root, "tree").join(ranked.select("name", "pos"), "pos")
        .select(F.col("name").alias("tree"), F.col("pos").alias("upper_pos"), F.col("segment").alias("upper_segment"), F.col("digest").alias("subroot"), "root")
    )
    return proofs(nodes, height).join(cut_lineage(trees), "tree")


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The contract's rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    values = {c: F.col(c) for c in COLUMNS}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = leaf_digest(list((values | {"n_chars": F.col("n_chars") + 1}).values()))
    leaves = cut_lineage(docs.select(
        F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(list(values.values())).alias("digest"),
        F.when(tampered, changed).alias("changed")))
    siblings = F.concat("segment", "upper_segment")
    folded = fold(fold(F.coalesce("changed", "digest"), F.col("pos"), F.col("segment")), F.col("upper_pos"), F.col("upper_segment"))
    return prove(leaves, block_levels).select(
        "doc_id", hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
        F.sha2(F.array_join(F.transform(siblings, hex_text), ""), 256).alias("proof_sha256"),
        hex_text(folded).alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
