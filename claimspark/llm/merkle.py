"""Merkle manifest: one tree of hashes per group of rows, one tree over the groups' roots, a proof for every row.

Every level is a table of nodes ``(tree, place)``. A node's siblings stand at places computed from its own: with ``arity`` slots a run begins
at ``place - slot``, and the others follow by slot offsets. Each offset is one equijoin of the level with itself; the
slot-zero rows, which then hold their whole run, emit the parents. Paths go down the same levels: a node's
path is its own step and its parent's path, so that only the rows of a level meet the third as many of the one above.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimspark.llm.common import partitions
from claimspark.session import materialise

ARITY = 3


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*values: Column) -> Column:
    """Hash of the fields of a row, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def placed_leaves(leaves: DataFrame, group: str, order: str) -> DataFrame:
    """``leaves`` with ``tree`` (rank of the group, NULL first), ``place`` (from 0, by ``order``, NULL first, then by leaf) and ``nodes`` of its tree.

    Rows are dealt by ranges of group, order and leaf, so that a large group fills many tasks. Ranks follow from the counts of the
    pieces (task and group), never from one window over all rows or all groups.
    """
    keys = [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first(), F.col("leaf")]
    spread = leaves.repartitionByRange(partitions(leaves.sparkSession), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    spread = materialise(spread.select("*", F.spark_partition_id().alias("part"), at.alias("at")), "merkle-sorted")
    pieces = spread.groupBy("part", group).agg(F.count("*").alias("size"), F.min("at").alias("first_at"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = materialise(pieces.select(
        "*", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy(group)).alias("nodes"),
    ), "merkle-pieces")
    begun = pieces.filter("start = 0")
    per_part = begun.groupBy("part").agg(F.count("*").alias("trees"))  # one row per task
    before = per_part.select(F.col("part").alias("of_part"), (F.sum("trees").over(Window.orderBy("part")) - F.col("trees")).alias("trees_before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col(group).asc_nulls_first())) - 1
    trees = begun.select(F.col(group).alias("of_group"), F.col("part").alias("in_part"), rank.alias("rank"))
    trees = trees.join(before, F.col("in_part") == F.col("of_part")).select("of_group", (F.col("trees_before") + F.col("rank")).alias("tree"))
    pieces = pieces.join(trees, F.col(group).eqNullSafe(F.col("of_group"))).select(
        F.col("part").alias("of_part"), F.col(group).alias("piece_group"), "tree", "nodes", (F.col("start") - F.col("first_at")).alias("shift")
    )
    rows = spread.join(pieces, (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("piece_group")))
    return rows.select(*leaves.columns, "tree", (F.col("at") + F.col("shift")).alias("place"), "nodes")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with the digests of their runs' other nodes ``before`` and ``after`` them, in order."""
    slot = F.col("place") % arity
    out = nodes
    for offset in range(1, arity):
        other = nodes.select(F.col("tree").alias(f"tree{offset}"), F.col("place").alias(f"place{offset}"), F.col("digest").alias(f"digest{offset}"))
        sibling = F.col("place") - slot + (slot + offset) % arity
        out = out.join(other, (F.col("tree") == F.col(f"tree{offset}")) & (sibling == F.col(f"place{offset}")), "left")
    none = F.lit(bytearray()).cast("binary")
    sides = [
        F.concat(*[F.when(side, F.coalesce(F.col(f"digest{o}"), none)).otherwise(none) for o, side in sides])
        for sides in (
            [(o, slot + o >= arity) for o in range(1, arity)],  # offsets past the end of the run come round to its first slots
            [(o, slot + o < arity) for o in range(1, arity)],
        )
    ]
    return out.select(*nodes.columns, sides[0].alias("before"), sides[1].alias("after"))


def parents_of(level: DataFrame, arity: int) -> DataFrame:
    """The slot-zero rows of a level as the nodes above."""
    digest = F.unhex(F.sha2(F.concat(hex_of(F.col("digest")), hex_of(F.col("after"))), 256))
    above = level.filter(F.col("place") % arity == 0)
    return above.select("tree", F.floor(F.col("place") / arity).alias("place"), F.ceil(F.col("nodes") / arity).alias("nodes"), digest.alias("digest"))


def build(nodes: DataFrame, most: int, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees from the leaves up, each written, and the roots ``tree, digest``. ``most`` is the largest number of leaves."""
    levels, roots = [], [nodes.filter("nodes = 1").select("tree", "digest")]
    while most > 1:
        level = materialise(with_siblings(nodes.filter("nodes > 1"), arity), name)
        levels.append(level)
        nodes, most = parents_of(level, arity), -(-most // arity)
        roots.append(nodes.filter("nodes = 1").select("tree", "digest"))
    return levels, materialise(reduce(DataFrame.unionByName, roots), f"{name}-roots")


def descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest of ``levels`` with ``steps``: own siblings, then the parent's steps, up to ``steps`` of the tree's root.

    ``tops`` has ``tree``, ``steps`` and columns to hand down for every tree.
    """
    handed = [c for c in tops.columns if c != "tree"]
    above = None
    for level in reversed(levels):
        def below(rows: DataFrame, ends: DataFrame, match: Column) -> DataFrame:
            own = F.array(F.struct("before", "after"))
            carried = [(F.concat(own, F.col("top_steps")) if c == "steps" else F.col(f"top_{c}")).alias(c) for c in handed]
            return rows.join(ends, match).select(*level.columns, *carried)

        ends = tops.select(*[F.col(c).alias(f"top_{c}") for c in tops.columns])
        found = below(level.filter(F.col("nodes") <= arity), ends, F.col("tree") == F.col("top_tree"))
        if above is not None:
            ends = above.select(F.col("tree").alias("top_tree"), F.col("place").alias("top_place"), *[F.col(c).alias(f"top_{c}") for c in handed])
            up = (F.col("tree") == F.col("top_tree")) & (F.floor(F.col("place") / arity) == F.col("top_place"))
            found = found.unionByName(below(level.filter(F.col("nodes") > arity), ends, up))
        above = found
    return above


def folded(leaf: Column, steps: Column) -> Column:
    """Root that follows from a leaf (bytes) and its steps, as hex text."""
    return F.aggregate(steps, hex_of(leaf), lambda got, step: F.sha2(F.concat(hex_of(step["before"]), got, hex_of(step["after"])), 256))


def merkle_manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", arity: int = ARITY) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` (hex text) and ``steps``: the siblings before and after each node on the way to the root.

    ``leaves`` has ``leaf`` (the digest as bytes), the columns ``group`` and ``order`` and any others, which pass through (but for the names
    ``tree``, ``place``, ``nodes``, ``digest``, ``before``, ``after``, ``part``, ``at`` that are used here). NULL groups are a group, the first; NULL orders come first
    in theirs; rows that tie are ordered by their leaf, repeated rows are leaves of their own. A lone node of a
    tree is its root, without a step; a run of one node beside others has a step without siblings. An empty table gives an empty result.
    """
    nodes = materialise(placed_leaves(leaves, group, order).withColumn("digest", F.col("leaf")), "merkle-leaves")
    most, last = nodes.agg(F.max("nodes"), F.max("tree")).first()
    levels, subroots = build(nodes, most or 0, arity, "merkle-level")
    count = 0 if last is None else last + 1
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(count).cast("long").alias("nodes"), "digest")
    top_levels, root = build(tops, count, arity, "merkle-top")
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    root = root.select("tree", none.alias("steps"), hex_of(F.col("digest")).alias("root"))
    if top_levels:
        heads = descend(top_levels, root, arity).select(F.col("place").alias("tree"), "steps", hex_of(F.col("digest")).alias("subroot"), "root")
    else:
        heads = root.withColumn("subroot", F.col("root"))
    heads = materialise(heads.select("tree", "steps", "subroot", "root"), "merkle-heads")
    own = [*leaves.columns, "steps", "subroot", "root"]
    lone = nodes.filter("nodes = 1").join(heads, "tree").select(*own)
    return lone if not levels else lone.unionByName(descend(levels, heads, arity).select(*own))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, shown``: each row's hash and the hash of what a check is shown.

    A check is shown the text without its line feeds where 2 divides the unsigned CRC-32 of the decimal id, else the row itself. NULL
    ids are never altered, and neither are NULL texts.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    altered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    without = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in names]
    leaf = row_hash(*map(F.col, names))
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(altered, row_hash(*without)).alias("other"))
    return rows.select("doc_id", "source", "leaf", F.coalesce("other", "leaf").alias("shown"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` and ``steps``.

    The proof is the hash of all sibling digests as hex text, level by level; ``folded_root`` is what the shown leaf gives with the original siblings.
    A document differs from its manifest where that is not ``root``. Rules for NULLs, ties and empty tables are those of ``merkle_manifest``;
    empty texts are texts of 0 bytes, unlike NULL. Other columns are ignored.
    """
    rows = merkle_manifest(materialise(document_leaves(docs), "merkle-hashes"))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(hex_of(s["before"]), hex_of(s["after"]))), "")
    rows = rows.select(
        "doc_id", hex_of(F.col("leaf")).alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("shown"), F.col("steps")).alias("folded_root"), "steps",
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
