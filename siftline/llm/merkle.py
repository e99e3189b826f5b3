"""A Merkle manifest of a table: a tree for each group of rows, a tree over their roots, and a witness for each row.

Nodes are joined in twos by SHA-256 of their hex digests; the last node of a level that has no other is hashed alone.
Rows are numbered in their group by a range shuffle and counts for each part, and cut into aligned blocks.
A task takes the nodes of a block in order, as an append-only log does: it keeps a stack of open subtrees, and when two
of one height meet, the witnesses of the members of each are extended by the other's digest. The roots of blocks are
the nodes that are appended one round further up, in blocks again, until each group has one; then the groups' roots are.
A witness is complete when the steps of its block's root are put behind its own.

Steps are strings: L or R and the digest of the sibling on that side, or nothing where there is none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.shared import written

# Blocks have 2^HEIGHT nodes.
HEIGHT = 12

RESULTS = ("subroot", "root", "witness")
_RESULT_FIELDS = [T.StructField(n, T.StringType()) for n in RESULTS[:2]] + [T.StructField(RESULTS[2], T.ArrayType(T.StringType()))]
_ROW = (1 << 33) - 1


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, or ``-`` where it is null."""
    spelled = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*spelled), 256)


def append_all(digests: list[str], height: int | None) -> tuple[str, list[list[str]]]:
    """Append nodes in order; the root, and each node's steps up to it.

    The root stands ``height`` levels above the nodes, or where a single node is left if that is None.
    """
    steps: list[list[str]] = [[] for _ in digests]
    stack: list[tuple[int, int, str]] = []  # height, first member, digest; lower ones to the end

    def closed(left: tuple[int, int, str], right: tuple[int, int, str], stop: int) -> tuple[int, int, str]:
        for witness in steps[left[1] : right[1]]:
            witness.append("R" + right[2])
        for witness in steps[right[1] : stop]:
            witness.append("L" + left[2])
        return left[0] + 1, left[1], sha(left[2] + right[2])

    def alone(node: tuple[int, int, str]) -> tuple[int, int, str]:
        for witness in steps[node[1] :]:
            witness.append("")
        return node[0] + 1, node[1], sha(node[2])

    for i, digest in enumerate(digests):
        node = (0, i, digest)
        while stack and stack[-1][0] == node[0]:
            node = closed(stack.pop(), node, i + 1)
        stack.append(node)
    node = stack.pop()
    while stack:
        while node[0] < stack[-1][0]:
            node = alone(node)
        node = closed(stack.pop(), node, len(digests))
    while height is not None and node[0] < height:
        node = alone(node)
    return node[2], steps


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``at``, the place of a row in its ``tree`` by ``order`` (nulls first), and ``size``, the rows of that tree.

    Equal rows may come in any order among themselves; a salt lets them go to several tasks.
    """
    ways = [F.col(c).asc_nulls_first() for c in ("tree", *order, "salt")]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*ways).sortWithinPartitions(*ways).drop("salt")
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-rows")
    placed = placed.withColumns({"part": F.shiftrightunsigned("at", 33), "at": F.col("at").bitwiseAND(_ROW)})
    # One row for each part, and one more for each tree that begins inside a part.
    parts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("many"), F.min("at").alias("low"))
    tree = Window.partitionBy("tree")
    parts = parts.select(
        "tree", "part", F.sum("many").over(tree).alias("size"),
        (F.sum("many").over(tree.orderBy("part")) - F.col("many") - F.col("low")).alias("shift"),
    )
    return placed.join(parts, ["tree", "part"]).withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift")


def _appended(nodes: pa.Table, height: int) -> tuple[pa.Table, str, list[list[str]]]:
    nodes = nodes.take(pc.sort_indices(nodes, [("at", "ascending")]))
    full = height if nodes["size"][0].as_py() > 1 << height else None
    return nodes, *append_all(nodes["digest"].to_pylist(), full)


def witnessed(nodes: DataFrame, most: int, finish: Callable[[DataFrame], DataFrame], height: int = HEIGHT) -> DataFrame:
    """``nodes`` (tree, at, size, digest and others) with what ``finish`` gives the root of each tree, and their steps
    before its. ``most`` is the size of the largest tree; blocks have 2^``height`` nodes."""
    if most <= 1:
        return finish(nodes)

    def root_of(block: pa.Table) -> pa.Table:
        block, root, _steps = _appended(block, height)
        size = (block["size"][0].as_py() - 1 >> height) + 1
        return pa.table({"tree": block["tree"][:1], "at": [block["at"][0].as_py() >> height], "size": [size], "digest": [root]})

    def witnesses_of(block: pa.Table, above: pa.Table) -> pa.Table:
        block, _root, steps = _appended(block, height)
        behind = above["witness"][0].as_py()
        found = {"witness": pa.array([s + behind for s in steps], pa.list_(pa.string()))}
        found |= {name: pa.repeat(above[name][0], len(block)) for name in ("subroot", "root")}
        return pa.table({**{name: block[name] for name in block.column_names if name != "block"}, **found})

    blocks = nodes.withColumn("block", F.shiftright("at", height))
    roots = written(blocks.groupBy("tree", "block").applyInArrow(root_of, "tree string, at long, size long, digest string"), "merkle-roots")
    above = witnessed(roots, (most - 1 >> height) + 1, finish, height).select("tree", F.col("at").alias("block"), *RESULTS)
    schema = T.StructType([*nodes.schema, *_RESULT_FIELDS])
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(witnesses_of, schema)


def largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("size")).first()[0] or 0


def manifest(rows: DataFrame, leaf_col: str, group: str, order: str, height: int = HEIGHT) -> DataFrame:
    """``rows`` with ``subroot`` of their group, ``root`` of all, and ``witness``: the steps from their leaf to the root.

    Inside a group, leaves ascend by ``order``, null first; rows of equal order by leaf. Groups ascend bytewise by their
    text, null first. Repeated rows are leaves of their own. A null leaf is an error; an empty table has no rows.
    Columns of the names of results are replaced. Blocks, not groups, meet in tasks, so a group may hold any part of
    the table.
    """
    kept = [c for c in rows.columns if c not in RESULTS]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    given = F.coalesce(F.col(leaf_col), F.raise_error(F.lit("null leaf")).cast("string"))
    leaves = written(rows.select(F.struct(*kept).alias("row"), tree.alias("tree"), F.col(order).alias("key"), given.alias("digest")), "merkle-leaves")
    nodes = numbered(leaves, "key", "digest").drop("key")

    def of_all(tops: DataFrame) -> DataFrame:
        last = lambda root: root.select("*", F.array().cast("array<string>").alias("witness"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
        ends = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("at").alias("place"), "digest"), "name")
        return witnessed(ends, largest(ends), last, height).select(
            F.col("name").alias("tree"), F.col("place").alias("at"), F.col("digest").alias("subroot"), "root", "witness"
        )

    most = largest(nodes)
    if most == 1:
        # No group has a block to climb: its leaf is its root.
        return nodes.drop("at").join(of_all(nodes.select("tree", "at", "digest")), "tree").select("row.*", *RESULTS)
    if most == 0:
        return nodes.select("row.*", *(F.lit("").alias(c) for c in RESULTS[:2]), F.array(F.lit("")).alias(RESULTS[2]))
    return witnessed(nodes, most, of_all, height).select("row.*", *RESULTS)


def folded(start: Column, witness: Column | str) -> Column:
    """The root that a leaf and its steps give."""
    other = lambda step: F.substring(step, 2, 64)
    joined = lambda node, step: F.when(step == "", node).when(F.substring(step, 1, 1) == "L", F.concat(other(step), node)).otherwise(F.concat(node, other(step)))
    return F.aggregate(witness, start, lambda node, step: F.sha2(joined(node, step), 256))


def siblings(witness: Column | str) -> Column:
    """The digests of a witness's siblings, from the leaf upward, as one text."""
    return F.array_join(F.transform(F.filter(witness, lambda s: s != ""), lambda s: F.substring(s, 2, 64)), "")
