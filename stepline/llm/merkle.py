"""A Merkle manifest of a table, its trees built by slot pivots.

A leaf is a hash of a row's fields.  The leaves of each group (a language, say) stand in the
order of a key; each run of ``FANOUT`` consecutive nodes becomes the hash of their digests,
put one after the other, until a single node is left: the group's subroot.  Subroots, in the
order of their groups, become the root alike.  The hash is sha256 in lowercase hex, and hashes
of hashes take that text.

How it runs.  A level's parent is a group-by on (group, place div fanout): conditional aggregates
spread its children into a column for each slot.  The columns in a row are the parent's
preimage; without a child's own column they are its siblings.  So proofs need no join of leaves with
nodes: on the way back down, each parent's row is joined with its own path, by a key that no
two parents share, and exploded into its children.  All levels above the leaves together are a seventh of the
rows, so they cost little.  Leaves get their places from one range exchange by (group, key,
leaf, place in the input), in which a group or key that holds a third of all rows is
dealt to many tasks; places are counted by partition and group, and the counts of earlier partitions
added.  Texts are read once; leaves, not texts, are shuffled.  All is DataFrame functions.

Cases: a null field is a ``-``; groups and keys may be null and come first; rows of the same
key are in the order of their leaves, so repeated rows have proofs of their own; a lone leaf is its
subroot, with no sibling; with one group its subroot is the root; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.llm.common import cut

FANOUT = 8
#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as it stands in a leaf's preimage: its length in UTF-8 bytes and itself, or ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """(grp, ...) with g, which tells groups apart and ascends as they do, idx (place in the group, from 0) and n (rows of the group)."""
    order = ["grp", *order]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    placed = cut(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", PLACE_BITS)
    # a row for each partition, and one more for each border of groups
    spans = placed.groupBy(part.alias("part"), F.col("grp").alias("_grp")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of_group = Window.partitionBy("_grp")
    earlier = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("part", "_grp", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(of_group).alias("n"), F.min("first").over(of_group).alias("g"))
    here = (part == F.col("part")) & F.col("grp").eqNullSafe(F.col("_grp"))
    return placed.join(spans, here).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "_grp", "first", "before")


def levels_of(nodes: DataFrame, fanout: int) -> int:
    most = nodes.agg(F.max("n")).first()[0] or 1
    levels = 1
    while fanout**levels < most:
        levels += 1
    return levels


def slots(fanout: int) -> list[str]:
    return [f"s{k}" for k in range(fanout)]


def pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """(g, idx of the parent, n of the children's level, s0, ...): the children of each parent, (g, idx, n, it), in a column for each slot."""
    slot = F.pmod("idx", F.lit(fanout))
    children = [F.max(F.when(slot == k, F.col("it"))).alias(s) for k, s in enumerate(slots(fanout))]
    return nodes.groupBy("g", F.expr(f"idx div {fanout}").alias("idx")).agg(F.max("n").alias("n"), *children)


def _hashes(fanout: int, of: str = "") -> list[Column]:
    return [F.coalesce(F.col(s + of), F.lit("")) for s in slots(fanout)]


def parents(pivoted: DataFrame, fanout: int, of: str = "") -> DataFrame:
    """The level above: a lone node stays what it is."""
    node = F.when(F.col("n") == 1, F.col(f"s0{of}")).otherwise(digest(*_hashes(fanout, of)))
    return pivoted.select("g", "idx", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), node.alias("it"))


def climb(nodes: DataFrame, fanout: int, of: str = "") -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, lowest first, and the node (g, it) that is left of each group.  ``of``: where the lowest nodes have their digest."""
    pivots = []
    for _ in range(levels_of(nodes, fanout)):
        pivots.append(cut(pivot(nodes, fanout)))
        nodes, of = parents(pivots[-1], fanout, of), ""
    return pivots, nodes.select("g", "it")


def descend(pivots: list[DataFrame], tops: DataFrame, fanout: int, of: str = "") -> DataFrame:
    """(it, path, ...) of the lowest nodes.  ``tops``: (g, path, ...), what is above each group's last node; path: (left, right) of each level, lowest first, the siblings' digests on either side."""
    above = tops.withColumn("_idx", F.lit(0).cast("long")).withColumnRenamed("g", "_g")
    carried = [c for c in above.columns if c not in ("_g", "_idx", "path")]
    for level in reversed(range(len(pivots))):
        hashes = _hashes(fanout, "" if level else of)
        beside = [F.struct(F.concat(F.lit(""), *hashes[:k]).alias("left"), F.concat(F.lit(""), *hashes[k + 1 :]).alias("right")) for k in range(fanout)]
        child = F.explode(F.filter(F.array(*[F.struct((F.col("idx") * fanout + k).alias("idx"), F.col(s).alias("it"), beside[k].alias("beside")) for k, s in enumerate(slots(fanout))]), lambda x: x["it"].isNotNull()))
        known = pivots[level].join(above, (F.col("g") == F.col("_g")) & (F.col("idx") == F.col("_idx")))
        children = known.select("g", "n", "path", *carried, child.alias("child"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array("child.beside"), "path"))
        above = children.select(F.col("g").alias("_g"), F.col("child.idx").alias("_idx"), F.col("child.it").alias("it"), path.alias("path"), *carried)
    return above.select("_g", "it", "path", *carried)


def manifest(leaves: DataFrame, group: str, key: str, leaf_col: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """The rows of ``leaves`` (group, key, leaf and whatever else) with subroot, root and path.

    path is an array of (left, right), from the leaf's level up to the root: the siblings' digests before and after the node.
    """
    named = leaves.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(leaf_col).alias("leaf"), F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row"))
    placed = numbered(cut(named), ["key", "leaf"]).select("g", "idx", "n", F.struct("leaf", "row").alias("it"))
    placed = cut(placed)
    pivots, subroots = climb(placed, fanout, ".leaf")
    subroots = cut(subroots)
    ordered = numbered(subroots.select(F.lit(0).alias("grp"), "g", "it").withColumnRenamed("g", "of"), ["of"])
    top_pivots, root = climb(ordered.select("g", "idx", "n", F.struct(F.col("it").alias("leaf"), "of").alias("it")), fanout, ".leaf")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    tops = descend(top_pivots, root.select("g", nothing.alias("path"), F.col("it").alias("root")), fanout, ".leaf")
    tops = cut(tops.select(F.col("it.of").alias("g"), "path", F.col("it.leaf").alias("subroot"), "root"))
    found = descend(pivots, tops, fanout, ".leaf")
    return found.select(*[F.col(f"it.row.`{c}`").alias(c) for c in leaves.columns], "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """A proof's digests, level by level and left to right, as one text."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, node, lambda below, p: digest(p["left"], below, p["right"]))
