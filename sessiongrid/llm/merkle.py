"""Merkle manifest of a table: one hash tree per source, and one over the sources' roots.

A leaf is the SHA-256 of a row's columns, each written as its byte count and its text. Rows of
a source ascend by id; every ``ARITY`` neighbours are hashed to their parent until one node, the
subroot, is left. Subroots in the order of sources give the root in the same way.

Levels are kept as strings. ``ARITY`` ** ``HEIGHT`` neighbouring nodes make a block, aligned so that no
run of siblings crosses a border. A block holds each of its levels as one string of hex digests;
a parent is the hash of a fixed-width substring, and the siblings of a node are the substrings
that flank it. The top of every block is a node of a table that is smaller by a factor of
``ARITY`` ** ``HEIGHT`` and is treated in the same way, until each source fits one block. So no task
ever holds more than a block, whatever the share of a source.

Rows get their place in a source by a range sort over (source, id, leaf) and the number of rows
in the ranges before. A null id comes first, rows of one id are in the order of their leaves,
and repeated rows are leaves of their own; since equal leaves may trade places, the result is
the same in every run. A null source is a source of its own and comes first. An empty table gives
an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessiongrid.schema import quoted
from sessiongrid.sources.storage import stage

ARITY = 3
HEIGHT = 6  # levels in a block: 729 nodes, 46,656 hex digits
DIGITS = 64
_PATH = "array<struct<left:string,right:string>>"
_ROW = (1 << 33) - 1  # the part of monotonically_increasing_id() that counts rows


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of ``-`` for a null, else byte count, colon and text of each column."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _parents(level: Column) -> Column:
    """The next level of a block, from hex digests in one string (as bytes, so cutting it costs its width)."""
    run = ARITY * DIGITS
    places = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / run).cast("int"))
    return F.array_join(F.transform(places, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "").cast("binary")


def _flanks(level: Column, at: Column) -> Column:
    """The substrings left and right of node ``at`` within its run of siblings."""
    first = at - at % ARITY
    left = F.substring(level, first * DIGITS + 1, (at - first) * DIGITS)
    right = F.substring(level, (at + 1) * DIGITS + 1, (first + ARITY - 1 - at) * DIGITS)
    return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """(group, block, single, items, l0 ... top) of nodes (group, index, size, node, item)."""
    width = ARITY**HEIGHT
    rows = F.array_sort(F.collect_list(F.struct("index", "node", "item")))
    blocks = (
        nodes.groupBy("group", F.floor(F.col("index") / width).alias("block"))
        .agg(rows.alias("rows"), F.first("size").alias("size"))
        .select(
            "group",
            "block",
            (F.col("size") <= width).alias("single"),
            F.col("rows.item").alias("items"),
            F.array_join("rows.node", "").cast("binary").alias("l0"),
        )
    )
    for level in range(HEIGHT):
        below = F.col(f"l{level}")
        # A group of one block ends with its first single node; all others fill their block's height.
        ends = F.col("single") & (F.octet_length(below) == DIGITS)
        blocks = blocks.withColumn(f"l{level + 1}", F.when(~ends, _parents(below)))
    top = F.coalesce(*[F.col(f"l{level}") for level in range(HEIGHT, -1, -1)]).cast("string")
    return stage(blocks.withColumn("top", top), name)


def _segments(place: Column) -> Column:
    """Flanks of item ``place`` of a block on all levels that have parents."""
    own, levels = place, []
    for level in range(HEIGHT):
        levels.append(F.when(F.col(f"l{level + 1}").isNotNull(), _flanks(F.col(f"l{level}"), own)))
        own = F.floor(own / ARITY).cast("int")
    return F.filter(F.array(*levels), lambda s: s.isNotNull())


def trees(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``nodes``, and for each block (group, block, rest, root): the way from its top to its group's root.

    ``nodes`` has group (not null), index (from 0), size (nodes of the group), node (hex digest)
    and item (anything that travels along).
    """
    blocks = _blocks(nodes, name)
    above = blocks.filter("single").select("group", "block", F.lit(None).cast(_PATH).alias("rest"), F.col("top").alias("root"))
    several = blocks.filter(~F.col("single"))
    if not several.isEmpty():
        last = F.max("block").over(Window.partitionBy("group"))
        tops = several.select(
            "group", F.col("block").alias("index"), (last + 1).alias("size"), F.col("top").alias("node"), F.col("block").alias("item")
        )
        upper = spread(*trees(tops, name))
        above = above.unionByName(upper.select("group", F.col("item").alias("block"), F.col("path").alias("rest"), "root"))
    return blocks, stage(above, name)


def spread(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(item, path) of every node of the blocks, with the further columns of ``above``."""
    items = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.substring("l0", i * DIGITS + 1, F.lit(DIGITS)).cast("string").alias("node"), _segments(i).alias("own")))
    each = blocks.join(above, ["group", "block"]).select(*above.columns, F.explode(items).alias("x"))
    path = F.concat("x.own", F.coalesce("rest", F.array().cast(_PATH)))
    return each.select("group", *[c for c in above.columns if c not in ("group", "block", "rest")], F.col("x.item").alias("item"), F.col("x.node").alias("node"), path.alias("path"))


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def sibling_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _in_order(leaves: DataFrame) -> DataFrame:
    """Add ``index`` and ``size`` within ``group``, in the order of id and leaf."""
    # A number of its own keeps repeated rows apart, so any number of them is cut into ranges too.
    order = ["group", "id", "node", "row"]
    ranged = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(ranged.drop("row").withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("at", 33)
    ranged = ranged.withColumn("part", part).withColumn("at", F.col("at").bitwiseAND(F.lit(_ROW)))
    # At most one row for each range and one for each source.
    runs = ranged.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("group")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "group", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size")
    )
    return ranged.join(starts, ["group", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def manifest(
    docs: DataFrame,
    columns: Sequence[str],
    id_col: str = "doc_id",
    source_col: str = "source",
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per document: id, source, leaf, subroot, root, path, and tampered_leaf.

    ``columns`` are hashed into the leaf in this order. ``path`` lists the flanks (left, right) of
    siblings from the leaf to the root; ``fold`` recomputes a root from it. ``tampered`` gives
    columns that a later copy of the table holds instead; tampered_leaf is their leaf, or the
    leaf itself without it. Texts are read once and not moved.
    """
    changed = tampered or {}
    leaf = leaf_hash([F.col(quoted(c)) for c in columns])
    other = leaf_hash([changed.get(c, F.col(quoted(c))) for c in columns])
    differs = [~F.col(quoted(c)).eqNullSafe(e) for c, e in changed.items()]
    held = F.lit(False)
    for d in differs:
        held = held | d
    source = F.col(quoted(source_col))
    # In the order of its bytes, null first: "" and then "s" before every name.
    group = F.when(source.isNull(), "").otherwise(F.concat(F.lit("s"), source.cast("string")))
    leaves = docs.select(
        group.alias("group"), F.col(quoted(id_col)).alias("id"), leaf.alias("node"), F.when(held, other).alias("other")
    )
    ordered = _in_order(stage(leaves, "leaves"))
    blocks, above = trees(ordered.select("group", "index", "size", "node", F.struct("id", "other").alias("item")), "trees")
    tops = above.groupBy("group").agg(F.first("root").alias("node"))
    sources = _in_order(tops.select(F.lit("").alias("group"), F.col("group").alias("id"), "node"))
    up = spread(*trees(sources.select("group", "index", "size", "node", F.col("id").alias("item")), "roots"))
    up = up.select(F.col("item").alias("group"), F.col("path").alias("further"), F.col("root"))
    above = above.withColumnRenamed("root", "subroot").join(up, "group")
    above = above.withColumn("rest", F.concat(F.coalesce("rest", F.array().cast(_PATH)), "further")).drop("further")
    return spread(blocks, above).select(
        F.col("item.id").alias(id_col),
        F.when(F.col("group") != "", F.substr("group", F.lit(2))).alias(source_col),
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        "path",
        F.coalesce("item.other", "node").alias("tampered_leaf"),
    )
