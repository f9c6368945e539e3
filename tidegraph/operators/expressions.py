"""Text expressions over candidate sets, evaluated from the leaves up as joins of nodes with their children.

An expression is a tree of node rows. Its inputs are the cells that it reads,
each with the values that it may have where the expression stands. One input
varies at a time: for every value of every cell with several, that cell has the
value and the other cells with several are unknown, so that the number of
snapshots is the sum of the candidates and not their product. A cell read twice has one value in
a snapshot. The nodes of one height are evaluated in one join, for all
expressions and snapshots of all units.

Unknown is data: a value is null if nothing is known of it, and has UNKNOWN_CHAR
where single characters are not. A fill of anything but one character, a slice
outside of its text, and what is fitted from an unknown text have a known
length and unknown characters. A choice is what either of its branches may be;
it stands at the top of an expression (or of a choice), elsewhere it is unknown.

Defined results: cells without values (in blocks that nothing reaches) and open
ones ('?') have unknown among their alternatives; slices and widths below zero
are unknown; an expression without reads has one snapshot; no expressions: an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.text import fit, piece
from tidegraph.operators.dataflow import UNKNOWN
from tidegraph.operators.shared import checkpointed

UNKNOWN_CHAR = "�"
LEAVES = ("LITERAL", "READ", "UNKNOWN")
_AT = ["unit", "pos"]
_NODE = "struct<node:bigint,op:string,text:string,cell:bigint,a:bigint,b:bigint,left:bigint,right:bigint,height:bigint>"


def node(node: int, op: str, text: Column | None = None, cell: Column | None = None, a: Column | None = None, b: Column | None = None, left: int | None = None, right: int | None = None, height: int = 0) -> Column:
    """A tree's node: text of a literal, cell of a read, a and b of a slice (start, count) or a width (a), numbers of children, height over the leaves."""
    given = [F.lit(node), F.lit(op), text, cell, a, b, F.lit(left), F.lit(right), F.lit(height)]
    return F.struct(*(F.lit(None) if x is None else x for x in given)).cast(_NODE)


def trees(blocks: DataFrame) -> DataFrame:
    """unit, pos, node (0 is the root), op, text, cell, a, b, left, right, height: the expression that each block of the event encoding assigns, by its number modulo 7."""
    k, lit, source, cell = F.col("k"), F.col("literal"), F.col("source"), F.col("cell")
    read, literal = (lambda n, c=source: node(n, "READ", cell=c)), (lambda n, t=lit: node(n, "LITERAL", text=t))
    shapes = [
        [literal(0)],
        [node(0, "FIT", a=2 + k % 7, left=1, height=1), read(1)],
        [node(0, "CONCAT", left=1, right=2, height=1), read(1), literal(2, F.concat(F.lit("-"), k.cast("string")))],
        [node(0, "SLICE", a=k % 4, b=1 + k % 5, left=1, height=2), node(1, "CONCAT", left=2, right=3, height=1), read(2), read(3, cell)],
        [node(0, "CHOICE", left=1, right=2, height=2), read(1), node(2, "FIT", a=k % 9, left=3, height=1), literal(3)],
        [node(0, "CONCAT", left=1, right=2, height=2), node(1, "FILL", a=1 + k % 3, left=3, height=1), read(2, cell), node(3, "LITERAL", text=F.when(k % 2 == 0, "*").otherwise("**"))],
        [node(0, "CONCAT", left=1, right=2, height=1), read(1), read(2)],
    ]
    shape = F.element_at(F.array(*(F.array(*x) for x in shapes)), (k % len(shapes) + 1).cast("int"))
    return blocks.select("unit", "pos", F.inline(shape))


def inputs(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """unit, pos, cell, alternatives (null for unknown; sorted) of the cells that expressions read. values: unit, pos, cell, val."""
    read = nodes.where("op = 'READ'").select(*_AT, "cell").distinct()
    met = read.join(values, [*_AT, "cell"], "left").groupBy(*_AT, "cell").agg(F.collect_set("val").alias("all"))
    known = F.array_sort(F.filter("all", lambda v: v != UNKNOWN))
    unknown = (F.size("all") == 0) | F.array_contains("all", UNKNOWN)
    return met.select(*_AT, "cell", F.when(unknown, F.array_append(known, F.lit(None).cast("string"))).otherwise(known).alias("alternatives"))


def snapshots(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """unit, pos, snap, cells (a map of what the cells that are not unknown have): a row for each alternative of each varying input, or one."""
    cells = inputs(nodes, values).withColumn("varying", F.size("alternatives") > 1)
    entry = lambda value: F.struct(F.col("cell"), value.alias("val"))
    fixed = cells.groupBy(*_AT).agg(F.collect_list(F.when(~F.col("varying"), entry(F.element_at("alternatives", 1)))).alias("fixed"), F.collect_list(F.when(F.col("varying"), F.struct("cell", "alternatives"))).alias("varying"))
    every = nodes.select(*_AT).distinct().join(fixed, _AT, "left")
    one = F.array(F.array().cast("array<struct<cell:bigint,val:string>>"))
    each = F.flatten(F.transform("varying", lambda v: F.transform(v["alternatives"], lambda a: F.array(F.struct(v["cell"].alias("cell"), a.alias("val"))))))
    ways = every.select(*_AT, "fixed", F.posexplode(F.when(F.size("varying") > 0, each).otherwise(one)).alias("snap", "chosen"))
    held = F.concat(F.coalesce("fixed", F.array().cast("array<struct<cell:bigint,val:string>>")), "chosen")
    return ways.select(*_AT, "snap", F.map_from_entries(F.filter(held, lambda x: x["val"].isNotNull())).alias("cells"))


def _unknown(n: Column) -> Column:
    return F.when(n >= 0, F.repeat(F.lit(UNKNOWN_CHAR), n.cast("int")))


def _value(x: Column, y: Column) -> Column:
    """A node's value of its children's."""
    op, a, b = F.col("op"), F.col("a"), F.col("b")
    return (
        F.when(op == "FILL", F.when(F.length(x) == 1, F.repeat(x, a.cast("int"))).otherwise(_unknown(a)))
        .when(op == "FIT", F.coalesce(F.when(a >= 0, fit(x, a.cast("int"))), _unknown(a)))
        .when(op == "SLICE", F.coalesce(piece(x, a, b), _unknown(b)))
        .when(op == "CONCAT", F.concat(x, y))
    )


def evaluate(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """unit, pos, val: what each expression may be, '?' for unknown; UNKNOWN_CHAR stands for single unknown characters.

    nodes: as `trees` gives them; values: unit, pos, cell, val at the blocks.
    """
    nodes = checkpointed(nodes)
    snaps = checkpointed(snapshots(nodes, values))
    leaf = F.when(F.col("op") == "LITERAL", F.col("text")).when(F.col("op") == "READ", F.try_element_at("cells", "cell"))
    known = nodes.where(F.col("op").isin(*LEAVES)).join(snaps, _AT).select(*_AT, "snap", "node", leaf.alias("val"))
    known = checkpointed(known)
    upper = nodes.where(~F.col("op").isin(*LEAVES) & (F.col("op") != "CHOICE"))
    top = upper.agg(F.max("height")).first()[0] or 0
    for height in range(1, top + 1):
        here = upper.where(F.col("height") == height)
        child = lambda side: known.select(*_AT, F.col("node").alias(side), "snap", F.col("val").alias(f"{side}_val"))  # noqa: B023, E731
        one = here.join(child("left"), [*_AT, "left"])
        both = one.join(child("right"), [*_AT, "right", "snap"], "left")
        known = checkpointed(known.unionByName(both.select(*_AT, "snap", "node", _value(F.col("left_val"), F.col("right_val")).alias("val"))))
    # the top: choices are what their branches are
    at = nodes.where("node = 0").select(*_AT, "node", "op", "left", "right")
    found = None
    while True:
        done = at.where("op <> 'CHOICE'").select(*_AT, "node")
        found = done if found is None else found.unionByName(done)
        branches = at.where("op = 'CHOICE'").select(*_AT, F.explode(F.array("left", "right")).alias("node"))
        at = checkpointed(branches.join(nodes.select(*_AT, "node", "op", "left", "right"), [*_AT, "node"]))
        if at.isEmpty():
            break
    met = found.join(known, [*_AT, "node"], "left")
    return met.select(*_AT, F.coalesce("val", F.lit(UNKNOWN)).alias("val")).distinct()


def assigned(values: DataFrame) -> DataFrame:
    """unit, pos, n, open, vals (sorted, joined by |) of evaluated expressions: closed candidates, and whether there may be others."""
    whole = (F.col("val") != UNKNOWN) & ~F.col("val").contains(UNKNOWN_CHAR)
    closed = F.collect_set(F.when(whole, F.col("val")))
    return values.groupBy(*_AT).agg(F.size(closed).cast("long").alias("n"), F.bool_or(~whole).alias("open"), F.array_join(F.array_sort(closed), "|").alias("vals"))
