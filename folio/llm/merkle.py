"""Merkle manifest of a dataset by Pregel-style supersteps (operator 11).

Rows are leaves; each group of rows (a source) is a tree of runs of ARITY nodes, and the groups' roots are the leaves of one
tree more. A superstep is one message along every edge of a level:

* upward, children message their parents (their place in the run and their digest); a parent that has heard from all its
  children hashes them and forwards its own digest in the next superstep;
* downward, parents that know their way to the root hand each child that way and the child's siblings, down to the leaves,
  where the path is folded again from a presented leaf.

Vertices are keyed (tree, place), so a tree that holds a third of all rows is dealt over all tasks, and a group never holds
more than ARITY messages and one path. A level is written before the next starts; each is ARITY times smaller than the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import materialize, shuffle_width

#: Nodes of a run, as the manifest's format has it.
ARITY = 16
#: The tree over the groups' roots; other trees are numbered from 0.
TOP = -1
#: monotonically_increasing_id() counts rows of a partition below this bit.
_PARTITION_BIT = 33

_NODE = T.StructType(
    [
        T.StructField("tree", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("nodes", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("children", T.ArrayType(T.StringType())),
    ]
)


def leaf(columns: Iterable[Column]) -> Column:
    """SHA-256 (hex) of values in order: `-` for null, else the UTF-8 byte count, `:` and the value, so that no two rows read alike."""
    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(framed, columns)), 256)


def digest_of(texts: Sequence[str]) -> str:
    """SHA-256 (hex) of digests concatenated as hex text."""
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def fold(start: str, steps: Iterable[tuple[int, str]]) -> str:
    """The root that a leaf and its path give; a step is the place in the run and the siblings' digests joined."""
    for place, rest in steps:
        cut = place * len(start)
        start = digest_of((rest[:cut], start, rest[cut:]))
    return start


def _placed(rows: DataFrame, group_col: str, order_col: str, leaf_col: str) -> DataFrame:
    """rows with tree (numbered in the groups' order), at (place in the group) and nodes (rows of the group).

    The rows are sorted over all tasks and written; places are counted from the sizes of what each task holds of each group, so
    no group passes through one task. Nulls come first; rows alike in group, order and leaf keep the order they are read in.
    """
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))
    tied = rows.select("*", group.alias("tree_key"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("tree_key"), F.col(order_col).asc_nulls_first(), F.col(leaf_col), F.col("tie")]
    ordered = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("row", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("part", F.shiftright("row", _PARTITION_BIT)), "leaves")
    # One row for each group and task that holds rows of it.
    held = ordered.groupBy("tree_key", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("tree_key").orderBy("part")
    held = held.select(
        "*",
        F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
        F.sum("n").over(Window.partitionBy("tree_key")).alias("nodes"),
    )
    # Groups are numbered by the task where they begin (a row for each task is counted in one place), then within it.
    begun = held.where("earlier = 0").select("tree_key", "part", "first")
    tasks = begun.groupBy("part").agg(F.count("*").alias("k"))
    tasks = tasks.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("passed"))
    numbered = begun.join(tasks, "part").select("tree_key", (F.col("passed") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1).alias("tree"))
    held = held.join(numbered, "tree_key").select("tree_key", "part", "first", "earlier", "nodes", "tree")
    return ordered.join(held, ["tree_key", "part"]).withColumn("at", F.col("earlier") + F.col("row") - F.col("first"))


def _upward(spark: SparkSession, level: DataFrame, label: str) -> DataFrame:
    """One superstep: every node of a run messages its parent; parents that have heard from all children hash and are returned."""
    def message(v: T.Row) -> tuple[tuple[int, int], tuple[int, str, int]]:
        return (v.tree, v.at // ARITY), (v.at % ARITY, v.digest, v.nodes)

    def heard(arrived: tuple[tuple[int, int], Iterable[tuple[int, str, int]]]) -> tuple[int, int, int, str, list[str]]:
        (tree, at), messages = arrived
        got = sorted(messages)
        nodes = got[0][2]
        if [m[0] for m in got] != list(range(min(ARITY, nodes - at * ARITY))):
            raise ValueError(f"node {at} of tree {tree} has not heard from all its children")
        children = [m[1] for m in got]
        return tree, at, -(-nodes // ARITY), digest_of(children), children

    sent = level.where("nodes > 1").select("tree", "at", "digest", "nodes").rdd.map(message)
    parents = sent.groupByKey(shuffle_width(spark)).map(heard)
    return materialize(spark.createDataFrame(parents, _NODE, verifySchema=False), label)


def _climb(spark: SparkSession, leaves: DataFrame, largest: int, label: str) -> list[DataFrame]:
    """The levels above the leaves of trees whose largest has so many leaves; a tree ends where it has one node."""
    levels, below = [], leaves
    while largest > 1:
        below = _upward(spark, below, f"{label}{len(levels) + 1}")
        levels.append(below)
        largest = -(-largest // ARITY)
    return levels


def _steps(children: Sequence[str], way: Sequence[tuple[int, str]]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """Each child's place with its way to the root: its siblings, then its parent's way."""
    joined = "".join(children)
    width = len(children[0])
    for place in range(len(children)):
        cut = place * width
        yield place, [(place, joined[:cut] + joined[cut + width :]), *way]


def _downward(level: DataFrame, ways: RDD, width: int) -> RDD:
    """One reverse superstep: parents hand their subroot and their way down; the children's, keyed as they are, are returned."""
    def handed(v):
        (tree, at), (children, (subroot, way)) = v
        return [((tree, at * ARITY + place), (subroot, steps)) for place, steps in _steps(children, way)]

    children = level.select("tree", "at", "children").rdd.map(lambda v: ((v.tree, v.at), list(v.children)))
    return children.join(ways, width).flatMap(handed)


def manifest(rows: DataFrame, group_col: str, order_col: str, leaf_col: str, presented_col: str | None = None) -> DataFrame:
    """The columns of rows with subroot, root, proof_sha256, folded_root and verified.

    Leaves of a group ascend by order_col, groups by their UTF-8 bytes, nulls first in both; rows of one group and order value
    ascend by leaf. proof_sha256 is over the siblings from the leaf to the root. folded_root is what presented_col (null or not
    given: the leaf) gives with the path of the original; verified tells whether it is the root. Repeated rows are leaves each,
    and so are rows whose columns are all null; leaf_col itself must not be null. An empty table gives no rows. Columns of any name pass.
    """
    spark = rows.sparkSession
    width = shuffle_width(spark)
    names = [f"merkle_{i}" for i in range(len(rows.columns))]
    inner = rows.toDF(*names).select(*names)
    at = {c: n for c, n in zip(rows.columns, names)}
    placed = _placed(inner, at[group_col], at[order_col], at[leaf_col]).withColumn("digest", F.col(at[leaf_col]))
    placed = materialize(placed.select("tree", "at", "nodes", "digest", *names), "placed")
    seen = placed.agg(F.max("nodes").alias("largest"), F.max("tree").alias("last")).first()
    out_fields = [f for f in rows.schema.fields] + [T.StructField(c, T.StringType()) for c in ("subroot", "root", "proof_sha256", "folded_root")] + [T.StructField("verified", T.BooleanType())]
    schema = T.StructType(out_fields)
    if seen.largest is None:
        return spark.createDataFrame([], schema)

    levels = _climb(spark, placed, seen.largest, "level")
    ends = [level.where("nodes = 1").select(F.col("tree").alias("at"), "digest") for level in (placed, *levels)]
    subroots = ends[0]
    for end in ends[1:]:
        subroots = subroots.unionByName(end)
    trees = seen.last + 1
    subroots = materialize(subroots.select(F.lit(TOP).cast("long").alias("tree"), "at", F.lit(trees).cast("long").alias("nodes"), "digest"), "subroots")
    above = _climb(spark, subroots, trees, "top")
    root = (above[-1] if above else subroots).first().digest

    # Down the tree of groups: from the root, whose way is empty, to the groups' roots.
    ways = spark.sparkContext.parallelize([((TOP, 0), (root, []))], 1)
    for level in reversed(above):
        ways = _downward(level, ways, width)
    group_ways = subroots.rdd.map(lambda v: ((TOP, v.at), v.digest)).join(ways, width).map(lambda v: ((v[0][1], 0), (v[1][0], v[1][1][1])))
    # Down the groups' trees: a tree joins in at the level of its root, those of one leaf at the leaves.
    def begun(level: DataFrame) -> RDD:
        return level.where("nodes = 1").rdd.map(lambda v: ((v.tree, v.at), None)).join(group_ways, width).mapValues(lambda v: v[1])

    handed = begun(placed).mapValues(lambda way: (None, way))
    ways = None
    for i in reversed(range(len(levels))):
        ways = begun(levels[i]) if ways is None else _downward(levels[i + 1], ways, width).union(begun(levels[i]))
    if levels:
        handed = levels[0].rdd.map(lambda v: ((v.tree, v.at), list(v.children))).join(ways, width).union(handed)

    n, leaf_at, presented_at = len(names), rows.columns.index(leaf_col), rows.columns.index(presented_col or leaf_col)

    def arrived(group):
        leaves, messages = group[1]
        for children, (subroot, way) in messages:
            paths = dict(_steps(children, way)) if children else {0: way}
            for place, values in leaves:
                steps = paths[place]
                folded = fold(values[presented_at] or values[leaf_at], steps)
                yield (*values, subroot, root, digest_of([rest for _, rest in steps]), folded, folded == root)

    leaves = placed.select("tree", "at", *names).rdd.map(lambda v: ((v[0], v[1] // ARITY), (v[1] % ARITY, tuple(v[2 : 2 + n]))))
    return spark.createDataFrame(leaves.cogroup(handed, width).flatMap(arrived), schema, verifySchema=False)
