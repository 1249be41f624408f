"""A Merkle manifest of a dataset: a root, and for every row a proof that it is under it.

A row's leaf is the SHA-256 of its columns, each as ``-`` if null, else byte count, colon,
value. The rows of a source, in order of doc_id, are the leaves of a tree: while several
nodes remain, every ARITY consecutive ones (the last run: what is left) become the SHA-256
of their digests. The subroots, in order of source, are the leaves of one more tree.

The trees are built by a monoid, the sparse forest: nodes keyed by (tree, level, index)
that still wait for siblings. Merging two forests unites their nodes, and where a run of
siblings is whole (how many there are is known from the tree's size) they give way to their
parent, again and again; the order of merges doesn't matter. Each partition makes a forest
of its rows. Neighbouring forests are then merged FAN by FAN, as a tree of rounds, until
one node is left, the root. On the way each node is noted with the siblings that it met, so
the rounds backwards give every partition's waiting nodes their way to the root.

Defined cases. Any column may be null; null sources are a tree of their own, the first, and
null ids come first in their tree. Rows of equal source and id are ordered by their leaves;
equal leaves are leaves each, side by side. Texts of any length are hashed whole. Other
columns are left out of a leaf, whatever their names. An empty table gives an empty result.

Scale. Texts are hashed where they are read; some 100 bytes a row go on. Rows are dealt out
by ranges of (source, doc_id, leaf, a number of their own), so no source or id is one task,
ROWS of them or so a partition. A partition of m rows leaves some 4 log m nodes to merge;
the rounds work on those alone, FAN partitions a task, and nothing but counts reaches the
driver. What is joined to the rows are their partition's waiting nodes. (Spark's own
treeReduce merges partitions that aren't neighbours, so nothing would be whole before the
driver had all of them; hence the rounds.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, saved

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Rows in a partition, partitions (or merged ones) in a task of a round.
ROWS, FAN = 50_000, 32
#: The tree of subroots.
TOP = -1
#: Partition numbers stand above this bit in Spark's row numbers.
SHIFT = 33

Node = tuple[int, int, int]  # tree, level, index
Step = tuple[str, str]  # the digests to the left and to the right


def leaf(*columns: Column) -> Column:
    """The digest, in hex, of a row with these columns."""

    def told(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(told, columns)), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, digest, lambda d, step: F.sha2(F.concat(step["left"], d, step["right"]), 256))


class Forest:
    """Nodes by (tree, level, index) with their digests; those in ``open`` wait for siblings, ``up`` leads from the others to their parents.

    ``sizes``: the number of leaves of each tree that has nodes here, and of TOP.
    """

    def __init__(self, sizes: dict[int, int]):
        self.digests: dict[Node, str] = {}
        self.up: dict[Node, Node] = {}
        self.open: set[Node] = set()
        self.widths: dict[int, list[int]] = {}
        self._ways: dict[Node, tuple[Node, tuple[Step, ...], str | None]] = {}
        for tree, n in sizes.items():
            levels = self.widths[tree] = [n]
            while levels[-1] > 1:
                levels.append(-(-levels[-1] // ARITY))

    def run(self, node: Node) -> list[Node]:
        """A node and its siblings."""
        tree, level, i = node
        first = i - i % ARITY
        return [(tree, level, k) for k in range(first, min(first + ARITY, self.widths[tree][level]))]

    def add(self, node: Node, digest: str) -> None:
        """A node, and the parents that it completes."""
        while True:
            self.digests[node] = digest
            self.open.add(node)
            tree, level, i = node
            if self.widths[tree][level] == 1:
                if tree == TOP:
                    return
                run, parent = [node], (TOP, 0, tree)  # a subroot is a leaf as it is
            else:
                run, parent = self.run(node), (tree, level + 1, i // ARITY)
                if not all(k in self.digests for k in run):
                    return
                digest = hashlib.sha256("".join([self.digests[k] for k in run]).encode()).hexdigest()
            for k in run:
                self.open.discard(k)
                self.up[k] = parent
            node = parent

    def way(self, node: Node) -> tuple[Node, tuple[Step, ...], str | None]:
        """The open node that a node leads to, the siblings on the way, and the subroot if it is passed."""
        if node in self._ways:
            return self._ways[node]
        tree, level, i = node
        subroot = self.digests[node] if tree != TOP and self.widths[tree][level] == 1 else None
        parent = self.up.get(node)
        if parent is None:
            found = node, (), subroot
        else:
            end, steps, above = self.way(parent)
            if parent[0] == tree:
                run, at = [self.digests[k] for k in self.run(node)], i % ARITY
                steps = (("".join(run[:at]), "".join(run[at + 1 :])), *steps)
            found = end, steps, subroot or above
        if level:  # what leaves share; each of them is asked for once
            self._ways[node] = found
        return found


STEPS = "array<struct<left:string,right:string>>"
NODE = "tree bigint, level int, place bigint, size bigint, digest string"
LINK = f"part bigint, {NODE}, up_tree bigint, up_level int, up_place bigint, up_size bigint, up_digest string, subroot string, steps {STEPS}"
STEP_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
NODE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]


def tabled(rows: list[tuple], kinds: Sequence[pa.DataType]) -> pa.Table:
    """Rows as the first columns of LINK."""
    names = [c.split()[0] for c in LINK.split(", ")]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names[: len(kinds)])


def as_steps(steps: Sequence[Step]) -> list[dict]:
    return [{"left": a, "right": b} for a, b in steps]


def forest_of(nodes: pa.Table, trees: int) -> Forest:
    """The forest of rows that have tree, level, place, size, digest."""
    columns = [nodes.column(c).to_pylist() for c in ("tree", "level", "place", "size", "digest")]
    forest = Forest(dict(zip(columns[0], columns[3], strict=True)) | {TOP: trees})
    for tree, level, place, _, digest in zip(*columns, strict=True):
        forest.add((tree, level, place), digest)
    return forest


def indexed(rows: DataFrame, rows_a_part: int) -> tuple[DataFrame, int]:
    """Of saved rows (row, name, rank, digest, own_number): row, part and NODE (level 0), saved; the number of trees."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_a_part))
    keys = [F.col("name").asc_nulls_first(), F.col("rank").asc_nulls_first(), F.col("digest"), F.col("own_number")]
    in_order = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = saved(in_order.select("row", "name", "digest", "at", F.shiftright("at", SHIFT).alias("part")), "manifest-sorted")
    # a run: the rows of one tree in one partition; they follow each other
    runs = saved(dealt.groupBy("part", "name").agg(F.count("*").alias("n"), F.min("at").alias("begin")), "manifest-runs")
    own = Window.partitionBy("name")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"before": before, "size": F.sum("n").over(own)})
    # trees are numbered in order: by the partition that they begin in, and by where
    first = runs.filter("before = 0")
    ahead = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = first.groupBy("part").count().select("part", ahead.alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("begin")) - 1
    numbers = first.withColumn("inside", inside).join(F.broadcast(begun), "part").select(F.col("name").alias("tree_name"), (F.col("ahead") + F.col("inside")).cast("long").alias("tree"))
    numbers = saved(numbers, "manifest-trees")
    few = runs.count() <= BROADCAST_ROWS

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df.hint("merge")

    runs = runs.join(small(numbers), F.col("name").eqNullSafe(F.col("tree_name")))
    runs = runs.select(F.col("part").alias("run_part"), "tree_name", "tree", (F.col("before") - F.col("begin")).alias("shift"), "size")
    found = dealt.join(small(runs), (F.col("part") == F.col("run_part")) & F.col("name").eqNullSafe(F.col("tree_name")))
    leaves = found.select("row", "part", "tree", F.lit(0).alias("level"), (F.col("at") + F.col("shift")).alias("place"), "size", "digest")
    return saved(leaves, "manifest-leaves"), numbers.count()


def merged(nodes: DataFrame, trees: int, fan: int) -> DataFrame:
    """One round over open nodes (part, NODE): each with the open node of its merged forest, and the way there (LINK)."""
    kinds = [pa.int64(), *NODE_TYPES, *NODE_TYPES, pa.string(), STEP_TYPE]

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        forest, rows = forest_of(group, trees), []
        for row in group.to_pylist():
            up, steps, subroot = forest.way((row["tree"], row["level"], row["place"]))
            size = forest.widths[up[0]][0]
            rows.append((row["part"], row["tree"], row["level"], row["place"], row["size"], row["digest"], *up, size, forest.digests[up], subroot, as_steps(steps)))
        return tabled(rows, kinds)

    return nodes.groupBy(F.floor(F.col("part") / fan).alias("merged_part")).applyInArrow(merge, LINK)


def ways(leaves: DataFrame, trees: int, fan: int) -> DataFrame:
    """part, tree, level, place, subroot, steps, root of each node that a partition leaves open: its way to the root."""

    def fragment(key: tuple, group: pa.Table) -> pa.Table:
        forest = forest_of(group, trees)
        rows = [(key[0].as_py(), *node, forest.widths[node[0]][0], forest.digests[node]) for node in sorted(forest.open)]
        return tabled(rows, [pa.int64(), *NODE_TYPES])

    own = leaves.select("part", "tree", "level", "place", "size", "digest")
    nodes = saved(own.groupBy("part").applyInArrow(fragment, f"part bigint, {NODE}"), "manifest-open")
    parts, rounds = (nodes.agg(F.max("part")).first()[0] or 0) + 1, []
    while True:
        rounds.append(saved(merged(nodes, trees, fan), "manifest-round"))
        parts = -(-parts // fan)
        if parts == 1:
            break
        up = [F.col(f"up_{c}").alias(c) for c in ("tree", "level", "place", "size", "digest")]
        nodes = rounds[-1].select(F.floor(F.col("part") / fan).alias("part"), *up).distinct()
    columns = ["part", "tree", "level", "place", "subroot", "steps", "up_tree", "up_level", "up_place"]
    found = rounds[-1].select(*columns, F.col("up_digest").alias("root"))
    for below in reversed(rounds[:-1]):
        above = found.select(*[F.col(c).alias(f"above_{c}") for c in ("part", "tree", "level", "place", "subroot", "steps")], "root")
        meets = (F.floor(F.col("part") / fan) == F.col("above_part")) & (F.col("up_tree") == F.col("above_tree")) & (F.col("up_level") == F.col("above_level")) & (F.col("up_place") == F.col("above_place"))
        both = below.join(above, meets)
        found = saved(both.select("part", "tree", "level", "place", F.coalesce("subroot", "above_subroot").alias("subroot"), F.concat("steps", "above_steps").alias("steps"), "up_tree", "up_level", "up_place", "root"), "manifest-ways")
    return found.select("part", "tree", "level", "place", "subroot", "steps", "root")


def proven(rows: DataFrame, tree: str = "source", order: str = "doc_id", leaf: str = "leaf", rows_a_part: int = ROWS, fan: int = FAN) -> DataFrame:
    """``rows`` with subroot, root and proof: the digests to the left and right of each step from the leaf to the root.

    tree, order, leaf: the columns that tell a row's tree, its place in it and its digest in
    hex. ``folded(leaf, proof)`` is the root.
    """
    # a row in one column, so that no name of the input meets one of ours
    whole = rows.select(F.struct(*rows.columns).alias("row"), F.col(tree).alias("name"), F.col(order).alias("rank"), F.col(leaf).alias("digest"), F.monotonically_increasing_id().alias("own_number"))
    leaves, trees = indexed(saved(whole, "manifest-rows"), rows_a_part)
    found = saved(ways(leaves, trees, fan), "manifest-ways")
    names = T.StructType.fromDDL(f"subroot string, root string, proof {STEPS}")

    def finish(group: pa.Table, above: pa.Table) -> pa.Table:
        forest = forest_of(group, trees)
        on = {(w["tree"], w["level"], w["place"]): (w["subroot"], w["root"], [(x["left"], x["right"]) for x in w["steps"]]) for w in above.to_pylist()}
        subroots, roots, ends, left, right = [], [], [0], [], []
        for t, p in zip(group.column("tree").to_pylist(), group.column("place").to_pylist(), strict=True):
            up, steps, subroot = forest.way((t, 0, p))
            beyond, root, more = on[up]
            subroots.append(subroot or beyond)
            roots.append(root)
            for a, b in (*steps, *more):
                left.append(a)
                right.append(b)
            ends.append(len(left))
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        return pa.Table.from_arrays([group.column("row").combine_chunks(), pa.array(subroots, pa.string()), pa.array(roots, pa.string()), proof], ["row", *names.names])

    schema = T.StructType([T.StructField("row", leaves.schema["row"].dataType), *names.fields])
    return leaves.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(finish, schema).select("row.*", *names.names)


def leaves_of(docs: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """doc_id, source, leaf, tampered of each row; tampered: the leaf after tampering, where the CRC-32 of the id is even (its text loses its line ends), else null."""
    told = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    other = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns]
    return docs.select("doc_id", "source", leaf(*map(F.col, columns)).alias("leaf"), F.when(told, leaf(*other)).alias("tampered"))
