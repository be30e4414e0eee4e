"""A Merkle manifest of a dataset: fragments of a sparse forest that merge wherever a run of siblings is whole.

A fragment is a set of nodes, each with its tree, level, place and hash. Merging two unites them and replaces every run
of siblings that is whole, which a tree's size tells, by their parent; the order of merges doesn't matter. Each tree of a
language ends in its subroot, which is a leaf of the tree above all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.session import checkpointed, id_remainder, parts_for

#: Children of a node, rows of a partition (about), and fragments that a task merges in a round.
ARITY, ROWS, FAN = 8, 1 << 15, 16
#: The number of the tree whose leaves are the subroots.
TOP = -1

Node = tuple[int, int, int]  #: tree, level, place


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(size: int) -> list[int]:
    """Nodes of each level of a tree with so many leaves; the last level has one."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Forest:
    """Nodes by (tree, level, place) with their hashes; ``sizes`` has the leaves of each tree that occurs."""

    def __init__(self, sizes: dict[int, int]):
        self.sizes, self.nodes, self.made = sizes, {}, {}
        self.widths = {tree: widths(size) for tree, size in sizes.items()}
        self.open: dict[Node, int] = {}

    def _up(self, node: Node) -> tuple[Node, int] | None:
        """What a node is part of and of how many parts; a subroot is a part by itself. None above the root."""
        tree, level, place = node
        n = self.widths[tree][level]
        if n > 1:
            return (tree, level + 1, place // ARITY), min(ARITY, n - place // ARITY * ARITY)
        return None if tree == TOP else ((TOP, 0, tree), 1)

    def add(self, node: Node, value: str) -> None:
        """Adds a node (again: nothing), and parents as long as runs become whole."""
        while node not in self.nodes:
            self.nodes[node] = value
            up = self._up(node)
            if up is None:
                return
            parent, n = up
            self.open[parent] = self.open.get(parent, 0) + 1
            if self.open[parent] < n:
                return
            del self.open[parent]
            value = value if parent[0] != node[0] else digest(self.nodes[x] for x in self.run(node))
            self.made[parent] = value
            node = parent

    def run(self, node: Node) -> list[Node]:
        """A node with its siblings, in order."""
        tree, level, place = node
        low = place // ARITY * ARITY
        return [(tree, level, i) for i in range(low, min(low + ARITY, self.widths[tree][level]))]

    def unresolved(self) -> list[Node]:
        """Nodes whose parents aren't known."""
        return [x for x in self.nodes if (up := self._up(x)) is None or up[0] not in self.nodes]

    def path(self, leaf: Node) -> list[tuple[list[Node], int]]:
        """The runs from a leaf to the root that have siblings, and the node's place in each."""
        out, node = [], leaf
        while (up := self._up(node)) is not None:
            if up[0][0] == node[0]:
                out.append((self.run(node), node[2] % ARITY))
            node = up[0]
        return out


_NODE = "part long, tree long, size long, level long, place long, hash string"


def _rows(forest: Forest, part: int, kept: list[Node], **flags: list[bool]) -> pa.Table:
    return pa.table({
        "part": pa.array([part] * len(kept), pa.int64()), "tree": pa.array([x[0] for x in kept], pa.int64()), "size": pa.array([forest.sizes[x[0]] for x in kept], pa.int64()),
        "level": pa.array([x[1] for x in kept], pa.int64()), "place": pa.array([x[2] for x in kept], pa.int64()), "hash": pa.array([forest.nodes.get(x) for x in kept], pa.string()),
        **{name: pa.array(flag, pa.bool_()) for name, flag in flags.items()},
    })


class Layout:
    """Where the leaves of each partition of the sorted table stand: its first language's tree, the leaves before, sizes of the trees that cross its ends."""

    def __init__(self, first_tree: dict[int, int], before: dict[int, int], sizes: dict[int, tuple[int, int]], trees: int):
        self.first_tree, self.before, self.sizes, self.trees = first_tree, before, sizes, trees

    def placed(self, part: int, langs: list[str | None]) -> tuple[list[Node], dict[int, int]]:
        """The nodes of a partition's leaves, by its rows' languages in order, and the sizes of their trees."""
        tree, place, nodes, sizes = self.first_tree[part], self.before[part], [], {TOP: self.trees}
        for i, lang in enumerate(langs):
            if i and lang != langs[i - 1]:
                sizes[tree] = place
                tree, place = tree + 1, 0
            nodes.append((tree, 0, place))
            place += 1
        sizes[tree] = self.sizes[part][1]
        sizes[self.first_tree[part]] = self.sizes[part][0]
        return nodes, sizes


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("k")


def _grown(layout: Layout):
    def run(rows: pa.Table) -> pa.Table:
        """The unresolved nodes of a partition, and as ``needs`` the siblings that its leaves' paths lack."""
        rows, part = _ordered(rows), rows["part"][0].as_py()
        nodes, sizes = layout.placed(part, rows["lang"].to_pylist())
        forest = Forest(sizes)
        for node, value in zip(nodes, rows["leaf"].to_pylist(), strict=True):
            forest.add(node, value)
        lacking: dict[Node, None] = {}
        edges = {nodes[i] for i in range(len(nodes)) if i in (0, len(nodes) - 1) or nodes[i][0] != nodes[i - 1][0] or nodes[i + 1][0] != nodes[i][0]}
        for leaf in edges:  # what stands between the ends of a tree's leaves is known
            for run_, _ in forest.path(leaf):
                lacking |= {x: None for x in run_ if x not in forest.nodes}
            lacking |= {x: None for x in ((TOP, 0, leaf[0]),) if x not in forest.nodes}
        kept = forest.unresolved()
        return _rows(forest, part, [*kept, *lacking], need=[False] * len(kept) + [True] * len(lacking))

    return run


def _merged(rows: pa.Table) -> pa.Table:
    """Fragments as one: its unresolved nodes, and the nodes that it made (``made``; these can be both)."""
    part, sizes = rows["part"][0].as_py(), dict(zip(rows["tree"].to_pylist(), rows["size"].to_pylist(), strict=True))
    top = rows["trees"][0].as_py()
    forest = Forest(sizes | {TOP: top})
    for tree, level, place, value in zip(*(rows[c].to_pylist() for c in ("tree", "level", "place", "hash")), strict=True):
        forest.add((tree, level, place), value)
    open_ = set(forest.unresolved())
    kept = [*open_, *(x for x in forest.made if x not in open_)]
    return _rows(forest, part, kept, open=[x in open_ for x in kept], made=[x in forest.made for x in kept])


def tree_reduced(fragments: DataFrame, parts: int, trees: int) -> DataFrame:
    """The fragments' nodes (see ``_NODE``) and all that their merges make, each once; with ``open`` for the root.

    A tree reduction: in each round a task merges FAN neighbouring fragments into one. What a round makes stays in a table, so
    proofs can be read from it, and nothing but the root comes to the driver.
    """
    made, now = fragments.select(_names(_NODE)), fragments.select(_names(_NODE))
    while True:
        grouped = now.withColumn("part", F.floor(F.col("part") / FAN)).withColumn("trees", F.lit(trees).cast("long"))
        merged = checkpointed(grouped.groupBy("part").applyInArrow(_merged, f"{_NODE}, open boolean, made boolean"))
        made, now = made.unionByName(merged.where("made").select(_names(_NODE))), merged.where("open").select(_names(_NODE))
        parts = -(-parts // FAN)
        if parts <= 1:
            return made


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _proved(layout: Layout):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        """Each row's proof and the root that its leaf, as it is or tampered with, folds to with its siblings."""
        rows, part = _ordered(rows), rows["part"][0].as_py() if rows.num_rows else None
        if part is None:
            return pa.table({c: pa.array([], t) for c, t in (("row", pa.int64()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()))})
        nodes, sizes = layout.placed(part, rows["lang"].to_pylist())
        forest = Forest(sizes)
        for node, value in zip(nodes, rows["leaf"].to_pylist(), strict=True):
            forest.add(node, value)
        have = forest.nodes | {(t, level, p): h for t, level, p, h in zip(*(known[c].to_pylist() for c in ("tree", "level", "place", "hash")), strict=True)}
        subroots, proofs, folded = [], [], []
        for node, leaf, other in zip(nodes, rows["leaf"].to_pylist(), rows["tampered"].to_pylist(), strict=True):
            value, siblings = leaf if other is None else other, []
            for run_, at in forest.path(node):
                hashes = [have[x] for x in run_]
                siblings += hashes[:at] + hashes[at + 1 :]
                value = digest([*hashes[:at], value, *hashes[at + 1 :]])
            subroots.append(have[(TOP, 0, node[0])])
            proofs.append(digest(siblings))
            folded.append(value)
        return pa.table({"row": rows["k"], "subroot": pa.array(subroots), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded)})

    return run


def field(value: Column) -> Column:
    """A value as it enters a hash: its length in bytes, a colon and itself in UTF-8; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def manifest(docs: DataFrame, tampered_with: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf hashes doc_id, source, lang, n_chars and text. A language's leaves stand by doc_id, and every 8 nodes have a parent
    until one is left, the subroot; subroots, by language, have the root in the same way. The proof of a row is the hash of its
    siblings from leaf to root; folding the leaf with them gives ``folded_root``. ``tampered_with`` (a text, or null where it is as
    it was) changes what is folded: the query lower-cases the text of ids whose crc32 3 divides.

    Null values enter as such: a null language and a null id stand first. Rows that repeat an id stand by leaf hash, equal rows have
    leaves each. Texts of any length are hashed whole. An empty table gives an empty result; other columns are not looked at.

    The table is sorted into partitions of about 32,768 rows; a few numbers of each come to the driver. A partition's
    rows without their texts, and the unresolved nodes of 16 fragments, are what a task holds.
    """
    changed = F.when(id_remainder("doc_id", 3) == 0, lowered(F.col("text"))) if tampered_with is None else tampered_with
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_hash(*own, F.col("text")).alias("leaf"), F.when(changed.isNotNull() & (changed != F.col("text")), leaf_hash(*own, changed)).alias("tampered"))
    leaves = checkpointed(leaves.withColumn("row", F.monotonically_increasing_id()))
    order = ["lang", "doc_id", "leaf", "row"]
    ordered = leaves.repartitionByRange(parts_for(leaves.count(), ROWS), *order).sortWithinPartitions(*order)
    ordered = checkpointed(ordered.select("doc_id", "lang", "leaf", "tampered", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("k")))
    counts = checkpointed(ordered.groupBy("part", "lang").agg(F.count(F.lit(1)).alias("n")))
    langs = counts.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("size"), F.min("part").alias("first"))
    # Of each partition: languages that begin in it, and how its first and last one stand to the others. A few numbers each.
    begun = langs.groupBy(F.col("first").alias("part")).agg(F.count(F.lit(1)).alias("begun"))
    spans = counts.join(langs, F.col("lang").eqNullSafe(F.col("of_lang"))).select("part", "lang", "n", "size", "first")
    across = spans.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("part")))
    key = F.struct(F.col("lang").isNotNull(), "lang")
    ends = across.groupBy("part").agg(F.min_by(F.struct((F.col("upto") - F.col("n")).alias("before"), "size", "first"), key).alias("low"), F.max_by("size", key).alias("high"))
    found = ends.join(begun, "part", "left").select("part", "low.*", "high", F.coalesce("begun", F.lit(0)).alias("begun")).orderBy("part").collect()
    first_tree, before, sizes, trees = {}, {}, {}, 0
    for r in found:
        first_tree[r["part"]] = trees - (r["first"] != r["part"])
        before[r["part"]], sizes[r["part"]] = r["before"], (r["size"], r["high"])
        trees += r["begun"]
    layout = Layout(first_tree, before, sizes, trees)
    grown = ordered.select("part", "k", "lang", "leaf").groupBy("part").applyInArrow(_grown(layout), f"{_NODE}, need boolean")
    grown = checkpointed(grown)
    nodes = checkpointed(tree_reduced(grown.where("not need"), max(first_tree, default=0) + 1, trees))
    place = ["tree", "level", "place"]
    root = nodes.where((F.col("tree") == TOP)).orderBy(F.desc("level"), "place").select("hash").head()
    root = root["hash"] if root else None
    needs = grown.where("need").select(F.col("part").alias("of"), *place).join(nodes.select(*place, "hash"), place)
    proved = ordered.groupBy("part").cogroup(needs.groupBy("of")).applyInArrow(_proved(layout), "row long, subroot string, proof_sha256 string, folded_root string")
    rows = ordered.select("k", "doc_id", "leaf").join(proved, F.col("k") == F.col("row"))
    return rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
