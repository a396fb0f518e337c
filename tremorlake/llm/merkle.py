"""A manifest of a table's rows as a persistent Merkle tree: a subtree for each group, and one tree over the groups' roots.

Leaves are cut into aligned blocks of 8^4 neighbours (a parameter), so that no task holds a group. A block's nodes are built in one task, its
root is a leaf of the next floor, and so on until a group has one node left. The way back goes from floor to floor: each block gets
the siblings between its root and the root of all, once for its 4,096 nodes. A changed leaf is a version of the tree: within its
block only its ancestors are copied, all other nodes are shared, and the version goes on along the block's upper siblings.
Versions of one block stay in its task; versions of different blocks never meet.

Positions come from ranges of rows in order, so they need one row per range in one window of each group, and no more.

Nulls: a null field is a value of its own; a null group is a group that comes first, a null doc_id comes before all others and is
never changed. Texts may be empty or long: only digests are moved. Rows equal in doc_id go by their leaves; rows equal in
everything are interchangeable leaves. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import parts

WIDTH = 8
BLOCK_LEVELS = 4


def digest(*inputs: Column) -> Column:
    """Lower-case hexadecimal sha256 of the inputs in a row."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: its byte count and value, which no other value can look like, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(group: Column) -> Column:
    """A name that is never null and sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """The number of levels above ``n`` leaves."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * WIDTH
    return levels


class Block:
    """The nodes above a run of digests, never changed once made."""

    def __init__(self, digests: list[str], levels: int):
        self.levels = [digests]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([sha256("".join(below[i:i + WIDTH])) for i in range(0, len(below), WIDTH)])

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """What stands left and right of the path from a leaf to the root, level by level."""
        found = []
        for nodes in self.levels[:-1]:
            start = at // WIDTH * WIDTH
            found.append(("".join(nodes[start:at]), "".join(nodes[at + 1:start + WIDTH])))
            at //= WIDTH
        return found


def copied(path: list[tuple[str, str]], node: str) -> list[str]:
    """The copies of a leaf's ancestors in the version that has ``node`` in its place; all else on the way is shared."""
    copies = []
    for left, right in path:
        node = sha256(left + node + right)
        copies.append(node)
    return copies


def _block_of(levels: int) -> Column:
    return F.expr(f"pos div {WIDTH ** levels}")


def _sorted_block(rows: pa.Table, levels: int) -> tuple[pa.Table, Block]:
    rows = rows.sort_by("pos")
    n = rows.column("n")[0].as_py()
    return rows, Block(rows.column("digest").to_pylist(), min(depth(n), levels))


def block_roots(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The next floor (grp, pos, n, digest) above ``nodes``; n counts the group's nodes of a floor."""
    schema = "grp STRING, pos BIGINT, n BIGINT, digest STRING"

    def roots(rows: pa.Table) -> pa.Table:
        rows, block = _sorted_block(rows, levels)
        n = rows.column("n")[0].as_py()
        return pa.table({"grp": rows.column("grp").slice(0, 1), "pos": [rows.column("pos")[0].as_py() // WIDTH ** levels],
                         "n": [-(-n // WIDTH ** levels)], "digest": [block.levels[-1][0]]})

    return nodes.select("grp", "pos", "n", "digest").groupBy("grp", _block_of(levels)).applyInArrow(roots, schema)


def floors(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The leaves and the floors above them that still have several nodes in a group, and each group's root (grp, digest)."""
    found, roots = [leaves], None
    while True:
        above = stored(block_roots(found[-1], levels), "floor")
        ended = above.filter("n = 1").select("grp", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        above = above.filter("n > 1")
        if above.isEmpty():
            return found, roots
        found.append(above)


def in_order(rows: DataFrame, order: Sequence[str], rows_per_range: int = 65_536) -> DataFrame:
    """``rows`` (with grp) with their position in the group from 0 as ``pos`` and the group's size as ``n``, written to a table.

    Rows are numbered once, so ranges can cut between rows that are equal in everything.
    """
    numbered = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    keys = ["grp", *order, "tie"]
    ranged = numbered.repartitionByRange(parts(numbered.count(), rows_per_range), *keys).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "ranged-leaves")
    counts = ranged.groupBy("grp", "range").agg(F.count("*").alias("held"))
    before, whole = Window.partitionBy("grp").orderBy("range"), Window.partitionBy("grp")
    bases = stored(counts.select("grp", "range", (F.sum("held").over(before) - F.col("held")).alias("base"), F.sum("held").over(whole).alias("n")), "bases")
    turn = F.row_number().over(Window.partitionBy("grp", "range").orderBy(*order, "tie"))
    placed = ranged.withColumn("turn", turn).join(bases, ["grp", "range"])
    return stored(placed.select(*rows.columns, (F.col("base") + F.col("turn") - 1).alias("pos"), "n"), "placed-leaves")


def _above(nodes: DataFrame, tops: DataFrame, paths: DataFrame | None, levels: int) -> DataFrame:
    """The way from each block's root on: that of its node on the next floor, or its group's when the group ends there."""
    ended = nodes.filter(f"n <= {WIDTH ** levels} AND pos = 0").select(F.col("grp").alias("of"))
    rows = ended.join(tops, F.col("of") == F.col("grp")).drop("of").withColumn("pos", F.lit(0).cast("bigint"))
    return rows if paths is None else rows.unionByName(paths)


_PATH = "grp STRING, pos BIGINT, lefts ARRAY<STRING>, rights ARRAY<STRING>, subroot STRING, root STRING"


def _way(above: pa.Table) -> tuple[list[tuple[str, str]], str, str]:
    row = above.to_pylist()[0]
    return list(zip(row["lefts"], row["rights"])), row["subroot"], row["root"]


def _paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """For each node what stands left and right of its path to the root of all."""
    def run(rows: pa.Table, way: pa.Table) -> pa.Table:
        rows, block = _sorted_block(rows, levels)
        upper, subroot, root = _way(way)
        whole = [block.siblings(i) + upper for i in range(rows.num_rows)]
        return pa.table({"grp": rows.column("grp"), "pos": rows.column("pos"), "lefts": [[a for a, _ in p] for p in whole],
                         "rights": [[b for _, b in p] for p in whole], "subroot": [subroot] * rows.num_rows, "root": [root] * rows.num_rows},
                        schema=pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("lefts", pa.list_(pa.string())),
                                          ("rights", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]))

    blocks = nodes.select("grp", "pos", "n", "digest").groupBy("grp", _block_of(levels))
    return blocks.cogroup(above.groupBy("grp", "pos")).applyInArrow(run, _PATH)


def _descend(found: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The way from the root of every block of leaves to the root of all."""
    paths = None
    for nodes in reversed(found[1:]):
        paths = stored(_paths(nodes, _above(nodes, tops, paths, levels), levels), "paths")
    return _above(found[0], tops, paths, levels)


def _group_tops(roots: DataFrame, levels: int) -> DataFrame:
    """(grp, lefts, rights, subroot, root): the way from each group's root to the root of all."""
    ranked = in_order(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    found, top = floors(ranked, levels)
    none = F.array().cast("array<string>")
    start = top.select("grp", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    way = _paths(ranked, _descend(found, start, levels), levels)
    joined = ranked.select("pos", "name", "digest").join(way.drop("subroot", "grp"), "pos")
    return stored(joined.select(F.col("name").alias("grp"), "lefts", "rights", F.col("digest").alias("subroot"), "root"), "tops")


def manifest(leaves: DataFrame, order: str = "doc_id", levels: int = BLOCK_LEVELS, rows_per_range: int = 65_536) -> DataFrame:
    """``leaves``: grp (see :func:`group_key`), the column ``order``, digest, and altered: a changed leaf's digest or null.

    One row per leaf: ``order``, leaf, subroot, root, proof (the digests of its siblings up to the root of all, in a row),
    copied (the ancestors that its version copies, root last; null without a change) and folded_root: the root that the changed, or
    else the original, leaf and the original siblings give. Blocks hold 8^``levels`` leaves.
    """
    kind = leaves.schema[order].dataType.simpleString()
    placed = in_order(leaves, [order, "digest"], rows_per_range)
    found, roots = floors(placed, levels)
    above = _descend(found, _group_tops(roots, levels), levels)

    def run(rows: pa.Table, way: pa.Table) -> pa.Table:
        rows, block = _sorted_block(rows, levels)
        upper, subroot, root = _way(way)
        leaf, altered = block.levels[0], rows.column("altered").to_pylist()
        proofs, copies, folded = [], [], []
        shared: list[tuple[str, str]] = []
        beyond = ""
        for i, (node, change) in enumerate(zip(leaf, altered)):
            if i % WIDTH == 0:  # the way above the parent is that of all its children
                shared = block.siblings(i)[1:] + upper
                beyond = "".join(a + b for a, b in shared)
            start = i // WIDTH * WIDTH
            own = [("".join(leaf[start:i]), "".join(leaf[i + 1:start + WIDTH]))] if len(block.levels) > 1 else []
            path = own + shared
            proofs.append("".join(a + b for a, b in own) + beyond)
            version = copied(path, node if change is None else change)
            copies.append(None if change is None else version)
            folded.append(version[-1] if version else (node if change is None else change))
        n = rows.num_rows
        return pa.table({order: rows.column(order), "leaf": leaf, "subroot": [subroot] * n, "root": [root] * n, "proof": pa.array(proofs, pa.string()),
                         "copied": pa.array(copies, pa.list_(pa.string())), "folded_root": folded})

    blocks = placed.groupBy("grp", _block_of(levels)).cogroup(above.groupBy("grp", "pos"))
    return blocks.applyInArrow(run, f"`{order}` {kind}, leaf STRING, subroot STRING, root STRING, proof STRING, copied ARRAY<STRING>, folded_root STRING")


def document_leaves(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
                    every: int = 3) -> DataFrame:
    """Leaves of documents. Where ``every`` divides the crc32 of the decimal doc_id, the text's A-Z are lower-cased in the changed leaf."""
    small = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    changed = digest(*[field(small if c == "text" else F.col(c)) for c in fields])
    return docs.select("doc_id", group_key(F.col(group)).alias("grp"), digest(*[field(F.col(c)) for c in fields]).alias("digest"),
                       F.when(chosen, changed).alias("altered"))
