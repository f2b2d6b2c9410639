"""Sharding by a hierarchical weighted hash tree.

A document's id descends from the root through regions and racks to a shard.  At each level every child draws a hash of (id, child) as a number
u in (0, 1), and the child with the smallest -ln(u) / weight is taken, so a child is taken with a probability in
proportion to its weight (the sum of the shards' weights below it), and a change of one weight moves only ids into or out of that child's subtree.  grow() adds a shard as a region of its own: every draw among the old children keeps its value, so ids move only into it.

All of it is DataFrame expressions.  Slots number a shard's rows from 0 without gaps: rows are numbered within (shard, block), where the block is
a part of the id's hash, and each block starts where the counts of the blocks before it end.  No task holds a shard, only a block.

Cases: a null id is hashed as the empty string; null text has no bytes and the checksum 0; equal ids go to one shard, in the order of their
text's checksum and size; rows that are equal in all of these take slots in any order; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 0.0
    shard: int = -1
    children: tuple[Node, ...] = field(default_factory=tuple)

    @property
    def total(self) -> float:
        return self.weight if self.shard >= 0 else sum(c.total for c in self.children)


def layout(regions: int, racks: int, shards: int, weight: float = 1.0) -> Node:
    """A tree of equal shards, numbered from 0 in depth-first order."""
    number = iter(range(regions * racks * shards))
    return Node("root", children=tuple(Node(f"g{g}", children=tuple(Node(f"g{g}r{r}", children=tuple(Node(f"s{n}", weight, n) for n in (next(number) for _ in range(shards)))) for r in range(racks))) for g in range(regions)))


def grow(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    return Node(tree.name, children=(*tree.children, Node(f"g-s{shard}", children=(Node(f"g-s{shard}-r", children=(Node(f"s{shard}", weight, shard),)),))))


def leaves(tree: Node) -> list[int]:
    return [tree.shard] if tree.shard >= 0 else [s for c in tree.children for s in leaves(c)]


def _draw(key: str) -> str:
    """-ln(u) / weight of a child c; u has 52 bits of the hash of the key and the child's name."""
    bits = f"CAST(conv(substr(md5(CAST(concat({key}, ':', c.name) AS BINARY)), 1, 13), 16, 10) AS DOUBLE)"
    return f"-ln(({bits} + 1D) / {2**52 + 1}D) / c.weight"


def descend(df: DataFrame, key: str, tree: Node, to: str) -> DataFrame:
    """Adds column `to`, the shard of the string column `key`.  Each level looks up the children of the node reached so far and takes the one
    with the smallest draw, the first on a tie."""
    at, level = f"'{tree.name}'", [tree]
    while any(n.shard < 0 for n in level):
        rows = []
        for n in level:
            live = [(c.name, c.total) for c in n.children if c.total > 0] if n.shard < 0 else [(n.name, 1.0)]
            rows.append(f"'{n.name}', array({', '.join(f"named_struct('i', {i}, 'name', '{name}', 'weight', {weight!r}D)" for i, (name, weight) in enumerate(live))})")
        at = f"array_min(transform(element_at(map({', '.join(rows)}), {at}), c -> struct({_draw(key)} AS d, c.i, c.name))).name"
        level = [c for n in level for c in (n.children or (n,)) if c.total > 0]
    numbers = ", ".join(f"'{n.name}', {n.shard}" for n in level)
    return df.withColumn(to, F.expr(f"element_at(map({numbers}), {at})"))


def assign(df: DataFrame, tree: Node, grown: Node | None = None, blocks: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (null without `grown`) of every row."""
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"),
    )
    rows = descend(rows, "_key", tree, "shard")
    rows = descend(rows, "_key", grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = rows.withColumn("_block", F.expr(f"CAST(CAST(conv(substr(md5(CAST(concat(_key, ':block') AS BINARY)), 1, 6), 16, 10) AS BIGINT) % {blocks} AS INT)")).drop("_key")
    # One row for each shard and block at most, so its size is bounded by the layout, whatever the input.
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    starts = counts.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_start"))
    within = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("_row", F.row_number().over(within) - 1)
    return rows.join(F.broadcast(starts), ["shard", "_block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_row")).cast("long").alias("slot"), "grown_shard")
