"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

Sketch (Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017).  In each of T rounds, every element of a set is hashed to a bin and a
value; in T further rounds, round T + j throws every element into bin j.  A bin keeps the smallest value of the first round that reaches it, so every
coordinate of every non-empty set is filled, in time O(n + T log T), and the share of equal coordinates is concentrated about the Jaccard similarity
as for T independent samples.  Rounds stop when all bins are full.

Banding: BANDS bands of ROWS coordinates.  A pair of similarity 0.8 meets in a band unless all fail: (1 - 0.8**7)**48 = 1.2e-5; one of 0.5 meets with
probability 0.31, one of 0.3 with 0.01.

Sets that are equal are one node from the start.  Nodes that meet are confirmed on the full sets, in rounds that each look only at pairs of which the
ends aren't yet connected: (1) each node with the smallest node it meets; (2) all pairs of small buckets, and each node with the smallest of each
bucket; (3) in large buckets, what is outside the bucket's largest component against the whole bucket, in blocks of bounded size.  So no link that
would join two components is left out, and a group of n mutual copies costs about n confirmations.

Cases: null and empty texts have no shingles and are linked with nothing; texts of fewer words than a shingle are one shingle; rows with one doc_id
count as one document; a null doc_id has no component of its own (null, and is kept) unless an equal set gives it one (and isn't kept); very long
texts are read whole, and their sets fill a block by themselves; ties of ids can't occur otherwise; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from boardlark.llm.shared import Scratch, arrow_pass, fresh, lists, mix64, utf8

BANDS, ROWS = 48, 7
T = BANDS * ROWS
#: Least similarity of a link, in hundredths.
SIMILAR = 80
#: Buckets up to this size are paired within; larger ones go by rounds.
SMALL = 8
#: Nodes and shingles in one side of a block, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = mix64(np.arange(1, 2 * T + 1, dtype=np.uint64) * _GOLD)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A to Z lower-cased) of all rows, and where each row's words start."""
    inside = ~_SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = inside[edge]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.flatnonzero(inside)
    word = np.cumsum(first)[place] - 1
    depth = place - at[word]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(depth.max()), np.uint64(0x100000001B3 * 2 + 1), np.uint64)]))
    value = _LETTERS[_FOLD[data[place]]] * power[depth]
    hashes = np.add.reduceat(value, np.flatnonzero(first[place]))
    return mix64(hashes), np.searchsorted(at, offsets)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each row of a string column, its distinct shingles as sorted 64-bit hashes."""
    data, offsets, _ = utf8(column)
    hashes, starts = _words(data, offsets)
    with np.errstate(over="ignore"):
        run = hashes.copy()
        for j in range(1, words):
            run = mix64(run[: max(0, len(hashes) - j)] * np.uint64(0xD6E8FEB86659FD93) + hashes[j:])
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a >= words:
                yield np.unique(run[a : b - words + 1])
            elif b > a:
                whole = hashes[a]
                for h in hashes[a + 1 : b]:
                    whole = mix64(whole * np.uint64(0xD6E8FEB86659FD93) + h)
                yield np.array([mix64(whole + np.uint64(b - a))], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set: the round in the high half, the value in the low half."""
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, min(2 * T, 4096 // len(elements)))  # several rounds at once for small sets
    for i in range(0, 2 * T, step):
        rounds = np.arange(i, min(i + step, 2 * T))
        h = mix64(elements[None, :] + _SEEDS[rounds, None])
        bins = np.where(rounds[:, None] < T, (h >> np.uint64(32)) * np.uint64(T) >> np.uint64(32), np.uint64(0)).astype(np.int64)
        bins += np.maximum(rounds - T, 0)[:, None]
        np.minimum.at(out, bins.ravel(), (rounds.astype(np.uint64)[:, None] << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))).ravel())
        if out.max() >> np.uint64(32) < np.uint64(2 * T):
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One key for each band; the band's number is part of it, so a key alone names a bucket."""
    grid, key = coordinates.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * _GOLD + grid[:, j])
    return key


SKETCHED = StructType([StructField(n, LongType()) for n in ("n_shingles", "set_a", "set_b")] + [StructField("bands", ArrayType(LongType()))])


def sketched(df: DataFrame, words: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, the size of the set, two independent 64-bit sums that name it, and its band keys (none for an empty set)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sizes, a, b, keys = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column(text), words):
                    sizes.append(len(s))
                    a.append(mix64(s).sum(dtype=np.uint64))
                    b.append(mix64(s ^ _GOLD).sum(dtype=np.uint64))
                    keys.append(band_keys(sketch(s)) if len(s) else s)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            return {"n_shingles": pa.array(sizes, pa.int64()), "set_a": signed(a), "set_b": signed(b), "bands": lists(np.concatenate(keys).view(np.int64), [len(k) for k in keys], pa.int64())}

        return work

    return arrow_pass(df, text, df.columns if keep is None else keep, SKETCHED, make)


def with_sets(df: DataFrame, words: int, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and the set's shingle hashes."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = list(shingle_sets(batch.column(text), words))
            return {"shingles": lists(np.concatenate(sets).view(np.int64), [len(s) for s in sets], pa.int64())}

        return work

    return arrow_pass(df, text, keep, StructType([StructField("shingles", ArrayType(LongType()))]), make)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node reachable.  Alternates large-star and small-star rounds (Kiveris and others,
    "Connected Components in MapReduce and Beyond", 2014), each written to the shared folder; nodes keep their degree out of memory."""
    now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    mark = None
    k = 0
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        k += 1
        now = scratch.table(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("i") >= similar * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b").distinct()


def _block_links(key: tuple, rows: pd.DataFrame, similar: int) -> pd.DataFrame:
    """The links of one block between rows of the first side and all rows, as pairs of components, each pair of components once."""
    sets = [np.asarray(s, np.int64) for s in rows["shingles"]]
    comp, first = rows["comp"].to_numpy(), rows["side"].to_numpy() == 0
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = set()
    for x in np.flatnonzero(first):
        lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        linked = (100 * both >= similar * (sizes + sizes[x] - both)) & (comp != comp[x])
        found |= {(max(comp[x], c), min(comp[x], c)) for c in np.unique(comp[linked])}
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def near_duplicates(df: DataFrame, words: int = 5, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (doc_id = component_id) of every row.  scratch: where
    intermediate tables go, for a caller that drops them."""
    own, scratch = scratch is None, scratch or Scratch(df.sparkSession, "near")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = scratch.table(sketched(docs, words, keep=["doc_id"]), "sketched")
    name = ["n_shingles", "set_a", "set_b"]
    # One node for each distinct set; its copies stay out of everything that follows.
    nodes = known.where("n_shingles > 0").groupBy(*name).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = scratch.table(nodes, "nodes")
    rows = nodes.where("node IS NOT NULL").select("node", F.explode("bands").alias("key"))
    # Bucket totals are written before they are joined back: both sides are then dealt out for the join alone, and a bucket of many rows can be split.
    shared = scratch.table(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("low")).where("m > 1"), "shared")
    met = scratch.table(rows.join(shared, "key"), "met")
    ids = met.select("node").distinct()
    sets = scratch.table(with_sets(docs.join(ids, docs["doc_id"] == ids["node"]).select("node", "text"), words, "text", ["node"]), "sets")

    # (1) each node with the smallest that it meets
    nearest = scratch.table(met.groupBy("node").agg(F.min("low").alias("b")).where("node <> b").withColumnRenamed("node", "a"), "nearest")
    comp = components(_confirmed(nearest, sets, similar), scratch, "first")
    sizes = nodes.groupBy("node").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))  # one size, unless a doc_id has several texts
    comp = scratch.table(ids.join(comp, "node", "left").join(sizes, "node").select("node", F.coalesce("root", "node").alias("comp"), "least", "most"), "comp1")

    # (2) all pairs of small buckets, and each node with the smallest of each of its buckets
    close = (F.col("na.most") * 100 >= F.col("nb.least") * similar) & (F.col("nb.most") * 100 >= F.col("na.least") * similar)
    labelled = met.join(comp, "node")
    labelled = scratch.table(labelled, "labelled")
    several = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    mixed = scratch.table(labelled.join(scratch.table(several, "several"), "key"), "mixed")
    small = mixed.where(f"m <= {SMALL}")
    x = small.select("key", F.col("node").alias("a"), F.struct("least", "most").alias("na"), F.col("comp").alias("ca"))
    y = small.select("key", F.col("node").alias("b"), F.struct("least", "most").alias("nb"), F.col("comp").alias("cb"))
    within = x.join(y, "key").where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & close).select("a", "b").distinct()
    other = comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    stars = mixed.where(f"m > {SMALL} AND node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"), F.col("comp").alias("ca")).distinct()
    stars = stars.join(other, "b").where("ca <> cb").select("a", "b")
    pairs = within.union(stars).distinct().join(nearest, ["a", "b"], "left_anti")
    comp = _joined(comp, _confirmed(pairs, sets, similar), scratch, "second")

    # (3) large buckets that still hold several components, in blocks
    # Of buckets with the same members one is enough, and a block holds a bounded number of shingles, so that sets of any size fit.
    large = mixed.where(f"m > {SMALL}").select("key", "node", "most")
    same = large.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("node", F.lit(7)).cast("decimal(38,0)")).alias("b"))
    large = large.join(same.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key"), "key").join(comp, "node")
    by_comp = large.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("most").alias("s"))
    shape = by_comp.groupBy("key").agg(F.sum("k").alias("all"), F.sum("s").alias("size"), F.max(F.struct("k", "comp", "s")).alias("main")).where("all > main.k")
    parts = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))
    shape = shape.select("key", F.col("main.comp").alias("main"), parts(F.col("all") - F.col("main.k"), F.col("size") - F.col("main.s")).alias("firsts"), parts(F.col("all"), F.col("size")).alias("seconds"))
    shape = scratch.table(shape, "shape")
    part = large.drop("most").join(shape, "key")
    spread = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    outside = part.where("comp <> main").select("key", "node", "comp", F.lit(0).alias("side"), spread(1, "firsts").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("seconds") - 1)).alias("j"))
    whole = part.select("key", "node", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("firsts") - 1)).alias("i"), spread(2, "seconds").alias("j"))
    blocks = outside.union(whole).join(sets, "node")
    links = blocks.groupBy("key", "i", "j").applyInPandas(lambda k, p: _block_links(k, p, similar), "a bigint, b bigint").distinct()
    comp = _joined(comp, links, scratch, "third", contracted=True)

    found = nodes.select(*name, "node").join(comp, "node", "left").select(*name, F.coalesce("comp", "node").alias("component"))
    if own:
        scratch.only("sketched", "nodes", "comp-third")
    out = known.drop("bands").join(found, name, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def one_of_each(df: DataFrame, words: int = 5, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near copies: of each group of linked rows the one with the smallest id stays (a null id last).  Rows are told apart by
    themselves, so repeated rows, equal ids with different texts and null ids are each judged by their text; texts without words all stay."""
    row = fresh(df.columns, "_row")
    scratch = Scratch(df.sparkSession, "copies")
    rows = scratch.table(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(row, F.col(text_col)), words, similar, row, text_col, scratch)
    ids = found.select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, F.col(id_col).alias("_id")), row)
    # A large component meets in no task: its least row is found by partial minima, and the other rows are told by their own numbers.
    stays = ids.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", row)).alias("s")).select(F.col(f"s.{row}").alias(row))
    gone = scratch.table(ids.select(row).join(stays, row, "left_anti"), "gone")
    scratch.only("rows", "gone")
    return rows.join(gone, row, "left_anti").select(*df.columns)


def _joined(comp: DataFrame, links: DataFrame, scratch: Scratch, name: str, contracted: bool = False) -> DataFrame:
    """The components (node, comp) after more links, between nodes or, if contracted, between components."""
    if not contracted:
        a, b = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        links = links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(links, scratch, name).select(F.col("node").alias("comp"), "root")
    return scratch.table(comp.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), f"comp-{name}")
