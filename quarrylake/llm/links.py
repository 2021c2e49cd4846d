"""Connected components, and components over shared keys, without emitting all pairs.

Links, labels and postings are tables in the shared folder, never collected. Iterations
are cut by written tables, so a lost executor repeats one step. Sides are broadcast only
after they are counted; links of no more counted bytes than that are grouped in one task,
all others stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Counted bytes of links up to which one task groups them all: steps of stars are dozens
#: of short stages, and take as long for a few links as for many.
ALONE_BYTES = common.BROADCAST_BYTES
#: Types of nodes whose order there is Spark's.
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BinaryType)
#: Rounds of leaders before what is left is compared pair by pair.
LEADER_ROUNDS = 6
#: Leaders of a key in a round.
LEADERS = 4
#: Pairs per posting up to which the rest is compared at once.
PAIRS_PER_POSTING = 2
#: Pairs per posting from which bits that have to be made are worth it.
MANY_PAIRS = 8
#: Share of the pairs that a slow round of leaders leaves.
SLOW = 0.75


def _only_stars(e: DataFrame) -> bool:
    """Whether every u of the links (u > v) hangs on one v that hangs on nothing."""
    tops = e.groupBy("u").agg(F.count("*").alias("n"))
    wrong = tops.where("n > 1").select("u").unionByName(e.select(F.col("v").alias("u")).join(tops.select("u"), "u", "left_semi"))
    return wrong.isEmpty()


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n points the least one that the links a, b lead to. Every round hangs
    each top to the least top beside it, and all points to their new tops."""
    top = np.arange(n)
    while len(a):
        a, b = top[a], top[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := top[top], top):
            top = up
    return top


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and component of all links (u, v) of the batches."""
    found = list(batches)
    if not found:
        return
    ends = pa.chunked_array([b.column(i) for i in range(2) for b in found])
    nodes = ends.unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    at = pc.index_in(ends, value_set=nodes).to_numpy()
    top = least_reached(at[: len(at) // 2], at[len(at) // 2 :], len(nodes))
    yield from pa.table([nodes, nodes.take(pa.array(top))], names=["node", "component"]).to_batches()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for all nodes of ``edges`` (a, b;
    written, or read from what is).

    Few links are grouped in one task. Otherwise large and small stars alternate: every
    step hangs a node's neighbours to the least of them, until each component is one star.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    kind = e.schema["u"].dataType
    if (isinstance(kind, ORDERED) or kind == T.StringType()) and common.small(edges, ALONE_BYTES):
        schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
        return e.coalesce(1).mapInArrow(lambda it: common.released(_grouped(it)), schema)
    e = common.materialize(e.distinct(), "edges")
    while not _only_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, e = e, common.materialize(small, "edges")
        common.discard(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def several(postings: DataFrame) -> DataFrame:
    """The postings whose key more than one of them has."""
    return postings.join(postings.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1").select("key"), "key")


def shared_key_components(postings: DataFrame, verify: Callable[[DataFrame], DataFrame], fit: Callable[[Column, Column], Column], rounds: int = LEADER_ROUNDS, sketch: tuple[DataFrame | Callable[[DataFrame], DataFrame], Callable[..., Column]] | None = None, per_posting: int = PAIRS_PER_POSTING, labels: DataFrame | None = None, slow: int = 0) -> DataFrame:
    """Components of the graph whose links are the pairs of nodes that share a key of
    ``postings`` (key, node, rank, size; written before, each row once), whose sizes
    ``fit`` each other, and which pass ``verify`` (pairs a, b in, links out).

    A pair within one component needs no check, so all members of a key are first
    held against a few leaders, the least by rank among the members of each salt;
    members that they did not draw in meet other leaders. Once few enough pairs remain
    they are all checked. Every pair that shares a key ends up checked or within one
    component: no link is lost, and a group of near copies costs about its size
    instead of its square.

    ``sketch`` has a table (node, bits) and a condition on two nodes' bits and sizes that
    every link meets; it thins out the pairs of the last step inside their join. Instead
    of the table it may have a function that makes it (written) for a table of nodes;
    that is only asked where many pairs are left, and thins out those of all steps from
    there. Where
    ``fit`` does so itself, ``per_posting`` may leave more of them to that step.
    ``labels`` are components (node, component; written) that are known already.
    Up to ``slow`` pairs per posting, a round of leaders that leaves more than SLOW of
    the pairs is the last one.
    """
    pairs_before, made = 0, None
    for i in range(0 if labels is None else 1, rounds + 1):
        if labels is None:
            rest, last, mixed = postings.withColumn("comp", F.col("node")), False, None
        else:
            named = postings.join(common.small_enough(labels), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
            sizes = named.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
            mixed = sizes.agg(F.count("*").alias("comps"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q")).where("comps > 1")
            mixed = common.materialize(mixed, "mixed")
            left = mixed.agg(F.sum("m").alias("m"), F.sum(F.expr("(m * m - q) div 2")).alias("pairs")).first()
            if not left["pairs"]:
                break
            rest = named.join(common.small_enough(mixed.select("key")), "key")
            enough = slow if 0 < SLOW * pairs_before < left["pairs"] else 0
            last, pairs_before = i == rounds or left["pairs"] <= max(per_posting, enough) * left["m"], left["pairs"]
        rest = rest.select("key", "node", "rank", "size", "comp")
        thin = sketch[0] if sketch and last else None
        if sketch and callable(sketch[0]):
            if not made and mixed and left["pairs"] > MANY_PAIRS * left["m"]:
                made = sketch[0](rest.select("node").distinct())  # later steps have no other nodes
            thin = made
        rest = rest.join(common.small_enough(thin), "node") if thin else rest
        if last:
            rest = rest if thin else rest.withColumn("bits", F.lit(None))
            one, other = (rest.select("key", *(F.col(c).alias(f"{c}_{n}") for c in ("node", "size", "comp", "bits"))) for n in "xy")
            alike = (F.col("node_x") < F.col("node_y")) & (F.col("comp_x") != F.col("comp_y")) & fit(F.col("size_x"), F.col("size_y"))
            if thin:
                alike = alike & sketch[1](*(F.col(c) for c in ("bits_x", "bits_y", "size_x", "size_y")))
            both = one.join(other, (one["key"] == other["key"]) & alike)
            pairs = _pairs(both.select(F.col("node_x").alias("x"), F.col("node_y").alias("y")))
        else:
            order = F.struct("rank", "node") if i == 0 else F.struct(F.xxhash64("node", F.lit(i)), "node")
            salted = rest.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(-1 - i)), F.lit(LEADERS)))
            heads = salted.groupBy("key", "salt").agg(F.min_by(F.struct("node", "comp", "size", *(["bits"] if thin else [])), order).alias("head")).select("key", "head")
            alike = (F.col("comp") != F.col("head.comp")) & fit(F.col("size"), F.col("head.size"))
            if thin:
                alike = alike & sketch[1](*(F.col(c) for c in ("bits", "head.bits", "size", "head.size")))
            both = rest.join(heads, "key").where(alike)
            pairs = _pairs(both.select(F.col("node").alias("x"), F.col("head.node").alias("y")))
        found = verify(pairs)
        found = found if hasattr(found, "_written_to") else common.materialize(found.select("a", "b"), "links")
        common.discard(mixed)
        if labels is None or not found.isEmpty():
            before = [] if labels is None else [labels.select(F.col("node").alias("a"), F.col("component").alias("b"))]
            labels, old = common.materialize(components(reduce(DataFrame.unionByName, [found, *before])), "labels"), labels
            common.discard(old)
        common.discard(found)
        if last:
            break
    common.discard(made)
    return labels
