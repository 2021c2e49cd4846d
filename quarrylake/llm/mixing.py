"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (words) within each source. Each source's
target comes from its weight, limited to a multiple of its size. The whole part of
target / size is given to every document; for the rest, most of the budget is taken
evenly from every length, and what remains, now at most a fixed window, is fitted by
bounded-knapsack dynamic programming over the length counts. Documents of a length
are then chosen in the order of a seeded hash.

Scale: texts are read once for their sizes. What is shuffled is (source, size,
bucket) counts and narrow rows. A length of a hot source is cut into seeded buckets;
whole buckets are in or out, and only the one bucket at the border ranks its own
rows, so no task holds more than a bucket. The driver gets one row per source.

A null text has size 0. Null is a source of its own, last. Repeated rows count each;
ties of the hash go by document id. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Weights by the sources' order, repeated (the contract's values).
WEIGHTS = (5, 2, 1)
#: Most copies of a document, and the most a target may be of its source's size.
MAX_COPIES = 3
#: Words of budget that the dynamic programming fits.
WINDOW = 1 << 15
#: Seeded buckets that a length of a source is cut into.
BUCKETS = 1024
SEED = 20_240_601


def fit_targets(sizes: Sequence[int], weights: Sequence[float], cap: float = MAX_COPIES) -> list[float]:
    """Shares of the total by weight, each at most ``cap`` times its size; what is
    over a cap is shared again by weight until none is above."""
    targets, held = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = sum(sizes) - sum(cap * sizes[i] for i in held)
        whole = sum(weights[i] for i in free)
        for i in range(len(sizes)):
            targets[i] = float(cap * sizes[i]) if i in held else rest * weights[i] / whole
        over = {i for i in free if targets[i] > cap * sizes[i]}
        if not over:
            return targets
        held |= over


def choose_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their words come as close
    to ``budget`` as the window's dynamic programming can: never more than exist."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    budget = max(0, min(int(budget), total))
    if not total or not budget:
        return taken
    if budget == total:
        return counts.copy()
    if budget > window:  # evenly from every length
        taken = np.floor(counts * ((budget - window) / total)).astype(np.int64)
    left = budget - int((taken * lengths).sum())
    for i in np.random.default_rng(seed).permutation(len(lengths)):  # what rounding down has left
        if left <= window:
            break
        if lengths[i]:
            n = min(int(counts[i] - taken[i]), (left - window) // int(lengths[i]))
            taken[i] += n
            left -= n * int(lengths[i])
    return taken + knapsack(lengths, counts - taken, left, window)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, slack: int) -> np.ndarray:
    """Bounded knapsack: counts whose lengths' sum is nearest to ``budget`` (ties:
    the lower). ``first[s]`` is the first item that reached the sum s, so the way
    back needs one number a sum."""
    limit = int(budget + min(slack, int(lengths.max(initial=0))))
    reach = np.zeros(limit + 1, bool)
    reach[0], first = True, np.full(limit + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    usable = [i for i in range(len(lengths)) if 0 < lengths[i] <= limit and counts[i] > 0]
    unit = int(np.gcd.reduce(lengths[usable])) if usable else 1
    best = budget // unit * unit  # the nearest sum that can be
    best += unit if best + unit <= limit and best + unit - budget < budget - best else 0
    for i in usable:
        most, step = min(int(counts[i]), limit // int(lengths[i])), 1
        while most > 0 and not reach[best]:
            n = min(step, most)
            w = n * int(lengths[i])
            if w <= limit:
                fresh = np.flatnonzero(reach[: limit + 1 - w] & ~reach[w:]) + w
                first[fresh] = len(items)
                reach[fresh] = True
                items.append((i, n))
            most, step = most - n, step * 2
        if reach[best]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.lexsort((sums, np.abs(sums - budget)))[0]])
    out = np.zeros(len(lengths), np.int64)
    while at:
        i, n = items[first[at]]
        out[i] += n
        at -= n * int(lengths[i])
    return out


def _planner(seed: int, window: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = min(int(target // size), MAX_COPIES) if size else 0
        rest = round(target) - whole * size if whole < MAX_COPIES else 0
        rows["whole"] = whole
        rows["extra"] = choose_counts(rows["size"].to_numpy(), rows["n"].to_numpy(), rest, seed, window)
        return rows[["no_source", "source", "size", "whole", "extra"]]

    return plan


def _order(seed: int, key: str, text: str) -> Column:
    """A seeded place in the order of choice; rows that repeat an id with another text
    have places of their own."""
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, seed: int = SEED, buckets: int = BUCKETS, window: int = WINDOW) -> DataFrame:
    """The operator: key, size, source_size, target, copies, taken (= copies x size) and
    order (its seeded place) for every row of ``df``."""
    spark = df.sparkSession
    rows = df.select(
        F.col(key).alias("id"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        common.word_count(F.col(text)).alias("size"),
        _order(seed, key, text).alias("order"),
    ).withColumn("bucket", F.pmod("order", F.lit(buckets)).cast("int"))
    rows = common.materialize(rows, "mix-rows")
    group = ["no_source", "source", "size"]
    counts = rows.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    sources = sorted((r["no_source"], r["source"], r["size"]) for r in rows.groupBy("no_source", "source").agg(F.sum("size").alias("size")).collect())
    targets = fit_targets([s for *_, s in sources], [weights[i % len(weights)] for i in range(len(sources))])
    budget = spark.createDataFrame([(*s, t) for s, t in zip(sources, targets, strict=True)], "no_source boolean, source string, source_size long, target double")
    lengths = counts.groupBy(*group).agg(F.sum("n").alias("n")).join(common.small_enough(budget), ["no_source", "source"])
    plan = lengths.groupBy("no_source", "source").applyInPandas(_planner(seed, window), "no_source boolean, source string, size long, whole long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = (
        counts.join(plan, group)
        .withColumn("share", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - before)))
        .join(common.small_enough(budget), ["no_source", "source"])
        .select(*group, "bucket", "whole", "share", "source_size", "target")
    )
    rank = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy("order", "id"))
    copies = F.col("whole") + F.when(F.col("rank") <= F.col("share"), 1).otherwise(0)
    return (
        rows.withColumn("rank", rank)
        .join(share, [*group, "bucket"])
        .withColumn("copies", copies.cast("long"))
        .select(F.col("id").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "order")
    )


def apply(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, **options) -> DataFrame:
    """``df`` with each row as often as the mix takes it: rows are found by id and text,
    null ids too. Of rows equal in both each gets the most copies that one of them has."""
    names = [f"c{i}" for i in range(len(df.columns))]  # no name of theirs can clash
    at, own = df.columns.index(key), df.toDF(*names)
    rows = own.withColumn("order", _order(seed, names[at], names[df.columns.index(text)]))
    mixed = mix(df, key, text, seed=seed, **options).select(F.col(key).alias("id"), "copies", "order")
    copies = common.materialize(mixed.groupBy("id", "order").agg(F.max("copies").cast("int").alias("copies")), "copies")
    found = rows.join(common.small_enough(copies.withColumnRenamed("order", "place")), F.col(names[at]).eqNullSafe(F.col("id")) & (F.col("order") == F.col("place")))
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(names).toDF(*df.columns)
