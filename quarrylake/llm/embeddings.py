"""Embedding near-dedup: spherical k-means cells, blocked cosines, one kept per group.

Equal vectors become one class. Centroids are fitted on a bounded, seeded sample; every
class is then assigned to its nearest cell and also probes the cells whose centroid
is almost as near. Within a cell, its own members are compared with its own and its
probing ones in blocks of a matrix product, in double precision. A probing list tells
each task whether another cell sees the same pair, so each link is counted once.

Recall: a pair is missed only if neither vector probes the other's cell; the margin
is wide enough that this is rare (tests measure recall against brute force; 0.9 is
the promise, about 1.0 the measurement). No partner is capped.

Scale: the number of cells follows the number of classes, a cell larger than a block
is dealt out as pairs of blocks, and tasks return link counts and a spanning forest,
never their pairs. The driver gets the sample and the centroids, both bounded.

Null vectors, zero vectors, vectors with null or non-finite components, and rows
with a null id link with nothing: n_links 0, themselves their component, kept.
Vectors of different lengths link with nothing of each other; each length has cells of
its own. Repeated rows count as one vector of that id: their copies link with each other as any equal
vectors do. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, links

THRESHOLD = 0.9
#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Classes a cell is meant to hold, and cells at most (the centroids are broadcast).
CELL, MAX_CELLS = 256, 4_096
#: A cell is probed if its centroid's cosine is within this of the nearest one's.
MARGIN = 0.1
#: Rows of a block within a cell.
BLOCK = 1_024
SEED = 11


def fit_centroids(sample: np.ndarray, k: int, seed: int = SEED, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids by repeated assignment and normalised means."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        lost = norms < 1e-12
        sums[lost], norms[lost] = sample[rng.choice(len(sample), int(lost.sum()))], 1.0
        centres = sums / norms[:, None]
    return centres


def units(vectors: list) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = np.array(vectors, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(v) -> bool:
    if v is None or not len(v) or any(x is None for x in v):
        return False
    a = np.asarray(v, np.float64)
    return bool(np.isfinite(a).all() and 0 < np.linalg.norm(a) < np.inf)


def _keyed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, node (digest of a usable vector's components, else null) and the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            nodes = [hashlib.blake2b((np.asarray(v, np.float64) + 0.0).tobytes(), digest_size=16).digest() if _usable(v) else None for v in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array([v if n else None for v, n in zip(rows, nodes, strict=True)], pa.list_(pa.float64()))], names=["id", "node", "vector"])

    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("node", T.BinaryType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return df.select(F.col(key), F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def _assign(classes: DataFrame, centres: dict[int, tuple[int, np.ndarray]], margin: float) -> DataFrame:
    """A row for each class and cell that it lives in (home) or probes. ``centres`` has,
    for each length of vectors, the number of its first cell and its centroids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["vector"].map(len).to_numpy()
            for width in np.unique(lengths):
                b = batch[lengths == width]
                first, own = centres[int(width)]
                x = units(b["vector"].tolist())
                near = x @ own.T
                home = near.argmax(axis=1)
                probed = near >= near.max(axis=1, keepdims=True) - margin
                row, cell = np.nonzero(probed)
                cells = [(first + np.flatnonzero(p)).astype(np.int32) for p in probed]
                yield pd.DataFrame({"cell": (first + cell).astype(np.int32), "home": (first + home[row]).astype(np.int32), "id": b["id"].to_numpy()[row], "n": b["n"].to_numpy()[row], "cells": [cells[i] for i in row], "vector": [x[i] for i in row]})

    return classes.select("id", "n", "vector").mapInPandas(run, T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("home", T.IntegerType()), T.StructField("id", classes.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of n points."""
    parent, out = list(range(n)), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(i), top(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def _compare(threshold: float, id_type: T.DataType):
    """Compares one block of home members with one block of all members of a cell."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        out: dict[str, list] = {"id": [], "links": [], "a": [], "b": []}
        if len(left) and len(right):
            x, y = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy())
            i, j = np.nonzero(x @ y.T >= threshold)
            ids_l, ids_r = left["id"].to_numpy(), right["id"].to_numpy()
            keep = ids_l[i] < ids_r[j]
            back = np.flatnonzero(ids_l[i] > ids_r[j])
            cells, homes = left["cells"].to_numpy(), right["home"].to_numpy()
            keep[back] = [homes[j[t]] not in cells[i[t]] for t in back]
            i, j = i[keep], j[keep]
            n_l, n_r = left["n"].to_numpy(), right["n"].to_numpy()
            counts = pd.concat([pd.Series(n_r[j], index=ids_l[i]), pd.Series(n_l[i], index=ids_r[j])]).groupby(level=0).sum()
            pool, at = np.unique(np.concatenate([ids_l[i], ids_r[j]]), return_inverse=True)
            tree = forest(len(pool), at[: len(i)], at[len(i) :])
            for k, v in counts.items():
                out["id"].append(k), out["links"].append(v), out["a"].append(None), out["b"].append(None)
            for p, q in tree:
                out["id"].append(None), out["links"].append(0), out["a"].append(pool[p]), out["b"].append(pool[q])
        kind = "Int64" if isinstance(id_type, (T.LongType, T.IntegerType, T.ShortType)) else object
        return pd.DataFrame({k: pd.Series(v, dtype="int64" if k == "links" else kind) for k, v in out.items()})

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, margin: float = MARGIN, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The operator: key, n_links, component_id and kept for every row."""
    id_type = df.schema[key].dataType
    keyed = common.materialize(_keyed(df, key, vector), "vectors")
    real = keyed.where("id is not null and node is not null")
    classes = common.materialize(real.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")), "classes")
    sizes = {r["width"]: r["count"] for r in classes.groupBy(F.size("vector").alias("width")).count().collect()}  # a row a length
    picked = [r["vector"] for r in common.seeded_sample(classes, "node", sample, seed).select("vector").collect()]
    centres: dict[int, tuple[int, np.ndarray]] = {}
    cells = 0
    for width, n in sorted(sizes.items()):
        own = [v for v in picked if len(v) == width]  # a length that the sample lacks is one cell
        centres[width] = cells, fit_centroids(units(own), min(MAX_CELLS, n // CELL + 1), seed) if own else np.zeros((1, width))
        cells += len(centres[width][1])
    assigned = common.materialize(_assign(classes, centres, margin), "assigned")
    # Blocks: home members against all members of the cell, dealt out by hash.
    per_cell = assigned.groupBy("cell").agg(F.count("*").alias("all"), F.count(F.when(F.col("home") == F.col("cell"), 1)).alias("own"))
    blocks = per_cell.select("cell", F.expr(f"(own + {BLOCK} - 1) div {BLOCK}").cast("int").alias("rows"), F.expr(f"(all + {BLOCK} - 1) div {BLOCK}").cast("int").alias("columns")).where("rows > 0")
    dealt = assigned.join(F.broadcast(blocks) if cells <= 8 * MAX_CELLS else blocks, "cell")
    place = F.xxhash64("id", F.lit(seed + 1))
    left = dealt.where("home = cell").withColumn("i", F.pmod(place, F.col("rows")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("side", F.lit(0))
    right = dealt.withColumn("j", F.pmod(place, F.col("columns")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("side", F.lit(1))
    columns = ["cell", "i", "j", "side", "id", "n", "home", "cells", "vector"]
    found = left.select(columns).unionByName(right.select(columns)).groupBy("cell", "i", "j").applyInPandas(_compare(threshold, id_type), T.StructType([T.StructField("id", id_type), T.StructField("links", T.LongType()), T.StructField("a", id_type), T.StructField("b", id_type)]))
    found = common.materialize(found, "found")
    counts = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links")).select(F.col("id").alias("head"), "links")
    groups = links.components(found.where("a is not null").select("a", "b")).select(F.col("node").alias("head"), "component")
    heads = classes.select("node", F.col("id").alias("head"), "n").join(counts, "head", "left").join(groups, "head", "left")
    heads = common.materialize(heads.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id")), "heads")
    out = keyed.select("id", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")).join(heads, "node", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def near_duplicates_sql(table: str, key: str = "vec_id", vector: str = "embedding") -> str:
    """The same for DuckDB, by comparing all pairs of usable vectors."""
    return f"""
with recursive v as (select {key} as id, {vector}::double[] as x from {table}),
usable as (select id, x, sqrt(list_inner_product(x, x)) as norm from v
           where len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and list_inner_product(x, x) > 0),
near as (select a.id as a, b.id as b from usable a join usable b on a.id < b.id where list_inner_product(a.x, b.x) / (a.norm * b.norm) >= {THRESHOLD}),
edges as (select a, b from near union all select b, a from near),
reach as (select id, id as other from v union select r.id, e.b from reach r join edges e on r.other = e.a),
least as (select id, min(other) as component_id from reach group by 1),
counts as (select a as id, count(*) as n from edges group by 1)
select l.id as {key}, coalesce(n, 0)::bigint as n_links, component_id, l.id = component_id as kept from least l left join counts c on c.id = l.id"""
