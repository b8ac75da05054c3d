"""Nearest vectors for many queries at once: matrix products of blocks, in all cells or in those of an inverted file.

Rows are assigned to cells around centres that are fitted on a bounded sample; a query looks into its nearest cells and compares every vector there exactly.
A cell has a radius, the largest angle between its centre and a vector in it, so the nearest a cell can hold is known: `complete` looks into every further cell
that could still hold one of a query's k nearest, which makes the answer exact at the cost of those cells.  Cells of many rows or many queries are cut into
blocks, so no task grows with a cell.  Null and zero vectors have no direction and are in no answer."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.operators import staging

BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024
#: Rows that centres are fitted on, rounds of fitting, and the most centres there are.
SAMPLE, ROUNDS, MOST_CENTRES = 20_000, 8, 4_096
FOUND = "query_id long, id long, similarity double"
#: Similarities are compared to so many decimals, so that the order of summing does not decide ties.
DECIMALS = 12


@dataclass(frozen=True)
class Index:
    """Rows (id, vector, cell) with the centres of the cells, one row of `centres` each."""

    rows: DataFrame
    centres: np.ndarray


def units(vectors: pd.Series) -> np.ndarray:
    """Rows of length one."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def with_direction(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)))


def fitted(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n centres of unit vectors, by rounds of assigning and averaging from evenly spread starts."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        for c in range(n):
            inside = sample[nearest == c].sum(axis=0)
            length = np.linalg.norm(inside)
            if length > 0:
                centres[c] = inside / length
    return centres


def indexed(rows: DataFrame, n_centres: int | None = None) -> Index:
    """An index of all rows (id, vector); the number of cells grows with the root of theirs."""
    rows = with_direction(rows.select(F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("vector")))
    n = n_centres or min(MOST_CENTRES, max(1, math.isqrt(rows.count())))
    # At most SAMPLE vectors, the same ones in each run.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    centres = fitted(units(sample), min(n, len(sample))) if len(sample) else np.empty((0, 0))
    cells = rows.withColumn("cell", nearest_cells(F.col("vector"), centres, 1)[0])
    return Index(staging.written(cells, "cells"), centres)


def nearest_cells(vector: Column, centres: np.ndarray, n: int) -> Column:
    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors) or not len(centres):
            return pd.Series([[]] * len(vectors), dtype=object)
        near = np.argsort(-(units(vectors) @ centres.T), axis=1, kind="stable")[:, :n]
        return pd.Series([list(map(int, row)) for row in near])

    return cells(vector)


def further_cells(vector: Column, seen: Column, least: Column, centres: np.ndarray, cosines: np.ndarray) -> Column:
    """Cells that a query has not seen and that may hold a vector at least as similar; cosines: that of each cell's radius."""
    radius = np.arccos(np.clip(cosines, -1, 1))

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series, looked: pd.Series, enough: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        angle = np.arccos(np.clip(units(vectors) @ centres.T, -1, 1)) - radius
        best = (1 + np.cos(np.maximum(angle, 0))) / 2 + 1e-9
        return pd.Series([[c for c in np.flatnonzero(b >= e).tolist() if c not in set(s)] for b, s, e in zip(best, looked, enough, strict=True)])

    return cells(vector, seen, least)


def compared(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, similarity (0 to 1) of the k most similar rows (id, vector, cell) of each block to each query (query_id, vector, cell)."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    asked = queries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))
    cells = F.broadcast(staging.written(sizes.join(asked, "cell"), "blocks"))  # at most MOST_CENTRES rows
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    left = rows.join(cells, "cell").select("cell", own("id", "parts").alias("part"), numbers("blocks").alias("block"), "id", "vector")
    right = queries.join(cells, "cell").select("cell", numbers("parts").alias("part"), own("query_id", "blocks").alias("block"), "query_id", "vector")

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []}).astype({"query_id": "int64", "id": "int64"})
        ids = a["id"].to_numpy()
        similar = np.round((1 + units(b["vector"]) @ units(a["vector"]).T) / 2, DECIMALS)
        # The k best by similarity, then by id.
        best = np.lexsort((np.broadcast_to(ids, similar.shape), -similar), axis=1)[:, :k]
        return pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "similarity": np.take_along_axis(similar, best, axis=1).ravel()})

    keys = ["cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def nearest(index: Index, queries: DataFrame, k: int = 20, probes: int = 8, complete: bool = False) -> DataFrame:
    """query_id, id, similarity, place of the k rows of the index that are most similar to each query (query_id, vector).

    Where vectors lie in groups, a few cells hold nearly all; where they point anywhere, most cells must be looked into, and `complete` does so."""
    asked = with_direction(queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector")))
    asked = staging.written(asked.withColumn("cells", nearest_cells(F.col("vector"), index.centres, probes)), "queries")
    found = compared(index.rows, asked.select("query_id", "vector", F.explode("cells").alias("cell")), k)
    if not complete:
        return first(found, k)
    found = staging.written(first(found, k).select("query_id", "id", "similarity"), "found")
    radii = index.rows.groupBy("cell").agg(F.min(cosine_to(F.col("vector"), F.col("cell"), index.centres)).alias("cosine")).collect()  # a row for each cell
    cosines = np.full(len(index.centres), 1.0)
    for r in radii:
        cosines[r.cell] = r.cosine
    # A query that has fewer than k answers looks into every cell.
    enough = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(0.0).alias("enough"))
    more = asked.join(enough, "query_id", "left").withColumn("enough", F.coalesce("enough", F.lit(0.0)))
    more = more.withColumn("more", further_cells(F.col("vector"), F.col("cells"), F.col("enough"), index.centres, cosines))
    more = staging.written(more.select("query_id", "vector", F.explode("more").alias("cell")), "further")
    return first(found.unionByName(compared(index.rows, more, k)), k)


def cosine_to(vector: Column, cell: Column, centres: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def cosine(vectors: pd.Series, cells: pd.Series) -> pd.Series:
        return pd.Series((units(vectors) * centres[cells.to_numpy()]).sum(axis=1)) if len(vectors) else pd.Series([], dtype=float)

    return cosine(vector, cell)


def nearest_exact(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The same by comparing all rows with all queries, block by block."""
    rows = with_direction(rows.select(F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))).withColumn("cell", F.lit(0))
    asked = with_direction(queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))).withColumn("cell", F.lit(0))
    return first(compared(rows, asked, k), k)
