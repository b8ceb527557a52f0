"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one vector kept per group.

Centroids are fitted on a bounded, hashed sample (SAMPLE vectors at most, about) of the distinct
directions; every vector is assigned. A pair that is linked may lie on two sides of a cell's border,
so a vector also visits each cell of a lower number whose border with its own is nearer than
`margin`. The pair's difference has length sqrt(2 - 2 cos) at most; a margin of that length, the
default, finds every pair.

Members of a cell are dealt to blocks of about BLOCK vectors; each pair of blocks is one matrix
product in one task, of which only each vector's number of links and one tie to its group within
the two blocks leave the task: a group's links are counted, never listed. Equal vectors are one class
throughout. A label of n vectors has sqrt(n) / 4 cells at least, and as many as keep its cells at about
PER_CELL members (the largest label decides, MOST_CELLS at most). A vector without near neighbours
visits more cells the more there are: with 64 dimensions and random directions about 22 of 195.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, stored
from .components import connected_components

SAMPLE = 40_000
PER_CELL = 1024
MOST_CELLS = 4096
BLOCK = 1024


def cells_for(members: int, per_cell: int) -> int:
    """How many cells a label with so many vectors is cut into."""
    return min(MOST_CELLS, max(1, math.ceil(members / per_cell), math.ceil(math.sqrt(members) / 4)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centroids of the unit rows of x; an empty cell keeps its old centroid."""
    rng = np.random.default_rng(seed)
    cents = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[i : i + 4096] @ cents.T, axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        cells, starts = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        norms = np.sqrt((sums * sums).sum(axis=1))
        good = norms > 0
        cents[cells[good]] = sums[good] / norms[good, None]
    return cents


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    margin: float | None = None,
    sample: int = SAMPLE,
    per_cell: int = PER_CELL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors.

    Rows are compared when their labels are equal and not null (label_col None: all of them), by
    cosine in double precision. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without an id, link with nothing: 0 links, their own id as component, kept
    (without an id: null and not kept). Equal vectors of one label link with each other; repeated
    rows count as vectors of their own. Vectors of different lengths never link. Other columns are
    left out; an empty table gives no rows.
    """
    margin = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6 if margin is None else margin
    label = F.lit(0).cast("string") if label_col is None else F.col(f"`{label_col}`").cast("string")
    rows = columns(vectors.withColumn("__label", label), (id_col, "vec_id", "long"), (vector_col, "v", "array<double>"), ("__label", "label", "string"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    usable = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (size > 0) & (size < float("inf"))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable, F.lit(False))
    rows = stored(rows.withColumn("fit", fit).withColumn("v", F.when(F.col("fit"), F.transform("v", lambda x: x + F.lit(0.0)))), "vectors")
    classes = stored(rows.where("fit").groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")), "classes")

    ties = stored(_links(classes, threshold, margin, sample, per_cell), "links")
    counts = ties.groupBy("cid").agg(F.sum("n").alias("others"))
    roots = connected_components(ties, "cid", "rep").select(F.col("node").alias("cid"), "component")
    named = classes.join(counts, "cid", "left").join(roots, "cid", "left").select(
        F.col("label").alias("l2"), F.col("v").alias("v2"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id")
    )
    linked = rows.where("fit").join(named, (F.col("label") == F.col("l2")) & (F.col("v") == F.col("v2"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, threshold: float, margin: float, sample: int, per_cell: int) -> DataFrame:
    """(cid, rep, n): for blocks of vectors of one label, how many vectors in them (copies counted) each class is linked with, and a class it is connected to."""
    spark = classes.sparkSession
    per_label = classes.groupBy(F.size("v").alias("d"), "label").agg(F.count("*").alias("n"))
    per_dim = {r["d"]: (r["n"], r["most"]) for r in per_label.groupBy("d").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    found = None
    for dim, (n, most) in sorted(per_dim.items()):
        part = classes.where(F.size("v") == dim)
        share = min(1.0, sample / n)
        picked = part.where(F.pmod(F.xxhash64("v", "label"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").toArrow()
        x = _matrix(picked.column("v").combine_chunks(), dim) if picked.num_rows else np.eye(1, dim)
        x = x[np.lexsort(x.T[:4])] if len(x) else x
        cents = spherical_kmeans(_unit(x), min(cells_for(most, per_cell), len(x)))
        one = _links_of(part, spark.sparkContext.broadcast(cents), dim, threshold, margin)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], TIES)


TIES = "cid long, rep long, n long"


def _groups(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The smallest node connected to each of `size` nodes by the edges (i, j)."""
    low = np.arange(size)
    while True:
        least = np.minimum(low[i], low[j])
        after = low.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if np.array_equal(after, low):
            return low
        low = after


def linked_in_blocks(x: np.ndarray, y: np.ndarray | None, hx: np.ndarray, hy: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit rows x and y (None: of x with itself): how many copies each is linked with, x first, and the smallest row each is connected to.

    A pair counts where one of the two is at home. A cosine within 1e-9 of the threshold is summed exactly.
    """
    same = y is None
    other = x if same else y
    dots = x @ other.T
    linked = (dots >= threshold) & (hx[:, None] | hy[None, :])
    for a, b in zip(*np.nonzero((np.abs(dots - threshold) < 1e-9) & (hx[:, None] | hy[None, :]))):
        linked[a, b] = math.fsum(x[a] * other[b]) >= threshold
    if same:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    if same:
        return linked @ nx, _groups(i, j, len(x))
    return np.concatenate([linked @ ny, linked.T @ nx]), _groups(i, len(x) + j, len(x) + len(y))


def _links_of(part: DataFrame, shared, dim: int, threshold: float, margin: float) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = shared.value
        gap = np.sqrt(np.maximum(0, 2 - 2 * cents @ cents.T))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                dots = _unit(_matrix(s.column("v"), dim)) @ cents.T
                home = np.argmax(dots, axis=1)
                best = dots[np.arange(len(home)), home]
                near = best[:, None] - dots <= (margin + 1e-9) * gap[home]
                near &= np.arange(len(cents))[None, :] < home[:, None]
                near[np.arange(len(home)), home] = True
                row, cell = np.nonzero(near)
                took = s.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [took.column("cid"), took.column("label"), took.column("v"), took.column("copies"), pa.array(cell.astype(np.int32)), pa.array(cell == home[row])], ["cid", "label", "v", "copies", "cell", "home"]
                )

    kinds = "cid long, label string, v array<double>, copies long, cell int, home boolean"
    placed = stored(part.select("cid", "label", "v", "copies").mapInArrow(assign, kinds), "cells")
    sizes = placed.groupBy("label", "cell").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m")
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = placed.join(sizes, ["label", "cell"]).withColumn("block", block)
    both = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"low": F.least("block", "with"), "high": F.greatest("block", "with")}
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = key[2], key[3]
        sides = [rows] if low == high else [rows[rows["block"] == low], rows[rows["block"] == high]]
        v = [_unit(np.array(r["v"].tolist(), np.float64).reshape(-1, dim)) for r in sides]
        home = [r["home"].to_numpy(bool) for r in sides]
        copies = [r["copies"].to_numpy(np.int64) for r in sides]
        n, low_of = linked_in_blocks(v[0], v[1] if len(v) > 1 else None, home[0], home[-1], copies[0], copies[-1], threshold)
        cid = np.concatenate([r["cid"].to_numpy(np.int64) for r in sides])
        some = n > 0
        return pd.DataFrame({"cid": cid[some], "rep": cid[low_of][some], "n": n[some]})

    return both.groupBy("label", "cell", "low", "high").applyInPandas(compare, TIES)
