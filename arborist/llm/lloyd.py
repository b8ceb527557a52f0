"""Centroid clustering by delta Lloyd: every round does only what the round before it has changed.

Vectors become integers, so that sums, means (floored) and distances are exact and do not depend on the
order of rows. The state - each vector with its owner and its squared distance to it - is written to
shared storage after each round, and the sums of the clusters stay with the driver (k x (dim + 1) whole
numbers). A round

* compares a vector whose owner stayed where it was with the centroids that moved only: all others are
  no nearer than they were, and the stored distance stands for the owner;
* compares a vector whose owner moved with all centroids;
* adds to the sums nothing but transfers: a vector that changed hands counts -1 times for the cluster it
  left and once for the one it joined. Tasks add these up before anything is shuffled.

No vector meets another one, so nothing is dealt by cluster and a hot cluster costs nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, forget, stored

DIM, SCALE = 64, 64
K, ROUNDS = 16, 3
SLICE = 16_384
STATE = "vec_id long, v array<int>, owner int, was int, distance long"


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for vectors of `dim` components none of which is null or not finite.

    Components so large that squared distances would not fit a long (beyond about 10^8) are an error, never rounded.
    """
    most = math.isqrt((1 << 61) // dim)
    rows = columns(vectors, (id_col, "vec_id", "long"), (vector_col, "x", "array<double>"))
    usable = (F.size("x") == dim) & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("x", lambda x: F.when(F.abs(x * scale) < most, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for whole distances"))).cast("int"))
    return rows.where(F.coalesce(usable, F.lit(False))).select("vec_id", whole.alias("v"))


def squared_distances(x: np.ndarray, cents: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: as products of doubles where all sums stay below 2^53, else as whole numbers."""
    most = int(max(np.abs(x).max(initial=0), np.abs(cents).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), cents.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in cents], axis=1)


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, cents: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances after the centroids marked in `moved` have moved; owner -1: none so far."""
    owner, distance = owner.copy(), distance.copy()
    anew = (owner < 0) | moved[owner]
    if anew.any():
        d = squared_distances(x[anew], cents)
        owner[anew] = d.argmin(1)
        distance[anew] = d.min(1)
    rest = np.flatnonzero(~anew)
    some = np.flatnonzero(moved)
    if len(rest) and len(some):
        d = squared_distances(x[rest], cents[some])
        rival, near = some[d.argmin(1)], d.min(1)
        wins = (near < distance[rest]) | ((near == distance[rest]) & (rival < owner[rest]))
        owner[rest[wins]], distance[rest[wins]] = rival[wins], near[wins]
    return owner, distance


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _round(state: DataFrame, cents: np.ndarray, moved: np.ndarray) -> DataFrame:
    dim = cents.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                was = b.column("owner").to_numpy()
                owner, distance = reassign(_rows(b.column("v"), dim), was, b.column("distance").to_numpy(), cents, moved)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(owner, pa.int32()), pa.array(was, pa.int32()), pa.array(distance)], ["vec_id", "v", "owner", "was", "distance"])

    return state.mapInArrow(work, STATE)


def _transfers(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """k x (1 + dim) whole numbers: how the number of members and the sums of each cluster change."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1 + dim), np.int64)
        for b in batches:
            x = np.concatenate([np.ones((b.num_rows, 1), np.int64), _rows(b.column("v"), dim)], axis=1)
            for side, sign in (("owner", 1), ("was", -1)):
                who = b.column(side).to_numpy()
                order = np.argsort(who, kind="stable")
                at, first = np.unique(who[order], return_index=True)
                if len(at):
                    sums = np.add.reduceat(x[order], first, axis=0)
                    total[at[at >= 0]] += sign * sums[at >= 0]
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "change"])

    parts = state.where("was <> owner").select("v", "owner", "was").mapInArrow(work, "cluster int, change array<long>")
    sums = parts.select("cluster", F.posexplode("change")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    out = np.zeros((k, 1 + dim), object)
    for r in sums.collect():  # k * (1 + dim) rows at most
        out[r.cluster, r.pos] = int(r.s)
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, distance) for each usable vector, the final centroids as a k x dim matrix).

    Starts from the k vectors with the smallest SHA-256 of "<seed>:<vec_id>" (a null id counts as the
    empty text, equal ids by their components); fewer vectors make fewer centroids. Each round gives
    every vector to its nearest centroid (ties: the smaller number) and puts each centroid that has
    members at their floored mean; then vectors are assigned once more. Stops early where no centroid
    moves. Vectors that are null, of another length or hold null or non-finite components are left
    out, repeated rows count each, other columns are left out; no usable vector gives no rows.
    """
    kept = integer_vectors(vectors, dim, scale, id_col, vector_col)
    state = stored(kept.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(-1).alias("was"), F.lit(0).cast("long").alias("distance")), "lloyd")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select("v", key.alias("h")).orderBy("h", "v").limit(k).collect()
    cents = np.array([r.v for r in first], np.int64).reshape(-1, dim)
    if not len(cents):
        return state.select("vec_id", "v", F.col("owner").alias("cluster"), "distance"), cents
    sums = np.zeros((len(cents), 1 + dim), object)
    moved = np.ones(len(cents), bool)
    for r in range(rounds + 1):
        after = stored(_round(state, cents, moved), "lloyd")
        forget(state)
        state = after
        if r == rounds:
            break
        sums += _transfers(state, len(cents), dim)
        now = cents.copy()
        full = np.flatnonzero(sums[:, 0])
        now[full] = (sums[full, 1:] // sums[full, :1]).astype(np.int64)
        moved = (now != cents).any(1)
        cents = now
        if not moved.any():
            break
    return state.select("vec_id", "v", F.col("owner").alias("cluster"), "distance"), cents


def clusters_with_inertia(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each usable vector; see cluster()."""
    rows, cents = cluster(vectors, k, rounds, id_col=id_col, vector_col=vector_col)
    spark = vectors.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(cents.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = each.agg(F.sum("cluster_inertia").alias("inertia"))
    summary = named.join(each, "cluster").crossJoin(F.broadcast(whole))  # k rows and one
    return rows.join(F.broadcast(summary), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
