"""Resampling of paired scores (key, a, b): bootstrap weights and sign flips drawn inside the tasks, of which only sums leave them.

A pair's draw in sample s follows from a hash of its key and s, so results do not depend on how rows are
dealt or on retries. Each task goes over its rows in blocks, draws a block of samples at a time and keeps three
sums a sample; those are what is shuffled: (number of tasks) x (number of samples) short rows, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, SAMPLES = 2048, 500
SUMS = "id int, w double, wd double, wd2 double"
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(keys: np.ndarray, first: int, count: int, seed: int) -> np.ndarray:
    """count x keys hashes of (key, sample)."""
    sample = mixed((np.arange(first, first + count, dtype=np.uint64) + np.uint64(1)) * GOLD + np.uint64(seed))
    return mixed(keys[None, :] ^ sample[:, None])


def poisson_weights(keys: np.ndarray, first: int, count: int, seed: int) -> np.ndarray:
    """Poisson(1) draws of the samples first, first + 1, ... for each key, by the inverse of the distribution function."""
    u = (_draws(keys, first, count, seed) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    out, at, p = np.zeros(u.shape), 0.0, np.exp(-1.0)
    for k in range(1, 13):
        at += p
        out += u >= at
        p /= k
    return out


def sign_flips(keys: np.ndarray, first: int, count: int, seed: int) -> np.ndarray:
    """+1 or -1 of the samples first, ... for each key: a bit a sample, 64 of a hash."""
    words = _draws(keys, first // 64, (first + count + 63) // 64 - first // 64, seed)
    bits = np.unpackbits(words.view(np.uint8).reshape(*words.shape, 8), axis=2, bitorder="little")
    flat = bits.transpose(0, 2, 1).reshape(-1, len(keys))
    return flat[first % 64 : first % 64 + count] * 2.0 - 1.0


def _sums(pairs: DataFrame, key: str, samples: int, draw, seed: int) -> DataFrame:
    """(id, w, wd, wd2): for each sample the sums of the draws, of draw x difference and of draw x difference squared."""
    rows = pairs.select(F.xxhash64(F.col(key).cast("string")).alias("k"), (F.col("a") - F.col("b")).cast("double").alias("d")).where("d is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((samples, 3)), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                keys, d = b.column("k").to_numpy().view(np.uint64), b.column("d").to_numpy()
                x, seen = np.stack([np.ones_like(d), d, d * d], axis=1), True
                for first in range(0, samples, SAMPLES):
                    count = min(SAMPLES, samples - first)
                    total[first : first + count] += draw(keys, first, count, seed) @ x
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples, dtype=np.int32)), *(pa.array(total[:, i]) for i in range(3))], ["id", "w", "wd", "wd2"])

    return rows.mapInArrow(work, SUMS).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("w", "wd", "wd2")])


def bootstrap(pairs: DataFrame, key: str, samples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: mean difference and d_z, each with its percentile interval; a pair's weight in a resample is a Poisson(1) draw."""
    each = _sums(pairs, key, samples, poisson_weights, seed).where("w > 0")
    m = F.col("wd") / F.col("w")
    var = F.greatest((F.col("wd2") - F.col("w") * m * m) / F.greatest(F.col("w") - 1, F.lit(1.0)), F.lit(0.0))
    each = each.select(m.alias("m"), F.when(var > 0, m / F.sqrt(var)).otherwise(0.0).alias("z"))
    at = lambda c, q, n: F.percentile(c, F.lit(q)).alias(n)
    low, high = (1 - level) / 2, (1 + level) / 2
    ci = each.agg(at("m", low, "low"), at("m", high, "high"), at("z", low, "d_z_low"), at("z", high, "d_z_high"))
    d = F.col("a") - F.col("b")
    sd = F.stddev_samp(d)
    return pairs.agg(F.avg(d).alias("mean_diff"), F.when(sd > 0, F.avg(d) / sd).otherwise(0.0).alias("d_z")).crossJoin(F.broadcast(ci))


def permutation(pairs: DataFrame, key: str, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: mean difference and the sign-flip p, (count + 1) / (samples + 1)."""
    seen = pairs.agg(F.avg(F.col("a") - F.col("b")).alias("mean_diff"), F.count(F.col("a") - F.col("b")).alias("n"))
    flipped = _sums(pairs, key, samples, sign_flips, seed).crossJoin(F.broadcast(seen))
    as_far = (F.abs(F.col("wd") / F.col("n")) >= F.abs("mean_diff") - 1e-12).cast("int")
    return flipped.groupBy("mean_diff").agg(((F.sum(as_far) + 1) / (samples + 1.0)).alias("p"))
