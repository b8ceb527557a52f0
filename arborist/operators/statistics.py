"""Paired tests, effect sizes and corrections over aligned scores (key, a, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import resampling


def align(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b) of two systems' scores; rows with a null are dropped."""
    return a.select(key, F.col(value).cast("double").alias("a")).join(b.select(key, F.col(value).cast("double").alias("b")), key).where("a is not null and b is not null")


def place(rows: DataFrame, value: Column, ties: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds name: the row's place (from 1) by value, then by the column `ties`, without sorting in one task.

    Rows are dealt by ranges of both and numbered within their range; ranges are moved by the counts of
    those before them (a number for each partition). parts: how many, by default what Spark chooses.
    """
    valued = rows.withColumn("__v", value.cast("double"))
    ranged = (valued.repartitionByRange(parts, "__v", ties) if parts else valued.repartitionByRange("__v", ties)).sortWithinPartitions("__v", ties)
    ranged = kept(ranged.withColumn("__i", F.monotonically_increasing_id()))  # the partition above bit 33, the row within it below
    part = F.shiftrightunsigned("__i", 33)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    at = F.col("__o") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, at).drop("__p", "__i", "__o", "__v")


def phi(x: Column) -> Column:
    """Normal distribution function by a rational approximation of the error function (absolute error under 1.5e-7)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def r_label(r: Column) -> Column:
    return F.when(F.abs(r) < 0.1, "negligible").when(F.abs(r) < 0.3, "small").when(F.abs(r) < 0.5, "medium").otherwise("large")


def effect_label(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def paired_t(pairs: DataFrame) -> DataFrame:
    """One row: n, mean difference, t, two-sided normal p, pooled-deviation effect (d) and its label, d_z."""
    t = pairs.agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("m"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"))
    stat = F.when(F.col("sd") > 0, F.col("m") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))).otherwise(0.0)
    pooled = F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2.0)
    d = F.when(pooled > 0, F.abs(F.col("m")) / pooled).otherwise(0.0)
    return t.select("n", F.round("m", 6).alias("mean_diff"), F.round(stat, 6).alias("t"), F.round(2.0 * (1.0 - phi(F.abs(stat))), 6).alias("p"), F.round(d, 6).alias("d"), effect_label(d).alias("effect"), F.round(F.when(F.col("sd") > 0, F.col("m") / F.col("sd")).otherwise(0.0), 6).alias("d_z"))


def wilcoxon(pairs: DataFrame, key: str) -> DataFrame:
    """One row: signed-rank W, z, p and r; zero differences dropped, equal ones ranked by key, as in the plain rule."""
    d = pairs.select(key, (F.col("a") - F.col("b")).alias("d")).where("d <> 0")
    r = place(d, F.round(F.abs("d"), 9), key, "r")
    t = r.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0)).alias("wp"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0)).alias("wm"))
    w = F.least("wp", "wm")
    n = F.col("n")
    z = F.when(n > 0, (w - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)).otherwise(0.0)
    return t.select(n.cast("long").alias("n"), w.cast("double").alias("w"), F.round(z, 6).alias("z"), F.round(2.0 * (1.0 - phi(F.abs(z))), 6).alias("p"), F.round(F.when(n > 0, F.abs(z) / F.sqrt(n)).otherwise(0.0), 6).alias("r"))


def bootstrap(pairs: DataFrame, key: str, samples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: mean difference and its percentile interval; see resampling.bootstrap, which has that of d_z too."""
    return resampling.bootstrap(pairs, key, samples, level, seed).select("mean_diff", "low", "high")


def permutation(pairs: DataFrame, key: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean difference and the sign-flip p, (count + 1) / (samples + 1)."""
    return resampling.permutation(pairs, key, samples, seed)


def required_pairs(d_z: Column, z_level: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> Column:
    """Pairs that a two-sided test at 5 % needs for a power of 80 %, by the normal approximation; null for no effect."""
    return F.when(d_z != 0, F.ceil(F.pow((F.lit(z_level) + z_power) / F.abs(d_z), F.lit(2.0))))


def compare(pairs: DataFrame, key: str, level: float = 0.05, samples: int = 1000) -> DataFrame:
    """One row for two systems' aligned scores: means, deviations, the p or interval of four tests, how many are significant, confidence and winner."""
    t, w, b, x = paired_t(pairs), wilcoxon(pairs, key), bootstrap(pairs, key, samples), permutation(pairs, key, samples)
    m = pairs.agg(F.count("*").alias("n"), *[F.round(f(c), 6).alias(f"{n}_{c}") for c in ("a", "b") for n, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))])
    one = m.crossJoin(F.broadcast(t.select(F.col("p").alias("p_t"), "d", "effect", "d_z"))).crossJoin(F.broadcast(w.select(F.col("p").alias("p_wilcoxon"), "r"))).crossJoin(F.broadcast(b.select("low", "high"))).crossJoin(F.broadcast(x.select(F.col("p").alias("p_permutation"))))
    sig = [F.col("p_t") < level, F.col("p_wilcoxon") < level, (F.col("low") > 0) | (F.col("high") < 0), F.col("p_permutation") < level]
    one = one.withColumn("n_significant", sum((c.cast("int") for c in sig), F.lit(0)))
    sure = F.when(F.col("n_significant") >= 3, "high").when(F.col("n_significant") == 2, "medium").when(F.col("n_significant") == 1, "low").otherwise("none")
    return one.withColumns({"r_effect": r_label(F.col("r")), "required_n": required_pairs(F.col("d_z")), "confidence": sure}).withColumn("winner", F.when(F.col("confidence") != "none", F.when(F.col("mean_a") > F.col("mean_b"), "a").otherwise("b")))


def corrections(tests: DataFrame, key: str, level: float = 0.05) -> DataFrame:
    """Adds bonferroni, bh_forward (running maximum of p n / rank) and bh_standard (backward minimum), each at most 1, with significance at level."""
    whole = Window.partitionBy()
    up = Window.orderBy("p", key)
    n = F.count("*").over(whole)
    ranked = tests.withColumn("raw", F.col("p") * n / F.row_number().over(up)).withColumn("bonferroni", F.least(F.lit(1.0), F.col("p") * n))
    out = ranked.withColumns({"bh_forward": F.least(F.lit(1.0), F.max("raw").over(up.rowsBetween(Window.unboundedPreceding, 0))), "bh_standard": F.least(F.lit(1.0), F.min("raw").over(up.rowsBetween(0, Window.unboundedFollowing)))})
    return out.select(*tests.columns, *[F.round(c, 6).alias(c) for c in ("bonferroni", "bh_forward", "bh_standard")], (F.col("bonferroni") < level).alias("significant"))
