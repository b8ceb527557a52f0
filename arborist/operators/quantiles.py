"""Exact quantiles of groups of any size: a mergeable sketch says where to look, a second pass counts there.

Values are sketched per group (partial sketches merge before and after the shuffle), which gives GRID cuts.
A wanted rank lies between two or three neighbouring cuts, or the count below says that it does not and the whole
group is looked at. Only values in that bracket are counted, equal ones as one; while a bracket still has more
than MOST distinct values, it is sketched and cut again. No group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

GRID, ACCURACY = 100, 10_000
MOST = 1_000_000


def values_at(rows: DataFrame, wanted: DataFrame, accuracy: int = ACCURACY, most: int | None = None) -> DataFrame:
    """(g, k, x): of rows (g, x), x a double that is not null, the value at place k from 0 in each group's order, for wanted (g, k)."""
    most = MOST if most is None else most
    asked = wanted.select("g", "k").distinct().withColumn("own", F.struct("g", "k"))
    # Each wanted rank is a group of its own from here on: (own, left) is what is still to be found among its values.
    state = asked.select("own", "g", F.col("k").alias("left"))
    pool = rows.select("g", F.col("x").cast("double").alias("x"))
    first = True
    found = None
    while True:
        key = "g" if first else "own"
        sized = _bounds(pool, key, accuracy)
        near = state.join(sized, key)
        at = F.floor(F.col("left") / F.col("n") * GRID).cast("int")
        near = near.withColumns({"lo": F.get("cuts", F.greatest(at - 1, F.lit(0))), "hi": F.get("cuts", F.least(at + 2, F.lit(GRID)))})
        near = kept(near.select("own", *([key] if first else []), "left", "lo", "hi", "low", "high"))
        met = pool.join(near, key).select("own", "left", "lo", "hi", "low", "high", "x")
        counts = met.groupBy("own", "left", "lo", "hi", "low", "high").agg(F.sum((F.col("x") < F.col("lo")).cast("long")).alias("below"), F.sum((F.col("x") <= F.col("hi")).cast("long")).alias("upto"))
        missed = (F.col("left") < F.col("below")) | (F.col("left") >= F.col("upto"))
        place = kept(counts.select(
            "own", F.when(missed, F.col("left")).otherwise(F.col("left") - F.col("below")).alias("left"), F.when(missed, F.col("low")).otherwise(F.col("lo")).alias("lo"), F.when(missed, F.col("high")).otherwise(F.col("hi")).alias("hi"),
        ))
        inner = pool.join(near.select("own", *([key] if first else [])).join(place, "own"), key) if first else pool.join(place, "own")
        pool = kept(inner.where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).select("own", "x"))
        state, first = place.select("own", "left"), False
        sizes = pool.groupBy("own").agg(F.approx_count_distinct("x").alias("d"), F.min("x").alias("a"), F.max("x").alias("b"))
        small = (F.col("d") <= most) | (F.col("a") == F.col("b"))
        sizes = kept(sizes.select("own", small.alias("small")))
        done = _picked(pool.join(sizes.where("small").select("own"), "own"), state)
        found = done if found is None else found.unionByName(done)
        rest = sizes.where("not small").select("own")
        if rest.isEmpty():
            return found.select("own.g", "own.k", "x")
        pool, state = kept(pool.join(rest, "own")), kept(state.join(rest, "own"))


def _bounds(pool: DataFrame, key: str, accuracy: int) -> DataFrame:
    at = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return pool.groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx("x", at, F.lit(accuracy)).alias("cuts"), F.min("x").alias("low"), F.max("x").alias("high"))


def _picked(pool: DataFrame, state: DataFrame) -> DataFrame:
    """(own, x): the value at place `left` of each, along the counts of its distinct values."""
    counted = pool.groupBy("own", "x").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("own").orderBy("x"))
    j = counted.withColumn("upto", upto).join(state, "own")
    return j.where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c"))).select("own", "x")


def _group(by: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("all"))


def largest_group(log: DataFrame, by: tuple[str, ...]) -> int:
    return log.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def interpolated(log: DataFrame, by: tuple[str, ...], value: str, shares: dict[str, float], **kwargs) -> DataFrame:
    """(g, names...): quantiles between the two values around (n - 1) p, in proportion; null for groups without a value."""
    rows = log.select(_group(by).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    p = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("p")) for n, s in shares.items()])).alias("s")
    at = sizes.select("g", "n", p).select("g", "s.name", ((F.col("n") - 1) * F.col("s.p")).alias("h"))
    at = kept(at.withColumns({"k": F.floor("h"), "k2": F.ceil("h")}))
    both = at.select("g", "k").union(at.select("g", F.col("k2").alias("k")))
    v = kept(values_at(rows, both, **kwargs))
    j = at.join(v.withColumnRenamed("x", "x1"), ["g", "k"]).join(v.select("g", F.col("k").alias("k2"), F.col("x").alias("x2")), ["g", "k2"])
    mixed = F.when(F.col("k") == F.col("k2"), F.col("x1")).otherwise((F.col("k2") - F.col("h")) * F.col("x1") + (F.col("h") - F.col("k")) * F.col("x2"))
    return j.select("g", "name", mixed.alias("q")).groupBy("g").pivot("name", list(shares)).agg(F.first("q"))


def nearest(log: DataFrame, by: tuple[str, ...], value: str, p: float, **kwargs) -> DataFrame:
    """(g, x): the value at place min(floor(p n), n - 1) from 0 of each group that has one."""
    rows = log.select(_group(by).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    return values_at(rows, sizes.select("g", F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("k")), **kwargs).select("g", "x")
