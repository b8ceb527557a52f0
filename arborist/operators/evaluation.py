"""Evaluation aggregates: metric summaries, efficiency, comparisons of systems, ablations, domains, human ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .power import paired_t_exact
from .statistics import phi


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def aggregate_metrics(rows: DataFrame, names: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, metric, mean, std, min, max, n) of the named columns, nulls left out; std is that of the whole population."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("x")) for n in names])).alias("m")).select(*by, "m.*").where("x is not null")
    return long.groupBy(*by, "metric").agg(_r(F.avg("x")).alias("mean"), _r(F.stddev_pop("x")).alias("std"), _r(F.min("x")).alias("min"), _r(F.max("x")).alias("max"), F.count("*").alias("n"))


def context_reduction(flat: Column, tree: Column) -> Column:
    """How much shorter the tree's context is than the flat one; 0 at least, and for an empty flat one."""
    return F.when(flat == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - tree / flat))


def latency_comparison(tree: Column, flat: Column) -> Column:
    """Struct of speedup, difference and the faster system ("first" is the tree's)."""
    speed = F.when(tree > 0, flat / tree).otherwise(0.0)
    return F.struct(_r(speed).alias("speedup"), _r(flat - tree).alias("difference"), F.when(speed > 1.0, "first").otherwise("second").alias("faster"))


def with_rates(log: DataFrame) -> DataFrame:
    """Adds overhead_ms, reduction, compression (null where it has no bound), visit_rate and pruning_rate to a log.

    log: total_ms, llm_ms, context_tokens, document_tokens, visited, pruned, tree_nodes.
    """
    c = F.col
    return log.withColumns({
        "overhead_ms": c("total_ms") - c("llm_ms"),
        "reduction": F.when(c("document_tokens") == 0, 0.0).otherwise(1.0 - c("context_tokens") / c("document_tokens")),
        "compression": F.when(c("context_tokens") != 0, c("document_tokens") / c("context_tokens")),
        "visit_rate": F.when(c("tree_nodes") == 0, 0.0).otherwise(c("visited") / c("tree_nodes")),
        "pruning_rate": F.when(c("visited") + c("pruned") == 0, 0.0).otherwise(c("pruned") / (c("visited") + c("pruned"))),
    })


def efficiency(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of with_rates' columns, token totals, and the throughput: rows over the sum of their seconds."""
    means = [_r(F.avg(n)).alias(n) for n in ("overhead_ms", "reduction", "compression", "visit_rate", "pruning_rate")]
    seconds = F.sum("total_ms") / 1000.0
    return with_rates(log).groupBy(*by).agg(F.count("*").alias("n"), *means, F.sum("context_tokens").alias("context_tokens"), F.sum("document_tokens").alias("document_tokens"), _r(F.when(seconds > 0, F.count("*") / seconds).otherwise(0.0)).alias("per_second"))


def breakdown(scores: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """For each category of aligned scores (a, b): means, mean difference, and shares of wins and ties of a."""
    a, b = F.col("a"), F.col("b")
    share = lambda c: _r(F.avg(c.cast("double")))
    return scores.groupBy(*by).agg(F.count("*").alias("n"), _r(F.avg(a)).alias("mean_a"), _r(F.avg(b)).alias("mean_b"), _r(F.avg(a - b)).alias("mean_diff"), share(a > b).alias("win_rate"), share(a == b).alias("tie_rate"))


def pairwise_wins(metrics: DataFrame, names: tuple[str, ...], system: str = "system", key: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(first, second, metric, n, mean_diff, wins, losses, ties) for each pair of systems over the questions both have."""
    long = metrics.select(system, *key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("x")) for n in names])).alias("m")).select(F.col(system).alias("first"), *key, "m.metric", "m.x")
    other = long.withColumnsRenamed({"first": "second", "x": "y"})
    j = long.join(other, [*key, "metric"]).where("first < second")
    count = lambda c: F.count(F.when(c, 1))
    return j.groupBy("first", "second", "metric").agg(F.count("*").alias("n"), _r(F.avg(F.col("x") - F.col("y"))).alias("mean_diff"), count(F.col("x") > F.col("y")).alias("wins"), count(F.col("x") < F.col("y")).alias("losses"), count(F.col("x") == F.col("y")).alias("ties"))


def pairwise_tests(metrics: DataFrame, names: tuple[str, ...], system: str = "system", key: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """pairwise_wins with the exact paired t test beside them: t, p, d_z, and the winner where p is below 0.05 after correction over all rows (Bonferroni: there are few)."""
    long = metrics.select(system, *key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("x")) for n in names])).alias("m")).select(F.col(system).alias("first"), *key, "m.metric", F.col("m.x").alias("a"))
    pairs = long.join(long.withColumnsRenamed({"first": "second", "a": "b"}), [*key, "metric"]).where("first < second and a is not null and b is not null")
    tests = paired_t_exact(pairs, ("first", "second", "metric"), digits=9)
    wins = pairwise_wins(metrics, names, system, key)
    j = wins.join(tests.select("first", "second", "metric", "t", "p", "d_z"), ["first", "second", "metric"], "left")
    n = F.count("p").over(Window.partitionBy())  # a row for each pair of systems and metric
    sure = F.col("p") * n < 0.05
    return j.withColumn("winner", F.when(sure, F.when(F.col("t") > 0, F.col("first")).otherwise(F.col("second")))).withColumns({c: _r(F.col(c)) for c in ("t", "p", "d_z")})


def rating_tests(pairs: DataFrame, by: tuple[str, ...], key: str) -> DataFrame:
    """(by..., n, w, z, p, r): the signed-rank test of (key, a, b) in each group, a rating's dimension and rival, say; as statistics.wilcoxon, over groups that fit a task."""
    d = pairs.select(*by, key, (F.col("a") - F.col("b")).alias("d")).where("d <> 0")
    ranked = d.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.round(F.abs("d"), 9), key)))
    up, down = (F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0)).cast("double") for c in (F.col("d") > 0, F.col("d") < 0))
    g = ranked.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.least(up, down).alias("w"))
    n = F.col("n")
    z = (F.col("w") - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    g = g.withColumn("z", z)
    return g.select(*by, n.cast("long").alias("n"), "w", _r(F.col("z")).alias("z"), _r(2.0 * (1.0 - phi(F.abs("z")))).alias("p"), _r(F.abs("z") / F.sqrt(n)).alias("r"))


def ablation_deltas(configs: DataFrame, value: str, full: str, config: str = "config") -> DataFrame:
    """Adds delta against the full configuration (null without one) and its size as importance; configs has a row for each configuration, a report's few."""
    base = configs.where(F.col(config) == full).agg(F.max(value).alias("__full"))
    d = F.col(value) - F.col("__full")
    return configs.crossJoin(F.broadcast(base)).withColumns({"delta": _r(d), "importance": _r(F.abs(d))}).drop("__full")


def domain_report(scored: DataFrame) -> DataFrame:
    """For each domain of (domain, confidence, correct): counts, means and places by accuracy, confidence and size; ties by name. A domain is one row: places are over a handful."""
    per = scored.groupBy("domain").agg(F.count("*").alias("n"), _r(F.avg("confidence")).alias("confidence"), _r(F.avg(F.col("correct").cast("double"))).alias("accuracy"))
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "domain"))
    return per.withColumns({"by_accuracy": place("accuracy"), "by_confidence": place("confidence"), "by_size": place("n")})


def single_positive(ranks: DataFrame, k: int = 5) -> DataFrame:
    """One row for (query_id, rank) of each query's one positive (null: not ranked): accuracy at 1, mean reciprocal rank, NDCG at k."""
    r = F.col("rank")
    gain = F.when(r <= k, F.lit(1.0) / F.log2(r + 1.0)).otherwise(0.0)
    return ranks.agg(F.count("*").alias("n"), _r(F.avg(F.coalesce((r == 1).cast("double"), F.lit(0.0)))).alias("accuracy"), _r(F.avg(F.coalesce(1.0 / r, F.lit(0.0)))).alias("mrr"), _r(F.avg(gain)).alias("ndcg"))


def unblinded(ratings: DataFrame, key: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Mean score of each system by dimension: ratings (task, slot, dimension, score) with the key (task, slot, system)."""
    return ratings.join(key, ["task", "slot"]).groupBy("system").pivot("dimension", list(dimensions)).agg(_r(F.avg("score")))


def invalid_scores(ratings: DataFrame, domains: DataFrame) -> DataFrame:
    """(dimension, n_invalid): scores outside their dimension's (dimension, low, high), and dimensions that have none."""
    j = ratings.join(F.broadcast(domains), "dimension", "left")
    return j.where(F.col("low").isNull() | F.col("score").isNull() | ~F.col("score").between(F.col("low"), F.col("high"))).groupBy("dimension").agg(F.count("*").alias("n_invalid"))


def judged(raw: list[Column], scale: float = 5.0) -> Column:
    """Mean of a judge's axes, each over scale and within 0 and 1; null if any is."""
    each = [F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / scale))) for c in raw]
    return sum(each[1:], each[0]) / float(len(each))


def detector_gap(scored: DataFrame, poor: float = 0.4, good: float = 0.7) -> DataFrame:
    """One row for (judge, confidence): mean confidence of poor and good answers and the gap; the ones between are left out."""
    mean = lambda c: F.avg(F.when(c, F.col("confidence")))
    p, g = F.col("judge") <= poor, F.col("judge") > good
    return scored.agg(F.count(F.when(p, 1)).alias("n_poor"), F.count(F.when(g, 1)).alias("n_good"), _r(mean(p)).alias("poor"), _r(mean(g)).alias("good"), _r(mean(g) - mean(p)).alias("gap"))


def section_recall(rows: DataFrame, found: str, expected: str) -> Column:
    """Share of the expected titles among those found, lower-cased; without any expected, whether anything was found."""
    low = lambda c: F.array_distinct(F.transform(F.col(c), lambda x: F.lower(x)))
    return F.when(F.size(expected) == 0, (F.size(found) > 0).cast("double")).otherwise(_r(F.size(F.array_intersect(low(found), low(expected))) / F.size(low(expected))))


def rejected_report(decisions: DataFrame, sure: float = 0.8, limit: int = 10) -> DataFrame:
    """(kind, place, doc_id, confidence): the first `limit` rejects of either kind, confident or not, by confidence, then id."""
    r = decisions.where("not relevant").withColumn("kind", F.when(F.col("confidence") > sure, "confident").otherwise("uncertain"))
    ranked = r.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("confidence"), "doc_id")))
    return ranked.where(F.col("place") <= limit).select("kind", "place", "doc_id", "confidence")


def known_as(value: Column, names: tuple[str, ...], default: str) -> Column:
    """The lower-case name if it is one of names, else the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*names), v).otherwise(default)
