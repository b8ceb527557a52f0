"""Rank metrics, text-similarity metrics, efficiency and agreement aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import quantiles


def rank_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20), digits: int = 6) -> DataFrame:
    """(system, query_id, k, precision, recall, f1, ndcg, hit, rr, ap) for run (system, query_id, doc_id, rank) and qrels (query_id, doc_id).

    One pass over the run: every cut is a filtered sum of the same group. Queries without gold are left out.
    """
    gold = qrels.select("query_id", "doc_id").distinct()
    n_rel = gold.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    marked = run.join(gold.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    so_far = F.sum("rel").over(Window.partitionBy("system", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("at", so_far)
    aggs = [F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") == 1, F.col("at") / F.col("rank"))).alias("aps")]
    for k in ks:
        aggs += [F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"h{k}"), F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), F.lit(1.0) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"d{k}")]
    per = marked.groupBy("system", "query_id").agg(*aggs).join(n_rel, "query_id")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    cut = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h"), F.col(f"d{k}").alias("d"), ideal(k).alias("i")) for k in ks])).alias("c")
    rows = per.select("system", "query_id", "n_rel", "first", "aps", cut)
    p, r = F.col("c.h") / F.col("c.k"), F.col("c.h") / F.col("n_rel")
    return rows.select(
        "system", "query_id", "c.k", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0), digits).alias("f1"), F.round(F.col("c.d") / F.col("c.i"), digits).alias("ndcg"),
        (F.col("c.h") > 0).cast("int").alias("hit"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), digits).alias("rr"), F.round(F.coalesce(F.col("aps"), F.lit(0.0)) / F.col("n_rel"), digits).alias("ap"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    """Means over queries for each system and cut."""
    names = ("precision", "recall", "f1", "ndcg", "rr", "ap")
    return metrics.groupBy("system", "k").agg(F.count("*").alias("n_queries"), F.round(F.avg("hit"), 6).alias("hit_rate"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def graded_ndcg(run: DataFrame, qrels: DataFrame, k: int = 5, linear: bool = False) -> DataFrame:
    """(query_id, ndcg) with gains 2^rel - 1 (linear: rel) from qrels (query_id, doc_id, relevance)."""
    gain = lambda c: c if linear else F.pow(F.lit(2.0), c) - 1.0
    got = run.where(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain(F.col("relevance")) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    best = qrels.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))).where(F.col("r") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain(F.col("relevance")) / F.log2(F.col("r") + 1.0)).alias("idcg"))
    return ideal.join(got, "query_id", "left").select("query_id", F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of b's places at a time (a row of the table is one integer)."""
    where: dict[str, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Of two arrays of words, whole texts; in Arrow batches."""
    @F.pandas_udf("int")
    def length(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0 if p is None or q is None else lcs(list(p), list(q)) for p, q in zip(x, y)], dtype="int32")

    return length(a, b)


def rouge_l(pairs: DataFrame, key: str, reference: str, answer: str) -> DataFrame:
    """(key, precision, recall, f1) of the longest common subsequence of words."""
    rows = pairs.select(key, T.tokens_cjk(reference).alias("a"), T.tokens_cjk(answer).alias("b")).withColumn("l", lcs_length(F.col("a"), F.col("b")))
    p, r = F.when(F.size("b") > 0, F.col("l") / F.size("b")).otherwise(0.0), F.when(F.size("a") > 0, F.col("l") / F.size("a")).otherwise(0.0)
    return rows.select(key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def exact_match(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    return pairs.select(key, (T.normalised(a) == T.normalised(b)).cast("int").alias("exact"))


# The medical terms whose recall is measured by default.
MEDICAL_TERMS = (
    "cardiac", "pulmonary", "hepatic", "renal", "cerebral", "vascular", "myocardial", "neural", "skeletal", "endocrine", "cardiovascular", "musculoskeletal", "gait", "stroke volume", "heart rate",
    "hypertension", "diabetes", "myocardial infarction", "stroke", "sepsis", "pneumonia", "arrhythmia", "fibrillation", "thrombosis", "embolism",
    "mmhg", "bpm", "ml/min", "mg/dl", "mcg/kg", "iu/l", "khz", "mhz", "hz", "decibel", "frequency", "wavelength", "amplitude",
    "ultrasound", "doppler", "transducer", "piezoelectric", "impedance", "electrode", "biosignal", "prosthetic", "scaffold", "biocompatibility", "in vitro", "in vivo", "signal-to-noise", "attenuation", "reflection",
    "acoustic", "echo", "b-mode", "sonar", "imaging", "diagnosis", "resolution", "penetration", "probe", "gel", "tissue",
    "초음파", "압전", "감쇠", "임피던스", "주파수", "파장", "도플러", "심장", "혈류", "진단", "영상", "전극", "생체", "조직", "반사", "보행", "근골격계", "심박", "프로브", "탐촉자", "음향", "해상도",
)


def term_recall(pairs: DataFrame, key: str, reference: str, answer: str, terms: tuple[str, ...] = MEDICAL_TERMS) -> DataFrame:
    """(key, n_terms, recall): of the terms in the reference those in the answer, as substrings; 1 without any."""
    has = lambda c: F.filter(F.array(*map(F.lit, terms)), lambda x: F.contains(F.lower(F.col(c)), x))
    return pairs.select(key, F.size(has(reference)).alias("n_terms"), F.round(F.when(F.size(has(reference)) == 0, 1.0).otherwise(F.size(F.array_intersect(has(reference), has(answer))) / F.size(has(reference))), 6).alias("recall"))


def identical_answers(a: DataFrame, b: DataFrame, prefix: int = 80) -> DataFrame:
    """One row for two systems' answers (question_id, answer): share of equal answers, of equal prefixes, and a verdict."""
    j = a.join(b.withColumnRenamed("answer", "other"), "question_id")
    same = lambda x, y: F.avg((x == y).cast("double"))
    agg = j.agg(F.count("*").alias("n"), F.round(same(F.col("answer"), F.col("other")), 6).alias("same"), F.round(same(F.substring("answer", 1, prefix), F.substring("other", 1, prefix)), 6).alias("same_prefix"))
    return agg.withColumn("verdict", F.when(F.col("same_prefix") < 0.10, "independent").when(F.col("same_prefix") < 0.25, "suspicious").otherwise("contaminated"))


def latency(log: DataFrame, by: tuple[str, ...], value: str = "value") -> DataFrame:
    """Mean, median, deviation and interpolated percentiles of a measure.

    Spark's percentile keeps a group's distinct values together; where the largest group has more than
    quantiles.MOST rows, its exact values are found without that (see quantiles).
    """
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    own = [F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("stdev")]
    if quantiles.largest_group(log, by) <= quantiles.MOST:
        j = log.groupBy(*by).agg(*own, *[F.percentile(value, F.lit(p)).alias(c) for c, p in shares.items()])
    else:
        each = log.groupBy(F.struct(*by).alias("g")).agg(*own)
        j = each.join(quantiles.interpolated(log, by, value, shares), "g", "left").select("g.*", *[c for c in ("n", "mean", "stdev")], *shares)
    return j.select(*by, "n", "mean", F.round("median", 6).alias("median"), "stdev", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


def nearest_rank(log: DataFrame, by: tuple[str, ...], value: str = "value", p: float = 0.95) -> DataFrame:
    """The value at place floor(p n) from 0 of each group; of one with more than quantiles.MOST rows without sorting it in one task (see quantiles)."""
    if quantiles.largest_group(log, by) > quantiles.MOST:
        return quantiles.nearest(log, by, value, p).select("g.*", F.col("x").alias("nearest"))
    w = Window.partitionBy(*by)
    ranked = log.where(F.col(value).isNotNull()).withColumns({"r": F.row_number().over(w.orderBy(value)) - 1, "n": F.count("*").over(w)})
    return ranked.where(F.col("r") == F.least(F.floor(F.col("n") * p), F.col("n") - 1)).select(*by, F.col(value).alias("nearest"))


def null_skipping_means(rows: DataFrame, by: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def running_average(log: DataFrame, by: str, order: tuple[str, ...], value: str, last: int = 50) -> DataFrame:
    """Adds avg_all and avg_last, the means so far and over the last rows."""
    w = Window.partitionBy(by).orderBy(*order)
    return log.withColumns({"avg_all": F.round(F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), 9), "avg_last": F.round(F.avg(value).over(w.rowsBetween(-(last - 1), 0)), 9)})


def krippendorff(ratings: DataFrame) -> DataFrame:
    """One row: interval alpha of ratings (unit, value) over units with two or more; NaN without any. Sums only, no pairs."""
    per = ratings.where("value is not null").groupBy("unit").agg(F.count("*").alias("m"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).where("m >= 2")
    t = per.agg(F.sum("m").cast("double").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(2.0 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("within"))
    expected = 2.0 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    alpha = F.when(F.col("n").isNull(), F.lit(float("nan"))).when(expected == 0, 1.0).otherwise(1.0 - F.col("within") / F.col("n") / expected)
    return t.select(F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n_ratings"), F.round(alpha, 6).alias("alpha"))


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: agreement and kappa of two binary ratings."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    t = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return t.select("n", F.round("po", 6).alias("agreement"), F.round(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


def spearman(rows: DataFrame, a: str, b: str, ties: str) -> DataFrame:
    """One row: correlation of ordinal ranks; equal values by the numeric column `ties`."""
    from .statistics import place

    r = place(place(rows.select(a, b, ties), F.col(a), ties, "ra"), F.col(b), ties, "rb")
    return r.agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def stratified(rows: DataFrame, strata: tuple[str, ...], key: str, n: int) -> DataFrame:
    """n rows, taken round-robin over the strata in the order of a hash of the key."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", *strata, key).limit(n)
