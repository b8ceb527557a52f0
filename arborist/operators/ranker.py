"""Learning to rank: features, pairwise losses, full-batch gradient descent; training has mini-batches, a split and early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FEATURES = ("jaccard", "depth_fit", "overlap", "lexical", "position", "parent", "siblings", "children")


def features(nodes: DataFrame) -> DataFrame:
    """Adds the array `features` to nodes (query_id, parent_id, query, text, depth, max_depth, position, parent_text[, child_text]).

    By white-space words: Jaccard with the query, fit of the depth (0.4 of the deepest is best), share of
    the query's words, BM25 for texts of 100 words over its largest possible value, earliness, Jaccard of the parent,
    mean Jaccard of the siblings, and share of the query's words in the children's text (0 where there is none).
    """
    every = lambda c: T.white_space_tokens(c)
    q, t, p = (F.array_distinct(every(c)) for c in ("query", "text", "parent_text"))
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
    fit = F.when(F.col("max_depth") > 0, F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("depth") - 0.4 * F.col("max_depth")) / F.col("max_depth"))).otherwise(0.5)
    own = nodes.withColumns({"_q": every("query"), "_t": every("text")})
    n = F.size("_t")
    tf = lambda x: F.size(F.filter("_t", lambda y: y == x)).cast("double")
    part = F.transform(F.transform("_q", tf), lambda c: c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / 100.0)))
    lexical = F.when((F.size("_q") > 0) & (n > 0), F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / (F.size("_q") * 2.2)).otherwise(0.0)
    w = Window.partitionBy("query_id", "parent_id")
    with_jac = own.withColumn("_j", F.when((F.size(q) > 0) & (F.size(t) > 0), T.jaccard(q, t)).otherwise(0.0))
    siblings = F.coalesce((F.sum("_j").over(w) - F.col("_j")) / F.nullif(F.count("*").over(w) - 1, F.lit(0)), F.lit(0.0))
    place = F.when(F.col("position").isNull(), 0.0).otherwise(1.0 - F.col("position"))
    parent = F.coalesce(F.when((F.size(q) > 0) & (F.size(p) > 0), T.jaccard(q, p)), F.lit(0.0))
    below = F.coalesce(share(q, F.array_distinct(every("child_text"))), F.lit(0.0)) if "child_text" in nodes.columns else F.lit(0.0)
    return with_jac.withColumn("features", F.array(F.col("_j"), fit, share(q, t), lexical, place, parent, siblings, below)).drop("_j", "_q", "_t")


def training_pairs(rows: DataFrame, negatives: int = 10) -> DataFrame:
    """(query_id, pos, neg): each relevant node's features against those of the first other nodes in order."""
    bad = rows.where("not relevant").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).where(F.col("n") <= negatives)
    return rows.where("relevant").select("query_id", F.col("features").alias("pos")).join(bad.select("query_id", F.col("features").alias("neg")), "query_id")


def _dot(f: Column, w: list[float]) -> Column:
    return sum((f[i] * F.lit(x) for i, x in enumerate(w)), F.lit(0.0))


def score(rows: DataFrame, weights: list[float], bias: float = 0.0) -> DataFrame:
    z = _dot(F.col("features"), weights) + bias
    return rows.withColumn("score", F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z))))


def loss(pairs: DataFrame, weights: list[float], kind: str = "bpr", margin: float = 0.1) -> DataFrame:
    """One row with the mean loss: bpr, hinge, cross_entropy or mse."""
    a, b = _dot(F.col("pos"), weights), _dot(F.col("neg"), weights)
    s = lambda z: 1.0 / (1.0 + F.exp(-z))
    one = {"bpr": F.log1p(F.exp(-(a - b))), "hinge": F.greatest(F.lit(0.0), margin - (s(a) - s(b))), "cross_entropy": F.log1p(F.exp(-a)) + F.log1p(F.exp(b)), "mse": F.pow(1.0 - s(a), F.lit(2.0)) + F.pow(s(b), F.lit(2.0))}[kind]
    return pairs.agg(F.avg(one).alias("loss"))


def train(pairs: DataFrame, epochs: int = 30, rate: float = 0.5, l2: float = 0.001, width: int = len(FEATURES), patience: int = 10) -> tuple[list[float], list[float]]:
    """Weights of the pairwise logistic loss and its value after each epoch; an epoch is one aggregation, nothing but sums reaches the driver."""
    weights, history, best = [0.0] * width, [], (float("inf"), 0)
    for epoch in range(epochs):
        gap = _dot(F.col("pos"), weights) - _dot(F.col("neg"), weights)
        pull = 1.0 / (1.0 + F.exp(gap))
        row = pairs.agg(F.avg(F.log1p(F.exp(-gap))).alias("loss"), *[F.avg(pull * (F.col("pos")[i] - F.col("neg")[i])).alias(f"g{i}") for i in range(width)]).first()
        if row is None or row["loss"] is None:
            break
        history.append(row["loss"])
        if row["loss"] < best[0] - 1e-6:
            best = (row["loss"], epoch)
        elif epoch - best[1] >= patience:
            break
        weights = [x + rate * (row[f"g{i}"] - l2 * x) for i, x in enumerate(weights)]
    return weights, history


def importance(weights: list[float]) -> dict[str, float]:
    total = sum(map(abs, weights)) or 1.0
    return {n: abs(x) / total for n, x in zip(FEATURES, weights)}
