"""Training of the ranking function: examples split by hash, mini-batches as one aggregation each, early stopping, models as versioned tables.

An example is a relevant node's features against those of up to ten others of the same query. All that reaches
the driver is, for each mini-batch, its size, its loss and a gradient; which examples a batch has follows from a
hash of the example and the epoch, so that a retried task or another partitioning changes nothing.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from ..sources.versions import VersionedTable
from .ranker import FEATURES

LOSSES = ("bpr", "hinge", "cross_entropy", "mse")
MARGIN, LEAST = 0.1, 1e-10


@dataclass
class Ranker:
    """score = sigmoid(weights . features + bias)."""

    weights: list[float]
    bias: float = 0.0
    history: list[dict] = field(default_factory=list)

    @staticmethod
    def random(width: int = len(FEATURES), seed: int = 42) -> Ranker:
        draw = random.Random(seed)
        return Ranker([draw.gauss(0, math.sqrt(2.0 / width)) for _ in range(width)])

    def save(self, spark: SparkSession, root: str) -> int:
        """Adds the model below root as a new version; its number."""
        text = json.dumps({"weights": self.weights, "bias": self.bias, "history": self.history, "features": list(FEATURES)[: len(self.weights)]})
        return VersionedTable(spark, root, "model string").update(lambda _: spark.createDataFrame([(text,)], "model string"))

    @staticmethod
    def load(spark: SparkSession, root: str, version: int | None = None) -> Ranker:
        row = VersionedTable(spark, root, "model string").read(version).first()
        if row is None:
            raise ValueError(f"no model below {root}")
        held = json.loads(row.model)
        return Ranker(held["weights"], held["bias"], held["history"])


def examples(rows: DataFrame, negatives: int = 10) -> DataFrame:
    """(example, pos, negs) of rows (query_id, node_id, ord, relevant, features): each relevant node with the first others of its query; queries without others have none."""
    bad = rows.where("not relevant").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "node_id"))).where(F.col("n") <= negatives)
    bad = bad.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "features"))), lambda x: x["features"]).alias("negs"))
    name = F.concat_ws("|", F.col("query_id").cast("string"), F.col("node_id").cast("string"))
    return rows.where("relevant").select("query_id", name.alias("example"), F.col("features").alias("pos")).join(bad, "query_id").select("example", "pos", "negs")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def losses(pos: np.ndarray, neg: np.ndarray, owner: np.ndarray, weights: np.ndarray, bias: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, gradient of the weights, of the bias) of each example; owner says whose each row of neg is."""
    n = len(pos)
    m = np.maximum(np.bincount(owner, minlength=n), 1)
    p, q = _sigmoid(pos @ weights + bias), _sigmoid(neg @ weights + bias)
    total = lambda x: np.bincount(owner, x, n)
    spread = lambda x: np.stack([total(x * neg[:, j]) for j in range(neg.shape[1])], axis=1)
    if kind in ("bpr", "hinge"):
        gap = p[owner] - q
        if kind == "bpr":
            pull = _sigmoid(-gap)
            loss = total(-np.log(np.maximum(1 - pull, LEAST)))
        else:
            pull = (MARGIN - gap > 0).astype(np.float64)
            loss = total(np.maximum(0, MARGIN - gap))
        held = total(pull)
        return loss / m, (spread(pull) - held[:, None] * pos) / m[:, None], -held / m
    if kind == "cross_entropy":
        loss = -np.log(np.maximum(p, LEAST)) + total(-np.log(np.maximum(1 - q, LEAST)))
        up, down = p - 1, q
    elif kind == "mse":
        loss = (p - 1) ** 2 + total(q**2)
        up, down = 2 * (p - 1) * p * (1 - p), 2 * q * q * (1 - q)
    else:
        raise ValueError(f"loss is one of {LOSSES}")
    size = np.bincount(owner, minlength=n) + 1
    return loss / size, (up[:, None] * pos + spread(down)) / size[:, None], (up + total(down)) / size


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos = b.column("pos").flatten().to_numpy().reshape(b.num_rows, -1)
    negs = b.column("negs")
    neg = negs.flatten().flatten().to_numpy().reshape(-1, pos.shape[1])
    return pos, neg, np.repeat(np.arange(b.num_rows), negs.value_lengths().to_numpy())


def _sums(some: DataFrame, model: Ranker, kind: str) -> tuple[int, float, np.ndarray, float]:
    """(examples, loss, gradient, gradient of the bias), summed; tasks send one row each."""
    weights, bias = np.array(model.weights), model.bias

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 + len(weights) + 1)
        for b in batches:
            if b.num_rows:
                loss, g, h = losses(*_arrays(b), weights, bias, kind)
                out += np.concatenate([[b.num_rows, loss.sum()], g.sum(axis=0), [h.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(len(out))], pa.int32()), pa.array(out)], ["i", "x"])

    sums = {r.i: r.x for r in some.select("pos", "negs").mapInArrow(work, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    out = np.array([sums.get(i, 0.0) for i in range(2 + len(weights) + 1)])
    return int(out[0]), float(out[1]), out[2:-1], float(out[-1])


def train(given: DataFrame, kind: str = "bpr", epochs: int = 100, batches: int = 8, rate: float = 0.01, l2: float = 0.01, validation: float = 0.2, patience: int = 10, seed: int = 42, start: Ranker | None = None) -> Ranker:
    """A model trained on examples (example, pos, negs), with its history: epoch, mean training loss over batches, validation loss.

    An example is for validation where a hash of its name says so. Each epoch goes over the
    others in `batches` mini-batches, drawn anew by hash; stops after `patience` epochs without a better
    validation loss. Without training examples the model stays as it was.
    """
    if kind not in LOSSES:
        raise ValueError(f"loss is one of {LOSSES}")
    model = start or Ranker.random(seed=seed)
    model = Ranker(list(model.weights), model.bias)
    held = F.pmod(F.xxhash64("example", F.lit(seed)), F.lit(1000)) < int(1000 * validation)
    rows = kept(given.withColumn("held", held))
    proof, rest = rows.where("held"), rows.where("not held")
    best, worse = math.inf, 0
    for epoch in range(1, epochs + 1):
        dealt = rest.withColumn("batch", F.pmod(F.xxhash64("example", F.lit(epoch), F.lit(seed)), F.lit(batches)))
        seen = []
        for b in range(batches):
            n, loss, g, h = _sums(dealt.where(F.col("batch") == b), model, kind)
            if n:
                seen.append(loss / n)
                model.weights = [w - rate * (x / n + l2 * w) for w, x in zip(model.weights, g.tolist())]
                model.bias -= rate * h / n
        if not seen:
            break
        n, loss, *_ = _sums(proof, model, kind)
        val = loss / n if n else 0.0
        model.history.append({"epoch": epoch, "train_loss": sum(seen) / len(seen), "val_loss": val})
        if val < best:
            best, worse = val, 0
        else:
            worse += 1
            if worse >= patience:
                break
    return model


def quality(given: DataFrame, model: Ranker) -> DataFrame:
    """One row: how often the relevant node of an example comes first, its mean NDCG at 5 and reciprocal rank, the mean BPR loss."""
    weights, bias = np.array(model.weights), model.bias

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                pos, neg, owner = _arrays(b)
                p, q = _sigmoid(pos @ weights + bias), _sigmoid(neg @ weights + bias)
                rank = 1 + np.bincount(owner, q > p[owner], b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(rank.astype(np.int64)), pa.array(losses(pos, neg, owner, weights, bias, "bpr")[0])], ["rank", "loss"])

    each = given.select("pos", "negs").mapInArrow(work, "rank long, loss double")
    r = F.col("rank")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return each.agg(F.count("*").alias("n"), mean((r == 1).cast("double"), "accuracy"), mean(F.when(r <= 5, 1.0 / F.log2(r + 1.0)).otherwise(0.0), "ndcg_5"), mean(1.0 / r, "mrr"), mean("loss", "loss"))
