"""Table functions for sequences: a group's rows come one after the other, in order, and only the running state is held.

They take the place of folds over gathered arrays where a group may be long: Spark partitions and sorts the
rows, the function sees them as a stream.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as T


@udtf(returnType="grp string, ord int, leader int")
class LeaderFold:
    """Each item joins the first leader whose words are similar enough, or leads; the leaders' sizes, and which of them hold a word, are the state."""

    def __init__(self) -> None:
        self.leaders: list[tuple[int, int]] = []
        self.holders: dict[str, list[int]] = {}

    def eval(self, row: Row):
        words = set(row["words"] or ())
        shared = Counter(chain.from_iterable(self.holders.get(w, ()) for w in words))
        for i in sorted(shared) if row["least"] > 0 else range(len(self.leaders)):
            leader, size = self.leaders[i]
            both = size + len(words) - shared[i]
            if both and shared[i] / both >= row["least"]:
                yield row["grp"], row["ord"], leader
                return
        for w in words:
            self.holders.setdefault(w, []).append(len(self.leaders))
        self.leaders.append((row["ord"], len(words)))
        yield row["grp"], row["ord"], row["ord"]


@udtf(returnType="grp string, ord int, n_tokens long, taken boolean")
class BudgetFold:
    """Each chunk that still fits is taken; one too large is taken only first and alone. The total is the state."""

    def __init__(self) -> None:
        self.total, self.stop = 0, False

    def eval(self, row: Row):
        fits = not self.stop and self.total + row["n_tokens"] <= row["budget"]
        alone = not self.stop and not fits and self.total == 0
        if fits or alone:
            self.total += row["n_tokens"]
        self.stop = self.stop or alone
        yield row["grp"], row["ord"], row["n_tokens"], fits or alone


def streamed_leaders(items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(grp, ord, leader) for items (grp, ord, text) of groups of any length; grp comes back as text."""
    rows = items.select(F.col("grp").cast("string").alias("grp"), F.col("ord").cast("int").alias("ord"), F.array_distinct(T.content_tokens("text")).alias("words"), F.lit(float(threshold)).alias("least"))
    return LeaderFold(rows.asTable().partitionBy("grp").orderBy("ord"))


def streamed_budget(chunks: DataFrame, tokens: int) -> DataFrame:
    """As context.budget, for chunks (grp, ord, score, n_tokens) of groups of any length; grp comes back as text."""
    rows = chunks.select(F.col("grp").cast("string").alias("grp"), F.col("ord").cast("int").alias("ord"), F.col("n_tokens").cast("long").alias("n_tokens"), (-F.col("score")).alias("worst"), F.lit(tokens).alias("budget"))
    return BudgetFold(rows.asTable().partitionBy("grp").orderBy("worst", "ord"))
