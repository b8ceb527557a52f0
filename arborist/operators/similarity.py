"""Similarity of two texts by greedy alignment of token vectors (BERTScore), its fallback, and all text metrics at once.

Texts come as (key, reference, hypothesis). Tokens are weighed in Spark, by their inverse frequency among the
references; the alignment of a pair is a product of two token matrices inside a task, in blocks of BLOCK rows,
of which only the maxima in both directions are kept. A batch's distinct tokens are embedded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics as M

#: Token vectors: a matrix with one row for each of the given tokens.
Embedder = Callable[[list[str]], np.ndarray]

PLACES = 256
BLOCK = 1024
SLICE = 256
FEW_TERMS = 200_000
DIGITS = 6


def hashed_grams(tokens: list[str]) -> np.ndarray:
    """Counts of each token's character trigrams, "^" and "$" around it, in 256 places by the last byte of their md5."""
    places: dict[str, int] = {}
    out = np.zeros((len(tokens), PLACES))
    for row, token in enumerate(tokens):
        framed = f"^{token}$"
        for i in range(len(framed) - 2):
            gram = framed[i : i + 3]
            at = places.get(gram)
            if at is None:
                at = places[gram] = hashlib.md5(gram.encode()).digest()[-1]
            out[row, at] += 1
    return out


def best_matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit row of a the largest product with a row of b, and the other way round."""
    of_a, of_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            s = a[i : i + BLOCK] @ b[j : j + BLOCK].T
            np.maximum(of_a[i : i + BLOCK], s.max(axis=1), out=of_a[i : i + BLOCK])
            np.maximum(of_b[j : j + BLOCK], s.max(axis=0), out=of_b[j : j + BLOCK])
    return of_a, of_b


def _weighted_mean(x: np.ndarray, w: np.ndarray, n: np.ndarray) -> float:
    w = w if w.sum() > 0 else n
    return float((x * w).sum() / w.sum())


def _weights(own: DataFrame, key: str, idf: bool) -> DataFrame:
    """(key, toks): each pair's distinct tokens of both sides as (side, t, n, w); side 0 is the reference."""
    sides = F.concat(F.transform("r", lambda t: F.struct(F.lit(0).alias("side"), t.alias("t"))), F.transform("h", lambda t: F.struct(F.lit(1).alias("side"), t.alias("t"))))
    counts = own.select(key, F.explode(sides).alias("x")).groupBy(key, "x.side", "x.t").agg(F.count("*").cast("double").alias("n"))
    if idf:
        df = own.select(F.explode(F.array_distinct("r")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        if df.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
            df = F.broadcast(df)
        size = own.agg(F.count("*").alias("m"))
        counts = counts.join(df, "t", "left").crossJoin(F.broadcast(size))
        counts = counts.withColumn("w", F.col("n") * F.log((F.col("m") + 1) / (F.coalesce("df", F.lit(0)) + 1)))
    else:
        counts = counts.withColumn("w", F.col("n"))
    return counts.groupBy(key).agg(F.collect_list(F.struct("side", "t", "n", "w")).alias("toks"))


def bertscore(pairs: DataFrame, key: str, reference: str, hypothesis: str, embed: Embedder | None = hashed_grams, idf: bool = True) -> DataFrame:
    """(key, precision, recall, f1): how well each token of one text is matched by its nearest of the other.

    Precision is the weighted mean over the hypothesis' tokens of their best cosine among the
    reference's, recall the other way round; weights are log((M + 1) / (df + 1)) over the M references (all
    alike where a text's are all zero, or without idf). embed gives token vectors, by default
    hashed trigrams; None: multiset token F1 instead, the stated fallback where there is no embedder.
    Two texts without tokens score 1, one of them 0; null is empty. Keys must be unique.
    """
    own = pairs.select(key, T.tokens_cjk(F.coalesce(F.col(reference), F.lit(""))).alias("r"), T.tokens_cjk(F.coalesce(F.col(hypothesis), F.lit(""))).alias("h"))
    sizes = own.select(key, F.size("r").alias("nr"), F.size("h").alias("nh"))
    scored = _token_f1(own, key) if embed is None else _aligned(own, key, embed, idf)
    none = F.when((F.col("nr") == 0) & (F.col("nh") == 0), 1.0).otherwise(0.0)
    return sizes.join(scored, key, "left").select(key, *[F.round(F.coalesce(F.col(c), none), DIGITS).alias(c) for c in ("precision", "recall", "f1")])


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0)


def _token_f1(own: DataFrame, key: str) -> DataFrame:
    count = lambda c, n: own.select(key, F.explode(c).alias("t")).groupBy(key, "t").agg(F.count("*").alias(n))
    common = count("r", "x").join(count("h", "y"), [key, "t"]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("n"))
    sized = own.where((F.size("r") > 0) & (F.size("h") > 0)).join(common, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p, r = F.col("n") / F.size("h"), F.col("n") / F.size("r")
    return sized.select(key, p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def _aligned(own: DataFrame, key: str, embed: Embedder, idf: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                toks = b.column("toks").flatten()
                ends = np.concatenate([[0], np.cumsum(b.column("toks").value_lengths().to_numpy())])
                side, n, w = (toks.field(c).to_numpy() for c in ("side", "n", "w"))
                coded = toks.field("t").dictionary_encode()
                which = coded.indices.to_numpy()
                v = np.asarray(embed(coded.dictionary.to_pylist()), np.float64)
                v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
                p, r = np.zeros(b.num_rows), np.zeros(b.num_rows)
                for i in range(b.num_rows):
                    own = np.arange(ends[i], ends[i + 1])
                    ref, hyp = own[side[own] == 0], own[side[own] == 1]
                    if len(ref) and len(hyp):
                        of_ref, of_hyp = best_matches(v[which[ref]], v[which[hyp]])
                        p[i], r[i] = _weighted_mean(of_hyp, w[hyp], n[hyp]), _weighted_mean(of_ref, w[ref], n[ref])
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(p), pa.array(r)], [key, "precision", "recall"])

    rows = _weights(own, key, idf)
    kind = f"{key} {own.schema[key].dataType.simpleString()}, precision double, recall double"
    found = rows.where(F.exists("toks", lambda x: x["side"] == 0) & F.exists("toks", lambda x: x["side"] == 1)).mapInArrow(work, kind)
    return found.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _rouge(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    return M.rouge_l(pairs, key, a, b)


#: The metrics that evaluate() knows: name, function of (pairs, key, reference, hypothesis), its result's column.
METRICS: dict[str, tuple[Callable[[DataFrame, str, str, str], DataFrame], str]] = {
    "rouge_l": (_rouge, "f1"),
    "bertscore": (bertscore, "f1"),
    "token_f1": (lambda p, k, a, b: bertscore(p, k, a, b, None), "f1"),
    "exact_match": (M.exact_match, "exact"),
    "entity_recall": (lambda p, k, a, b: M.term_recall(p, k, a, b, M.MEDICAL_TERMS), "recall"),
}


def evaluate(pairs: DataFrame, key: str, reference: str, hypothesis: str, metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """The pairs' keys with one column for each metric asked for; an unknown name is an error."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    out = pairs.select(key)
    for m in metrics:
        of, column = METRICS[m]
        out = out.join(of(pairs, key, reference, hypothesis).select(key, F.col(column).cast("double").alias(m)), key, "left")
    return out
