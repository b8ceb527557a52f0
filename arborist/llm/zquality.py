"""Quality by compression: how much better good text's dictionary serves a text than bad text's.

One zstandard dictionary is built from good labelled texts and one from bad ones. A text is compressed
with each; the difference of the two sizes over their sum says which it resembles. A logistic curve,
fitted on labelled texts that built no dictionary, turns that (and the text's length) into a score.

The fit reads a bounded sample: at most SAMPLE labelled rows of each class, those with the smallest
hash of their id, of which a class's texts beyond SAMPLE_BYTES are left out whole. Two in three build
the dictionaries, the third calibrates. Every text is scored whole.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

SAMPLE = 3000
SAMPLE_BYTES = 24 << 20
DICTIONARY = 1 << 17
LEVEL = 3
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    mean: list[float]
    scale: list[float]


class Sizer:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        make = lambda d: zstandard.ZstdCompressor(level=level, dict_data=_dictionary(d, level), write_checksum=False, write_content_size=False, write_dict_id=False) if d else None
        self.good, self.bad = make(good), make(bad)

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8")
        if not raw or not self.good or not self.bad:
            return [0.0, math.log1p(len(raw)), 0.0]
        g, b = len(self.good.compress(raw)), len(self.bad.compress(raw))
        d = (b - g) / (b + g)
        return [d, math.log1p(len(raw)), (b + g) / 2 / len(raw)]


def _dictionary(data: bytes, level: int) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if data[:4] != b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_FULLDICT)
    d.precompute_compress(level=level)
    return d


def build_dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the texts' own ends where there are too few to train one; b"" without text."""
    raw = [t.encode("utf-8") for t in texts if t]
    if not raw:
        return b""
    try:
        return zstandard.train_dictionary(size, raw).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(raw)[-size:]


def _expand(x: np.ndarray) -> np.ndarray:
    d, length, ratio = x.T
    return np.stack([d, d * length, ratio, length, d * d], axis=1)


def fit(rows: list[tuple[int, str | None, int]], size: int = DICTIONARY) -> Model:
    """rows: (id, text, label 0 or 1), in a fixed order. With fewer than two classes the score is the share of good rows."""
    parts = {y: [r for r in rows if r[2] == y] for y in (0, 1)}
    prior = (len(parts[1]) + 1) / (len(rows) + 2)
    if not parts[0] or not parts[1]:
        return Model(b"", b"", [math.log(prior / (1 - prior))] + [0.0] * 5, [0.0] * 5, [1.0] * 5)
    build = {y: [t or "" for i, (_, t, _) in enumerate(p) if i % 3 != 2] for y, p in parts.items()}
    apart = {y: [t for i, (_, t, _) in enumerate(p) if i % 3 == 2] or [t for _, t, _ in p] for y, p in parts.items()}
    good, bad = (build_dictionary(build[y], size) for y in (1, 0))
    sizer = Sizer(good, bad)
    x = _expand(np.array([sizer.features(t) for y in (0, 1) for t in apart[y]]))
    y = np.repeat([0.0, 1.0], [len(apart[0]), len(apart[1])])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    pull = np.diag([1e-6] + [1e-2] * (z.shape[1] - 1))
    for _ in range(50):  # Newton steps on the penalised log likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + pull, z.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return Model(good, bad, w.tolist(), mean.tolist(), scale.tolist())


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, bytes_: int) -> list[tuple]:
    """The labelled rows that the fit may see, in the order of their hash; each id counts once."""
    own = columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string"))
    may = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    marks = columns(labels, (id_col, "doc_id", "long"), (label_col, "y", "int")).where(F.col("y").isin(0, 1) & may).groupBy("doc_id").agg(F.min("y").alias("y"))
    at = F.xxhash64("doc_id")
    picked = [marks.where(F.col("y") == y).orderBy(at, "doc_id").limit(most) for y in (0, 1)]
    few = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "labelled")
    got = own.join(F.broadcast(few), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "y", at.alias("h")).orderBy("h", "doc_id", "text").toLocalIterator()
    out, seen, used = [], set(), {0: 0, 1: 0}
    for r in got:
        if r.doc_id in seen:
            continue
        seen.add(r.doc_id)
        n = len((r.text or "").encode("utf-8"))
        if used[r.y] + n <= bytes_:
            used[r.y] += n
            out.append((r.doc_id, r.text, r.y))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE, bytes_: int = SAMPLE_BYTES) -> Model:
    """The model fitted on `sample`'s rows.

    Rows without an id, labels other than 0 and 1 and ids without a text row teach nothing; of an id with several
    labels the smaller counts, with several texts the smallest; null texts count as empty. With labels of one class,
    or none (an empty table), every text scores (good rows + 1) / (rows + 2). Other columns are not read.
    """
    return fit(sample(docs, labels, id_col, text_col, label_col, most, bytes_))


def score_many(model: Model, texts: list[str | None], sizer: Sizer) -> np.ndarray:
    x = _expand(np.array([sizer.features(t) for t in texts], np.float64).reshape(-1, 3))
    z = model.weights[0] + ((x - np.array(model.mean)) / np.array(model.scale)) @ np.array(model.weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of docs.

    Null and empty texts have the score of an empty text; a null id stays null and is not held out;
    repeated rows are scored alike; other columns are left out; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.good, model.bad)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                p = score_many(model, s.column(1).to_pylist(), sizer)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(p)], ["doc_id", "score"])

    scored = columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string")).mapInArrow(work, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores below threshold; columns, whatever their names, and other rows stay as they are.

    Null and empty texts have the score of an empty text; rows with a null id and repeated rows are judged by their
    text alone; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.good, model.bad)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                p = score_many(model, s.column(at).to_pylist(), sizer)
                yield s.filter(pa.array(p >= threshold))

    return docs.mapInArrow(work, docs.schema)


def describe(model: Model) -> str:
    return json.dumps({"good": len(model.good), "bad": len(model.bad), "weights": model.weights})
