"""A materialised table of text embeddings, keyed by what it was made from, refreshed by parts.

Rows are dealt to a fixed number of parts by a hash of their id. A part's key is a digest of its rows (their
number and the sums of the rows' digests, so that order does not matter), of the embedder's name and of
the dimension. A refresh compares keys: parts whose key is known are left alone, the others are
embedded anew, counted and measured, and only then named by the next version of the manifest. What a
failed refresh wrote, no version names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import retrieval as R
from .versions import VersionedTable

MANIFEST = "part int, digest string, n_rows long, dim int, folder string"
PARTS = 64
PARTS_MOST = 256

#: Embeds texts: (doc_id, text) to (doc_id, v array<double>), a unit vector for every row that has one.
Embedder = Callable[[DataFrame], DataFrame]


def hashed_embedder(texts: DataFrame) -> DataFrame:
    """Unit vectors of hashed token counts; texts without tokens have none."""
    return R.dense(texts, "doc_id", "v")


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: status existing, created or failed; the manifest's version; parts embedded anew and in all."""

    status: str
    version: int
    rebuilt: int = 0
    parts: int = 0
    error: str | None = None


class EmbeddingIndex:
    """Embeddings below `root`, made by `embed`, which is known by `name` and gives vectors of `dim` components."""

    def __init__(self, spark: SparkSession, root: str, embed: Embedder = hashed_embedder, name: str = "hashed-256", dim: int = 256, parts: int = PARTS):
        if not 1 <= parts <= PARTS_MOST:
            raise ValueError(f"1 to {PARTS_MOST} parts")
        self.spark, self.root, self.embed, self.name, self.dim, self.parts = spark, root.rstrip("/"), embed, name, dim, parts
        self.manifest = VersionedTable(spark, f"{self.root}/manifest", MANIFEST)

    def _part(self, doc_id: Column) -> Column:
        return F.pmod(V.hash_bucket(doc_id.cast("string")), F.lit(self.parts)).cast("int")

    def keys(self, docs: DataFrame) -> DataFrame:
        """(part, digest, n_rows) of the rows (doc_id, text) that have an id and a text."""
        row = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
        lanes = [F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]
        sums = self._rows(docs).groupBy("part").agg(F.count("*").alias("n_rows"), *[F.sum(x).cast("string").alias(f"s{i}") for i, x in enumerate(lanes)])
        whole = F.concat_ws(":", F.col("n_rows").cast("string"), "s0", "s1", F.lit(self.name), F.lit(str(self.dim)))
        return sums.select("part", F.md5(whole.cast("binary")).alias("digest"), "n_rows")

    def _rows(self, docs: DataFrame) -> DataFrame:
        return docs.where("doc_id is not null and text is not null").select("doc_id", "text", self._part(F.col("doc_id")).alias("part"))

    def refresh(self, docs: DataFrame) -> Refresh:
        """Brings the table to the state of docs (doc_id, text): embeds the parts whose rows, embedder or dimension changed."""
        base = self.manifest.current()
        known = self.manifest.read(base)
        now = {r.part: r for r in self.keys(docs).collect()}  # a row a part
        had = {r.part: r for r in known.collect()}
        if not now:
            return Refresh("failed", base, error="there is no text to index")
        stale = sorted(p for p, r in now.items() if p not in had or had[p].digest != r.digest or had[p].dim != self.dim or had[p].n_rows != r.n_rows)
        if not stale and now.keys() == had.keys():
            return Refresh("existing", base, 0, len(now))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        if stale:
            try:
                self._build(docs, stale, folder)
            except Exception as why:  # noqa: BLE001 - the embedder is foreign code; its failure is the refresh's result
                return Refresh("failed", base, error=str(why).splitlines()[0][:300])
        rows = [(p, r.digest, r.n_rows, self.dim, folder if p in stale else had[p].folder) for p, r in sorted(now.items())]
        if not self.manifest.swap(base, self.spark.createDataFrame(rows, MANIFEST).coalesce(1)):
            return Refresh("failed", self.manifest.current(), error="another refresh came first")
        return Refresh("created", base + 1, len(stale), len(now))

    def _build(self, docs: DataFrame, stale: list[int], folder: str) -> None:
        rows = self._rows(docs).where(F.col("part").isin(stale)).select("doc_id", "text")
        made = self.embed(rows).select("doc_id", "v", self._part(F.col("doc_id")).alias("part"))
        made.write.partitionBy("part").parquet(folder)
        wrong = self._read(folder, made.schema["doc_id"].dataType.simpleString(), stale).where(F.size("v") != self.dim).limit(1).count()
        if wrong:
            raise ValueError(f"the embedder gave vectors of another dimension than {self.dim}")

    def _read(self, folder: str, id_type: str, parts: list[int]) -> DataFrame:
        fs = self.manifest._fs
        there = [f"{folder}/part={p}" for p in parts if fs.exists(self.manifest._path(f"{folder}/part={p}"))]
        schema = f"doc_id {id_type}, v array<double>"
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def vectors(self, id_type: str = "long", version: int | None = None) -> DataFrame:
        """(doc_id, v) of a version, the last one; parts are at most PARTS_MOST paths."""
        folders: dict[str, list[int]] = {}
        for r in self.manifest.read(version).orderBy("part").collect():
            folders.setdefault(r.folder, []).append(r.part)
        out = self.spark.createDataFrame([], f"doc_id {id_type}, v array<double>")
        for folder, parts in folders.items():
            out = out.unionByName(self._read(folder, id_type, parts))
        return out

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, doc_id, score, rank): the k nearest rows for each query (query_id, text), embedded the same way."""
        asked = self.embed(queries.select(F.col("query_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
        return R.nearest(self.vectors(), asked, k)

    def delete(self) -> bool:
        """Removes the whole index; whether there was one."""
        return bool(self.manifest._fs.delete(self.manifest._path(self.root), True))
