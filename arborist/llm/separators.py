"""Token counts by separator scan over flat, unindexed token files.

A file is a run of fixed-width ids in which an end-of-document id follows each document; nothing says
where documents begin. Files come as blocks (file, block, data) cut anywhere between ids. Each block
is searched at once for the separator; what it leaves open on either side is stitched to its
neighbours by a prefix scan of block summaries: the running number of separators and the place of the
last one. The scan has two levels (blocks in spans of SPAN, then spans), so a file of any length,
which may hold most of the tokens, never meets in one task. Files on disk come in by Spark's binary
source, hence one by one whole and of 2 GB at most; longer ones come as rows (file, block, data).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import columns, stored

BLOCK_IDS = 1 << 17
SPAN = 4096
BLOCKS = "file long, block long, data binary"


def blocks_of_files(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(path, file, block, data) of the binary files at a path; files are numbered by a hash of their path."""
    size = width * block_ids
    whole = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / size))))
    return whole.withColumn("block", at).select("path", F.xxhash64("path").alias("file"), "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data"))


def separator_scan(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended): one row for each document of each file, in order from 0.

    start counts the ids of the file before the document; its separator is not in n_tokens. Ids after
    a file's last separator are a document with ended = false. Null or empty blocks hold no ids; a
    repeated (file, block) is an error of the caller and counted twice; an empty table gives no rows.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {1: "<u1", 2: "<u2", 4: "<u4"}[width]
        for b in batches:
            rows = []
            for file, block, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(data or b"", kind)
                at = np.flatnonzero(ids == separator)
                rows.append((file, block, len(ids), at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                ["file", "block", "n", "at"],
            )

    found = stored(columns(blocks, ("file", "file", "long"), ("block", "block", "long"), ("data", "data", "binary")).mapInArrow(search, "file long, block long, n long, at array<long>"), "separators")
    found = found.withColumn("span", F.floor(F.col("block") / SPAN))
    here = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inner = found.withColumns({"ids": F.coalesce(F.sum("n").over(here), zero), "seps": F.coalesce(F.sum(F.size("at")).over(here), zero)})
    inner = inner.withColumn("end", F.when(F.size("at") > 0, F.col("ids") + F.element_at("at", -1) + 1)).withColumn("last", F.max("end").over(here))
    spans = found.groupBy("file", "span").agg(F.sum("n").alias("n"), F.sum(F.size("at")).alias("k"))
    ends = inner.groupBy("file", "span").agg(F.max("end").alias("e"))
    across = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.join(ends, ["file", "span"]).withColumns({"ids0": F.coalesce(F.sum("n").over(across), zero), "seps0": F.coalesce(F.sum("k").over(across), zero)})
    before = before.withColumn("last0", F.coalesce(F.max(F.col("ids0") + F.col("e")).over(across), zero)).withColumn("left", F.lead("span").over(Window.partitionBy("file").orderBy("span")).isNull())
    joined = inner.join(before.select("file", "span", "ids0", "seps0", "last0"), ["file", "span"])
    base = F.col("ids0") + F.col("ids")
    open_from = F.coalesce(F.col("ids0") + F.col("last"), F.col("last0"))
    ended = joined.where(F.size("at") > 0).select("file", (F.col("seps0") + F.col("seps")).alias("first"), base.alias("base"), open_from.alias("open"), F.posexplode("at").alias("i", "p"), "at")
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("at", F.col("i") - 1) + 1)
    docs = ended.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("p") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = before.groupBy("file").agg(F.sum("n").alias("all"), F.sum("k").alias("ordinal"), F.max(F.col("ids0") + F.col("e")).alias("e")).withColumn("start", F.coalesce("e", zero)).where("all > start")
    return docs.unionByName(rest.select("file", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))


def write_token_blocks(docs: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Flat 16-bit token files of the texts, a file for each partition: their blocks, and (file, ordinal, doc_id) in order.

    Special tokens spelled out in a text are encoded as text, so only the separators have the
    separator's id. A null text counts as empty, a null id stays null.
    """
    schema = "file long, block long, data binary, ordinal long, doc_id long"
    size = 2 * block_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        enc, end = Encoder(tokenizer, "<u2", special_as_text=True), np.array([separator], "<u2").tobytes()
        held, block, ordinal = bytearray(), 0, 0

        def flat(data: list[bytes]) -> pa.RecordBatch:
            nonlocal block
            m = len(data)
            block += m
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * m, pa.int64()), pa.array(range(block - m, block), pa.int64()), pa.array(data, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], ["file", "block", "data", "ordinal", "doc_id"]
            )

        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                for text in s.column(1).to_pylist():
                    held += enc.encode(text)
                    held += end
                m = s.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(range(ordinal, ordinal + m), pa.int64()), s.column(0)], ["file", "block", "data", "ordinal", "doc_id"]
                )
                ordinal += m
                full = len(held) // size
                if full:
                    yield flat([bytes(held[i * size : (i + 1) * size]) for i in range(full)])
                    del held[: full * size]
        if held:
            yield flat([bytes(held)])

    base = columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string"))
    made = stored(base.mapInArrow(work, schema), "tokens")
    return made.where("data is not null").select("file", "block", "data"), made.where("data is null").select("file", "ordinal", "doc_id")


def token_counts(docs: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal, start): counts found by the scan, named by the documents' order in their files.

    One row for each row of docs, repeated rows too; an empty table gives no rows.
    """
    blocks, order = write_token_blocks(docs, tokenizer, separator, id_col, text_col, block_ids)
    counts = separator_scan(blocks, separator).where("ended")
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
