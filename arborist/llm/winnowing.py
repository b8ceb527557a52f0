"""Benchmark decontamination by winnowing: fingerprints of word k-grams, joined and extended to whole windows.

Of every window of `window` consecutive words the k-gram with the smallest hash (the first of equal
ones) is kept, on both sides by the same code. Equal windows keep the same k-gram, so every shared span
of that length or more shares a fingerprint, wherever it begins. A benchmark item shorter than a window
is one window of its own length, and documents are winnowed for each such length too.

Documents' fingerprints are first held against a bitmap of fixed size of the items' fingerprints; what
is left leaves the task with the words of the windows it was kept for. The fingerprint join has the
window as its second key: that is the extension, by equality, so that neither a frequent k-gram nor a
frequent passage makes pairs of occurrences. Words are compared as they are; hashes only select.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, stored

WINDOW, GRAM = 10, 5
BITMAP_BITS = 1 << 24
GROUP_BYTES = 2 << 20
PIECE_BYTES = 1 << 20

# Fixed value: bytes below 128 that belong to words, as in the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[list(WORD_BYTES)] = True
_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were ever needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                line = np.full(n, base, np.uint64)
                line[0] = 1
                setattr(self, name, np.cumprod(line, dtype=np.uint64))
        return self.up, self.down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], by differences of running sums over pieces of about PIECE_BYTES."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE_BYTES, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = powers.need(b - a + 1)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data[a:b]] * up[: b - a], dtype=np.uint64)])
        out[lo:hi] = _mix((run[ends[lo:hi] - a] - run[starts[lo:hi] - a]) * down[starts[lo:hi] - a])
        lo = hi
    return out


class Words:
    """The lower-cased words of some texts (UTF-8, null: none) in one buffer: where each begins and ends, its text and its hash."""

    def __init__(self, texts: pa.Array, powers: Powers):
        flat = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
        self.data = _LOWER[np.frombuffer(b"\n".join([*flat, b""]), np.uint8)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[self.data], [False]]).view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        heads = np.cumsum([0, *(len(t) + 1 for t in flat)])
        self.first = np.searchsorted(self.starts, heads)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(flat)), self.counts)
        self.hashes = word_hashes(self.data, self.starts, self.ends, powers)

    def winnow(self, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """(first words, fingerprints) of all windows of `length` words within one text."""
        k = min(gram, length)
        n = len(self.hashes) - length + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = np.full(len(self.hashes) - k + 1, length, np.uint64)
        for j in range(k):
            grams = grams * np.uint64(_BASE) + self.hashes[j : j + len(grams)]
        grams = _mix(grams)
        least = grams[:n].copy()
        for j in range(1, length - k + 1):
            np.minimum(least, grams[j : j + n], out=least)
        at = np.flatnonzero(self.text_of[:n] == self.text_of[length - 1 :])
        return at, least[at]

    def window(self, at: int, length: int) -> bytes:
        """The words of a window, joined by one space."""
        return b" ".join([self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + length].tolist(), self.ends[at : at + length].tolist())])


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about GROUP_BYTES of text; a longer text is a slice of its own."""
    sizes = np.array([0 if s is None else s for s in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    lo, held = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > lo and held + s > GROUP_BYTES:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += s
    if lo < batch.num_rows:
        yield batch.slice(lo)


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, len, h, words): every window of every item with its fingerprint; an item of fewer words is one window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for b in _groups(batch, "text"):
                w = Words(b.column("text"), powers)
                for length in {min(window, c) for c in w.counts.tolist() if c}:
                    at, h = w.winnow(length, gram)
                    fits = np.minimum(w.counts[w.text_of[at]], window) == length
                    at, h = at[fits], h[fits]
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("item_id").take(pa.array(w.text_of[at])), pa.array(np.full(len(at), length, np.int32)), pa.array(h.view(np.int64)),
                            pa.array([w.window(a, length) for a in at.tolist()], pa.binary()),
                        ],
                        ["item_id", "len", "h", "words"],
                    )

    return columns(items, (id_col, "item_id", "string"), (text_col, "text", "string")).mapInArrow(work, "item_id string, len int, h long, words binary")


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """The fingerprints' lowest bits as a bitmap, put together by Spark: bits / 8 bytes in all, whatever the items."""
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    parts = windows.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for r in parts.collect():
        # Buckets count from 1 for places from 1 on, so that place 0 is alone in bucket 0.
        out[r.part * 4096 : r.part * 4096 + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def document_prints(docs: DataFrame, lengths: list[int], bitmap: np.ndarray, bits: int, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, prints) for each row: the windows whose fingerprint the bitmap has, as (h, at, len, words)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.struct([("h", pa.int64()), ("at", pa.int64()), ("len", pa.int32()), ("words", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, known = Powers(), shared.value
        for batch in batches:
            for b in _groups(batch, "text"):
                w = Words(b.column("text"), powers)
                found = []
                for length in lengths:
                    at, h = w.winnow(length, gram)
                    low = (h & np.uint64(bits - 1)).astype(np.int64)
                    hit = known[_byte(low)] >> _bit(low) & 1 == 1
                    at, h = at[hit], h[hit]
                    found.append((at, np.full(len(at), length, np.int32), h))
                at, size, h = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64))
                order = np.argsort(w.text_of[at], kind="stable")
                at, size, h = at[order], size[order], h[order]
                texts = w.text_of[at]
                flat = pa.StructArray.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(at - w.first[texts]), pa.array(size), pa.array([w.window(a, s) for a, s in zip(at.tolist(), size.tolist())], pa.binary())], fields=list(kind)
                )
                offsets = pa.array(np.searchsorted(texts, np.arange(b.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "n_words", "prints"])

    rows = columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string"))
    return rows.mapInArrow(work, "doc_id long, n_words long, prints array<struct<h: long, at: long, len: int, words: binary>>")


def _byte(p: np.ndarray) -> np.ndarray:
    """Where Spark's bitmaps have place p (from 0): bucket (p - 1) // 32768 + 1, position (p - 1) % 32768; place 0 is bucket 0, position 0."""
    return np.where(p > 0, 4096 + (p - 1) // 8, 0)


def _bit(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, (p - 1) % 8, 0).astype(np.uint8)


def contaminated_spans(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITMAP_BITS,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, spans, items): one row for each row of docs.

    spans are the maximal runs [from, to) of words that lie in an occurrence of an item's window, in
    order, touching ones as one; items are the ids, as sorted strings, of the items that have a window
    in the text. Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A
    text or item that is null or has no words takes no part; an item without an id marks words but is
    not listed; rows of one item id are one item; repeated rows and null or repeated ids of documents
    have a row each. Texts of any length are searched whole. Other columns are left out; without
    items every document is clean, and an empty table gives no rows.
    """
    if bits & (bits - 1) or bits < 1 << 15:
        raise ValueError("bits must be a power of two, 32768 at least")
    known = stored(item_windows(items, window, gram, item_id_col, item_text_col).distinct(), "items")
    lengths = sorted(r["len"] for r in known.select("len").distinct().collect())
    windows = stored(known.select("len", "h", "words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    members = known.where(F.col("item_id").isNotNull()).join(windows, ["len", "h", "words"]).select("wid", "item_id")
    prints = stored(document_prints(docs, lengths, _bitmap(windows, bits), bits, gram, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "prints")
    met = prints.where(F.size("prints") > 0).select("rid", F.inline("prints")).join(windows, ["len", "h", "words"]).select("rid", "at", "len", "wid")
    met = stored(met, "met")

    line = Window.partitionBy("rid").orderBy("from", "to")  # the windows of one text
    apart = F.coalesce(F.col("from") > F.max("to").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = met.select("rid", F.col("at").alias("from"), (F.col("at") + F.col("len")).alias("to")).withColumn("apart", apart.cast("int"))
    runs = runs.withColumn("run", F.sum("apart").over(line)).groupBy("rid", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    spans = runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))
    listed = met.select("rid", "wid").distinct().join(members, "wid").groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<struct<from: bigint, to: bigint>>"), F.array().cast("array<string>")
    return prints.select("rid", "doc_id", "n_words").join(spans, "rid", "left").join(listed, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of each document; see contaminated_spans()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return contaminated_spans(docs, items, window, gram).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans"
    )
