"""The tokenisers of functions.text over whole batches of texts: bytes are classed by a table and cut where the class changes.

The table holds what the regular expression's classes say of each character. Spark is asked for it once a
session, so that both ways split alike; lower case is made by Spark as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CHARACTERS, SLICE = 0x110000, 1 << 22
#: Bytes of the character that a byte begins.
SIZES = np.select([np.arange(256) < 0xC0, np.arange(256) < 0xE0, np.arange(256) < 0xF0], [1, 2, 3], 4)


@dataclass(frozen=True)
class Cut:
    """Runs of characters that match `run`, and each one that matches `single`; those of more than longer_than (0 or 1) characters."""

    run: str
    single: str | None = None
    longer_than: int = 0


_held: dict[tuple[str, str | None], bytes] = {}


def classes(spark: SparkSession, cut: Cut) -> bytes:
    """Two bits a character: in a run, single."""
    if (cut.run, cut.single) not in _held:
        c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        kinds = F.when(c.rlike(f"^{cut.run}$"), 1).when(c.rlike(f"^{cut.single}$") if cut.single else F.lit(False), 2)
        there = spark.range(1, CHARACTERS, numPartitions=4).where("id not between 55296 and 57343").select(F.col("id").cast("int").alias("id"), kinds.cast("byte").alias("kind")).where("kind is not null").toArrow()
        kind = np.zeros(CHARACTERS, np.uint8)
        kind[there.column("id").to_numpy()] = there.column("kind").to_numpy()
        _held[cut.run, cut.single] = np.concatenate([np.packbits(kind == 1), np.packbits(kind == 2)]).tobytes()
    return _held[cut.run, cut.single]


@lru_cache(maxsize=4)
def unpacked(packed: bytes) -> np.ndarray:
    """The kind of each character: 1 in a run, 2 single, 0 neither."""
    bits = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(2, CHARACTERS)
    return bits[0] + 2 * bits[1]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, at, data = texts.cast(pa.string()).buffers()
    at = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], data


def pieces(texts: pa.Array, most: int = SLICE) -> list[tuple[int, int]]:
    """(from, to) of neighbouring texts of `most` bytes together, or one longer one."""
    at, _ = _bytes(texts)
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def tokens(texts: pa.Array, kinds: np.ndarray, longer_than: int = 0) -> pa.ListArray:
    """The tokens of each text (UTF-8, lower case, not null) in order."""
    at, data = _bytes(texts)
    kind = kinds[:256][data] if len(data) else np.zeros(0, np.uint8)
    wide = np.flatnonzero(data >= 0x80)
    kind[wide] = 0
    lead = wide[data[wide] >= 0xC0]
    for size in (2, 3, 4):
        own = lead[SIZES[data[lead]] == size]
        if not len(own):
            continue
        c = data[own].astype(np.int32) & (0x7F >> size)
        for i in range(1, size):
            c = c << 6 | data[own + i] & 0x3F
        k = kinds[c]
        kind[own] = k
        for i in range(1, size):
            kind[own + i] = np.where(k == 2, 3, k)
    edge = at[:-1][at[:-1] < len(data)]
    first = (kind == 1) & np.concatenate([[True], kind[:-1] != 1])[: len(kind)]
    first[edge[kind[edge] == 1]] = True
    first |= kind == 2
    start = np.flatnonzero(first)
    inside = kind > 0
    last = inside & np.concatenate([~inside[1:] | first[1:], [True]])[: len(kind)]
    size = np.flatnonzero(last) - start + 1
    if longer_than:
        short = size <= SIZES[data[start]]
        for i in range(4):
            inside[start[short & (size > i)] + i] = False
        start, size = start[~short], size[~short]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    held = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[inside].tobytes()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, at).astype(np.int32)), held)
