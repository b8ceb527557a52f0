"""Bounded-space online packing of token ids into windows of fixed length.

Each partition keeps OPEN windows and reads its documents once. Full windows are cut off a long
document at once; what is left goes to the open window where it leaves the least room. When it fits
in none and no more windows may be opened, the fullest is topped up with a cut of the document and
emitted. The windows still open at a partition's end are merged, FAN partitions at a time, by the
same rule, until one group is left; its last ids go to windows whose lengths are powers of two.
A task holds OPEN windows, or the leftovers of FAN groups: both bounded, whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import columns, stored

OPEN = 16
FAN = 64
END = np.zeros(1, "<u4").tobytes()
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, grp long, place long, ids binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Packer:
    """Takes pieces (doc_id, start, ids as bytes, doc_tokens); rows() gives what has been decided since."""

    def __init__(self, size: int, windows: int, first_id: int):
        self.size, self.windows, self.next_id = size, windows, first_id
        self.open: list[tuple[int, list]] = []
        self.done: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at, total = 0, sum(len(p[2]) for p in pieces) // 4
        for doc, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), tokens, self.next_id, at, total, None, None, None))
            at += n
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: bytes, tokens: int) -> None:
        full = 4 * self.size
        view = memoryview(ids)
        at = 0
        while len(view) - at >= full:
            self._emit([(doc, start + at // 4, view[at : at + full], tokens)])
            at += full
        while at < len(view):
            n = (len(view) - at) // 4
            fits = [(w[0], i) for i, w in enumerate(self.open) if w[0] >= n]
            if not fits and len(self.open) < self.windows:
                self.open.append((self.size, []))
                fits = [(self.size, len(self.open) - 1)]
            room, i = min(fits) if fits else min((w[0], i) for i, w in enumerate(self.open))
            take = min(room, n)
            pieces = self.open[i][1]
            pieces.append((doc, start + at // 4, bytes(view[at : at + 4 * take]), tokens))
            at += 4 * take
            if take == room:
                self._emit(pieces)
                self.open.pop(i)
            else:
                self.open[i] = (room - take, pieces)

    def close(self, group: int) -> None:
        """What is still open goes on to the next level."""
        place = 0
        for _, pieces in self.open:
            for doc, start, ids, tokens in pieces:
                self.done.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, None, None, None, group, place, ids))
                place += 1
        self.open = []

    def finish(self) -> None:
        """The very last ids: whole windows, then windows of 2^k ids."""
        rest = [list(p) for _, pieces in self.open for p in pieces]
        self.open = []
        left = sum(len(p[2]) for p in rest) // 4
        while left:
            want = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= want
            window = []
            while want:
                doc, start, ids, tokens = rest[0]
                n = min(want, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], tokens))
                want -= n
                if 4 * n == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = [doc, start + n, ids[4 * n :], tokens]
            self._emit(window)

    def rows(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        cols = list(zip(*done)) or [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(NAMES, cols)], NAMES)


def _id(level: int, group: int) -> int:
    return level << 59 | group << 36


def _merger(size: int, windows: int, depth: int, last: bool):
    """Packs the leftovers of FAN groups into one."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(size, windows, _id(depth, int(key[0])))
        for r in rows.sort_values(["grp", "place"]).itertuples():
            packer.add(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), r.ids, int(r.doc_tokens))
        packer.finish() if last else packer.close(int(key[0]))
        return packer.rows().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return merge


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, windows: int = OPEN, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens).

    Each text's ids by the tokenizer file, then id 0, lie in exactly one piece each; pieces fill
    their sequence gapless from offset 0. Every sequence has `size` ids but the last few, whose
    lengths are powers of two: nothing is padded when `size` is one. A null text counts as empty
    (one piece with id 0); a null id stays null; repeated rows are packed each; other columns are
    left out; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, packer = Encoder(tokenizer, special_as_text=special_as_text), Packer(size, windows, _id(0, part))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                for doc, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                    ids = enc.encode(text) + END
                    packer.add(doc, 0, ids, len(ids) // 4)
                yield packer.rows()
        packer.close(part)
        yield packer.rows()

    base = columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string"))
    level = stored(base.mapInArrow(work, SCHEMA), "packed")
    decided = [level.where("sequence_id is not null")]
    depth = 0
    while True:
        left = level.where("sequence_id is null")
        groups = (left.agg(F.max("grp")).first()[0] or 0) + 1
        depth, last = depth + 1, groups <= FAN

        merge = _merger(size, windows, depth, last)
        level = stored(left.groupBy(F.floor(F.col("grp") / FAN).alias("to")).applyInPandas(merge, SCHEMA), "packed")
        decided.append(level.where("sequence_id is not null"))
        if last:
            break
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.drop("grp", "place", "ids")
