"""Context-tree weighting over bytes, trained once, spread over the cluster.

A byte is eight binary decisions; each decision node of each context of 0 to DEPTH preceding bytes
has Krichevsky-Trofimov counts. The weighted block probability of a node is half its own estimate's
and half the product of its longer contexts'. After training the mixture is fixed: going up from the
longest context that was seen, a node's own estimate gets its posterior weight, the longer context's
prediction the rest. The code length of a text is the sum over its bytes.

Nothing of the model is gathered in one place but the two shortest depths (at most 256 x 255 nodes):
one pass over the counts gives their sums, a second one the mixed probabilities, so that nothing but
counts is kept between. Texts are cut to blocks; a block asks for its own distinct byte strings and
words, the answers are joined to it by key and packed by block. What is shuffled follows the distinct
strings of the blocks, not their length. Words go by their 128-bit hash's upper half: 64 bits, under
which two words of a corpus meet by a chance of one in some millions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, stored

DEPTH = 5
BLOCK = 24_000_000
CHUNK, PACK = 2_000_000, 1_000_000
ROWS_A_TASK = 150_000
STOP = 10  # the byte that ends a text; words hold no white space
HALF = math.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series above 8."""
    x = np.asarray(x, np.float64)
    small = x < 8
    y = np.where(small, x + 8, x)
    z = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    if small.any():
        p = np.ones_like(x)
        for i in range(8):
            p *= np.where(small, x + i, 1)
        out -= np.where(small, np.log(p), 0)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def codes_of(tokens: list[bytes], depth: int) -> np.ndarray:
    """The text's words, one space apart, then STOP: each byte with the `depth` bytes before it, in one number."""
    raw = np.frombuffer(bytes([STOP]) * depth + b" ".join(tokens) + bytes([STOP]), np.uint8).astype(np.uint64)
    n = len(raw) - depth
    out = np.zeros(n, np.uint64)
    for i in range(depth + 1):
        out = out << np.uint64(8) | raw[i : i + n]
    return out


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


class Nodes:
    """Decision nodes of the contexts of `d` bytes over distinct byte strings: which node each string's bits meet, and counts."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, d: int):
        byte = (codes & np.uint64(255)).astype(np.int64)
        context = codes >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)
        at, bit = np.empty((8, len(codes)), np.uint64), np.empty((8, len(codes)), np.int64)
        for i in range(8):
            at[i] = context << np.uint64(8) | ((1 << i) | (byte >> (8 - i))).astype(np.uint64)
            bit[i] = byte >> (7 - i) & 1
        self.bit = bit
        self.keys, where = np.unique(at, return_inverse=True)
        self.where = where.reshape(at.shape)
        both = np.bincount(self.where.ravel() * 2 + bit.ravel(), weights=np.tile(n.astype(np.float64), 8), minlength=2 * len(self.keys)).reshape(-1, 2)
        self.n0, self.n1 = both[:, 0], both[:, 1]
        self.one = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)

    def weigh(self, below: Nodes | None, cut: int) -> None:
        """Sets log block probabilities and own weights from the nodes one byte deeper (None: the deepest)."""
        own = log_kt(self.n0, self.n1)
        if below is None:
            self.log, self.weight = own, np.ones(len(own))
            return
        up = (below.keys >> np.uint64(8) & np.uint64((1 << 8 * (cut - 1)) - 1)) << np.uint64(8) | below.keys & np.uint64(255)
        kids = np.bincount(np.searchsorted(self.keys, up), weights=below.log, minlength=len(self.keys))
        self.log = np.logaddexp(HALF + own, HALF + kids)
        self.weight = np.exp(HALF + own - self.log)

    def mix(self, longer: np.ndarray | None) -> np.ndarray:
        """Probability of each string's bits (8 x strings); longer: the same from one byte deeper, nan where never seen."""
        one = self.one[self.where]
        own = np.where(self.bit == 1, one, 1 - one)
        seen = (self.n0 + self.n1)[self.where] > 0
        if longer is None:
            return np.where(seen, own, np.nan)
        w = np.where(np.isnan(longer), 1.0, self.weight[self.where])
        return np.where(seen, w * own + (1 - w) * np.nan_to_num(longer), np.nan)


def subtree(codes: np.ndarray, n: np.ndarray, depth: int, top: int, mix: bool = True) -> tuple[np.ndarray | None, Nodes]:
    """From depth up to `top`: each string's bit probabilities there (nan: never seen; None without mix), and the nodes at top."""
    below, mixed = None, None
    for d in range(depth, top - 1, -1):
        nodes = Nodes(codes, n, d)
        nodes.weigh(below, d + 1)
        mixed, below = nodes.mix(mixed) if mix else None, nodes
    return mixed, below


TOP = 2


def train(counts: DataFrame, depth: int) -> DataFrame:
    """counts (code, n): distinct byte strings of depth + 1 bytes with their training counts (0: only to be scored). Gives (code, lp): log10 of the last byte's probability."""
    spark = counts.sparkSession
    rows = counts.count()
    key = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    dealt = counts.repartition(max(1, math.ceil(rows / ROWS_A_TASK)), key)

    def table(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
        got = [b for b in batches if b.num_rows]
        if not got:
            return None
        t = pa.Table.from_batches(got)
        return t.column("code").to_numpy().view(np.uint64), t.column("n").to_numpy()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := table(batches):
            top = subtree(*got, depth, TOP, False)[1]
            context, node = (top.keys >> np.uint64(8) & np.uint64(255)).astype(np.int32), (top.keys & np.uint64(255)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(node), pa.array(top.n0), pa.array(top.n1), pa.array(top.log)], ["byte", "node", "n0", "n1", "log"])

    first = dealt.mapInArrow(sums, "byte int, node int, n0 double, n1 double, log double").groupBy("byte", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("kids"))
    one, zero = np.zeros((2, 256, 256)), np.zeros((2, 256))
    one[1] = zero[1] = np.nan
    logs, n0, n1 = np.zeros(256), np.zeros(256), np.zeros(256)
    for r in first.collect():  # at most 256 x 255 rows
        own = float(log_kt(np.array([r.n0]), np.array([r.n1]))[0])
        log = float(np.logaddexp(HALF + own, HALF + r.kids))
        if r.n0 + r.n1:
            one[:, r.byte, r.node] = math.exp(HALF + own - log), (r.n1 + 0.5) / (r.n0 + r.n1 + 1)
            logs[r.node] += log
            n0[r.node] += r.n0
            n1[r.node] += r.n1
    own = log_kt(n0, n1)
    zero[0] = np.exp(HALF + own - np.logaddexp(HALF + own, HALF + logs))
    zero[1] = (n1 + 0.5) / (n0 + n1 + 1)
    shared = spark.sparkContext.broadcast((one, zero))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := table(batches)):
            return
        (one, zero), q = shared.value, subtree(*got, depth, TOP)[0]
        codes = got[0].view(np.int64)
        byte, before = codes & 255, codes >> 8 & 255
        lp = np.zeros(len(codes))
        for i in range(8):
            node, bit = (1 << i) | (byte >> (8 - i)), byte >> (7 - i) & 1
            p = q[i]
            for w, x in ((one[0][before, node], one[1][before, node]), (zero[0][node], zero[1][node])):
                own = np.where(bit == 1, x, 1 - x)
                w = np.where(np.isnan(p), 1.0, w)
                p = np.where(np.isnan(own), p, w * own + (1 - w) * np.nan_to_num(p))
            lp += np.log10(p)
        for a in range(0, len(codes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[a : a + 50_000]), pa.array(lp[a : a + 50_000])], ["code", "lp"])

    return dealt.mapInArrow(answer, "code long, lp double")


def packed(answers: DataFrame) -> DataFrame:
    """Rows (block, code, x) as (block, payload): the codes and numbers of one block in a task, up to PACK rows of the task at a time."""

    def rows(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        block, code, x = (t.column(c).to_numpy() for c in ("block", "code", "x"))
        order = np.lexsort((code, block))
        block, code, x = block[order], code[order], x[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
        squeeze = zstandard.ZstdCompressor(level=1)
        blobs = [squeeze.compress(np.diff(code[a:b], prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes() + x[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(blobs, pa.binary())], ["block", "payload"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= PACK:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return answers.mapInArrow(work, "block long, payload binary")


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and their numbers out of packed rows."""
    codes, numbers = [np.zeros(0, np.int64)], [np.zeros(0)]
    for blob in blobs:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        n = len(raw) // 16
        codes.append(np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.int64).ravel()))
        numbers.append(raw[8 * n :].view(np.float64))
    code, x = np.concatenate(codes), np.concatenate(numbers)
    order = np.argsort(code, kind="stable")
    return code[order], x[order]


def word_codes(words: list[bytes]) -> np.ndarray:
    """One number for each word."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w)[:8] for w in words]), ">i8").astype(np.int64)


def _held_out(doc: int | None) -> bool:
    return doc is not None and crc32(str(doc).encode()) % 10 == 0


ASKS = "block long, kind int, code long, n long, payload binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
_ASK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
_ASK_NAMES = [x.split()[0] for x in ASKS.split(", ")]


class _Block:
    """Texts of one block, and the distinct strings and words in them with their training counts."""

    def __init__(self, depth: int):
        self.depth, self.size = depth, 0
        self.docs: list[tuple[int | None, str]] = []
        self.words, self.other = Counter(), set()
        self.train: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.raw = 0
        self.codes, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, doc: int | None, text: str | None) -> None:
        tokens = tokens_of(text)
        self.docs.append((doc, text or ""))
        codes = codes_of(tokens, self.depth)
        if _held_out(doc):
            self.other.update(tokens)
            self.held.append(codes)
        else:
            self.words.update(tokens)
            self.words[b""] += 1
            self.train.append(codes)
        self.raw += len(codes)
        self.size += len(text or "") + 64
        if self.raw >= CHUNK:
            self.fold()

    def fold(self) -> None:
        parts = [(self.codes, self.n)]
        for some, count in ((self.train, 1), (self.held, 0)):
            if some:
                u, c = np.unique(np.concatenate(some), return_counts=True)
                parts.append((u, c * count))
        self.train, self.held, self.raw = [], [], 0
        self.codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        self.n = np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(self.codes)).astype(np.int64)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        self.fold()
        table = pa.table({"doc": pa.array([d for d, _ in self.docs], pa.int64()), "text": pa.array([t for _, t in self.docs], pa.string())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
        self.docs = []
        yield self._batch(block, 0, payload=[blob])
        for a in range(0, len(self.codes), 50_000):
            yield self._batch(block, 1, code=self.codes[a : a + 50_000].view(np.int64), n=self.n[a : a + 50_000])
        for t in self.other:
            self.words[t] += 0
        words = list(self.words)
        codes, n = word_codes(words), np.fromiter(self.words.values(), np.int64, len(words))
        order = np.argsort(codes)
        for a in range(0, len(words), 50_000):
            some = order[a : a + 50_000]
            yield self._batch(block, 2, code=codes[some], n=n[some])

    @staticmethod
    def _batch(block: int, kind: int, **given) -> pa.RecordBatch:
        m = len(next(iter(given.values())))
        fixed = {"block": np.full(m, block), "kind": np.full(m, kind)}
        return pa.RecordBatch.from_arrays([pa.array((fixed | given)[k], t) if k in fixed or k in given else pa.nulls(m, t) for k, t in zip(_ASK_NAMES, _ASK_TYPES)], _ASK_NAMES)


def score_texts(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the unigram base score, the weighted context tree's log10 probability, and its code length for each byte of the model's text.

    A-Z are lower-cased; the model's text is the words, one space apart, and an end. Rows whose
    crc32(doc_id as text) mod 10 is 0 are held out, all others train (also those with a null id). A
    null text counts as empty: one token, the end. Repeated rows train and are scored each; other
    columns are left out; an empty table gives no rows. Without any training row every base
    probability is 1 and every bit of the model 1/2.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, block = TaskContext.get().partitionId() << 24, 0, _Block(depth)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                s = b.slice(at, 128)
                for doc, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                    block.add(doc, text)
                    if block.size >= BLOCK:
                        yield from block.rows(first + k)
                        k, block = k + 1, _Block(depth)
        if block.docs:
            yield from block.rows(first + k)

    base = columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string"))
    asked = stored(base.mapInArrow(ask, ASKS), "ctw-asks")
    strings, words = asked.where("kind = 1"), asked.where("kind = 2")
    model = train(stored(strings.groupBy("code").agg(F.sum("n").alias("n")), "ctw-counts"), depth)
    counts = stored(words.groupBy("code").agg(F.sum("n").alias("c")), "ctw-words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    found = packed(strings.select("block", "code").join(model, "code").select("block", "code", F.col("lp").alias("x")))
    known = packed(words.select("block", "code").join(counts, "code").select("block", "code", F.col("c").cast("double").alias("x")))
    texts = asked.where("kind = 0").select("block", "kind", "payload")
    parts = [texts, found.select("block", F.lit(1).alias("kind"), "payload"), known.select("block", F.lit(2).alias("kind"), "payload")]

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        kind, payload = rows["kind"].to_numpy(), rows["payload"].to_numpy()
        blob = payload[kind == 0][0]
        codes, lp = unpacked(payload[kind == 1].tolist())
        codes = pa.array(codes)
        token, c = unpacked(payload[kind == 2].tolist())
        log = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
        del rows, payload
        logs: dict[bytes, float] = {}
        new: set[bytes] = set()

        def learn(tokens: list[bytes]) -> None:
            """Fetches the numbers of words not met in this block so far."""
            fresh = list(set(tokens).difference(logs))
            if fresh:
                at = np.searchsorted(token, word_codes(fresh))
                logs.update(zip(fresh, log[at].tolist()))
                new.update([w for w, n in zip(fresh, c[at].tolist()) if not n])

        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as r:
            held = r.read_all()
        out, pending, sizes = [], [], []
        total_lp: list[float] = []
        lengths: list[int] = []

        def look() -> None:
            if pending:
                at = pa.compute.index_in(pa.array(np.concatenate(pending).view(np.int64)), value_set=codes).to_numpy()
                total_lp.extend(np.add.reduceat(lp[at], np.cumsum([0, *sizes[:-1]])).tolist())
                pending.clear()
                sizes.clear()

        for doc, text in zip(held.column("doc").to_pylist(), held.column("text")):
            tokens = tokens_of(text.as_py())
            codes_here = codes_of(tokens, depth)
            pending.append(codes_here)
            sizes.append(len(codes_here))
            lengths.append(len(codes_here))
            if sum(sizes) > CHUNK:
                look()
            tokens.append(b"")
            learn(tokens)
            n_new = sum(map(new.__contains__, tokens)) if new else 0
            out.append((doc, _held_out(doc), len(tokens), len(tokens) - n_new, total, math.fsum(map(logs.__getitem__, tokens))))
        look()
        frame = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        frame["score"] = total_lp
        frame["bits_per_byte"] = -frame["score"] * math.log2(10) / lengths
        return frame

    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("block").applyInPandas(score, SCORES)
