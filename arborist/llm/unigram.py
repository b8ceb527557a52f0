"""Unigram segmentation: Viterbi over a double-array trie of pieces with log scores.

Text is escaped as SentencePiece does (a whitespace marker before it and for each space). A character
no piece covers costs the lowest score less UNKNOWN and is written as its bytes' pieces. When no piece
has the marker after another character, the best path never crosses the start of a run of markers;
the chunks between are segmented once and kept in a bounded dictionary, and all new chunks of a batch
go through trie and Viterbi together, array-wise, in double precision. SentencePiece adds scores in
single precision from the start of the text, so paths of almost equal score are ranked by its
rounding: where a chunk's best path leads by less than that can move, it is searched again from the
sum so far in single precision, the first of equals by start. So ids are the library's, ties included.

The installed vocabulary gives pieces in the order of their merges; as log score each piece gets that
of a Zipf law at its rank. Another list of (piece, score) may be given.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import columns

MARK = "▁"
UNKNOWN = 10.0
KEPT, SHORT = 300_000, 64
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        shift += 7
        at += 1
        if b[at - 1] < 128:
            return n, at


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = b[at : at + n], at + n
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) for each id of a SentencePiece model file."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
    return out


def zipf_scores(pieces: list[tuple[str, float, int]], shift: float = 2.7) -> list[tuple[str, float, int]]:
    """The pieces with the log probability of a Zipf-Mandelbrot law at their place in the list, other kinds unchanged."""
    ranks = [i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)]
    total = math.log(sum(1 / (r + shift) for r in range(1, len(ranks) + 1)))
    score = {i: -math.log(r + shift) - total for r, i in enumerate(ranks, 1)}
    return [(p, score.get(i, s), k) for i, (p, s, k) in enumerate(pieces)]


@dataclass
class Trie:
    """base and check of a double-array trie; value: piece id at a node or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(words: dict[bytes, int]) -> Trie:
    kids: list[dict[int, int]] = [{}]
    ids = [-1]
    for w in sorted(words):
        s = 0
        for c in w:
            if c not in kids[s]:
                kids[s][c] = len(kids)
                kids.append({})
                ids.append(-1)
            s = kids[s][c]
        ids[s] = words[w]
    size = 4 * len(kids) + 4096
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    place, free, span = {0: 0}, 1, 512
    order, at = [0], 0
    while at < len(order):
        s = order[at]
        at += 1
        p = place[s]
        value[p] = ids[s]
        if not kids[s]:
            continue
        codes = np.array(sorted(kids[s]), np.int64)
        while used[free]:
            free += 1
        b, n = max(0, free - int(codes[0]) - 1), span
        while True:  # the first base in the next n under which all codes are free
            if b + n + 512 > len(used):
                grow = len(used)
                used = np.concatenate([used, np.zeros(grow, bool)])
                base, check, value = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([check, np.full(grow, -1, np.int32)]), np.concatenate([value, np.full(grow, -1, np.int32)])
            taken = used[b + int(codes[0]) + 1 : b + int(codes[0]) + 1 + n].copy()
            for c in codes[1:].tolist():
                taken |= used[b + c + 1 : b + c + 1 + n]
            i = int(taken.argmin())
            if not taken[i]:
                b += i
                break
            b, n = b + n, min(2 * n, 1 << 15)
        base[p] = b
        for c in codes.tolist():
            used[b + c + 1] = True
            check[b + c + 1] = p
            place[kids[s][c]] = b + c + 1
            order.append(kids[s][c])
    room = np.zeros(260, np.int32)
    return Trie(np.concatenate([base, room]), np.concatenate([check, room - 1]), np.concatenate([value, room - 1]))


class Unigram:
    """Encodes and decodes with a list of (piece, score, kind)."""

    def __init__(self, pieces: list[tuple[str, float, int]], trie: Trie | None = None):
        self.pieces = pieces
        words = {p.encode(): i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER) and p}
        self.trie = trie or build_trie(words)
        self.scores = np.array([s for _, s, _ in pieces], np.float32)
        self.unknown = np.float32(min((s for _, s, k in pieces if k == NORMAL), default=0.0) - UNKNOWN)
        self.bytes_at = np.full(256, next((i for i, p in enumerate(pieces) if p[2] == UNK), 0), np.int64)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.bytes_at[int(p[3:5], 16)] = i
        self.cuts = not any(MARK in p.lstrip(MARK) for p, _, k in pieces if k in (NORMAL, USER))
        self.by_bytes = {w: (i, self.scores[i]) for w, i in words.items()}
        self.held: dict[str, list] = {}
        self.longest = max(map(len, words), default=1)
        self.known: dict[str, tuple[bytes, float, float, bytes]] = {}
        raw = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNK else p.encode() for p, _, k in pieces]
        self.raw = raw

    def chunks(self, text: str) -> list[str]:
        """The escaped text in parts that no piece crosses."""
        if not text:
            return []
        if not self.cuts:
            return [MARK + text.replace(" ", MARK)]
        parts = text.replace(MARK, " ").split(" ")
        if all(parts):
            return [MARK + p for p in parts]
        out, run = [], ""
        for p in parts:
            run += MARK
            if p:
                out.append(run + p)
                run = ""
        return out + [run] if run else out

    def encode_many(self, texts: list[str | None]) -> list[tuple[np.ndarray, float]]:
        """(ids, score of the best path) of each text."""
        split = [self.chunks(t or "") for t in texts]
        known = self.known
        new = list({c for parts in split for c in parts if c not in known})
        if new:
            known.update(zip(new, self._segment(new)))
        out = []
        for parts in split:
            if not parts:
                out.append((np.zeros(0, "<i4"), 0.0))
                continue
            found = list(map(known.__getitem__, parts))
            ids, scores, leads, _ = zip(*found)
            total = math.fsum(scores)
            # leads count by the sums behind them, of which each is off by half a unit in the last place of the whole
            if min(leads) <= float(np.spacing(np.float32(abs(total) + 1))):
                ids, _, _, costs = zip(*self._settled(parts, found))
                total = math.fsum(np.frombuffer(b"".join(costs), np.float32).tolist())
            out.append((np.frombuffer(b"".join(ids), "<i4"), total))
        if len(known) > KEPT:
            known.clear()
        else:
            for c in new:
                if len(c) >= SHORT:
                    del known[c]
        return out

    def _settled(self, parts: list[str], found: list[tuple]) -> list[tuple]:
        """found, where chunks whose best path may lose by rounding are searched again from the sum so far."""
        out = list(found)
        sums = np.add.accumulate(np.frombuffer(b"".join([f[3] for f in found]), np.float32))
        firsts = np.concatenate(([0], np.cumsum([len(f[3]) // 4 for f in found])))
        before = np.concatenate(([np.float32(0)], sums))[firsts[:-1]]
        lead = np.fromiter([f[2] for f in found], np.float64, len(found))
        may = np.spacing(np.abs(np.concatenate(([np.float32(0)], sums))[firsts[1:]]) + np.float32(1))
        now, at = np.float32(0), -1  # the sum before chunk `at`, once an earlier chunk has taken another path
        for k in np.flatnonzero(lead <= may).tolist():
            if at < 0:
                now = before[k]
            elif k > at:
                between = np.frombuffer(b"".join([f[3] for f in out[at:k]]), np.float32)
                now = np.add.accumulate(np.concatenate(([now], between)), dtype=np.float32)[-1]
                at = k
            other = self._single(parts[k], now)
            if other[0] != out[k][0]:
                out[k], at = other, k
        return out

    def _edges(self, word: bytes) -> list[tuple[int, int, int, np.float32]]:
        """(from, to, id or -1, score) of all pieces in a chunk, by where they begin."""
        n, get, out, at = len(word), self.by_bytes.get, [], 0
        while at < n:
            c = word[at]
            wide = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            found = [(at, end, *hit) for end in range(at + wide, min(n, at + self.longest) + 1) if (hit := get(word[at:end])) is not None]
            if not found or found[0][1] != at + wide:
                found.append((at, at + wide, -1, self.unknown))
            out += found
            at += wide
        return out

    def _single(self, chunk: str, so_far: np.float32) -> tuple[bytes, float, float, bytes]:
        """One chunk's path by single-precision sums that begin with so_far."""
        word = chunk.encode()
        edges = self.held.get(chunk)
        if edges is None:
            if len(self.held) >= KEPT // 10:
                self.held.clear()
            edges = self.held[chunk] = self._edges(word)
        best: dict[int, np.float32] = {0: so_far}
        back: dict[int, tuple] = {}
        for edge in edges:
            score, end = edge[3] + best[edge[0]], edge[1]
            if end not in best or score > best[end]:
                best[end], back[end] = score, edge
        path, at = [], len(word)
        while at:
            path.append(back[at])
            at = back[at][0]
        path.reverse()
        ids = [i for a, b, p, _ in path for i in ([p] if p >= 0 else self.bytes_at[list(word[a:b])].tolist())]
        costs = [e[3] for e in path]
        return np.array(ids, "<i4").tobytes(), float(sum(map(float, costs))), math.inf, np.array(costs, np.float32).tobytes()

    def _segment(self, chunks: list[str]) -> list[tuple[bytes, float, float, bytes]]:
        out: list[tuple[bytes, float, float, bytes]] = []
        for a in range(0, len(chunks), 20_000):
            out += self._viterbi([c.encode() for c in chunks[a : a + 20_000]])
        return out

    def _viterbi(self, words: list[bytes]) -> list[tuple[bytes, float, float, bytes]]:
        """(ids, score, by how much the best path leads at its narrowest choice for each two sums compared there, the cost of each piece) of each chunk."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8).astype(np.int64)  # one more place for each word's end
        firsts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        ends = firsts + sizes
        offset = np.arange(len(text)) - np.repeat(firsts, sizes + 1)
        end_of = np.repeat(ends, sizes + 1)
        head = ((text & 0xC0) != 0x80) & (np.arange(len(text)) < end_of)
        starts = np.flatnonzero(head)
        length = np.where(text[starts] < 0x80, 1, np.where(text[starts] < 0xE0, 2, np.where(text[starts] < 0xF0, 3, 4)))
        state, at, origin = np.zeros(len(starts), np.int64), starts.copy(), np.arange(len(starts))
        edges, single = [], np.zeros(len(starts), bool)
        while len(at):
            step = base[state] + text[at] + 1
            good = check[step] == state
            state, at, origin = step[good], at[good] + 1, origin[good]
            ids = value[state]
            hit = ids >= 0
            edges.append((starts[origin[hit]], at[hit], ids[hit].astype(np.int64)))
            single[origin[hit & (at - starts[origin] == length[origin])]] = True
            more = at < end_of[starts[origin]]
            state, at, origin = state[more], at[more], origin[more]
        lone = starts[~single]
        edges.append((lone, lone + length[~single], np.full(len(lone), -1)))
        src, dst, ids = (np.concatenate([e[i] for e in edges]) for i in range(3))
        cost = np.where(ids < 0, self.unknown, self.scores[ids]).astype(np.float64)
        order = np.argsort(offset[src], kind="stable")
        src, dst, ids, cost = src[order], dst[order], ids[order], cost[order]
        steps = offset[src]
        bounds = np.flatnonzero(np.r_[True, steps[1:] != steps[:-1], True]) if len(steps) else []
        best, back, via = np.full(len(text), -np.inf), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        lead, paid, count = np.full(len(text), np.inf), np.zeros(len(text), np.float32), np.zeros(len(text), np.int64)
        best[firsts] = 0
        for a, b in zip(bounds[:-1], bounds[1:]):
            score, to = best[src[a:b]] + cost[a:b], dst[a:b]
            ahead = score - best[to]
            good = ahead > 0
            adds = count[src[a:b]] + 1
            lead[to] = np.minimum(lead[to], 2 * np.abs(ahead) / (count[to] + adds))
            to = to[good]
            best[to], back[to], via[to], paid[to], count[to] = score[good], src[a:b][good], ids[a:b][good], cost[a:b][good], adds[good]
        here, word, path = ends.copy(), np.arange(len(words)), []
        while len(here):
            go = here > firsts[word]
            here, word = here[go], word[go]
            path.append((word, back[here], here, via[here], paid[here], lead[here]))
            here = back[here]
        word, frm, to, ids, paid, lead = (np.concatenate([p[i] for p in path]) for i in range(6))
        order = np.lexsort((frm, word))
        word, frm, to, ids, paid, lead = word[order], frm[order], to[order], ids[order], paid[order], lead[order]
        reps = np.where(ids < 0, to - frm, 1)
        which = np.repeat(np.arange(len(ids)), reps)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
        final = np.where(ids[which] < 0, self.bytes_at[text[frm[which] + inner]], ids[which]).astype("<i4")
        counts, steps = np.bincount(word[which], minlength=len(words)), np.bincount(word, minlength=len(words))
        flat, cut = final.tobytes(), np.concatenate(([0], np.cumsum(counts))) * 4
        costs, at = paid.tobytes(), np.concatenate(([0], np.cumsum(steps)))
        narrow = np.minimum.reduceat(lead, at[:-1]) if len(lead) else lead
        return [(flat[a:b], z, x, costs[4 * c : 4 * d]) for a, b, c, d, x, z in zip(cut[:-1].tolist(), cut[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), narrow.tolist(), best[ends].tolist())]

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes joined, markers to spaces, without the one put before the text."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


ENCODED = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, score double, decoded_crc32 long, lossless boolean"


def encode_texts(spark: SparkSession, docs: DataFrame, pieces: list[tuple[str, float, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the best path's ids (count, digest as little-endian 32-bit numbers), its score, and the digest of their decoding.

    lossless says whether decoding gives the text back: so it is but for texts that hold the marker
    itself. A null text counts as empty: no ids, score 0; a null id stays null; repeated rows stay;
    other columns are left out; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast((pieces, Unigram(pieces).trie))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(*shared.value)
        is_byte = np.array([k == BYTE for _, _, k in model.pieces])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
        names = [x.split()[0] for x in ENCODED.split(", ")]
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                texts, rows = s.column(1).to_pylist(), []
                for key, text, (ids, score) in zip(s.column(0).to_pylist(), texts, model.encode_many(texts)):
                    back = model.decode(ids.tolist())
                    rows.append((key, len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), score, zlib.crc32(back.encode()), back == (text or "")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string")).mapInArrow(work, ENCODED)
