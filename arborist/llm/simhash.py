"""SimHash near-duplicate search with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most
three bits agree on one segment but for at most one bit. Each segment is indexed once as it is and
once for each of its bits with that bit blanked; fingerprints meet by equality of those keys. Under
a blanked bit only rows with a 0 there meet rows with a 1, so that a pair with equal segments meets
once, under the exact key. Pairs that met are verified by the number of differing bits.

Only distinct fingerprints are indexed, hence a thousand copies cost as much as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, forget, stored
from .components import connected_components

SEED = 42
LANES = 255


def fingerprint_many(texts: list[str | None], words: int = 3, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text; null and wordless texts have 0."""
    digest, parts, sizes = xxhash.xxh64_digest, [], []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        if not w:
            sizes.append(0)
            continue
        joined = b" ".join(w)
        if words == 1:
            grams = w
        elif len(w) <= words:
            grams = [joined]
        else:
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            grams = [joined[a:b] for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())]
        parts.append(b"".join([digest(g, seed) for g in grams]))
        sizes.append(len(grams))
    n = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(n[full])
    at = 0
    for lo in range(0, len(full)):  # bits of one text at a time are counted, eight counters in each machine word
        a, b = at, int(ends[lo])
        at = b
        ones = np.zeros(64, np.int64)
        for s in range(a, b, LANES * 64):
            e = min(b, s + LANES * 64)
            lanes = np.unpackbits(raw[8 * s : 8 * e]).view(np.uint64).reshape(-1, 8)
            sums = np.add.reduceat(lanes, np.arange(0, e - s, LANES), axis=0)
            ones += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[full[lo]] = np.packbits(ones * 2 > b - a).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id long, fp long) for each row; fp holds the 64 bits of the fingerprint.

    Lower-cases A-Z, takes runs of other than ASCII white space as words and hashes every shingle of
    `words` of them, repeats included (a shorter text: all its words; null or none: fingerprint 0).
    A null id stays null; repeated rows stay repeated; other columns are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprint_many(b.column(1).to_pylist(), words, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string")).mapInArrow(work, "doc_id long, fp long")


def _keys(fp: Column, segment: int, ones: bool | None) -> Column:
    """Index keys of one segment: exact (ones is None), or with each 0 (or each 1) bit blanked."""
    seg = F.shiftrightunsigned(fp, 32) if segment else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    if ones is None:
        return F.array(seg.bitwiseOR(F.lit(segment * 33 << 32)))
    keys = [
        F.when(F.shiftright(seg, j).bitwiseAND(F.lit(1)) == int(ones), seg.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j))).bitwiseOR(F.lit((segment * 33 + j + 1) << 32)))
        for j in range(32)
    ]
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def _index(fps: DataFrame, ones: bool) -> DataFrame:
    fp = F.col("fp")
    keys = F.concat(*[_keys(fp, s, o) for s in (0, 1) for o in (None, ones)])
    return fps.select(fp, F.explode(keys).alias("key"))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b) with a < b: the pairs of distinct fingerprints in column fp that differ in 1 to `bits` bits, each once.

    Spark takes the exploded keys, some 33 a fingerprint, for no larger than the fingerprints; the hint keeps
    it from sending them through the driver as a broadcast.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one blanked bit find up to 3 differing bits")
    low, high = _index(fps, False).select(F.col("fp").alias("x"), "key"), _index(fps, True).select(F.col("fp").alias("y"), "key")
    near = low.join(high.hint("merge"), "key").where((F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= bits))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    component_id is the smallest doc_id reachable over links (itself included); rows whose id is null
    take part and count for no minimum, a component of such rows alone has a null. An empty table
    gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(groups.select("fp"), bits)).withColumnRenamed("component", "root")
    rooted = groups.join(found, groups.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


BROADCAST_IDS = 200_000
SHINGLE = 5
SAMPLE, FREQUENT, MOST_FREQUENT = 8_000, 4, 200_000
SKETCH_BITS_EACH = 4
CROWD_SHARE, CROWD, CROWD_BITS, CROWD_PART = 4, 3, 1 << 26, 1 << 15


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (a shorter text: all its words; none: one of the empty string)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)).view(np.int64))


def frequent_shingles(docs: DataFrame, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that FREQUENT or more of about SAMPLE documents share, the MOST_FREQUENT first of them, and classes by how many (half powers of two)."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = b.column(0).slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, words) for t in texts]))], ["g"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    counts = picked.mapInArrow(grams, "g long").groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT)
    found = np.array([(r.g, r.c) for r in counts.orderBy(F.desc("c"), "g").limit(MOST_FREQUENT).collect()], np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    return found[:, 0].copy(), np.floor(2 * np.log2(found[:, 1])).astype(np.int8)


def rarest(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float, crowd: np.ndarray | None = None) -> np.ndarray:
    """The prefix of a sorted shingle set in the one order all sets share: by hash, crowded ones behind, the frequent ones last, by how frequent they are.

    Of two sets x and y that have the similarity t, |x & y| >= t / (1 + t) (|x| + |y|) =: o, so that
    the first |x| - o + 1 of x and the first |y| - o + 1 of y have a shingle in common, whatever the
    order is. No o is below t |x|: floor((1 - t) |x|) + 1 shingles do for every partner.
    """
    late = np.zeros(len(s), np.int8)
    if crowd is not None:
        place = s.view(np.uint64) & np.uint64(CROWD_BITS - 1)
        late[crowd[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7)).astype(np.uint8)) & 1 == 1] = 1
    often, kinds = frequent
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        late = np.where(often[at] == s, 2 + kinds[at], late)
    s = s[np.argsort(late, kind="stable")]
    return s[: int((1 - similarity) * len(s) + 1e-9) + 1]


def crowded(docs: DataFrame, words: int, similarity: float, frequent) -> np.ndarray:
    """A bitmap of CROWD_BITS places: those of shingles that CROWD or more prefixes of one document in CROWD_SHARE hold.

    Any order of the shingles makes prefixes complete, hence neither a sample nor two shingles in one
    place lose a pair; the bitmap's size is fixed, so it may travel with every task.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = b.column(0).slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rarest(shingle_set(t, words), frequent.value, similarity) for t in texts]))], ["g"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(CROWD_PART, np.uint8)
        bits[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("crowd")), F.lit(CROWD_SHARE)) == 0).select("text")
    counts = some.mapInArrow(grams, "g long").groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") >= CROWD)
    place = F.col("g").bitwiseAND(F.lit(CROWD_BITS - 1))
    places = counts.select(F.floor(place / CROWD_PART).cast("int").alias("part"), F.pmod(place, F.lit(CROWD_PART)).cast("int").alias("bit")).distinct()
    out = np.zeros(CROWD_BITS // 8, np.uint8)
    each = CROWD_PART // 8
    for r in places.groupBy("part").applyInPandas(pack, "part int, bits binary").toLocalIterator():
        out[r.part * each : (r.part + 1) * each] = np.frombuffer(r.bits, np.uint8)
    return out


def occupied(s: np.ndarray) -> np.ndarray:
    """A bitmap as longs: the places some hash of the set falls on. It has SKETCH_BITS_EACH bits a hash or more, and 2^k of them, so that it folds."""
    size = max(64, 1 << (SKETCH_BITS_EACH * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[s.view(np.uint64) % np.uint64(size)] = 1
    return np.packbits(bits).view(np.int64)


def _features(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, same, n, bits, prefix): a digest of the shingle set, its size, its occupied bits and its rarest shingles."""
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(frequent_shingles(docs, words))
    crowd = context.broadcast(crowded(docs, words, similarity, frequent))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                sets = [shingle_set(t, words) for t in s.column(1).to_pylist()]
                same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                bits = pa.array([occupied(x) for x in sets], pa.list_(pa.int64()))
                prefix = pa.array([rarest(x, frequent.value, similarity, crowd.value) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(same, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), bits, prefix], ["doc_id", "same", "n", "bits", "prefix"])

    return docs.mapInArrow(work, "doc_id long, same binary, n int, bits array<long>, prefix array<long>")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(cid, s): the shingle sets of the documents named in ids."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([shingle_set(t, words) for t in s.column(1).to_pylist()], pa.list_(pa.int64()))], ["cid", "s"])

    texts = docs.join(few, docs.doc_id == few.cid, "left_semi")
    return stored(texts.mapInArrow(sets, "cid long, s array<long>"), "sets")


def _postings(prints: DataFrame, similarity: float) -> DataFrame:
    """(g, cid, n, at, c, first, band): the place of each shingle in the prefixes that hold it, and how many do, where there are two or more.

    Of shingles that the same prefixes hold (those of a shared passage) the first in the common order
    stands for all: whoever meets under a later one meets under it, at places no later; c counts them
    all. first: the place is in the shorter prefix that is enough against partners of no more shingles.
    band: sizes by powers of 1 / similarity; a pair's bands are equal or neighbours.
    """
    each = prints.select("cid", "n", F.posexplode("prefix").alias("at", "g"))
    n = F.col("n").cast("double")
    first = F.col("at") <= n - F.ceil(2 * similarity / (1 + similarity) * n - 1e-9)
    band = F.floor(F.log(n) / math.log(1 / similarity)).cast("int") if similarity < 1 else F.col("n")
    many = each.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")  # a document is one row under a shingle, at most
    shared = stored(each.join(many, "g", "left_semi").withColumns({"first": first, "band": band}), "shared")
    lead = F.min(F.struct("cid", "at")).alias("lead")
    holders = [F.bit_xor(F.xxhash64("cid", F.lit(x))).alias(f"h{x}") for x in (0, 1)]
    held = shared.groupBy("g").agg(F.count("*").alias("k"), lead, *holders)
    kept = held.groupBy("k", "h0", "h1", "lead.cid").agg(F.min_by("g", "lead.at").alias("g"), (F.count("*") * F.col("k")).alias("c"))
    out = stored(shared.join(kept.select("g", "c"), "g"), "postings")
    forget(shared)
    return out


def _fits(n: str, at: str, m: str, other: str, similarity: float) -> Column:
    """Whether sets of n and m shingles that share the ones at these places can have the similarity, and have these in their pair's prefixes."""
    n, i, m, j = (F.col(x) for x in (n, at, m, other))
    need = F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (i <= n - need) & (j <= m - need)


def _apart(postings: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of all classes the pairs in different components that can have the similarity, each once.

    Within a shingle's postings the components are paired first, by bounds over their members (exact ones
    where each has one member), so that members of one never meet; the smaller set of a pair needs the
    shingle in its shorter prefix, and sizes meet by band.
    """
    rows = postings.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumns({"root": F.coalesce("component", "cid"), "lone": F.col("component").isNull()}).drop("component", "c")
    mixed = rows.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("first").alias("any")).where("lo <> hi and any").select("g")
    rows = stored(rows.join(mixed, "g"), "mixed")
    small = rows.where("first").withColumnsRenamed({"cid": "centre", "n": "m", "at": "there", "root": "r2", "lone": "lone2"}).drop("first")
    large = rows.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).drop("first")
    share = similarity / (1 + similarity)
    room = lambda n, i: F.max((1 - share) * F.col(n) - F.col(i))  # noqa: E731 - by _fits no less than `share` of the other's size
    of_large = large.groupBy("g", "band", "root", "lone").agg(room("n", "at").alias("a"), F.min("n").alias("n"))
    of_small = small.groupBy("g", "band", "r2", "lone2").agg(room("m", "there").alias("b"), F.min("m").alias("m"))
    may = (F.col("a") >= share * F.col("m") - 1e-6) & (F.col("b") >= share * F.col("n") - 1e-6)
    ordered = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("root") > F.col("r2")))
    exact = ordered & (F.col("m") >= similarity * F.col("n") - 1e-9)
    meet = stored(of_large.join(of_small, ["g", "band"]).where((F.col("root") != F.col("r2")) & may & (~(F.col("lone") & F.col("lone2")) | exact)).select("g", "band", "root", "r2", (F.col("lone") & F.col("lone2")).alias("lone")), "meet")
    alone = meet.where("lone").select(F.least("root", "r2").alias("a"), F.greatest("root", "r2").alias("b"))
    met = large.drop("lone").join(meet.where("not lone").drop("lone"), ["g", "band", "root"]).join(small.drop("lone2"), ["g", "band", "r2"])
    met = met.where(((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("cid") > F.col("centre")))) & _fits("n", "at", "m", "there", similarity))
    return met.select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).unionByName(alone).distinct()


def _folded(bits: str, other: str) -> Column:
    """The bitmap at the size of the other where that is smaller (sizes are powers of two, a pair's at most a factor of two apart)."""
    half = F.size(bits) / 2
    low, high = F.slice(bits, F.lit(1), half.cast("int")), F.slice(bits, half.cast("int") + 1, half.cast("int"))
    return F.when(F.size(bits) > F.size(other), F.zip_with(low, high, lambda p, q: p.bitwiseOR(q))).otherwise(F.col(bits))


def _similar(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose shingle sets have the Jaccard similarity.

    Whole sets are fetched for the pairs alone that can have it by their bitmaps: each bit that only
    one of two sets occupies stands for a shingle, at least, that the other lacks.
    """
    side = lambda x: sketches.select(F.col("cid").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, k: t + k)
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumns({"x": _folded("a_bits", "b_bits"), "y": _folded("b_bits", "a_bits")})
    most = F.least(F.col("a_n") - alone("x", "y"), F.col("b_n") - alone("y", "x"))
    fit = (F.size("x") == F.size("y")) & (most >= similarity / (1 + similarity) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    near = stored(both.where(fit).select("a", "b"), "near")
    ids = stored(near.select(F.col("a").alias("cid")).union(near.select("b")).distinct(), "ids")
    grams = _sets(docs, ids, words)
    both = near.join(grams.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(grams.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    good = stored(both.withColumn("i", common).where(F.col("i") >= similarity * (F.size("sa") + F.size("sb") - F.col("i")) - 1e-9).select("a", "b"), "links")
    for done in (grams, ids, near):
        forget(done)
    return good


def _unsettled(rows: DataFrame, best: DataFrame, roots: DataFrame) -> DataFrame:
    """Bucket rows that are not in their centre's group, where two or more are left."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("component").alias(f"{x}_root"))
    after = rows.join(best, "g").withColumn("centre", F.col("top.cid")).join(of("cid"), "cid", "left").join(of("centre"), "centre", "left")
    after = after.where(F.coalesce("cid_root", "cid") != F.coalesce("centre_root", "centre")).select(*rows.columns)
    many = after.groupBy("g").agg(F.count("*").alias("left")).where("left > 1").select("g")
    return stored(after.join(many, "g"), "buckets")


def _one_text_an_id(docs: DataFrame) -> DataFrame:
    """docs with the smallest text of each repeated id; where no id is repeated, docs."""
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return docs
    settled = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(again, "doc_id", "left_anti").unionByName(settled)


def similar_groups(docs: DataFrame, words: int = SHINGLE, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """(doc_id, component_id) over texts whose sets of word shingles have a Jaccard similarity of at least `similarity`.

    The search is exact: texts that have the similarity share one of the rarest shingles of each (see
    rarest), and every link is verified on the whole texts. Large groups are tied first: in each bucket
    of a shingle the member that shares most with others is compared with all the rest; members it is
    linked with need no more comparisons there. After `rounds` such rounds all classes, settled ones
    too, are searched for links between different components. So a group's cost follows its size, and no
    bucket is gathered. Rows without an id are left out; ids that are repeated count once, by the
    smallest text.
    """
    docs = columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string")).where("doc_id is not null")
    docs = _one_text_an_id(docs)
    features = stored(_features(docs, words, similarity), "features")
    seen = stored(features.select("doc_id", "same"), "digests")
    classes = stored(seen.groupBy("same").agg(F.min("doc_id").alias("cid")), "classes")
    prints = stored(features.join(classes, features.doc_id == classes.cid, "left_semi").select(F.col("doc_id").alias("cid"), "n", "bits", "prefix"), "prints")
    forget(features)
    sketches, postings = stored(prints.select("cid", "n", "bits"), "sketches"), _postings(prints, similarity)
    forget(prints)
    ranks = stored(postings.groupBy("cid").agg(F.sum("c").alias("rank")), "ranks")
    rows = postings.drop("c", "first", "band").join(ranks, "cid")
    links, roots = None, rows.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(rounds + 1):
        if turn < rounds:
            best = rows.groupBy("g").agg(F.max(F.struct("rank", "cid", "n", "at")).alias("top"))
            met = rows.join(best, "g").select("cid", "n", "at", F.col("top.cid").alias("centre"), F.col("top.n").alias("m"), F.col("top.at").alias("there"))
            pairs = met.where(_fits("n", "at", "m", "there", similarity) & (F.col("cid") != F.col("centre"))).select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).distinct()
        else:
            pairs = _apart(postings, roots, similarity)
        good = _similar(pairs, sketches, docs, words, similarity)
        if not good.isEmpty():
            links = good if links is None else links.unionByName(good)
            roots = connected_components(links)
        if turn < rounds:
            rows = _unsettled(rows, best, roots)
    # a class goes by its smallest id and a component by its smallest class: no rows are gathered by component
    classes = classes.select("same", F.col("cid").alias("node")).join(roots, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    return seen.select("doc_id", "same").join(classes, "same").select("doc_id", "component_id")


def both_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): texts tied by fingerprints as in near_duplicates, and then by similar_groups, which finds what fingerprints lose.

    A text is in one group with whatever either way links it to, over any number of steps; the
    component is its smallest id. Rows without an id are left out; ids that are repeated count once,
    by the smallest text.
    """
    docs = columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string")).where("doc_id is not null")
    docs = _one_text_an_id(docs)
    found = stored(near_duplicates(docs).select("doc_id", "component_id").unionByName(similar_groups(docs, words, similarity)), "groups")
    tied = connected_components(found.where("doc_id <> component_id"), "doc_id", "component_id")
    return docs.select("doc_id").join(tied, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, by both_groups (the one with the smallest id), and all rows without an id; columns stay."""
    groups = both_groups(docs, id_col, text_col, words, similarity)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    left = docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("__gone"), "left_anti")
    return left
