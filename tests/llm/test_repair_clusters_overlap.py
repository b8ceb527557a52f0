"""Conversation repair, delta Lloyd and winnowing against brute force, SQL twins and awkward rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from arborist.llm import dialogue, lloyd, queries, winnowing

NAMES = ("op11_conversation_repair", "op12_delta_lloyd", "op13_winnowing")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want and want


# Conversation repair


def damaged(rows):
    """Rows (conv_id, turn, role, text) after damage, in plain code."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by a search over all edit sequences in order of cost, then of audit."""
    seen_before, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen_before else "truncated" if bare[-1] not in ".!?" else None)
        seen_before.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, lines, faults
        state = (i, "" if not shape else "s" if shape == "s" else shape[-1])
        if state in done:
            continue
        done.add(state)
        steps = []
        for new in ("user", "assistant"):
            steps.append((5, "I", 0, new[0], (f"{new}:",)))
        if i < len(rows):
            _, _, role, text = rows[i]
            steps.append((2, "D", 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                steps.append((more, "K", 1, role[:1] or "?", (f"{role}:{text}",)))
                steps += [(more + 1, "R", 1, new[0], (f"{new}:{text}",)) for new in ("user", "assistant")]
        for c, e, used, add, line in steps:
            if re.fullmatch("(s?(ua)*u?)?", shape + add):
                heapq.heappush(heap, (cost + c, audit + e, i + used, shape + add, lines + line))
    raise AssertionError


def repaired(rows):
    """The contract's row of every conversation, in plain code."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == conv])
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        cost, audit, lines, faults = cheapest(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(mine)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversations():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "ünï"]
    texts = ["Yes.", "No!", "what", "", None, " \t\n", "Yes.", "end. ", "a. ", "ß?", "Hm.\n\x0b", "end ", "x" * 3000 + "."]
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.randrange(0, 9)):
            turn = rng.choice([turn, turn, turn, None, 2 * turn, 1])
            rows += [(conv, turn, rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    rows += [(777, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 5}.") for t in range(200)]
    rows += [(778, None, None, None)] * 5 + [(779, t, None, None) for t in range(4)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [None, 13, 150])
def test_repair_matches_a_search_over_all_edits(spark, parts):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", part string, n int").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in dialogue.repair(dialogue.damage(df), parts).collect()}
    assert got == repaired(rows)


def test_one_long_conversation_in_many_ranges(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c", f"{t}.", f"{t}"])) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (dialogue.repair(dialogue.damage(df), parts).collect() for parts in (1, 40))
    assert one == many and len(one) == 1
    kept = dialogue.repaired_turns(dialogue.damage(df), 40).orderBy("part", "position").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in kept)
    assert hashlib.sha256(text.encode()).hexdigest() == one[0].repaired_sha256
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))


def test_every_conversation_has_a_row_and_no_rows_make_none(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)
    assert [tuple(r) for r in dialogue.repair(dialogue.damage(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert dialogue.repair(dialogue.damage(df.limit(0))).collect() == []
    named = spark.createDataFrame([("a", 1, "user", "b."), (None, 1, "assistant", "c.")], "conv_id string, turn int, role string, text string")
    assert {r.conv_id for r in dialogue.repair(dialogue.damage(named), 3).collect()} == {"a", None}


# Delta Lloyd


def plain_lloyd(rows, k=16, rounds=3, dim=64):
    import math

    kept = [(i, [math.floor(64 * float(np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"1:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    cents = [list(kept[j][1]) for j in order[:k]]
    x = np.array([v for _, v in kept], object).reshape(-1, dim)

    def nearest():
        d = [[int(((v - np.array(c, object)) ** 2).sum()) for c in cents] for v in x]
        return [min(range(len(cents)), key=lambda j: (r[j], j)) for r in d], [min(r) for r in d]

    for _ in range(rounds):
        owner, _ = nearest()
        for j in range(len(cents)):
            mine = [v for v, o in zip(x, owner) if o == j]
            if mine:
                cents[j] = [int(s) // len(mine) for s in sum(mine)]
    owner, dist = nearest()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    per = [sum(d for d, o in zip(dist, owner) if o == j) for j in range(len(cents))]
    return sorted([(i, o, d, per[o], sum(dist), digest[o]) for (i, _), o, d in zip(kept, owner, dist)], key=repr)


def vectors(rng, n, scale=1.0):
    base = rng.normal(size=(5, 64))
    return [(base[i % 5] * (1 if i % 7 else 0) + rng.normal(size=64) * 0.05 * (i % 3)) * scale for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 0.01, 200_000.0])
def test_delta_lloyd_equals_plain_lloyd(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(rng, 120, scale))]
    rows += [(i, rows[i][1]) for i in (3, 3, 8)] + [(None, rows[4][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("-inf")] * 64)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, owner int").repartition(5)
    got = sorted((tuple(r) for r in lloyd.clusters_with_inertia(df).collect()), key=repr)
    assert got == plain_lloyd(rows)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in lloyd.clusters_with_inertia(df).collect()), key=repr) == plain_lloyd(rows)
    assert lloyd.clusters_with_inertia(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="too large"):
        lloyd.clusters_with_inertia(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_a_round_compares_no_more_than_what_changed():
    rng = np.random.default_rng(4)
    x, cents = rng.integers(-60, 60, (500, 8)), rng.integers(-60, 60, (6, 8))
    owner, dist = lloyd.reassign(x, np.full(500, -1, np.int32), np.zeros(500, np.int64), cents, np.ones(6, bool))
    moved = np.array([False, True, False, False, True, False])
    after = cents.copy()
    after[moved] += rng.integers(-20, 20, (2, 8))
    met = []
    plain = lloyd.squared_distances
    lloyd.squared_distances = lambda a, b: (met.append(a.shape[0] * b.shape[0]), plain(a, b))[1]
    try:
        now, near = lloyd.reassign(x, owner, dist, after, moved)
    finally:
        lloyd.squared_distances = plain
    d = plain(x, after)
    assert (now == d.argmin(1)).all() and (near == d.min(1)).all()
    stay = int((~moved[owner]).sum())
    assert sum(met) == stay * 2 + (500 - stay) * 6


# Winnowing


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, met = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    met |= windows[tuple(w[i : i + n])]
        ids = sorted(str(i) for i in met if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contaminated_texts():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "日本", "don't", "a-b", "x"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([30, 12, 10, 11, 25, 9, 5, 4, 1, 10])]
    items += [(20, None), (21, ""), (22, " -- !"), (23, items[0][1]), (0, say(14)), (None, say(12)), (24, "x x x x x x x x x x x x")]
    docs = [(i, say(rng.randrange(0, 60))) for i in range(40)]
    for i, (_, text) in enumerate(items):
        if text:
            docs.append((100 + i, f"{say(20)} {text.upper()}, {say(7)}"))
            docs.append((200 + i, f"{text}\n\x0b{text}"))
            docs.append((300 + i, text[3:]))
    docs += [(400, None), (401, ""), (402, "!"), (None, items[1][1]), (100, items[2][1]), (100, items[2][1]), (403, "x " * 3000), (404, say(30_000) + " " + items[4][1])]
    docs += [(405, "y" * 3_000_000 + " " + items[0][1]), (406, " ".join(items[0][1].split()[:9])), (407, " ".join(items[0][1].split()[5:15]))]
    return docs, items


def test_winnowing_finds_every_shared_window(spark):
    docs, items = contaminated_texts()
    d = spark.createDataFrame([(*r, "a", 1, []) for r in docs], "doc_id long, text string, words string, rid int, prints array<int>").repartition(4)
    b = spark.createDataFrame([(*r, "b") for r in items], "item_id long, text string, wid string")
    got = winnowing.contamination(d, b)
    assert sorted((tuple(r) for r in got.drop("spans").collect()), key=repr) == plain_contamination(docs, items)
    spans = got.where("contaminated").select("doc_id", "n_hit", "spans").collect()
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_hit and all(a["to"] < b["from"] for a, b in itertools.pairwise(r.spans)) for r in spans)


def test_a_full_bitmap_only_costs_time(spark):
    docs, items = contaminated_texts()
    docs = [d for d in docs if len(d[1] or "") < 5000]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    few = winnowing.contaminated_spans(d, b, bits=1 << 15)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, winnowing.contaminated_spans(d, b).collect()))


def test_winnowing_without_items_or_documents(spark):
    d, b = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in winnowing.contamination(d, b.limit(0)).collect()) == [(1, 3, 0, False), (2, 0, 0, False)]
    assert winnowing.contamination(d.limit(0), b).collect() == []


def test_a_shared_span_shares_a_fingerprint():
    import pyarrow as pa

    rng = random.Random(1)
    shared = " ".join(rng.choice("abcdefgh") for _ in range(10))
    powers = winnowing.Powers()
    for _ in range(50):
        text = " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30))) + " " + shared + " " + " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))
        w = winnowing.Words(pa.array([text]), powers)
        assert set(winnowing.Words(pa.array([shared]), powers).winnow(10)[1].tolist()) <= set(w.winnow(10)[1].tolist())


def test_words_of_many_texts_are_those_of_each(spark):
    import pyarrow as pa

    texts = [None, "", "Ab-c dÉf", "x", "日本 語!9a", "Z" * 100]
    w = winnowing.Words(pa.array(texts), winnowing.Powers())
    assert w.counts.tolist() == [len(words_of(t)) for t in texts]
    assert [w.window(i, 1).decode() for i in range(len(w.starts))] == [x for t in texts for x in words_of(t)]
    assert len(set(w.hashes.tolist())) == len({x for t in texts for x in words_of(t)})


