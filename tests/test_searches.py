"""Searches inside the tasks: their tokeniser, and what they leave where it is."""

import time

import numpy as np
import pyarrow as pa
import pytest
from arborist.functions import split
from arborist.functions import text as T
from arborist.operators import retrieval as R
from arborist.operators import tree as X

ODD = ["", "a", "é", "中文abc한글 x_y", "😀𝐀𝐁 ab", " ", "ab", "cd", "ΑΣ ΑΣ. İI ß", "x\x00y٣٤", "No. 5, of 12\nlines", "日本", "z"]


@pytest.mark.parametrize("tokenizer", [T.long_words, T.word_set, T.tokens_cjk])
def test_a_batch_is_cut_as_spark_cuts_a_text(spark, sf, tokenizer):
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", "text").unionByName(odd)
    held = docs.selectExpr("lower(text) AS low", "text").select("low", tokenizer("text").alias("t")).toArrow().combine_chunks()
    low, want = held.column("low").combine_chunks(), held.column("t").to_pylist()
    read = R._reader(docs, tokenizer)
    for most in (1, 300, 1 << 22):
        found = [read(low[a:z]) for a, z in split.pieces(low, most)]
        got = [t for tokens, _ in found for t in tokens.to_pylist()]
        assert [list(dict.fromkeys(t)) if tokenizer is T.word_set else t for t in got] == want
        assert np.concatenate([n for _, n in found]).tolist() == [len(t) for t in want]
    assert len(read(pa.array([], pa.string()))[0]) == 0


def test_sections_of_a_long_text_take_linear_time(spark):
    """A text of 120,000 words: it was split anew for each section."""
    text = " ".join(f"w{i}" for i in range(120_000))
    began = time.monotonic()
    rows = X.chunk_words(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ord").collect()
    assert " ".join(r.text for r in rows) == text and len(rows) == 300
    assert time.monotonic() - began < 8


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_found_documents_are_fetched_without_moving_the_texts(spark, sf):
    from arborist.plans import queries as Q

    docs = Q.docs(spark, sf)
    found = R.bm25(docs, Q.asked(spark, sf), 2)
    said = plan(R.only(docs, found))
    assert "BroadcastHashJoin" in said and "SortMergeJoin" not in said
    assert {r.doc_id for r in R.only(docs, found).collect()} == {r.doc_id for r in found.collect()}


def test_trigrams_are_made_where_they_are_scored(spark, sf):
    """They went to the tasks of a second step, eight bytes a character."""
    from arborist.plans import queries as Q

    assert plan(Q.trigram_topk(spark, sf)).count("MapInArrow") == 1


def test_scoring_some_documents_counts_terms_in_all(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3}x common word{i}") for i in range(12)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w0x word4"), (2, "common")], "query_id long, text string")
    some = docs.where("doc_id < 5")
    every = {(r.query_id, r.doc_id): r.score for r in R.bm25(docs, asked, None).collect()}
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25(docs, asked, None, scored=some).collect()}
    assert got == {k: v for k, v in every.items() if k[1] < 5} and got
    assert "MapInArrow" in plan(R.bm25(docs, asked, None, scored=some))


def test_leaders_of_a_long_group_take_linear_time(spark):
    """1,500 items without common words: each was held against all items before it, word set by word set."""
    from arborist.operators import context as C

    rows = [(7, i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(1500)] + [(7, 1500, " ".join(f"w900x{j}" for j in range(60))), (8, 0, ""), (8, 1, None), (None, 0, "some words")]
    items = spark.createDataFrame(rows, "grp long, ord int, text string")
    C.leaders(items.where("grp = 8"), 0.5).collect()
    began = time.monotonic()
    got = {(r.grp, r.ord): r.leader for r in C.leaders(items, 0.5).collect()}
    assert time.monotonic() - began < 20
    assert got == {(g, i): 900 if i == 1500 else i for g, i, _ in rows} and dict(C.leaders(items, 0.5).dtypes)["grp"] == "bigint"


def test_a_key_waits_with_one_timer():
    """Each request had its own timer and map entry, about ten calls to the state store."""
    from types import SimpleNamespace as N

    from arborist.streaming import expiry

    class Store:
        def __init__(self):
            self.timers, self.calls, self.rows, self.one = [], 0, [], None

        def getListState(self, *_):  # noqa: N802 - Spark's names
            return N(appendList=lambda x: self.count(self.rows.extend(x)), get=lambda: self.count(iter(list(self.rows))), put=lambda x: self.count(self.keep(x)), clear=lambda: self.count(self.keep([])))

        def getValueState(self, *_):  # noqa: N802
            return N(get=lambda: self.count(self.one), update=lambda x: self.count(setattr(self, "one", x)), clear=lambda: self.count(setattr(self, "one", None)))

        def registerTimer(self, ms):  # noqa: N802
            self.count(self.timers.append(ms))

        def keep(self, rows):
            self.rows = list(rows)

        def count(self, value):
            self.calls += 1
            return value

    store, p = Store(), expiry.Lookups(60.0, "after")
    p.init(store)
    s = 1_000_000
    list(p.handleInputRows(("k",), iter([N(us=t * s, id=t) for t in (200, 10, 70, 30, 71, 100)]), None))
    fire = lambda ms, now: [(r.id, r.hit) for r in p.handleExpiredTimer(("k",), N(getCurrentWatermarkInMs=lambda: now), N(getExpiryTimeInMs=lambda: ms))]
    assert store.timers == [10_000] and store.calls == 2
    assert fire(10_000, 100_000) == [(10, False), (30, True), (70, True), (71, False)]  # what is at the watermark itself may still be joined by others
    assert store.timers[1:] == [100_000, 131_002] and [i for _, i in store.rows] == [100, 200] and store.calls <= 8
    assert fire(100_000, 500_000) == [(100, True), (200, False)] and store.rows == []
    assert fire(260_002, 500_000) == [] and store.one is None
