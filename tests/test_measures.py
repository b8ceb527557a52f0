"""Text similarity, exact tests, resampling, versioned tables, the embedding index, expiring entries and experiments against plain code."""

import hashlib
import math
import random
import threading
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborist.operators import evaluation as E
from arborist.operators import experiments as X
from arborist.operators import graph as G
from arborist.operators import metrics as M
from arborist.operators import power as P
from arborist.operators import quantiles as Q
from arborist.operators import ranker
from arborist.operators import resampling as B
from arborist.operators import retrieval as R
from arborist.operators import service as S
from arborist.operators import similarity as Y
from arborist.operators import statistics as Z
from arborist.operators import training as L
from arborist.operators import tree as T
from arborist.sources import datasets, sinks
from arborist.sources.embedding_index import EmbeddingIndex
from arborist.sources.sessions import SessionStore
from arborist.sources.shared import shared_dir
from arborist.sources.versions import VersionedTable
from arborist.streaming import expiry


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


# similarity

PAIRS = [
    (1, "the cat sat on the mat", "the cats sat on a mat"), (2, "", ""), (3, "some text", ""), (4, None, "x"), (5, "!!", "??"), (6, "same words here", "same words here"),
    (7, "심장 박동 검사", "심장 검사 결과"), (8, "abc " * 3000, "abd xyz"), (9, "hypertension and gel", "HYPERTENSION"), (10, "초음파 漢字", "漢 字"),
]


def plain_bertscore(pairs, idf=True):
    import re

    toks = [[re.findall("[0-9A-Za-z가-힣]+|[一-鿿]", (t or "").lower()) for t in p[1:]] for p in pairs]
    df = Counter(t for r, _ in toks for t in set(r))
    weight = lambda t: math.log((len(pairs) + 1) / (df[t] + 1)) if idf else 1.0

    def vector(t):
        return Counter(hashlib.md5(f"^{t}$"[i : i + 3].encode()).digest()[-1] for i in range(len(t)))

    def cosine(a, b):
        x, y = vector(a), vector(b)
        return sum(x[k] * y[k] for k in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    def mean(own, other):
        best = {t: max(cosine(t, o) for o in set(other)) for t in set(own)}
        w = {t: weight(t) for t in best}
        if sum(w.values()) <= 0:
            w = dict.fromkeys(best, 1.0)
        n = Counter(own)
        return sum(best[t] * w[t] * n[t] for t in best) / sum(w[t] * n[t] for t in best)

    out = {}
    for (key, *_), (r, h) in zip(pairs, toks):
        if not r or not h:
            out[key] = (float(not r and not h),) * 3
            continue
        p, q = mean(h, r), mean(r, h)
        out[key] = (p, q, 2 * p * q / (p + q) if p + q else 0.0)
    return out


@pytest.mark.parametrize("idf", [True, False])
def test_bertscore_is_greedy_alignment(spark, idf):
    df = spark.createDataFrame(PAIRS, "k int, r string, h string")
    got = {x.k: (x.precision, x.recall, x.f1) for x in Y.bertscore(df, "k", "r", "h", idf=idf).collect()}
    want = plain_bertscore(PAIRS, idf)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6), k


def test_bertscore_takes_any_embedder_and_falls_back(spark):
    df = spark.createDataFrame(PAIRS, "k int, r string, h string")

    def letters(tokens):
        return np.array([[t.count(c) + 1e-9 for c in "abcdefghij"] for t in tokens])

    got = {x.k: x.f1 for x in Y.bertscore(df, "k", "r", "h", letters).collect()}
    assert got[6] == got[1] == 1.0 and 0 < got[8] < 1 and got[3] == 0.0 and got[2] == 1.0
    fallback = {x.k: x.f1 for x in Y.bertscore(df, "k", "r", "h", None).collect()}
    assert fallback[1] == pytest.approx(2 * (4 / 6) * (4 / 6) / (8 / 6)) and fallback[2] == fallback[5] == 1.0 and fallback[3] == fallback[4] == 0.0
    assert fallback[7] == pytest.approx(2 / 3, abs=1e-6)


def test_best_matches_goes_by_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(70, 8)), rng.normal(size=(45, 8))
    monkeypatch.setattr(Y, "BLOCK", 16)
    x, y = Y.best_matches(a, b)
    assert np.allclose(x, (a @ b.T).max(1)) and np.allclose(y, (a @ b.T).max(0))


def test_evaluate_gives_every_metric_and_refuses_unknown_ones(spark):
    df = spark.createDataFrame(PAIRS, "k int, r string, h string")
    rows = {r.k: r.asDict() for r in Y.evaluate(df, "k", "r", "h").collect()}
    assert set(rows[1]) == {"k", *Y.METRICS} and len(rows) == len(PAIRS)
    assert rows[9]["entity_recall"] == 0.5 and rows[6]["exact_match"] == 1.0
    with pytest.raises(ValueError, match="unknown metrics"):
        Y.evaluate(df, "k", "r", "h", ("bleu",))


# exact tests


def t_density(x, v):
    return math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)


def test_student_t_equals_published_quantiles_and_integrals():
    table = {1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 5: 2.570582, 10: 2.228139, 20: 2.085963, 30: 2.042272, 60: 2.000298, 120: 1.979930}
    assert P.critical_t(0.05, np.array(list(table), float)) == pytest.approx(list(table.values()), abs=1e-6)
    assert P.critical_t(0.01, np.array([5.0, 30.0])) == pytest.approx([4.032143, 2.749996], abs=1e-6)
    for v in (1, 3, 8, 50):
        x = np.linspace(0, 2.5, 200_001)
        y = np.array([t_density(z, v) for z in x[::100]])
        area = float(((y[1:] + y[:-1]) / 2).sum() * (x[100] - x[0]))
        assert P.two_sided_p(np.array([2.5]), np.array([v]))[0] == pytest.approx(1 - 2 * area, abs=1e-5)
    assert np.isnan(P.two_sided_p(np.array([1.0, np.nan]), np.array([0, 5]))).all()
    assert P.two_sided_p(np.array([0.0, np.inf]), np.array([5, 5])).tolist() == [1.0, 0.0]


def test_power_equals_published_values_and_simulation():
    # Two-sided paired t test at 5 %, as in published tables.
    assert P.power(np.array([0.5, 0.2, 0.8]), np.array([34, 199, 15])) == pytest.approx([0.807778, 0.801692, 0.821311], abs=1e-6)
    assert P.power(np.array([0.0]), np.array([20]))[0] == pytest.approx(0.05, abs=1e-9)
    assert np.isnan(P.power(np.array([0.5, np.nan]), np.array([1, 9]))).all() and P.power(np.array([200.0]), np.array([10_000]))[0] == 1.0
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200_000, 6)) + 0.9
    t = x.mean(1) / (x.std(1, ddof=1) / math.sqrt(6))
    assert P.power(np.array([0.9]), np.array([6]))[0] == pytest.approx((np.abs(t) > 2.570582).mean(), abs=0.004)


def test_power_in_pieces_is_the_same(monkeypatch):
    d, n = np.array([0.1, 0.5, 2.0, 0.3, 1.0]), np.array([400, 12, 50, 9, 1000])
    whole = P.power(d, n)
    monkeypatch.setattr(P, "TERMS", 100)
    assert P.power(d, n) == pytest.approx(whole, abs=1e-14)


def test_groups_without_a_test_have_none(spark):
    rows = [("one", 1, 2.0, 1.0), ("equal", 1, 1.0, 1.0), ("equal", 2, 3.0, 3.0), ("shift", 1, 2.0, 1.0), ("shift", 2, 3.0, 2.0), *[("many", i, float(i % 7), float(i % 5)) for i in range(30)]]
    got = {r.g: r for r in P.with_power(P.paired_t_exact(spark.createDataFrame(rows, "g string, key int, a double, b double"), ("g",))).collect()}
    assert got["one"].t is None and got["one"].p is None and got["one"].power is None
    assert got["equal"].t == 0.0 and got["equal"].p == 1.0 and got["shift"].t is None and got["shift"].p is None
    d = np.array([i % 7 - i % 5 for i in range(30)], float)
    assert got["many"].t == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(30)), abs=1e-6) and 0 < got["many"].power < 1


# resampling


def test_resampling_does_not_depend_on_partitions_and_is_right(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(1.0, 2.0), rng.gauss(0.5, 2.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "key int, a double, b double")
    one, many = B.bootstrap(df.coalesce(1), "key", 1500).first(), B.bootstrap(df.repartition(7), "key", 1500).first()
    assert tuple(one) == pytest.approx(tuple(many), abs=1e-9)
    d = np.array([a - b for _, a, b in rows])
    se = d.std(ddof=1) / 20
    assert one.low == pytest.approx(d.mean() - 1.96 * se, abs=0.3 * se) and one.high == pytest.approx(d.mean() + 1.96 * se, abs=0.3 * se)
    assert one.d_z == pytest.approx(d.mean() / d.std(ddof=1)) and one.d_z_low < one.d_z < one.d_z_high
    p, q = B.permutation(df, "key", 1500).first(), B.permutation(df.repartition(5), "key", 1500).first()
    assert p.p == q.p and p.p == pytest.approx(float(P.two_sided_p(np.array([d.mean() / se]), np.array([399]))[0]), abs=0.02)


def test_draws_have_their_distributions():
    keys = np.arange(2000, dtype=np.uint64) * np.uint64(7919)
    w = B.poisson_weights(keys, 3, 200, 1)
    assert w.shape == (200, 2000) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert (B.poisson_weights(keys, 0, 10, 1)[4] == B.poisson_weights(keys, 4, 1, 1)[0]).all()
    s = B.sign_flips(keys, 0, 130, 1)
    assert set(np.unique(s)) == {-1.0, 1.0} and abs(s.mean()) < 0.01 and abs(np.corrcoef(s[0], s[1])[0, 1]) < 0.1
    assert (B.sign_flips(keys, 70, 40, 1) == s[70:110]).all()


# versions, sessions


def test_two_writers_lose_nothing(spark, folder):
    failed = []

    def write(who):
        try:
            for i in range(4):
                table = VersionedTable(spark, folder, "who string, i int")
                table.update(lambda old, i=i: old.unionByName(spark.sql(f"SELECT '{who}' AS who, {i} AS i")))
        except Exception as why:  # noqa: BLE001 - reported below
            failed.append(why)

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = VersionedTable(spark, folder, "who string, i int")
    assert not failed and table.current() == 8
    assert sorted((r.who, r.i) for r in table.read().collect()) == [(w, i) for w in "ab" for i in range(4)]
    assert table.read(3).count() == 3 and table.read(0).count() == 0
    assert not table.swap(7, table.read()) and table.current() == 8
    assert table.forget(2) == 6 and table.versions() == [7, 8]


def test_sessions_are_replaced_merged_and_deleted(spark, folder):
    store = SessionStore(spark, folder)
    rows = lambda *ids: spark.createDataFrame([(i, f'{{"n":"{i}"}}') for i in ids], "session_id string, session string")
    assert store.load()[0].collect() == [] and store.load()[1] is None
    store.save(rows("a", "b"), "missing")
    assert store.load()[1] is None
    store.merge(rows("b", "c"), "c")
    store.merge(rows("d"))
    got, now = store.load()
    assert sorted(r.session_id for r in got.collect()) == ["a", "b", "c", "d"] and now == "c"
    store.delete(rows("c"))
    assert store.load()[1] is None and store.load()[0].count() == 3


# embedding index


def texts(spark, n=40, change=()):
    return spark.createDataFrame([(i, f"text number {i} {'new' if i in change else 'old'}") for i in range(n)] + [(None, "no id"), (n + 1, None)], "doc_id long, text string")


def test_index_embeds_only_what_changed(spark, folder):
    asked = []

    def embed(df):
        asked.append(df.count())
        return R.dense(df, "doc_id", "v")

    index = EmbeddingIndex(spark, folder, embed, parts=8)
    first = index.refresh(texts(spark))
    assert (first.status, first.version, first.rebuilt) == ("created", 1, first.parts) and asked == [40]
    assert index.refresh(texts(spark).repartition(5)).status == "existing" and asked == [40]
    after = index.refresh(texts(spark, change={7}))
    assert (after.status, after.rebuilt) == ("created", 1) and 0 < asked[1] < 40
    assert index.vectors().count() == 40 and index.vectors(version=1).count() == 40
    fewer = index.refresh(texts(spark, 39, change={7}))
    assert fewer.status == "created" and index.vectors().count() == 39
    best = index.search(spark.createDataFrame([(1, "text number 7 new")], "query_id int, text string"), 1).first()
    assert best.doc_id == 7 and best.score == 1.0
    other = EmbeddingIndex(spark, folder, embed, "another embedder", parts=8)
    assert other.refresh(texts(spark, 39, change={7})).rebuilt == first.parts
    assert other.delete() and not other.manifest.versions()


def test_index_says_why_it_failed_and_keeps_what_it_has(spark, folder):
    index = EmbeddingIndex(spark, folder, parts=4)
    assert index.refresh(texts(spark, 0)).status == "failed"
    assert index.refresh(texts(spark)).status == "created"
    wrong = EmbeddingIndex(spark, folder, lambda d: R.dense(d, "doc_id", "v", 256), "x", 128, 4).refresh(texts(spark))
    assert wrong.status == "failed" and "dimension" in wrong.error

    def broken(df):
        raise RuntimeError("no model")

    failed = EmbeddingIndex(spark, folder, broken, "y", 256, 4).refresh(texts(spark))
    assert (failed.status, failed.error) == ("failed", "no model")
    assert index.refresh(texts(spark)).status == "existing" and index.vectors().count() == 40


# ranking among near ties


def test_near_ties_rank_alike_on_both_ways(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 1) * 1e-5 for x in base]) for i in range(300)] + [(1000 + i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    q = v.where("vec_id % 50 = 0")
    matrix = sorted(map(tuple, R.vector_topk(q, v).collect()))
    monkeypatch.setattr(R, "QUERY_SLICE", 3)
    monkeypatch.setattr(R, "DOC_SLICE", 17)
    assert sorted(map(tuple, R.vector_topk(q, v).collect())) == matrix
    monkeypatch.setattr(R, "FEW_QUERIES", 2)
    assert sorted(map(tuple, R.vector_topk(q, v).collect())) == matrix
    own = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    ids = [d for _, d, _, _ in (r for r in matrix if r[0] == 0)]
    want = sorted((i for i in own if i), key=lambda i: (-math.floor(own[0] @ own[i] * 1e6 + 0.5), i))[:10]
    assert sorted(ids) == sorted(want)


# expiring entries


def plain_expiry(rows, ttl, rule):
    made, out = {}, {}
    for key, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        live = key in made and (t - made[key] <= ttl if rule == "after" else t - made[key] < ttl)
        out[i] = live
        if not live:
            made[key] = t
    return out


@pytest.mark.parametrize("rule", expiry.RULES)
def test_stream_equals_the_fold_whatever_the_batches_and_restarts(spark, folder, rule):
    rng = random.Random(8)
    rows = [(rng.choice("abcde"), i, 1_700_000_000 + rng.randrange(0, 4000)) for i in range(300)] + [("z", 1000, 1_700_000_000), ("z", 1001, 1_700_000_060), ("z", 1002, 1_700_000_120)]
    rng.shuffle(rows)
    schema = "key string, id long, t long"
    as_stream = lambda d: d.select("key", "id", F.timestamp_seconds("t").alias("ts"))
    old = spark.conf.get(expiry.PROVIDER, None)
    expiry.with_rocks(spark)
    try:
        for n, part in enumerate((rows[:100], rows[100:200], rows[200:])):
            part = part + [(None, 5000 + n, 1_700_000_000)] + ([("end", -1, 4_000_000_000)] if n == 2 else [])
            as_stream(spark.createDataFrame(part, schema)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema("key string, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            found = expiry.run_available(expiry.expiring_hits(stream, 60, rule, "2 hours"), f"{folder}/out", f"{folder}/check")
        got = {r.id: r.hit for r in found.collect()}
        assert found.count() == len(got)
    finally:
        spark.conf.unset(expiry.PROVIDER) if old is None else spark.conf.set(expiry.PROVIDER, old)
    assert got == plain_expiry(rows, 60, rule)
    assert got[1001] == (rule == "after")
    with pytest.raises(ValueError, match="rule"):
        expiry.expiring_hits(found, 1, "never")


# trees


def test_deep_trees_and_nodes_without_ids(spark):
    deep = ""
    for i in range(130, 0, -1):
        deep = '{"title":"t%d"%s}' % (i, f',"children":[{deep}]' if deep else "")
    rows = spark.createDataFrame([(1, deep), (2, '{"id":"r","children":[{"children":[{"id":"x"},{"title":"y"}]},{"id":"b"}]}'), (3, "{broken"), (4, None)], "doc_id int, tree string")
    nodes = T.flatten(spark, rows)
    got = {r.node_id: r.parent_id for r in nodes.where("doc_id = 2").collect()}
    assert got == {"r": None, "node_0.0": "r", "x": "node_0.0", "node_0.0.1": "node_0.0", "b": "r"}
    assert nodes.where("doc_id = 1").agg(F.max("depth")).first()[0] == 129 and nodes.where("doc_id > 2").count() == 0
    orphans = nodes.where("parent_id is not null").join(nodes.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_anti")
    assert orphans.count() == 0


# experiments

TEXTS = {1: "alpha beta gamma delta " * 250, 2: "heart rate and blood pressure. " * 90, 3: ""}


def study(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    asked = [(10, 1, "alpha beta?", "alpha beta", "a"), (11, 2, "blood pressure", "blood pressure", "b"), (12, 3, "nothing", "nothing", "a"), (13, 2, "", "x", None)]
    return T.section_tree(docs), spark.createDataFrame(asked, "question_id long, doc_id long, question string, expected string, category string")


def test_a_run_goes_on_after_an_interruption(spark, folder):
    nodes, q = study(spark)
    e = X.Experiment(spark, folder)

    def interrupted(*_):
        raise KeyboardInterrupt

    some = {"bm25": X.bm25, "treerag_dfs": X.tree_dfs, "dense": interrupted, "raptor": X.raptor}
    with pytest.raises(KeyboardInterrupt):
        e.run(nodes, q, some)
    assert e.finished("bm25") and e.finished("treerag_dfs", 4) and not e.finished("dense") and not e.finished("raptor")
    before = sorted(map(repr, e.results().collect()))
    assert e.run(nodes, q, {**some, "dense": X.dense}) == ["dense", "raptor"]
    assert sorted(map(repr, e.results(["bm25", "treerag_dfs"]).collect())) == before
    assert e.run(nodes, q, {**some, "dense": X.dense}) == []
    assert e.run(nodes, q.limit(3), {"bm25": X.bm25}) == ["bm25"], "results for other questions are not whole"


def test_judging_again_swaps_one_column(spark, folder):
    nodes, q = study(spark)
    e = X.Experiment(spark, folder)
    e.run(nodes, q, {"bm25": X.bm25, "treerag_beam": X.tree_beam})
    plain = sorted(map(repr, e.results().drop("llm_judge").collect()))
    assert {r.llm_judge for r in e.results().collect()} == {None}
    assert e.judge(q, F.lit(0.5)) == 1 and e.judge(q, F.length("answer") * 0.0 + 0.25, ["bm25"]) == 2
    assert {(r.system, r.llm_judge) for r in e.results().collect()} == {("bm25", 0.25), ("treerag_beam", 0.5)}
    assert sorted(map(repr, e.results().drop("llm_judge").collect())) == plain
    s = {r.system: r for r in X.summary(e.results()).collect()}
    assert s["bm25"].n == 4 and s["bm25"].llm_judge == 0.25 and s["bm25"].dfs_fraction is None


def test_all_systems_answer_every_question(spark, folder):
    nodes, q = study(spark)
    e = X.Experiment(spark, folder)
    assert e.run(nodes, q) == list(X.SYSTEMS)
    rows = e.results().collect()
    assert len(rows) == 4 * len(X.SYSTEMS) and {r.system for r in rows} == set(X.SYSTEMS)
    by = {(r.system, r.question_id): r for r in rows}
    assert by[("bm25", 13)].retrieved == [] and by[("treerag_dfs", 12)].answer == "" and by[("raptor", 13)].retrieved_count > 0
    assert by[("treerag_auto", 12)].chosen == "dfs" and by[("bm25", 10)].chosen is None
    assert all(r.context_tokens == len(r.answer) // 4 for r in rows)
    sig = {r.system: r for r in X.significance(e.results()).collect()}
    assert set(sig) == set(X.SYSTEMS) - {"treerag_beam"} and sig["bm25"].n == 4
    gold = spark.createDataFrame([(10, "d1.1"), (11, "d2.1")], "question_id long, node_id string")
    pages = spark.createDataFrame([(10, "1")], "question_id long, page string")
    cases = X.case_metrics(e.results(), gold, pages)
    names = {r.metric for r in cases.select("metric").distinct().collect()}
    assert names == {*(f"{m}@{k}" for m in ("precision", "recall", "f1") for k in (1, 3, 5)), "ndcg@3", "ndcg@5", "answer_length", "context_size", "citation_accuracy"}
    whole = {(r.system, r.metric): r for r in X.report(cases).where("whole").collect()}
    assert whole[("treerag_dfs", "recall@3")].n == 2 and whole[("raptor", "recall@5")].mean == 0.0 and whole[("bm25", "answer_length")].n == 4
    grid = {(r.system, r.branches, r.k): r for r in X.ablation_grid(nodes, q, gold, {"dfs": X.tree_dfs, "bm25": X.bm25}, (1, 3)).collect()}
    assert {(s, b) for s, b, _ in grid} == {("dfs", 1), ("dfs", 3), ("bm25", 1), ("bm25", 3)} and grid[("bm25", 3, 3)].recall >= grid[("bm25", 1, 3)].recall


# quantiles


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_quantiles_are_exact_without_gathering_a_group(spark, monkeypatch, most):
    rng = random.Random(4)
    monkeypatch.setattr(Q, "MOST", most)
    rows = [("a", rng.gauss(0, 1)) for _ in range(2500)] + [("b", float(rng.randrange(4))) for _ in range(700)] + [("one", 3.5), ("none", None), (None, 1.0), (None, 2.0), ("same", 7.0), ("same", 7.0), ("skew", 1e9)] + [("skew", 0.001 * i * i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    got = {r.g: r for r in M.latency(df, ("g",)).collect()}
    assert got["none"].n == 0 and got["none"].median is None and set(got) == {"a", "b", "one", "none", None, "same", "skew"}
    near = {r.g: r.nearest for r in M.nearest_rank(df, ("g",)).collect()}
    for g in ("a", "b", "one", None, "same", "skew"):
        x = np.array(sorted(v for k, v in rows if k == g and v is not None))
        for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert got[g][name] == pytest.approx(float(np.percentile(x, 100 * p)), abs=2e-6), (g, name)
        assert near[g] == x[min(int(len(x) * 0.95), len(x) - 1)]


# learning to rank


def plain_loss(pos, negs, w, b, kind):
    s = lambda f: 1 / (1 + math.exp(-(sum(x * y for x, y in zip(w, f)) + b)))
    p, d = s(pos), len(w)
    loss, g, h = 0.0, [0.0] * d, 0.0
    if kind in ("bpr", "hinge"):
        for f in negs:
            gap = p - s(f)
            pull = 1 / (1 + math.exp(gap)) if kind == "bpr" else float(0.1 - gap > 0)
            loss += -math.log(max(1 - pull, 1e-10)) if kind == "bpr" else max(0, 0.1 - gap)
            g = [a + pull * (f[i] - pos[i]) for i, a in enumerate(g)]
            h -= pull
        n = len(negs)
        return loss / n, [x / n for x in g], h / n
    up = p - 1 if kind == "cross_entropy" else 2 * (p - 1) * p * (1 - p)
    loss = -math.log(max(p, 1e-10)) if kind == "cross_entropy" else (p - 1) ** 2
    g, h = [up * x for x in pos], up
    for f in negs:
        q = s(f)
        down = q if kind == "cross_entropy" else 2 * q * q * (1 - q)
        loss += -math.log(max(1 - q, 1e-10)) if kind == "cross_entropy" else q * q
        g = [a + down * f[i] for i, a in enumerate(g)]
        h += down
    n = 1 + len(negs)
    return loss / n, [x / n for x in g], h / n


@pytest.mark.parametrize("kind", L.LOSSES)
def test_losses_and_gradients_equal_plain_loops(kind):
    rng = random.Random(6)
    vec = lambda: [rng.gauss(0, 1) for _ in range(5)]
    pos, negs = [vec() for _ in range(7)], [[vec() for _ in range(rng.randrange(1, 5))] for _ in range(7)]
    w, b = vec(), 0.3
    owner = np.repeat(np.arange(7), [len(n) for n in negs])
    loss, g, h = L.losses(np.array(pos), np.array([f for n in negs for f in n]), owner, np.array(w), b, kind)
    for i in range(7):
        want = plain_loss(pos[i], negs[i], w, b, kind)
        assert loss[i] == pytest.approx(want[0]) and g[i].tolist() == pytest.approx(want[1]) and h[i] == pytest.approx(want[2])


def test_training_equals_plain_loops_and_does_not_depend_on_partitions(spark, folder):
    rng = random.Random(7)
    rows = []
    for q in range(40):
        for n in range(6):
            good = n == 0 or (n == 1 and q % 5 == 0)
            rows.append((q, f"n{n}", n, good, [rng.gauss(1.0 if good else 0.0, 0.5), rng.gauss(0, 1), rng.random()]))
    rows += [(100, "alone", 0, True, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id int, node_id string, ord int, relevant boolean, features array<double>")
    given = L.examples(df, 3)
    assert given.count() == 48
    start = L.Ranker([0.1, -0.2, 0.3])
    args = {"epochs": 3, "batches": 3, "rate": 0.3, "start": start, "patience": 5}
    model = L.train(given, **args)
    tags = given.select("example", "pos", "negs", F.pmod(F.xxhash64("example", F.lit(42)), F.lit(1000)).alias("u"), *[F.pmod(F.xxhash64("example", F.lit(e), F.lit(42)), F.lit(3)).alias(f"b{e}") for e in (1, 2, 3)]).collect()
    w, b, history = [0.1, -0.2, 0.3], 0.0, []
    for e in (1, 2, 3):
        seen = []
        for k in range(3):
            some = [plain_loss(r.pos, r.negs, w, b, "bpr") for r in tags if r.u >= 200 and r[f"b{e}"] == k]
            seen.append(sum(x[0] for x in some) / len(some))
            w = [x - 0.3 * (sum(s[1][i] for s in some) / len(some) + 0.01 * x) for i, x in enumerate(w)]
            b -= 0.3 * sum(s[2] for s in some) / len(some)
        val = [plain_loss(r.pos, r.negs, w, b, "bpr")[0] for r in tags if r.u < 200]
        history.append((sum(seen) / len(seen), sum(val) / len(val)))
    assert model.weights == pytest.approx(w) and model.bias == pytest.approx(b)
    assert np.allclose([(h["train_loss"], h["val_loss"]) for h in model.history], history)
    again = L.train(given.repartition(7), **args)
    assert again.weights == pytest.approx(model.weights)
    assert model.save(spark, folder) == 1 and again.save(spark, folder) == 2
    assert L.Ranker.load(spark, folder, 1) == model
    score = L.quality(given, model).first()
    assert score.n == 48 and 0.5 < score.accuracy <= 1 and score.mrr >= score.accuracy
    assert len(L.train(given, epochs=30, batches=2, rate=-0.5, start=start, patience=2).history) == 3, "a loss that only grows stops the training"
    assert L.train(given.limit(0), start=start).history == []
    with pytest.raises(ValueError):
        L.Ranker.load(spark, folder + "-none")


def test_ranking_features_follow_their_rules(spark):
    rows = [(1, "p", "red fish swim", "red red fish blue", 1, 2, 0.25, "red things", "fish here"), (1, "p", "red fish swim", "nothing", 2, 2, None, None, None), (2, "p", "", "x", 0, 0, 0.0, "x", "x")]
    df = spark.createDataFrame(rows, "query_id int, parent_id string, query string, text string, depth int, max_depth int, position double, parent_text string, child_text string")
    a, b, c = (r.features for r in ranker.features(df).orderBy("query_id", F.desc(F.length("text"))).collect())
    part = lambda tf: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 4 / 100))
    assert a == pytest.approx([2 / 4, 1 - 0.2 / 2, 2 / 3, (part(2) + part(1)) / 6.6, 0.75, 1 / 4, 0.0, 1 / 3])
    assert b == pytest.approx([0.0, 1 - 1.2 / 2, 0.0, 0.0, 0.0, 0.0, 0.5, 0.0]) and c == pytest.approx([0.0, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0])


# graphs and small rules


def test_graphs_are_built_with_types_and_directions(spark):
    tree = '{"id":"r","children":[{"id":"a","title":"red fish"},{"id":"b","title":"red fish swim"},{"id":"c","title":"fish red"},{"id":"d","title":"other"}]}'
    nodes = T.flatten(spark, spark.createDataFrame([(1, tree)], "doc_id long, tree string"))
    got = {(r.src, r.dst, r.edge_type): (r.confidence, r.bidirectional) for r in G.build(nodes, least=0.6).collect()}
    down = {("r", x, "parent_child"): (1.0, False) for x in "abcd"}
    assert got == down | {("a", "b", "elaboration"): (pytest.approx(2 / 3, abs=1e-6), False), ("c", "b", "elaboration"): (pytest.approx(2 / 3, abs=1e-6), False), ("a", "c", "elaboration"): (1.0, True), ("c", "a", "elaboration"): (1.0, True)}
    judged = lambda a, b: F.struct(F.when(a.contains("other") | b.contains("other"), "contrast").otherwise("none").alias("relationship"), F.lit(0.9).alias("confidence"), F.lit("b_to_a").alias("direction"))
    edges = G.build(nodes, judged)
    assert {(r.src, r.dst) for r in edges.where("edge_type = 'contrast'").collect()} == {("d", "b"), ("d", "c")}
    titles = nodes.select(F.col("node_id").alias("node"), F.when(F.col("title") == "", "Root").otherwise(F.col("title")).alias("title"))
    asked = spark.createDataFrame([("r", "b"), ("d", "c"), ("a", "b"), ("a", "a"), ("a", "zz")], "a string, b string")
    said = {(r.a, r.b): (r.connected, r.path_length, r.explanation) for r in G.explain(edges, titles, asked).collect()}
    assert said == {
        ("r", "b"): (True, 1, "'red fish swim' is a section of 'Root'"), ("d", "c"): (True, 1, "'other' contrasts with 'fish red'"),
        ("a", "b"): (False, -1, G.APART), ("a", "a"): (True, 0, G.SAME),
    }


def test_system_tests_name_a_winner_only_where_it_is_sure(spark):
    rng = random.Random(1)
    rows = [(s, q, rng.random() + shift, 0.5) for q in range(60) for s, shift in (("a", 0.0), ("b", 0.01), ("c", 0.6))]
    got = {(r.first, r.second, r.metric): r for r in E.pairwise_tests(spark.createDataFrame(rows, "system string, query_id int, x double, y double"), ("x", "y")).collect()}
    assert got[("a", "c", "x")].winner == "c" and got[("a", "b", "x")].winner is None and got[("a", "b", "y")].p == 1.0 and got[("a", "b", "y")].ties == 60
    assert got[("a", "c", "x")].wins + got[("a", "c", "x")].losses == 60 and got[("a", "c", "x")].p < 1e-5


def test_places_by_range_are_those_of_one_sort(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1.0, 1.0, 2.0, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key int, v double").repartition(6)
    want = {k: n + 1 for n, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.key: r.place for r in Z.place(df, F.col("v"), "key", "place").collect()} == want


def test_questions_are_filtered_and_sources_found(spark):
    q = spark.createDataFrame([(1, 1, "red fish?", "Medical", "easy"), (2, 1, "blue", "legal", "hard"), (3, 2, "", None, None)], "question_id int, doc_id int, question string, domain string, difficulty string")
    ids = lambda d: sorted(r.question_id for r in d.collect())
    assert ids(S.filter_questions(q)) == [1, 2, 3] and ids(S.filter_questions(q, ("medical",))) == [1] and ids(S.filter_questions(q, None, ("HARD", "easy"))) == [1, 2] and ids(S.filter_questions(q, ("legal",), ("easy",))) == []
    nodes = spark.createDataFrame([(1, "a", [0], "red", "red red"), (1, "b", [0, 0], "fish", "red"), (1, "c", [0, 1], None, "fish"), (2, "d", [0], "red", "fish")], "doc_id int, node_id string, path_ord array<int>, title string, summary string")
    assert [(r.question_id, r.node_id, r.n) for r in S.source_nodes(nodes, q, 2).orderBy("question_id", "rank").collect()] == [(1, "b", 2), (1, "a", 1)]
    hits = spark.createDataFrame([(1, "3"), (1, ""), (2, None), (2, "")], "question_id int, page_ref string")
    assert {r.question_id: r.available for r in X.citation_available(hits).collect()} == {1: True, 2: False}


# question sets and files


def test_items_and_reports_become_trees_questions_and_qrels(spark, tmp_path):
    import json

    items = [
        {"_id": "q1", "type": "bridge", "level": "hard", "question": "who?", "answer": "x", "supporting_facts": [["A", 0]], "context": [["A", ["one ", "two"]], ["B", ["three"]]]},
        {"_id": "q2", "type": "comparison", "level": "easy", "question": "which?", "answer": "y", "supporting_facts": [["Z", 0]], "context": [["C", ["four"]]]},
    ]
    (tmp_path / "items.json").write_text(json.dumps(items))
    nodes, q, rel = datasets.multi_hop_benchmark(spark, str(tmp_path / "items.json"), None)
    assert {(r.doc_id, r.node_id, r.title, r.page_ref) for r in nodes.collect()} == {("q1", "ROOT", "who?", "1-2"), ("q1", "SEC0", "A", "1"), ("q1", "SEC1", "B", "2"), ("q2", "ROOT", "which?", "1-1"), ("q2", "SEC0", "C", "1")}
    assert {(r.question_id, r.difficulty) for r in q.collect()} == {("q1", "hard"), ("q2", "medium")}
    assert {tuple(r) for r in rel.collect()} == {("q1", "SEC0"), ("q2", "SEC0")}, "without a supporting title all are relevant"
    nodes, q, rel = datasets.report_benchmark(spark.createDataFrame([(1, "w " * 801, "s"), (2, "", None), (3, None, "t")], "doc_id int, report string, summary string"), None)
    assert nodes.groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 4), (2, 2), (3, 2)] and rel.count() == 5 and q.count() == 3
    assert datasets.report_benchmark(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("a b").alias("report"), F.lit("s").alias("summary")), 4)[1].count() == 4
    (tmp_path / "set.json").write_text(json.dumps({"version": "1", "questions": [{"question_id": "a", "document_id": "d", "question": "q?", "expected_sections": ["s"], "difficulty": "easy"}]}))
    row = datasets.load_dataset(spark, str(tmp_path / "set.json")).first()
    assert (row.question_id, row.question, row.expected_sections, row.category) == ("a", "q?", ["s"], None)
    assert datasets.load_dataset(spark, " Known ", {"known": lambda s: s.range(3)}).count() == 3


def test_graphs_reports_and_tables_come_back(spark, tmp_path):
    from arborist.sources import readers

    nodes = T.section_tree(spark.createDataFrame([(1, "red fish " * 500), (2, "")], "doc_id long, text string"))
    edges = G.build(nodes)
    sinks.save_graphs(nodes, edges, str(tmp_path / "g"))
    n, e = sinks.load_graphs(spark, str(tmp_path / "g"))
    key = lambda d, *c: sorted(map(repr, d.select(F.col("doc_id").cast("string"), *c).collect()))
    assert key(n, "node_id", "title", "summary", "page_ref", "depth") == key(nodes, "node_id", "title", "summary", "page_ref", "depth")
    assert key(e, "src", "dst", "edge_type", "confidence", "bidirectional") == key(edges, "src", "dst", "edge_type", "confidence", "bidirectional")
    rows = spark.createDataFrame([("b", 2, 0.5, 'say "x"'), ("a", 1, None, "é\n,"), ("b", 1, 0.25, None)], "system string, question_id int, rouge_l double, answer string")
    sinks.save_report(rows, str(tmp_path / "r"))
    back = readers.report_rows(spark, str(tmp_path / "r"), "question_id int, rouge_l double, answer string")
    assert sorted(map(repr, back.select(*rows.columns).collect())) == sorted(map(repr, rows.collect()))
    sinks.save_csv(rows.where("answer is not null"), str(tmp_path / "c"))
    again = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c"))
    assert sorted(r.answer for r in again.collect()) == ['say "x"', "é\n,"]


def test_searches_are_scored_in_their_tasks_as_by_joins(spark, monkeypatch):
    """No pair of a query and a text leaves a task but the best ones: there is no join over pairs; more queries than travel go by joins, with equal results."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "é", "漢字", "x"]) + str(rng.randrange(9)) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.choice([0, 1, 5, 40]))) for i in range(150)] + [(900, "ab"), (901, None), (None, "alpha1 beta2")], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, text(8)) for i in range(12)] + [(50, ""), (51, "ab")], "query_id long, text string")
    nodes = docs.where("doc_id is not null").selectExpr("concat('d', doc_id) AS node_id", "cast(doc_id % 3 AS int) AS depth", "coalesce(text, '') AS text")
    searches = {
        "bm25": lambda: R.bm25(docs, queries, 4), "raw": lambda: R.bm25(docs, queries, 4, binary=False), "candidates": lambda: R.bm25_candidates(docs, queries, 7), "trigram": lambda: R.trigram(docs, queries, 3),
        "jaccard": lambda: R.best_overlap(docs, queries, k=4), "share": lambda: R.best_overlap(docs, queries, "share", least=0.25), "f1": lambda: R.token_f1_nodes(nodes, queries, 3),
    }
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    found = {n: f() for n, f in searches.items()}
    got = {n: rows(df) for n, df in found.items()}
    assert all(got.values()) and not [n for n, df in found.items() if "Join" in df._jdf.queryExecution().executedPlan().toString()]
    monkeypatch.setattr(R, "PIECE", 40)
    monkeypatch.setattr(R, "DOC_SLICE", 17)
    assert {n: rows(f()) for n, f in searches.items()} == got
    monkeypatch.setattr(R, "FEW_PAIRS", 0)
    assert {n: rows(f()) for n, f in searches.items()} == got
