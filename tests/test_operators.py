"""Operators without SQL twins against plain Python, and fixed expectations."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from arborist.functions import text as T
from arborist.functions import vector as V
from arborist.operators import context as C
from arborist.operators import graph as G
from arborist.operators import grounding as H
from arborist.operators import metrics as M
from arborist.operators import ranker as L
from arborist.operators import retrieval as R
from arborist.operators import service as S
from arborist.operators import statistics as Z
from arborist.operators import traverse as W
from arborist.operators import tree as X
from arborist.sources import readers
from arborist.streaming import limits

TREE = {
    "id": "root", "title": "Guide", "summary": "All of it", "page_ref": "1-30",
    "children": [
        {"id": "a", "title": "Quality control", "summary": 'Tests "quoted"', "page_ref": "1-9", "children": [{"id": "a1", "title": "Section 1.1: Scope", "summary": "see Table 2", "text": "x"}, {"id": "a2", "title": "Limits", "summary": "", "children": []}]},
        {"id": "b", "title": "Safety", "summary": "Risks"},
    ],
}


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first().x


def test_text_primitives(spark):
    t = "The café, 第2章: Don't STOP  now"
    assert one(spark, T.words("t", 1), t=t) == ["the", "café", "第2章", "don", "stop", "now"]
    assert one(spark, T.white_space_tokens("t"), t=" A  b\nc ") == ["a", "b", "c"]
    assert one(spark, T.char_ngrams("t"), t="aB  cab c") == ["ab ", "b c", " ca", "cab", "ab ", "b c"][:4] and one(spark, T.char_ngrams("t"), t="ab") == ["ab"] and one(spark, T.char_ngrams("t"), t="") == []
    assert one(spark, T.word_ngrams(T.words("t"), 2), t="a b c") == ["a b", "b c"] and one(spark, T.word_ngrams(T.words("t"), 2), t="a") == []
    assert one(spark, T.char_windows("t"), t="x" * 30) == ["x" * 15] * 3
    assert one(spark, T.language("t"), t="한글") == "ko" and one(spark, T.language("t"), t="漢字") == "ja"
    assert one(spark, T.model_answer("t"), t='```json\n{"answer": "yes"}\n```') == "yes" and one(spark, T.model_answer("t"), t='{"answer": "cut o') in ('{"answer": "cut o', "cut o")
    assert one(spark, V.hash_bucket(F.col("t")), t="abc") == 114
    assert one(spark, T.normalised("t"), t="A, b!  C.") == "a b c"


def test_word_pairs_and_windows_take_linear_time(spark):
    """A text of 20,000 words: the words were taken anew for each pair, and each window was sought from the text's start."""
    began = time.monotonic()
    text = " ".join(f"w{i}é" for i in range(20_000))
    assert one(spark, T.word_ngrams(T.words("t"), 3), t=text)[-1] == "w19997é w19998é w19999é"
    windows = one(spark, T.char_windows("t"), t=text)
    assert windows == [text[i : i + 15] for i in range(0, len(text) - 14, 7)]
    assert time.monotonic() - began < 20


def test_trees_flatten_and_come_back(spark):
    trees = spark.createDataFrame([("d", json.dumps(TREE)), ("broken", "{")], "doc_id string, tree string")
    nodes = X.flatten(spark, trees).cache()
    rows = nodes.orderBy("pre_order").collect()
    assert [r.node_id for r in rows] == ["root", "a", "a1", "a2", "b"] and [r.depth for r in rows] == [0, 1, 2, 2, 1]
    assert [r.parent_id for r in rows] == [None, "root", "a", "a", "root"]
    back = json.loads(X.rebuild(nodes).first().tree)
    assert [c["id"] for c in back["children"]] == ["a", "b"] and back["children"][0]["summary"] == 'Tests "quoted"' and "summary" not in back["children"][0]["children"][1]
    assert X.outline(nodes).first().outline.splitlines()[1] == '  - Quality control: Tests "quoted"'
    assert X.violations(nodes).count() == 0 and X.violations(nodes.unionByName(nodes.where("node_id = 'b'"))).first().problem == "repeated id"
    keys = C.reference_keys(nodes)
    refs = C.detect_references(spark.createDataFrame([("d", "As Section 1.1 and Table 9 say")], "doc_id string, text string"))
    got = {(r.kind, r.number): r.node_id for r in C.resolve_references(refs, keys).collect()}
    assert got == {("section", "1.1"): "a1", ("table", "9"): None}
    pages = X.marked_pages(spark.createDataFrame([(1, "--- PAGE 1 ---\nfirst\n--- PAGE 2 ---\n\n--- [Page 3] ---\nthird")], "doc_id int, text string"))
    assert {(r.page, r.text) for r in pages.collect()} == {(1, "first"), (3, "third")}


def test_leader_merge_and_budget_match_plain_loops(spark):
    rng = random.Random(1)
    items, chunks = [], []
    for g in range(20):
        for i in range(rng.randrange(1, 9)):
            items.append((g, i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=3))))
            chunks.append((g, i, rng.randrange(5) / 4, rng.randrange(1, 80)))
    got = {(r.grp, r.ord): r.leader for r in C.leaders(spark.createDataFrame(items, "grp int, ord int, text string"), 0.5).collect()}
    want = {}
    for g in range(20):
        lead = []
        for _, i, t in sorted(x for x in items if x[0] == g):
            s = set(t.split())
            hit = next((k for k, o in lead if len(s & o) / len(s | o) >= 0.5), None)
            if hit is None:
                lead.append((i, s))
            want[(g, i)] = i if hit is None else hit
    assert got == want
    taken = {(r.grp, r.ord): r.taken for r in C.budget(spark.createDataFrame(chunks, "grp int, ord int, score double, n_tokens long"), 60).collect()}
    for g in range(20):
        total, stop = 0, False
        for _, i, s, n in sorted((x for x in chunks if x[0] == g), key=lambda x: (-x[2], x[1])):
            take = not stop and (total + n <= 60 or total == 0)
            stop = stop or (take and n > 60)
            total += n if take else 0
            assert taken[(g, i)] == take


def test_rate_limiter_and_cache_fold(spark):
    assert S.admit([0, 1, 2, 3, 11], 2, 10) == [(True, 0), (True, 0), (False, 9), (False, 8), (True, 0)]
    log = spark.createDataFrame([(1, t, i) for i, t in enumerate([0.0, 1.0, 2.0, 3.0, 11.0])] + [(2, 5.0, 9)], "user_id long, ts double, event_id long")
    assert [r.allowed for r in S.rate_limit(log, "user_id", "ts", "event_id", 2, 10.0).orderBy("user_id", "event_id").collect()] == [True, True, False, False, True, True]
    hits = S.ttl_hits(log, "user_id", "ts", 2.5, "event_id").orderBy("user_id", "event_id").collect()
    assert [r.hit for r in hits] == [False, True, True, False, False, False]


def test_streaming_limiter(spark, tmp_path):
    spark.createDataFrame([(1, i, float(i)) for i in range(6)], "user_id long, event_id long, s double").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(f"{tmp_path}/in")
    q = limits.rate_limited(stream, 2, 3.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert [r.allowed for r in spark.table("limited").orderBy("event_id").collect()] == [ok for ok, _ in S.admit([float(i) for i in range(6)], 2, 3.0)]


def test_streaming_limiter_keeps_state_in_a_slow_stream(spark, tmp_path):
    for part, rows in enumerate([[(1, 0, 0.0), (1, 1, 0.2)], [(2, 2, 0.3)], [(1, 3, 0.4), (1, 4, 1.3)]]):
        spark.createDataFrame(rows, "user_id long, event_id long, s double").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = limits.rate_limited(stream, 2, 1.0).writeStream.format("memory").queryName("slow").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(90)
    q.stop()
    assert [(r.event_id, r.allowed, r.retry_after) for r in spark.table("slow").orderBy("event_id").collect()] == [(0, True, 0), (1, True, 0), (2, True, 0), (3, False, 1), (4, True, 0)]


def test_exact_traversal(spark):
    trees = spark.createDataFrame([(7, json.dumps(TREE))], "doc_id long, tree string")
    nodes = X.flatten(spark, trees)
    q = spark.createDataFrame([(1, "quality control limits")], "query_id long, text string")
    routes = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 7)], "query_id long, doc_id long")
    assert {r.node_id for r in W.traverse_exact(nodes, q, "beam", routes).collect()} == {"a1", "a2", "b"}
    dfs = {r.node_id: r for r in W.traverse_exact(nodes, q, "dfs", routes).collect()}
    assert all(not r.recovered or r.path.startswith("[RECOVERED] ") for r in dfs.values())
    with pytest.raises(ValueError):
        W.traverse_exact(nodes, q, "beam", routes, levels=11)


def tau(base, selected, total, length, depth):
    fr = 0.0 if total == 0 else 1 - selected / total
    rate = -0.15 if fr > 0.9 else -0.10 if fr > 0.7 else 0.10 if fr < 0.3 else 0.0
    return base + rate + (0.10 if length < 10 else -0.05 if length > 100 else 0.0) + (-0.05 if depth <= 1 else 0.05 if depth >= 4 else 0.0)


def plain_share(query, node):
    import re

    terms = {w for w in re.split(r"\s+", query.lower()) if w} - set(T.QUESTION_WORDS)
    body = f"{node['title']} {node['summary']}".lower()
    return sum(t in body for t in terms) / len(terms) if terms else 0.5


def plain_gate(query, node):
    import re

    keys = [w for w in re.findall(r"\w+", query.lower()) if len(w) > 2]
    if not keys:
        return 0.7 * 0.5 + 0.3 * 0.3
    part = lambda c: sum(k in node[c].lower() for k in keys) / len(keys)
    return 0.7 * 0.5 + 0.3 * (0.4 * part("title") + 0.6 * part("summary"))


def plain_beam(tree, query, width, levels, base):
    front, chosen, visited = [(tree, 1.0, tree["title"], 0)], [], 0
    for depth in range(levels):
        grown = []
        for node, score, path, _ in front:
            visited += 1
            if node["children"] and depth < levels - 1:
                for c in node["children"]:
                    own = 0.6 * 0.5 + 0.2 * plain_share(query, c) + 0.2 * max(0.3, 1.0 - 0.1 * (depth + 1))
                    grown.append((c, score * own, f"{path} > {c['title']}", depth + 1))
            elif score >= tau(base, len(chosen), visited, len(query), depth):
                chosen.append((node["id"], path, depth, score))
        if not grown:
            break
        front = sorted(grown, key=lambda x: -x[1])[:width]
    for node, score, path, depth in front:
        if node["id"] not in {c[0] for c in chosen} and score >= tau(base, len(chosen), visited, len(query), depth):
            chosen.append((node["id"], path, depth, score))
    return sorted((i, p, d, round(s, 9), False) for i, p, d, s in chosen)


def plain_dfs(tree, query, branches, levels, base):
    import re

    stack, chosen, rejected, pops = [(tree, 0, "")], [], [], 0
    while stack:
        node, depth, above = stack.pop()
        pops += 1
        if depth >= levels:
            continue
        path = f"{above} > {node['title']}" if above else node["title"]
        gate = plain_gate(query, node)
        thin = len(node["summary"]) < 20 and len(node["title"]) < 10
        if depth and (thin or not gate > tau(base, len(chosen), pops, len(query), depth)):
            rejected.append((node, path, gate))
            continue
        if not node["children"] or depth >= levels - 1:
            chosen.append((node["id"], path, depth, round(gate, 9), False))
        stack += [(c, depth + 1, path) for c in reversed(node["children"][:branches])]
    n, m = len(chosen), len(rejected)
    if (n == 0 and m >= 1) or (n < 2 and m > 2 * n):
        critical = {w for w in re.findall(r"\w+", query.lower()) if len(w) > 3}
        good = []
        for node, path, gate in rejected:
            hits = sum(w in node["title"].lower() for w in critical)
            if hits >= 2 or (hits >= 1 and len(node["title"].split()) >= 3):
                good.append((node["id"], f"[RECOVERED] {path}", 1, round(gate, 9), True))
        chosen += good[:3]
    return sorted(chosen)


def test_traversal_over_all_pairs_equals_plain_traversal(spark):
    rng = random.Random(11)
    words = ["quality", "control", "limits", "risk", "safety", "scope", "of", "the", "annex", "review"]
    say = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randrange(a, b)))

    def grow(name, depth):
        kids = [grow(f"{name}.{i}", depth + 1) for i in range(rng.choice([0, 1, 2, 4, 6] if depth else [3, 5]))] if depth < 6 and rng.random() < 0.75 ** max(0, depth - 1) else []
        return {"id": name, "title": say(1, 5), "summary": say(0, 12), "children": kids}

    trees = {i: grow(f"t{i}", 0) for i in range(14)}
    asked = {1: "quality control limits", 2: "the of", 3: "safety risk review annex scope " * 5, 4: "is", 5: "review of safety and quality in scope"}
    nodes = X.flatten(spark, spark.createDataFrame([(i, json.dumps(t)) for i, t in trees.items()], "doc_id long, tree string"))
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    routes = q.select("query_id").crossJoin(spark.createDataFrame([(i,) for i in trees], "doc_id long"))
    for algorithm, plain, ways in (("beam", plain_beam, ({"width": 5, "levels": 5, "base": 0.2}, {"width": 2, "levels": 3, "base": 0.05})), ("dfs", plain_dfs, ({"branches": 3, "levels": 5, "base": 0.5}, {"branches": 2, "levels": 4, "base": 0.42}))):
        for way in ways:
            got = {}
            for r in W.traverse_exact(nodes, q, algorithm, routes, **way).collect():
                got.setdefault((r.query_id, r.doc_id), []).append((r.node_id, r.path, r.depth, round(r.score, 9), r.recovered))
            want = {(k, i): plain(t, text, *way.values()) for k, text in asked.items() for i, t in trees.items()}
            assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}, (algorithm, way)


def test_korean_forms(spark):
    row = spark.sql("SELECT '초음파의 원리와 심장에서는 blood pressure 측정을 나는' AS t").select(T.critical_keywords("t").alias("k"), T.question_terms("t").alias("q"), T.content_tokens("t").alias("c")).first()
    assert row.k == ["초음파", "원리", "심장", "blood", "pressure", "측정", "나는"]
    assert row.q == ["초음파의", "원리와", "심장에서는", "blood", "pressure", "측정을", "나는"]
    assert spark.sql("SELECT '에서 the Cat 의 is a 고양이 에' AS t").select(T.content_tokens("t").alias("c"), T.question_terms("t").alias("q")).first() == (["cat", "고양이"], ["cat", "고양이"])
    assert spark.sql("SELECT 'to be or not that question' AS t").select(T.critical_keywords("t").alias("k")).first().k == ["that", "question"]


def test_paths_on_a_chain(spark):
    e = spark.createDataFrame([("A", "B", "temporal", 0.9), ("B", "C", "temporal", 0.9), ("C", "D", "temporal", 0.9), ("C", "A", "temporal", 0.5)], "src string, dst string, edge_type string, confidence double")
    got = {"-".join(r.path): (round(r.confidence, 3), r.kind) for r in G.best_paths(e, spark.createDataFrame([("A", 1.0)], "node string, confidence double"), 4).collect()}
    assert got == {"A-B": (0.9, "temporal_sequence"), "A-B-C": (0.81, "temporal_sequence"), "A-B-C-D": (0.729, "temporal_sequence")}
    hop = G.shortest_paths(e, spark.createDataFrame([("A", "D"), ("D", "A"), ("B", "B")], "a string, b string")).collect()
    assert {(r.a, r.b): r.n_hops for r in hop} == {("A", "D"): 3, ("B", "B"): 0}


def test_known_metric_values(spark):
    run = spark.createDataFrame([("s", 1, f"d{i}", i) for i in range(1, 6)], "system string, query_id long, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, d) for d in ("d1", "d3", "d5", "d7")], "query_id long, doc_id string")
    m = {r.k: r for r in M.rank_metrics(run, qrels).collect()}
    assert (m[1].precision, m[5].precision, m[1].recall, m[5].recall, m[5].rr) == (1.0, 0.6, 0.25, 0.75, 1.0)
    assert m[5].f1 == 0.666667 and m[5].ap == 0.566667 and m[5].ndcg == 0.73659
    c = H.calibration(spark.createDataFrame([(0.8, True), (0.8, False), (0.2, False), (0.2, True)], "confidence double, correct boolean")).first()
    assert c.brier == 0.34
    p = Z.corrections(spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.02, 0.03, 0.04, 0.10])], "id int, p double"), "id").orderBy("id").collect()
    assert [r.bh_forward for r in p] == [0.05, 0.05, 0.05, 0.05, 0.1]
    a = spark.createDataFrame([(u, v) for u in range(6) for v in (u * 1.0, u * 1.0)], "unit int, value double")
    assert M.krippendorff(a).first().alpha == 1.0 and math.isnan(M.krippendorff(a.limit(0)).first().alpha)
    r = M.rouge_l(spark.createDataFrame([(1, "the cat sat on the mat", "the cat on a mat"), (2, "", "x")], "k int, a string, b string"), "k", "a", "b").orderBy("k").collect()
    assert (r[0].precision, r[0].recall, r[1].f1) == (0.8, 0.666667, 0.0)


def test_bootstrap_and_permutation_are_plausible(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.gauss(1, 1), rng.gauss(0, 1)) for i in range(200)], "key int, a double, b double")
    b = Z.bootstrap(rows, "key", 300).first()
    assert b.low < b.mean_diff < b.high and b.high - b.low < 1 and Z.permutation(rows, "key", 300).first().p < 0.02


def test_ranker_learns(spark):
    rng = random.Random(3)
    rows = [(q, i, i == 0, [rng.random() + (i == 0), rng.random(), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for q in range(40) for i in range(4)]
    pairs = L.training_pairs(spark.createDataFrame(rows, "query_id int, ord int, relevant boolean, features array<double>")).cache()
    weights, history = L.train(pairs, 8)
    assert history[-1] < history[0] and max(L.importance(weights), key=L.importance(weights).get) == "jaccard"
    assert L.loss(pairs, weights).first().loss < math.log(2)


def test_catalog_and_uploads(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x_index.json").write_text(json.dumps(TREE))
    (tmp_path / "t" / "y_index.json").write_text("{")
    listing = readers.catalog(spark, f"{tmp_path}/t")
    assert {(r.doc_id, r.title) for r in listing.collect()} == {("x", "Guide"), ("y", None)} and readers.search_catalog(listing, "ALL OF").count() == 1
    with pytest.raises(Exception):
        readers.tree_files(spark, f"{tmp_path}/t", strict=True).collect()
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-1.4\n...\n%%EOF\n")
    (tmp_path / "bad.pdf").write_bytes(b"hello")
    files = spark.read.format("binaryFile").load([f"{tmp_path}/ok.pdf", f"{tmp_path}/bad.pdf"])
    assert {(r.path.rpartition("/")[2], r.problem) for r in readers.pdf_problems(files).collect()} == {("bad.pdf", "no PDF header"), ("bad.pdf", "no end mark")}
    (tmp_path / "a.csv").write_text("task_id,annotator_id,faithfulness\nt1,a,4\nt1,b,\nt2,a,x\n")
    assert [(r.task_id, r.value) for r in readers.annotations(spark, f"{tmp_path}/a.csv", ("faithfulness",)).collect()] == [("t1", 4.0)]


def test_vector_topk_finds_itself_nowhere(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    top = R.vector_topk(v.where("vec_id < 3"), v, 5).collect()
    assert len(top) == 15 and all(r.query_id != r.doc_id for r in top)


def test_whole_turns_and_whole_documents_count(spark, monkeypatch):
    from arborist.plans import queries as Q

    long = " ".join(f"w{i}" for i in range(120))
    turns = spark.createDataFrame([(1, long, long), (2, long, long[:400])], "answer_id int, question string, answer string")
    monkeypatch.setattr(Q, "pairs", lambda *_: turns)
    n = len(long[:400].split())
    got = {r.answer_id: (r.precision, r.recall) for r in Q.rouge_l_pairs(spark, "").collect()}
    assert got[1] == (1.0, 1.0) and abs(got[2][1] - n / 120) < 0.01
    filler = "plain filler words here " * 60
    texts = spark.createDataFrame([(1, filler + "zebra quartz violin " * 3), (2, filler)], "doc_id long, text string")
    monkeypatch.setattr(Q, "docs", lambda *_: texts)
    monkeypatch.setattr(Q, "asked", lambda *_: spark.createDataFrame([(7, "zebra quartz violin")], "query_id long, text string"))
    chunks = Q.chunk_scores(spark, "").orderBy("rank").collect()
    assert "".join(c.text for c in chunks if "_1_" in c.chunk_id) == texts.first().text
    scores = {r.chunk_id: r.score for r in Q.compress_relevance(spark, "").collect()}
    assert max(scores, key=scores.get) == "doc_1_chunk_2" and scores["doc_1_chunk_2"] > 0.3
    assert {r.chunk_id for r in Q.compress_keep(spark, "").collect()} == {"doc_1_chunk_2"}
    assert sum(r.n_tokens for r in Q.budget_truncate(spark, "").collect()) >= len(filler) // 3 - 2 and Q.leader_merge(spark, "").count() == len(chunks)


def test_faithfulness_is_the_mean_of_best_overlaps(spark):
    a = spark.createDataFrame([(1, "The cat sat. The dog ran fast."), (2, ""), (3, " ... ")], "answer_id int, answer string")
    c = spark.createDataFrame([(1, "the cat sat on a mat"), (1, "a dog ran")], "answer_id int, context string")
    got = {r.answer_id: (r.faithfulness, r.faithful, r.n_low) for r in H.faithfulness(a, c).collect()}
    assert got == {1: (0.75, True, 0), 2: (1.0, True, 0), 3: (1.0, True, 0)}  # 3 of 3 words, 2 of 4


def test_node_choice_by_token_f1_and_depth(spark):
    n = spark.createDataFrame([("ROOT", 0, "a b"), ("x", 1, "a a b"), ("y", 2, "a b"), ("z", 1, "c")], "node_id string, depth int, text string")
    got = R.token_f1_nodes(n, spark.createDataFrame([(1, "a b")], "query_id int, text string")).orderBy("rank").collect()
    assert [(r.node_id, r.f1) for r in got] == [("y", 0.81), ("x", 0.72)]  # 1 x 0.9^2, 2 * 2 / 5 x 0.9


def test_errors_by_markers_and_pairs(spark):
    rows = [(1, "This will definitely always work", "it works", "It may work"), (2, "The drug is not safe", "drug safe", "the drug is safe"), (3, "All is well 42 Paris", "well", "all is well"), (4, "fine", "planets moons orbit", "nothing here")]
    got = {(r.answer_id, r.category, r.severity) for r in H.errors(spark.createDataFrame(rows, "answer_id int, answer string, reference string, context string")).collect()}
    assert {(1, "overclaim", "minor"), (2, "contradiction", "critical"), (3, "hallucination", "major"), (4, "retrieval_miss", "critical")} <= got
    assert (3, "overclaim", "minor") not in got and (4, "contradiction", "critical") not in got


def test_claims_are_verified_by_numbers_names_and_words(spark):
    a = spark.createDataFrame([(1, "It costs 300 units in all. Angela Merkel spoke then. on 3월 4일 it rained. the cats were sleeping. and so on")], "answer_id int, answer string")
    src = spark.createDataFrame([(1, "a total of 300 was paid; angela merkel was there; cats are sleeping")], "answer_id int, source string")
    got = {r.kind + str(r.i): (r.verified, r.error) for r in H.verify_claims(H.claims(a), src).collect()}
    assert got["number0"] == (True, None) and got["entity1"] == (True, None) and got["fact3"] == (True, None)
    assert got["number2"] == (False, "quantitative_error")  # a date holds a number, which wins
    f = H.fidelity(H.verify_claims(H.claims(a), src), a.unionByName(spark.createDataFrame([(2, "no")], "answer_id int, answer string"))).orderBy("answer_id").collect()
    assert [(r.n_claims, r.groundedness) for r in f] == [(4, 0.75), (0, 1.0)]


def test_citations_with_their_surroundings(spark):
    a = spark.createDataFrame([(1, "Thermal noise limits the amplifier [1] (Source: manual)"), (2, "plain")], "answer_id int, answer string")
    s = spark.createDataFrame([("1", "thermal noise in every amplifier limits it"), ("manual", "unrelated words only")], "citation string, source string")
    got = {r.citation: (r.place, r.valid) for r in H.cited_windows(a, s).collect()}
    assert got == {"1": (35, True), "manual": (39, False)}


def test_domains_by_lexicon(spark):
    d = spark.createDataFrame([(1, "the patient needs treatment and a drug"), (2, "zzz"), (3, "data paper law")], "doc_id int, text string")
    got = {r.doc_id: (r.domain, r.confidence) for r in H.domains(d).collect()}
    assert got[1] == ("medical", 1.0) and got[2] == ("general", 0.5) and got[3] == ("legal", 0.633333)


def test_places_equal_a_total_sort(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, 0.0, 1.5, float(rng.randrange(50))])) for i in rng.sample(range(10_000), 3000)]
    got = {r.k: r.r for r in Z.place(spark.createDataFrame(rows, "k long, v double"), F.col("v"), "k", "r", 20).collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1)}
    assert Z.place(spark.createDataFrame([], "k long, v double"), F.col("v"), "k", "r").count() == 0


def test_caches_evict_and_expire(spark):
    log = spark.createDataFrame([(0, "a", 1, 0.0), (0, "b", 2, 1.0), (0, "a", 3, 2.0), (0, "c", 4, 3.0), (0, "b", 5, 4.0), (0, "a", 6, 50.0)], "node int, key string, event_id long, ts double")
    got = [(r.hit, r.evicted) for r in S.lru_hits(log, "node", "key", "ts", "event_id", 2, 10.0).orderBy("event_id").collect()]
    assert got == [(False, False), (False, False), (True, False), (False, True), (False, True), (False, True)]
    stats = S.cache_statistics(S.lru_hits(log, "node", "key", "ts", "event_id", 2, 10.0)).first()
    assert (stats.hits, stats.misses, stats.hit_rate) == (1, 5, "16.67%")


def test_query_path_from_route_to_context(spark):
    words = lambda w: " ".join(w for _ in range(5))
    docs = spark.createDataFrame([(1, " ".join(["battery voltage"] * 200 + ["charger safety"] * 200 + ["river bank"] * 200)), (2, words("music")), (3, None)], "doc_id long, text string").fillna("")
    q = spark.createDataFrame([(7, "battery voltage limits"), (8, "charger safety rules"), (9, "zz")], "query_id long, text string")
    n, routes = X.section_tree(docs), S.route(q, docs)
    hits = W.traverse_auto(n, q, routes)
    assert {r.query_id for r in hits.select("query_id").distinct().collect()} == {7, 8}
    body = n.select("doc_id", "node_id", "title", F.coalesce("text", "summary").alias("text"), "page_ref")
    found = hits.join(body, ["doc_id", "node_id"]).join(q.select("query_id", F.col("text").alias("query")), "query_id").withColumn("chunk_id", F.col("node_id"))
    ranked = R.rank_by(found, "score", None, ties=("chunk_id",)).select("query_id", "chunk_id", "query", "title", "text", "page_ref", "rank")
    small = C.compress(ranked, tokens=700)
    assert {r.query_id: "charger" in r.context for r in C.joined(small).collect()} == {7: "charger" in C.joined(small.where("query_id = 7")).first().context, 8: True}
    report = {r.query_id: r for r in C.compression_report(ranked, small).collect()}
    assert report[8].n_after <= report[8].n_before and report[8].tokens_saved >= 0
    stats = W.traversal_statistics(hits, n, routes).collect()
    assert all(r.tree_nodes == (4 if r.doc_id == 1 else 2) for r in stats)
    assert "### " in W.format_hits(hits, n).first().block and W.flat_context(n).count() == 3
