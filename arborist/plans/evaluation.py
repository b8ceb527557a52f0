"""Registered queries of the evaluation operators, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import grounding as H
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import service as S
from ..operators import statistics as Z
from ..operators import traverse as V
from ..operators import tree as X
from ..functions import text as T
from ..sources.shared import kept
from . import oracle as O
from . import queries as Q
from .queries import REGISTRY, asked, docs, pairs, query, read, systems

SQL: dict[str, str] = {}


def twin(sql: str):
    """Registers a query together with its SQL."""

    def add(f):
        SQL[f.__name__] = sql
        return query(f)

    return add


_NAMES = ("precision", "recall", "f1", "ndcg", "rr", "ap")


@twin("SELECT k, metric, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) AS n FROM (UNPIVOT (SELECT k, precision, recall, f1, ndcg, rr, ap FROM (" + O.SQL["ir_metrics"] + ")) ON precision, recall, f1, ndcg, rr, ap INTO NAME metric VALUE x) GROUP BY ALL")
def metric_summary(spark, sf):
    return E.aggregate_metrics(Q.REGISTRY["ir_metrics"](spark, sf), _NAMES, ("k",))


@twin("""WITH m AS (SELECT * FROM (UNPIVOT (SELECT system, query_id, k, precision, recall, f1, ndcg, rr, ap FROM (""" + O.SQL["ir_metrics"] + """)) ON precision, recall, f1, ndcg, rr, ap INTO NAME metric VALUE x))
SELECT a.system AS first, b.system AS second, a.metric, count(*) AS n, round(avg(a.x - b.x), 6) AS mean_diff, count(*) FILTER (a.x > b.x) AS wins, count(*) FILTER (a.x < b.x) AS losses, count(*) FILTER (a.x = b.x) AS ties
FROM m a JOIN m b ON a.query_id = b.query_id AND a.k = b.k AND a.metric = b.metric AND a.system < b.system GROUP BY ALL""")
def system_wins(spark, sf):
    return E.pairwise_wins(Q.REGISTRY["ir_metrics"](spark, sf), _NAMES, key=("query_id", "k"))


def usage(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf, "orders").select(
        "o_orderstatus", F.pmod(k, F.lit(900)).alias("total_ms"), F.pmod(k, F.lit(300)).alias("llm_ms"), F.pmod(c, F.lit(500)).alias("context_tokens"), (F.pmod(k, F.lit(50)) * 100).alias("document_tokens"),
        F.pmod(c, F.lit(40)).alias("visited"), F.pmod(k, F.lit(60)).alias("pruned"), F.pmod(c, F.lit(120)).alias("tree_nodes"),
    )


_USAGE = "u AS (SELECT o_orderstatus, o_orderkey % 900 AS total_ms, o_orderkey % 300 AS llm_ms, o_custkey % 500 AS context_tokens, o_orderkey % 50 * 100 AS document_tokens, o_custkey % 40 AS visited, o_orderkey % 60 AS pruned, o_custkey % 120 AS tree_nodes FROM orders)"


@twin(f"""WITH {_USAGE} SELECT o_orderstatus, count(*) AS n, round(avg(total_ms - llm_ms), 6) AS overhead_ms, round(avg(CASE WHEN document_tokens = 0 THEN 0e0 ELSE 1 - context_tokens / document_tokens END), 6) AS reduction,
  round(avg(CASE WHEN context_tokens <> 0 THEN document_tokens / context_tokens END), 6) AS compression, round(avg(CASE WHEN tree_nodes = 0 THEN 0e0 ELSE visited / tree_nodes END), 6) AS visit_rate,
  round(avg(CASE WHEN visited + pruned = 0 THEN 0e0 ELSE pruned / (visited + pruned) END), 6) AS pruning_rate, sum(context_tokens)::BIGINT AS context_tokens, sum(document_tokens)::BIGINT AS document_tokens, round(count(*) / (sum(total_ms) / 1000e0), 6) AS per_second FROM u GROUP BY 1""")
def efficiency_by_status(spark, sf):
    return E.efficiency(usage(spark, sf), ("o_orderstatus",))


@twin(f"""WITH {_USAGE} SELECT o_orderstatus, total_ms, llm_ms, count(*) AS n, round(avg(CASE WHEN document_tokens = 0 THEN 0e0 ELSE greatest(0e0, 1e0 - context_tokens / document_tokens) END), 6) AS reduction,
  round(CASE WHEN llm_ms > 0 THEN total_ms / llm_ms ELSE 0e0 END, 6) AS speedup, round((total_ms - llm_ms)::DOUBLE, 6) AS difference, CASE WHEN llm_ms > 0 AND total_ms / llm_ms > 1e0 THEN 'first' ELSE 'second' END AS faster FROM u GROUP BY ALL""")
def context_and_latency(spark, sf):
    u = usage(spark, sf).withColumns({"reduction": E.context_reduction(F.col("document_tokens"), F.col("context_tokens")), "c": E.latency_comparison(F.col("llm_ms").cast("double"), F.col("total_ms").cast("double"))})
    return u.groupBy("o_orderstatus", "total_ms", "llm_ms", "c.speedup", "c.difference", "c.faster").agg(F.count("*").alias("n"), F.round(F.avg("reduction"), 6).alias("reduction"))


@twin("""WITH s AS (SELECT o_orderpriority AS category, (o_orderkey % 97)::DOUBLE AS a, ((o_orderkey * 31 + 7) % 89)::DOUBLE AS b FROM orders)
SELECT category, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS mean_diff, round(avg((a > b)::INT), 6) AS win_rate, round(avg((a = b)::INT), 6) AS tie_rate FROM s GROUP BY 1""")
def category_breakdown(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("category"))
    return E.breakdown(systems(spark, sf).join(o, "key"), ("category",))


@twin("""WITH c AS (SELECT o_orderpriority AS config, round(avg(o_orderkey % 1000), 6) AS score FROM orders GROUP BY 1), f AS (SELECT max(score) AS f FROM c WHERE config = '1-URGENT')
SELECT config, score, round(score - f, 6) AS delta, round(abs(score - f), 6) AS importance FROM c, f""")
def ablation(spark, sf):
    c = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("config")).agg(F.round(F.avg(F.pmod("o_orderkey", F.lit(1000))), 6).alias("score"))
    return E.ablation_deltas(c, "score", "1-URGENT")


@twin("""WITH j AS (SELECT d.domain, s.confidence, s.correct FROM (""" + O.SQL["domain_classify"] + """) d JOIN (WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), """ + O.SCORED + """ SELECT * FROM sc) s USING (doc_id)),
p AS (SELECT domain, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct::INT), 6) AS accuracy FROM j GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY accuracy DESC, domain)::INT AS by_accuracy, row_number() OVER (ORDER BY confidence DESC, domain)::INT AS by_confidence, row_number() OVER (ORDER BY n DESC, domain)::INT AS by_size FROM p""")
def domain_report(spark, sf):
    return E.domain_report(H.domains(docs(spark, sf)).select("doc_id", "domain").join(Q.scored(spark, sf), "doc_id"))


@twin("WITH r AS (SELECT g.query_id, min(b.rank) AS rank FROM (WITH " + f"{O.D}, {O.A}, {O.GOLD} SELECT * FROM gold" + ") g LEFT JOIN (" + O.SQL["bm25_topk"] + """) b USING (query_id, doc_id) GROUP BY 1)
SELECT count(*) AS n, round(avg(coalesce((rank = 1)::INT, 0)), 6) AS accuracy, round(avg(coalesce(1e0 / rank, 0e0)), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1e0 / log2(rank + 1e0) ELSE 0e0 END), 6) AS ndcg FROM r""")
def ranker_evaluation(spark, sf):
    best = Q.gold(spark, sf).join(R.bm25(docs(spark, sf), asked(spark, sf)), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return E.single_positive(best)


_DIMENSIONS = ("clarity", "depth", "use")


def ratings(spark, sf):
    k = F.col("o_orderkey")
    dim = F.element_at(F.array(*map(F.lit, _DIMENSIONS)), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    return read(spark, sf, "orders").select(k.alias("task"), F.pmod(F.col("o_custkey"), F.lit(2)).alias("slot"), dim.alias("dimension"), (F.pmod(k * 7, F.lit(8))).cast("double").alias("score"))


@twin("""SELECT system, round(avg(score) FILTER (d = 0), 6) AS clarity, round(avg(score) FILTER (d = 1), 6) AS depth, round(avg(score) FILTER (d = 2), 6) AS use
FROM (SELECT CASE WHEN (o_orderkey + o_custkey % 2) % 2 = 0 THEN 'tree' ELSE 'flat' END AS system, o_orderkey % 3 AS d, (o_orderkey * 7 % 8)::DOUBLE AS score FROM orders) GROUP BY 1""")
def unblinded_scores(spark, sf):
    r = ratings(spark, sf)
    key = r.select("task", "slot", F.when(F.pmod(F.col("task") + F.col("slot"), F.lit(2)) == 0, "tree").otherwise("flat").alias("system")).distinct()
    return E.unblinded(r, key, _DIMENSIONS)


@twin("SELECT dimension, count(*) AS n_invalid FROM (SELECT ['clarity', 'depth', 'use'][o_orderkey % 3 + 1] AS dimension, o_orderkey * 7 % 8 AS score FROM orders) WHERE (dimension = 'clarity' AND score NOT BETWEEN 1 AND 5) OR (dimension = 'depth' AND score NOT BETWEEN 0 AND 6) OR dimension = 'use' GROUP BY 1")
def invalid_scores(spark, sf):
    return E.invalid_scores(ratings(spark, sf), spark.createDataFrame([("clarity", 1.0, 5.0), ("depth", 0.0, 6.0)], "dimension string, low double, high double"))


@twin("""WITH j AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN (least(1e0, p_size % 9 / 5e0) + least(1e0, p_size % 4 / 5e0) + least(1e0, p_partkey % 6 / 5e0)) / 3e0 END AS judge, p_partkey % 100 / 100e0 AS confidence FROM part)
SELECT count(*) FILTER (judge <= 0.4e0) AS n_poor, count(*) FILTER (judge > 0.7e0) AS n_good, round(avg(confidence) FILTER (judge <= 0.4e0), 6) AS poor, round(avg(confidence) FILTER (judge > 0.7e0), 6) AS good, round(avg(confidence) FILTER (judge > 0.7e0) - avg(confidence) FILTER (judge <= 0.4e0), 6) AS gap FROM j""")
def detector_evaluation(spark, sf):
    p = read(spark, sf, "part")
    m = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("double")
    judge = E.judged([F.when(F.pmod("p_size", F.lit(7)) != 0, m("p_size", 9)), m("p_size", 4), m("p_partkey", 6)])
    return E.detector_gap(p.select(judge.alias("judge"), (m("p_partkey", 100) / 100.0).alias("confidence")))


@twin("WITH r AS (SELECT *, CASE WHEN confidence > 0.25e0 THEN 'confident' ELSE 'uncertain' END AS kind FROM (" + O.SQL["dual_stage_filter"] + ") WHERE NOT relevant) SELECT kind, place, doc_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, doc_id)::INT AS place FROM r) WHERE place <= 10")
def filtering_report(spark, sf):
    return E.rejected_report(REGISTRY["dual_stage_filter"](spark, sf), 0.25)


_SUPPORT = f"""{O.TURNS}, c AS (SELECT answer_id, question, list_filter(list_transform({O.CLAIMS}, lambda x: trim(x)), lambda x: length(x) >= 16) AS cs FROM pr), u AS (SELECT answer_id, question, i::INT AS i, cs[i + 1] AS claim FROM (SELECT *, unnest(range(0, len(cs))) AS i FROM c)),
w AS (SELECT answer_id, i, claim, list_distinct(list_filter({O.ws('claim')}, lambda x: x NOT IN {tuple(H.SUPPORT_STOP)})) AS w, list_distinct({O.ws('question')}) AS v FROM u),
sup AS (SELECT answer_id, i, claim, CASE WHEN len(w) = 0 THEN 1e0 ELSE round(len(list_intersect(w, v)) / len(w), 6) END AS support FROM w),
cs AS (SELECT answer_id, i, support, CASE WHEN support >= 0.5e0 THEN 'full' WHEN support >= 0.3e0 THEN 'partial' ELSE 'unsupported' END AS grade,
CASE WHEN regexp_matches(claim, '[0-9]|[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+') THEN 'high' WHEN len(list_filter({list(H.ABSOLUTE)}, lambda x: contains(lower(claim), x))) > 0 THEN 'medium' ELSE 'low' END AS severity FROM sup)"""
SQL["claim_support"] = f"WITH {_SUPPORT} SELECT * FROM cs"
SQL["hallucination_rates"] = f"""WITH {_SUPPORT}, g AS (SELECT answer_id, count(*) AS n, count(*) FILTER (grade = 'unsupported') AS bad FROM cs GROUP BY 1),
j AS (SELECT round(least(1e0, length(answer) / 400), 6) AS confidence, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, CASE WHEN n > 0 THEN bad / n ELSE 0e0 END AS share FROM pr LEFT JOIN g USING (answer_id))
SELECT count(*) AS n_answers, sum(n)::BIGINT AS n_claims, sum(bad)::BIGINT AS n_unsupported, round(CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0e0 END, 6) AS hallucination_rate, count(*) FILTER (share > 0) AS n_affected,
round(avg((share > 0)::INT), 6) AS answer_rate, round(avg(share), 6) AS mean_score, round(CASE WHEN min(share) = max(share) OR min(confidence) = max(confidence) THEN 0e0 ELSE corr(confidence, share) END, 6) AS correlation FROM j"""


def citing(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda x, m: F.pmod(x, F.lit(m)).cast("string")
    a = F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit("So it is [Manual "), n(k, 5), F.lit(", p."), n(c, 30), F.lit("] and [Rules - Section 2."), n(k, 3), F.lit(", Page "), n(c, 9), F.lit("] say.")))
    a = a.when(F.pmod(k, F.lit(4)) == 1, F.concat(F.lit("See [Guide, p."), n(k, 7), F.lit("-9] and again [Guide, p."), n(k, 7), F.lit("-9].")))
    a = a.when(F.pmod(k, F.lit(4)) == 2, F.concat(F.lit("As [ note "), n(c, 3), F.lit(" ] has it [x]."))).otherwise("Nothing is cited.")
    return read(spark, sf, "orders").select(k.alias("answer_id"), F.col("o_orderpriority").alias("system"), a.alias("answer"))


_CITING = """a AS (SELECT o_orderkey AS answer_id, o_orderpriority AS system, CASE o_orderkey % 4 WHEN 0 THEN 'So it is [Manual ' || o_orderkey % 5 || ', p.' || o_custkey % 30 || '] and [Rules - Section 2.' || o_orderkey % 3 || ', Page ' || o_custkey % 9 || '] say.'
WHEN 1 THEN 'See [Guide, p.' || o_orderkey % 7 || '-9] and again [Guide, p.' || o_orderkey % 7 || '-9].' WHEN 2 THEN 'As [ note ' || o_custkey % 3 || ' ] has it [x].' ELSE 'Nothing is cited.' END AS answer FROM orders)"""


def _zip(p: str) -> str:
    return f"list_transform(list_zip(regexp_extract_all(answer, '{p}', 1), regexp_extract_all(answer, '{p}', 2)), lambda x: trim(x[1]) || ', p.' || trim(x[2]))"


_WAYS = [r"(?i)\[([^\]]+?),\s*p\.([0-9]+(?:-[0-9]+)?(?:,\s*p\.[0-9]+(?:-[0-9]+)?)*)\]", r"(?i)\[([^\]]+?)\s*-?\s*(?:Sec|Section)\s*[0-9.]+,?\s*(?:Pg?|Page)\.?\s*([0-9]+(?:-[0-9]+)?)\]", r"(?i)\[([^\]]+?),\s*(?:페이지|쪽)\s*([0-9]+(?:-[0-9]+)?)\]"]


@twin(f"""WITH {_CITING}, n AS (SELECT answer_id, list_concat({_zip(_WAYS[0])}, list_concat({_zip(_WAYS[1])}, {_zip(_WAYS[2])})) AS n, list_filter(list_transform(regexp_extract_all(answer, '\\[([^\\]]+)\\]', 1), lambda x: trim(x)), lambda x: x <> '') AS r FROM a),
f AS (SELECT answer_id, CASE WHEN len(n) > 0 THEN n ELSE r END AS f FROM n), u AS (SELECT answer_id, f[i + 1] AS citation, i FROM (SELECT *, unnest(range(0, len(f))) AS i FROM f)), m AS (SELECT answer_id, citation, min(i) AS i FROM u GROUP BY 1, 2)
SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1)::INT AS ord, citation FROM m""")
def answer_citations(spark, sf):
    return H.answer_citations(citing(spark, sf))


@twin(f"WITH {_CITING} SELECT system, count(*) AS n, round(avg(regexp_matches(answer, '(?i)p\\.?\\s*[0-9]+')::INT), 6) AS citation_rate FROM a GROUP BY 1")
def page_citation_rate(spark, sf):
    return H.page_citation_rate(citing(spark, sf), ("system",))


@twin("""WITH f AS (""" + O.SQL["formal_relevance"] + """), g AS (WITH """ + O.GEO + """ SELECT * FROM geo)
SELECT parent_id, node_id, relevance, row_number() OVER (PARTITION BY parent_id ORDER BY relevance DESC, node_id)::INT AS rank, printf('relevance %.3f = 0.7 x semantic %.3f + 0.2 x structure %.3f + 0.1 x context %.3f', relevance, sem, struct, ctx) AS explanation FROM f JOIN g USING (node_id)""")
def ranked_siblings(spark, sf):
    g = Q.geo(spark, sf).select("node_id", "parent_id")
    return R.explained(R.rank_siblings(REGISTRY["formal_relevance"](spark, sf).join(g, "node_id"))).select("parent_id", "node_id", "relevance", "rank", "explanation")


@twin(f"WITH t AS ({O.SQL['trigram_topk']}) SELECT query_id, substring(string_agg(coalesce(d.text, ''), ' ' ORDER BY rank), 1, 600) AS answer, (length(substring(string_agg(coalesce(d.text, ''), ' ' ORDER BY rank), 1, 600)) // 4)::BIGINT AS n_tokens FROM t JOIN documents d USING (doc_id) GROUP BY 1")
def leaf_answers(spark, sf):
    return R.leaf_answers(docs(spark, sf), asked(spark, sf))


@twin(f"""WITH {O.D}, {O.SECTIONS}, n AS (SELECT doc_id, 'd' || doc_id || '.' || (ord + 1) AS node_id, 'Section ' || (ord + 1) AS title, ord AS at, count(*) OVER (PARTITION BY doc_id) AS size FROM sec),
k(category, k) AS (VALUES ('definition', 6), ('mechanism', 4), ('comparison', 3), ('summary', 1)), w AS (SELECT DISTINCT doc_id, size, category, unnest(range(0, k))::INT AS i FROM n, k)
SELECT w.doc_id, category, w.i, category || ': ' || title || '?' AS question, node_id AS expected FROM w JOIN n ON n.doc_id = w.doc_id AND n.at = w.i % w.size""")
def cycled_questions(spark, sf):
    return S.cycled_questions(X.content_nodes(X.section_tree(docs(spark, sf))).where("depth > 0"))


@twin("""WITH c AS (SELECT conv_id AS doc_id, text AS question, 'q' || turn AS question_id FROM conversations WHERE turn % 2 = 0), n AS (SELECT DISTINCT conv_id AS doc_id, text AS question FROM conversations WHERE turn < 3)
SELECT question_id, doc_id, md5(question) AS digest FROM c UNION ALL SELECT substring(md5(doc_id || '|' || question), 1, 12), doc_id, md5(question) FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = n.doc_id AND c.question = n.question)""")
def added_questions(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("question"), "turn")
    old = c.where(F.pmod("turn", F.lit(2)) == 0).withColumn("question_id", F.concat(F.lit("q"), F.col("turn").cast("string")))
    return S.add_questions(old, c.where("turn < 3")).select("question_id", "doc_id", F.md5(F.col("question").cast("binary")).alias("digest"))


@twin("""WITH c AS (SELECT doc_id, lang, source FROM documents), l AS (SELECT * FROM c WHERE doc_id % 5 <> 0), s AS (SELECT doc_id, lang, 'saved' AS source FROM c WHERE doc_id % 3 = 0)
SELECT *, 'existing' AS status FROM l WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM l) THEN 'replaced' ELSE 'created' END FROM s""")
def catalog_update(spark, sf):
    c = read(spark, sf, "documents").select("doc_id", "lang", "source")
    return S.catalog_update(c, c.where(F.pmod("doc_id", F.lit(5)) == 0), c.where(F.pmod("doc_id", F.lit(3)) == 0).withColumn("source", F.lit("saved")))


@twin(f"WITH b AS ({O.SQL['bm25_topk']}), j AS ({O.SQL['jaccard_topk']}) SELECT 'both' AS kind, query_id, doc_id FROM (SELECT query_id, doc_id FROM b INTERSECT SELECT query_id, doc_id FROM j) UNION ALL SELECT 'only bm25', query_id, doc_id FROM (SELECT query_id, doc_id FROM b EXCEPT SELECT query_id, doc_id FROM j)")
def shared_hits(spark, sf):
    pick = lambda n: REGISTRY[n](spark, sf).select("query_id", "doc_id")
    b, j = pick("bm25_topk"), pick("jaccard_topk")
    return b.intersect(j).select(F.lit("both").alias("kind"), "query_id", "doc_id").unionByName(b.exceptAll(j).select(F.lit("only bm25").alias("kind"), "query_id", "doc_id"))


@twin("SELECT event_id, CASE WHEN lower(event_type) IN ('click', 'view') THEN lower(event_type) ELSE 'general' END AS kind, coalesce(props->>'$.node.id', props->>'$.id', props->>'$.k') AS node FROM events")
def event_kinds(spark, sf):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return read(spark, sf, "events").select("event_id", E.known_as(F.col("event_type"), ("click", "view"), "general").alias("kind"), F.coalesce(get("node.id"), get("id"), get("k")).alias("node"))


@twin(f"WITH {O.TURNS} SELECT answer_id, CASE WHEN regexp_matches(question, '[가-힣]') THEN '관련 내용을 찾지 못했습니다.' WHEN regexp_matches(question, '[぀-ヿ一-鿿]') THEN '関連する内容が見つかりませんでした。' ELSE 'Nothing relevant was found.' END AS answer FROM pr")
def no_context_answers(spark, sf):
    return pairs(spark, sf).select("answer_id", C.no_context_answer(F.col("question")).alias("answer"))


@twin(f"""WITH {O.TURNS}, w AS (SELECT answer_id, list_distinct({O.w('question')}) AS e, list_distinct({O.w('answer')}) AS f FROM pr) SELECT answer_id, CASE WHEN len(e) = 0 THEN (len(f) > 0)::INT::DOUBLE ELSE round(len(list_intersect(f, e)) / len(e), 6) END AS recall FROM w""")
def section_recall(spark, sf):
    p = pairs(spark, sf).select("answer_id", T.words("question").alias("e"), T.words("answer").alias("f"))
    return p.select("answer_id", E.section_recall(p, "f", "e").alias("recall"))


@query
def system_comparison(spark, sf):
    return Z.compare(systems(spark, sf), "key")


@query
def error_crosstab(spark, sf):
    p = pairs(spark, sf).select("answer_id", "answer", F.col("question").alias("reference"), F.col("source").alias("context"))
    return H.error_crosstab(H.errors(p))


@query
def lru_cache_statistics(spark, sf):
    e = Q.timed(spark, sf).withColumn("node", F.pmod("user_id", F.lit(16)))
    return S.cache_statistics(S.lru_hits(e, "node", "event_type", "ts", "event_id", 3, 6 * 3600.0), ("node",))


def routed_hits(spark, sf):
    n, q, routes = Q.routed(spark, sf)
    return n, q, routes, kept(V.traverse_auto(n, q, routes))


@query
def traversal_statistics(spark, sf):
    n, _, routes, hits = routed_hits(spark, sf)
    return V.traversal_statistics(hits, n, routes)


@query
def query_context(spark, sf):
    """The query path: routed, traversed by the chosen algorithm, compressed, joined under its pages."""
    n, q, _, hits = routed_hits(spark, sf)
    body = n.select("doc_id", "node_id", "title", F.coalesce("text", "summary").alias("text"), "page_ref")
    found = hits.join(body, ["doc_id", "node_id"]).join(q.select("query_id", F.col("text").alias("query")), "query_id")
    ranked = R.rank_by(found.withColumnRenamed("node_id", "chunk_id"), "score", None, ties=("chunk_id",))
    return C.joined(C.compress(ranked.select("query_id", "chunk_id", "query", "title", "text", "page_ref", "rank")))


@query
def graph_search(spark, sf):
    e = Q.trade(spark, sf)
    seeds = spark.createDataFrame([("n1", 1.0), ("n8", 0.9)], "node string, confidence double")
    return G.search(e, seeds, 3, 5, 0.3)
