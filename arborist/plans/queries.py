"""The registered queries over the star schema and the corpus tables; plans.oracle has their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import graph as G
from ..operators import grounding as H
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import service as S
from ..operators import statistics as Z
from ..operators import traverse as V
from ..operators import tree as X
from ..sources.shared import kept

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key where a small input comes in fewer partitions than there are cores (one row group, say): tokenising is the work, not the move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def docs(spark, sf) -> DataFrame:
    return spread(read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")


def asked(spark, sf) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def geo(spark, sf) -> DataFrame:
    return X.geography(*(read(spark, sf, t) for t in ("region", "nation", "customer")))


def pairs(spark, sf) -> DataFrame:
    """Answered user turns: answer_id, question, answer, source (the question as context)."""
    t = S.turns(read(spark, sf, "conversations"))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "question", "answer", F.col("question").alias("source"))


def timed(spark, sf) -> DataFrame:
    return read(spark, sf, "events").where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))


def run_of(df: DataFrame, system: str) -> DataFrame:
    return df.select(F.lit(system).alias("system"), "query_id", "doc_id", "rank")


def gold(spark, sf) -> DataFrame:
    """A passage's relevant documents: those that share four fifths of its words."""
    return R.best_overlap(docs(spark, sf), asked(spark, sf), "share", least=0.8).select("query_id", "doc_id")


def scored(spark, sf) -> DataFrame:
    """Labelled documents with a confidence (their share of distinct words) and whether they are good."""
    d = docs(spark, sf).select("doc_id", T.words("text").alias("w")).where(F.size("w") > 0)
    conf = d.select("doc_id", F.round(F.size(F.array_distinct("w")) / F.size("w"), 6).alias("confidence"))
    return conf.join(read(spark, sf, "labels").where("quality is not null"), "doc_id").select("doc_id", "confidence", (F.col("quality") == 1).alias("correct"))


# retrieval


@query
def bm25_topk(spark, sf):
    return R.bm25(docs(spark, sf), asked(spark, sf))


@query
def bm25_raw_tf(spark, sf):
    return R.bm25(docs(spark, sf), asked(spark, sf), binary=False)


@query
def okapi_topk(spark, sf):
    return R.okapi(docs(spark, sf), asked(spark, sf))


@query
def bm25_candidates(spark, sf):
    return R.bm25_candidates(docs(spark, sf), asked(spark, sf))


@query
def jaccard_topk(spark, sf):
    return R.best_overlap(docs(spark, sf), asked(spark, sf), k=10)


@query
def router_lexical(spark, sf):
    return S.route(asked(spark, sf), docs(spark, sf))


@query
def trigram_topk(spark, sf):
    return R.trigram(docs(spark, sf), asked(spark, sf))


@query
def hash_embed_topk(spark, sf):
    return R.hashed(docs(spark, sf), asked(spark, sf))


def leveled(spark, sf) -> DataFrame:
    return docs(spark, sf).withColumn("depth", F.pmod("doc_id", F.lit(4)))


@query
def hybrid_topk(spark, sf):
    return R.hybrid(leveled(spark, sf), asked(spark, sf))


@query
def hybrid_weight_sweep(spark, sf):
    grid = spark.createDataFrame([(i, a / 100, b / 100, c / 100) for i, (a, b, c) in enumerate([(60, 25, 15), (100, 0, 0), (0, 100, 0), (0, 0, 100), (50, 50, 0), (70, 20, 10), (34, 33, 33)])], "config int, w_bm25 double, w_jaccard double, w_depth double")
    return R.hybrid(leveled(spark, sf), asked(spark, sf), 5, grid)


@query
def vector_cosine_topk(spark, sf):
    v = read(spark, sf, "embeddings")
    return R.vector_topk(v.where("vec_id % 50 = 0"), v)


@query
def vector_label_precision(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "label")
    top = vector_cosine_topk(spark, sf)
    j = top.join(v.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id").join(v.withColumnsRenamed({"vec_id": "doc_id", "label": "dl"}), "doc_id")
    return j.groupBy("query_id").agg(F.round(F.avg((F.col("ql") == F.col("dl")).cast("double")), 6).alias("precision"))


@query
def token_f1_pairs(spark, sf):
    return R.token_f1(pairs(spark, sf), "answer_id", "question", "answer")


@query
def keyword_traversal(spark, sf):
    n = X.section_tree(docs(spark, sf))
    return R.token_f1_nodes(n.select("node_id", "depth", F.concat_ws(" ", "title", "summary").alias("text")), asked(spark, sf))


@query
def formal_relevance(spark, sf):
    g = geo(spark, sf)
    up = g.select(F.col("node_id").alias("parent_id"), F.col("title").alias("parent_title"))
    n = g.join(up, "parent_id", "left").withColumn("query", F.lit("the AFRICA nation of egypt")).withColumn("summary", F.col("title"))
    return R.formal_relevance(n).select("node_id", "sem", "struct", "ctx", "relevance")


# trees


@query
def chunk_300(spark, sf):
    return X.chunk_chars(docs(spark, sf)).select("doc_id", "ord", "chunk_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def chunk_400_words(spark, sf):
    return X.chunk_words(docs(spark, sf)).select("doc_id", "ord", "n_words", F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def cluster_round_robin(spark, sf):
    return X.round_robin_clusters(X.chunk_chars(docs(spark, sf))).select("doc_id", "cluster", "n_members", F.md5(F.col("summary").cast("binary")).alias("digest"))


@query
def tree_flatten_geo(spark, sf):
    return geo(spark, sf)


@query
def tree_paths_geo(spark, sf):
    return X.breadcrumbs(geo(spark, sf), 2)


@query
def tree_stats(spark, sf):
    return X.stats(geo(spark, sf))


@query
def section_tree_stats(spark, sf):
    return X.stats(X.section_tree(docs(spark, sf)))


@query
def sibling_groups(spark, sf):
    return X.sibling_groups(geo(spark, sf))


@query
def sibling_pairs_range(spark, sf):
    return G.sibling_pairs(geo(spark, sf).withColumn("ord", F.col("key")))


@query
def hierarchy_edges(spark, sf):
    return X.hierarchy_edges(geo(spark, sf))


@query
def page_headings(spark, sf):
    return X.html_headings(read(spark, sf, "pages"))


@query
def page_buckets(spark, sf):
    n = X.section_tree(docs(spark, sf))
    last = n.groupBy("doc_id").agg(F.max(X.last_page(F.col("page_ref"))).alias("pages"))
    return last.select("doc_id", "pages", X.page_bucket(F.col("pages")).alias("bucket"))


# traversal


def geo_scores(spark, sf) -> DataFrame:
    g = geo(spark, sf).where("depth > 0").select("doc_id", "node_id", "depth", "key")
    q = spark.range(3).select(F.col("id").alias("query_id"))
    kw = F.pmod(F.col("key") * 7 + F.col("query_id") * 3, F.lit(11)) / 10.0
    return g.crossJoin(F.broadcast(q)).select("query_id", "doc_id", "node_id", F.round(V.beam_score(F.lit(0.5), kw, F.col("depth")), 6).alias("score"))


@query
def beam_search_geo(spark, sf):
    return V.beam(geo(spark, sf), geo_scores(spark, sf), 5, 3, 0.2)


@query
def policy_choice(spark, sf):
    s = geo_scores(spark, sf)
    roots = s.join(geo(spark, sf).where("depth = 1").select("node_id"), "node_id", "left_semi")
    return V.choose_algorithm(roots)


@query
def dual_stage_filter(spark, sf):
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("summary"))
    kw = V.keyword_evidence(F.lit("the of and license version"), F.col("title"), F.col("summary"))
    r = V.dual_stage(F.lit(0.5), F.lit(0.0), F.round(kw, 6), F.lit(0.45))
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query
def adaptive_threshold(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.pmod("user_id", F.lit(20)).alias("selected"), (F.pmod("event_id", F.lit(80)) + 20).alias("total"), F.pmod("event_id", F.lit(130)).alias("size"), F.pmod("event_id", F.lit(6)).alias("depth"))
    return e.select("event_id", F.round(V.adaptive_threshold(F.lit(0.6), F.col("selected"), F.col("total"), F.col("size"), F.col("depth")), 6).alias("tau"))


def routed(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, queries, routes): three trees a passage, and the section trees of those documents alone."""
    d, q = docs(spark, sf), asked(spark, sf)
    routes = kept(S.route(q, d))
    return X.section_tree(kept(R.only(d, routes))), q, routes


@query
def beam_search_docs(spark, sf):
    n, q, routes = routed(spark, sf)
    return V.traverse_exact(n, q, "beam", routes=routes).select("query_id", "doc_id", "node_id", "depth", F.round("score", 6).alias("score"), "recovered")


@query
def dfs_search_docs(spark, sf):
    n, q, routes = routed(spark, sf)
    return V.traverse_exact(n, q, "dfs", routes=routes).select("query_id", "doc_id", "node_id", "depth", F.round("score", 6).alias("score"), "recovered")


# context


def chunk_scores(spark, sf) -> DataFrame:
    """The hits of each passage, their whole texts in chunks of 600 characters; rank goes by hit, then by place."""
    hits = kept(R.bm25(docs(spark, sf), asked(spark, sf), 10).select("query_id", "doc_id", "rank"))  # ten rows a query, read twice
    chunks = X.chunk_chars(kept(R.only(docs(spark, sf), hits)), 600)
    j = hits.join(asked(spark, sf).withColumnRenamed("text", "query"), "query_id").join(chunks, "doc_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "ord"))
    return j.select("query_id", "chunk_id", "query", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "text", place.alias("rank"))


@query
def compress_relevance(spark, sf):
    return C.relevance(chunk_scores(spark, sf)).select("query_id", "chunk_id", "score")


@query
def compress_keep(spark, sf):
    return C.keep_relevant(C.relevance(chunk_scores(spark, sf))).select("query_id", "chunk_id")


@query
def leader_merge(spark, sf):
    c = chunk_scores(spark, sf).select(F.col("query_id").alias("grp"), F.col("rank").alias("ord"), "text")
    return C.leaders(c, 0.3)


@query
def budget_truncate(spark, sf):
    c = C.relevance(chunk_scores(spark, sf), ("query_id", "chunk_id", "rank")).select(F.col("query_id").alias("grp"), F.col("rank").alias("ord"), "score", F.floor(F.length("text") / 3).alias("n_tokens"))
    return C.budget(c, 500)


def referring(spark, sf) -> DataFrame:
    """Texts with cross-references, out of the orders' numbers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda x, m: F.pmod(x, F.lit(m)).cast("string")
    text = F.concat(F.lit("As Section "), n(k, 9), F.lit("."), n(c, 7), F.lit(" shows, see Table "), n(k, 13), F.lit("-"), n(c, 5), F.lit(" and fig. "), n(c, 11), F.lit(" in chapter "), n(k, 17), F.lit(", page "), n(c, 89), F.lit("; 제 3 장, 표 "), n(k, 6), F.lit("."))
    return read(spark, sf, "orders").select(k.alias("doc_id"), text.alias("text"))


@query
def detect_references(spark, sf):
    return C.detect_references(referring(spark, sf)).groupBy("doc_id", "kind", "number").agg(F.count("*").alias("n"))


# graph


def trade(spark, sf) -> DataFrame:
    """Edges between nations: each to the two next of its region and to one of the next region."""
    n = read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.col("n_nationkey").alias("k"))
    kinds = ("temporal", "support", "cause_effect")
    hop = F.explode(F.array(*[F.struct(F.lit(kinds[i]).alias("edge_type"), F.lit(s).alias("s"), F.lit(c).alias("confidence")) for i, (s, c) in enumerate([(1, 0.9), (3, 0.8), (7, 0.7)])])).alias("h")
    return n.select("src", "k", hop).select("src", F.concat(F.lit("n"), F.pmod(F.col("k") + F.col("h.s"), F.lit(25)).cast("string")).alias("dst"), "h.edge_type", "h.confidence")


@query
def graph_paths_3hop(spark, sf):
    e = trade(spark, sf)
    seeds = e.select(F.col("src").alias("node")).distinct().withColumn("confidence", F.lit(1.0))
    return G.best_paths(e, seeds, 4, 0.5, None).select("seed", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"), "n_nodes")


@query
def graph_shortest_path(spark, sf):
    e = trade(spark, sf)
    ends = e.select(F.col("src").alias("a")).distinct().crossJoin(e.select(F.col("src").alias("b")).distinct())
    return G.shortest_paths(e, ends).select("a", "b", "n_hops")


@query
def graph_edge_counts(spark, sf):
    return G.edge_counts(trade(spark, sf))


@query
def graph_neighbourhood(spark, sf):
    return G.neighbourhood(trade(spark, sf)).select("node", "n_out", "n_in", F.array_join("out_nodes", ",").alias("out_nodes"), F.array_join("in_nodes", ",").alias("in_nodes"))


# grounding


@query
def grounding_sentences(spark, sf):
    return H.ground(pairs(spark, sf)).select("answer_id", "i", "confidence", "grounded")


@query
def grounding_verdicts(spark, sf):
    return H.verdicts(H.ground(pairs(spark, sf)))


@query
def claims_by_type(spark, sf):
    return H.claims(pairs(spark, sf)).groupBy("kind").agg(F.count("*").alias("n_claims"))


@query
def claim_support(spark, sf):
    return H.claim_support(pairs(spark, sf))


@query
def hallucination_rates(spark, sf):
    p = pairs(spark, sf)
    return H.hallucination_rates(H.claim_support(p), p.select("answer_id", F.round(F.least(F.lit(1.0), F.length("answer") / 400), 6).alias("confidence")))


@query
def fidelity_by_kind(spark, sf):
    p = pairs(spark, sf)
    v = H.verify_claims(H.claims(p), p.select("answer_id", "source"))
    return v.groupBy("kind", F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n_claims"))


@query
def fidelity_summary(spark, sf):
    p = pairs(spark, sf)
    return H.fidelity_summary(H.fidelity(H.verify_claims(H.claims(p), p.select("answer_id", "source")), p))


@query
def error_matrix(spark, sf):
    p = pairs(spark, sf).select("answer_id", "answer", F.col("question").alias("reference"), F.col("source").alias("context"))
    return H.error_matrix(H.errors(p))


@query
def calibration_bins(spark, sf):
    return H.calibration_bins(scored(spark, sf))


@query
def calibration_summary(spark, sf):
    return H.calibration(scored(spark, sf))


@query
def temperature_grid(spark, sf):
    return H.temperature(scored(spark, sf))


@query
def domain_classify(spark, sf):
    return H.domains(docs(spark, sf))


@query
def language_detect(spark, sf):
    return docs(spark, sf).select("doc_id", T.language("text").alias("script"))


@query
def section_citation_f1(spark, sf):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    dotted = lambda *p: F.concat_ws(".", *[x.cast("string") for x in p])
    found = o.select(F.pmod("o_custkey", F.lit(97)).alias("key"), dotted(F.pmod(k, F.lit(5)), F.pmod(k, F.lit(7)), F.pmod(k, F.lit(3))).alias("f"))
    want = o.select(F.pmod("o_custkey", F.lit(97)).alias("key"), dotted(F.pmod(k, F.lit(11)), F.pmod(k, F.lit(4))).alias("e"))
    return H.section_citation_f1(found, want)


@query
def citation_accuracy(spark, sf):
    o = read(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(97)).alias("key"), F.pmod("o_orderkey", F.lit(41)).alias("c"), "o_orderstatus")
    return H.citation_accuracy(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"))


@query
def faithfulness(spark, sf):
    p = pairs(spark, sf)
    return H.faithfulness(p, p.select("answer_id", F.col("source").alias("context")))


# metrics


def runs_and_gold(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two systems' runs over the passages, and what is relevant."""
    d, q = docs(spark, sf), asked(spark, sf)
    runs = run_of(R.bm25(d, q, 20), "bm25").unionByName(run_of(R.best_overlap(d, q, k=20), "jaccard"))
    return kept(runs), kept(gold(spark, sf))


@query
def ir_metrics(spark, sf):
    return M.rank_metrics(*runs_and_gold(spark, sf))


@query
def ir_macro(spark, sf):
    return M.macro(M.rank_metrics(*runs_and_gold(spark, sf), digits=12))


@query
def ndcg_graded(spark, sf):
    rel = R.best_overlap(docs(spark, sf), asked(spark, sf), "share", least=0.4).select("query_id", "doc_id", F.floor(F.col("score") * 5).cast("double").alias("relevance"))
    return M.graded_ndcg(R.bm25(docs(spark, sf), asked(spark, sf)), rel)


@query
def rouge_l_pairs(spark, sf):
    return M.rouge_l(pairs(spark, sf), "answer_id", "question", "answer")


@query
def exact_match_pairs(spark, sf):
    return M.exact_match(pairs(spark, sf), "answer_id", "question", "answer")


@query
def term_recall_pairs(spark, sf):
    return M.term_recall(pairs(spark, sf), "answer_id", "question", "answer", ("the", "and", "license", "version", "der", "que"))


@query
def answer_identity_audit(spark, sf):
    p = pairs(spark, sf).select(F.col("answer_id").alias("question_id"), "answer", "question")
    return M.identical_answers(p.select("question_id", "answer"), p.select("question_id", F.col("question").alias("answer")))


@query
def latency_stats(spark, sf):
    return M.latency(read(spark, sf, "events"), ("event_type",))


@query
def latency_nearest_rank(spark, sf):
    return M.nearest_rank(read(spark, sf, "events").where("value is not null"), ("event_type",))


@query
def running_average_50(spark, sf):
    return M.running_average(read(spark, sf, "events"), "user_id", ("ts", "event_id"), "value").select("event_id", "avg_all", "avg_last")


@query
def llm_cost_by_stage(spark, sf):
    e = read(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), F.pmod("event_id", F.lit(50)).alias("completion_tokens"), F.col("value").alias("latency_s"))
    return S.call_costs(e, ("event_type",))


@query
def krippendorff_alpha(spark, sf):
    o = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_quantity").alias("value"))
    return M.krippendorff(o)


@query
def cohen_kappa(spark, sf):
    return M.cohen_kappa(read(spark, sf, "labels"), "quality", "toxic")


@query
def spearman_rho(spark, sf):
    return M.spearman(read(spark, sf, "part"), "p_size", "p_retailprice", "p_partkey")


@query
def stratified_sample(spark, sf):
    return M.stratified(read(spark, sf, "customer"), ("c_mktsegment", "c_nationkey"), "c_custkey", 100).select("c_custkey", "c_mktsegment", "c_nationkey", "turn")


# statistics


def systems(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.pmod("o_orderkey", F.lit(97)).cast("double").alias("a"), F.pmod(F.col("o_orderkey") * 31 + 7, F.lit(89)).cast("double").alias("b"))


@query
def paired_ttest(spark, sf):
    return Z.paired_t(systems(spark, sf))


@query
def wilcoxon_signed_rank(spark, sf):
    return Z.wilcoxon(systems(spark, sf), "key")


@query
def p_value_corrections(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", F.round((F.pmod(F.col("n_nationkey") * 7, F.lit(25)) + 1) / 400.0, 6).alias("p"))
    return Z.corrections(n, "n_nationkey")


@query
def bootstrap_interval(spark, sf):
    return Z.bootstrap(systems(spark, sf), "key")


@query
def permutation_test(spark, sf):
    return Z.permutation(systems(spark, sf), "key", 10_000)


# questions and service


@query
def offline_qa(spark, sf):
    n = X.content_nodes(X.section_tree(docs(spark, sf))).where("depth > 0")
    return S.offline_questions(n).select("doc_id", "category", "i", "question", F.array_join("expected", ",").alias("expected"))


@query
def qa_validation(spark, sf):
    c = read(spark, sf, "conversations").select((F.col("conv_id") * 37).alias("doc_id"), "turn", F.when(F.pmod("conv_id", F.lit(7)) == 0, F.lit(" ")).otherwise(F.col("text")).alias("question"))
    again = c.where(F.pmod("doc_id", F.lit(5)) == 0)
    return S.question_problems(c.unionByName(again).drop("turn"), docs(spark, sf))


@query
def conversation_pairs(spark, sf):
    return S.turns(read(spark, sf, "conversations")).select("conv_id", "turn", F.length("question").alias("n_question"), F.length("answer").alias("n_answer"))


@query
def cache_ttl_hits(spark, sf):
    e = timed(spark, sf).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return S.ttl_hits(e, "key", "ts", 6 * 3600.0, "event_id")


@query
def rate_limit_window(spark, sf):
    return S.rate_limit(timed(spark, sf), "user_id", "ts", "event_id", 3, 6 * 3600.0)


@query
def cache_keys(spark, sf):
    p = read(spark, sf, "conversations").where("role = 'user'")
    return p.select("conv_id", "turn", S.cache_key(F.col("text"), F.array(F.lit("b"), F.lit("a")), F.lit(3)).alias("key"))
