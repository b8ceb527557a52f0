"""Evaluation of retrieval systems over questions about document trees: seven systems by one signature, resumable runs, re-judging, one harness.

A system is a plan (nodes, questions, branches) -> hits. nodes are (doc_id, node_id, depth, path_ord, title, summary,
text, page_ref), questions (question_id, doc_id, question, expected[, category]); a question is asked of its own
document's tree. hits are (question_id, node_id, rank, score, title, body, page_ref).

All scores of one tokeniser come out of one join on (document, term); a question is paired with all nodes of
its tree only where the rule ranks nodes without a common term too. Ties go by the order of the tree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..sources.versions import VersionedTable, appear, exists
from . import metrics as M
from . import retrieval as R
from . import similarity as S
from . import traverse
from .power import paired_t_exact
from .tree import chunk_chars, round_robin_clusters

System = Callable[[DataFrame, DataFrame, int], DataFrame]
DIGITS = R.DIGITS
NODE = ("node_id", "title", "body", "page_ref")
K1, B, EPSILON = 1.5, 0.75, 0.25
FLAT_WEIGHTS, FLAT_CANDIDATES = (0.6, 0.25, 0.15), 20


def body() -> Column:
    """A node's text: its summary or, without one, its text."""
    return F.coalesce(F.nullif("summary", F.lit("")), F.col("text"), F.lit(""))


def _prepared(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """The nodes of the trees that are asked about, with body and the node's text."""
    near = nodes.join(questions.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("body", body())
    return near.withColumn("words", F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), "body")))


def _bags(nodes: DataFrame, questions: DataFrame, tokenizer: Callable[[Column], Column], text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node_id, len, t, x) and (question_id, doc_id, asked, t, y): tokens with counts; a node without any has the one token "<empty>"."""
    own = tokenizer(F.col(text))
    own = F.when(F.size(own) == 0, F.array(F.lit("<empty>"))).otherwise(own)
    x = nodes.select("doc_id", "node_id", own.alias("all")).select("doc_id", "node_id", F.size("all").alias("len"), F.explode("all").alias("t"))
    y = questions.select("question_id", "doc_id", tokenizer(F.col("question")).alias("all")).select("question_id", "doc_id", F.size("all").alias("asked"), F.explode("all").alias("t"))
    return x.groupBy("doc_id", "node_id", "len", "t").agg(F.count("*").alias("x")), y.groupBy("question_id", "doc_id", "asked", "t").agg(F.count("*").alias("y"))


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best rows (question_id, path_ord, score, ...) of each question."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "path_ord"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("question_id", "node_id", "rank", "score", "title", "body", "page_ref")


def _of_all_nodes(nodes: DataFrame, questions: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k best of all of a tree's nodes; those without a score have 0, and a question without tokens has none."""
    asked = scores.select("question_id", "doc_id").distinct() if questions is None else questions.select("question_id", "doc_id")
    pairs = asked.join(nodes.select("doc_id", "path_ord", *NODE), "doc_id").join(scores.select("question_id", "node_id", "score"), ["question_id", "node_id"], "left")
    return _ranked(pairs.withColumn("score", F.coalesce("score", F.lit(0.0))), k)


def _with_tokens(questions: DataFrame) -> DataFrame:
    return questions.where(F.size(T.tokens_cjk("question")) > 0)


def bm25(nodes: DataFrame, questions: DataFrame, branches: int) -> DataFrame:
    """Okapi BM25 over the title and summary of all nodes of the tree; negative idf becomes EPSILON times the tree's mean idf."""
    own = _prepared(nodes, questions)
    x, y = _bags(own, questions, T.tokens_cjk, "words")
    size = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    length = x.groupBy("doc_id", "node_id").agg(F.first("len").alias("len")).groupBy("doc_id").agg(F.avg("len").alias("avg_len"))
    idf = x.groupBy("doc_id", "t").agg(F.count("*").alias("df")).join(size, "doc_id").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.groupBy("doc_id").agg(F.avg("idf").alias("mean_idf")).join(length, "doc_id")
    idf = idf.join(mean, "doc_id").select("doc_id", "t", "avg_len", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    tf = F.col("x")
    part = F.col("y") * F.col("idf") * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * F.col("len") / F.col("avg_len")))
    scores = y.join(x, ["doc_id", "t"]).join(idf, ["doc_id", "t"]).groupBy("question_id", "node_id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    return _of_all_nodes(own, _with_tokens(questions), scores, branches)


def dense(nodes: DataFrame, questions: DataFrame, branches: int) -> DataFrame:
    """Cosine of hashed token counts over all nodes of the tree."""
    own = _prepared(nodes, questions)
    x, y = _bags(own, questions, T.tokens_cjk, "words")
    x = x.where("t <> '<empty>'").groupBy("doc_id", "node_id", V.hash_bucket(F.col("t")).alias("at")).agg(F.sum("x").cast("double").alias("x"))
    y = y.groupBy("question_id", "doc_id", V.hash_bucket(F.col("t")).alias("at")).agg(F.sum("y").cast("double").alias("y"))
    xs, ys = x.groupBy("doc_id", "node_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("xs")), y.groupBy("question_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ys"))
    dots = y.join(x, ["doc_id", "at"]).groupBy("question_id", "doc_id", "node_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scores = dots.join(xs, ["doc_id", "node_id"]).join(ys, "question_id").select("question_id", "node_id", F.round(F.col("dot") / (F.col("xs") * F.col("ys")), DIGITS).alias("score"))
    return _of_all_nodes(own, questions.where(F.coalesce(F.col("question"), F.lit("")) != ""), scores, branches)


def flat(nodes: DataFrame, questions: DataFrame, branches: int) -> DataFrame:
    """The twenty nodes of the largest idf sum, by BM25 over its best, Jaccard of the words and decay with depth."""
    words = lambda c: T.words(c, 1)
    own = _prepared(nodes, questions).withColumn("both", F.concat_ws(" ", "body", F.coalesce("title", F.lit(""))))
    x, y = _bags(own, questions, words, "both")
    x = x.withColumn("len", F.when(F.col("t") == "<empty>", 0).otherwise(F.col("len")))
    size = x.groupBy("doc_id", "node_id").agg(F.first("len").alias("len")).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = x.groupBy("doc_id", "t").agg(F.count("*").alias("df")).join(size, "doc_id").withColumn("idf", R.idf(F.col("n"), F.col("df")))
    part = F.col("idf") * (K1 + 1.0) / (1.0 + K1 * (1.0 - B + B * F.col("len") / F.col("avg_len")))
    met = y.join(x, ["doc_id", "t"]).join(df.select("doc_id", "t", "idf", "avg_len"), ["doc_id", "t"])
    met = met.groupBy("question_id", "doc_id", "node_id").agg(F.round(F.sum(F.col("y") * F.col("idf")), DIGITS).alias("first"), F.round(F.sum(part), DIGITS).alias("bm25"))
    met = met.join(own.select("doc_id", "path_ord", "depth", *NODE), ["doc_id", "node_id"])
    first = Window.partitionBy("question_id").orderBy(F.desc("first"), "path_ord")
    near = met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= FLAT_CANDIDATES).join(questions.select("question_id", "question"), "question_id")
    best = F.max("bm25").over(Window.partitionBy("question_id"))
    jaccard = T.jaccard(T.word_set("question"), T.word_set("body"))
    a, b, c = FLAT_WEIGHTS
    score = a * F.when(best > 0, F.col("bm25") / best).otherwise(0.0) + b * jaccard + c * R.structural(F.col("depth"))
    return _ranked(near.withColumn("score", F.round(score, DIGITS)), branches)


def raptor(nodes: DataFrame, questions: DataFrame, branches: int) -> DataFrame:
    """Trigram Jaccard over 300-character chunks of the text and their round-robin clusters of three; the first ones where all are 0."""
    whole = nodes.join(questions.select("doc_id").distinct(), "doc_id", "left_semi").where("text is not null")
    texts = whole.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_ord", "text"))), lambda p: p["text"]), " ").alias("text"))
    chunks = chunk_chars(texts).select("doc_id", "ord", "text")
    leaf = chunks.select("doc_id", F.concat(F.lit("chunk_"), F.col("ord").cast("string")).alias("node_id"), F.concat(F.lit("Chunk "), F.col("ord").cast("string")).alias("title"), F.col("text").alias("body"), F.array(F.lit(1), F.col("ord")).alias("path_ord"))
    up = round_robin_clusters(chunks)
    up = up.select("doc_id", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("node_id"), F.concat(F.lit("Cluster "), F.col("cluster").cast("string")).alias("title"), F.col("summary").alias("body"), F.array(F.lit(0), F.col("cluster")).alias("path_ord"))
    own = up.unionByName(leaf).withColumn("page_ref", F.lit("1"))
    score = T.jaccard(T.char_ngrams("question"), T.char_ngrams("body"))
    pairs = questions.select("question_id", "doc_id", "question").join(own, "doc_id").withColumn("score", F.round(score, DIGITS))
    best = _ranked(pairs, max(branches, 5))
    some = F.max("score").over(Window.partitionBy("question_id"))
    return best.withColumn("some", some).where((F.col("score") > 0) | (F.col("some") == 0)).drop("some")


def _f1_of_nodes(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """Nodes that share a token with the question, with f1, the multiset token F1 of both; a node called ROOT is left out."""
    own = _prepared(nodes, questions)
    x, y = _bags(own.where("node_id <> 'ROOT'"), questions, T.tokens_cjk, "words")
    met = y.join(x, ["doc_id", "t"]).groupBy("question_id", "doc_id", "node_id", "asked", "len").agg(F.sum(F.least("x", "y")).alias("n"))
    met = met.select("question_id", "doc_id", "node_id", (2.0 * F.col("n") / (F.col("asked") + F.col("len"))).alias("f1"))
    return met.join(own.select("doc_id", "path_ord", "depth", *NODE), ["doc_id", "node_id"])


def _by_f1(met: DataFrame, k: Column | int, shallow: bool) -> DataFrame:
    score = F.col("f1") * F.pow(F.lit(0.9), F.col("depth")) if shallow else F.col("f1")
    return _ranked(met.withColumn("score", F.round(score, DIGITS)), k)


def tree_dfs(nodes: DataFrame, questions: DataFrame, branches: int) -> DataFrame:
    """The nodes of the best token F1, times 0.9 for each level."""
    return _by_f1(_f1_of_nodes(nodes, questions), branches, True)


def tree_beam(nodes: DataFrame, questions: DataFrame, branches: int) -> DataFrame:
    """The nodes of the best token F1, five at least."""
    return _by_f1(_f1_of_nodes(nodes, questions), max(branches, 5), False)


def tree_policy(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, chosen): dfs where one child of the root is clearly the best by token F1 or there are fewer than two, else beam."""
    met = _f1_of_nodes(nodes, questions)
    roots = questions.select("question_id", "doc_id").join(_prepared(nodes, questions).where("depth = 1").select("doc_id", "node_id"), "doc_id")
    roots = roots.join(met.select("question_id", "node_id", "f1"), ["question_id", "node_id"], "left").select(F.col("question_id").alias("query_id"), "doc_id", F.round(F.coalesce("f1", F.lit(0.0)), DIGITS).alias("score"))
    said = traverse.choose_algorithm(roots).select(F.col("query_id").alias("question_id"), F.col("algorithm").alias("chosen"))
    return questions.select("question_id").join(said, "question_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit("dfs")))


def tree_auto(nodes: DataFrame, questions: DataFrame, branches: int) -> DataFrame:
    """tree_dfs or tree_beam, as tree_policy chooses for each question."""
    both = _f1_of_nodes(nodes, questions).join(tree_policy(nodes, questions), "question_id")
    return _by_f1(both.where("chosen = 'dfs'"), branches, True).unionByName(_by_f1(both.where("chosen = 'beam'"), max(branches, 5), False))


#: Systems that choose a way for each question, and the plan that says which.
POLICIES: dict[System, Callable[[DataFrame, DataFrame], DataFrame]] = {tree_auto: tree_policy}
SYSTEMS: dict[str, System] = {"bm25": bm25, "dense": dense, "flatrag": flat, "raptor": raptor, "treerag_dfs": tree_dfs, "treerag_beam": tree_beam, "treerag_auto": tree_auto}


def extractive(hits: DataFrame) -> DataFrame:
    """(question_id, answer, retrieved): titles and bodies in rank order with their pages, and the nodes' ids."""
    entry = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(": "), "body"))
    page = F.when(F.coalesce("page_ref", F.lit("")) != "", F.concat(F.lit(" [p."), "page_ref", F.lit("]"))).otherwise("")
    rows = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(entry, page).alias("part"), "node_id"))).alias("h"))
    return rows.select("question_id", F.array_join(F.transform("h", lambda x: x["part"]), " ").alias("answer"), F.transform("h", lambda x: x["node_id"]).alias("retrieved"))


def citation_available(hits: DataFrame) -> DataFrame:
    """(question_id, available): whether any node found says its page."""
    return hits.groupBy("question_id").agg(F.bool_or(F.coalesce("page_ref", F.lit("")) != "").alias("available"))


ROWS = (
    "question_id long, doc_id long, category string, answer string, retrieved array<string>, retrieved_count int, context_tokens long, "
    "chosen string, rouge_l double, bertscore double, entity_recall double"
)
SCORES = ("rouge_l", "bertscore", "entity_recall")


def scored(nodes: DataFrame, questions: DataFrame, system: System, branches: int = 3, generate: Column | None = None) -> DataFrame:
    """ROWS of one system: an answer for every question, with its scores against the expected text.

    generate turns (question, context) into an answer, by default the context itself. A question without hits has an
    empty answer.
    """
    hits = system(nodes, questions, branches)
    own = questions.join(POLICIES[system](nodes, questions), "question_id") if system in POLICIES else questions.withColumn("chosen", F.lit(None).cast("string"))
    own = own if "category" in questions.columns else own.withColumn("category", F.lit(None).cast("string"))
    rows = own.join(extractive(hits).withColumnRenamed("answer", "context"), "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    rows = rows.withColumn("answer", F.col("context") if generate is None else generate)
    marks = S.evaluate(rows.select("question_id", "expected", "answer"), "question_id", "expected", "answer", SCORES)
    none = F.array().cast("array<string>")
    return rows.join(marks, "question_id").select(
        "question_id", "doc_id", "category", "answer", F.coalesce("retrieved", none).alias("retrieved"), F.size(F.coalesce("retrieved", none)).alias("retrieved_count"),
        F.floor(F.length("context") / 4).alias("context_tokens"), "chosen", *SCORES,
    )


class Experiment:
    """Results below `root`: a folder for each finished system, which appears whole; judges' scores in a versioned table beside them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.scores = VersionedTable(spark, f"{self.root}/judged", "system string, question_id long, llm_judge double")

    def finished(self, system: str, n_questions: int | None = None) -> bool:
        """Whether a system's results are there, for so many questions."""
        at = f"{self.root}/system={system}"
        return exists(self.spark, at) and (n_questions is None or self.spark.read.schema(ROWS).parquet(at).count() == n_questions)

    def run(self, nodes: DataFrame, questions: DataFrame, systems: dict[str, System] | None = None, branches: int = 3, generate: Column | None = None) -> list[str]:
        """Runs the systems that are not finished for these questions; which those were. A failure leaves the earlier ones' results in place."""
        n, ran = questions.count(), []
        for name, system in (SYSTEMS if systems is None else systems).items():
            if self.finished(name, n):
                continue
            aside = f"{self.root}/.running-{name}"
            scored(nodes, questions, system, branches, generate).write.mode("overwrite").parquet(aside)
            appear(self.spark, aside, f"{self.root}/system={name}", replace=True)
            ran.append(name)
        return ran

    def results(self, systems: list[str] | None = None) -> DataFrame:
        """(system, ROWS, llm_judge) of the finished systems; llm_judge is null until judge() has run."""
        names = [s for s in (SYSTEMS if systems is None else systems) if self.finished(s)]
        parts = [self.spark.read.schema(ROWS).parquet(f"{self.root}/system={s}").withColumn("system", F.lit(s)) for s in names]
        if not parts:
            return self.spark.createDataFrame([], f"system string, {ROWS}, llm_judge double")
        rows = reduce(DataFrame.unionByName, parts)
        return rows.join(self.scores.read(), ["system", "question_id"], "left").select("system", *[c for c in rows.columns if c != "system"], "llm_judge")

    def judge(self, questions: DataFrame, score: Column, systems: list[str] | None = None) -> int:
        """Replaces the judge's scores by `score`, a column over (question, expected, answer); answers stay as they are. The scores' version."""
        rows = self.results(systems).drop("llm_judge").join(questions.select("question_id", "question", "expected"), "question_id")
        new = rows.select("system", "question_id", score.cast("double").alias("llm_judge"))
        keep = self.results(systems).select("system").distinct()
        return self.scores.update(lambda old: old.join(F.broadcast(keep), "system", "left_anti").unionByName(new))


def summary(rows: DataFrame) -> DataFrame:
    """One row a system: means of its scores (nulls left out), its size, and how often its policy chose dfs."""
    mean = lambda c: F.round(F.avg(c), DIGITS).alias(c)
    dfs = F.round(F.avg(F.when(F.col("chosen").isNotNull(), (F.col("chosen") == "dfs").cast("double"))), DIGITS)
    return rows.groupBy("system").agg(F.count("*").alias("n"), *[mean(c) for c in (*SCORES, "llm_judge", "context_tokens", "retrieved_count")], dfs.alias("dfs_fraction"))


def significance(rows: DataFrame, against: str = "treerag_beam", metric: str = "rouge_l") -> DataFrame:
    """Exact paired t tests of one system against every other, over the questions that both answered."""
    own = rows.where(F.col("system") == against).select("question_id", F.col(metric).alias("a"))
    other = rows.where(F.col("system") != against).select("system", "question_id", F.col(metric).alias("b"))
    return paired_t_exact(own.join(other, "question_id").where("a is not null and b is not null"), ("system",))


KS, NDCG_KS = (1, 3, 5), (3, 5)
CITED = r"\[p\.(\d+)"


def case_metrics(rows: DataFrame, gold: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(system, question_id, category, metric, value): every metric of every case in one long table.

    gold (question_id, node_id) gives precision, recall and F1 at 1, 3 and 5 and NDCG at 3 and 5; pages (question_id, page),
    the pages that should be cited, gives citation_accuracy, the share of them in the answer. Questions
    without gold have neither; all have answer_length and context_size (in tokens).
    """
    run = rows.select("system", F.col("question_id").alias("query_id"), F.posexplode("retrieved").alias("p", "doc_id")).withColumn("rank", F.col("p") + 1).drop("p")
    cases = rows.select("system", "question_id", "category")
    qrels = gold.select(F.col("question_id").alias("query_id"), F.col("node_id").alias("doc_id")).distinct()
    per = M.rank_metrics(run, qrels, KS).withColumnRenamed("query_id", "question_id")
    wanted = cases.join(qrels.select(F.col("query_id").alias("question_id")).distinct(), "question_id").crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in KS], "k int")))
    per = wanted.join(per, ["system", "question_id", "k"], "left").fillna(0.0, ["precision", "recall", "f1", "ndcg"])
    at = lambda name: F.concat(F.lit(f"{name}@"), F.col("k").cast("string"))
    cells = [F.struct(at(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")] + [F.when(F.col("k").isin(*NDCG_KS), F.struct(at("ndcg").alias("metric"), F.col("ndcg").alias("value")))]
    out = per.select("system", "question_id", "category", F.inline(F.array_compact(F.array(*cells))))
    sizes = F.array(F.struct(F.lit("answer_length").alias("metric"), F.length("answer").cast("double").alias("value")), F.struct(F.lit("context_size").alias("metric"), F.col("context_tokens").cast("double").alias("value")))
    out = out.unionByName(rows.select("system", "question_id", "category", F.inline(sizes)))
    if pages is not None:
        cited = rows.select("system", "question_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(CITED), F.lit(1)))).alias("page"))
        want = pages.select("question_id", F.col("page").cast("string").alias("page")).distinct()
        right = cited.join(want, ["question_id", "page"]).groupBy("system", "question_id").agg(F.count("*").alias("right"))
        acc = cases.join(want.groupBy("question_id").agg(F.count("*").alias("all")), "question_id").join(right, ["system", "question_id"], "left")
        out = out.unionByName(acc.select("system", "question_id", "category", F.lit("citation_accuracy").alias("metric"), (F.coalesce("right", F.lit(0)) / F.col("all")).alias("value")))
    return out


def report(cases: DataFrame) -> DataFrame:
    """(system, category, metric, mean, std, n): the long table over all categories (category null, whole true) and by category, in one pass."""
    grid = cases.groupingSets([["system", "metric"], ["system", "category", "metric"]], "system", "category", "metric")
    return grid.agg(
        F.round(F.avg("value"), DIGITS).alias("mean"), F.round(F.stddev_pop("value"), DIGITS).alias("std"), F.count("*").alias("n"), (F.grouping("category") == 1).alias("whole")
    ).select("system", "category", "metric", "whole", "mean", "std", "n")


def ablation_grid(nodes: DataFrame, questions: DataFrame, gold: DataFrame, variants: dict[str, System], branches: tuple[int, ...]) -> DataFrame:
    """(system, branches, metric, mean): retrieval metrics of every variant under every number of branches."""
    runs = [v(nodes, questions, k).select(F.lit(f"{name}|{k}").alias("system"), F.col("question_id").alias("query_id"), F.col("node_id").alias("doc_id"), "rank") for name, v in variants.items() for k in branches]
    macro = M.macro(M.rank_metrics(reduce(DataFrame.unionByName, runs), gold.select(F.col("question_id").alias("query_id"), F.col("node_id").alias("doc_id")), KS))
    parts = F.split("system", r"\|")
    return macro.withColumns({"branches": F.element_at(parts, 2).cast("int"), "system": F.element_at(parts, 1)})
