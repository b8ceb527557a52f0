"""Request logs: cache keys and hits, rate limits, routing, call accounting, question sets."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def cache_key(question: Column, files: Column, *rest: Column) -> Column:
    """SHA-256 of canonical JSON: the question trimmed (ASCII ones in lower case), files sorted, all further parameters in order."""
    q = F.trim(question)
    q = F.when(q.rlike(r"^[\x00-\x7F]*$"), F.lower(q)).otherwise(q)
    named = [x.alias(f"p{i}") for i, x in enumerate(rest)]
    return F.sha2(F.to_json(F.struct(q.alias("q"), F.array_sort(files).alias("files"), *named)), 256)


def ttl_hits(log: DataFrame, key: str, ts: str, ttl_s: float, ties: str) -> DataFrame:
    """Adds hit: whether the entry that the last miss of the key stored is at most ttl_s old. One pass along each key's requests."""
    schema = f"{key} {log.schema[key].dataType.simpleString()}, {ties} {log.schema[ties].dataType.simpleString()}, hit boolean"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", ties])
        since, hits = None, []
        for now in rows["t"]:
            hits.append(since is not None and now - since <= ttl_s)
            since = since if hits[-1] else now
        return pd.DataFrame({key: rows[key], ties: rows[ties], "hit": hits})

    return log.select(key, ties, F.col(ts).cast("double").alias("t")).groupBy(key).applyInPandas(one, schema)


def lru_hits(log: DataFrame, cache: str, key: str, ts: str, ties: str, capacity: int = 100, ttl_s: float = 3600.0) -> DataFrame:
    """(cache, ties, hit, evicted) of caches of `capacity` entries, the least recently used one leaving first, entries for ttl_s at most.

    A miss stores its entry; at capacity something leaves even where the key itself is stored anew. One cache's log is one
    sequence by nature, hence one group; the state is `capacity` entries.
    """
    schema = f"{cache} {log.schema[cache].dataType.simpleString()}, {ties} {log.schema[ties].dataType.simpleString()}, hit boolean, evicted boolean"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", ties])
        held: OrderedDict = OrderedDict()
        out = []
        for k, now in zip(rows["k"], rows["t"]):
            if k in held and now - held[k] > ttl_s:
                del held[k]
            hit, gone = k in held, False
            if hit:
                held.move_to_end(k)
            else:
                if len(held) >= capacity:
                    held.popitem(last=False)
                    gone = True
                held[k] = now
            out.append((hit, gone))
        return pd.DataFrame({cache: rows[cache], ties: rows[ties], "hit": [o[0] for o in out], "evicted": [o[1] for o in out]})

    return log.select(cache, ties, F.col(key).alias("k"), F.col(ts).cast("double").alias("t")).groupBy(cache).applyInPandas(one, schema)


def cache_statistics(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits, misses and the hit rate as text."""
    h = F.count(F.when(F.col("hit"), 1))
    return hits.groupBy(*by).agg(h.alias("hits"), (F.count("*") - h).alias("misses"), F.format_string("%.2f%%", F.when(F.count("*") > 0, 100.0 * h / F.count("*")).otherwise(0.0)).alias("hit_rate"))


def short_key(question: Column, files: Column, *rest: Column, size: int = 16) -> Column:
    """The first digits of cache_key, for shared backends."""
    return F.substring(cache_key(question, files, *rest), 1, size)


def admit(times: list[float], most: int, window_s: float) -> list[tuple[bool, int]]:
    """For ascending request times: whether each is admitted, else after how many seconds to retry. Denied requests leave no trace."""
    held: list[float] = []
    out = []
    for now in times:
        held = [t for t in held if t >= now - window_s]
        if len(held) >= most:
            out.append((False, int(held[0] + window_s - now) + 1))
        else:
            held.append(now)
            out.append((True, 0))
    return out


def rate_limit(log: DataFrame, key: str, ts: str, ties: str, most: int, window_s: float) -> DataFrame:
    """(key, ties, allowed, retry_after) of a sliding-window log limiter."""
    schema = f"{key} {log.schema[key].dataType.simpleString()}, {ties} {log.schema[ties].dataType.simpleString()}, allowed boolean, retry_after int"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", ties])
        got = admit(rows["t"].tolist(), most, window_s)
        return pd.DataFrame({key: rows[key], ties: rows[ties], "allowed": [g[0] for g in got], "retry_after": [g[1] for g in got]})

    return log.select(key, ties, F.col(ts).cast("double").alias("t")).groupBy(key).applyInPandas(one, schema)


def route(queries: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, doc_id, score, rank): the documents whose names and summaries share most words with the query."""
    from .retrieval import best_overlap

    return best_overlap(docs, queries, "share", k)


def call_costs(log: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Calls, tokens and time of a call log (prompt_tokens, completion_tokens, latency_s)."""
    return log.groupBy(*by).agg(F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.avg("latency_s"), 6).alias("latency_s"))


def offline_questions(nodes: DataFrame, factual: int = 5, linked: int = 3) -> DataFrame:
    """Question rows from content nodes in order: one for each of the first `factual`, one for each of the first `linked` neighbours, and comparisons two apart."""
    w = Window.partitionBy("doc_id").orderBy("path_ord")
    n = nodes.withColumns({"i": F.row_number().over(w), "next": F.lead("title").over(w), "after": F.lead("title", 2).over(w), "next_id": F.lead("node_id").over(w), "after_id": F.lead("node_id", 2).over(w)})
    one = n.where(F.col("i") <= factual).select("doc_id", F.lit("factual").alias("category"), "i", F.concat(F.lit("What does "), "title", F.lit(" say?")).alias("question"), F.array("node_id").alias("expected"))
    two = n.where((F.col("i") <= linked) & F.col("next").isNotNull()).select("doc_id", F.lit("multi_hop").alias("category"), "i", F.concat(F.lit("How does "), "title", F.lit(" lead to "), "next", F.lit("?")).alias("question"), F.array("node_id", "next_id").alias("expected"))
    three = n.where((F.col("i") <= 2) & F.col("after").isNotNull()).select("doc_id", F.lit("comparative").alias("category"), "i", F.concat(F.lit("How do "), "title", F.lit(" and "), "after", F.lit(" differ?")).alias("question"), F.array("node_id", "after_id").alias("expected"))
    return one.unionByName(two).unionByName(three)


CYCLE = (("definition", 6), ("mechanism", 4), ("comparison", 3), ("summary", 1))


def cycled_questions(nodes: DataFrame, counts: tuple[tuple[str, int], ...] = CYCLE) -> DataFrame:
    """(doc_id, category, i, question, expected): so many questions of each category, going round the content nodes of a document in order."""
    n = nodes.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("path_ord")) - 1)
    size = nodes.groupBy("doc_id").agg(F.count("*").alias("size"))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("k")) for c, k in counts])).alias("c")
    want = size.select("doc_id", "size", kinds).select("doc_id", "size", "c.category", F.explode(F.sequence(F.lit(0), F.col("c.k") - 1)).alias("i"))
    j = want.withColumn("at", F.pmod("i", F.col("size")).cast("int")).join(n.select("doc_id", "at", "title", "node_id"), ["doc_id", "at"])
    return j.select("doc_id", "category", "i", F.concat(F.col("category"), F.lit(": "), F.col("title"), F.lit("?")).alias("question"), F.col("node_id").alias("expected"))


def add_questions(questions: DataFrame, new: DataFrame) -> DataFrame:
    """questions (question_id, doc_id, question) and the new ones (doc_id, question) that are not among them, under the first twelve digits of their md5."""
    ident = F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "question").cast("binary")), 1, 12)
    fresh = new.select("doc_id", "question").distinct().join(questions.select("doc_id", "question"), ["doc_id", "question"], "left_anti")
    return questions.select("question_id", "doc_id", "question").unionByName(fresh.select(ident.alias("question_id"), "doc_id", "question"))


def catalog_update(catalog: DataFrame, gone: DataFrame, saved: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, status): the catalog without `gone`, with `saved` in place of equal keys; status existing, replaced or created."""
    left = catalog.join(gone.select(key), key, "left_anti")
    old = left.select(key).withColumn("__old", F.lit(True))
    new = saved.join(old, key, "left").withColumn("status", F.when(F.col("__old"), "replaced").otherwise("created")).drop("__old")
    return left.join(saved.select(key), key, "left_anti").withColumn("status", F.lit("existing")).unionByName(new)


def filter_questions(questions: DataFrame, domains: tuple[str, ...] | None = None, difficulties: tuple[str, ...] | None = None) -> DataFrame:
    """The questions (domain, difficulty, ...) of the named domains and difficulties; None: of all."""
    out = questions if domains is None else questions.where(F.lower("domain").isin(*[d.lower() for d in domains]))
    return out if difficulties is None else out.where(F.lower("difficulty").isin(*[d.lower() for d in difficulties]))


def source_nodes(nodes: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(question_id, node_id, n, rank): the k nodes of each question's own tree that share most of its words, ties in the order of the tree."""
    q = questions.select("question_id", "doc_id", F.explode(T.word_set("question")).alias("t"))
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    n = nodes.select("doc_id", "node_id", "path_ord", F.explode(T.word_set(body)).alias("t"))
    met = q.join(n, ["doc_id", "t"]).groupBy("question_id", "node_id", "path_ord").agg(F.count("*").alias("n"))
    w = Window.partitionBy("question_id").orderBy(F.desc("n"), "path_ord")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("question_id", "node_id", "n", "rank")


def question_problems(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, problem, n): repeated questions, unknown documents, missing fields."""
    twice = questions.groupBy("doc_id", "question").agg(F.count("*").alias("n")).where("n > 1").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("repeated question").alias("problem"), "n")
    lost = questions.join(docs.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("unknown document").alias("problem"), "n")
    bare = questions.where("coalesce(trim(question), '') = ''").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("no question").alias("problem"), "n")
    return twice.unionByName(lost).unionByName(bare)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user turns and the assistant turn that follows each."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.withColumns({"r": F.lead("role").over(w), "answer": F.lead("text").over(w)}).where("role = 'user' and r = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")
