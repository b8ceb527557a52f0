"""Context building under a token budget, near-duplicate merging and cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import folds

# How cross-references are written, English and Korean; group 1 is the number.
REFERENCES = {
    "section": r"(?i)(?:section|sec\.)\s+([0-9]+(?:\.[0-9]+)*)",
    "chapter": r"(?i)chapter\s+([0-9]+)",
    "table": r"(?i)table\s+([0-9]+(?:[.-][0-9]+)*)",
    "figure": r"(?i)(?:figure|fig\.)\s+([0-9]+(?:[.-][0-9]+)*)",
    "appendix": r"(?i)appendix\s+([A-Z])",
    "page": r"(?i)(?:page|p\.)\s*([0-9]+)",
    "section_ko": r"([0-9]+(?:\.[0-9]+)*)\s*절",
    "chapter_ko": r"제?\s*([0-9]+)\s*장",
    "table_ko": r"표\s*([0-9]+(?:[.-][0-9]+)*)",
    "figure_ko": r"그림\s*([0-9]+(?:[.-][0-9]+)*)",
}


def relevance(chunks: DataFrame, key: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """Adds score to chunks (query, title, text): half cosine of term counts, 0.3 for the share of the query's terms, 0.2 where the title holds one of them."""
    t = lambda c: T.content_tokens(F.col(c))
    both = chunks.select(*key, "query", "title", "text", t("query").alias("q"), T.content_tokens(F.concat_ws(" ", "title", "text")).alias("d"))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x)).cast("double")
    terms = F.array_distinct("q")
    product = F.aggregate(F.transform(terms, lambda x: count(F.col("q"), x) * count(F.col("d"), x)), F.lit(0.0), lambda s, x: s + x)
    length = lambda c: F.sqrt(F.aggregate(F.transform(F.array_distinct(c), lambda x: F.pow(count(F.col(c), x), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    cosine = F.when((F.size("q") > 0) & (F.size("d") > 0), product / (length("q") * length("d"))).otherwise(0.0)
    share = F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, F.array_distinct("d"))) / F.size(terms)).otherwise(0.0)
    titled = F.exists(terms, lambda x: F.contains(F.lower("title"), x)).cast("double")
    return both.withColumn("score", F.round(0.5 * cosine + 0.3 * share + 0.2 * titled, 6)).drop("q", "d")


def keep_relevant(scored: DataFrame, least: float = 0.2, fallback: int = 3) -> DataFrame:
    """Chunks of at least `least`, or a query's best `fallback` where it has none."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumns({"rn": F.row_number().over(best), "top": top}).where((F.col("score") >= least) | ((F.col("top") < least) & (F.col("rn") <= fallback))).drop("rn", "top")


def leaders(items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(grp, ord, leader): greedy in order, each item joins the first leader whose word set is similar enough, or leads.

    items (grp, ord, text); a group's items come one after the other (see folds).
    """
    folded = folds.streamed_leaders(items, threshold)
    return folded.select(F.col("grp").cast(items.schema["grp"].dataType).alias("grp"), "ord", "leader")


def merge(items: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each leader: best member's id with "_merged" where there are several, first three distinct texts, sorted pages, best score."""
    j = items.join(groups, ["grp", "ord"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    best = F.max_by("chunk_id", F.struct("score", (-F.col("ord")).alias("o")))
    return j.groupBy("grp", "leader").agg(
        F.concat(best, F.when(F.count("*") > 1, "_merged").otherwise("")).alias("chunk_id"), F.array_join(F.slice(F.array_distinct(texts), 1, 3), " | ").alias("text"),
        F.array_join(F.array_sort(F.collect_set("page_ref")), ", ").alias("pages"), F.max("score").alias("score"), F.count("*").alias("n_merged"),
    )


def budget(chunks: DataFrame, tokens: int) -> DataFrame:
    """(grp, ord, n_tokens, taken): by descending score each chunk that still fits is taken; one too large is taken only first and alone.

    chunks (grp, ord, score, n_tokens); a group is one query's context.
    """
    arr = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "n_tokens")))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(False).alias("stop"), F.array().cast("array<struct<ord:int,n_tokens:bigint,taken:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["stop"] & (acc["total"] + x["n_tokens"] <= tokens)
        alone = ~acc["stop"] & ~fits & (acc["total"] == 0)
        take = fits | alone
        row = F.array(F.struct(x["ord"].cast("int").alias("ord"), x["n_tokens"].cast("bigint").alias("n_tokens"), take.alias("taken")))
        return F.struct((acc["total"] + F.when(take, x["n_tokens"]).otherwise(0)).cast("long").alias("total"), (acc["stop"] | alone).alias("stop"), F.concat(acc["out"], row).alias("out"))

    folded = chunks.groupBy("grp").agg(arr.alias("c")).select("grp", F.explode(F.aggregate("c", zero, step)["out"]).alias("x"))
    return folded.select("grp", "x.ord", "x.n_tokens", "x.taken")


def compress(hits: DataFrame, tokens: int = 2000, least: float = 0.2, similar: float = 0.7, chars_each: int = 3) -> DataFrame:
    """The stages in a row over hits (query_id, chunk_id, query, title, text, page_ref, rank): scored, kept, merged by leader, cut to the budget.

    (query_id, place, chunk_id, text, pages, score, n_merged, n_tokens): what is in the context, best first.
    """
    kept = keep_relevant(relevance(hits, ("query_id", "chunk_id", "rank", "page_ref")), least)
    items = kept.select(F.col("query_id").alias("grp"), F.col("rank").cast("int").alias("ord"), "chunk_id", F.concat_ws(" ", "title", "text").alias("text"), "page_ref", "score")
    merged = merge(items, leaders(items.select("grp", "ord", "text"), similar)).withColumn("n_tokens", F.floor(F.length("text") / chars_each))
    taken = budget(merged.select("grp", F.col("leader").alias("ord"), "score", "n_tokens"), tokens).where("taken").select("grp", F.col("ord").alias("leader"))
    out = merged.join(taken, ["grp", "leader"])
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "leader"))
    return out.select(F.col("grp").alias("query_id"), place.alias("place"), "chunk_id", "text", "pages", "score", "n_merged", "n_tokens")


def compression_report(hits: DataFrame, compressed: DataFrame, chars_each: int = 3) -> DataFrame:
    """For each query: pieces and tokens before and after, the ratio and the tokens saved."""
    before = hits.groupBy("query_id").agg(F.count("*").alias("n_before"), F.sum(F.floor(F.length("text") / chars_each)).alias("tokens_before"))
    after = compressed.groupBy("query_id").agg(F.count("*").alias("n_after"), F.sum("n_tokens").alias("tokens_after"))
    j = before.join(after, "query_id", "left").fillna(0, ["n_after", "tokens_after"])
    return j.withColumns({"ratio": F.round(F.col("n_after") / F.col("n_before"), 6), "tokens_saved": F.greatest(F.lit(0), F.col("tokens_before") - F.col("tokens_after"))})


def joined(compressed: DataFrame) -> DataFrame:
    """(query_id, context): the pieces in order under their pages."""
    part = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] (p."), F.col("pages"), F.lit(")\n"), F.col("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"])
    return compressed.groupBy("query_id").agg(F.array_join(listed, "\n\n").alias("context"))


NO_CONTEXT = {"ko": "관련 내용을 찾지 못했습니다.", "ja": "関連する内容が見つかりませんでした。", "en": "Nothing relevant was found."}


def no_context_answer(question: Column, answers: dict[str, str] = NO_CONTEXT) -> Column:
    """What to say without a context, in the question's language."""
    lang = T.language(question)
    return F.coalesce(*[F.when(lang == k, F.lit(v)) for k, v in answers.items()])


def enhanced_question(question: Column, title: Column, page: Column, summary: Column) -> Column:
    """The question with the node it is asked about; as it is without one."""
    note = F.concat(question, F.lit("\n\n[Section: "), title, F.lit(" (p."), F.coalesce(page, F.lit("N/A")), F.lit(")] "), F.coalesce(summary, F.lit("")))
    return F.coalesce(note, question)


def prompts(contexts: DataFrame, templates: DataFrame) -> DataFrame:
    """(query_id, prompt): contexts (query_id, question, context, domain) in the template (domain, lang, head) of their domain and question's language; "general" for others."""
    c = contexts.withColumn("lang", T.language("question"))
    own = templates.select("domain", "lang", F.col("head").alias("own"))
    rest = templates.where("domain = 'general'").select("lang", F.col("head").alias("rest"))
    j = c.join(F.broadcast(own), ["domain", "lang"], "left").join(F.broadcast(rest), "lang", "left")
    return j.select("query_id", F.concat(F.coalesce("own", "rest", F.lit("")), F.lit("\n\nContext:\n"), "context", F.lit("\n\nQuestion: "), "question").alias("prompt"))


def detect_references(texts: DataFrame, patterns: dict[str, str] = REFERENCES) -> DataFrame:
    """(doc_id, kind, number) of every mention, one row each, by all patterns."""

    def mentions(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind.removesuffix("_ko")).alias("kind"), x.alias("number")))

    found = F.concat(*[mentions(k, p) for k, p in patterns.items()])
    return texts.select("doc_id", F.explode(found).alias("r")).select("doc_id", "r.kind", "r.number")


def reference_keys(nodes: DataFrame) -> DataFrame:
    """(doc_id, key, node_id): ids, lower-case titles and the numbers in them; of nodes with one key the last in depth-first order wins."""

    def numbered(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("title", F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(kind.removesuffix("_ko") + "_"), x))

    numbers = [numbered(k, p) for k, p in REFERENCES.items()]
    keys = F.array_distinct(F.concat(F.array(F.lower("node_id"), F.lower("title")), *numbers))
    rows = nodes.select("doc_id", "node_id", "path_ord", F.explode(keys).alias("key"))
    return rows.groupBy("doc_id", "key").agg(F.max_by("node_id", "path_ord").alias("node_id"))


def resolve_references(references: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds node_id: the node under "kind_number", else under the number alone; null for none."""
    full = references.withColumn("key", F.concat_ws("_", "kind", "number"))
    exact = full.join(keys.withColumnRenamed("node_id", "n1"), ["doc_id", "key"], "left")
    bare = keys.select("doc_id", F.col("key").alias("number"), F.col("node_id").alias("n2"))
    return exact.join(bare, ["doc_id", "number"], "left").select("doc_id", "kind", "number", F.coalesce("n1", "n2").alias("node_id"))
