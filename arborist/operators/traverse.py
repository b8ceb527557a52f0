"""Pruned tree traversal: beam and depth-first, adaptive thresholds, recovery.

beam() goes level by level with a fixed threshold; beam_exact() and dfs_exact() with one that follows the
running counts, which are the state of a (query, tree) pair. All work on any number of trees at once:
joins, one window a level, and folds over arrays of a bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept

DEPTHS = 10


def keyword_evidence(query: Column, title: Column, summary: Column) -> Column:
    """0.4 for the share of the query's keywords in the title, 0.6 for that in the summary; 0.3 without keywords."""
    k = T.query_keywords(query)
    hits = lambda c: F.size(F.filter(k, lambda x: F.contains(F.lower(c), x))) / F.size(k)
    return F.when(F.size(k) == 0, 0.3).otherwise(0.4 * hits(title) + 0.6 * hits(summary))


def term_share(query: Column, text: Column) -> Column:
    """Share of a question's terms found in the text; 0.5 when it has none."""
    k = T.question_terms(query)
    return F.when(F.size(k) == 0, 0.5).otherwise(F.size(F.filter(k, lambda x: F.contains(F.lower(text), x))) / F.size(k))


def beam_score(semantic: Column, keyword: Column, depth: Column) -> Column:
    return 0.6 * semantic + 0.2 * keyword + 0.2 * F.greatest(F.lit(0.3), 1.0 - 0.1 * depth)


def adaptive_threshold(base: Column, selected: Column, total: Column, query_length: Column, depth: Column) -> Column:
    fr = F.when(total == 0, 0.0).otherwise(1.0 - selected / total)
    rate = F.when(fr > 0.9, -0.15).when(fr > 0.7, -0.10).when(fr < 0.3, 0.10).otherwise(0.0)
    size = F.when(query_length < 10, 0.10).when(query_length > 100, -0.05).otherwise(0.0)
    deep = F.when(depth <= 1, -0.05).when(depth >= 4, 0.05).otherwise(0.0)
    return base + rate + size + deep


def dual_stage(semantic: Column, confidence: Column, keyword: Column, threshold: Column) -> Column:
    """Struct of relevant, score, confidence and reason."""
    score = 0.7 * semantic + 0.3 * keyword
    sure = 0.7 * confidence + 0.3 * F.when(keyword > 0.5, 1.0).otherwise(0.3)
    relevant = score > threshold
    reason = (
        F.when(relevant & (semantic >= 0.5) & (keyword >= 0.5), "both agree")
        .when(relevant & (semantic >= keyword), "semantic")
        .when(relevant, "keyword")
        .when((semantic < 0.5) & (keyword < 0.5), "neither")
        .otherwise("below threshold")
    )
    return F.struct(relevant.alias("relevant"), F.round(score, 6).alias("score"), F.round(sure, 6).alias("confidence"), reason.alias("reason"))


def over_filtered(selected: Column, filtered: Column) -> Column:
    return ((selected == 0) & (filtered >= 1)) | ((selected < 2) & (filtered > 2 * selected))


def recover(filtered: DataFrame, keep: int = 3) -> DataFrame:
    """Of rejected nodes (query_id, query, node_id, title, path, visit) the first `keep` whose titles hold two critical keywords, or one in three words or more."""
    k = T.critical_keywords("query")
    hits = F.size(F.filter(F.array_distinct(k), lambda x: F.contains(F.lower(F.col("title")), x)))
    good = filtered.where((hits >= 2) | ((hits >= 1) & (F.size(T.white_space_tokens("title")) >= 3)))
    first = good.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("visit", "node_id"))).where(F.col("n") <= keep)
    return first.select("query_id", "node_id", F.concat(F.lit("[RECOVERED] "), F.coalesce("path", F.lit(""))).alias("path"), F.lit(1).alias("depth"), F.lit(True).alias("recovered"))


def choose_algorithm(scores: DataFrame, margin: float = 0.15) -> DataFrame:
    """(query_id, doc_id, algorithm): dfs with fewer than two root children or a clear first one, else beam."""
    best = scores.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    return best.select("query_id", "doc_id", F.when((F.size("s") < 2) | (F.get("s", F.lit(0)) - F.get("s", F.lit(1)) >= margin), "dfs").otherwise("beam").alias("algorithm"))


def beam(nodes: DataFrame, scores: DataFrame, width: int = 5, levels: int = 3, threshold: float = 0.0) -> DataFrame:
    """Hits (query_id, doc_id, node_id, depth, score, path) of a beam over all trees and queries at once.

    nodes (doc_id, node_id, parent_id, depth, title); scores (query_id, doc_id, node_id, score) of the
    nodes that may be entered. A hit is a leaf that was reached, or any node of the last level, with a
    cumulative score of at least threshold.
    """
    if levels > DEPTHS:
        raise ValueError(f"at most {DEPTHS} levels")
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("k"))
    roots = nodes.where("depth = 0").select("doc_id", "node_id", F.col("title").alias("path"))
    front = scores.select("query_id", "doc_id").distinct().join(roots, "doc_id").withColumns({"score": F.lit(1.0), "depth": F.lit(0), "rank": F.lit(1)})
    out = None
    for d in range(levels):
        done = front.join(kids, ["doc_id", "node_id"], "left").where((F.col("k").isNull() if d < levels - 1 else F.lit(True)) & (F.col("score") >= threshold)).select("query_id", "doc_id", "node_id", "depth", "score", "path")
        out = done if out is None else out.unionByName(done)
        if d == levels - 1:
            break
        up = front.select("query_id", "doc_id", F.col("node_id").alias("parent_id"), F.col("score").alias("above"), F.col("path").alias("front"))
        step = nodes.select("doc_id", "node_id", "parent_id", "title").join(up, ["doc_id", "parent_id"]).join(scores.withColumnRenamed("score", "own"), ["query_id", "doc_id", "node_id"])
        step = step.withColumn("score", F.round(F.col("above") * F.col("own"), 6))
        w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "node_id")
        front = step.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= width).select("query_id", "doc_id", "node_id", F.concat("front", F.lit(" > "), "title").alias("path"), "score", F.lit(d + 1).alias("depth"), "rank")
    return out


HITS = "query_id long, doc_id long, node_id string, path string, depth int, score double, recovered boolean"
_CHOSEN = "array<struct<node_id: string, path: string, depth: int, score: double, recovered: boolean>>"


def _hit(node: Column, path: Column, depth: Column, score: Column, recovered: bool) -> Column:
    return F.array(F.struct(node.alias("node_id"), path.alias("path"), depth.cast("int").alias("depth"), score.cast("double").alias("score"), F.lit(recovered).alias("recovered")))


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _routed(nodes: DataFrame, queries: DataFrame, routes: DataFrame) -> DataFrame:
    """(query_id, doc_id, query) of the routed pairs whose tree has a node."""
    trees = nodes.where("depth = 0").select("doc_id").distinct()
    return routes.select("query_id", "doc_id").distinct().join(trees, "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")


def _trees(nodes: DataFrame) -> DataFrame:
    """The nodes with their number of children and a summary that is not null."""
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    return nodes.join(kids, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "parent_id", "ord", "depth", "path_ord", "title", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("kids", F.lit(0)).alias("kids"))


def beam_exact(nodes: DataFrame, queries: DataFrame, routes: DataFrame, width: int = 5, levels: int = 5, base: float = 0.2, semantic: Column | None = None) -> DataFrame:
    """HITS of a beam over every routed (query, tree) at once, with thresholds that follow the running counts.

    The state of a pair is one row: its counts, what it has chosen, and its front of `width` nodes at most,
    best first. A level goes along the fronts in order (a node that may not grow is chosen if its score passes
    the threshold at that moment), joins the children of the others, scores them and keeps the best. Where
    nothing grows, what is left of the front is held against the threshold once more. Work follows the
    nodes that are reached. Node ids are unique in a tree; ties go by the order of the front, then of children.
    """
    sem = F.lit(0.5) if semantic is None else semantic
    trees = kept(_trees(nodes))
    root = trees.where("depth = 0").select("doc_id", F.array(_struct(pos=F.lit(1), node_id=F.col("node_id"), kids=F.col("kids"), score=F.lit(1.0), path=F.col("title"))).alias("front"))
    state = _routed(nodes, queries, routes).join(root, "doc_id").select(
        "query_id", "doc_id", "query", F.length("query").alias("size"), "front", F.lit(0).alias("sel"), F.lit(0).alias("vis"), F.lit(None).cast(_CHOSEN).alias("chosen")
    )
    state = state.withColumn("chosen", F.coalesce("chosen", F.array().cast(_CHOSEN)))
    done = None
    for depth in range(levels):
        d = F.lit(depth)
        grows = lambda x: (x["kids"] > 0) if depth < levels - 1 else F.lit(False)  # noqa: B023, E731

        def step(a: Column, x: Column) -> Column:
            vis = a["vis"] + 1
            take = ~grows(x) & (x["score"] >= adaptive_threshold(F.lit(base), a["sel"], vis, a["size"], d))  # noqa: B023
            hit = _hit(x["node_id"], x["path"], d, x["score"], False)  # noqa: B023
            return _struct(sel=a["sel"] + take.cast("int"), vis=vis, size=a["size"], chosen=F.when(take, F.concat(a["chosen"], hit)).otherwise(a["chosen"]))

        state = state.withColumn("s", F.aggregate("front", _struct(sel=F.col("sel"), vis=F.col("vis"), size=F.col("size"), chosen=F.col("chosen")), step))
        state = kept(state.select("query_id", "doc_id", "query", "size", "front", "s.sel", "s.vis", "s.chosen", F.exists("front", grows).alias("more")))
        still = state.where("not more")
        done = still if done is None else done.unionByName(still)
        up = state.where("more").select("query_id", "doc_id", "query", F.explode(F.filter("front", grows)).alias("f"))
        step2 = up.select("query_id", "doc_id", "query", F.col("f.node_id").alias("parent_id"), F.col("f.pos").alias("above"), F.col("f.score").alias("held"), F.col("f.path").alias("front")).join(trees, ["doc_id", "parent_id"])
        own = beam_score(sem, term_share(F.col("query"), F.concat_ws(" ", "title", "summary")), F.col("depth"))
        best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "above", "ord", "node_id")
        step2 = step2.withColumn("score", F.col("held") * own).withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= width)
        item = _struct(pos=F.col("pos"), node_id=F.col("node_id"), kids=F.col("kids"), score=F.col("score"), path=F.concat("front", F.lit(" > "), "title"))
        fronts = step2.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(item)).alias("front"))
        state = state.where("more").drop("front", "more").join(fronts, ["query_id", "doc_id"])

    def sweep(a: Column, x: Column) -> Column:
        there = F.exists(a["chosen"], lambda c: c["node_id"] == x["node_id"])
        take = ~there & (x["score"] >= adaptive_threshold(F.lit(base), a["sel"], a["vis"], a["size"], a["depth"]))
        hit = _hit(x["node_id"], x["path"], a["depth"], x["score"], False)
        return _struct(sel=a["sel"] + take.cast("int"), vis=a["vis"], size=a["size"], depth=a["depth"], chosen=F.when(take, F.concat(a["chosen"], hit)).otherwise(a["chosen"]))

    ends = done.join(trees.select("doc_id", F.col("node_id").alias("first"), "depth"), (done.doc_id == trees.doc_id) & (F.get("front", F.lit(0))["node_id"] == F.col("first"))).select(done["*"], "depth")
    last = ends.withColumn("s", F.aggregate("front", _struct(sel=F.col("sel"), vis=F.col("vis"), size=F.col("size"), depth=F.col("depth"), chosen=F.col("chosen")), sweep))
    return last.select("query_id", "doc_id", F.inline("s.chosen"))


def dfs_exact(nodes: DataFrame, queries: DataFrame, routes: DataFrame, branches: int = 3, levels: int = 5, base: float = 0.5, semantic: Column | None = None) -> DataFrame:
    """HITS of a depth-first search over every routed (query, tree), with thresholds that follow the running counts.

    A tree's first `branches` children at each node, down to `levels`, are at most (branches^(levels + 1) - 1) /
    (branches - 1) nodes: in pre-order they are one array, along which the search is one fold. A node below a
    rejected one is passed over. Where too little was chosen, up to three rejected nodes whose titles hold the
    query's critical words come back. path_ord counts siblings from 0.
    """
    sem = F.lit(0.5) if semantic is None else semantic
    near = _trees(nodes).where((F.col("depth") <= levels) & F.forall(F.slice("path_ord", F.lit(2), F.greatest(F.size("path_ord") - 1, F.lit(0))), lambda x: x < branches))
    pairs = _routed(nodes, queries, routes).join(near, "doc_id")
    critical = F.array_distinct(T.critical_keywords("query"))
    words = F.size(F.filter(critical, lambda x: F.contains(F.lower("title"), x)))
    pairs = pairs.withColumns({
        "gate": (0.7 * sem + 0.3 * keyword_evidence(F.col("query"), F.col("title"), F.col("summary"))).cast("double"),
        "thin": (F.length("summary") < 20) & (F.length(F.coalesce("title", F.lit(""))) < 10),
        "known": (words >= 2) | ((words >= 1) & (F.size(T.white_space_tokens("title")) >= 3)),
    })
    rows = pairs.groupBy("query_id", "doc_id", F.length("query").alias("size")).agg(F.array_sort(F.collect_list(F.struct("path_ord", "node_id", "title", "depth", "kids", "gate", "thin", "known"))).alias("nodes"))
    none = F.array().cast(_CHOSEN)
    zero = _struct(sel=F.lit(0), pops=F.lit(0), skip=F.lit(1 << 20), size=F.col("size"), paths=F.array().cast("array<string>"), chosen=none, rejected=none, m=F.lit(0))

    def step(a: Column, x: Column) -> Column:
        inside, deep = x["depth"] <= a["skip"], x["depth"] >= levels
        pops = a["pops"] + inside.cast("int")
        met = inside & ~deep
        path = F.when(x["depth"] == 0, x["title"]).otherwise(F.concat(F.element_at(a["paths"], -1 - F.size(a["paths"]) + x["depth"]), F.lit(" > "), x["title"]))
        good = (x["depth"] == 0) | (~x["thin"] & (x["gate"] > adaptive_threshold(F.lit(base), a["sel"], pops, a["size"], x["depth"])))
        take, drop = met & good & ((x["kids"] == 0) | (x["depth"] >= levels - 1)), met & ~good
        back = F.concat(a["rejected"], _hit(x["node_id"], F.concat(F.lit("[RECOVERED] "), path), F.lit(1), x["gate"], True))
        return _struct(
            sel=a["sel"] + take.cast("int"), pops=pops, skip=F.when(drop, x["depth"]).when(inside, F.lit(1 << 20)).otherwise(a["skip"]), size=a["size"],
            paths=F.when(met, F.concat(F.slice(a["paths"], F.lit(1), x["depth"]), F.array(path))).otherwise(a["paths"]),
            chosen=F.when(take, F.concat(a["chosen"], _hit(x["node_id"], path, x["depth"], x["gate"], False))).otherwise(a["chosen"]),
            rejected=F.when(drop & x["known"], back).otherwise(a["rejected"]), m=a["m"] + drop.cast("int"),
        )

    found = rows.select("query_id", "doc_id", F.aggregate("nodes", zero, step).alias("s"))
    more = F.when(over_filtered(F.col("s.sel"), F.col("s.m")), F.slice("s.rejected", 1, 3)).otherwise(none)
    return found.select("query_id", "doc_id", F.inline(F.concat("s.chosen", more)))


def traverse_exact(nodes: DataFrame, queries: DataFrame, algorithm: str, routes: DataFrame, **kwargs) -> DataFrame:
    """HITS of beam_exact ("beam") or dfs_exact ("dfs") on the routed (query_id, doc_id) pairs."""
    if kwargs.get("levels", 1) > DEPTHS:
        raise ValueError(f"at most {DEPTHS} levels")
    return (beam_exact if algorithm == "beam" else dfs_exact)(nodes, queries, routes, **kwargs)


def traverse_auto(nodes: DataFrame, queries: DataFrame, routes: DataFrame, margin: float = 0.15, **kwargs) -> DataFrame:
    """HITS of each routed (query, tree) by the algorithm that its root children's token F1 calls for, and which one (algorithm)."""
    from .retrieval import token_f1_nodes

    kids = nodes.where("depth = 1").select("doc_id", "node_id", "depth", F.concat_ws(" ", "title", "summary").alias("text"))
    f1 = token_f1_nodes(kids, queries, None, 1.0).select("query_id", "node_id", "f1")
    met = kids.select("doc_id", "node_id").join(routes.select("query_id", "doc_id").distinct(), "doc_id").join(f1, ["query_id", "node_id"], "left")
    chosen = choose_algorithm(met.select("query_id", "doc_id", F.coalesce("f1", F.lit(0.0)).alias("score")), margin)
    rest = routes.select("query_id", "doc_id").distinct().join(chosen, ["query_id", "doc_id"], "left").withColumn("algorithm", F.coalesce("algorithm", F.lit("dfs")))
    found = [traverse_exact(nodes, queries, a, routes=rest.where(F.col("algorithm") == a), **kwargs).withColumn("algorithm", F.lit(a)) for a in ("beam", "dfs")]
    return found[0].unionByName(found[1])


def traversal_statistics(hits: DataFrame, nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """For each routed (query, tree): nodes of the tree, hits, recovered ones, deepest hit and best score."""
    size = nodes.groupBy("doc_id").agg(F.count("*").alias("tree_nodes"))
    per = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_hits"), F.count(F.when(F.col("recovered"), 1)).alias("n_recovered"), F.max("depth").alias("deepest"), F.round(F.max("score"), 6).alias("best"))
    j = routes.select("query_id", "doc_id").distinct().join(size, "doc_id").join(per, ["query_id", "doc_id"], "left")
    return j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_hits", "n_recovered")})


def format_hits(hits: DataFrame, nodes: DataFrame, limit: int | None = 500) -> DataFrame:
    """(query_id, doc_id, block): each tree's hits in order as headed paragraphs, texts cut to `limit` characters (None: whole)."""
    body = F.coalesce("text", "summary", F.lit(""))
    part = F.concat(F.lit("### "), F.coalesce("path", "title"), F.lit(" (p."), F.coalesce("page_ref", F.lit("N/A")), F.lit(")\n"), body if limit is None else F.substring(body, 1, limit))
    j = hits.join(nodes.select("doc_id", "node_id", "title", "summary", "text", "page_ref"), ["doc_id", "node_id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node_id", part.alias("part")))), lambda x: x["part"])
    return j.groupBy("query_id", "doc_id").agg(F.array_join(listed, "\n\n").alias("block"))


def flat_context(nodes: DataFrame) -> DataFrame:
    """(doc_id, context): a tree's nodes as one JSON list in pre-order."""
    rows = F.array_sort(F.collect_list(F.struct("path_ord", "node_id", "depth", "title", "summary", "page_ref")))
    return nodes.groupBy("doc_id").agg(F.to_json(F.transform(rows, lambda x: x.dropFields("path_ord"))).alias("context"))
