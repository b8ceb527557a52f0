"""Reasoning graphs: edges, best-first paths, shortest paths; hops are joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def sibling_pairs(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """(doc_id, src, dst, gap): siblings at most `distance` places apart, by window leads rather than a range join."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("ord", "node_id")
    own = nodes.where("parent_id is not null").select("doc_id", F.col("node_id").alias("src"), F.array(*[F.struct(F.lead("node_id", g).over(w).alias("dst"), F.lit(g).alias("gap")) for g in range(1, distance + 1)]).alias("n"))
    return own.select("doc_id", "src", F.explode("n").alias("n")).where("n.dst is not null").select("doc_id", "src", "n.dst", "n.gap")


def infer_edges(pairs: DataFrame, nodes: DataFrame, least: float = 0.6, scorer=None) -> DataFrame:
    """Edges of sibling pairs whose confidence reaches `least`; scorer(text a, text b) gives it, by default the Jaccard of their words."""
    body = nodes.select("doc_id", "node_id", F.concat_ws(" ", "title", "summary").alias("body"))
    j = pairs.join(body.select("doc_id", F.col("node_id").alias("src"), F.col("body").alias("a")), ["doc_id", "src"]).join(body.select("doc_id", F.col("node_id").alias("dst"), F.col("body").alias("b")), ["doc_id", "dst"])
    conf = (scorer or (lambda a, b: T.jaccard(T.word_set(a), T.word_set(b))))(F.col("a"), F.col("b"))
    return j.select("doc_id", "src", "dst", F.lit("similar").alias("edge_type"), F.round(conf, 6).alias("confidence"), F.lit(True).alias("bidirectional")).where(F.col("confidence") >= least)


def by_words(a: Column, b: Column) -> Column:
    """A deterministic stand-in for a judged relation of two texts: the one with more distinct words elaborates on the other, as surely as their words are the same."""
    x, y = T.word_set(a), T.word_set(b)
    way = F.when(F.size(x) < F.size(y), "a_to_b").when(F.size(x) > F.size(y), "b_to_a").otherwise("bidirectional")
    return F.struct(F.lit("elaboration").alias("relationship"), F.round(T.jaccard(x, y), 6).alias("confidence"), way.alias("direction"))


def infer_relations(pairs: DataFrame, nodes: DataFrame, relate=by_words, least: float = 0.6, longest: int = 500) -> DataFrame:
    """Typed edges between pairs (doc_id, src, dst): relate(text a, text b) gives a struct of relationship (or "none"), confidence and direction (a_to_b, b_to_a, bidirectional)."""
    body = nodes.select("doc_id", "node_id", F.concat_ws(" ", "title", F.substring("summary", 1, longest)).alias("body"))
    j = pairs.join(body.select("doc_id", F.col("node_id").alias("src"), F.col("body").alias("a")), ["doc_id", "src"]).join(body.select("doc_id", F.col("node_id").alias("dst"), F.col("body").alias("b")), ["doc_id", "dst"])
    j = j.withColumn("r", relate(F.col("a"), F.col("b"))).where((F.col("r.relationship") != "none") & (F.col("r.confidence") >= least))
    back = F.col("r.direction") == "b_to_a"
    return j.select(
        "doc_id", F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.col("r.relationship").alias("edge_type"),
        F.col("r.confidence").alias("confidence"), (F.col("r.direction") == "bidirectional").alias("bidirectional"),
    )


def build(nodes: DataFrame, relate=by_words, distance: int = 2, least: float = 0.6) -> DataFrame:
    """The edges (doc_id, src, dst, edge_type, confidence, bidirectional) of trees: parents to children, and what is inferred between siblings at most `distance` apart, in both directions where it holds both ways."""
    down = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("parent_child").alias("edge_type"), F.lit(1.0).alias("confidence"), F.lit(False).alias("bidirectional"))
    return with_reverse(down.unionByName(infer_relations(sibling_pairs(nodes, distance), nodes, relate, least)))


# How an edge of each type reads, {a} being its source and {b} its target.
PHRASES = {
    "cause_effect": "'{a}' leads to '{b}'", "support": "'{a}' supports '{b}'", "contrast": "'{a}' contrasts with '{b}'", "elaboration": "'{b}' elaborates on '{a}'", "temporal": "'{a}' precedes '{b}'",
    "reference": "'{a}' references '{b}'", "definition": "'{a}' defines concepts in '{b}'", "example": "'{b}' exemplifies '{a}'", "parent_child": "'{b}' is a section of '{a}'",
}
OTHER_PHRASE = "'{a}' relates to '{b}'"
SAME, APART = "Direct reference.", "No reasoning path found between these sections."


def edge_phrase(kind: Column, a: Column, b: Column) -> Column:
    """An edge in words."""
    said = lambda p: F.replace(F.replace(F.lit(p), F.lit("{a}"), a), F.lit("{b}"), b)
    out = F.lit(None).cast("string")
    for name, phrase in PHRASES.items():
        out = F.coalesce(F.when(kind == name, said(phrase)), out)
    return F.coalesce(out, said(OTHER_PHRASE))


def explain(edges: DataFrame, titles: DataFrame, pairs: DataFrame, hops: int = 6) -> DataFrame:
    """(a, b, connected, path_length, nodes, types, explanation) for asked pairs (a, b) of nodes that have a title (node, title).

    The shortest path within `hops`, the first by its nodes; of several edges between two nodes the surest
    speaks, of equals the first by type. Pairs with an unknown node are left out; without a path the length is -1.
    """
    known = titles.select("node", "title")
    asked = pairs.select("a", "b").distinct().join(known.select(F.col("node").alias("a")), "a", "left_semi").join(known.select(F.col("node").alias("b")), "b", "left_semi")
    paths = shortest_paths(edges, asked, hops)
    best = edges.groupBy("src", "dst").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "edge_type")).alias("e")).select("src", "dst", F.col("e.edge_type").alias("edge_type"))
    each = paths.select("a", "b", F.posexplode("path").alias("i", "node")).join(known, "node")
    line = Window.partitionBy("a", "b").orderBy("i")  # one path
    each = each.withColumns({"to": F.lead("node").over(line), "to_title": F.lead("title").over(line)})
    each = each.join(best.withColumnsRenamed({"src": "node", "dst": "to"}), ["node", "to"], "left")
    said = F.when(F.col("to").isNotNull(), edge_phrase(F.col("edge_type"), F.col("title"), F.col("to_title")))
    rows = each.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("i", "title", "edge_type", said.alias("said")))).alias("p"))
    part = lambda c: F.array_compact(F.transform("p", lambda x: x[c]))
    told = rows.select("a", "b", part("title").alias("nodes"), part("edge_type").alias("types"), part("said").alias("said"))
    j = asked.join(told, ["a", "b"], "left")
    text = F.when(F.col("said").isNull(), APART).when(F.size("said") == 0, SAME).otherwise(F.array_join("said", " \u2192 "))
    return j.select("a", "b", F.col("said").isNotNull().alias("connected"), F.when(F.col("said").isNotNull(), F.size("nodes") - 1).otherwise(-1).alias("path_length"), "nodes", "types", text.alias("explanation"))


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges and the reverse of bidirectional ones, each (src, dst, type) once with its best confidence."""
    back = edges.where("bidirectional").select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "confidence", "bidirectional")
    return edges.unionByName(back).groupBy("doc_id", "src", "dst", "edge_type").agg(F.max("confidence").alias("confidence"), F.bool_or("bidirectional").alias("bidirectional"))


def path_type(types: Column) -> Column:
    every = lambda *k: F.forall(types, lambda t: t.isin(*k))
    return (
        F.when(every("cause_effect"), "causal_chain").when(every("support"), "evidence_chain").when(F.exists(types, lambda t: t == "contrast"), "contrastive")
        .when(every("temporal"), "temporal_sequence").when(every("parent_child"), "hierarchical").otherwise("mixed")
    )


def best_paths(edges: DataFrame, seeds: DataFrame, hops: int = 3, least: float = 0.5, keep: int | None = 20) -> DataFrame:
    """(seed, path, confidence, n_nodes, kind): paths without repeated nodes of up to `hops` nodes, the best for each (seed, last node, length), `keep` for each seed.

    edges (src, dst, edge_type, confidence); seeds (node, confidence).
    """
    front = seeds.select(F.col("node").alias("seed"), F.array("node").alias("path"), F.array().cast("array<string>").alias("types"), F.col("confidence").cast("double").alias("confidence"), F.col("node").alias("last"))
    out = None
    for _ in range(hops - 1):
        step = front.join(edges.select(F.col("src").alias("last"), "dst", "edge_type", F.col("confidence").alias("c")), "last")
        step = step.where(~F.array_contains("path", F.col("dst"))).withColumn("confidence", F.round(F.col("confidence") * F.col("c"), 9)).where(F.col("confidence") >= least)
        step = step.select("seed", F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("edge_type")).alias("types"), "confidence", F.col("dst").alias("last"))
        w = Window.partitionBy("seed", "last").orderBy(F.desc("confidence"), "path", "types")
        front = step.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
        out = front if out is None else out.unionByName(front)
    paths = out.select("seed", "path", "confidence", F.size("path").alias("n_nodes"), path_type(F.col("types")).alias("kind"))
    if keep is None:
        return paths
    w = Window.partitionBy("seed").orderBy(F.desc("confidence"), "n_nodes", "path")
    return paths.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n")


def distinct_paths(paths: DataFrame, k: int = 5) -> DataFrame:
    """The k best paths over all seeds, one for each set of nodes."""
    w = Window.partitionBy(F.array_sort("path")).orderBy(F.desc("confidence"), "path")
    return paths.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").orderBy(F.desc("confidence"), "path").limit(k)


def search(edges: DataFrame, seeds: DataFrame, hops: int = 3, k: int = 5, least: float = 0.5) -> DataFrame:
    """(place, node, n_paths, confidence): the nodes of the k best paths in the order they first stand in, twice k at most, with how many of the paths hold them."""
    paths = distinct_paths(best_paths(edges, seeds, hops, least), k).withColumn("p", F.row_number().over(Window.orderBy(F.desc("confidence"), "path")))
    each = paths.select("p", "confidence", F.posexplode("path").alias("i", "node"))
    per = each.groupBy("node").agg(F.min(F.struct("p", "i")).alias("first"), F.count("*").alias("n_paths"), F.max("confidence").alias("confidence"))
    ranked = per.withColumn("place", F.row_number().over(Window.orderBy("first")))  # at most k paths of `hops` nodes
    return ranked.where(F.col("place") <= 2 * k).select("place", "node", "n_paths", F.round("confidence", 6).alias("confidence"))


def connection_phrase(types: Column) -> Column:
    """What a path's edge types say, in words."""
    return F.array_join(F.transform(types, lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ", then ")


def neighbourhood(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, out_nodes, in_nodes)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.array_sort(F.collect_set("dst")).alias("out_nodes"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.array_sort(F.collect_set("src")).alias("in_nodes"))
    j = out.join(into, "node", "full")
    empty = F.array().cast("array<string>")
    return j.select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("out_nodes", empty).alias("out_nodes"), F.coalesce("in_nodes", empty).alias("in_nodes"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 6) -> DataFrame:
    """(a, b, n_hops, path): by breadth, the first path in order of its nodes; pairs without one within `hops` are left out."""
    front = pairs.select("a", "b", F.array("a").alias("path"), F.col("a").alias("last"))
    out = front.where("a = b").select("a", "b", F.lit(0).alias("n_hops"), "path")
    open_ = front.where("a <> b")
    for h in range(1, hops + 1):
        step = open_.join(edges.select(F.col("src").alias("last"), "dst").distinct(), "last").where(~F.array_contains("path", F.col("dst")))
        step = step.groupBy("a", "b", F.col("dst").alias("last")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        out = out.unionByName(step.where("last = b").select("a", "b", F.lit(h).alias("n_hops"), "path"))
        open_ = step.where("last <> b")
    first = Window.partitionBy("a", "b").orderBy("n_hops", "path")
    return out.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n_edges"))


def content_hash(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, 12)
