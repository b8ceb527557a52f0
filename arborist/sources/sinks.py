"""Graphs, reports and tables as files that others read: JSON lines a document, one JSON report, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import SUFFIX

NODE = "id string, title string, summary string, page_ref string, depth int"
EDGE = "source_id string, target_id string, edge_type string, confidence double, bidirectional boolean"
GRAPH = f"document_name string, nodes map<string, struct<{NODE}>>, edges array<struct<{EDGE}>>, stats struct<node_count bigint, edge_count bigint, edge_types map<string, bigint>>"


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, graph): each document's nodes by id, edges and counts as one JSON text; a document's graph is one row."""
    node = F.struct(F.col("node_id").alias("id"), "title", "summary", "page_ref", "depth")
    n = nodes.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", node)))).alias("nodes"), F.count("*").alias("node_count"))
    edge = F.struct(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "edge_type", "confidence", "bidirectional")
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"), F.count("*").alias("edge_count"))
    kinds = edges.groupBy("doc_id", "edge_type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type", "n")))).alias("edge_types"))
    j = n.join(e, "doc_id", "left").join(kinds, "doc_id", "left")
    stats = F.struct("node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.coalesce("edge_types", F.create_map().cast("map<string,bigint>")).alias("edge_types"))
    empty = F.array().cast(f"array<struct<{EDGE}>>")
    return j.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_name"), "nodes", F.coalesce("edges", empty).alias("edges"), stats.alias("stats"))).alias("graph"))


def save_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One line a document."""
    graph_json(nodes, edges).select("graph").write.mode("overwrite").text(path)


def load_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of saved graphs; document names come back as text."""
    g = spark.read.text(path).select(F.from_json("value", GRAPH).alias("g")).where("g is not null")
    nodes = g.select(F.col("g.document_name").alias("doc_id"), F.explode("g.nodes").alias("node_id", "n")).select("doc_id", "node_id", "n.title", "n.summary", "n.page_ref", "n.depth")
    edges = g.select(F.col("g.document_name").alias("doc_id"), F.inline("g.edges")).withColumnsRenamed({"source_id": "src", "target_id": "dst"})
    return nodes, edges


def save_catalog(trees: DataFrame, path: str) -> int:
    """(doc_id, tree) as one file a tree, <doc_id>_index.json; how many. Tasks write, the driver only renames."""
    spark = trees.sparkSession
    aside = f"{path.rstrip('/')}/.writing"
    trees.select(F.concat(F.col("doc_id").cast("string"), F.lit(SUFFIX)).alias("name"), "tree").repartition("name").write.mode("overwrite").partitionBy("name").text(aside)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    count = 0
    for folder in fs.listStatus(jvm.Path(aside)):
        key, _, name = folder.getPath().getName().partition("=")
        for part in fs.listStatus(folder.getPath()) if key == "name" else []:
            if part.getPath().getName().startswith("part-"):
                fs.delete(jvm.Path(path, name), False)
                count += bool(fs.rename(part.getPath(), jvm.Path(path, name)))
    fs.delete(jvm.Path(aside), True)
    return count


def save_report(rows: DataFrame, path: str, system: str = "system") -> None:
    """One JSON file of an experiment: per_question maps each system to its rows, in order of question_id; a report is small."""
    fields = [c for c in rows.columns if c != system]
    own = rows.groupBy(system).agg(F.array_sort(F.collect_list(F.struct("question_id", *[c for c in fields if c != "question_id"]))).alias("rows"))
    whole = own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(system, "rows")))).alias("per_question"))
    whole.select(F.to_json(F.struct("per_question"))).coalesce(1).write.mode("overwrite").text(path)


def save_csv(rows: DataFrame, path: str) -> None:
    """With a header; nulls are empty, texts quoted where they must be."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
