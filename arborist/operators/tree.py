"""Document trees as flat node tables, and the path algebra on them.

A node is (doc_id, node_id, parent_id, ord, depth, path_ord, title, summary, text, page_ref).
path_ord, the ordinals from the root, orders nodes depth-first when compared as an array, and an
ancestor's is a prefix of its descendants'; nothing after ingest needs recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept


def chunk_chars(docs: DataFrame, size: int = 300) -> DataFrame:
    """(doc_id, chunk_id, ord, text): pieces of `size` characters; an empty text has none."""
    n = F.ceil(F.length("text") / size).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * size + 1, F.lit(size))))
    rows = docs.select("doc_id", F.posexplode(parts).alias("ord", "text"))
    return rows.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("ord").cast("string")).alias("chunk_id"), "ord", "text")


def chunk_words(docs: DataFrame, size: int = 400) -> DataFrame:
    """(doc_id, ord, text, n_words): sections of `size` white-space words."""

    def cut(w: Column) -> Column:
        n = F.ceil(F.size(w) / size).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(w, i * size + 1, F.lit(size))))

    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(T.once(words, cut)).alias("ord", "w")).select("doc_id", "ord", F.array_join("w", " ").alias("text"), F.size("w").alias("n_words"))


def section_tree(docs: DataFrame, size: int = 400, summary: int = 200) -> DataFrame:
    """Nodes of flat trees: a root for each document and its sections of `size` words below it."""
    sections = chunk_words(docs, size)
    key = F.col("doc_id").cast("string")
    leaf = sections.select(
        "doc_id", F.concat(F.lit("d"), key, F.lit("."), (F.col("ord") + 1).cast("string")).alias("node_id"), F.concat(F.lit("d"), key).alias("parent_id"), "ord", F.lit(1).alias("depth"),
        F.array(F.lit(0), F.col("ord")).alias("path_ord"), F.concat(F.lit("Section "), (F.col("ord") + 1).cast("string")).alias("title"), F.substring("text", 1, summary).alias("summary"), "text",
        (F.col("ord") + 1).cast("string").alias("page_ref"),
    )
    root = docs.select(
        "doc_id", F.concat(F.lit("d"), key).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), F.array(F.lit(0)).alias("path_ord"),
        F.concat(F.lit("Document "), key).alias("title"), F.substring("text", 1, summary).alias("summary"), F.lit(None).cast("string").alias("text"), F.lit("1").alias("page_ref"),
    )
    return root.unionByName(leaf)


def flatten(spark: SparkSession, trees: DataFrame) -> DataFrame:
    """Nodes of JSON trees (doc_id, tree as text): id, title, summary, page_ref, text, children at any depth, pre-order numbered.

    A node without an id is called "node_" and its path, also by its children. Broken JSON gives no rows.
    Goes down by levels, each written once to shared storage: neither depth nor the number of nodes has a limit.
    """
    level = trees.select("doc_id", F.try_parse_json("tree").alias("node")).where("node is not null")
    level = kept(level.select("doc_id", "node", F.lit(0).alias("depth"), F.array(F.lit(0)).alias("path_ord"), F.lit(None).cast("string").alias("parent_id")))
    rows = level
    own = "coalesce(try_variant_get(t.node, '$.id', 'string'), concat('node_', array_join(cast(t.path_ord AS array<string>), '.')))"
    while not level.isEmpty():
        level = kept(spark.sql(
            f"SELECT t.doc_id, c.value AS node, t.depth + 1 AS depth, concat(t.path_ord, array(c.pos)) AS path_ord, {own} AS parent_id "
            "FROM {level} AS t, LATERAL variant_explode(try_variant_get(t.node, '$.children', 'variant')) AS c", level=level
        ))
        rows = rows.unionByName(level)
    get = lambda k: F.expr(f"try_variant_get(node, '$.{k}', 'string')")
    order = Window.partitionBy("doc_id").orderBy("path_ord")
    return rows.select(
        "doc_id", F.coalesce(get("id"), F.concat(F.lit("node_"), F.array_join(F.transform("path_ord", lambda x: x.cast("string")), "."))).alias("node_id"), "parent_id",
        F.element_at("path_ord", -1).alias("ord"), "depth", "path_ord", (F.row_number().over(order) - 1).alias("pre_order"),
        *[F.coalesce(get(k), F.lit("")).alias(k) for k in ("title", "summary", "page_ref")], get("text").alias("text"),
    )


def rebuild(nodes: DataFrame, unnamed: str | None = None) -> DataFrame:
    """(doc_id, tree): JSON trees out of nodes, children in order and empty fields left out; one pass for each level. unnamed: a column that is true where the id is to be left out."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("doc_id", F.lit("").alias("tree")).limit(0)
    below = None
    for d in range(deepest, -1, -1):
        here = nodes.where(F.col("depth") == d)
        kids = F.lit(None).cast("string")
        if below is not None:
            grouped = below.groupBy("doc_id", "parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tree"))), lambda x: x["tree"]), ",").alias("kids"))
            here = here.join(grouped.withColumnRenamed("parent_id", "node_id"), ["doc_id", "node_id"], "left")
            kids = F.col("kids")
        fields = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f'"{k}":'), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))) for k, c in (("id", "node_id"), ("title", "title"), ("summary", "summary"), ("page_ref", "page_ref"))]
        if unnamed:
            fields[0] = F.when(~F.col(unnamed), fields[0])
        fields.append(F.when(kids.isNotNull(), F.concat(F.lit('"children":['), kids, F.lit("]"))))
        below = kept(here.select("doc_id", "parent_id", "ord", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("tree")))
    return below.select("doc_id", "tree")


def geography(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """A three-level tree out of the star schema: one document for each region, nations and customers below it."""
    r = region.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.col("r_name").alias("title"), F.lit(0).cast("long").alias("key"))
    n = nation.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.lit(1).alias("depth"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("key"))
    c = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.lit(2).alias("depth"), F.col("c_name").alias("title"), F.col("c_custkey").cast("long").alias("key"))
    return r.unionByName(n).unionByName(c)


def breadcrumbs(nodes: DataFrame, levels: int, sep: str = " > ") -> DataFrame:
    """Adds path, the titles from the root, for trees of up to `levels` levels below it: one equality join a level."""
    out = nodes.where("depth = 0").select("doc_id", "node_id", "depth", F.col("title").alias("path"))
    level = out
    for d in range(1, levels + 1):
        up = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("above"))
        level = nodes.where(F.col("depth") == d).join(up, "parent_id").select("doc_id", "node_id", "depth", F.concat("above", F.lit(sep), "title").alias("path"))
        out = out.unionByName(level)
    return out


def stats(nodes: DataFrame) -> DataFrame:
    """For each tree: nodes, leaves, depth and mean branching of the inner nodes."""
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("k"))
    j = nodes.select("doc_id", "node_id", "depth").join(kids, ["doc_id", "node_id"], "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count(F.when(F.col("k").isNull(), 1)).alias("n_leaves"), F.max("depth").alias("max_depth"), F.round(F.coalesce(F.avg("k"), F.lit(0.0)), 6).alias("branching"))


def sibling_groups(nodes: DataFrame) -> DataFrame:
    """Parents with two children or more, and how many."""
    return nodes.where("parent_id is not null").groupBy("doc_id", "parent_id").agg(F.count("*").alias("n_children")).where("n_children >= 2")


def hierarchy_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("coalesce(parent_id, '') <> '' and coalesce(node_id, '') <> ''").select("doc_id", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("parent_child").alias("edge_type"), F.lit(1.0).alias("confidence"))


def content_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("upper(node_id) <> 'ROOT' and coalesce(title, '') <> '' and coalesce(summary, '') <> ''")


def outline(nodes: DataFrame, depth: int = 3, children: int = 5, summary: int = 100) -> DataFrame:
    """(doc_id, outline): indented titles of the first levels and children, with the start of each summary."""
    own = nodes.where((F.col("depth") < depth) & (F.col("ord") < children))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("title"), F.when(F.col("summary") != "", F.concat(F.lit(": "), F.substring("summary", 1, summary))).otherwise(""))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("outline"))


def prefixes(section: Column, sep: str = ".") -> Column:
    """A dotted id and those of its ancestors."""
    parts = F.split(section, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def related_sections(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct pairs (key, f, e) of sections that are equal, or one the other's ancestor: two equality joins on prefixes instead of a nested loop."""
    f_up = found.select("key", "f", F.explode(prefixes(F.col("f"))).alias("e"))
    e_up = expected.select("key", "e", F.explode(prefixes(F.col("e"))).alias("f"))
    return f_up.join(expected, ["key", "e"], "left_semi").select("key", "f", "e").union(e_up.join(found, ["key", "f"], "left_semi").select("key", "f", "e")).distinct()


def last_page(page_ref: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(page_ref, F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.cast("int")))


def page_bucket(pages: Column) -> Column:
    return F.when(pages < 50, "<50").when(pages <= 100, "50-100").when(pages > 100, ">100")


def marked_pages(texts: DataFrame) -> DataFrame:
    """(doc_id, page, text) of texts whose pages begin with "--- PAGE n ---" or "--- [Page n] ---"; text before the first mark is page 1, empty pages are left out."""
    mark = r"(?i)^---\s*\[?page\s+([0-9]+)\]?\s*---\s*$"
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("p", F.nullif(F.regexp_extract("line", mark, 1), F.lit("")).cast("int"))
    runs = lines.withColumn("run", F.count("p").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    body = runs.groupBy("doc_id", "run").agg(F.coalesce(F.max("p"), F.lit(1)).alias("page"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p").isNull(), F.struct("i", "line")))), lambda x: x["line"]), "\n")).alias("text"))
    return body.where("text <> ''").select("doc_id", "page", "text")


def round_robin_clusters(chunks: DataFrame, size: int = 3, prefix: int = 80) -> DataFrame:
    """(doc_id, cluster, n_members, summary): chunk i of n joins cluster i modulo ceil(n / size)."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    member = chunks.withColumn("k", F.ceil(n / size)).withColumn("cluster", F.pmod("ord", "k").cast("int"))
    return member.groupBy("doc_id", "cluster").agg(F.count("*").alias("n_members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.substring("text", 1, prefix).alias("s")))), lambda x: x["s"]), " ").alias("summary"))


def html_headings(pages: DataFrame) -> DataFrame:
    """(page_id, ord, level, title) of the h1 to h6 elements of raw HTML; tags inside a heading are dropped."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "h"))
    title = F.trim(F.regexp_replace(F.regexp_replace("h", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", "ord", F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), title.alias("title"))


def violations(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, problem) of nodes that break the schema: no id, no title, an unknown parent, a repeated id."""
    twice = nodes.groupBy("doc_id", "node_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "node_id", F.lit("repeated id").alias("problem"))
    orphan = nodes.where("parent_id is not null").join(nodes.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_anti").select("doc_id", "node_id", F.lit("unknown parent").alias("problem"))
    plain = nodes.where("coalesce(title, '') = ''").select("doc_id", "node_id", F.lit("no title").alias("problem")).unionByName(nodes.where("coalesce(node_id, '') = ''").select("doc_id", "node_id", F.lit("no id").alias("problem")))
    return plain.unionByName(twice).unionByName(orphan)


def clean_json(c: Column | str) -> Column:
    """Model output to JSON text: fences stripped, of a list the first object."""
    t = F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.when(t.startswith("["), F.get_json_object(t, "$[0]")).otherwise(t)


def pseudo_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): page marker, title and summary of each node in depth-first order, for trees without their text."""
    page = F.regexp_extract("page_ref", "[0-9]+", 0)
    part = F.concat(F.when(page != "", F.concat(F.lit("--- PAGE "), page, F.lit(" ---\n"))).otherwise(""), F.col("title"), F.lit(" "), F.coalesce("summary", F.lit("")))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_ord", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
