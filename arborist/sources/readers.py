"""Readers and writers: tree catalogs, question sets, reports, annotations, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIX = "_index.json"


def tree_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(doc_id, name, tree): the JSON files of a catalog; strict: broken ones fail, else they have a null tree."""
    raw = spark.read.option("pathGlobFilter", f"*{SUFFIX}").text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value")
    good = F.expr("try_parse_json(value)")
    tree = F.when(good.isNotNull(), F.col("value"))
    if strict:
        tree = F.when(good.isNull(), F.raise_error(F.concat(F.lit("not JSON: "), "name"))).otherwise(F.col("value"))
    return raw.select(F.regexp_replace("name", SUFFIX + "$", "").alias("doc_id"), "name", tree.alias("tree"))


def catalog(spark: SparkSession, path: str, summary: int = 200) -> DataFrame:
    """(doc_id, name, title, summary): every tree with the start of its summary, or of its title without one."""
    get = lambda k: F.get_json_object("tree", f"$.{k}")
    return tree_files(spark, path).select("doc_id", "name", get("title").alias("title"), F.substring(F.coalesce(F.nullif(get("summary"), F.lit("")), get("title")), 1, summary).alias("summary"))


def search_catalog(listing: DataFrame, keyword: str) -> DataFrame:
    k = F.lit(keyword.lower())
    return listing.where(F.contains(F.lower("name"), k) | F.contains(F.lower("summary"), k))


def save_trees(trees: DataFrame, path: str) -> None:
    """(doc_id, tree) as JSON lines, one row a tree; the folder appears whole."""
    trees.select("doc_id", "tree").write.mode("overwrite").json(path)


QA = "_id string, type string, level string, question string, answer string, supporting_facts array<array<string>>, context array<array<string>>"


def multi_hop_items(spark: SparkSession, path: str, n: int | None = 100, seed: int = 42, longest: int = 100) -> DataFrame:
    """(question_id, question, answer, kind, sections): multi-hop items of the two kinds with short answers, n of them by a hash of id and seed.

    Sections are (title, text, relevant): where no title supports the answer, all are relevant.
    """
    raw = spark.read.option("multiLine", True).json(path)
    pair = raw.schema["context"].dataType.simpleString().startswith("struct")
    titles = F.col("context.title") if pair else F.transform("context", lambda c: c[0].cast("string"))
    if pair:
        texts = F.transform("context.sentences", lambda s: F.array_join(s, " "))
        facts = F.col("supporting_facts.title")
    else:
        texts = F.transform("context", lambda c: F.array_join(F.from_json(c[1].cast("string"), "array<string>"), " "))
        facts = F.transform("supporting_facts", lambda s: s[0].cast("string"))
    own = raw.where(F.col("type").isin("comparison", "bridge") & (F.length("answer") < longest)).select(F.col("_id").alias("question_id"), "question", "answer", F.col("type").alias("kind"), F.arrays_zip(titles.alias("title"), texts.alias("text")).alias("s"), facts.alias("facts"))
    some = F.exists("s", lambda x: F.array_contains(F.col("facts"), x["title"]))
    out = own.withColumn("sections", F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"), (~some | F.array_contains(F.col("facts"), x["title"])).alias("relevant")))).drop("s", "facts")
    return out.orderBy(F.xxhash64("question_id", F.lit(seed)), "question_id").limit(n) if n else out


def annotations(spark: SparkSession, path: str, ratings: tuple[str, ...]) -> DataFrame:
    """(task_id, annotator_id, rating, value) of a CSV of ratings; blank and non-numeric cells are left out."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select("task_id", "annotator_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rating"), F.expr(f"try_cast(`{r}` AS double)").alias("value")) for r in ratings])).alias("r")).select("task_id", "annotator_id", "r.rating", "r.value").where("value is not null")


def report_rows(spark: SparkSession, path: str, row: str) -> DataFrame:
    """(file, system, row fields) of report JSON files whose per_question maps a system to its rows of the given DDL."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"per_question map<string, array<struct<{row}>>>").alias("r"))
    systems = raw.select("file", F.explode("r.per_question").alias("system", "rows"))
    return systems.select("file", "system", F.explode("rows").alias("x")).select("file", "system", "x.*")


def best_report(rows: DataFrame) -> DataFrame:
    """The rows of the report with most questions, of equals the last by name; reports marked contaminated are skipped."""
    sizes = rows.where(~F.contains("file", F.lit("_CONTAMINATED"))).groupBy("file").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(sizes.orderBy(F.desc("n"), F.desc("file")).limit(1).select("file")), "file", "left_semi")


def pdf_problems(files: DataFrame, most: int = 50 << 20, streams: int = 10_000) -> DataFrame:
    """(path, problem) of binaryFile rows that are no acceptable PDF: header, end mark in the last KiB, size, number of compressed streams, name."""
    text = F.decode("content", "ISO-8859-1")
    name = F.element_at(F.split("path", "/"), -1)
    checks: tuple[tuple[str, Column], ...] = (
        ("no PDF header", ~text.startswith("%PDF-")), ("no end mark", ~F.contains(F.right(text, F.lit(1024)), F.lit("%%EOF"))), ("too large", F.col("length") > most), ("empty", F.col("length") == 0),
        ("too complex", F.size(F.split(text, "/FlateDecode")) - 1 > streams), ("name too long", F.length(name) > 255), ("bad name", name.rlike(r"\.\.|[\x00-\x1f]") | ~F.lower(name).endswith(".pdf")),
    )
    return files.select("path", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))).alias("problem"))


def sessions(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, first_question, messages): turns gathered by conversation, in order; a null role or text is mended."""
    m = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    agg = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))
    first = F.get(F.filter("messages", lambda x: x["role"] == "user"), F.lit(0))["text"]
    return agg.select("conv_id", F.size("messages").alias("n_turns"), first.alias("first_question"), "messages")


def ordered_ids(rows: DataFrame, prefix: str = "auto_") -> DataFrame:
    """Adds a running question_id over documents and positions, numbered within documents first so that no sort takes all rows."""
    w = Window.partitionBy("doc_id").orderBy("category", "i")
    return rows.withColumn("question_id", F.concat(F.lit(prefix), F.col("doc_id").cast("string"), F.lit("_"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")))
