"""Registered queries of readers, text primitives, context blocks, streams and ranking features, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import grounding as H
from ..operators import metrics as M
from ..operators import ranker as L
from ..operators import retrieval as R
from ..operators import service as S
from ..operators import tree as X
from ..sources import readers, sinks
from ..sources.shared import kept
from ..streaming import expiry, limits
from . import oracle as O
from . import twins as W
from .evaluation import SQL, twin
from .measures import _CASES, cases, new_folder
from .queries import REGISTRY, asked, docs, geo, pairs, read, scored, timed, trade

# sources


@twin(f"""WITH {O.GEO}, r AS (SELECT doc_id, title, (SELECT string_agg(n.title, ', ' ORDER BY n.key) FROM geo n WHERE n.doc_id = g.doc_id AND n.depth = 1) AS about FROM geo g WHERE depth = 0)
  SELECT doc_id::VARCHAR AS doc_id, doc_id || '_index.json' AS name, title, substring(coalesce(about, title), 1, 200) AS summary FROM r WHERE contains(lower(doc_id || '_index.json'), 'a') OR contains(lower(substring(coalesce(about, title), 1, 200)), 'a')""")
def catalog_search(spark, sf):
    """The regions' trees as files of a catalog, listed with summaries and searched."""
    g = geo(spark, sf)
    about = g.where("depth = 1").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "title"))), lambda x: x["title"]), ", ").alias("summary"))
    none = F.lit(None).cast("string")
    nodes = g.where("depth = 0").join(about, "doc_id", "left").withColumns({"ord": F.lit(0), "page_ref": none, "text": none})
    at = new_folder(spark, "catalog")
    sinks.save_catalog(X.rebuild(nodes), at)
    return readers.search_catalog(readers.catalog(spark, at), "A")


@twin(f"""WITH {O.D}, {O.SECTIONS} SELECT doc_id, 1 AS page, md5(trim('Document ' || doc_id || ' ' || substring(text, 1, 200))) AS digest FROM d
  UNION ALL SELECT doc_id, ord + 1, md5(trim('Section ' || (ord + 1) || ' ' || substring(array_to_string(ww, ' '), 1, 200))) FROM sec""")
def page_markers(spark, sf):
    """Trees written as text with page marks, cut at the marks again."""
    pages = X.marked_pages(X.pseudo_text(X.section_tree(docs(spark, sf))))
    return pages.select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("digest"))


@twin(f"""WITH {O.D}, {O.SECTIONS}, l AS (SELECT doc_id, 0 AS po, '- Document ' || doc_id || CASE WHEN text <> '' THEN ': ' || substring(text, 1, 100) ELSE '' END AS line FROM d
    UNION ALL SELECT doc_id, ord + 1, '  - Section ' || (ord + 1) || ': ' || substring(array_to_string(ww, ' '), 1, 100) FROM sec WHERE ord < 5)
  SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY po)) AS digest FROM l GROUP BY doc_id""")
def outlines(spark, sf):
    return X.outline(X.section_tree(docs(spark, sf))).select("doc_id", F.md5(F.col("outline").cast("binary")).alias("digest"))


@twin(f"""WITH {O.GEO}, n AS (SELECT doc_id, CASE WHEN depth = 2 AND key % 17 = 0 THEN '' ELSE node_id END AS node_id, CASE WHEN depth = 2 AND key % 19 = 0 THEN 'nowhere' ELSE parent_id END AS parent_id, CASE WHEN key % 13 = 5 THEN NULL ELSE title END AS title, key, depth FROM geo),
  m AS (SELECT * FROM n UNION ALL SELECT * FROM n WHERE depth = 2 AND key % 23 = 0 AND node_id <> '')
  SELECT doc_id, node_id, 'no title' AS problem FROM m WHERE coalesce(title, '') = '' UNION ALL SELECT doc_id, node_id, 'no id' FROM m WHERE node_id = ''
  UNION ALL SELECT doc_id, node_id, 'repeated id' FROM m GROUP BY doc_id, node_id HAVING count(*) > 1 UNION ALL SELECT doc_id, node_id, 'unknown parent' FROM m WHERE parent_id = 'nowhere'""")
def tree_violations(spark, sf):
    """What is wrong with the geography after some of its rows were spoiled."""
    k, deep = F.col("key"), F.col("depth") == 2
    n = geo(spark, sf).withColumns({
        "node_id": F.when(deep & (k % 17 == 0), "").otherwise(F.col("node_id")), "parent_id": F.when(deep & (k % 19 == 0), "nowhere").otherwise(F.col("parent_id")), "title": F.when(k % 13 != 5, F.col("title")),
    })
    return X.violations(n.unionByName(n.where(deep & (k % 23 == 0) & (F.col("node_id") != "")))).select("doc_id", "node_id", "problem")


@twin("""WITH s AS (SELECT conv_id, turn, 'turn ' || turn AS x FROM conversations)
  SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '{"answer": "' || x || '"}' WHEN 1 THEN '{"answer":"' || x || '"}' WHEN 2 THEN x ELSE 'say {"score": 3} now' END AS clean,
    CASE conv_id % 4 WHEN 3 THEN 'say {"score": 3} now' ELSE x END AS answer, CASE conv_id % 4 WHEN 0 THEN '{"answer": "' || x || '"}' WHEN 1 THEN '{"answer":"' || x || '"}' WHEN 3 THEN '{"score": 3}' END AS json FROM s""")
def model_output(spark, sf):
    """Answers and JSON out of four ways in which a model may write them."""
    c = read(spark, sf, "conversations")
    x = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    wrap = lambda a, b: F.concat(F.lit(a), x, F.lit(b))
    kind = F.col("conv_id") % 4
    said = F.when(kind == 0, wrap('```json\n{"answer": "', '"}\n```')).when(kind == 1, wrap('[{"answer":"', '"}]')).when(kind == 2, x).otherwise('say {"score": 3} now')
    c = c.select("conv_id", "turn", said.alias("said"))
    return c.select("conv_id", "turn", X.clean_json("said").alias("clean"), T.model_answer("said").alias("answer"), T.first_json("said").alias("json"))


_SPLIT = "len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: trim(x)), lambda x: x <> ''))"


@twin(f"""WITH {O.D} SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i, 3)))) END AS n_grams,
    greatest(len({O.w('text')}) - 1, 0) AS n_pairs, CASE WHEN length(text) >= 15 THEN (length(text) - 15) // 7 + 1 ELSE 0 END AS n_windows, {_SPLIT} AS n_sentences, length(text) // 4 AS n_tokens, (length(text) + 511) // 512 AS n_chunks FROM d""")
def text_measures(spark, sf):
    """How many grams, word pairs, windows, sentences, tokens and chunks of 512 characters each text has."""
    d = docs(spark, sf)
    chunks = X.chunk_chars(d, 512).groupBy("doc_id").agg(F.count("*").alias("k"))
    own = d.select(
        "doc_id", F.size(T.char_ngrams("text", 3, False)).alias("n_grams"), F.size(T.word_ngrams(T.words("text"), 2)).alias("n_pairs"), F.size(T.char_windows("text")).alias("n_windows"),
        F.size(T.sentences("text")).alias("n_sentences"), T.tokens_estimate("text").alias("n_tokens"),
    )
    return own.join(chunks, "doc_id", "left").withColumn("n_chunks", F.coalesce("k", F.lit(0))).drop("k")


@twin(f"SELECT query_id, doc_id, round(greatest(0e0, least(1e0, (score + 1e0) / 2e0)), 7) AS relevance FROM ({O.SQL['vector_cosine_topk']})")
def embedding_relevance(spark, sf):
    return REGISTRY["vector_cosine_topk"](spark, sf).select("query_id", "doc_id", F.round(R.cosine_relevance(F.col("score")), 7).alias("relevance"))


_TOP = f"{O.BASE}, h AS ({O.top(O.bm25('1e0'), 3)}), x AS (SELECT query_id, rank, 'Document ' || doc_id AS title, doc_id::VARCHAR AS page, text FROM h JOIN d USING (doc_id))"


def _ranked_texts(spark, sf):
    d = docs(spark, sf)
    key = F.col("doc_id").cast("string")
    return R.bm25(d, asked(spark, sf), 3).join(d, "doc_id").select("query_id", "rank", F.concat(F.lit("Document "), key).alias("title"), key.alias("page_ref"), "text")


@twin(f"{_TOP} SELECT query_id, md5(string_agg('[Document ' || rank || ': ' || title || ' (p.' || page || ')]' || chr(10) || text || chr(10), chr(10) ORDER BY rank)) AS digest FROM x GROUP BY query_id")
def context_blocks(spark, sf):
    return R.context_block(_ranked_texts(spark, sf)).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@twin(f"{_TOP} SELECT query_id, substring(string_agg(title || ': ' || text || ' [p.' || page || ']', ' ' ORDER BY rank), 1, 600) AS answer FROM x GROUP BY query_id")
def extractive_answers(spark, sf):
    return R.extractive_answer(_ranked_texts(spark, sf))


@twin(O.SQL["ndcg_graded"].replace("(pow(2e0, g) - 1e0)", "g"))
def ndcg_linear(spark, sf):
    d, q = docs(spark, sf), asked(spark, sf)
    rel = R.best_overlap(d, q, "share", least=0.4).select("query_id", "doc_id", F.floor(F.col("score") * 5).cast("double").alias("relevance"))
    return M.graded_ndcg(R.bm25(d, q), rel, linear=True)


@twin("SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(CASE WHEN doc_id % 3 > 0 THEN toxic END), 6) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_means(spark, sf):
    """Means of labels by language, nulls left out."""
    j = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").withColumn("toxic", F.when(F.col("doc_id") % 3 > 0, F.col("toxic")))
    return M.null_skipping_means(j, ("lang",), ("quality", "toxic"))


@twin(f"WITH o AS ({O.SQL['offline_qa']}) SELECT doc_id, category, i, 'auto_' || doc_id || '_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY category, i))::VARCHAR, 3, '0') AS question_id FROM o")
def question_ids(spark, sf):
    n = X.content_nodes(X.section_tree(docs(spark, sf))).where("depth > 0")
    return readers.ordered_ids(S.offline_questions(n)).select("doc_id", "category", "i", "question_id")


@twin(f"""WITH {O.TURNS}, x AS (SELECT answer_id, CASE WHEN answer_id % 3 = 0 THEN answer ELSE '**1. 공통점 요약**' || question || '**2. Differences**' || answer || '📚' END AS t FROM pr),
  p AS (SELECT answer_id, nullif(trim(regexp_extract(t, '(?is)\\*\\*1\\.\\s*(?:공통점|commonalit).*?\\*\\*(.+?)(?:\\*\\*2\\.|📚|$)', 1)), '') AS a, nullif(trim(regexp_extract(t, '(?is)\\*\\*2\\.\\s*(?:차이점|difference).*?\\*\\*(.+?)(?:\\*\\*3\\.|📚|$)', 1)), '') AS b FROM x)
  SELECT answer_id, a IS NOT NULL OR b IS NOT NULL AS has_comparison, md5(a) AS commonalities, md5(b) AS differences FROM p""")
def comparison_parts(spark, sf):
    """Commonalities and differences out of answers written under two headings."""
    p = pairs(spark, sf)
    text = F.when(F.col("answer_id") % 3 == 0, F.col("answer")).otherwise(F.concat(F.lit("**1. 공통점 요약**"), "question", F.lit("**2. Differences**"), "answer", F.lit("📚")))
    found = H.comparison_sections(p.select("answer_id", text.alias("answer")))
    return found.select("answer_id", "has_comparison", F.md5(F.col("commonalities").cast("binary")).alias("commonalities"), F.md5(F.col("differences").cast("binary")).alias("differences"))


@twin(f"""WITH RECURSIVE {O.TURNS}, {W._ERRORS}, k AS ({O.SQL['calibration_summary']}), h AS ({SQL['hallucination_rates']}), {O.D}, {O.SCORED}, f AS (SELECT avg(confidence) AS confidence FROM sc),
  n AS (SELECT count(*) FILTER (category = 'retrieval_miss') AS miss, count(*) FILTER (category = 'hallucination') AS made_up FROM er),
  a AS (SELECT list_filter([CASE WHEN miss > 0 THEN 'widen retrieval' END, CASE WHEN made_up > 0 THEN 'ground generation' END, CASE WHEN ece > 0.1 THEN 'scale temperature' END, CASE WHEN confidence > accuracy + 0.1 THEN 'recalibrate overconfidence' END,
    CASE WHEN hallucination_rate > 0.2 THEN 'verify against context' END, CASE WHEN correlation < -0.3 THEN 'filter by confidence' END], lambda x: x IS NOT NULL) AS l FROM n, k, h, f)
  SELECT i::INT AS ord, l[i + 1] AS advice FROM (SELECT l, unnest(range(0, len(l))) AS i FROM a)""")
def advice(spark, sf):
    """What the errors, the calibration and the unsupported claims call for."""
    p = pairs(spark, sf)
    found = H.errors(p.select("answer_id", "answer", F.col("question").alias("reference"), F.col("source").alias("context")))
    s = scored(spark, sf)
    return H.recommendations(found, H.calibration(s), REGISTRY["hallucination_rates"](spark, sf), s.agg(F.avg("confidence").alias("confidence")))


def _kind(t: str) -> str:
    every = lambda k: f"len(list_filter({t}, lambda x: x <> '{k}')) = 0"
    return f"CASE WHEN {every('cause_effect')} THEN 'causal_chain' WHEN {every('support')} THEN 'evidence_chain' WHEN list_contains({t}, 'contrast') THEN 'contrastive' WHEN {every('temporal')} THEN 'temporal_sequence' WHEN {every('parent_child')} THEN 'hierarchical' ELSE 'mixed' END"


@twin(f"""WITH {O.TRADE}, p0 AS (SELECT DISTINCT src AS seed, [src] AS path, []::VARCHAR[] AS types, 1e0 AS confidence, src AS last FROM tr), p1 AS ({W._BEST.format('p0')}), p2 AS ({W._BEST.format('p1')}), a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)
  SELECT seed, array_to_string(path, '>') AS path, {_kind('types')} AS kind, array_to_string(types, ', then ').replace('_', ' ') AS phrase FROM a""")
def graph_path_kinds(spark, sf):
    """What kind of reasoning each path of up to three nodes is."""
    e = trade(spark, sf)
    seeds = e.select(F.col("src").alias("node")).distinct().withColumn("confidence", F.lit(1.0))
    types = e.groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type"))
    paths = G.best_paths(e, seeds, 3, 0.3, None)
    hops = paths.select("seed", "path", "kind", F.posexplode("path").alias("i", "src"))
    both = hops.withColumn("dst", F.get("path", F.col("i") + 1)).where("dst is not null").join(types, ["src", "dst"])
    said = both.groupBy("seed", "path", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "edge_type"))), lambda x: x["edge_type"]).alias("t"))
    return said.select("seed", F.array_join("path", ">").alias("path"), "kind", G.connection_phrase(F.col("t")).alias("phrase"))


@twin("""WITH s AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY 1), f AS (SELECT conv_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE coalesce(role, 'user') = 'user')
  SELECT conv_id, n_turns, md5(t) AS first_question FROM s LEFT JOIN (SELECT * FROM f WHERE n = 1) USING (conv_id)""")
def loaded_sessions(spark, sf):
    return readers.sessions(read(spark, sf, "conversations")).select("conv_id", "n_turns", F.md5(F.col("first_question").cast("binary")).alias("first_question"))


@twin("""WITH r AS (SELECT doc_id::VARCHAR AS task_id, 'r' || (doc_id % 3) AS annotator_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS quality, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END AS toxic FROM labels)
  SELECT task_id, annotator_id, 'quality' AS rating, quality::DOUBLE AS value FROM r WHERE quality IS NOT NULL UNION ALL SELECT task_id, annotator_id, 'toxic', toxic::DOUBLE FROM r WHERE toxic IS NOT NULL""")
def annotation_rows(spark, sf):
    """Ratings written as CSV with blank and non-numeric cells, read as one row a rating."""
    d = F.col("doc_id")
    rows = read(spark, sf, "labels").where("doc_id is not null").select(d.cast("string").alias("task_id"), F.concat(F.lit("r"), (d % 3).cast("string")).alias("annotator_id"), F.when(d % 5 != 0, F.col("quality").cast("string")).alias("quality"), F.when(d % 7 == 0, "n/a").otherwise(F.col("toxic").cast("string")).alias("toxic"))
    at = new_folder(spark, "ratings")
    sinks.save_csv(rows, at)
    return readers.annotations(spark, at, ("quality", "toxic"))


@twin("SELECT 's' || (o_orderkey % 3) AS system, o_orderkey::INT AS question_id, (o_orderkey % 100) / 100e0 AS rouge_l FROM orders WHERE o_custkey % 3 > 0")
def best_report(spark, sf):
    """Of three reports on disk, one marked as contaminated, the one with most questions."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = read(spark, sf, "orders").select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("system"), k.cast("int").alias("question_id"), ((k % 100) / 100.0).alias("rouge_l"), c.alias("c"))
    at = new_folder(spark, "reports")
    for name, part in (("small", o.where("c % 3 = 0")), ("large", o.where("c % 3 > 0")), ("all_CONTAMINATED", o)):
        sinks.save_report(part.drop("c"), f"{at}/{name}")
    return readers.best_report(readers.report_rows(spark, f"{at}/*", "question_id int, rouge_l double")).select("system", "question_id", "rouge_l")


_PROBLEMS = (("doc_id % 4 = 1", "no PDF header"), ("doc_id % 6 = 1 AND NOT closes", "no end mark"), ("doc_id % 11 = 1", "bad name"), ("n > 5000", "too large"), ("doc_id % 13 = 1", "too complex"))


@twin("WITH f AS (SELECT doc_id, strlen(coalesce(text, '')) + CASE WHEN doc_id % 4 = 1 THEN 3 ELSE 8 END + CASE WHEN doc_id % 6 = 1 THEN 4 ELSE 5 END + CASE WHEN doc_id % 13 = 1 THEN 60 ELSE 0 END AS n, ends_with(coalesce(text, ''), '%') AS closes FROM documents) "
      + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS problem FROM f WHERE {c}" for c, p in _PROBLEMS))
def upload_problems(spark, sf):
    """Documents as uploaded files, some without a header, an end or a proper name, too large or too complex."""
    d = F.col("doc_id")
    body = F.concat(F.when(d % 4 == 1, "PDF").otherwise("%PDF-1.4"), F.when(d % 13 == 1, F.repeat(F.lit("/FlateDecode"), 5)).otherwise(""), F.coalesce("text", F.lit("")), F.when(d % 6 == 1, "%EOF").otherwise("%%EOF"))
    name = F.concat(F.lit("in/"), F.when(d % 11 == 1, "a..b").otherwise("doc"), d.cast("string"), F.lit(".pdf"))
    files = read(spark, sf, "documents").select("doc_id", name.alias("path"), body.cast("binary").alias("content")).withColumn("length", F.length("content"))
    found = readers.pdf_problems(files, 5000, 4)
    return found.select(F.regexp_extract("path", r"([0-9]+)\.pdf$", 1).cast("long").alias("doc_id"), "problem")


# streams


def _staged(spark, rows, more: str):
    """A folder of files to stream: the rows, and one last row that moves the watermark past them."""
    at = new_folder(spark, "stream")
    rows.write.parquet(f"{at}/in")
    spark.sql(more).write.mode("append").parquet(f"{at}/in")
    return at, spark.readStream.schema(rows.schema).parquet(f"{at}/in")


@twin("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts::TIMESTAMP) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts::TIMESTAMP, event_id) AS i FROM events WHERE ts IS NOT NULL),
  w AS (SELECT user_id, event_id, i, [t] AS held, true AS allowed, 0 AS retry_after FROM e WHERE i = 1
    UNION ALL SELECT user_id, event_id, i, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END, len(h) < 3, CASE WHEN len(h) < 3 THEN 0 ELSE trunc(h[1] + 21600 - t)::INT + 1 END FROM (
      SELECT e.*, list_filter(held, lambda x: x >= e.t - 21600) AS h FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
  SELECT user_id, event_id, allowed, retry_after FROM w""")
def rate_limited_stream(spark, sf):
    """Three requests of a user in six hours, over a stream."""
    e = timed(spark, sf).select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "ts")
    at = new_folder(spark, "stream")
    e.write.parquet(f"{at}/in")
    stream = limits.rate_limited(spark.readStream.schema(e.schema).parquet(f"{at}/in"), 3, 6 * 3600.0)
    return expiry.run_available(stream, f"{at}/out", f"{at}/checkpoint")


@twin("SELECT date_trunc('hour', ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def costs_by_hour_stream(spark, sf):
    """Sums by event-time windows of an hour, over a stream whose last event closes them all."""
    e = timed(spark, sf).select("ts", "event_type", F.col("value").cast("double").alias("value"))
    at, stream = _staged(spark, e, "SELECT timestamp '3000-01-01' AS ts, 'end' AS event_type, 0D AS value")
    out = expiry.run_available(limits.costs_by_window(stream), f"{at}/out", f"{at}/checkpoint")
    return out.where("event_type <> 'end'").withColumn("total", F.round("total", 6))


# ranking features

WEIGHTS, BIAS = (1.5, 0.5, 2.0, 1.0, 0.25, 0.5, -0.5, 0.75), -1.0


def _ws(t: str) -> str:
    return O.ws(t)


_FEATURES = f"""{_CASES}, dn AS (SELECT doc_id, max(depth) AS deep, count(*) AS size FROM nd GROUP BY 1),
  fx AS (SELECT question_id, node_id, po, CASE WHEN depth = 0 THEN NULL ELSE 'r' END AS up, depth, deep, CASE WHEN depth = 0 THEN 0e0 ELSE po / size END AS place, {_ws('question')} AS qa, {_ws('coalesce(nd.text, body)')} AS ta,
    list_distinct({_ws("coalesce((SELECT r.body FROM nd r WHERE r.doc_id = nd.doc_id AND r.po = 0 AND nd.po > 0), '')")}) AS p, list_distinct({_ws("coalesce(CASE WHEN depth = 0 THEN (SELECT string_agg(c.body, ' ' ORDER BY c.po) FROM nd c WHERE c.doc_id = nd.doc_id AND c.po > 0) END, '')")}) AS c FROM qs JOIN nd USING (doc_id) JOIN dn USING (doc_id)),
  fy AS (SELECT *, list_distinct(qa) AS q, list_distinct(ta) AS t FROM fx),
  fz AS (SELECT *, CASE WHEN len(q) > 0 AND len(t) > 0 THEN len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) ELSE 0e0 END AS f1, CASE WHEN deep > 0 THEN greatest(0e0, 1e0 - abs(depth - 0.4e0 * deep) / deep) ELSE 0.5e0 END AS f2, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0e0 END AS f3,
    CASE WHEN len(qa) > 0 AND len(ta) > 0 THEN list_sum(list_transform(list_transform(qa, lambda x: len(list_filter(ta, lambda y: y = x))::DOUBLE), lambda k: k * 2.2e0 / (k + 1.2e0 * (0.25e0 + 0.75e0 * len(ta) / 100e0)))) / (len(qa) * 2.2e0) ELSE 0e0 END AS f4, 1e0 - place AS f5,
    CASE WHEN len(q) > 0 AND len(p) > 0 THEN len(list_intersect(q, p)) / len(list_distinct(list_concat(q, p))) ELSE 0e0 END AS f6, CASE WHEN len(q) > 0 THEN len(list_intersect(q, c)) / len(q) ELSE 0e0 END AS f8 FROM fy),
  fv AS (SELECT question_id, node_id, po, [f1, f2, f3, f4, f5, f6, coalesce((sum(f1) OVER (PARTITION BY question_id, up) - f1) / nullif(count(*) OVER (PARTITION BY question_id, up) - 1, 0), 0e0), f8] AS f FROM fz),
  sv AS (SELECT *, {" + ".join(f"f[{i + 1}] * ({w}e0)" for i, w in enumerate(WEIGHTS))} AS z FROM fv)"""


def _features(spark, sf):
    nodes, q, gold = cases(spark, sf)
    size = nodes.groupBy("doc_id").agg(F.max("depth").alias("max_depth"), F.count("*").alias("size"))
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("summary").alias("parent_text"))
    down = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda x: x["summary"]), " ").alias("child_text"))
    at = F.when(F.col("depth") == 0, 0).otherwise(F.col("ord") + 1)
    own = nodes.join(size, "doc_id").join(up, ["doc_id", "parent_id"], "left").join(down, ["doc_id", "node_id"], "left").withColumns({"ord": at, "position": at / F.col("size"), "text": F.coalesce("text", "summary")})
    rows = L.features(q.select(F.col("question_id").alias("query_id"), "doc_id", F.col("question").alias("query")).join(own, "doc_id"))
    marked = rows.join(gold.select(F.col("question_id").alias("query_id"), "node_id", F.lit(True).alias("relevant")), ["query_id", "node_id"], "left")
    return marked.select("query_id", "node_id", "ord", F.coalesce("relevant", F.lit(False)).alias("relevant"), "features")


@twin(f"WITH {_FEATURES} SELECT question_id AS query_id, node_id, {', '.join(f'round(f[{i + 1}], 6) AS {n}' for i, n in enumerate(L.FEATURES))}, round(1e0 / (1e0 + exp(-(z + ({BIAS}e0)))), 6) AS score FROM sv")
def ranking_scores(spark, sf):
    """The eight features of every node of a case's tree, and its score under fixed weights."""
    s = L.score(_features(spark, sf), list(WEIGHTS), BIAS)
    return s.select("query_id", "node_id", *[F.round(F.col("features")[i], 6).alias(n) for i, n in enumerate(L.FEATURES)], F.round("score", 6).alias("score"))


@twin(f"""WITH {_FEATURES}, gold AS (SELECT question_id, node_id FROM qs JOIN nd USING (doc_id) WHERE depth = 1 AND len(list_intersect(list_distinct({O.w('question')}), list_distinct({O.w('text')}))) / len(list_distinct({O.w('question')})) >= 0.5),
  g AS (SELECT sv.*, gold.node_id IS NOT NULL AS good FROM sv LEFT JOIN gold USING (question_id, node_id)), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY po) AS n FROM g WHERE NOT good) WHERE n <= 10),
  p AS (SELECT a.z AS a, b.z AS b, 1e0 / (1e0 + exp(-a.z)) AS x, 1e0 / (1e0 + exp(-b.z)) AS y FROM g a JOIN b ON a.question_id = b.question_id WHERE a.good)
  SELECT count(*) AS n, round(avg(ln(1e0 + exp(-(a - b)))), 6) AS bpr, round(avg(greatest(0e0, 0.1e0 - (x - y))), 6) AS hinge, round(avg(ln(1e0 + exp(-a)) + ln(1e0 + exp(b))), 6) AS cross_entropy, round(avg(pow(1e0 - x, 2e0) + pow(y, 2e0)), 6) AS mse FROM p""")
def ranking_losses(spark, sf):
    """The four pairwise losses of the cases under fixed weights."""
    p = kept(L.training_pairs(_features(spark, sf)))
    out = p.agg(F.count("*").alias("n"))
    for kind in ("bpr", "hinge", "cross_entropy", "mse"):
        out = out.crossJoin(F.broadcast(L.loss(p, list(WEIGHTS), kind).select(F.round("loss", 6).alias(kind))))
    return out
