"""Registered queries of text similarity, exact tests, the embedding index, expiring entries, JSON trees and experiments, each beside its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import context, evaluation, folds, graph, grounding, traverse
from ..operators import retrieval as R
from ..operators import experiments as X
from ..operators import power as P
from ..operators import ranker
from ..operators import resampling as B
from ..operators import service as S
from ..operators import similarity as Y
from ..operators import training
from ..operators import tree as T
from ..sources import datasets, sinks
from ..sources.embedding_index import EmbeddingIndex
from ..sources.shared import kept, shared_dir
from ..streaming import expiry
from . import oracle as O
from . import twins
from .evaluation import SQL, routed_hits, twin
from .queries import REGISTRY, asked, chunk_scores, docs, geo, pairs, query, read, systems, timed, trade

CJK = "regexp_extract_all(lower({0}), '[0-9A-Za-z가-힣]+|[一-鿿]')"


def new_folder(spark, what: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


# text similarity

_TOKENS = f"""tok AS (SELECT answer_id, 0 AS side, unnest({CJK.format("coalesce(question, '')")}) AS t FROM pr UNION ALL SELECT answer_id, 1, unnest({CJK.format("coalesce(answer, '')")}) FROM pr),
  n AS (SELECT answer_id, side, t, count(*)::DOUBLE AS n FROM tok GROUP BY ALL)"""


@twin(f"""WITH {O.TURNS}, {_TOKENS},
  df AS (SELECT t, count(*) AS df FROM n WHERE side = 0 GROUP BY t),
  w AS (SELECT n.*, n.n * ln(((SELECT count(*) FROM pr) + 1e0) / (coalesce(df, 0) + 1e0)) AS w FROM n LEFT JOIN df USING (t)),
  g AS (SELECT t, right(md5(substring('^' || t || '$', i, 3)), 2) AS slot, count(*)::DOUBLE AS c FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT DISTINCT t FROM n)) GROUP BY ALL),
  s AS (SELECT t, sqrt(sum(c * c)) AS s FROM g GROUP BY t),
  need AS (SELECT DISTINCT a.t AS a, b.t AS b FROM n a JOIN n b USING (answer_id) WHERE a.side = 0 AND b.side = 1),
  dots AS (SELECT a, b, sum(x.c * y.c) AS d FROM need JOIN g x ON x.t = a JOIN g y ON y.t = b AND y.slot = x.slot GROUP BY a, b),
  cos AS (SELECT need.a, need.b, coalesce(d, 0) / (sa.s * sb.s) AS c FROM need LEFT JOIN dots USING (a, b) JOIN s sa ON sa.t = need.a JOIN s sb ON sb.t = need.b),
  best AS (SELECT answer_id, 0 AS side, x.t, max(c) AS c FROM n x JOIN n y USING (answer_id) JOIN cos ON cos.a = x.t AND cos.b = y.t WHERE x.side = 0 AND y.side = 1 GROUP BY answer_id, x.t
    UNION ALL SELECT answer_id, 1, y.t, max(c) FROM n x JOIN n y USING (answer_id) JOIN cos ON cos.a = x.t AND cos.b = y.t WHERE x.side = 0 AND y.side = 1 GROUP BY answer_id, y.t),
  m AS (SELECT answer_id, side, CASE WHEN sum(w) > 0 THEN sum(c * w) / sum(w) ELSE sum(c * n) / sum(n) END AS m FROM best JOIN w USING (answer_id, side, t) GROUP BY ALL),
  pr2 AS (SELECT pr.answer_id, p.m AS p, r.m AS r, len({CJK.format("coalesce(question, '')")}) + len({CJK.format("coalesce(answer, '')")}) = 0 AS bare FROM pr
    LEFT JOIN (SELECT * FROM m WHERE side = 1) p USING (answer_id) LEFT JOIN (SELECT * FROM m WHERE side = 0) r USING (answer_id))
  SELECT answer_id, round(coalesce(p, bare::INT), 6) AS precision, round(coalesce(r, bare::INT), 6) AS recall, round(CASE WHEN p IS NULL THEN bare::INT WHEN p + r > 0 THEN 2e0 * p * r / (p + r) ELSE 0e0 END, 6) AS f1 FROM pr2""")  # fmt: skip
def bertscore_pairs(spark, sf):
    return Y.bertscore(pairs(spark, sf), "answer_id", "question", "answer")


_F1 = f"""c AS (SELECT answer_id, sum(least(a.n, b.n)) AS c FROM n a JOIN n b USING (answer_id, t) WHERE a.side = 0 AND b.side = 1 GROUP BY 1),
  z AS (SELECT answer_id, len({CJK.format("coalesce(question, '')")}) AS nr, len({CJK.format("coalesce(answer, '')")}) AS nh FROM pr),
  f AS (SELECT answer_id, CASE WHEN nr + nh = 0 THEN 1e0 WHEN nh = 0 THEN 0e0 ELSE coalesce(c, 0) / nh END AS p, CASE WHEN nr + nh = 0 THEN 1e0 WHEN nr = 0 THEN 0e0 ELSE coalesce(c, 0) / nr END AS r FROM z LEFT JOIN c USING (answer_id))"""


@twin(f"WITH {O.TURNS}, {_TOKENS}, {_F1} SELECT answer_id, round(p, 6) AS precision, round(r, 6) AS recall, {O.f1('p', 'r')} AS f1 FROM f")
def token_f1_fallback(spark, sf):
    return Y.bertscore(pairs(spark, sf), "answer_id", "question", "answer", None)


_MEDICAL = "[" + ", ".join(f"'{t}'" for t in Y.M.MEDICAL_TERMS) + "]"


@twin(f"""WITH {O.TURNS}, {_TOKENS}, {_F1},
  e AS (SELECT answer_id, list_filter({_MEDICAL}, lambda x: contains(lower(question), x)) AS a, list_filter({_MEDICAL}, lambda x: contains(lower(answer), x)) AS b FROM pr),
  x AS ({O.SQL['exact_match_pairs']})
  SELECT answer_id, {O.f1('p', 'r')} AS token_f1, exact::DOUBLE AS exact_match, round(CASE WHEN len(a) = 0 THEN 1e0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS entity_recall FROM f JOIN e USING (answer_id) JOIN x USING (answer_id)""")  # fmt: skip
def text_metrics(spark, sf):
    """Several metrics of one batch, the medical terms among them."""
    return Y.evaluate(pairs(spark, sf), "answer_id", "question", "answer", ("token_f1", "exact_match", "entity_recall"))


# exact tests and power


def by_customer(spark, sf):
    o = systems(spark, sf).join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer")), "key")
    return P.paired_t_exact(o, ("customer",))


#: |T| < t under Student's t with a whole number of degrees of freedom v, in closed form: finite sums of powers of the cosine of atan(t / sqrt(v)).
_CLOSED = """CASE WHEN v = 1 THEN 2e0 * th / pi()
    WHEN v % 2 = 1 THEN 2e0 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (v - 1) // 2), lambda i: pow(cos(th), 2 * i + 1) * list_product(list_concat([1e0], list_transform(range(1, i + 1), lambda j: 2e0 * j / (2 * j + 1)))))))
    ELSE sin(th) * list_sum(list_transform(range(0, v // 2), lambda i: pow(cos(th), 2 * i) * list_product(list_concat([1e0], list_transform(range(1, i + 1), lambda j: (2e0 * j - 1) / (2 * j)))))) END"""


@twin(f"""WITH {O.SYSTEMS}, g AS (SELECT o_custkey AS customer, count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM sy JOIN orders ON o_orderkey = key GROUP BY 1),
  s AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN sd > 0 THEN m / (sd / sqrt(n)) WHEN m = 0 THEN 0e0 END AS t, sqrt((sa * sa + sb * sb) / 2) AS pooled, CASE WHEN sd > 0 THEN m / sd ELSE 0e0 END AS dz, n - 1 AS v FROM g),
  x AS (SELECT *, CASE WHEN pooled > 0 THEN abs(m) / pooled ELSE 0e0 END AS d, atan(abs(t) / sqrt(v)) AS th FROM s)
  SELECT customer, n, round(m, 6) AS mean_diff, round(t, 6) AS t, CASE WHEN t IS NOT NULL THEN round(1e0 - {_CLOSED}, 6) END AS p, round(d, 6) AS d,
    CASE WHEN d < 0.2 THEN 'negligible' WHEN d < 0.5 THEN 'small' WHEN d < 0.8 THEN 'medium' ELSE 'large' END AS effect, round(dz, 6) AS d_z,
    CASE WHEN dz <> 0 THEN ceil(pow((1.959963984540054e0 + 0.8416212335729143e0) / abs(dz), 2e0))::BIGINT END AS required_n FROM x""")  # fmt: skip
def paired_t_by_customer(spark, sf):
    return by_customer(spark, sf)


@query
def power_by_customer(spark, sf):
    """Achieved power of each customer's test."""
    return P.with_power(by_customer(spark, sf)).select("customer", "n", "d_z", "power")


@query
def effect_interval(spark, sf):
    """Bootstrap intervals of the mean difference and of d_z over all orders."""
    return B.bootstrap(systems(spark, sf), "key")


# embedding index

_PARTS = 16
_INDEXED = """x AS (SELECT doc_id, text, CASE WHEN doc_id % 97 = 0 THEN text || ' changed' ELSE text END AS later, (('0x' || right(md5(doc_id::VARCHAR), 2))::INT % 16) AS part FROM documents WHERE text IS NOT NULL)"""


def _digest(text: str) -> str:
    row = f"md5(doc_id || ':' || {text})"
    lane = lambda at: f"sum(('0x' || substring({row}, {at}, 15))::HUGEINT)::VARCHAR"
    return f"md5(count(*) || ':' || {lane(1)} || ':' || {lane(17)} || ':hashed-256:256')"


@twin(f"""WITH {_INDEXED}, a AS (SELECT part, {_digest('text')} AS old, {_digest('later')} AS digest, count(*) AS n_rows FROM x GROUP BY part)
  SELECT part::INT AS part, digest, n_rows, 256 AS dim, old <> digest AS rebuilt, 'created' AS first, 'existing' AS again, 'created' AS after_change FROM a""")
def embedding_index_refresh(spark, sf):
    """An index made, found unchanged, and refreshed after some rows changed: the parts' keys, and which were made anew."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    index = EmbeddingIndex(spark, new_folder(spark, "index"), parts=_PARTS)
    first, again = index.refresh(d), index.refresh(d)
    before = index.manifest.read(first.version).select("part", F.col("folder").alias("had"))
    after = index.refresh(d.withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))))
    now = index.manifest.read(after.version).join(before, "part")
    said = [F.lit(r.status).alias(n) for r, n in ((first, "first"), (again, "again"), (after, "after_change"))]
    return now.select("part", "digest", "n_rows", "dim", (F.col("folder") != F.col("had")).alias("rebuilt"), *said)


@twin(O.SQL["hash_embed_topk"])
def embedding_index_topk(spark, sf):
    """The search of hash_embed_topk, out of the materialised index."""
    index = EmbeddingIndex(spark, new_folder(spark, "index"), parts=_PARTS)
    index.refresh(docs(spark, sf))
    return index.search(asked(spark, sf))


# expiring entries


def _expiring(spark, sf, rule: str, ttl_s: float = 6 * 3600.0):
    """The events as a stream of files, with one last request a thousand years on that moves the watermark past all others."""
    e = timed(spark, sf).select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_id").alias("id"), "ts")
    at = new_folder(spark, "requests")
    e.write.parquet(f"{at}/in")
    spark.sql("SELECT 'end' AS key, -1L AS id, timestamp '3000-01-01' AS ts").write.mode("append").parquet(f"{at}/in")
    stream = expiry.with_rocks(spark).readStream.schema(e.schema).parquet(f"{at}/in")
    return expiry.run_available(expiry.expiring_hits(stream, ttl_s, rule), f"{at}/out", f"{at}/checkpoint").select("key", "id", "hit")


def _expiry_sql(live: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, event_id AS id, epoch_us(ts::TIMESTAMP) AS us FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
      o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, id) AS i FROM e),
      w AS (SELECT key, id, i, us, us AS made, false AS hit FROM o WHERE i = 1
        UNION ALL SELECT o.key, o.id, o.i, o.us, CASE WHEN o.us - w.made {live} 21600000000 THEN w.made ELSE o.us END, o.us - w.made {live} 21600000000 FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)
      SELECT key, id, hit FROM w"""


@twin(_expiry_sql("<="))
def expiring_hits_stream(spark, sf):
    return _expiring(spark, sf, "after")


# JSON trees

_NAMED = "CASE WHEN depth = 1 AND key % 3 = 0 THEN NULL ELSE node_id END"
_ORDERED = f"""o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY key) - 1)::INT AS ord FROM geo),
  p AS (SELECT c.*, n.ord AS up_ord FROM o c LEFT JOIN o n ON n.node_id = c.parent_id AND n.doc_id = c.doc_id),
  q AS (SELECT *, CASE depth WHEN 0 THEN [0] WHEN 1 THEN [0, ord] ELSE [0, up_ord, ord] END AS path FROM p),
  r AS (SELECT *, CASE WHEN depth = 1 AND key % 3 = 0 THEN 'node_' || array_to_string(path, '.') ELSE node_id END AS named FROM q)"""


@twin(f"""WITH {O.GEO}, {_ORDERED} SELECT c.doc_id, c.named AS node_id, u.named AS parent_id, c.ord, c.depth, c.title, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.path) - 1 AS pre_order
  FROM r c LEFT JOIN r u ON u.node_id = c.parent_id AND u.doc_id = c.doc_id""")
def tree_json_flatten(spark, sf):
    """The geography as JSON trees, a third of the nations without an id, flattened again."""
    from pyspark.sql import Window

    g = geo(spark, sf).withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("key")) - 1).cast("int"))
    none = F.lit(None).cast("string")
    nodes = kept(g.withColumns({"summary": none, "page_ref": none, "text": none, "unnamed": (F.col("depth") == 1) & (F.col("key") % 3 == 0)}))
    trees = T.rebuild(nodes, unnamed="unnamed")
    return T.flatten(spark, trees).select("doc_id", "node_id", "parent_id", "ord", "depth", "title", F.col("pre_order").cast("long").alias("pre_order"))


# experiments


def cases(spark, sf):
    """(nodes, questions, gold): section trees, the benchmark's passages each asked of the document it is routed to, and the sections that share half of a passage's words."""
    d = docs(spark, sf)
    to = S.route(asked(spark, sf), d, 1).select("query_id", "doc_id")
    q = asked(spark, sf).join(to, "query_id").select(F.col("query_id").alias("question_id"), "doc_id", F.col("text").alias("question"), F.col("text").alias("expected"), F.pmod("query_id", F.lit(3)).cast("string").alias("category"))
    q = kept(q)
    nodes = kept(T.section_tree(kept(R.only(d, q))))
    share = F.size(F.array_intersect(X.T.word_set("question"), X.T.word_set("text"))) / F.size(X.T.word_set("question"))
    gold = q.join(nodes.where("depth = 1").select("doc_id", "node_id", "text"), "doc_id").where(share >= 0.5).select("question_id", "node_id")
    return nodes, q, gold


_CASES = f"""{O.D}, {O.A}, qs AS (SELECT query_id AS question_id, doc_id, q.text AS question, (query_id % 3)::VARCHAR AS category FROM ({O.top(O.overlap(O.w('text'), 'share'), 1)}) JOIN q USING (query_id)),
  {O.SECTIONS}, st AS (SELECT doc_id, ord, array_to_string(ww, ' ') AS text FROM sec),
  nd AS (SELECT doc_id, 'd' || doc_id AS node_id, 0 AS depth, 0 AS po, 'Document ' || doc_id AS title, substring(text, 1, 200) AS body, NULL::VARCHAR AS text, '1' AS page FROM d WHERE doc_id IN (SELECT doc_id FROM qs)
    UNION ALL SELECT doc_id, 'd' || doc_id || '.' || (ord + 1), 1, ord + 1, 'Section ' || (ord + 1), substring(text, 1, 200), text, (ord + 1)::VARCHAR FROM st WHERE doc_id IN (SELECT doc_id FROM qs)),
  nw AS (SELECT *, trim(title || ' ' || body) AS words FROM nd),
  x AS (SELECT doc_id, node_id, len(t) AS n, unnest(t) AS t FROM (SELECT doc_id, node_id, {CJK.format('words')} AS t FROM nw)), xc AS (SELECT doc_id, node_id, n, t, count(*) AS x FROM x GROUP BY ALL),
  y AS (SELECT question_id, doc_id, len(t) AS asked, unnest(t) AS t FROM (SELECT question_id, doc_id, {CJK.format('question')} AS t FROM qs)), yc AS (SELECT question_id, doc_id, asked, t, count(*) AS y FROM y GROUP BY ALL)"""

_PLACE = "row_number() OVER (PARTITION BY question_id ORDER BY score DESC, po) AS rank"
_ALL = "(SELECT question_id, nw.node_id, nw.po, coalesce(s.score, 0) AS score FROM qs JOIN nw USING (doc_id) LEFT JOIN {0} s USING (question_id, node_id))"
_LEAVES = f"""rt AS (SELECT doc_id, string_agg(text, ' ' ORDER BY po) AS text FROM nd WHERE text IS NOT NULL GROUP BY 1),
  rc AS (SELECT doc_id, i::INT AS ord, substring(text, i * 300 + 1, 300) AS text, ceil(ceil(length(text) / 300) / 3)::INT AS k FROM (SELECT *, unnest(range(0, (length(text) + 299) // 300)) AS i FROM rt)),
  rn AS (SELECT doc_id, 'chunk_' || ord AS node_id, 1000000 + ord AS po, text FROM rc UNION ALL SELECT doc_id, 'cluster_' || (ord % k), ord % k, string_agg(substring(text, 1, 80), ' ' ORDER BY ord) FROM rc GROUP BY doc_id, ord % k),
  rg AS (SELECT doc_id, node_id, po, list_distinct({O.GRAMS}) AS g FROM rn), qg AS (SELECT question_id, doc_id, list_distinct({O.GRAMS}) AS h FROM (SELECT question_id, doc_id, question AS text FROM qs)),
  rp AS (SELECT question_id, node_id, po, round(CASE WHEN len(g) + len(h) = 0 THEN 0e0 ELSE len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) END, 6) AS score FROM qg JOIN rg USING (doc_id))"""
_FLAT = f"""fx AS (SELECT doc_id, node_id, len(t) AS n, unnest(t) AS t FROM (SELECT doc_id, node_id, {O.w("body || ' ' || title", 1)} AS t FROM nw)), fd AS (SELECT DISTINCT * FROM fx),
  fl AS (SELECT doc_id, count(*) AS nn, avg(len({O.w("body || ' ' || title", 1)})) AS al FROM nw GROUP BY 1), ff AS (SELECT doc_id, t, count(*) AS df FROM fd GROUP BY ALL),
  fy AS (SELECT question_id, doc_id, t, count(*) AS y FROM (SELECT question_id, doc_id, unnest({O.w('question', 1)}) AS t FROM qs) GROUP BY ALL),
  fm AS (SELECT question_id, doc_id, node_id, round(sum(y * ln((nn - df + 0.5e0) / (df + 0.5e0) + 1e0)), 6) AS first, round(sum(ln((nn - df + 0.5e0) / (df + 0.5e0) + 1e0) * 2.5e0 / (1e0 + 1.5e0 * (0.25e0 + 0.75e0 * n / al))), 6) AS bm FROM fy JOIN fd USING (doc_id, t) JOIN ff USING (doc_id, t) JOIN fl USING (doc_id) GROUP BY ALL),
  fc AS (SELECT * FROM (SELECT fm.*, po, depth, body, row_number() OVER (PARTITION BY question_id ORDER BY first DESC, po) AS place FROM fm JOIN nw USING (doc_id, node_id)) WHERE place <= 20),
  fs AS (SELECT question_id, node_id, po, round(0.6e0 * CASE WHEN max(bm) OVER (PARTITION BY question_id) > 0 THEN bm / max(bm) OVER (PARTITION BY question_id) ELSE 0e0 END
    + 0.25e0 * (len(list_intersect(list_distinct({O.w('question')}), list_distinct({O.w('body')}))) / greatest(len(list_distinct(list_concat({O.w('question')}, {O.w('body')}))), 1)) + 0.15e0 * greatest(pow(0.85e0, depth), 0.1e0), 6) AS score FROM fc JOIN qs USING (question_id))"""  # fmt: skip
_HITS = f"""{_CASES},
  b0 AS (SELECT doc_id, count(*) AS nn, avg(n) AS al FROM (SELECT doc_id, node_id, max(n) AS n FROM x GROUP BY ALL) GROUP BY 1), b1 AS (SELECT doc_id, t, count(*) AS df FROM xc GROUP BY ALL),
  b2 AS (SELECT b1.doc_id, t, al, ln(nn - df + 0.5e0) - ln(df + 0.5e0) AS i FROM b1 JOIN b0 USING (doc_id)), b3 AS (SELECT doc_id, avg(i) AS m FROM b2 GROUP BY 1),
  b4 AS (SELECT question_id, node_id, round(sum(y * (CASE WHEN i < 0 THEN 0.25e0 * m ELSE i END) * x * 2.5e0 / (x + 1.5e0 * (0.25e0 + 0.75e0 * n / al))), 6) AS score FROM yc JOIN xc USING (doc_id, t) JOIN b2 USING (doc_id, t) JOIN b3 USING (doc_id) GROUP BY ALL),
  v1 AS (SELECT doc_id, node_id, right(md5(t), 2) AS slot, sum(x)::DOUBLE AS x FROM xc GROUP BY ALL), v2 AS (SELECT question_id, doc_id, right(md5(t), 2) AS slot, sum(y)::DOUBLE AS y FROM yc GROUP BY ALL),
  v3 AS (SELECT question_id, node_id, round(sum(x * y) / (any_value(xs) * any_value(ys)), 6) AS score FROM v2 JOIN v1 USING (doc_id, slot) JOIN (SELECT doc_id, node_id, sqrt(sum(x * x)) AS xs FROM v1 GROUP BY ALL) USING (doc_id, node_id)
    JOIN (SELECT question_id, sqrt(sum(y * y)) AS ys FROM v2 GROUP BY ALL) USING (question_id) GROUP BY question_id, node_id),
  f0 AS (SELECT question_id, nw.doc_id, nw.node_id, po, depth, 2e0 * sum(least(x, y)) / (asked + n) AS f1 FROM yc JOIN xc USING (doc_id, t) JOIN nw USING (doc_id, node_id) GROUP BY question_id, nw.doc_id, nw.node_id, po, depth, asked, n),
  au AS (SELECT question_id, CASE WHEN len(s) < 2 OR s[1] - s[2] >= 0.15e0 THEN 'dfs' ELSE 'beam' END AS chosen FROM (SELECT question_id, list_reverse_sort(list(round(coalesce(f1, 0), 6))) AS s FROM qs JOIN nw USING (doc_id) LEFT JOIN f0 USING (question_id, node_id) WHERE nw.depth = 1 GROUP BY 1)),
  {_LEAVES}, {_FLAT},
  hits AS (
    SELECT 'bm25' AS system, question_id, node_id, score, rank FROM (SELECT *, {_PLACE} FROM {_ALL.format('b4')}) WHERE rank <= 3
    UNION ALL SELECT 'dense', question_id, node_id, score, rank FROM (SELECT *, {_PLACE} FROM {_ALL.format('v3')}) WHERE rank <= 3
    UNION ALL SELECT 'flatrag', question_id, node_id, score, rank FROM (SELECT *, {_PLACE} FROM fs) WHERE rank <= 3
    UNION ALL SELECT 'raptor', question_id, node_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS most, {_PLACE} FROM rp) WHERE rank <= 5 AND (score > 0 OR most = 0)
    UNION ALL SELECT 'treerag_dfs', question_id, node_id, score, rank FROM (SELECT *, {_PLACE} FROM (SELECT question_id, node_id, po, round(f1 * pow(0.9e0, depth), 6) AS score FROM f0)) WHERE rank <= 3
    UNION ALL SELECT 'treerag_beam', question_id, node_id, score, rank FROM (SELECT *, {_PLACE} FROM (SELECT question_id, node_id, po, round(f1, 6) AS score FROM f0)) WHERE rank <= 5
    UNION ALL SELECT 'treerag_auto', question_id, node_id, score, rank FROM (SELECT *, {_PLACE} FROM (SELECT question_id, node_id, po, chosen, round(CASE WHEN chosen = 'dfs' THEN f1 * pow(0.9e0, depth) ELSE f1 END, 6) AS score FROM f0 JOIN (SELECT question_id, coalesce(chosen, 'dfs') AS chosen FROM qs LEFT JOIN au USING (question_id)) USING (question_id)))
      WHERE rank <= CASE WHEN chosen = 'dfs' THEN 3 ELSE 5 END)"""  # fmt: skip


@twin(f"WITH {_HITS} SELECT system, question_id, node_id, score, rank FROM hits")
def experiment_hits(spark, sf):
    """What each of the seven systems finds."""
    nodes, q, _ = cases(spark, sf)
    parts = [kept(f(nodes, q, 3).select(F.lit(name).alias("system"), "question_id", "node_id", "score", "rank")) for name, f in X.SYSTEMS.items()]  # a plan each, not one of seven
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def experiment(spark, sf):
    nodes, q, gold = cases(spark, sf)
    e = X.Experiment(spark, new_folder(spark, "experiment"))
    e.run(nodes, q)
    return e, q, gold, nodes


_GOLD = f"gold AS (SELECT question_id, node_id FROM qs JOIN nd USING (doc_id) WHERE depth = 1 AND len(list_intersect(list_distinct({O.w('question')}), list_distinct({O.w('text')}))) / len(list_distinct({O.w('question')})) >= 0.5)"
_ANSWERS = """bodies AS (SELECT question_id, nw.node_id, title, body, page FROM qs JOIN nw USING (doc_id) UNION ALL
    SELECT question_id, node_id, CASE WHEN po >= 1000000 THEN 'Chunk ' || (po - 1000000) ELSE 'Cluster ' || po END, text, '1' FROM qs JOIN rn USING (doc_id)),
  ans AS (SELECT system, question_id, string_agg(trim(title || ': ' || body) || ' [p.' || page || ']', ' ' ORDER BY rank) AS answer FROM hits JOIN bodies USING (question_id, node_id) GROUP BY ALL)"""


@twin(f"""WITH {_HITS}, {_GOLD}, {_ANSWERS}, ng AS (SELECT question_id, count(*) AS g FROM gold GROUP BY 1), sys AS (SELECT DISTINCT system FROM hits),
  per AS (SELECT system, question_id, category, k, g, (SELECT count(*) FROM hits h JOIN gold USING (question_id, node_id) WHERE h.system = sys.system AND h.question_id = qs.question_id AND rank <= k) AS h,
    (SELECT coalesce(sum(1e0 / log2(rank + 1e0)), 0) FROM hits h JOIN gold USING (question_id, node_id) WHERE h.system = sys.system AND h.question_id = qs.question_id AND rank <= k) AS d FROM sys, qs JOIN ng USING (question_id), (VALUES (1), (3), (5)) ks(k)),
  long AS (SELECT system, category, 'precision@' || k AS metric, round(h / k, 6) AS value FROM per UNION ALL SELECT system, category, 'recall@' || k, round(h / g, 6) FROM per
    UNION ALL SELECT system, category, 'f1@' || k, round(CASE WHEN h > 0 THEN 2e0 * (h / k) * (h / g) / (h / k + h / g) ELSE 0e0 END, 6) FROM per
    UNION ALL SELECT system, category, 'ndcg@' || k, round(d / list_sum(list_transform(range(1, least(k, g) + 1), lambda i: 1e0 / log2(i + 1e0))), 6) FROM per WHERE k > 1
    UNION ALL SELECT system, category, 'answer_length', length(coalesce(answer, '')) FROM sys CROSS JOIN qs LEFT JOIN ans USING (system, question_id)
    UNION ALL SELECT system, category, 'context_size', length(coalesce(answer, '')) // 4 FROM sys CROSS JOIN qs LEFT JOIN ans USING (system, question_id)
    UNION ALL SELECT system, category, 'citation_accuracy', (SELECT count(DISTINCT page) FROM gold JOIN nd USING (node_id) WHERE gold.question_id = qs.question_id AND regexp_matches(coalesce(answer, ''), '\\[p\\.' || page || '([^0-9]|$)')) / (SELECT count(DISTINCT page) FROM gold JOIN nd USING (node_id) WHERE gold.question_id = qs.question_id)
      FROM sys CROSS JOIN qs JOIN ng USING (question_id) LEFT JOIN ans USING (system, question_id))
  SELECT system, category, metric, grouping(category) = 1 AS whole, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM long GROUP BY GROUPING SETS ((system, metric), (system, category, metric))""")  # fmt: skip
def experiment_report(spark, sf):
    """Retrieval metrics, citation accuracy and sizes of all systems, over all categories and by category."""
    e, q, gold, nodes = experiment(spark, sf)
    pages = gold.join(nodes.select("node_id", F.col("page_ref").alias("page")), "node_id")
    return X.report(X.case_metrics(e.results(), gold, pages))


@query
def experiment_summary(spark, sf):
    """Mean scores of the systems after a judge has run, and after a second run that finds all of them finished."""
    e, q, _, nodes = experiment(spark, sf)
    e.judge(q, F.round(F.least(F.lit(1.0), F.length("answer") / F.greatest(F.length("expected"), F.lit(1))), 6))
    ran = e.run(nodes, q)
    return X.summary(e.results()).withColumn("ran_again", F.lit(len(ran)))


@query
def experiment_significance(spark, sf):
    e, *_ = experiment(spark, sf)
    return X.significance(e.results())




# sessions


@twin("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1), m AS (SELECT min(conv_id) AS least FROM c)
  SELECT conv_id::VARCHAR AS session_id, '{"turns":' || (CASE WHEN conv_id % 10 = 0 THEN n + 1000 ELSE n END) || '}' AS session, conv_id = least AS current FROM c, m WHERE conv_id % 7 <> 3""")
def session_merges(spark, sf):
    """Sessions saved, merged into twice and deleted from; each change is a version of its own."""
    from ..sources.sessions import SessionStore

    c = read(spark, sf, "conversations").where("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("n"))
    as_json = lambda n: F.to_json(F.struct(n.alias("turns")))
    rows = c.select("conv_id", F.col("conv_id").cast("string").alias("session_id"), as_json(F.col("n")).alias("session"))
    store = SessionStore(spark, new_folder(spark, "sessions"))
    first = c.agg(F.min("conv_id").cast("string")).first()[0]
    store.save(rows.where("conv_id % 2 = 0"))
    store.merge(rows.where("conv_id % 2 = 1"), first)
    store.merge(c.where("conv_id % 10 = 0").select(F.col("conv_id").cast("string").alias("session_id"), as_json(F.col("n") + 1000).alias("session")))
    store.delete(rows.where("conv_id % 7 = 3"))
    return store.table.read()


# sequences as table functions


@twin(f"SELECT grp::VARCHAR AS grp, ord, leader FROM ({twins.SQL['leader_merge']})")
def leader_merge_streamed(spark, sf):
    c = chunk_scores(spark, sf).select(F.col("query_id").alias("grp"), F.col("rank").alias("ord"), "text")
    return folds.streamed_leaders(c, 0.3)


@twin(f"SELECT grp::VARCHAR AS grp, ord, n_tokens, taken FROM ({twins.SQL['budget_truncate']})")
def budget_truncate_streamed(spark, sf):
    c = context.relevance(chunk_scores(spark, sf), ("query_id", "chunk_id", "rank")).select(F.col("query_id").alias("grp"), F.col("rank").alias("ord"), "score", F.floor(F.length("text") / 3).alias("n_tokens"))
    return folds.streamed_budget(c, 500)


# learning to rank


def ranking_examples(spark, sf):
    """The cases' questions against all nodes of their trees, those that share half the question's words being relevant."""
    nodes, q, gold = cases(spark, sf)
    top = nodes.groupBy("doc_id").agg(F.max("depth").alias("max_depth"), F.count("*").alias("size"))
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("summary").alias("parent_text"))
    down = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda x: x["summary"]), " ").alias("child_text"))
    place = F.when(F.col("depth") == 0, 0.0).otherwise((F.col("ord") + 1) / F.col("size"))
    own = nodes.join(top, "doc_id").join(up, ["doc_id", "parent_id"], "left").join(down, ["doc_id", "node_id"], "left").withColumns({"position": place, "text": F.coalesce("text", "summary")})
    rows = q.select(F.col("question_id").alias("query_id"), "doc_id", F.col("question").alias("query")).join(own, "doc_id")
    rows = ranker.features(rows).join(gold.select(F.col("question_id").alias("query_id"), "node_id", F.lit(True).alias("relevant")), ["query_id", "node_id"], "left")
    return training.examples(rows.select("query_id", "node_id", (F.col("depth") * 1000 + F.col("ord")).alias("ord"), F.coalesce("relevant", F.lit(False)).alias("relevant"), "features"))


@query
def ranker_training(spark, sf):
    """The course of a training of a few epochs, and how well the model that was saved and loaded again ranks."""
    e = kept(ranking_examples(spark, sf))
    at = new_folder(spark, "model")
    training.train(e, epochs=3, batches=3, rate=0.5).save(spark, at)
    model = training.Ranker.load(spark, at)
    course = spark.createDataFrame([(h["epoch"], round(h["train_loss"], 9), round(h["val_loss"], 9)) for h in model.history], "epoch int, train_loss double, val_loss double")
    return course.crossJoin(F.broadcast(training.quality(e, model)))


# graphs


_SIBLINGS = f"""d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {O.SECTIONS},
  nb AS (SELECT doc_id, ord, 'd' || doc_id || '.' || (ord + 1) AS node_id, list_distinct({O.w("'Section ' || (ord + 1) || ' ' || substring(array_to_string(ww, ' '), 1, 200)")}) AS w FROM sec)"""


@twin(f"""WITH {_SIBLINGS}, pr AS (SELECT a.doc_id, a.node_id AS x, b.node_id AS y, len(a.w) AS nx, len(b.w) AS ny, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS c FROM nb a JOIN nb b ON a.doc_id = b.doc_id AND b.ord - a.ord IN (1, 2)),
  e AS (SELECT doc_id, CASE WHEN nx > ny THEN y ELSE x END AS src, CASE WHEN nx > ny THEN x ELSE y END AS dst, 'elaboration' AS edge_type, c AS confidence, nx = ny AS bidirectional FROM pr WHERE c >= 0.2e0
    UNION ALL SELECT doc_id, y, x, 'elaboration', c, true FROM pr WHERE c >= 0.2e0 AND nx = ny)
  SELECT * FROM e UNION ALL SELECT doc_id, 'd' || doc_id, node_id, 'parent_child', 1e0, false FROM nb""")
def graph_build_docs(spark, sf):
    """The reasoning graphs of all documents' section trees."""
    return graph.build(T.section_tree(docs(spark, sf)), least=0.2)


@twin(f"""WITH RECURSIVE {O.TRADE}, asked AS (SELECT 'n' || n_nationkey AS a, 'n' || ((n_nationkey * 7 + 5) % 25) AS b FROM nation UNION SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation),
  p AS (SELECT a, b, [a] AS path, a AS last FROM asked UNION ALL SELECT p.a, p.b, list_append(path, dst), dst FROM p JOIN (SELECT DISTINCT src, dst FROM tr) e ON e.src = p.last WHERE last <> b AND len(path) < 5 AND NOT list_contains(path, dst)),
  s AS (SELECT a, b, path FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) AS n FROM p WHERE last = b) WHERE n = 1),
  k AS (SELECT src, dst, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, edge_type) AS n FROM tr) WHERE n = 1),
  h AS (SELECT a, b, i, path[i] AS x, path[i + 1] AS y FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM s)),
  t AS (SELECT a, b, string_agg(nx.n_name, '>' ORDER BY i) AS nodes, coalesce(string_agg(edge_type, '>' ORDER BY i), '') AS types,
    string_agg(CASE edge_type WHEN 'temporal' THEN '''' || nx.n_name || ''' precedes ''' || ny.n_name || '''' WHEN 'support' THEN '''' || nx.n_name || ''' supports ''' || ny.n_name || '''' WHEN 'cause_effect' THEN '''' || nx.n_name || ''' leads to ''' || ny.n_name || '''' END, ' → ' ORDER BY i) AS said, count(*) - 1 AS l
    FROM h JOIN nation nx ON 'n' || nx.n_nationkey = x LEFT JOIN nation ny ON 'n' || ny.n_nationkey = y LEFT JOIN k ON k.src = x AND k.dst = y GROUP BY a, b)
  SELECT a, b, t.a IS NOT NULL AS connected, coalesce(l, -1)::INT AS path_length, nodes, types, CASE WHEN t.a IS NULL THEN 'No reasoning path found between these sections.' WHEN l = 0 THEN 'Direct reference.' ELSE said END AS explanation FROM asked LEFT JOIN t USING (a, b)""")  # fmt: skip
def graph_explain(spark, sf):
    """How asked pairs of nations are connected, in words."""
    n = read(spark, sf, "nation")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    titles = n.select(name.alias("node"), F.col("n_name").alias("title"))
    to = F.concat(F.lit("n"), F.pmod(F.col("n_nationkey") * 7 + 5, F.lit(25)).cast("string"))
    asked_pairs = n.select(name.alias("a"), F.explode(F.array(to, name)).alias("b"))
    out = graph.explain(trade(spark, sf), titles, asked_pairs, 4)
    return out.withColumns({"nodes": F.array_join("nodes", ">"), "types": F.array_join("types", ">")})


# comparisons


@twin(f"""WITH m AS (SELECT * FROM ({O.SQL['ir_metrics']})), l AS (SELECT system, query_id, k, 'ndcg' AS metric, ndcg AS x FROM m UNION ALL SELECT system, query_id, k, 'recall', recall FROM m),
  j AS (SELECT a.system AS first, b.system AS second, metric, a.x, b.x AS y FROM l a JOIN l b USING (query_id, k, metric) WHERE a.system < b.system),
  g AS (SELECT first, second, metric, count(*) AS n, avg(x - y) AS m, stddev_samp(x - y) AS sd, count(*) FILTER (x > y) AS wins, count(*) FILTER (x < y) AS losses, count(*) FILTER (x = y) AS ties FROM j GROUP BY ALL),
  t AS (SELECT *, CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) WHEN m = 0 THEN 0e0 END AS t, CASE WHEN sd > 0 THEN m / sd ELSE 0e0 END AS d_z, n - 1 AS v FROM g), x AS (SELECT *, atan(abs(t) / sqrt(v)) AS th FROM t),
  p AS (SELECT *, CASE WHEN t IS NOT NULL THEN 1e0 - {_CLOSED} END AS p FROM x)
  SELECT first, second, metric, n, round(m, 6) AS mean_diff, wins, losses, ties, round(t, 6) AS t, round(p, 6) AS p, round(d_z, 6) AS d_z, CASE WHEN p * count(p) OVER () < 0.05 THEN CASE WHEN t > 0 THEN first ELSE second END END AS winner FROM p""")  # fmt: skip
def system_tests(spark, sf):
    """Pairs of retrieval systems with wins, exact tests and a winner."""
    return evaluation.pairwise_tests(REGISTRY["ir_metrics"](spark, sf), ("ndcg", "recall"), key=("query_id", "k"))


@twin(f"""WITH {O.SYSTEMS}, d AS (SELECT o_orderpriority AS dimension, key, a - b AS d FROM sy JOIN orders ON o_orderkey = key WHERE a <> b), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY round(abs(d), 9), key) AS k FROM d),
  g AS (SELECT dimension, count(*)::DOUBLE AS n, least(coalesce(sum(k) FILTER (d > 0), 0), coalesce(sum(k) FILTER (d < 0), 0))::DOUBLE AS w FROM r GROUP BY 1), z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM g)
  SELECT dimension, n::BIGINT AS n, w, round(z, 6) AS z, round(2e0 * (1e0 - {O.phi('abs(z)')}), 6) AS p, round(abs(z) / sqrt(n), 6) AS r FROM z""")
def rating_tests(spark, sf):
    o = systems(spark, sf).join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("dimension")), "key")
    return evaluation.rating_tests(o, ("dimension",), "key")


@twin(f"""WITH {_CASES}, qw AS (SELECT question_id, doc_id, unnest(list_distinct({O.w('question')})) AS t FROM qs), nt AS (SELECT doc_id, node_id, po, unnest(list_distinct({O.w("title || ' ' || body")})) AS t FROM nd),
  m AS (SELECT question_id, node_id, po, count(*) AS n FROM qw JOIN nt USING (doc_id, t) GROUP BY ALL)
  SELECT question_id, node_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, po) AS rank FROM m) WHERE rank <= 3""")
def source_nodes(spark, sf):
    nodes, q, _ = cases(spark, sf)
    return S.source_nodes(nodes, q)


@query
def ablation_grid(spark, sf):
    """Two retrieval plans under one, three and five branches, by the cases' gold sections."""
    nodes, q, gold = cases(spark, sf)
    return X.ablation_grid(nodes, q, gold, {"treerag_dfs": X.tree_dfs, "bm25": X.bm25}, (1, 3, 5))


# question sets and graph files


@twin(f"""WITH {O.D}, {O.SECTIONS}, n AS (SELECT doc_id, len(wd) AS w, greatest((len(wd) + 399) // 400, 1) AS n FROM sw)
  SELECT doc_id, 'ROOT' AS node_id, '1-' || n AS page_ref, 'gr_' || doc_id AS question_id, md5('Government report (' || w || ' words, ' || n || ' sections)') AS digest, false AS relevant FROM n
  UNION ALL SELECT doc_id, 'PAGE' || (ord + 1), (ord + 1)::VARCHAR, 'gr_' || doc_id, md5(array_to_string(ww, ' ')), true FROM sec
  UNION ALL SELECT doc_id, 'PAGE1', '1', 'gr_' || doc_id, md5(''), true FROM n WHERE w = 0""")
def report_benchmark(spark, sf):
    """Every document as a long report: its tree, its question and what is relevant."""
    d = docs(spark, sf).select("doc_id", F.col("text").alias("report"), F.substring("text", 1, 80).alias("summary"))
    nodes, q, rel = datasets.report_benchmark(d, None)
    j = nodes.join(q.select("question_id", "doc_id"), "doc_id").join(rel.withColumn("relevant", F.lit(True)), ["question_id", "node_id"], "left")
    return j.select("doc_id", "node_id", "page_ref", "question_id", F.md5(F.col("summary").cast("binary")).alias("digest"), F.coalesce("relevant", F.lit(False)).alias("relevant"))


_TURNS_AT = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations)"


@twin(f"WITH {_TURNS_AT} SELECT conv_id::VARCHAR AS question_id, 'SEC' || i AS node_id, CASE WHEN conv_id % 2 = 0 THEN 'hard' ELSE 'medium' END AS difficulty, (i + 1)::VARCHAR AS page_ref, md5(trim(text)) AS digest FROM t WHERE role = 'assistant'")
def item_benchmark(spark, sf):
    """Conversations as items whose sections are their turns, those of the assistant being relevant."""
    c = read(spark, sf, "conversations")
    s = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text", (F.col("role") == "assistant").alias("relevant"))))
    items = c.groupBy("conv_id").agg(s.alias("sections")).select(
        F.col("conv_id").cast("string").alias("question_id"), F.get("sections", F.lit(0))["text"].alias("question"), F.lit("x").alias("answer"), F.when(F.col("conv_id") % 2 == 0, "bridge").otherwise("comparison").alias("kind"), "sections",
    )
    nodes, q, rel = datasets.item_benchmark(items)
    j = rel.join(nodes.withColumnRenamed("doc_id", "question_id"), ["question_id", "node_id"]).join(q.select("question_id", "difficulty"), "question_id")
    return j.select("question_id", "node_id", "difficulty", "page_ref", F.md5(F.col("summary").cast("binary")).alias("digest"))


@twin(f"""WITH g AS ({SQL['graph_build_docs']}), e AS (SELECT doc_id, count(*) AS n_edges, count(*) FILTER (edge_type = 'elaboration') AS n_elaborations, count(*) FILTER (bidirectional) AS n_both FROM g GROUP BY 1)
  SELECT d.doc_id::VARCHAR AS doc_id, coalesce(any_value(n_edges) - any_value(n_elaborations), 0) + 1 AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges, coalesce(any_value(n_elaborations), 0) AS n_elaborations, coalesce(any_value(n_both), 0) AS n_both FROM documents d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id""")
def graph_files(spark, sf):
    """The reasoning graphs written as JSON and read again, counted by document."""
    nodes = kept(T.section_tree(docs(spark, sf)))
    at = new_folder(spark, "graphs")
    sinks.save_graphs(nodes, graph.build(nodes, least=0.2), at)
    n, e = sinks.load_graphs(spark, at)
    count = lambda c: F.count(F.when(c, 1))
    per = e.groupBy("doc_id").agg(F.count("*").alias("n_edges"), count(F.col("edge_type") == "elaboration").alias("n_elaborations"), count(F.col("bidirectional")).alias("n_both"))
    return n.groupBy("doc_id").agg(F.count("*").alias("n_nodes")).join(per, "doc_id", "left").fillna(0)


# references, prompts, context reports


@twin(f"""WITH {O.D}, {O.SECTIONS}, k AS (SELECT doc_id, key, arg_max(node_id, po) AS node_id FROM (
    SELECT doc_id, 'd' || doc_id || '.' || (ord + 1) AS node_id, ord + 1 AS po, unnest(list_distinct(['d' || doc_id || '.' || (ord + 1), 'section ' || (ord + 1), 'section_' || (ord + 1)])) AS key FROM sec
    UNION ALL SELECT doc_id, 'd' || doc_id, 0, unnest(['d' || doc_id, 'document ' || doc_id]) FROM d) GROUP BY ALL),
  t AS (SELECT o_orderkey % 400 AS doc_id, 'see Section ' || (o_custkey % 7 + 1) || ' and table ' || (o_custkey % 5) || '; Sec. ' || (o_orderkey % 3 + 1) || ' or page ' || (o_custkey % 4) AS text FROM orders),
  r AS (SELECT DISTINCT doc_id, kind, number FROM (SELECT doc_id, 'section' AS kind, unnest(regexp_extract_all(text, '(?i)(?:section|sec\\.)\\s+([0-9]+(?:\\.[0-9]+)*)', 1)) AS number FROM t
    UNION ALL SELECT doc_id, 'table', unnest(regexp_extract_all(text, '(?i)table\\s+([0-9]+(?:[.-][0-9]+)*)', 1)) FROM t UNION ALL SELECT doc_id, 'page', unnest(regexp_extract_all(text, '(?i)(?:page|p\\.)\\s*([0-9]+)', 1)) FROM t))
  SELECT r.doc_id, kind, number, coalesce(a.node_id, b.node_id) AS node_id FROM r LEFT JOIN k a ON a.doc_id = r.doc_id AND a.key = kind || '_' || number LEFT JOIN k b ON b.doc_id = r.doc_id AND b.key = number""")
def resolved_references(spark, sf):
    """Cross-references out of texts and the sections they mean."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    say = lambda x: x.cast("string")
    text = F.concat(F.lit("see Section "), say(c % 7 + 1), F.lit(" and table "), say(c % 5), F.lit("; Sec. "), say(k % 3 + 1), F.lit(" or page "), say(c % 4))
    found = context.detect_references(read(spark, sf, "orders").select((k % 400).alias("doc_id"), text.alias("text"))).distinct()
    return context.resolve_references(found, context.reference_keys(T.section_tree(docs(spark, sf))))


_HEADS = (("general", "en", "Answer from the context."), ("technical", "en", "Answer as an engineer."), ("general", "ko", "문맥으로 답하세요."))


@twin(f"""WITH {_CASES}, dm AS ({O.SQL['domain_classify']}), tp(domain, lang, head) AS (VALUES {", ".join(str(h) for h in _HEADS)}),
  e AS (SELECT question_id, question || chr(10) || chr(10) || '[Section: ' || title || ' (p.' || page || ')] ' || body AS q, body, coalesce(domain, 'general') AS domain FROM qs JOIN nd USING (doc_id) LEFT JOIN dm USING (doc_id) WHERE po = 1),
  l AS (SELECT *, CASE WHEN regexp_matches(q, '[가-힣]') THEN 'ko' WHEN regexp_matches(q, '[぀-ヿ一-鿿]') THEN 'ja' ELSE 'en' END AS lang FROM e)
  SELECT question_id AS query_id, md5(coalesce(a.head, b.head, '') || chr(10) || chr(10) || 'Context:' || chr(10) || body || chr(10) || chr(10) || 'Question: ' || q) AS digest FROM l LEFT JOIN tp a USING (domain, lang) LEFT JOIN tp b ON b.domain = 'general' AND b.lang = l.lang""")
def question_prompts(spark, sf):
    """Each case's question, enhanced by the first section of its document, in the template of the document's domain and the question's language."""
    nodes, q, _ = cases(spark, sf)
    first = nodes.where("depth = 1 and ord = 0").select("doc_id", "title", "page_ref", "summary")
    told = context.enhanced_question(F.col("question"), F.col("title"), F.col("page_ref"), F.col("summary"))
    rows = q.join(first, "doc_id").join(grounding.domains(R.only(docs(spark, sf), q)).select("doc_id", "domain"), "doc_id", "left")
    rows = rows.select(F.col("question_id").alias("query_id"), told.alias("question"), F.col("summary").alias("context"), F.coalesce("domain", F.lit("general")).alias("domain"))
    return context.prompts(rows, spark.createDataFrame(_HEADS, "domain string, lang string, head string")).select("query_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


def found_chunks(spark, sf):
    n, q, _, hits = routed_hits(spark, sf)
    text = n.select("doc_id", "node_id", "title", F.coalesce("text", "summary").alias("text"), "page_ref")
    found = hits.join(text, ["doc_id", "node_id"]).join(q.select("query_id", F.col("text").alias("query")), "query_id")
    return R.rank_by(found.withColumnRenamed("node_id", "chunk_id"), "score", None, ties=("chunk_id",)).select("query_id", "chunk_id", "query", "title", "text", "page_ref", "rank")


@twin(twins.SQL["query_context"].rpartition("SELECT grp AS query_id")[0].rstrip() + """, b4 AS (SELECT query_id, count(*) AS n_before, sum(length(text) // 3)::BIGINT AS tokens_before FROM hb GROUP BY 1), af AS (SELECT grp AS query_id, count(*) AS n_after, sum(t)::BIGINT AS tokens_after FROM mo JOIN bg USING (grp, i) WHERE taken GROUP BY 1)
  SELECT query_id, n_before, tokens_before, coalesce(n_after, 0) AS n_after, coalesce(tokens_after, 0) AS tokens_after, round(coalesce(n_after, 0) / n_before, 6) AS ratio, greatest(0, tokens_before - coalesce(tokens_after, 0)) AS tokens_saved FROM b4 LEFT JOIN af USING (query_id)""")
def compression_report(spark, sf):
    """What compression of the query path's contexts saves."""
    ranked = kept(found_chunks(spark, sf))
    return context.compression_report(ranked, context.compress(ranked))


@twin(f"""WITH RECURSIVE {twins._HITS}, pt AS (SELECT h.*, (CASE WHEN recovered THEN '[RECOVERED] ' ELSE '' END) || 'Document ' || doc_id || ' > ' || c.title AS path, array_to_string(sec.ww, ' ') AS text, (c.ord + 1)::VARCHAR AS page
    FROM hits h JOIN ch c USING (query_id, doc_id, node_id) JOIN sec ON sec.doc_id = h.doc_id AND sec.ord = c.ord)
  SELECT query_id, doc_id, md5(string_agg('### ' || path || ' (p.' || page || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY score DESC, node_id)) AS digest FROM pt GROUP BY ALL""")
def formatted_hits(spark, sf):
    """Each routed tree's hits as headed paragraphs, whole texts."""
    n, _, _, hits = routed_hits(spark, sf)
    return traverse.format_hits(hits, n, None).select("query_id", "doc_id", F.md5(F.col("block").cast("binary")).alias("digest"))


@twin(f"""WITH {O.D}, {O.SECTIONS}, n AS (SELECT doc_id, 0 AS po, {{'node_id': 'd' || doc_id, 'depth': 0, 'title': 'Document ' || doc_id, 'summary': substring(text, 1, 200), 'page_ref': '1'}} AS s FROM d
    UNION ALL SELECT doc_id, ord + 1, {{'node_id': 'd' || doc_id || '.' || (ord + 1), 'depth': 1, 'title': 'Section ' || (ord + 1), 'summary': substring(array_to_string(ww, ' '), 1, 200), 'page_ref': (ord + 1)::VARCHAR}} FROM sec)
  SELECT doc_id, md5(to_json(list(s ORDER BY po))::VARCHAR) AS digest FROM n GROUP BY doc_id""")
def flat_context(spark, sf):
    """Every document's tree as one JSON list."""
    return traverse.flat_context(T.section_tree(docs(spark, sf))).select("doc_id", F.md5(F.col("context").cast("binary")).alias("digest"))
