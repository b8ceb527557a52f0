"""DuckDB twins of the registered queries. Literals are doubles; scores are rounded as in the engine."""

from __future__ import annotations

from ..operators.context import REFERENCES
from ..operators.grounding import DATE, ENTITY, HAS_NUMBER, LEXICONS


def w(t: str, longer: int = 0) -> str:
    found = f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"
    return f"list_filter({found}, lambda x: length(x) > {longer})" if longer else found


def ws(t: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda x: x <> '')"


D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
A = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
POST = f"dt AS (SELECT doc_id, {w('text', 1)} AS t FROM d), post AS (SELECT doc_id, n AS len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM dt) GROUP BY ALL), corp AS (SELECT count(*) AS nd, avg(len(t)) AS al FROM dt), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
QT = f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({w('text', 1)}) AS term FROM q) GROUP BY ALL)"
IDF = "ln((nd - df + 0.5e0) / (df + 0.5e0) + 1e0)"


def top(body: str, k: int, by: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rank FROM ({body})) WHERE rank <= {k}"


def bm25(tf: str, k: int = 10) -> str:
    part = f"{IDF} * {tf} * 2.5e0 / ({tf} + 1.5e0 * (0.25e0 + 0.75e0 * len / al))"
    return f"SELECT query_id, doc_id, round(sum({part}), 6) AS score FROM post JOIN qt USING (term) JOIN dfs USING (term), corp GROUP BY ALL"


def overlap(tok: str, kind: str = "jaccard", digits: int = 6) -> str:
    score = "c.n / (dn.n + qn.n - c.n)" if kind == "jaccard" else "c.n / qn.n"
    return f"""SELECT c.query_id, c.doc_id, round({score}, {digits}) AS score FROM
      (SELECT query_id, doc_id, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(list_distinct({tok})) AS term FROM d) a JOIN (SELECT query_id, unnest(list_distinct({tok})) AS term FROM q) b USING (term) GROUP BY ALL) c
      JOIN (SELECT doc_id, len(list_distinct({tok})) AS n FROM d) dn USING (doc_id) JOIN (SELECT query_id, len(list_distinct({tok})) AS n FROM q) qn USING (query_id)"""


BASE = f"WITH {D}, {A}, {POST}, {QT}"
CAND = f"SELECT query_id, doc_id, round(sum(qtf * {IDF}), 6) AS score FROM post JOIN qt USING (term) JOIN dfs USING (term), corp GROUP BY ALL"
COLLAPSED = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
CHARS = f"string_split({COLLAPSED}, '')"
GRAMS = f"(CASE WHEN length({COLLAPSED}) = 0 THEN []::VARCHAR[] WHEN length({COLLAPSED}) < 3 THEN [{COLLAPSED}] ELSE list_transform(list_zip({CHARS}[1:-3], {CHARS}[2:-2], {CHARS}[3:]), lambda x: x[1] || x[2] || x[3]) END)"
HYBRID = f"""{BASE}, cand AS ({top(CAND, 20)}), fullb AS ({bm25('1e0')}), jac AS ({overlap(w('text'), digits=12)}),
  mixed AS (SELECT c.query_id, c.doc_id, b.score AS bm25, coalesce(j.score, 0e0) AS jac, c.doc_id % 4 AS depth FROM cand c LEFT JOIN fullb b USING (query_id, doc_id) LEFT JOIN jac j USING (query_id, doc_id)),
  rel AS (SELECT *, CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN coalesce(bm25, 0e0) / max(bm25) OVER (PARTITION BY query_id) ELSE 0e0 END AS rel FROM mixed)"""


def mix(a: str, b: str, c: str) -> str:
    return f"round({a} * rel + {b} * jac + {c} * greatest(pow(0.85e0, depth), 0.1e0), 6) AS score"


GEO = """geo AS (SELECT r_regionkey::BIGINT AS doc_id, 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id, 0 AS depth, r_name AS title, 0::BIGINT AS key FROM region
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, 1, n_name, n_nationkey FROM nation
  UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || c_nationkey, 2, c_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
SECTIONS = f"sw AS (SELECT doc_id, {WORDS} AS wd FROM d), sec AS (SELECT doc_id, i::INT AS ord, list_slice(wd, i * 400 + 1, i * 400 + 400) AS ww FROM (SELECT doc_id, wd, unnest(range(0, (len(wd) + 399) // 400)) AS i FROM sw))"
CHUNKS = "ch AS (SELECT doc_id, i::INT AS ord, substring(text, i * 300 + 1, 300) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 299) // 300)) AS i FROM d))"
STATS = "SELECT doc_id, count(*) AS n_nodes, count(*) FILTER (k IS NULL) AS n_leaves, max(depth) AS max_depth, round(coalesce(avg(k), 0e0), 6) AS branching FROM (SELECT n.*, k.k FROM {0} n LEFT JOIN (SELECT doc_id, parent_id, count(*) AS k FROM {0} WHERE parent_id IS NOT NULL GROUP BY ALL) k ON k.doc_id = n.doc_id AND k.parent_id = n.node_id) GROUP BY doc_id"
SECNODES = "sn AS (SELECT doc_id, 'd' || doc_id AS node_id, NULL::VARCHAR AS parent_id, 0 AS depth FROM d UNION ALL SELECT doc_id, 'd' || doc_id || '.' || (ord + 1), 'd' || doc_id, 1 FROM sec)"
GSCORE = "gs AS (SELECT q.query_id, doc_id, node_id, parent_id, depth, title, round(0.6e0 * 0.5e0 + 0.2e0 * (((key * 7 + q.query_id * 3) % 11) / 10e0) + 0.2e0 * greatest(0.3e0, 1e0 - 0.1e0 * depth), 6) AS score FROM geo, range(3) q(query_id) WHERE depth > 0)"
TRADE = "tr AS (SELECT 'n' || n_nationkey AS src, 'n' || ((n_nationkey + s) % 25) AS dst, edge_type, confidence FROM nation, (VALUES ('temporal', 1, 0.9e0), ('support', 3, 0.8e0), ('cause_effect', 7, 0.7e0)) h(edge_type, s, confidence))"
TURNS = "pr AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"
SCORED = f"sc AS (SELECT doc_id, round(len(list_distinct(wd)) / len(wd), 6) AS confidence, quality = 1 AS correct FROM (SELECT doc_id, {w('text')} AS wd FROM d) JOIN labels USING (doc_id) WHERE len(wd) > 0 AND quality IS NOT NULL)"
GOLD = f"gold AS (SELECT query_id, doc_id FROM ({overlap(w('text'), 'share')}) WHERE score >= 0.8e0)"
RUNS = f"runs AS (SELECT 'bm25' AS system, query_id, doc_id, rank FROM ({top(bm25('1e0'), 20)}) UNION ALL SELECT 'jaccard', query_id, doc_id, rank FROM ({top(overlap(w('text')), 20)}))"
METRICS = """marked AS (SELECT r.*, (g.doc_id IS NOT NULL)::INT AS rel FROM runs r LEFT JOIN gold g USING (query_id, doc_id)),
  ats AS (SELECT *, sum(rel) OVER (PARTITION BY system, query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM marked),
  nrel AS (SELECT query_id, count(*) AS n_rel FROM gold GROUP BY query_id),
  per AS (SELECT system, query_id, k, n_rel, sum(rel) FILTER (rank <= k) AS h, coalesce(sum(1e0 / log2(rank + 1e0)) FILTER (rank <= k AND rel = 1), 0e0) AS d, min(rank) FILTER (rel = 1) AS first, sum(upto / rank) FILTER (rel = 1) AS aps FROM ats JOIN nrel USING (query_id), (VALUES (1), (3), (5), (10), (20)) ks(k) GROUP BY ALL),
  met AS (SELECT system, query_id, k, round(h / k, 6) AS precision, round(h / n_rel, 6) AS recall, round(CASE WHEN h > 0 THEN 2e0 * (h / k) * (h / n_rel) / (h / k + h / n_rel) ELSE 0e0 END, 6) AS f1,
    round(d / list_sum(list_transform(range(1, least(k, n_rel) + 1), lambda i: 1e0 / log2(i + 1e0))), 6) AS ndcg, (h > 0)::INT AS hit, round(coalesce(1e0 / first, 0e0), 6) AS rr, round(coalesce(aps, 0e0) / n_rel, 6) AS ap FROM per)"""
SYSTEMS = "sy AS (SELECT o_orderkey AS key, (o_orderkey % 97)::DOUBLE AS a, ((o_orderkey * 31 + 7) % 89)::DOUBLE AS b FROM orders)"


def phi(x: str) -> str:
    z = f"(abs({x}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + 0.3275911e0 * {z}))"
    poly = f"((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t}"
    return f"(0.5e0 * (1e0 + (1e0 - {poly} * exp(-{z} * {z}))))"


def f1(p: str, r: str) -> str:
    return f"round(CASE WHEN {p} + {r} > 0 THEN 2e0 * {p} * {r} / ({p} + {r}) ELSE 0e0 END, 6)"


_COUNTS = ", ".join("len(list_filter([" + ", ".join(f"'{x}'" for x in ws_) + f"], lambda x: contains(lower(text), x))) AS {k}" for k, ws_ in LEXICONS.items())
_BEST = "greatest(" + ", ".join(LEXICONS) + ")"
_TOTAL = "(" + " + ".join(LEXICONS) + ")"
_NAME = "CASE " + " ".join(f"WHEN {k} = {_BEST} THEN '{k}'" for k in LEXICONS) + " END"
CLAIMS = "regexp_split_to_array(answer, '[.!?]\\s+|[。！？]')"
TERMS = "['the', 'and', 'license', 'version', 'der', 'que']"
KW = "['the', 'and', 'license', 'version']"
KEYWORDS = "list_filter(['the', 'of', 'and', 'license', 'version'], lambda x: length(x) > 2)"

SQL: dict[str, str] = {
    "bm25_topk": f"{BASE} {top(bm25('1e0'), 10)}",
    "bm25_raw_tf": f"{BASE} {top(bm25('tf'), 10)}",
    "okapi_topk": f"{BASE}, raw AS (SELECT term, ln(nd - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM dfs, corp), ix AS (SELECT term, CASE WHEN idf < 0 THEN 0.25e0 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw) "
    + top("SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / al))), 6) AS score FROM post JOIN qt USING (term) JOIN ix USING (term), corp GROUP BY ALL", 10),
    "bm25_candidates": f"{BASE} {top(CAND, 20)}",
    "jaccard_topk": f"WITH {D}, {A} {top(overlap(w('text')), 10)}",
    "router_lexical": f"WITH {D}, {A} {top(overlap(w('text'), 'share'), 3)}",
    "trigram_topk": f"WITH {D}, {A} {top(overlap(GRAMS), 5)}",
    "hash_embed_topk": f"""WITH {D}, {A},
      dv AS (SELECT doc_id, slot, count(*)::DOUBLE AS n FROM (SELECT doc_id, right(md5(unnest(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+|[一-鿿]'))), 2) AS slot FROM d) GROUP BY ALL),
      qv AS (SELECT query_id, slot, count(*)::DOUBLE AS n FROM (SELECT query_id, right(md5(unnest(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+|[一-鿿]'))), 2) AS slot FROM q) GROUP BY ALL),
      ds AS (SELECT doc_id, sqrt(sum(n * n)) AS s FROM dv GROUP BY 1), qs AS (SELECT query_id, sqrt(sum(n * n)) AS s FROM qv GROUP BY 1)
      {top("SELECT query_id, doc_id, round(sum((dv.n / ds.s) * (qv.n / qs.s)), 6) AS score FROM dv JOIN ds USING (doc_id) JOIN qv USING (slot) JOIN qs USING (query_id) GROUP BY ALL", 5)}""",
    "hybrid_topk": f"{HYBRID} {top('SELECT query_id, doc_id, ' + mix('0.6e0', '0.25e0', '0.15e0') + ' FROM rel', 3)}",
    "hybrid_weight_sweep": f"{HYBRID} {top('SELECT config, query_id, doc_id, ' + mix('wb', 'wj', 'wd') + ' FROM rel, (VALUES (0, 0.6e0, 0.25e0, 0.15e0), (1, 1e0, 0e0, 0e0), (2, 0e0, 1e0, 0e0), (3, 0e0, 0e0, 1e0), (4, 0.5e0, 0.5e0, 0e0), (5, 0.7e0, 0.2e0, 0.1e0), (6, 0.34e0, 0.33e0, 0.33e0)) g(config, wb, wj, wd)', 5, 'config, query_id')}",
    "vector_cosine_topk": "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) "
    + top("SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0", 10),
    "vector_label_precision": "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), t AS ("
    + top("SELECT a.vec_id AS query_id, b.vec_id AS doc_id, (a.label = b.label)::INT AS same, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0", 10)
    + ") SELECT query_id, round(avg(same), 6) AS precision FROM t GROUP BY 1",
    "token_f1_pairs": f"""WITH {TURNS}, x AS (SELECT answer_id, t, count(*) AS n FROM (SELECT answer_id, unnest({w('question')}) AS t FROM pr) GROUP BY ALL), y AS (SELECT answer_id, t, count(*) AS n FROM (SELECT answer_id, unnest({w('answer')}) AS t FROM pr) GROUP BY ALL),
      c AS (SELECT answer_id, sum(least(x.n, y.n)) AS n FROM x JOIN y USING (answer_id, t) GROUP BY 1),
      pq AS (SELECT answer_id, CASE WHEN len({w('answer')}) > 0 THEN coalesce(n, 0) / len({w('answer')}) ELSE 0e0 END AS p, CASE WHEN len({w('question')}) > 0 THEN coalesce(n, 0) / len({w('question')}) ELSE 0e0 END AS r FROM pr LEFT JOIN c USING (answer_id))
      SELECT answer_id, round(p, 6) AS precision, round(r, 6) AS recall, {f1('p', 'r')} AS f1 FROM pq""",
    "keyword_traversal": f"""WITH d0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {SECTIONS.replace('FROM d)', 'FROM d0)')}, {A},
      nodes AS (SELECT 'd' || doc_id AS node_id, 0 AS depth, 'Document ' || doc_id || ' ' || substring(text, 1, 200) AS text FROM d0 UNION ALL SELECT 'd' || doc_id || '.' || (ord + 1), 1, 'Section ' || (ord + 1) || ' ' || substring(array_to_string(ww, ' '), 1, 200) FROM sec),
      nt AS (SELECT node_id, depth, regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+|[一-鿿]') AS t FROM nodes), qt AS (SELECT query_id, regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+|[一-鿿]') AS t FROM q),
      x AS (SELECT node_id, depth, nd, t, count(*) AS x FROM (SELECT node_id, depth, len(t) AS nd, unnest(t) AS t FROM nt) GROUP BY ALL), y AS (SELECT query_id, nq, t, count(*) AS y FROM (SELECT query_id, len(t) AS nq, unnest(t) AS t FROM qt) GROUP BY ALL),
      f AS (SELECT query_id, node_id, round(2e0 * sum(least(x, y)) / (nd + nq) * pow(0.9e0, depth), 6) AS f1 FROM x JOIN y USING (t) GROUP BY query_id, node_id, nd, nq, depth)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f1 DESC, node_id) AS rank FROM f) WHERE rank <= 3""",
    "formal_relevance": f"""WITH {GEO}, n AS (SELECT g.node_id, g.depth, list_distinct({w("'the AFRICA nation of egypt'")}) AS q, list_distinct({w("g.title || ' ' || g.title")}) AS n, list_distinct({w('g.title')}) AS t, CASE WHEN p.title IS NULL THEN NULL ELSE list_distinct({w('p.title')}) END AS p FROM geo g LEFT JOIN geo p ON p.node_id = g.parent_id),
      s AS (SELECT node_id, least(1e0, len(list_intersect(q, n)) / len(q) + CASE WHEN len(list_intersect(q, t)) > 0 THEN 0.2e0 ELSE 0e0 END) AS sem, CASE WHEN depth >= 10 THEN 0e0 ELSE pow(0.9e0, depth) END AS struct, CASE WHEN p IS NULL THEN 1e0 WHEN len(p) = 0 OR len(t) = 0 THEN 0.5e0 ELSE greatest(0.3e0, len(list_intersect(t, p)) / len(p)) END AS ctx FROM n)
      SELECT node_id, round(sem, 6) AS sem, round(struct, 6) AS struct, round(ctx, 6) AS ctx, round(least(1e0, greatest(0e0, 0.7e0 * sem + 0.2e0 * struct + 0.1e0 * ctx)), 6) AS relevance FROM s""",
    "chunk_300": f"WITH {D}, {CHUNKS} SELECT doc_id, ord, 'doc_' || doc_id || '_chunk_' || ord AS chunk_id, length(text) AS n, md5(text) AS digest FROM ch",
    "chunk_400_words": f"WITH {D}, {SECTIONS} SELECT doc_id, ord, len(ww) AS n_words, md5(array_to_string(ww, ' ')) AS digest FROM sec",
    "cluster_round_robin": f"WITH {D}, {CHUNKS}, k AS (SELECT *, ceil(count(*) OVER (PARTITION BY doc_id) / 3)::INT AS k FROM ch) SELECT doc_id, (ord % k)::INT AS cluster, count(*) AS n_members, md5(string_agg(substring(text, 1, 80), ' ' ORDER BY ord)) AS digest FROM k GROUP BY doc_id, ord % k",
    "tree_flatten_geo": f"WITH {GEO} SELECT * FROM geo",
    "tree_paths_geo": f"WITH RECURSIVE {GEO}, t AS (SELECT doc_id, node_id, depth, title AS path FROM geo WHERE depth = 0 UNION ALL SELECT g.doc_id, g.node_id, g.depth, t.path || ' > ' || g.title FROM t JOIN geo g ON g.parent_id = t.node_id) SELECT * FROM t",
    "tree_stats": f"WITH {GEO} {STATS.format('geo')}",
    "section_tree_stats": f"WITH {D}, {SECTIONS}, {SECNODES} {STATS.format('sn')}",
    "sibling_groups": f"WITH {GEO} SELECT doc_id, parent_id, count(*) AS n_children FROM geo WHERE parent_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    "sibling_pairs_range": f"WITH {GEO}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY key, node_id) AS i FROM geo WHERE parent_id IS NOT NULL) SELECT a.doc_id, a.node_id AS src, b.node_id AS dst, (b.i - a.i)::INT AS gap FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.parent_id = b.parent_id AND b.i - a.i BETWEEN 1 AND 2",
    "hierarchy_edges": f"WITH {GEO} SELECT doc_id, parent_id AS src, node_id AS dst, 'parent_child' AS edge_type, 1e0 AS confidence FROM geo WHERE parent_id IS NOT NULL",
    "page_headings": "WITH h AS (SELECT page_id, unnest(x) AS h, unnest(range(0, len(x)))::INT AS ord FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS x FROM pages)) SELECT page_id, ord, regexp_extract(h, '(?i)^<h([1-6])', 1)::INT AS level, trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM h",
    "page_buckets": f"WITH {D}, {SECTIONS}, m AS (SELECT d.doc_id, greatest(1, coalesce(max(ord) + 1, 1)) AS pages FROM d LEFT JOIN sec USING (doc_id) GROUP BY 1) SELECT doc_id, pages, CASE WHEN pages < 50 THEN '<50' WHEN pages <= 100 THEN '50-100' ELSE '>100' END AS bucket FROM m",
    "beam_search_geo": f"""WITH {GEO}, {GSCORE}, kids AS (SELECT DISTINCT parent_id AS node_id FROM geo WHERE parent_id IS NOT NULL),
      f0 AS (SELECT q.query_id, doc_id, node_id, 1e0 AS score, title AS path FROM geo, range(3) q(query_id) WHERE depth = 0),
      f1 AS (SELECT * FROM (SELECT g.query_id, g.doc_id, g.node_id, round(f.score * g.score, 6) AS score, f.path || ' > ' || g.title AS path, row_number() OVER (PARTITION BY g.query_id, g.doc_id ORDER BY round(f.score * g.score, 6) DESC, g.node_id) AS rank FROM f0 f JOIN gs g ON g.query_id = f.query_id AND g.parent_id = f.node_id) WHERE rank <= 5),
      f2 AS (SELECT * FROM (SELECT g.query_id, g.doc_id, g.node_id, round(f.score * g.score, 6) AS score, f.path || ' > ' || g.title AS path, row_number() OVER (PARTITION BY g.query_id, g.doc_id ORDER BY round(f.score * g.score, 6) DESC, g.node_id) AS rank FROM f1 f JOIN gs g ON g.query_id = f.query_id AND g.parent_id = f.node_id) WHERE rank <= 5)
      SELECT query_id, doc_id, node_id, 0 AS depth, score, path FROM f0 WHERE node_id NOT IN (SELECT node_id FROM kids) AND score >= 0.2e0 UNION ALL SELECT query_id, doc_id, node_id, 1, score, path FROM f1 WHERE node_id NOT IN (SELECT node_id FROM kids) AND score >= 0.2e0 UNION ALL SELECT query_id, doc_id, node_id, 2, score, path FROM f2 WHERE score >= 0.2e0""",
    "policy_choice": f"WITH {GEO}, {GSCORE}, s AS (SELECT query_id, doc_id, list_reverse_sort(list(score)) AS s FROM gs WHERE depth = 1 GROUP BY ALL) SELECT query_id, doc_id, CASE WHEN len(s) < 2 OR s[1] - s[2] >= 0.15e0 THEN 'dfs' ELSE 'beam' END AS algorithm FROM s",
    "dual_stage_filter": f"""WITH {D}, k AS (SELECT doc_id, {KEYWORDS} AS k, 'document ' || doc_id AS a, lower(text) AS b FROM d),
      s AS (SELECT doc_id, round(0.4e0 * (len(list_filter(k, lambda x: contains(a, x))) / len(k)) + 0.6e0 * (len(list_filter(k, lambda x: contains(b, x))) / len(k)), 6) AS kw FROM k), r AS (SELECT *, 0.7e0 * 0.5e0 + 0.3e0 * kw AS sc FROM s)
      SELECT doc_id, sc > 0.45e0 AS relevant, round(sc, 6) AS score, round(0.3e0 * CASE WHEN kw > 0.5e0 THEN 1e0 ELSE 0.3e0 END, 6) AS confidence, CASE WHEN sc > 0.45e0 AND kw >= 0.5e0 THEN 'both agree' WHEN sc > 0.45e0 AND 0.5e0 >= kw THEN 'semantic' WHEN sc > 0.45e0 THEN 'keyword' ELSE 'below threshold' END AS reason FROM r""",
    "adaptive_threshold": """WITH e AS (SELECT event_id, user_id % 20 AS s, event_id % 80 + 20 AS t, event_id % 130 AS n, event_id % 6 AS d FROM events), f AS (SELECT *, 1e0 - s / t AS fr FROM e)
      SELECT event_id, round(0.6e0 + CASE WHEN fr > 0.9e0 THEN -0.15e0 WHEN fr > 0.7e0 THEN -0.10e0 WHEN fr < 0.3e0 THEN 0.10e0 ELSE 0e0 END + CASE WHEN n < 10 THEN 0.10e0 WHEN n > 100 THEN -0.05e0 ELSE 0e0 END + CASE WHEN d <= 1 THEN -0.05e0 WHEN d >= 4 THEN 0.05e0 ELSE 0e0 END, 6) AS tau FROM f""",
    "detect_references": "WITH d AS (SELECT o_orderkey AS doc_id, 'As Section ' || o_orderkey % 9 || '.' || o_custkey % 7 || ' shows, see Table ' || o_orderkey % 13 || '-' || o_custkey % 5 || ' and fig. ' || o_custkey % 11 || ' in chapter ' || o_orderkey % 17 || ', page ' || o_custkey % 89 || '; 제 3 장, 표 ' || o_orderkey % 6 || '.' AS text FROM orders), r AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k.removesuffix('_ko')}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS number FROM d" for k, p in REFERENCES.items())
    + ") SELECT doc_id, kind, number, count(*) AS n FROM r GROUP BY ALL",
    "graph_paths_3hop": f"""WITH {TRADE}, s AS (SELECT DISTINCT src AS seed FROM tr), p1 AS (SELECT seed, seed || '>' || dst AS path, [seed, dst] AS nodes, [edge_type] AS ty, round(confidence, 9) AS c, dst AS last FROM s JOIN tr ON src = seed),
      b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, last ORDER BY c DESC, nodes, ty) AS n FROM p1) WHERE n = 1),
      p2 AS (SELECT seed, path || '>' || dst AS path, list_append(nodes, dst) AS nodes, list_append(ty, edge_type) AS ty, round(c * confidence, 9) AS c, dst AS last FROM b1 JOIN tr ON src = last WHERE NOT list_contains(nodes, dst)),
      b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, last ORDER BY c DESC, nodes, ty) AS n FROM p2 WHERE c >= 0.5e0) WHERE n = 1),
      p3 AS (SELECT seed, path || '>' || dst AS path, list_append(nodes, dst) AS nodes, list_append(ty, edge_type) AS ty, round(c * confidence, 9) AS c, dst AS last FROM b2 JOIN tr ON src = last WHERE NOT list_contains(nodes, dst)),
      b3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, last ORDER BY c DESC, nodes, ty) AS n FROM p3 WHERE c >= 0.5e0) WHERE n = 1)
      SELECT seed, path, round(c, 6) AS confidence, 2 AS n_nodes FROM b1 UNION ALL SELECT seed, path, round(c, 6), 3 FROM b2 UNION ALL SELECT seed, path, round(c, 6), 4 FROM b3""",
    "graph_shortest_path": f"WITH RECURSIVE {TRADE}, r(a, b, n_hops) AS (SELECT DISTINCT src, src, 0 FROM tr UNION SELECT r.a, tr.dst, r.n_hops + 1 FROM r JOIN tr ON tr.src = r.b WHERE r.n_hops < 6) SELECT a, b, min(n_hops)::INT AS n_hops FROM r GROUP BY ALL",
    "graph_edge_counts": f"WITH {TRADE} SELECT edge_type, count(*) AS n_edges FROM tr GROUP BY 1",
    "graph_neighbourhood": f"WITH {TRADE}, o AS (SELECT src AS node, count(*) AS n_out, array_to_string(list_sort(list(DISTINCT dst)), ',') AS out_nodes FROM tr GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n_in, array_to_string(list_sort(list(DISTINCT src)), ',') AS in_nodes FROM tr GROUP BY 1) SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(out_nodes, '') AS out_nodes, coalesce(in_nodes, '') AS in_nodes FROM o FULL JOIN i USING (node)",
    "calibration_bins": f"WITH {D}, {SCORED}, b AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct::INT::DOUBLE), 6) AS accuracy FROM sc GROUP BY 1) SELECT *, round(abs(confidence - accuracy), 6) AS gap FROM b",
    "calibration_summary": f"WITH {D}, {SCORED}, b AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, sum(confidence) AS c, sum(correct::INT::DOUBLE) AS a, sum(pow(confidence - correct::INT::DOUBLE, 2)) AS sq FROM sc GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(a) / sum(n), 6) AS accuracy, round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(c - a)) / sum(n), 6) AS ece, round(max(abs(c - a) / n), 6) AS mce FROM b",
    "temperature_grid": f"""WITH {D}, {SCORED}, z AS (SELECT ln(c / (1e0 - c)) AS z, correct::INT::DOUBLE AS y FROM (SELECT least(0.999e0, greatest(0.001e0, confidence)) AS c, correct FROM sc)), p AS (SELECT t / 10e0 AS t, y, least(0.999999e0, greatest(0.000001e0, 1e0 / (1e0 + exp(-z / (t / 10e0))))) AS p FROM z, range(1, 51) g(t))
      SELECT t, round(-avg(y * ln(p) + (1e0 - y) * ln(1e0 - p)), 9) AS nll FROM p GROUP BY t ORDER BY nll, t LIMIT 1""",
    "domain_classify": f"WITH {D}, c AS (SELECT doc_id, {_COUNTS} FROM d), s AS (SELECT doc_id, {_NAME} AS name, {_TOTAL} AS total, CASE WHEN {_TOTAL} > 0 THEN {_BEST} / {_TOTAL} ELSE 0e0 END AS share FROM c) SELECT doc_id, CASE WHEN share < 0.3e0 THEN 'general' ELSE name END AS domain, round(CASE WHEN total = 0 THEN 0.5e0 WHEN share < 0.3e0 THEN share ELSE least(1e0, share + 0.3e0) END, 6) AS confidence FROM s",
    "language_detect": f"WITH {D} SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[぀-ヿ一-鿿]') THEN 'ja' ELSE 'en' END AS script FROM d",
    "section_citation_f1": f"""WITH f AS (SELECT DISTINCT o_custkey % 97 AS key, (o_orderkey % 5) || '.' || (o_orderkey % 7) || '.' || (o_orderkey % 3) AS f FROM orders), e AS (SELECT DISTINCT o_custkey % 97 AS key, (o_orderkey % 11) || '.' || (o_orderkey % 4) AS e FROM orders),
      p AS (SELECT key, f, e FROM f JOIN e USING (key) WHERE f = e OR starts_with(f, e || '.') OR starts_with(e, f || '.')), r AS (SELECT key, count(DISTINCT f) AS fr, count(DISTINCT e) AS er FROM p GROUP BY 1),
      j AS (SELECT ne.key, coalesce(fr / nf, 0e0) AS p, coalesce(er / ne, 0e0) AS r FROM (SELECT key, count(*) AS ne FROM e GROUP BY 1) ne LEFT JOIN (SELECT key, count(*) AS nf FROM f GROUP BY 1) nf USING (key) LEFT JOIN r USING (key)) SELECT key, round(p, 6) AS precision, round(r, 6) AS recall, {f1('p', 'r')} AS f1 FROM j""",
    "citation_accuracy": f"""WITH c AS (SELECT DISTINCT o_custkey % 97 AS key, o_orderkey % 41 AS c FROM orders WHERE o_orderstatus = 'O'), g AS (SELECT DISTINCT o_custkey % 97 AS key, o_orderkey % 41 AS c FROM orders WHERE o_orderstatus = 'F'),
      j AS (SELECT g.key, CASE WHEN n > 0 THEN coalesce(h, 0) / n ELSE 0e0 END AS p, coalesce(h, 0) / g AS r FROM (SELECT key, count(*) AS g FROM g GROUP BY 1) g LEFT JOIN (SELECT key, count(*) AS n FROM c GROUP BY 1) c USING (key) LEFT JOIN (SELECT key, count(*) AS h FROM c JOIN g USING (key, c) GROUP BY 1) h USING (key)) SELECT key, round(p, 6) AS precision, round(r, 6) AS recall, {f1('p', 'r')} AS f1 FROM j""",
    "faithfulness": f"""WITH {TURNS}, s AS (SELECT answer_id, question, list_filter(list_transform(string_split(answer, '.'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM pr), u AS (SELECT answer_id, question, unnest(ss) AS s FROM s), b AS (SELECT answer_id, list_distinct({ws('s')}) AS a, list_distinct({ws('question')}) AS c FROM u),
      e AS (SELECT answer_id, avg(x) AS m, count(*) FILTER (x < 0.5e0) AS k FROM (SELECT answer_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, c)) / len(a) ELSE 0e0 END AS x FROM b) GROUP BY 1)
      SELECT answer_id, round(coalesce(m, 1e0), 6) AS faithfulness, round(coalesce(m, 1e0), 6) >= 0.5e0 AS faithful, coalesce(k, 0) AS n_low FROM pr LEFT JOIN e USING (answer_id)""",
    "ir_metrics": f"{BASE}, {GOLD}, {RUNS}, {METRICS} SELECT * FROM met",
    "ir_macro": f"{BASE}, {GOLD}, {RUNS}, {METRICS.replace(', 6)', ', 12)')} SELECT system, k, count(*) AS n_queries, round(avg(hit), 6) AS hit_rate, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr, round(avg(ap), 6) AS ap FROM met GROUP BY ALL",
    "ndcg_graded": f"""{BASE}, rel AS (SELECT query_id, doc_id, floor(score * 5) AS g FROM ({overlap(w('text'), 'share')}) WHERE score >= 0.4e0), run AS ({top(bm25('1e0'), 10)}),
      got AS (SELECT query_id, sum((pow(2e0, g) - 1e0) / log2(rank + 1e0)) AS d FROM run JOIN rel USING (query_id, doc_id) WHERE rank <= 5 GROUP BY 1), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, doc_id) AS r FROM rel), i AS (SELECT query_id, sum((pow(2e0, g) - 1e0) / log2(r + 1e0)) AS i FROM best WHERE r <= 5 GROUP BY 1)
      SELECT query_id, round(CASE WHEN i > 0 THEN coalesce(d, 0e0) / i ELSE 0e0 END, 6) AS ndcg FROM i LEFT JOIN got USING (query_id)""",
    "exact_match_pairs": f"WITH {TURNS} SELECT answer_id, (trim(regexp_replace(regexp_replace(lower(question), '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '\\s+', ' ', 'g')) = trim(regexp_replace(regexp_replace(lower(answer), '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '\\s+', ' ', 'g')))::INT AS exact FROM pr",
    "term_recall_pairs": f"WITH {TURNS}, h AS (SELECT answer_id, list_filter({TERMS}, lambda x: contains(lower(question), x)) AS a, list_filter({TERMS}, lambda x: contains(lower(answer), x)) AS b FROM pr) SELECT answer_id, len(a)::INT AS n_terms, round(CASE WHEN len(a) = 0 THEN 1e0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS recall FROM h",
    "answer_identity_audit": f"WITH {TURNS}, s AS (SELECT count(*) AS n, round(avg((answer = question)::INT::DOUBLE), 6) AS same, round(avg((substring(answer, 1, 80) = substring(question, 1, 80))::INT::DOUBLE), 6) AS same_prefix FROM pr) SELECT *, CASE WHEN same_prefix < 0.1e0 THEN 'independent' WHEN same_prefix < 0.25e0 THEN 'suspicious' ELSE 'contaminated' END AS verdict FROM s",
    "latency_stats": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(coalesce(stddev_samp(value), 0e0), 6) AS stdev, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "latency_nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value AS nearest FROM r WHERE r = least(floor(n * 0.95e0), n - 1)",
    "running_average_50": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS avg_all, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 49 PRECEDING), 9) AS avg_last FROM events",
    "llm_cost_by_stage": "SELECT event_type, count(*) AS n_calls, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS prompt_tokens, sum(event_id % 50)::BIGINT AS completion_tokens, round(avg(value), 6) AS latency_s FROM events GROUP BY 1",
    "krippendorff_alpha": "WITH p AS (SELECT l_orderkey AS u, count(*) AS m, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1 HAVING count(*) >= 2), t AS (SELECT sum(m)::DOUBLE AS n, sum(s) AS s, sum(q) AS q, sum(2e0 * (m * q - s * s) / (m - 1)) AS within FROM p) SELECT n::BIGINT AS n_ratings, round(1e0 - within / n / (2e0 * (n * q - s * s) / (n * (n - 1))), 6) AS alpha FROM t",
    "cohen_kappa": "WITH t AS (SELECT count(*) AS n, avg((quality = toxic)::INT::DOUBLE) AS po, avg(quality::DOUBLE) AS pa, avg(toxic::DOUBLE) AS pb FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM t) SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1e0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e",
    "spearman_rho": "WITH r AS (SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS a, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS b FROM part) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r",
    "stratified_sample": "SELECT * FROM (SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS turn FROM customer) ORDER BY turn, c_mktsegment, c_nationkey, c_custkey LIMIT 100",
    "paired_ttest": f"""WITH {SYSTEMS}, t AS (SELECT count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM sy), u AS (SELECT *, m / (sd / sqrt(n::DOUBLE)) AS t, abs(m) / sqrt((sa * sa + sb * sb) / 2e0) AS d FROM t)
      SELECT n, round(m, 6) AS mean_diff, round(t, 6) AS t, round(2e0 * (1e0 - {phi('t')}), 6) AS p, round(d, 6) AS d, CASE WHEN abs(d) < 0.2e0 THEN 'negligible' WHEN abs(d) < 0.5e0 THEN 'small' WHEN abs(d) < 0.8e0 THEN 'medium' ELSE 'large' END AS effect, round(m / sd, 6) AS d_z FROM u""",
    "wilcoxon_signed_rank": f"""WITH {SYSTEMS}, r AS (SELECT a - b AS d, row_number() OVER (ORDER BY round(abs(a - b), 9), key) AS r FROM sy WHERE a - b <> 0), t AS (SELECT count(*)::DOUBLE AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w FROM r), u AS (SELECT *, (w - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0) AS z FROM t)
      SELECT n::BIGINT AS n, w, round(z, 6) AS z, round(2e0 * (1e0 - {phi('z')}), 6) AS p, round(abs(z) / sqrt(n), 6) AS r FROM u""",
    "p_value_corrections": """WITH t AS (SELECT n_nationkey, round(((n_nationkey * 7) % 25 + 1) / 400e0, 6) AS p FROM nation), r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, n_nationkey) AS r FROM t), x AS (SELECT *, p * n / r AS raw FROM r)
      SELECT n_nationkey, p, round(least(1e0, p * n), 6) AS bonferroni, round(least(1e0, max(raw) OVER (ORDER BY p, n_nationkey ROWS UNBOUNDED PRECEDING)), 6) AS bh_forward, round(least(1e0, min(raw) OVER (ORDER BY p, n_nationkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh_standard, p * n < 0.05e0 AS significant FROM x""",
    "offline_qa": f"""WITH {D}, {SECTIONS}, s AS (SELECT doc_id, 'd' || doc_id || '.' || (ord + 1) AS id, 'Section ' || (ord + 1) AS t, ord + 1 AS i FROM sec), n AS (SELECT *, lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(id) OVER w AS i1, lead(id, 2) OVER w AS i2 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i))
      SELECT doc_id, 'factual' AS category, i, 'What does ' || t || ' say?' AS question, id AS expected FROM n WHERE i <= 5 UNION ALL SELECT doc_id, 'multi_hop', i, 'How does ' || t || ' lead to ' || t1 || '?', id || ',' || i1 FROM n WHERE i <= 3 AND t1 IS NOT NULL UNION ALL SELECT doc_id, 'comparative', i, 'How do ' || t || ' and ' || t2 || ' differ?', id || ',' || i2 FROM n WHERE i <= 2 AND t2 IS NOT NULL""",
    "qa_validation": """WITH b AS (SELECT conv_id * 37 AS doc_id, CASE WHEN conv_id % 7 = 0 THEN ' ' ELSE text END AS question FROM conversations), c AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE doc_id % 5 = 0)
      SELECT doc_id, 'repeated question' AS problem, count(*) AS n FROM (SELECT doc_id, question FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
      UNION ALL SELECT doc_id, 'unknown document', count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 1 UNION ALL SELECT doc_id, 'no question', count(*) FROM c WHERE coalesce(trim(question), '') = '' GROUP BY 1""",
    "conversation_pairs": f"WITH {TURNS} SELECT conv_id, turn, length(question) AS n_question, length(answer) AS n_answer FROM pr",
    "claims_by_type": f"""WITH {TURNS}, c AS (SELECT unnest(list_filter(list_transform({CLAIMS}, lambda x: trim(x)), lambda x: length(x) >= 10)) AS claim FROM pr)
      SELECT CASE WHEN regexp_matches(claim, '{HAS_NUMBER}') THEN 'number' WHEN regexp_matches(claim, '{DATE}') THEN 'temporal' WHEN regexp_matches(claim, '{ENTITY}') THEN 'entity' ELSE 'fact' END AS kind, count(*) AS n_claims FROM c GROUP BY 1""",
}
