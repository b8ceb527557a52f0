"""DuckDB twins of the traversal, compression and grounding queries, whose running counts and greedy choices are recursive tables."""

from __future__ import annotations

from ..functions.text import QUESTION_WORDS, STOPWORDS
from ..operators import grounding as H
from ..operators.grounding import CITATION
from . import oracle as O

Q_STOP = ", ".join(f"'{w}'" for w in QUESTION_WORDS)
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tau(base: str, selected: str, visited: str, size: str, depth: str) -> str:
    """The adaptive threshold."""
    fr = f"(CASE WHEN {visited} = 0 THEN 0e0 ELSE 1e0 - {selected} / {visited} END)"
    rate = f"CASE WHEN {fr} > 0.9e0 THEN -0.15e0 WHEN {fr} > 0.7e0 THEN -0.1e0 WHEN {fr} < 0.3e0 THEN 0.1e0 ELSE 0e0 END"
    long = f"CASE WHEN {size} < 10 THEN 0.1e0 WHEN {size} > 100 THEN -0.05e0 ELSE 0e0 END"
    deep = f"CASE WHEN {depth} <= 1 THEN -0.05e0 WHEN {depth} >= 4 THEN 0.05e0 ELSE 0e0 END"
    return f"({base} + {rate} + {long} + {deep})"


#: Routed section trees: the sections of the three best documents of each passage, with beam scores and gates.
ROUTED = f"""{O.D}, {O.A}, rt AS ({O.top(O.overlap(O.w('text'), 'share'), 3)}),
  {O.SECTIONS}, st AS (SELECT doc_id, ord, 'Section ' || (ord + 1) AS title, substring(array_to_string(ww, ' '), 1, 200) AS summary FROM sec),
  pairs AS (SELECT query_id, doc_id, q.text AS query, length(q.text) AS size, list_distinct(list_filter({O.ws('q.text')}, lambda x: x NOT IN ({Q_STOP}))) AS terms, {O.w('q.text', 2)} AS keys, list_distinct({O.w('q.text', 3)}) AS critical FROM rt JOIN q USING (query_id)),
  ch AS (SELECT p.*, ord, 'd' || doc_id || '.' || (ord + 1) AS node_id, title, summary,
    1e0 * (0.6e0 * 0.5e0 + 0.2e0 * CASE WHEN len(terms) = 0 THEN 0.5e0 ELSE len(list_filter(terms, lambda x: contains(lower(title || ' ' || summary), x))) / len(terms) END + 0.2e0 * greatest(0.3e0, 1e0 - 0.1e0 * 1)) AS score,
    0.7e0 * 0.5e0 + 0.3e0 * CASE WHEN len(keys) = 0 THEN 0.3e0 ELSE 0.4e0 * (len(list_filter(keys, lambda x: contains(lower(title), x))) / len(keys)) + 0.6e0 * (len(list_filter(keys, lambda x: contains(lower(summary), x))) / len(keys)) END AS gate,
    len(list_filter(critical, lambda x: contains(lower(title), x))) AS hits FROM pairs p JOIN st USING (doc_id))"""

BEAM_WALK = f"""bf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, ord, node_id) AS pos FROM ch) WHERE pos <= 5),
  bn AS (SELECT query_id, doc_id, size, max(pos) AS n FROM bf GROUP BY ALL),
  bw AS (SELECT query_id, doc_id, 0::BIGINT AS i, 0 AS sel, 1 AS vis, []::BIGINT[] AS took FROM bn
    UNION ALL SELECT query_id, doc_id, i + 1, sel + take, v, CASE WHEN take = 1 THEN list_append(took, pos) ELSE took END FROM (
      SELECT bw.query_id, bw.doc_id, bw.i, sel, bf.pos, took, vis + (bw.i < n)::INT AS v,
        (NOT list_contains(took, bf.pos) AND bf.score >= {tau('0.2e0', 'sel', '(vis + (bw.i < n)::INT)', 'bn.size', '1')})::INT AS take
      FROM bw JOIN bn USING (query_id, doc_id) JOIN bf ON bf.query_id = bw.query_id AND bf.doc_id = bw.doc_id AND bf.pos = bw.i % n + 1 WHERE bw.i < 2 * n)),
  beam AS (SELECT query_id, doc_id, node_id, 1 AS depth, score, false AS recovered FROM bw JOIN bn USING (query_id, doc_id) JOIN bf USING (query_id, doc_id) WHERE bw.i = 2 * n AND list_contains(took, pos))"""

DFS_WALK = f"""dn AS (SELECT query_id, doc_id, size, least(3, count(*)) AS n FROM ch GROUP BY query_id, doc_id, size),
  dw AS (SELECT query_id, doc_id, 0::BIGINT AS i, 0 AS sel, 0 AS m, []::BIGINT[] AS took, []::BIGINT[] AS back FROM dn
    UNION ALL SELECT query_id, doc_id, i + 1, sel + good, m + 1 - good, CASE WHEN good = 1 THEN list_append(took, i) ELSE took END, CASE WHEN good = 0 AND known THEN list_append(back, i) ELSE back END FROM (
      SELECT dw.*, (NOT (length(summary) < 20 AND length(title) < 10) AND gate > {tau('0.5e0', 'sel', '(dw.i + 2)', 'dn.size', '1')})::INT AS good, hits >= 2 OR (hits >= 1 AND len({O.ws('title')}) >= 3) AS known
      FROM dw JOIN dn USING (query_id, doc_id) JOIN ch ON ch.query_id = dw.query_id AND ch.doc_id = dw.doc_id AND ch.ord = dw.i WHERE dw.i < n)),
  de AS (SELECT dw.*, (sel = 0 AND m >= 1) OR (sel < 2 AND m > 2 * sel) AS few FROM dw JOIN dn USING (query_id, doc_id) WHERE i = n),
  dfs AS (SELECT query_id, doc_id, node_id, 1 AS depth, gate AS score, false AS recovered FROM de JOIN ch USING (query_id, doc_id) WHERE list_contains(took, ord)
    UNION ALL SELECT query_id, doc_id, node_id, 1, gate, true FROM de JOIN ch USING (query_id, doc_id) WHERE few AND list_contains(back[1:3], ord))"""

_OUT = "SELECT query_id, doc_id, node_id, depth, round(score, 6) AS score, recovered FROM"

#: The algorithm of each routed pair by the token F1 of its sections.
CHOICE = """fx AS (SELECT query_id, doc_id, node_id, regexp_extract_all(lower(title || ' ' || summary), '[0-9A-Za-z가-힣]+|[一-鿿]') AS t, regexp_extract_all(lower(query), '[0-9A-Za-z가-힣]+|[一-鿿]') AS u FROM ch),
  fa AS (SELECT query_id, doc_id, node_id, len(t) + len(u) AS n, unnest(t) AS t FROM fx), fb AS (SELECT query_id, doc_id, node_id, unnest(u) AS t FROM fx),
  fc AS (SELECT query_id, doc_id, node_id, n, sum(least(x, y)) AS k FROM (SELECT query_id, doc_id, node_id, n, t, count(*) AS x FROM fa GROUP BY ALL) JOIN (SELECT query_id, doc_id, node_id, t, count(*) AS y FROM fb GROUP BY ALL) USING (query_id, doc_id, node_id, t) GROUP BY ALL),
  fs AS (SELECT query_id, doc_id, list_reverse_sort(list(coalesce(round(2e0 * k / fc.n, 6), 0e0))) AS s FROM ch LEFT JOIN fc USING (query_id, doc_id, node_id) GROUP BY ALL),
  choice AS (SELECT query_id, doc_id, CASE WHEN len(s) < 2 OR s[1] - s[2] >= 0.15e0 THEN 'dfs' ELSE 'beam' END AS algorithm FROM fs)"""

#: Hits of each passage in chunks of 600 characters.
CHUNKS = f"""{O.POST}, {O.QT}, bh AS ({O.top(O.bm25('1e0'), 10)}), bc AS (SELECT query_id, doc_id, rank AS hit, text, unnest(range(0, (length(text) + 599) // 600)) AS i FROM bh JOIN d USING (doc_id)),
  ck AS (SELECT query_id, 'doc_' || doc_id || '_chunk_' || i AS chunk_id, q.text AS query, 'Document ' || doc_id AS title, substring(bc.text, i * 600 + 1, 600) AS text, row_number() OVER (PARTITION BY query_id ORDER BY hit, i) AS rank FROM bc JOIN q USING (query_id)),
  tk AS (SELECT query_id, chunk_id, rank, title, text, list_filter({O.w('query', 1)}, lambda x: x NOT IN ({STOP})) AS qt, list_filter({O.w("title || ' ' || text", 1)}, lambda x: x NOT IN ({STOP})) AS dt FROM ck)"""

SCORED = """qc AS (SELECT query_id, t, count(*)::DOUBLE AS n FROM (SELECT query_id, unnest(any_value(qt)) AS t FROM tk GROUP BY query_id) GROUP BY ALL), dc AS (SELECT query_id, chunk_id, t, count(*)::DOUBLE AS n FROM (SELECT query_id, chunk_id, unnest(dt) AS t FROM tk) GROUP BY ALL),
  ql AS (SELECT query_id, sqrt(sum(n * n)) AS l, count(*) AS k FROM qc GROUP BY 1), dl AS (SELECT query_id, chunk_id, sqrt(sum(n * n)) AS l FROM dc GROUP BY ALL),
  both_ AS (SELECT query_id, chunk_id, sum(qc.n * dc.n) AS p, count(*) AS c FROM qc JOIN dc USING (query_id, t) GROUP BY ALL),
  sc AS (SELECT tk.*, round(0.5e0 * coalesce(p / (ql.l * dl.l), 0e0) + 0.3e0 * coalesce(c / ql.k, 0e0) + 0.2e0 * (len(list_filter(qt, lambda x: contains(lower(title), x))) > 0)::INT, 6) AS score FROM tk LEFT JOIN both_ USING (query_id, chunk_id) LEFT JOIN ql USING (query_id) LEFT JOIN dl USING (query_id, chunk_id))"""

LEADERS = """wd AS (SELECT query_id AS grp, rank::INT AS ord, list_distinct(list_filter({tokens}, lambda x: x NOT IN ({stop}))) AS w FROM ck), wx AS (SELECT grp, ord, len(w) AS n, unnest(w) AS t FROM wd),
  nr AS (SELECT s.grp, j.ord, list(i.ord) AS near FROM (SELECT a.grp, a.ord AS i, b.ord AS j, a.n AS an, b.n AS bn, count(*) AS c FROM wx a JOIN wx b ON a.grp = b.grp AND a.t = b.t AND a.ord < b.ord GROUP BY ALL HAVING c / (an + bn - c) >= {least}) s
    JOIN wd i ON i.grp = s.grp AND i.ord = s.i JOIN wd j ON j.grp = s.grp AND j.ord = s.j GROUP BY ALL),
  lw AS (SELECT grp, 1 AS ord, [1] AS leads, 1 AS leader FROM wd WHERE ord = 1
    UNION ALL SELECT grp, ord, CASE WHEN first IS NULL THEN list_append(leads, ord) ELSE leads END, coalesce(first, ord) FROM (
      SELECT wd.grp, wd.ord, leads, list_min(list_filter(coalesce(near, []::INT[]), lambda x: list_contains(leads, x))) AS first FROM lw JOIN wd ON wd.grp = lw.grp AND wd.ord = lw.ord + 1 LEFT JOIN nr ON nr.grp = wd.grp AND nr.ord = wd.ord))"""

_WEIGHT = "lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN 2.5e0 WHEN length(x) > 8 THEN 2e0 WHEN length(x) > 5 THEN 1.5e0 ELSE 1e0 END"


def _grams(c: str, n: int) -> str:
    return f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"


def _share(n: int, k: str) -> str:
    a = f"list_distinct({_grams('w', n)})"
    return f"nullif(least(1e0, {k} * CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {_grams('x', n)})) / len({a}) ELSE 0e0 END), 0e0)"


GROUNDED = f"""ss AS (SELECT answer_id, question AS source, list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+\\s+'), lambda x: trim(x)), lambda x: x <> '') AS a FROM pr),
  sn AS (SELECT answer_id, source, i::INT AS i, a[i + 1] AS sentence FROM (SELECT *, unnest(range(0, len(a))) AS i FROM ss) WHERE length(a[i + 1]) >= 10),
  sw AS (SELECT *, lower(sentence) AS s, lower(source) AS t, {O.w('lower(sentence)')} AS w, {O.w('lower(source)')} AS x FROM sn),
  sp AS (SELECT *, CASE WHEN length(s) >= 15 THEN list_transform(range(1, length(s) - 13, 7), lambda i: substring(s, i, 15)) ELSE []::VARCHAR[] END AS p,
    CASE WHEN len(w) > 0 THEN coalesce(list_sum(list_transform(list_filter(w, lambda y: list_contains(x, y)), {_WEIGHT})), 0e0) / list_sum(list_transform(w, {_WEIGHT})) ELSE 0e0 END AS words FROM sw),
  sg AS (SELECT *, list_filter([CASE WHEN regexp_matches(sentence, '{CITATION}') THEN 0.85e0 END, words, words, {_share(2, '1.2e0')}, {_share(3, '1.5e0')},
    CASE WHEN len(p) > 0 THEN nullif(len(list_filter(p, lambda y: contains(t, y))) / len(p), 0e0) END], lambda y: y IS NOT NULL) AS g FROM sp),
  gr AS (SELECT answer_id, i, round(CASE WHEN contains(t, trim(s)) THEN 1e0 ELSE least(1e0, greatest(0.35e0, 0.6e0 * list_max(g) + 0.4e0 * (list_sum(g) / len(g)))) END, 6) AS confidence FROM sg)"""

SQL = {
    "beam_search_docs": f"WITH RECURSIVE {ROUTED}, {BEAM_WALK} {_OUT} beam",
    "dfs_search_docs": f"WITH RECURSIVE {ROUTED}, {DFS_WALK} {_OUT} dfs",
    "traversal_statistics": f"""WITH RECURSIVE {ROUTED}, {BEAM_WALK}, {DFS_WALK}, {CHOICE}, hits AS (SELECT b.* FROM beam b JOIN choice USING (query_id, doc_id) WHERE algorithm = 'beam' UNION ALL SELECT f.* FROM dfs f JOIN choice USING (query_id, doc_id) WHERE algorithm = 'dfs'),
      h AS (SELECT query_id, doc_id, count(*) AS n_hits, count(*) FILTER (recovered) AS n_recovered, max(depth) AS deepest, round(max(score), 6) AS best FROM hits GROUP BY ALL)
      SELECT query_id, doc_id, count(*) + 1 AS tree_nodes, coalesce(any_value(n_hits), 0) AS n_hits, coalesce(any_value(n_recovered), 0) AS n_recovered, any_value(deepest) AS deepest, any_value(best) AS best FROM ch LEFT JOIN h USING (query_id, doc_id) GROUP BY ALL""",
    "compress_relevance": f"WITH {O.D}, {O.A}, {CHUNKS}, {SCORED} SELECT query_id, chunk_id, score FROM sc",
    "compress_keep": f"""WITH {O.D}, {O.A}, {CHUNKS}, {SCORED} SELECT query_id, chunk_id FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM sc)
      WHERE score >= 0.2e0 OR (best < 0.2e0 AND n <= 3)""",
    "leader_merge": f"WITH RECURSIVE {O.D}, {O.A}, {CHUNKS}, {LEADERS.format(tokens=O.w('text', 1), stop=STOP, least='0.3e0')} SELECT grp, ord, leader FROM lw",
    "budget_truncate": f"""WITH RECURSIVE {O.D}, {O.A}, {CHUNKS}, {SCORED}, o AS (SELECT query_id AS grp, rank::INT AS ord, length(text) // 3 AS n_tokens, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS i FROM sc),
      w AS (SELECT grp, ord, n_tokens, i, n_tokens AS total, true AS taken, n_tokens > 500 AS stop FROM o WHERE i = 1
        UNION ALL SELECT o.grp, o.ord, o.n_tokens, o.i, total + CASE WHEN NOT stop AND total + o.n_tokens <= 500 OR NOT stop AND total = 0 THEN o.n_tokens ELSE 0 END, NOT stop AND (total + o.n_tokens <= 500 OR total = 0), stop OR (total = 0 AND o.n_tokens > 500)
        FROM w JOIN o ON o.grp = w.grp AND o.i = w.i + 1)
      SELECT grp, ord, n_tokens, taken FROM w""",
    "grounding_sentences": f"WITH {O.TURNS}, {GROUNDED} SELECT answer_id, i, confidence, confidence >= 0.5e0 AS grounded FROM gr",
    "grounding_verdicts": f"""WITH {O.TURNS}, {GROUNDED}, a AS (SELECT answer_id, round(avg(confidence), 3) AS confidence, count(*) AS n_sentences, count(*) FILTER (confidence < 0.5e0) AS n_ungrounded FROM gr GROUP BY 1)
      SELECT *, confidence >= 0.6e0 AS reliable, n_ungrounded >= 0.4e0 * n_sentences AS warn, CASE WHEN confidence >= 0.9e0 THEN 'high' WHEN confidence >= 0.7e0 THEN 'good' WHEN confidence >= 0.5e0 THEN 'partial' ELSE 'low' END AS label FROM a""",
}


SQL["rouge_l_pairs"] = f"""WITH RECURSIVE {O.TURNS}, t AS (SELECT answer_id, regexp_extract_all(lower(question), '[0-9A-Za-z가-힣]+|[一-鿿]') AS a, regexp_extract_all(lower(answer), '[0-9A-Za-z가-힣]+|[一-鿿]') AS b FROM pr),
  r AS (SELECT answer_id, 0::BIGINT AS i, list_transform(b, lambda x: 0::BIGINT) AS row FROM t
    UNION ALL SELECT answer_id, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
      SELECT r.answer_id, i, list_transform(range(1, len(b) + 1), lambda j: greatest(row[j], CASE WHEN b[j] = a[i + 1] THEN coalesce(row[j - 1], 0) + 1 ELSE 0 END)) AS c FROM r JOIN t USING (answer_id) WHERE i < len(a))),
  l AS (SELECT answer_id, coalesce(list_max(row), 0) AS l, len(a) AS n, len(b) AS m FROM r JOIN t USING (answer_id) WHERE i = len(a)),
  f AS (SELECT answer_id, CASE WHEN m > 0 THEN l / m ELSE 0e0 END AS p, CASE WHEN n > 0 THEN l / n ELSE 0e0 END AS r FROM l)
  SELECT answer_id, round(p, 6) AS precision, round(r, 6) AS recall, {O.f1('p', 'r')} AS f1 FROM f"""

_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, last ORDER BY confidence DESC, path, types) AS n FROM (SELECT seed, list_append(path, dst) AS path, list_append(types, edge_type) AS types, round(p.confidence * tr.confidence, 9) AS confidence, dst AS last FROM {0} p JOIN tr ON src = last WHERE NOT list_contains(path, dst)) WHERE confidence >= 0.3e0) WHERE n = 1"
SQL["graph_search"] = f"""WITH {O.TRADE}, p0 AS (SELECT seed, [seed] AS path, []::VARCHAR[] AS types, confidence, seed AS last FROM (VALUES ('n1', 1e0), ('n8', 0.9e0)) s(seed, confidence)),
  p1 AS ({_BEST.format('p0')}), p2 AS ({_BEST.format('p1')}), a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
  k AS (SELECT * FROM (SELECT seed, path, confidence, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, len(path), path) AS n FROM a) WHERE n <= 20),
  u AS (SELECT * FROM (SELECT path, confidence, row_number() OVER (PARTITION BY list_sort(path) ORDER BY confidence DESC, path) AS m FROM k) WHERE m = 1),
  b AS (SELECT * FROM (SELECT path, confidence, row_number() OVER (ORDER BY confidence DESC, path) AS p FROM u) WHERE p <= 5),
  e AS (SELECT p, confidence, i, path[i + 1] AS node FROM (SELECT *, unnest(range(0, len(path))) AS i FROM b)),
  g AS (SELECT node, min(p * 1000 + i) AS first, count(*) AS n_paths, max(confidence) AS confidence FROM e GROUP BY 1)
  SELECT * FROM (SELECT row_number() OVER (ORDER BY first) AS place, node, n_paths, round(confidence, 6) AS confidence FROM g) WHERE place <= 10"""


# Claims and errors. Numbers are found one run of digits after the other, since there is no look-around here.

_L = "[\\p{L}\\p{N}_]"
_U = "(?:억|만|천|백|개|년|월|일)?"
_AT = f"""coalesce(nullif(regexp_extract(rest, '^([0-9]+\\.[0-9]+%){_L}', 1), ''), nullif(regexp_extract(rest, '^([0-9]+\\.[0-9]+{_U})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), ''),
    nullif(regexp_extract(rest, '^([0-9]+%){_L}', 1), ''), nullif(regexp_extract(rest, '^([0-9]+{_U})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), ''))"""


def numbers(of: str, key: str, text: str) -> str:
    """Tables ending in nums (key, nums): the numbers in each text that has a digit."""
    return f"""scan AS (SELECT {key} AS id, {text} AS text, 1::BIGINT AS p, []::VARCHAR[] AS nums FROM {of} WHERE regexp_matches({text}, '[0-9]')
    UNION ALL SELECT id, text, p + CASE WHEN m IS NULL THEN length(regexp_extract(rest, '^[0-9]+')) ELSE length(m) END, CASE WHEN m IS NULL THEN nums ELSE list_append(nums, m) END FROM (
      SELECT *, CASE WHEN p = 1 OR NOT regexp_matches(substring(text, p - 1, 1), '{_L}') THEN {_AT} END AS m FROM (
        SELECT id, text, nums, q AS p, substring(text, q) AS rest FROM (SELECT *, p + length(regexp_extract(substring(text, p), '^[^0-9]*')) AS q FROM scan) WHERE q <= length(text)))),
  nums AS (SELECT id, arg_max(nums, len(nums)) AS nums FROM scan GROUP BY id)"""


def _any(pairs: tuple, a: str, b: str) -> str:
    return "(" + " OR ".join(f"(contains({a}, '{n.replace(chr(39), chr(39) * 2)}') AND contains({b}, '{p}'))" for n, p in pairs) + ")"


_CLAIM_STOP = ", ".join(f"'{w}'" for w in H.CLAIM_STOP)
_CLAIMS = f"""cl AS (SELECT answer_id, question AS source, c, unnest(range(0, len(c))) AS i FROM (SELECT answer_id, question, list_filter(list_transform({O.CLAIMS}, lambda x: trim(x)), lambda x: length(x) >= 10) AS c FROM pr)),
  cm AS (SELECT answer_id || ':' || i AS id, answer_id, source, c[i + 1] AS claim FROM cl), {numbers('cm', 'id', 'claim')},
  ck AS (SELECT cm.*, CASE WHEN regexp_matches(claim, '{H.HAS_NUMBER}') THEN 'number' WHEN regexp_matches(claim, '{H.DATE}') THEN 'temporal' WHEN regexp_matches(claim, '{H.ENTITY}') THEN 'entity' ELSE 'fact' END AS kind,
    list_distinct(list_filter({O.w('claim', 2)}, lambda x: x NOT IN ({_CLAIM_STOP}))) AS w, {O.w('source', 2)} AS v, coalesce(nums, []::VARCHAR[]) AS nums FROM cm LEFT JOIN nums USING (id)),
  cs AS (SELECT *, CASE WHEN len(w) > 0 THEN round(len(list_intersect(w, v)) / len(w), 6) ELSE 0e0 END AS support FROM ck),
  cv AS (SELECT *, CASE WHEN len(w) = 0 THEN true WHEN kind = 'number' AND len(list_filter(nums, lambda x: contains(source, x))) > 0 THEN true WHEN kind = 'number' AND support < 0.5e0 THEN false
    WHEN kind = 'entity' AND len(list_filter(regexp_extract_all(claim, '{H.ENTITY}'), lambda x: contains(lower(source), lower(x)))) > 0 THEN true ELSE support >= 0.4e0 END AS verified FROM cs),
  ce AS (SELECT *, CASE WHEN verified THEN 'none' WHEN {_any(H.CLAIM_OPPOSITES, 'lower(claim)', 'lower(source)')} THEN 'contradictory' WHEN kind = 'number' THEN 'quantitative_error' WHEN kind = 'temporal' THEN 'temporal_error' WHEN kind = 'entity' THEN 'fabricated_entity' ELSE 'unsupported_claim' END AS error FROM cv)"""

SQL["fidelity_by_kind"] = f"WITH RECURSIVE {O.TURNS}, {_CLAIMS} SELECT kind, error, count(*) AS n_claims FROM ce GROUP BY ALL"
SQL["fidelity_summary"] = f"""WITH RECURSIVE {O.TURNS}, {_CLAIMS}, a AS (SELECT answer_id, count(id) AS n, count(id) FILTER (verified) AS g, round(CASE WHEN count(id) > 0 THEN count(id) FILTER (verified) / count(id) ELSE 1e0 END, 6) AS x FROM pr LEFT JOIN cv USING (answer_id) GROUP BY 1)
  SELECT count(*) AS n_answers, sum(n)::BIGINT AS n_claims, sum(g)::BIGINT AS n_grounded, round(avg(x), 6) AS groundedness, round(coalesce(stddev_samp(x), 0e0), 6) AS deviation, round(1e0 - avg(x), 6) AS hallucination_rate FROM a"""

_MISS_STOP = ", ".join(f"'{w}'" for w in H.MISS_STOP)
_ERRORS = f"""{numbers('pr', 'answer_id', 'answer')}, ea AS (SELECT pr.answer_id, answer, question AS context, list_distinct(list_filter({O.ws('question')}, lambda x: x NOT IN ({_MISS_STOP}))) AS ref, {O.ws('question')} AS ctx, coalesce(nums, []::VARCHAR[]) AS nums FROM pr LEFT JOIN nums ON nums.id = pr.answer_id),
  ef AS (SELECT answer_id, len(ref) > 0 AND len(list_intersect(ref, ctx)) / len(ref) < 0.3e0 AS miss,
    len(list_filter(nums, lambda x: length(x) > 1 AND NOT contains(context, x))) > 0 OR len(list_filter(regexp_extract_all(answer, '{H.NAME}'), lambda x: length(x) > 3 AND NOT contains(context, x))) > 0 AS made_up,
    {" OR ".join(f"(contains(lower(answer), '{m}') AND NOT contains(lower(context), '{m}'))" for m in H.OVERCLAIM)} AS over_, {_any(H.OPPOSITES, 'lower(answer)', 'lower(context)')} AS against FROM ea),
  er AS (SELECT 'retrieval_miss' AS category, 'critical' AS severity FROM ef WHERE miss UNION ALL SELECT 'hallucination', 'major' FROM ef WHERE made_up UNION ALL SELECT 'overclaim', 'minor' FROM ef WHERE over_ UNION ALL SELECT 'contradiction', 'critical' FROM ef WHERE against)"""
SQL["error_matrix"] = f"WITH RECURSIVE {O.TURNS}, {_ERRORS} SELECT category, severity, count(*) AS n_errors FROM er GROUP BY ROLLUP (category, severity)"
SQL["error_crosstab"] = f"WITH RECURSIVE {O.TURNS}, {_ERRORS} SELECT category, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor FROM er GROUP BY 1"

#: The query path: hits by the chosen algorithm, scored, kept, merged by leader, cut to 2000 tokens and joined.
_HITS = f"""{ROUTED}, {BEAM_WALK}, {DFS_WALK}, {CHOICE}, hits AS (SELECT b.* FROM beam b JOIN choice USING (query_id, doc_id) WHERE algorithm = 'beam' UNION ALL SELECT f.* FROM dfs f JOIN choice USING (query_id, doc_id) WHERE algorithm = 'dfs'),
  hb AS (SELECT h.query_id, node_id AS chunk_id, p.query, c.title, array_to_string(sec.ww, ' ') AS text, (sec.ord + 1)::VARCHAR AS page, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, node_id) AS rank
    FROM hits h JOIN ch c USING (query_id, doc_id, node_id) JOIN pairs p USING (query_id, doc_id) JOIN sec ON sec.doc_id = h.doc_id AND sec.ord = c.ord),
  tk AS (SELECT query_id, chunk_id, rank, title, text, page, list_filter({O.w('query', 1)}, lambda x: x NOT IN ({STOP})) AS qt, list_filter({O.w("title || ' ' || text", 1)}, lambda x: x NOT IN ({STOP})) AS dt FROM hb), {SCORED}"""
SQL["query_context"] = f"""WITH RECURSIVE {_HITS},
  kp AS (SELECT query_id AS grp, rank, chunk_id, title || ' ' || text AS text, page, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS ord FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM sc) WHERE score >= 0.2e0 OR (best < 0.2e0 AND n <= 3)),
  {LEADERS.format(tokens=O.w('text', 1), stop=STOP, least='0.7e0').replace('query_id AS grp, rank::INT AS ord', 'grp, ord::INT AS ord').replace('FROM ck)', 'FROM kp)')},
  mg AS (SELECT grp, leader, score, chunk_id, text, page, ord FROM kp JOIN lw USING (grp, ord)), mt AS (SELECT grp, leader, text, min(ord) AS o FROM mg GROUP BY ALL),
  m3 AS (SELECT grp, leader, string_agg(text, ' | ' ORDER BY o) AS text FROM (SELECT *, row_number() OVER (PARTITION BY grp, leader ORDER BY o) AS k FROM mt) WHERE k <= 3 GROUP BY ALL),
  mm AS (SELECT grp, leader, max(score) AS score, array_to_string(list_sort(list_distinct(list(page))), ', ') AS pages FROM mg GROUP BY ALL),
  mo AS (SELECT grp, text, pages, score, length(text) // 3 AS t, row_number() OVER (PARTITION BY grp ORDER BY score DESC, leader) AS i FROM mm JOIN m3 USING (grp, leader)),
  bg AS (SELECT grp, i, t AS total, true AS taken, t > 2000 AS stop FROM mo WHERE i = 1
    UNION ALL SELECT mo.grp, mo.i, total + CASE WHEN NOT stop AND (total + t <= 2000 OR total = 0) THEN t ELSE 0 END, NOT stop AND (total + t <= 2000 OR total = 0), stop OR (total = 0 AND t > 2000) FROM bg JOIN mo ON mo.grp = bg.grp AND mo.i = bg.i + 1),
  pl AS (SELECT grp, text, pages, row_number() OVER (PARTITION BY grp ORDER BY mo.i) AS place FROM mo JOIN bg USING (grp, i) WHERE taken)
  SELECT grp AS query_id, string_agg('[' || place || '] (p.' || pages || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS context FROM pl GROUP BY grp"""
