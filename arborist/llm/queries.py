"""The queries of the corpus operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, dialogue, embed_dedup, lloyd, matroska, packing, secret_scan, separators, shards, simhash, unigram, winnowing, zquality
from .common import new_path, table

BPE = "byte_bpe_50k.json"
END_OF_TEXT = 50256
PIECES = "piece_bpe_32k.model"


def tokenizer(name: str = BPE) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return zquality.score(docs, zquality.train(docs, table(spark, sf_dir, "labels")))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.text_media(table(spark, sf_dir, "documents"))


def op6_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = unigram.zipf_scores(unigram.read_pieces(tokenizer(PIECES)))
    return unigram.encode_texts(spark, table(spark, sf_dir, "documents"), pieces)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the compacted version, with a digest of its text and the rows its manifest counts."""
    store = shards.ShardStore(spark, new_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    rows = store.manifest().agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("version_rows")).first().version_rows
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.lit(rows).cast("long").alias("version_rows"))


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"), tokenizer(), END_OF_TEXT)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations")))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters_with_inertia(table(spark, sf_dir, "embeddings"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_packing": op2_packing,
        "op3_context_tree_scores": op3_context_tree_scores,
        "op4_compression_quality": op4_compression_quality,
        "op5_matroska": op5_matroska,
        "op6_unigram_pieces": op6_unigram_pieces,
        "op7_secret_scan": op7_secret_scan,
        "op8_simhash": op8_simhash,
        "op9_sharding": op9_sharding,
        "op10_separator_scan": op10_separator_scan,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_delta_lloyd": op12_delta_lloyd,
        "op13_winnowing": op13_winnowing,
    }


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
), edges AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, e.y FROM reach r JOIN edges e ON e.x = r.other
), roots AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degrees AS (SELECT x, count(*) AS n_links FROM edges GROUP BY x)
SELECT v.vec_id, coalesce(d.n_links, 0) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN roots r USING (vec_id) LEFT JOIN degrees d ON d.x = v.vec_id
"""


OP9_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, (SELECT count(*) FROM documents) AS version_rows FROM documents"


OP11_SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 20 AS k20 FROM keyed
), broken AS (
  SELECT conv_id, turn, CASE WHEN k20 = 4 THEN 'user' ELSE role END AS role, CASE k20 WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE k20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed
), convs AS (SELECT row_number() OVER () AS g, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
), numbered AS (
  SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM broken b JOIN convs c ON b.conv_id IS NOT DISTINCT FROM c.conv_id
), r AS (
  SELECT *, bare = '' AS blank, bare <> '' AND seen AS dup, bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS c,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair, i > 1 AS follows FROM (
    SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS seen FROM numbered)
), sizes AS (SELECT g, count(*) AS m FROM r GROUP BY g
), used AS (
  SELECT *, CASE WHEN cut THEN 5 ELSE 0 END AS more, CASE WHEN blank OR dup THEN 1000000 ELSE 0 END AS gone FROM r
), back(g, i, w0, w1, w2, w3) AS (
  SELECT g, m + 1, 0::BIGINT, 10::BIGINT, 5::BIGINT, 0::BIGINT FROM sizes
  UNION ALL
  SELECT g, i, least(u0, 5 + least(u2, 5 + u3)), least(u1, 5 + least(u2, 5 + u3)), least(u2, 5 + u3), least(u3, 5 + u2) FROM (
    SELECT b.g, r.i,
      least(2 + w0, gone + more + 1 + w2, CASE c WHEN 's' THEN gone + more + w1 WHEN 'u' THEN gone + more + w2 END) AS u0,
      least(2 + w1, gone + more + 1 + w2, CASE c WHEN 'u' THEN gone + more + w2 END) AS u1,
      least(2 + w2, gone + more + 1 + w3, CASE c WHEN 'a' THEN gone + more + w3 END) AS u2,
      least(2 + w3, gone + more + 1 + w2, CASE c WHEN 'u' THEN gone + more + w2 END) AS u3
    FROM back b JOIN used r ON r.g = b.g AND r.i = b.i - 1)
), costs AS (SELECT g, i, [w0, w1, w2, w3] AS w FROM back
), walk(g, i, s, audit, lines) AS (
  SELECT g, 1::BIGINT, 1, '', []::VARCHAR[] FROM sizes
  UNION ALL
  SELECT g, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE added END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, name || ':' || text) ELSE list_append(lines, name || ':') END FROM (
    SELECT *, CASE WHEN i > m THEN 'I' WHEN 2 + after[s] = w[s] THEN 'D' WHEN 5 + w[added] = w[s] THEN 'I' WHEN gone + more + after[kept] = w[s] THEN 'K' ELSE 'R' END AS e FROM (
      SELECT k.*, m, c1.w, c2.w AS after, r.gone, r.more, r.role, r.text, CASE WHEN s = 3 THEN 4 ELSE 3 END AS added, CASE WHEN s = 3 THEN 'assistant' ELSE 'user' END AS name,
        CASE WHEN s = 1 AND c = 's' THEN 2 WHEN s <> 3 AND c = 'u' THEN 3 WHEN s = 3 AND c = 'a' THEN 4 END AS kept
      FROM walk k JOIN sizes z ON z.g = k.g JOIN costs c1 ON c1.g = k.g AND c1.i = k.i LEFT JOIN costs c2 ON c2.g = k.g AND c2.i = k.i + 1 LEFT JOIN used r ON r.g = k.g AND r.i = k.i
      WHERE k.i <= m OR s IN (2, 3)))
), ended AS (SELECT k.g, audit, lines FROM walk k JOIN sizes z ON z.g = k.g WHERE k.i = m + 1 AND s IN (1, 4)
), counted AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (follows AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY g
)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(c1.w[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM convs v LEFT JOIN counted n ON n.g = v.g LEFT JOIN ended e ON e.g = v.g LEFT JOIN costs c1 ON c1.g = v.g AND c1.i = 1
"""


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    nearest = """{a} AS (
      SELECT vec_id, x, arg_min(j, d * 1000 + j) AS j, min(d) AS d FROM (
        SELECT p.vec_id, p.x, c.j, list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM points p CROSS JOIN {c} c) GROUP BY vec_id, x)"""
    means = """m{r} AS (
      SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS x FROM (
        SELECT j, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(x) AS v, unnest(range(64)) AS pos FROM a{r}) GROUP BY j, pos) GROUP BY j
    ), c{n} AS (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j))"""
    steps = []
    for r in range(rounds):
        steps += [nearest.format(a=f"a{r}", c=f"c{r}"), means.format(r=r, n=r + 1)]
    steps.append(nearest.format(a="last", c=f"c{rounds}"))
    return f"""
    WITH points AS (
      SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
    ), c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS j, x FROM points ORDER BY j LIMIT {k}
    ), {", ".join(steps)}
    SELECT vec_id, l.j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY l.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM last l JOIN c{rounds} c USING (j)"""


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), found AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), met AS (SELECT rid, i, f.n, item_id FROM found f JOIN windows v ON v.n = f.n AND v.t = f.t
), hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM met) GROUP BY rid
), listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op9_sharding": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_delta_lloyd": _op12_sql(), "op13_winnowing": OP13_SQL}
