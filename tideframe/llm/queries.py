"""The registered queries of these operators, with SQL twins where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_language_id")
def op1_language_id(spark, folder):
    from tideframe.llm.language_id import language_id

    return language_id(table(spark, folder, "documents"))


@query("op6_quality_rules")
def op6_quality_rules(spark, folder):
    from tideframe.llm.quality_rules import quality_rules

    result = quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("anomaly"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, folder):
    from tideframe.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, folder, "documents"))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, folder):
    from tideframe.llm.suffix_dedup import dedup_suffixes

    result = dedup_suffixes(table(spark, folder, "documents"))
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op9_jaccard_join")
def op9_jaccard_join(spark, folder):
    from tideframe.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, folder, "documents"))


_OP8 = """
WITH RECURSIVE scaled AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
  SELECT vec_id, e FROM scaled
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), low AS (SELECT u, min(v) AS v FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.v, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.v, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.u = vec_id LEFT JOIN n ON n.u = vec_id
"""


@query("op8_embedding_dedup", _OP8)
def op8_embedding_dedup(spark, folder):
    from tideframe.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, folder, "embeddings"))


_OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


@query("op7_warc", _OP7)
def op7_warc(spark, folder):
    from tideframe.llm.warc import archive_and_read

    return archive_and_read(table(spark, folder, "pages"))


@query("op10_license_scan")
def op10_license_scan(spark, folder):
    from tideframe.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, folder, "documents"))


@query("op5_sentence_pieces")
def op5_sentence_pieces(spark, folder):
    from tideframe.llm.sentence_pieces import round_trip

    return round_trip(table(spark, folder, "documents"))


@query("op3_importance_sampling")
def op3_importance_sampling(spark, folder):
    from tideframe.llm.importance_sampling import importance_sample

    return importance_sample(table(spark, folder, "documents"), table(spark, folder, "labels"))


_OP11 = """
WITH whole AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""


@query("op11_topk_search", _OP11)
def op11_topk_search(spark, folder):
    from tideframe.llm.topk_search import top_k

    return top_k(table(spark, folder, "embeddings"))


_OP12 = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), words AS (SELECT lang, source, d, unnest(words) AS item FROM docs),
kept AS (SELECT lang, item, count(*) AS lang_count FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_n FROM kept GROUP BY 1),
own AS (SELECT lang, source, item, count(*) AS n FROM words JOIN kept USING (lang, item) GROUP BY 1, 2, 3),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(group_n, 0) AS group_n FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS group_n FROM own GROUP BY 1, 2) USING (lang, source)),
cells AS (SELECT g.lang, g.source, k.item, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (g.group_n + 5 * g.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_count + 5)) // (g.lang_n + 5 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.item = k.item),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', item, p - q FROM cells WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op12_source_divergence", _OP12)
def op12_source_divergence(spark, folder):
    from tideframe.llm.divergence_audit import source_divergence

    return source_divergence(table(spark, folder, "documents"))


_OP13 = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM words LEFT JOIN marks USING (doc_id)
), states AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS filters FROM letters a, letters b, letters c, letters d, letters e
  WHERE length(a.x || b.x || c.x || d.x || e.x) = 5 AND len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, s AS step, filters[s] AS own, filters[1:s - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS s)),
hits AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS failed, len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda f: f)) AS n_fails
  FROM states, steps
), sums AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM hits GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums
"""


@query("op13_filter_audit", _OP13)
def op13_filter_audit(spark, folder):
    from tideframe.llm.filter_audit import filter_interactions

    return filter_interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))
