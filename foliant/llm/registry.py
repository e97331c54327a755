"""The queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import simhash_sql
from foliant.llm.common import bucket_of, table

OP1 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
replies AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS j, count(*) OVER (PARTITION BY conv_id) AS m FROM n WHERE role = 'assistant'),
ends AS (SELECT conv_id, max(i) AS last_i, max(i) FILTER (WHERE j = ((conv_id % m) + m) % m + 1) AS swapped, arg_max(text, i) AS reply,
    CASE WHEN max(m) > 1 THEN arg_min(text, i) ELSE '' END AS own FROM replies GROUP BY conv_id),
pairs AS (SELECT e.conv_id, e.last_i, e.swapped, coalesce(o.reply, e.own) AS other FROM ends e LEFT JOIN ends o ON o.conv_id = xor(e.conv_id, 1)),
sides AS (SELECT p.conv_id, n.i, n.role, n.text AS a, CASE WHEN n.i = p.swapped THEN p.other ELSE n.text END AS b
    FROM pairs p JOIN n ON n.conv_id = p.conv_id AND n.i <= p.last_i),
prefixes AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE a IS DISTINCT FROM b) - 1, max(i)) AS n_common FROM sides GROUP BY conv_id),
turns AS (SELECT s.conv_id, s.i, s.role, p.n_common, s.i > p.n_common AS later, '<|start|>' || role || chr(10) || a || '<|end|>' || chr(10) AS a,
    '<|start|>' || role || chr(10) || b || '<|end|>' || chr(10) AS b FROM sides s JOIN prefixes p ON p.conv_id = s.conv_id),
placed AS (SELECT *, coalesce(sum(length(a)) OVER w, 0)::BIGINT AS a0, coalesce(sum(length(b)) OVER w, 0)::BIGINT AS b0 FROM turns
    WINDOW w AS (PARTITION BY conv_id, later ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, n_common::INTEGER AS n_common, coalesce(string_agg(a, '' ORDER BY i) FILTER (WHERE NOT later), '') AS prompt,
  coalesce(string_agg(a, '' ORDER BY i) FILTER (WHERE later), '') AS chosen, coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE later), '') AS rejected,
  coalesce(string_agg((a0 + 10 + length(role))::VARCHAR || ':' || (a0 + length(a))::VARCHAR, ',' ORDER BY i) FILTER (WHERE later AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((b0 + 10 + length(role))::VARCHAR || ':' || (b0 + length(b))::VARCHAR, ',' ORDER BY i) FILTER (WHERE later AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id, n_common
"""

# Kinds in their order, the pattern of each, and what a match must also hold.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN reverse({_DIGITS})[j]::INTEGER ELSE (2 * reverse({_DIGITS})[j]::INTEGER) // 10 + (2 * reverse({_DIGITS})[j]::INTEGER) % 10 END)) % 10 = 0"
PII_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS HUGEINT), 999) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
)


def pii_base_sql() -> str:
    """Open identifiers: each pattern's matches, placed by the lengths of what lies between them."""
    found = " UNION ALL ".join(
        f"SELECT r, {o} AS o, '{kind}' AS kind, m, s, s + length(m) AS e FROM (SELECT r, ms[i] AS m, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s"
        f" FROM (SELECT r, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps FROM d))) WHERE {able}"
        for o, (kind, p, able) in enumerate(PII_KINDS)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, _, _ in PII_KINDS)
    zeros = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in PII_KINDS)
    return (
        f"WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), found AS ({found}),"
        f" per AS (SELECT r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM found GROUP BY r)"
        f" SELECT d.doc_id, {zeros}, sha256(coalesce(per.spans, '')) AS base_sha256 FROM d LEFT JOIN per USING (r)"
    )


OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN nullif(max(page_id) OVER (PARTITION BY payload_digest, payload_bytes), page_id) END AS refers_to FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

OP8 = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  (('0x' || left(md5('8:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
e AS (SELECT *, greatest(size // (10 ** greatest(length(size::VARCHAR) - 2, 0))::BIGINT * (10 ** greatest(length(size::VARCHAR) - 2, 0))::BIGINT, 1) AS class FROM d),
classes AS (SELECT source, class, sum(size)::BIGINT AS words FROM e GROUP BY source, class),
s0 AS (SELECT source, sum(words)::BIGINT AS source_size FROM classes GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s1),
s3 AS (SELECT *, max(CASE WHEN lvl * weight <= cap THEN lvl END) OVER () AS level FROM s2),
s4 AS (SELECT source, source_size, least(cap, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM s3),
targets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12::DOUBLE) ELSE 0 END::BIGINT AS certain FROM s4),
c1 AS (SELECT c.*, t.source_size, t.target, t.certain, greatest(0, t.target - t.certain * t.source_size) AS rest FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
c2 AS (SELECT *, greatest(0, rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(words * sqrt(class)) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS own FROM c1),
c3 AS (SELECT *, arg_max(own, class) FILTER (WHERE own * sqrt(class) <= 1) OVER (PARTITION BY source) AS level FROM c2),
c4 AS (SELECT *, CASE WHEN rest <= 0 THEN 0 ELSE least(1, coalesce(level * sqrt(class), 1)) END::DOUBLE AS p FROM c3),
f AS (SELECT e.*, c.source_size, c.target, c.certain, c.rest, c.p, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 0 END AS odds FROM e JOIN c4 c ON e.source IS NOT DISTINCT FROM c.source AND e.class = c.class),
g AS (SELECT *, odds / (1 + odds) AS place FROM f),
h AS (SELECT source, place, sum(size) AS words FROM g WHERE p > 0 GROUP BY source, place),
k AS (SELECT source, place, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + words / 2 AS middle FROM h),
r AS (SELECT g.*, g.certain + CASE WHEN g.p > 0 AND k.middle <= g.rest THEN 1 ELSE 0 END AS copies FROM g LEFT JOIN k ON g.source IS NOT DISTINCT FROM k.source AND g.place = k.place)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM r
"""

OP9 = """
WITH RECURSIVE able AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP10 = """
WITH able AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM able q JOIN able c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM scored)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 20
"""


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import preference

    pairs = preference.pairs_of(preference.conversations_of(table(spark, sf_dir, "conversations")))
    return preference.formatted(pairs).select(
        F.col("key").alias("conv_id"), "n_common", "prompt", "chosen", "rejected",
        preference.mask_text(F.col("chosen_mask")).alias("chosen_mask"), preference.mask_text(F.col("rejected_mask")).alias("rejected_mask"),
    )


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import pii

    return pii.spans(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def pii_open_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express: its open identifiers."""
    return op2_pii_spans(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    held = bucket_of(F.col("_row.doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    return toxicity.scored(docs, lexicon).select("_row.doc_id", held.alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = quality.learn(docs, table(spark, sf_dir, "labels"))
    held = bucket_of(F.col("_row.doc_id"), quality.FOLDS) == quality.HELD_OUT
    return quality.scored(docs, ensemble).select("_row.doc_id", held.alias("held_out"), "score", "predicted")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foliant.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return out.select(F.col("key").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import simhash

    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import warc

    return warc.read_back(spark, warc.write(table(spark, sf_dir, "pages")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, mixing.word_count(F.col("text")))
    return out.select("_row.doc_id", "size", "source_size", "target", "taken", "copies")


def op9_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import embedding_dedup

    out = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import topk_search

    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = (op1_preference_pairs, op2_pii_spans, op3_toxicity, op4_quality_rules, op5_byte_bpe, op6_simhash_components, op7_warc, op8_mix_sources, op9_embedding_near_dups, op10_topk_search)
#: Parts of those that SQL can express where it can't express the whole.
PARTS = (pii_open_spans,)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*QUERIES, *PARTS)}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_pairs": OP1, "pii_open_spans": pii_base_sql(), "op6_simhash_components": simhash_sql.oracle(), "op7_warc": OP7, "op8_mix_sources": OP8, "op9_embedding_near_dups": OP9, "op10_topk_search": OP10}
