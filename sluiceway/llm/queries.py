"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluiceway.llm import (
    chat,
    decontamination,
    embedding_links,
    hard_negatives,
    language_model,
    line_dedup,
    near_duplicates,
    packing,
    quality,
    secret_scan,
    spelling_variants,
    toxicity,
    wrapper_induction,
)
from sluiceway.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, benchmark)


OP1_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS p
  FROM (SELECT item_id, w, least(10, len(w)) AS size,
          unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
        FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM pattern), hit AS (
  SELECT d.doc_id, d.s, d.size, p.item_id
  FROM (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS p
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
              FROM doc, sizes WHERE len(w) >= size)) d
  JOIN pattern p ON p.p = d.p AND p.size = d.size
), places AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS word
        FROM (SELECT DISTINCT doc_id, s, size FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_induction.main_texts(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + least(3, len(w)) - 1], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS s
        FROM doc WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingle a JOIN shingle b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"), shares=None)


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.embedding_links(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND list_sum([x * x FOR x IN e]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
"""


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
  FROM named
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), openings AS (
  SELECT conv_id, min(place) // 64 AS said,
    '<|system|>' || chr(10) || arg_min(text, place) || '<|end|>' || chr(10) AS opening
  FROM turns WHERE role = 'system' GROUP BY conv_id
), written AS (
  SELECT conv_id, speaker, CAST(place // 64 AS BIGINT) AS segment, place, role = speaker AS own,
    CASE WHEN said < place // 64 THEN opening ELSE '' END AS opening,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>'
      ELSE '<|user name=' || regexp_replace(role, '[^A-Za-z0-9_.-]', '_', 'g') || '|>' END
      || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM turns JOIN speakers USING (conv_id) LEFT JOIN openings USING (conv_id)
), placed AS (
  SELECT *, CAST(length(opening) + sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, speaker, segment ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM written
)
SELECT conv_id, speaker, segment, count(*) AS n_turns,
  min(opening) || string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY place)
    FILTER (WHERE own), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, speaker, segment
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)]), 0) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM usable WHERE vec_id % 100 = 0) a
  JOIN usable b ON len(a.e) = len(b.e) AND (a.label <> b.label OR a.vec_id <> b.vec_id)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
    ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digests(line_dedup.without_shared_lines(docs, min_docs=10, keep_first=False))


OP13_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS s
  FROM documents
), keyed AS (
  SELECT doc, doc_id, line, place, regexp_replace(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k
  FROM (SELECT doc, doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS place FROM split)
), shared AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(shared.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (shared.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared ON shared.k = keyed.k GROUP BY doc, doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_main_text": op2_main_text,
        "op3_toxicity": op3_toxicity,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_language_model": op5_language_model,
        "op6_embedding_links": op6_embedding_links,
        "op7_pack": op7_pack,
        "op8_secrets": op8_secrets,
        "op9_perspectives": op9_perspectives,
        "op10_quality": op10_quality,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1_SQL,
        "op4_near_duplicates": OP4_SQL,
        "op6_embedding_links": OP6_SQL,
        "op9_perspectives": OP9_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op13_line_dedup": OP13_SQL,
    }
