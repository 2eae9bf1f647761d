"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm import decontaminate_fm, line_templates, lm_backoff, mix_poisson, quality_fertility, simhash_vptree, token_output, toxicity_segments, url_filter, warc_revisit
from vecgrove.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_backoff.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_oov", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op2_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fertility.quality(table(spark, sf_dir, "documents"))


def op3_mix_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mix_poisson.replicate(table(spark, sf_dir, "documents"))
    return copies.select("row.doc_id", "row.source", F.col("mix_copies").alias("copies"), F.col("mix_copy").alias("copy"), F.md5(F.coalesce("row.text", F.lit(""))).alias("text_md5"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_decontaminate_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate_fm.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"))


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_templates.dedup(table(spark, sf_dir, "documents"))
    return lines.select("row.doc_id", "n_lines", "n_dropped", F.md5("kept_text").alias("kept_md5"))


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_segments.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity_segments.predicted(scored)


_QUERIES = (
    op1_lm_backoff, op2_quality_fertility, op3_mix_poisson, op4_url_filter, op5_decontaminate_fm,
    op6_token_sstable, op7_simhash_vptree, op8_line_templates, op9_warc_revisit, op10_toxicity_segments,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h,
    array_to_string(list_transform(range(0, 32), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4))) & 31)::bigint, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS original
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original = page_id THEN NULL ELSE original END AS refers_to
FROM d
"""

LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), m AS (
  SELECT doc_id, pos, line, regexp_replace(trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM l
), t AS (
  SELECT doc_id, pos, line, m, len(string_split(m, ' ')) AS size, array_to_string(string_split(m, ' ')[1:3], ' ') AS lead FROM m WHERE m <> ''
), need AS (
  SELECT size, greatest(least(10, greatest(2, ceil(100 / size::double)::int)), CASE WHEN size < 20 THEN ceil(0.000001::double * (SELECT count(*) FROM documents))::int ELSE 0 END) AS needed
  FROM (SELECT DISTINCT size FROM t)
), leaf AS (
  SELECT size, lead FROM t JOIN need USING (size) GROUP BY size, lead, needed HAVING count(DISTINCT doc_id) >= needed
), kind AS (
  SELECT t.size, t.lead, m, count(DISTINCT doc_id) >= needed AS again FROM t JOIN leaf USING (size, lead) JOIN need USING (size) GROUP BY t.size, t.lead, m, needed
), stands AS (
  SELECT size, lead, m, count(*) AS weight FROM (SELECT size, lead, doc_id, arg_min(m, pos) AS m FROM t JOIN leaf USING (size, lead) GROUP BY size, lead, doc_id) GROUP BY size, lead, m
), pair AS (
  SELECT size, lead, m, unnest(range(3, size)) AS i, string_split(m, ' ') AS w FROM kind
), weighed AS (
  SELECT p.size, p.lead, p.m, i, w[i] AS a, w[i + 1] AS b, coalesce(weight, 0) AS weight FROM pair p LEFT JOIN stands s ON s.size = p.size AND s.lead = p.lead AND s.m = p.m
), constant AS (
  SELECT size, lead, i, a, b FROM weighed JOIN need USING (size) GROUP BY size, lead, i, a, b, needed HAVING sum(weight) >= needed
), follows AS (
  SELECT size, lead, m FROM weighed JOIN constant USING (size, lead, i, a, b) GROUP BY size, lead, m HAVING count(*) >= 0.6 * (size - 3)
), template AS (
  SELECT size, lead, m FROM kind WHERE again UNION SELECT size, lead, m FROM follows
), gone AS (
  SELECT m.doc_id, m.pos, m.line, template.m IS NOT NULL AS gone FROM m LEFT JOIN t ON t.doc_id = m.doc_id AND t.pos = m.pos
  LEFT JOIN template ON template.size = t.size AND template.lead = t.lead AND template.m = t.m
), kept AS (
  SELECT doc_id, count(*)::bigint AS n_lines, sum(gone::int)::bigint AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, md5(CASE WHEN d.text IS NOT NULL THEN kept END) AS kept_md5
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lm_backoff": lm_backoff.ORACLE_SQL,
        "op3_mix_poisson": mix_poisson.ORACLE_SQL,
        "op8_line_templates": LINES_SQL,
        "op9_warc_revisit": WARC_SQL,
    }
