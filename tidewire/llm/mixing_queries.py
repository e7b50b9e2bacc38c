"""``op9_mixing`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.mixing import mix
from tidewire.llm.registry import query, table

SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', coalesce('=' || doc_id::VARCHAR, 'null'), coalesce('=' || md5(text), 'null'),
                       coalesce('=' || source, 'null'))) AS same
  FROM documents
),
drawn AS (
  SELECT *, (('0x' || substr(md5(concat_ws('|', 'mix', same, nth::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
            / 4503599627370496::DOUBLE AS u
  FROM (SELECT *, row_number() OVER (PARTITION BY same) - 1 AS nth FROM docs)
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM docs GROUP BY source
),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER stops, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER stops, 0))::DOUBLE AS level
  FROM sources
  WINDOW stops AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
shared AS (SELECT max(level) AS level FROM leveled WHERE NOT level * weight > source_size * 3),
planned AS (
  SELECT source, source_size,
         CASE WHEN l.level * weight > source_size * 3 THEN (source_size * 3)::DOUBLE
              ELSE least(s.level * weight, (source_size * 3)::DOUBLE) END AS target
  FROM leveled l CROSS JOIN shared s
),
fractions AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END::BIGINT AS whole FROM planned
),
rests AS (SELECT *, target - (whole * source_size)::DOUBLE AS rest FROM fractions),
by_size AS (SELECT source, size, count(*)::HUGEINT AS n_rows FROM docs WHERE size > 0 GROUP BY source, size),
levels AS (
  SELECT b.source, size,
         (rest - coalesce(sum(n_rows * size) OVER larger, 0)::DOUBLE)
           / (sum(n_rows * size * size) OVER (PARTITION BY b.source) - coalesce(sum(n_rows * size * size) OVER larger, 0))::DOUBLE AS c
  FROM by_size b JOIN rests r ON b.source IS NOT DISTINCT FROM r.source AND rest > 0
  WINDOW larger AS (PARTITION BY b.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
odds AS (
  SELECT source, greatest(arg_max(c, size), 0::DOUBLE) AS c, max(size) + 1 AS certain
  FROM levels WHERE c * size < 1 GROUP BY source
),
uncertain AS (
  SELECT d.*, o.c, c * size AS p,
         (length(bin(size)) - 1) * 8 + floor(size::DOUBLE * 8 / pow(2, length(bin(size)) - 1))::BIGINT AS class
  FROM drawn d JOIN odds o ON d.source IS NOT DISTINCT FROM o.source AND size > 0 AND size < certain
),
reached AS (
  SELECT source, class,
         floor(any_value(c) * (sum(sum(size)) OVER (PARTITION BY source ORDER BY class))::DOUBLE
           + (('0x' || substr(md5(concat_ws('|', 'mix', 'start', coalesce('=' || source, 'null'))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
             / 4503599627370496::DOUBLE)::BIGINT AS upto
  FROM uncertain GROUP BY source, class
),
samples AS (
  SELECT source, class, upto - coalesce(lag(upto) OVER (PARTITION BY source ORDER BY class), 0) AS n FROM reached
),
sampled AS (
  SELECT same, nth,
         row_number() OVER (PARTITION BY u.source, u.class ORDER BY (u / (1 - u)) / (p / (1 - p)), same, nth) <= n AS taken
  FROM uncertain u JOIN samples s ON u.source IS NOT DISTINCT FROM s.source AND u.class = s.class
  WHERE p > 0
)
SELECT d.doc_id, d.size, source_size, target,
       (whole + CASE WHEN d.size >= o.certain OR s.taken THEN 1 ELSE 0 END) * d.size AS taken
FROM drawn d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN odds o ON d.source IS NOT DISTINCT FROM o.source
LEFT JOIN sampled s ON d.same = s.same AND d.nth = s.nth
"""


@query("op9_mixing", SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
