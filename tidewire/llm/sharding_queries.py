"""``op6_sharding`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.registry import query, table
from tidewire.llm.sharding import numbered

SHARDS = 40

# The checksum is computed byte by byte over a table made from its polynomial; the
# generator's state as whole numbers modulo 2^64.
SQL = """
WITH RECURSIVE
checks AS (
  SELECT list_transform(range(256), lambda n:
    list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
),
sums AS (
  SELECT text, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) CROSS JOIN checks
),
digests AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(octet_length(encode(d.text)), 0) + 16 AS size, text_crc32
  FROM documents d LEFT JOIN sums s ON d.text = s.text
),
jumps AS (
  SELECT n, CAST(coalesce(doc_id, 0) AS HUGEINT) + CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END AS state,
         -1::BIGINT AS place, 0::BIGINT AS jump FROM digests
  UNION ALL
  SELECT n, following, jump,
         CAST(floor((jump + 1)::DOUBLE * (2147483648::DOUBLE / ((following >> 33)::BIGINT + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT *, CAST((state::UHUGEINT * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS HUGEINT) AS following
        FROM jumps WHERE jump < 41)
),
placed AS (
  SELECT n, max(place) FILTER (WHERE place < 40)::INTEGER AS shard, max(place) FILTER (WHERE place < 41)::INTEGER AS grown_shard
  FROM jumps GROUP BY n
),
keyed AS (
  SELECT *, CAST((CAST(coalesce(doc_id, 0) + CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END AS UHUGEINT)
    * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS HUGEINT) AS key
  FROM digests JOIN placed USING (n)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY
         xor((key >> 32)::BIGINT, coalesce(text_crc32, 0)) >> 20, key, doc_id NULLS LAST, text_crc32 NULLS LAST, size) - 1 AS slot,
       grown_shard
FROM keyed
"""


@query("op6_sharding", SQL)
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in shards 0 to 39 by its id."""
    text = F.col("text").cast("binary")
    digests = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return numbered(digests, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
