"""Queries on recordings as files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..sources.wav import wav_files, write_wav
from .adapters import table


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as recordings, 40 to each, of 8, 16 or 24 bits or floats by turns."""
    e = table(spark, sf_dir, "embeddings").select((F.expr("vec_id div 40")).alias("call"), "vec_id", F.col("embedding").cast("array<float>").alias("e"))
    parts = e.groupBy("call").agg(F.array_sort(F.collect_list(F.struct("vec_id", "e"))).alias("p"))  # 40 vectors
    bits = F.element_at(F.array(*map(F.lit, (8, 16, 24, 32))), (F.col("call") % 4 + 1).cast("int"))
    return parts.select(F.concat(F.lit("r"), F.col("call").cast("string")).alias("call_id"), F.lit(8000).alias("sample_rate"), F.flatten(F.transform("p", lambda x: x["e"])).alias("samples"), bits.alias("bits"), (F.col("call") % 4 == 3).alias("floats"))


def wav_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings through files and back: of each block of 700 samples their number and, in 16 bits, their sum, and that of the samples after it. Ranges end anywhere in a block."""
    folder = shared_folder(spark, "wav")
    write_wav(_recordings(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    blocks = wav_files(spark, folder, block=700, split_bytes=1777, task_bytes=256 << 10)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.floor(x.cast("double") * 32768).cast("long"))
    return blocks.filter("error_code IS NULL").select("call_id", "start_sample", F.size("samples").cast("long").alias("n"), total("samples").alias("total"), total("after").alias("after"))


_WAV_SQL = """
WITH s AS (
  SELECT vec_id // 40 AS c, unnest(embedding) AS x, vec_id, unnest(range(0, len(embedding))) AS k FROM embeddings
), i AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY vec_id, k) - 1 AS i, CAST(x AS DOUBLE) AS x, CASE c % 4 WHEN 0 THEN 7 WHEN 1 THEN 15 ELSE 23 END AS b FROM s
), q AS (
  SELECT c, i, CASE WHEN c % 4 = 3 THEN x ELSE least(greatest(floor(x * pow(2, b)), -pow(2, b)), pow(2, b) - 1) / pow(2, b) END AS y FROM i
), w AS (
  SELECT c, i, CAST(floor(y * 32768) AS BIGINT) AS v FROM q
), a AS (
  SELECT c, i - 700 AS i, v FROM w WHERE i >= 700 AND i % 700 < 256
), t AS (
  SELECT c, i // 700 AS j, sum(v) AS after FROM a GROUP BY ALL
), g AS (
  SELECT c, i // 700 AS j, count(*) AS n, sum(v) AS total FROM w GROUP BY ALL
)
SELECT 'r' || CAST(g.c AS VARCHAR) AS call_id, g.j * 700 AS start_sample, g.n, CAST(g.total AS BIGINT) AS total, CAST(coalesce(t.after, 0) AS BIGINT) AS after
FROM g LEFT JOIN t ON t.c = g.c AND t.j = g.j
"""

QUERIES = {"wav_samples": wav_samples}
SQL = {"wav_samples": _WAV_SQL}
