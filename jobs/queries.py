"""The jobs as registered queries: each runs its function twice into one new folder and returns what stands there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import sql as s
from gridloom.sources.shared import shared_dir
from jobs import scene_products, stage_segments


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_scene_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "scene_products")
    for _ in range(2):
        scene_products.run(spark, f"{sf_dir}/embeddings.parquet", out)
    health = scene_products.read_health(spark, out)
    return scene_products.read_products(spark, out).join(health, ["strip", "look"])


def job2_stage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "stage_segments")
    for _ in range(2):
        stage_segments.run(spark, f"{sf_dir}/documents.parquet", out)
    return stage_segments.segments(spark, out).select("batch", "volume", "doc_id", "revision", "name", "byte_len", "blocks", "lba", "sha256")


QUERIES = {f.__name__: f for f in (job1_scene_products, job2_stage_segments)}

ORACLE_SQL = {
    "job1_scene_products": f"""
        WITH image AS ({s.image("l1")}), blocks AS (
            SELECT row // 64 AS look, CAST(row % 64 // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, CAST(sum(mag) AS DOUBLE) / 16 AS mag FROM image GROUP BY ALL
        ), health AS (
            SELECT row // 64 AS look, CAST(max(mag) AS INTEGER) AS peak, CAST(sum(mag) AS DOUBLE) / count(*) AS mean,
                   100.0 * CAST(count(*) FILTER (mag >= 65535) AS DOUBLE) / count(*) AS saturated_pct, 100.0 * CAST(count(*) FILTER (mag > 0) AS DOUBLE) / count(*) AS nonzero_pct
            FROM image GROUP BY ALL
        )
        SELECT look // 16 AS strip, look, row, col, mag, CAST(least(255, floor(mag * 255 / 4096)) AS INTEGER) AS grey, peak, mean, saturated_pct, nonzero_pct
        FROM blocks JOIN health USING (look)
    """,
    "job2_stage_segments": """
        WITH texts AS (
            SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS byte_len FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sha256) AS revision, CAST((doc_id % 8 + 8) % 8 AS INTEGER) AS volume,
                   greatest(1, CAST(ceil(byte_len / 512.0) AS BIGINT)) AS blocks FROM texts
        )
        SELECT CAST(0 AS BIGINT) AS batch, volume, doc_id, revision, rpad('seg_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(10, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0'), 32, ' ') AS name, byte_len, blocks,
               CAST(8 + coalesce(sum(blocks) OVER (PARTITION BY volume ORDER BY doc_id, revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lba, sha256
        FROM numbered
    """,
}
