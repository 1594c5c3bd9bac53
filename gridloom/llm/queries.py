"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import htmltext, infill, langid, lmscore, mixing, neardup, outliers, packing, pii, quality, topk, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op2(spark, table(spark, sf_dir, "embeddings"))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.op3(spark, table(spark, sf_dir, "documents"))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.op4(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op5(spark, table(spark, sf_dir, "documents"))


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6(spark, table(spark, sf_dir, "documents"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op7(spark, table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.op9(spark, table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op10(spark, table(spark, sf_dir, "documents"))


def op11_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op11(spark, table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.op12(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_threshold_topk,
        op3_robust_outliers,
        op4_cross_entropy,
        op5_harmonic_packing,
        op6_pfair_mixing,
        op7_dart_minhash,
        op8_quality_classifier,
        op9_html_extraction,
        op10_language_id,
        op11_candidate_boosting,
        op12_fill_in_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_threshold_topk": """
        WITH usable AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(greatest(-4503599627370496, least(4503599627370496, floor(1024 * CAST(x AS DOUBLE)))) AS HUGEINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(greatest(-9223372036854775808, least(9223372036854775807, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b))) AS BIGINT) AS score
            FROM (SELECT vec_id, min(v) AS v FROM usable GROUP BY vec_id) q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op7_dart_minhash": r"""
        WITH RECURSIVE texts AS (
            SELECT DISTINCT CAST(doc_id AS BIGINT) AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), once AS (
            SELECT row_number() OVER (ORDER BY text) AS k, min(id) AS rep, text FROM texts GROUP BY text
        ), split AS (
            SELECT k, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM once
        ), placed AS (
            SELECT k, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM split WHERE len(w) > 0
        ), shingles AS (
            SELECT k, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS n FROM placed GROUP BY ALL
        ), sizes AS (
            SELECT k, sum(n) AS n FROM shingles GROUP BY k
        ), shared AS (
            SELECT x.k AS a, y.k AS b, sum(least(x.n, y.n)) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.k < y.k GROUP BY x.k, y.k
        ), near AS (
            SELECT p.rep AS u, q.rep AS v
            FROM shared JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b JOIN once p ON p.k = a JOIN once q ON q.k = b
            WHERE CAST(shared.n AS DOUBLE) / CAST(x.n + y.n - shared.n AS DOUBLE) >= CAST(0.8 AS DOUBLE)
        ), edges AS (
            SELECT u, v FROM near UNION SELECT v, u FROM near
            UNION SELECT t.id, o.rep FROM texts t JOIN once o ON o.text = t.text
            UNION SELECT o.rep, t.id FROM texts t JOIN once o ON o.text = t.text
        ), reach AS (
            SELECT id, id AS other FROM texts UNION SELECT r.id, e.v FROM reach r JOIN edges e ON e.u = r.other
        ), named AS (
            SELECT id, min(other) AS class_id FROM reach GROUP BY id
        )
        SELECT CAST(d.doc_id AS BIGINT) AS doc_id, coalesce(n.class_id, CAST(d.doc_id AS BIGINT)) AS class_id
        FROM documents d LEFT JOIN named n ON n.id = d.doc_id WHERE d.doc_id IS NOT NULL
    """,
    "op12_fill_in_middle": """
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
        ), units AS (
            SELECT doc_id, t, string_split(t, chr(10)) AS l,
                   CASE WHEN t = '' THEN 0 WHEN ends_with(t, chr(10)) THEN len(string_split(t, chr(10))) - 1 ELSE len(string_split(t, chr(10))) END AS n,
                   CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
                   CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
            FROM texts
        ), ranks AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS r1, greatest(h1 % (n + 1), h2 % (n + 1)) AS r2,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM units
        ), ends AS (
            SELECT *, CASE WHEN r1 = 0 THEN 0 WHEN r1 = n THEN length(t) ELSE length(array_to_string(l[1:r1], chr(10))) + 1 END AS a,
                   CASE WHEN r2 = 0 THEN 0 WHEN r2 = n THEN length(t) ELSE length(array_to_string(l[1:r2], chr(10))) + 1 END AS b
            FROM ranks
        ), parts AS (
            SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM ends
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
}
