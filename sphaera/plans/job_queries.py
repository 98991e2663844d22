"""The jobs as queries: each runs twice into one new folder, and what lies there then is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import document_surface, iteration_state
from jobs.command import settings

from ..functions.basis import harmonic_terms, penalty
from ..functions.portable import hazen_sql
from ..functions.shared import work_path
from ..streaming.iteration_state import read_late, read_rows
from .catalogue import _F, _G, RIDGE, SIGMA, THRESH, Q, _fit_ctes, _normal, q


def job1_iteration_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "job1")
    for _ in range(2):
        iteration_state.run(spark, f"{sf_dir}/events.parquet", out, f"{out}-checkpoint")
    rows = read_rows(spark, out).drop("batch").selectExpr("*", "false AS late")
    late = read_late(spark, out).drop("batch").selectExpr("*", "true AS late")
    return q(rows.unionByName(late, allowMissingColumns=True), "score", "share", "best", "mass", "w")


def job2_document_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "job2")
    config = settings(spark, None, document_surface.CONFIG)
    for _ in range(2):
        document_surface.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, config)
    found = document_surface.read_all(spark, out, config["percents"])
    return q(found, *[f for f, t in found.dtypes if t == "double"], digits=5)


_TEXT = "coalesce(text, '')"
_WITHOUT = f"CAST(1 + length({_TEXT}) - length(replace({_TEXT}, {{}}, '')) AS DOUBLE)"
_POINTS = (
    f"SELECT doc_id AS point_id, nullif(source, '') AS source, ln(1.0 + length({_TEXT})) AS x, "
    f"ln(1.0 + length({_TEXT}) / {_WITHOUT.format(chr(39) + ' ' + chr(39))}) AS y, ln(1.0 + length({_TEXT}) / {_WITHOUT.format('chr(10)')}) AS z FROM documents"
)
_NUMBERS = ("x", "y", "z", "r", "soft", "sdf")
_RATIO = "(CASE WHEN tp + {0} = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + {0}) END)"

QUERIES = {"job1_iteration_state": job1_iteration_state, "job2_document_surface": job2_document_surface}
ORACLE_SQL = {
    "job1_iteration_state": f"""
WITH RECURSIVE log AS (
  SELECT event_type AS config, event_id AS iter, value / 500.0 AS score, 0.5 + value / 1000.0 AS share,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events
), b AS (
  SELECT *, greatest(0.13, coalesce(max(score) OVER (PARTITION BY config ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.13)) AS best FROM log
), g AS (
  SELECT *, score >= best * 0.55 AS gate FROM b
), m AS (
  SELECT *, 4.6 + sum(CASE WHEN gate THEN score ELSE 0 END) OVER (PARTITION BY config ORDER BY n) AS mass FROM g
), e AS (
  SELECT config, n, 0.8 * CAST(0.65 AS DOUBLE) + (1 - CAST(0.8 AS DOUBLE)) * share AS w FROM log WHERE n = 1
  UNION ALL
  SELECT l.config, l.n, 0.8 * e.w + (1 - CAST(0.8 AS DOUBLE)) * l.share FROM e JOIN log l ON l.config = e.config AND l.n = e.n + 1
), v AS (
  SELECT m.*, e.w, CAST(2 * ceil(ln(1 - CAST(0.96 AS DOUBLE)) / ln(greatest(2.2250738585072014E-308, least(1 - 1E-12, 1.0 - pow(e.w, 6))))) AS DOUBLE) AS own
  FROM m JOIN e ON m.config = e.config AND m.n = e.n
)
SELECT config, iter, {Q('score')} AS score, {Q('share')} AS share, {Q('best')} AS best, gate, {Q('mass')} AS mass, {Q('w')} AS w,
       least(CAST(2000 AS DOUBLE), min(own) OVER (PARTITION BY config ORDER BY n)) AS max_iter, false AS late
FROM v
""",
    "job2_document_surface": _fit_ctes(RIDGE, penalty(harmonic_terms(2), 2), cloud=_normal(_POINTS, ", source"))
    + f""", sc AS (
  SELECT c.*, abs({_F} - 1.0) AS r, ({_F} - 1.0) / sqrt(greatest(1E-12, {_G[0]}*{_G[0]} + {_G[1]}*{_G[1]} + {_G[2]}*{_G[2]})) AS sdf FROM cloud c, beta
), truth AS (
  SELECT doc_id, max(quality) = 1 AS good FROM labels GROUP BY doc_id
), scored AS (
  SELECT point_id, source, coalesce(source, '') AS part, x, y, z, r, exp(-(r * r) / {2 * SIGMA * SIGMA!r}) AS soft, sdf, r < {THRESH} AS inlier, good
  FROM sc LEFT JOIN truth ON point_id = doc_id
), pct AS ({hazen_sql('scored', 'part', 'r', [50, 95])}), cnt AS (
  SELECT part, count(*) AS n_points, count(*) FILTER (inlier) AS n_inliers, avg(r * r) AS mse_all, count(*) FILTER (good AND inlier) AS tp,
         count(*) FILTER (NOT good AND inlier) AS fp, count(*) FILTER (good AND NOT inlier) AS fn, count(*) FILTER (NOT good AND NOT inlier) AS tn
  FROM scored GROUP BY part
), prf AS (
  SELECT *, {_RATIO.format('fp')} AS precision, {_RATIO.format('fn')} AS recall FROM cnt
)
SELECT point_id, source, {', '.join(f'{Q(c, 5)} AS {c}' for c in _NUMBERS)}, inlier, good, n_points, n_inliers, {Q('mse_all', 5)} AS mse_all, tp, fp, fn, tn,
       {Q('precision', 5)} AS precision, {Q('recall', 5)} AS recall, {Q('2 * precision * recall / greatest(1E-12, precision + recall)', 5)} AS f1,
       {Q('p50', 5)} AS p50, {Q('p95', 5)} AS p95
FROM scored JOIN prf USING (part) JOIN pct USING (part)
""",
}
