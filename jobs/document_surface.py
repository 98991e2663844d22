"""Batch job: documents that lie outside the surface around most documents.

Each text becomes a point: logarithms of its length, of the mean length of its words and of
its mean line length. The cloud is centred and scaled, an implicit surface is fitted to it
with a Sobolev ridge, and every document gets its residual, soft weight and signed distance.
Usual texts lie within the surface or near it; texts of odd shape (tables, lists of names, junk) lie
outside, with large positive distances. The scores are written by source, replacing the folders of the sources that the input holds; a report a source
compares inliers with the labelled quality.

    python -m jobs.document_surface --documents DIR --labels DIR --out DIR [--config FILE]

Defined cases: a null text is empty, a null or empty source is the null part; documents without
a label, or with a null one, are left out of the confusion counts only; of several labels the largest counts.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import log, main, settings
from sphaera.functions.basis import harmonic_terms
from sphaera.functions.portable import hazen, quantised
from sphaera.functions.shared import work_path
from sphaera.operators import linalg, score
from sphaera.sources import clouds

CONFIG = "document_surface.json"
#: Decimals of the numbers that are written.
DIGITS = 9
SCORES = "point_id bigint, x double, y double, z double, r double, soft double, sdf double, inlier boolean, good boolean, source string"


def features(docs: DataFrame) -> DataFrame:
    """point_id, source and x, y, z of every document, by functions that stay in generated code."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    without = lambda c: (1 + n - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    x, y, z = F.log(1.0 + n), F.log(1.0 + n / without(" ")), F.log(1.0 + n / without("\n"))
    return docs.select(F.col("doc_id").cast("long").alias("point_id"), F.nullif("source", F.lit("")).alias("source"), x.alias("x"), y.alias("y"), z.alias("z"))


def _report(scores: DataFrame, percents: list[float]) -> DataFrame:
    """A row per source: points, inliers, mean square, percentiles of the residual, confusion of inliers with good documents."""
    part = scores.withColumn("part", F.coalesce("source", F.lit("")))
    square = F.col("r") * F.col("r")
    sums = part.groupBy("part").agg(F.count("*").alias("n_points"), F.count_if("inlier").alias("n_inliers"), quantised(F.avg(square), DIGITS).alias("mse_all"))
    counted = score.confusion(part, F.col("good"), F.col("inlier"), ["part"])
    return sums.join(counted, "part").join(hazen(part, ["part"], "r", percents), "part", "left").withColumnRenamed("part", "source")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Rows read and written."""
    config = config or settings(spark, None, CONFIG)
    path = work_path(spark, "surface-features")
    points = features(spark.read.parquet(documents))
    points.write.parquet(path)  # texts are read once
    points = spark.read.schema(points.schema).parquet(path)
    read = points.count()
    log.info("read %d documents of %s", read, documents)
    cloud, terms = clouds.normalised(points), harmonic_terms(config["order"])
    beta = linalg.fit(cloud, terms, config["strength"], config["order"])
    if not read:  # the tables are written, without rows
        beta = [0.0] * len(terms)
    if beta is None:
        raise ValueError("the documents don't determine a surface; set a strength above 0")
    log.info("surface of order %d: %s", config["order"], [round(float(b), 6) for b in beta])
    scored = score.with_distance(score.with_residual(cloud, terms, beta, config["threshold"], config["sigma"]), terms, beta)
    truth = spark.read.parquet(labels).groupBy(F.col("doc_id").cast("long").alias("__doc")).agg((F.max("quality") == 1).alias("good"))
    scored = scored.join(truth, F.col("point_id") == F.col("__doc"), "left")
    # sums differ in their last digits with the order of tasks; what is written is the same in every run
    kinds = [c.split() for c in SCORES.split(", ")]
    scored.select(*[quantised(F.col(c), DIGITS).alias(c) if t == "double" else F.col(c) for c, t in kinds]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{out}/scores")
    scores = read_scores(spark, out)
    _report(scores, config["percents"]).write.mode("overwrite").json(f"{out}/report")
    written = scores.count()
    log.info("%s/scores holds %d rows, %s/report %d", out, written, out, read_report(spark, out, config["percents"]).count())
    return {"read": read, "written": written}


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCORES).parquet(f"{out}/scores")


def read_report(spark: SparkSession, out: str, percents: list[float]) -> DataFrame:
    shares = ", ".join(f"p{p:g} double".replace(".", "_") for p in percents)
    schema = f"source string, n_points bigint, n_inliers bigint, mse_all double, tp bigint, fp bigint, fn bigint, tn bigint, precision double, recall double, f1 double, {shares}"
    return spark.read.schema(schema).json(f"{out}/report")


def read_all(spark: SparkSession, out: str, percents: list[float]) -> DataFrame:
    """Scores with their source's report beside them."""
    report = read_report(spark, out, percents).withColumnRenamed("source", "part")
    return read_scores(spark, out).join(report, F.coalesce("source", F.lit("")) == F.col("part"), "left").drop("part")


if __name__ == "__main__":
    main("document_surface", __doc__.splitlines()[0], run, ["documents", "labels", "out"], CONFIG)
