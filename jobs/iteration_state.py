"""Incremental job: solver state of a growing iteration log.

Takes the files that came since the last run (a file stream with a checkpoint), gives every
iteration the best score before it, its gate, score mass, inlier weight and bound on
iterations, and writes them by batch and configuration. What comes late is set aside. A run
without new files changes nothing; a run that failed is made good by the next one.

    python -m jobs.iteration_state --log DIR --out DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jobs.command import log, main, settings
from sphaera.streaming import iteration_state as state

CONFIG = "iteration_state.json"


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Rows read and written by this run, and late ones."""
    config = config or settings(spark, None, CONFIG)
    rule = state.Rule(**config["rule"])
    kinds = {"config": "string", "iter": "bigint", "score": "double", "share": "double"}
    columns = [F.expr(config["columns"][k]).cast(t).alias(k) for k, t in kinds.items()]
    schema = spark.read.parquet(events).schema
    # as a pattern, a path may also be a single file
    parent, _, name = events.rstrip("/").rpartition("/")
    pattern = events if set(name) & set("*?{[") else f"{parent}/{{{name}}}" if parent else f"{{{name}}}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern).select(*columns)
    done = state.follow(stream, out, checkpoint, rule)
    batches = [p["batchId"] for p in done.recentProgress if p["numInputRows"]]
    read = sum(p["numInputRows"] for p in done.recentProgress)
    log.info("read %d rows of %s in %d batches (rows count once for each pass over a batch)", read, events, len(batches))
    own = F.col("batch").isin(batches)
    written = state.read_rows(spark, out).filter(own).count()
    late = state.read_late(spark, out).filter(own).count()
    log.info("wrote %d rows to %s/rows, %d late ones to %s/late", written, out, late, out)
    return {"batches": len(batches), "written": written, "late": late}


if __name__ == "__main__":
    main("iteration_state", __doc__.splitlines()[0], run, ["log", "out", "checkpoint"], CONFIG)
