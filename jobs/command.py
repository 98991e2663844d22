"""What the command lines share: arguments, logging, a session of their own."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str | None, default: str) -> dict:
    """A JSON object from any store that Spark reads; without a path the file beside the job."""
    path = path or "file://" + os.path.join(os.path.dirname(os.path.abspath(__file__)), default)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def main(name: str, about: str, run: Callable, paths: list[str], default: str) -> None:
    """Runs run(spark, *paths, settings) in a session that starts and stops here."""
    parser = argparse.ArgumentParser(description=about)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help=f"JSON file, {default} if there is none")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *[getattr(given, p) for p in paths], settings(spark, given.config, default))
    finally:
        spark.stop()
