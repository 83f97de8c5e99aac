"""What the jobs share: settings, logs, paths."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

LOG = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON file of settings, read by Spark: it may lie in any store that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def default_settings(name: str) -> dict:
    """The settings that lie beside a job."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text(encoding="utf-8"))


def command_line(name: str, what: str, work: Callable) -> None:
    """``python -m jobs.<name> --input DIR --output DIR [--config FILE]``: creates the session, does the work, stops it."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=what)
    p.add_argument("--input", required=True, help="folder of the tables")
    p.add_argument("--output", required=True, help="folder to write to; run again with the same one to go on")
    p.add_argument("--config", help=f"JSON settings; jobs/{name}.json if left out")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, args.input, args.output, settings(spark, args.config) if args.config else default_settings(name))
    finally:
        spark.stop()
