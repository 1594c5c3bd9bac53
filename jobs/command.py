"""What both jobs' command lines share: a config file read by Spark, a session made and stopped, a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def configured(default, text: str):
    """default with the values of a JSON object; an unknown name is an error."""
    given = json.loads(text)
    known = {f.name for f in fields(default)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(default, **given)


def main(run: Callable, default, about: str, args: list[str] | None = None) -> None:
    """Reads the paths and the config file (a path that Spark reads) and calls run(spark, source, out, config)."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("source", help="path of the input table")
    p.add_argument("out", help="folder of the output")
    p.add_argument("--config", help="JSON file with settings; without it the defaults hold")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about).getOrCreate()
    try:
        config = configured(default, spark.read.text(a.config, wholetext=True).first()["value"]) if a.config else default
        run(spark, a.source, a.out, config)
    finally:
        spark.stop()
