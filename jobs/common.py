"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def configured(kind: type, path: str | None):
    """The job's settings: the defaults of ``kind`` under those of the TOML file. What it does not know is an error."""
    given = {}
    if path:
        with open(path, "rb") as f:
            given = tomllib.load(f)
    if unknown := given.keys() - {f.name for f in fields(kind)}:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return kind(**given)


def command_line(doc: str, paths: dict[str, str], kind: type[dataclass], run: Callable, config: str) -> None:
    """Parses the paths and the settings, makes a session, runs the job in it, and stops it. The folder that the machines share is the one in
    ``spark.checkpoint.dir``, as spark-submit sets it."""
    parser = argparse.ArgumentParser(description=doc)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), config), help="settings (TOML)")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    settings = configured(kind, given.config)
    spark = SparkSession.builder.appName(os.path.splitext(config)[0]).getOrCreate()
    try:
        run(spark, *(getattr(given, n) for n in paths), settings)
    finally:
        spark.stop()


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` below ``path``, partitioned; of the partitions there, those that it has rows of are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
