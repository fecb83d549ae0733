"""What the jobs share: the config file, the command line, tables by path."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def table(spark: SparkSession, path: str, schema: str, *partition_by: str) -> DataFrame:
    """The table at path, which is made (without rows) if it is not there yet."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def replace_partitions(rows: DataFrame, path: str, *partition_by: str) -> None:
    """The partitions that rows have give way to them; all others stay. Run again with the same rows, it leaves the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def command_line(about: str, config: Path, run: Callable[..., Any]) -> None:
    """Settings come from the config file; each can be given on the command line as well (--input PATH). Creates the session, runs, and stops it."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", default=str(config), help="JSON file of settings")
    known, rest = parser.parse_known_args()
    settings = json.loads(Path(known.config).read_text())
    more = argparse.ArgumentParser(description=about)
    for name, value in settings.items():
        more.add_argument(f"--{name.replace('_', '-')}", dest=name, type=json.loads if isinstance(value, (list, bool)) else type(value) if value is not None else str, default=value)
    settings = vars(more.parse_args(rest))
    spark = SparkSession.builder.appName(config.stem).getOrCreate()
    try:
        log.info("%s: %s", config.stem, run(spark, **settings))
    finally:
        spark.stop()
