"""What the jobs share: configuration files, sessions of the command line, logging."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import SparkSession

C = TypeVar("C")


def configured(kind: type[C], given: dict[str, Any]) -> C:
    """The configuration with what is given in place of its defaults; unknown names are an error."""
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown settings {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    return kind(**given)


def read_config(spark: SparkSession, kind: type[C], path: str | None) -> C:
    """A JSON file by Spark's reader, so that it may lie where the tables do."""
    if path is None:
        return kind()
    return configured(kind, json.loads(spark.read.text(path, wholetext=True).first()[0]))


def run_from_command_line(name: str, about: str | None, paths: dict[str, str], kind: type[C], work: Callable[..., dict], argv: list[str] | None = None) -> dict:
    """Parse paths and configuration, make a session, do the work and stop the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    for path, told in paths.items():
        parser.add_argument(f"--{path}", required=True, help=told)
    parser.add_argument("--config", help="a JSON file of settings")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = read_config(spark, kind, given.pop("config"))
        return work(spark, *[given[path] for path in paths], config)
    finally:
        spark.stop()
