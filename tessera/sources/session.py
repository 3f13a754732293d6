"""Session settings for one step, put back afterwards: the session belongs to the caller."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CASE = {"spark.sql.caseSensitive": "true"}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or the warehouse where that is unset: all machines see both."""
    found = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoint"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """path without a file scheme, its folder made."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Set wanted, and put back what was there."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
