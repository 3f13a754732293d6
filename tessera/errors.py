"""Errors the engine raises on purpose, and those it translates."""

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

#: What an action may raise: Spark's own conditions, and Java exceptions that have none.
SPARK_ERRORS = (PySparkException, Py4JJavaError)


class TesseraError(Exception):
    """Base of all errors below."""


class QueryError(TesseraError):
    """A statement that cannot be lexed, parsed, bound or evaluated."""


class SchemaError(TesseraError):
    """A schema, table file or input row that breaks the data model."""
