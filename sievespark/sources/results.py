"""Result tables as JSON lines or CSV: what measurements are written to and reports read from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("json", "csv")
#: CSV has no null: an empty field is one, and the empty string is quoted.
_OPTIONS = {"json": {"ignoreNullFields": "false"}, "csv": {"header": "true", "escape": '"', "nullValue": "", "emptyValue": '""'}}


def _known(kind: str) -> str:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    return kind


def write_results(results: DataFrame, folder: str, kind: str = "json") -> str:
    """Writes a table of results, a file a task, and returns the folder. Floats keep all their digits."""
    results.write.format(_known(kind)).options(**_OPTIONS[kind]).mode("error").save(folder)
    return folder


def read_results(spark: SparkSession, folder: str, schema: str, kind: str = "json") -> DataFrame:
    """The rows of a folder or a file of results; a row that does not fit the schema is an error."""
    options = {"json": {}, "csv": {"header": "true", "escape": '"', "nullValue": "", "emptyValue": ""}}[_known(kind)]
    return spark.read.schema(schema).options(mode="FAILFAST", **options).format(kind).load(folder)
