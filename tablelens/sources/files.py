"""Metadata documents in files: one document per file, in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.codec import dumps
from tablelens.model import TableMetadata
from tablelens.operators.frames import parse_documents, tables_of


def read_metadata(spark: SparkSession, path: str, table: str, dialect: str = "reference") -> DataFrame:
    """A table of all documents in the files of a path (see frames.TABLES)."""
    return tables_of(spark.read.text(path, wholetext=True), "value", table, dialect)


def check_metadata(spark: SparkSession, path: str, dialect: str = "reference") -> DataFrame:
    """(file, table_uuid, error) of each file of a path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return parse_documents(files, "file", "value", dialect).select("file", "table_uuid", "error")


def write_metadata(spark: SparkSession, documents: list[TableMetadata], path: str, dialect: str = "reference") -> None:
    """Writes documents from the driver, one a line and file."""
    rows = [(dumps(d, dialect),) for d in documents]
    spark.createDataFrame(rows, "value string").repartition(max(1, len(rows))).write.text(path)


def write_documents(texts: DataFrame, column: str, path: str) -> None:
    """Writes documents that a DataFrame holds as text, one a line, where they are."""
    texts.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).write.text(path)
