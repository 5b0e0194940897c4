"""Readers of text and delimited files, through Spark only, so any store that it reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import checks
from helixframe.operators.association import from_matrix
from helixframe.operators.cleaning import na_to_null


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header: tab for ``.tsv``, comma otherwise; all columns strings, missing values null."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    return na_to_null(spark.read.option("header", True).option("sep", sep).option("multiLine", False).csv(path))


def read_lines(spark: SparkSession, path: str | None, column: str = "value", need_some: bool = False) -> DataFrame | None:
    """(pos, column): non-blank lines, stripped, numbered from 0 in file order; no path, no table."""
    if not path:
        return None
    stripped = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias(column)).where(F.length(column) > 0)
    if need_some and stripped.isEmpty():
        raise ValueError(f"no lines in {path}")
    # Numbering lines by file order is what zipWithIndex does: one count per partition, no shuffle.
    numbered = stripped.rdd.zipWithIndex().map(lambda r: (r[1], r[0][0]))
    return spark.createDataFrame(numbered, f"pos long, {column} string")


def read_sequences_text(spark: SparkSession, path: str) -> DataFrame:
    """(pos, seq) of a file with a sequence per line."""
    return read_lines(spark, path, "seq", need_some=True)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, seq) of a file with columns ``id`` and ``seq``."""
    df = read_any(spark, path)
    checks.columns(df, "id", "seq")
    return df.select(F.col("id").cast("string").alias("sample_id"), F.col("seq").cast("string").alias("seq"))


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent), headers in any case."""
    df = _lower(read_any(spark, path))
    checks.columns(df, "child", "parent")
    return df.select("child", "parent")


def read_disease_terms(spark: SparkSession, path: str) -> DataFrame:
    """(disease, term), headers in any case, rows without a disease left out."""
    df = _lower(read_any(spark, path))
    checks.columns(df, "disease", "term")
    return df.select("disease", "term").where("disease is not null")


def group_terms(rows: DataFrame) -> DataFrame:
    """(disease, terms): each disease's terms as a sorted array, null terms left out."""
    return rows.where("disease is not null").groupBy("disease").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(lnc, disease, value) of a labelled matrix; the first column names the rows."""
    return from_matrix(read_any(spark, path))
