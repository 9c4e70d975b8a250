"""Text and Markdown files as notes, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def import_notes(spark: SparkSession, path: str, untitled: str = "Untitled") -> DataFrame:
    """Whole files as (path, title, content); the title is the file's name without its ending."""
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.url_decode("_metadata.file_name").alias("n"), F.col("value").alias("content"))
    title = F.trim(F.regexp_replace("n", r"\.[^.]*$", ""))
    return f.select("path", F.when(title == "", untitled).otherwise(title).alias("title"), "content")


def page_lines(text: str = "text") -> Column:
    """A page's text without empty lines and outer white space."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def export_markdown(notes: DataFrame, path: str) -> None:
    """notes(id, title, content) as Markdown, one folder for each id; many ids are written in parallel."""
    notes.select("id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "content").alias("value")).write.mode("overwrite").partitionBy("id").text(path)
