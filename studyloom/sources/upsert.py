"""Sinks as plans: the new contents of a table after a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new are added, once each."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of equal key; others are added."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows)


def update_if_version(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """changes(key, expected, value): the column and version + 1 where the version is the expected one; other changes are lost."""
    c = changes.select(F.col(key), F.col("expected").alias("version"), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    j = table.join(c, [key, "version"], "left")
    hit = F.coalesce("__hit", F.lit(False))
    return j.withColumn(column, F.when(hit, F.col("__value")).otherwise(F.col(column))).withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version"))).select(*table.columns)


def replace_parents(table: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents that occur in rows are replaced."""
    return table.join(rows.select(parent).distinct(), parent, "left_anti").select(*table.columns).unionByName(rows)


def changed(sources: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Sources without a stored row of equal key and digest: what an incremental refresh has to do."""
    return sources.join(stored.select(key, digest), [key, digest], "left_anti")


def cascade(table: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children whose parent was deleted go with it."""
    return table.join(deleted.select(key).distinct(), key, "left_anti").select(*table.columns)


def orphans(files: DataFrame, used: DataFrame, path: str) -> DataFrame:
    """Files that no row refers to any more."""
    return files.join(used.select(path).distinct(), path, "left_anti")


def page_of(table: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page of a listing in total order."""
    return table.orderBy(*order).offset(offset).limit(size)
