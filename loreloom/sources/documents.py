"""Sources and sinks of documents: commented JSON, snapshot partitions, event logs."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loreloom.functions.documents import object_text


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON files with comments, one document each, typed by ``schema``.

    A missing path gives an empty table of that schema; a document that cannot be read
    gives a row of nulls.
    """
    try:
        reader = spark.read.schema(schema).option("multiLine", True).option("allowComments", True)
        return reader.option("mode", "PERMISSIVE").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``path`` and ``doc``: the clean object of each, keys in the order written."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.input_file_name().alias("path"), object_text(F.col("value")).alias("doc"))


def write_snapshot(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Write whole partitions (say session and snapshot); others of the table stay.

    The mode is set for this write only, and the rows of a partition are brought together
    first, so a partition is few files.
    """
    (
        rows.repartition(*partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str, **where: str) -> DataFrame:
    """Rows of the snapshot partitions that ``where`` names; others are never listed as input."""
    rows = spark.read.parquet(path)
    for column, value in where.items():
        rows = rows.where(F.col(column) == value)
    return rows


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a log (activities, prompts, events)."""
    rows.write.mode("append").parquet(path)


def load_or_create(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none it is built and written first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def clear_log(spark: SparkSession, path: str) -> bool:
    """Remove a log with all its rows; whether there was one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def save_documents(leaf_rows: DataFrame, key: list[str], path: str) -> None:
    """Leaves as documents again: one JSON line of the top-level fields for each ``key``, lists packed from their places.

    A document's leaves meet in one row, as it is written as one.
    """
    entry = F.struct(F.col("path"), F.col("ord") if "ord" in leaf_rows.columns else F.array().cast("array<int>").alias("ord"), F.col("value"))
    gathered = leaf_rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(entry["ord"].alias("ord"), entry["path"].alias("path"), entry["value"].alias("value")))).alias("leaves"))
    gathered.select(*key, packed_document(F.col("leaves")).alias("doc")).write.mode("overwrite").parquet(path)


def packed_document(leaves: Column) -> Column:
    """Leaves (``path``, ``value``) as one JSON document; keys 0, 1, 2 and so on of one parent are a list."""

    @F.pandas_udf("string")
    def pack(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else json.dumps(_packed([(list(x["path"]), x["value"]) for x in r]), ensure_ascii=False))

    return pack(leaves)


def _packed(leaves: list[tuple[list[str], str | None]]) -> object:
    root: dict = {}
    for path, value in leaves:
        plain = {"{}": {}, "[]": []}.get(value, value) if value is not None else None
        if not path:
            return plain
        at = root
        for step in path[:-1]:
            at = at.setdefault(step, {})
        at[path[-1]] = plain

    def closed(node: object) -> object:
        if not isinstance(node, dict) or not node:
            return node
        if list(node) == [str(i) for i in range(len(node))]:
            return [closed(v) for v in node.values()]
        return {k: closed(v) for k, v in node.items()}

    return closed(root)
