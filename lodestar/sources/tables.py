"""Tables of a folder of Parquet files, and results as files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators.results import Result


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, which may be a file or a folder of files, on any file system Spark knows."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_results(spark: SparkSession, results: Iterable[Result], path: str, mode: str = "error") -> None:
    """Results of one kind as Parquet, a row each."""
    frames = [r.to_df(spark) for r in results]
    if not frames:
        raise ValueError("no results to write")
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    out.coalesce(1).write.mode(mode).parquet(path)
