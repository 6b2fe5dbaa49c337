"""Tables written down once, in the folder that the whole cluster shares.

What is needed twice is written as Parquet and read back. That cuts the
lineage, so a lost executor costs one re-read and no recompute, and it gives
Catalyst the true size of small tables, which is how joins against them turn
into broadcasts only when they really are small.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_roots: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    If the setting is absent a temporary folder serves, but only where driver
    and executors are one process (master ``local``); a cluster without the
    setting is an error, since executors would not see the driver's files.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    for owner, known in _roots:
        if owner is spark:
            return known
    root = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    _roots.append((spark, root))
    return root


class Scratch:
    """A private subfolder of the shared folder; removed on ``drop``, or when Python exits, as results may still read from it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark).rstrip('/')}/lodestar-{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()
        atexit.unregister(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or the whole folder."""
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as error:  # the session may be gone at exit
            if name:
                raise RuntimeError(f"cannot delete scratch table {name}") from error


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """Rows of ``df``, stored in sorted ranges, with their ``_place``: range and number in it."""
    number = partitions(df.sparkSession)
    return scratch.write(df.repartitionByRange(number, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), name)


def numbered(stored: DataFrame) -> DataFrame:
    """Rows of ``ranges`` with their ``position`` from 0 in the order of all.

    Only the number of rows of each range, a row for each task, is summed up in one task.
    """
    of = F.shiftright("_place", 33)
    sizes = stored.groupBy(of.alias("_range")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))  # at most as many rows as ranges
    placed = stored.join(F.broadcast(starts), of == F.col("_range"))
    return placed.select(*[F.col(f"`{c}`") for c in stored.columns if c != "_place"], (F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias("position"))


def positions(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """Rows of ``df``, stored, with their ``position`` from 0 in the order of all."""
    return numbered(ranges(df, order, scratch, name))
