"""Scratch tables and Arrow batches of this subpackage's operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

from lodestar.plans import stored
from lodestar.plans.stored import partitions, positions, shared_root

#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of the session by bytes: by rows alone, ten thousand long texts would make one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class Scratch(stored.Scratch):
    """A scratch folder of an operator that sends Arrow batches to Python."""

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        super().__init__(spark, label)


def rows(batches, size: int):
    """Slices of at most ``size`` rows, so that a batch of long texts is worked off in bounded steps."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from one sequence for each field of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


__all__ = ["Scratch", "batch", "bound_batches", "partitions", "positions", "rows", "shared_root"]
