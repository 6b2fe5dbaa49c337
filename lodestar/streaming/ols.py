"""Regression over event-time windows of a stream.

The sums that least squares needs are mergeable, so a streaming aggregation
keeps them for each window and key, with state of a fixed size, and a window's
coefficients are an expression of its sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_regression(events: DataFrame, time_col: str, x_col: str, y_col: str, window: str, slide: str | None = None, watermark: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The regression of ``y_col`` on ``x_col`` in each window (tumbling, or sliding by ``slide``) and for each value of ``keys``.

    Works on batch and streaming DataFrames alike; on a stream ``watermark``
    bounds how late a row may be. Columns: ``window_start, window_end``, the
    keys, ``n_samples, slope, intercept, r_squared``. Rows with a null in
    either number don't count; a window whose covariate is constant has nulls.
    """
    source = events.withWatermark(time_col, watermark) if watermark else events
    x, y = F.col(f"`{x_col}`").cast("double"), F.col(f"`{y_col}`").cast("double")
    whole = x.isNotNull() & y.isNotNull()
    span = F.window(F.col(f"`{time_col}`"), window, slide) if slide else F.window(F.col(f"`{time_col}`"), window)
    grouped = source.where(whole).groupBy(span.alias("span"), *[F.col(f"`{k}`") for k in keys])
    fitted = grouped.agg(F.count("*").alias("n_samples"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"))
    edges: list[Column] = [F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end")]
    return fitted.select(*edges, *[F.col(f"`{k}`") for k in keys], "n_samples", "slope", "intercept", "r_squared")
