"""Worlds over time windows of a stream.

The state has the sums of each unit in a window, not of its worlds; a late row changes them until the watermark passes,
then they are dropped. Each batch adds the sums that it changed to the sink, and the worlds are made of the latest ones
when an answer is released.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.keyhash import Settings
from veilspark.functions.noise import sampled
from veilspark.operators.worlds import Agg, world_lists


def windowed_units(stream: DataFrame, time: str, width: str, late: str, kh: Column, groups: dict[str, Column], value: Column) -> DataFrame:
    """window, groups, unit, n and total: streaming sums of value by window and unit; for output mode `update`."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = rows.select(F.window(time, width).alias("window"), *[c.alias(g) for g, c in groups.items()], kh.alias("unit"), value.cast("double").alias("__v")).where("unit is not null")
    return rows.groupBy("window", *groups, "unit").agg(F.count("__v").alias("n"), F.sum("__v").alias("total"))


def sink(path: str):
    """What each batch does: its sums go to a folder of its own, so a batch that is run again writes the same."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def release(sums: DataFrame, groups: list[str], settings: Settings = Settings()) -> DataFrame:
    """The released count and sum of each window and group, from what the batches have written (with their number, `batch`)."""
    keys = ["window", *groups, "unit"]
    latest = sums.groupBy(*keys).agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select(*keys, "x.n", "x.total")
    lists = world_lists(latest, [F.col("window.start").cast("timestamp_ntz"), *map(F.col, groups)], F.col("unit"), [Agg("n", "sum", F.col("n")), Agg("total", "sum", F.col("total"))], settings)
    n = F.transform("n", lambda x: F.nullif(x, F.lit(0.0)))
    return lists.select(F.col("__g0").alias("start"), *[F.col(f"__g{i}").alias(g) for i, g in enumerate(groups, 1)], F.round(sampled(n, settings, scale=2.0)).cast("long").alias("n"), sampled(F.col("total"), settings, scale=2.0).alias("total"))
