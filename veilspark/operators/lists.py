"""Aggregates of lists of worlds, element by element; null elements are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.keyhash import WORLDS


def aggregate_lists(df: DataFrame, groups: dict[str, Column], lists: dict[str, tuple[str, Column]]) -> DataFrame:
    """lists: by output name, (sum, avg, count, min or max; the list column). An element without values is null.

    Narrow as the world aggregates: elements are exploded, summed by (group, place) and collected again.
    """
    names = list(groups)
    base = df.select(*[c.alias(g) for g, c in groups.items()], *[c.alias(f"__l{i}") for i, (_, c) in enumerate(lists.values())])
    zipped = base.withColumn("__z", F.arrays_zip(*[f"__l{i}" for i in range(len(lists))]))
    flat = zipped.select(*names, F.posexplode("__z").alias("__j", "__e")).where(F.col("__j") < WORLDS)
    fns = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.nullif(F.count(c), F.lit(0)).cast("double")}
    by_place = flat.groupBy(*names, "__j").agg(*[fns[k](F.col(f"__e.__l{i}")).alias(n) for i, (n, (k, _)) in enumerate(lists.items())])
    out = by_place.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("__j", F.struct(*lists)))).alias("__w"))  # 64 entries at most
    place = F.sequence(F.lit(0), F.lit(WORLDS - 1))
    return out.select(*names, *[F.transform(place, _at(n)).alias(n) for n in lists])


def _at(name: str):
    return lambda j: F.try_element_at("__w", j)[name].cast("double")
