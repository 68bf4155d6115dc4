"""Tables of a folder as views, in the formats that Spark reads, and sinks for answers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: File formats by suffix.
FORMATS = ("parquet", "orc", "csv", "json")


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """The table at path; its suffix names the format, without one it is parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    kind = kind if kind in FORMATS else "parquet"
    defaults = {"header": True, "inferSchema": True} if kind == "csv" else {}
    return spark.read.options(**(defaults | options)).format(kind).load(path)


def register_tables(spark: SparkSession, folder: str, names: Iterable[str], suffix: str = "parquet") -> None:
    for n in names:
        read_table(spark, f"{folder.rstrip('/')}/{n}.{suffix}").createOrReplaceTempView(n)


def write_answer(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(kind).save(path)
