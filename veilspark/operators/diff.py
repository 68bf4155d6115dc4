"""How much a private answer differs from the exact one."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def utility_diff(private: DataFrame, exact: DataFrame, keys: int) -> DataFrame:
    """Rows matched on the first `keys` columns (on the row number if 0), each number replaced by its error in per cent.

    A row that is missing in the private answer has null keys and errors of 0; one that only it has keeps its keys and
    has null errors. Exactly one null of two is an error of 50. Other types take the private value, or else the exact.
    """
    names = exact.columns
    if private.columns != names:
        private = private.toDF(*names)
    p = private.select(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(names)], F.lit(True).alias("__p"))
    e = exact.select(*[F.col(f"`{c}`").alias(f"__e{i}") for i, c in enumerate(names)], F.lit(True).alias("__e"))
    if keys:
        on = [F.col(f"__p{i}") == F.col(f"__e{i}") for i in range(keys)]
    else:  # by place in the order of all columns, for answers of few rows
        by = lambda c: F.row_number().over(Window.orderBy(*[f"__{c}{i}" for i in range(len(names))]))
        p, e = p.withColumn("__r", by("p")), e.withColumn("__s", by("e"))
        on = [F.col("__r") == F.col("__s")]
    both = p.join(e, on, "full")
    extra, missing = F.col("__e").isNull(), F.col("__p").isNull()
    kinds, out = dict(exact.dtypes), []
    for i, c in enumerate(names):
        x, y, kind = F.col(f"__p{i}"), F.col(f"__e{i}"), kinds[c]
        if i < keys:
            out.append(F.when(~missing, F.when(extra, x).otherwise(y)).alias(c))
        elif kind in _NUMBERS or kind.startswith("decimal"):
            a, b = x.cast("double"), y.cast("double")
            error = 100 * F.abs(b - a) / F.greatest(F.lit(1e-5), F.abs(b))
            cell = F.when(extra, F.lit(None)).when(missing | (a.isNull() & b.isNull()), F.lit(0.0)).when(a.isNull() | b.isNull(), F.lit(50.0)).otherwise(error)
            out.append((F.round(cell) if kind in _NUMBERS[:4] else cell).cast(kind).alias(c))
        else:
            out.append(F.coalesce(x, y).alias(c))
    return both.select(*out)


@dataclass(frozen=True)
class Utility:
    utility: float
    recall: float
    matched: int
    missing: int
    extra: int


def summarise(diff: DataFrame, keys: int, path: str | None = None) -> Utility:
    """Mean error of matched rows over the measures, and recall; appended to a CSV file if a path is given."""
    names = diff.columns
    kinds = dict(diff.dtypes)
    measures = [c for c in names[keys:] if kinds[c] in _NUMBERS or kinds[c].startswith("decimal")]
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in names[:keys]), F.lit(0))
    missing = (nulls == keys) if keys else F.lit(False)
    extra = ~missing & sum((F.col(f"`{c}`").isNull().cast("int") for c in measures), F.lit(0)).cast("int").cast("boolean")
    matched = ~missing & ~extra
    broken = (nulls > 0) & (nulls < keys)
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    r = diff.agg(one(matched).alias("m"), one(missing).alias("x"), one(extra).alias("e"), one(broken).alias("b"), *[F.avg(F.when(matched, F.col(f"`{c}`").cast("double"))).alias(f"u{i}") for i, c in enumerate(measures)]).first()
    if r["b"]:
        raise ValueError("a row has some of its keys null")
    means = [r[f"u{i}"] for i in range(len(measures)) if r[f"u{i}"] is not None]
    seen = r["m"] + r["x"]
    out = Utility(sum(means) / len(means) if means else 0.0, r["m"] / seen if seen else 1.0, r["m"], r["x"], r["e"])
    if path:
        with Path(path).open("a", newline="") as f:
            csv.writer(f).writerow([out.utility, out.recall])
    return out
