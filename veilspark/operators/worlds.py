"""Aggregates over 64 possible worlds: a row is in world j if bit j of its key hash, mixed with the query's, is set.

The narrow plan is the default: rows are summed by (group, key hash), so a unit's rows are one row; then the units of a
group meet and fill its 64 worlds in one pass, a matrix of bits times their sums, with no row for each world. A task
that holds many units of a group sends their 64 sums instead of the units, so a hot group, or the one group of a query
without groups, arrives as a few rows a task. The wide plan has a slot for each world and aggregate, for one or two
aggregates over few groups in one pass on the JVM alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

import veilspark
from veilspark.functions.keyhash import WORLDS, Settings, in_query
from veilspark.functions.noise import sampled

# Tasks carry the package's functions with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(veilspark)


class UnsupportedPrivateType(TypeError):
    """A type that an aggregate can't make private."""


@dataclass(frozen=True)
class Agg:
    """kind: count, sum, avg, min or max; value: None counts rows."""

    name: str
    kind: str
    value: Column | None = None
    distinct: bool = False
    correction: float = 1.0

    def __post_init__(self):
        if self.kind not in ("count", "sum", "avg", "min", "max"):
            raise NotImplementedError(f"unsupported aggregate function {self.kind}")
        if self.correction < 0:
            raise ValueError("the correction must not be negative")

    @property
    def scale(self) -> float:
        """A world has about half of the rows: counts, sums and averages are doubled."""
        return 1.0 if self.kind in ("min", "max") else 2.0


def _check_type(agg: Agg, kind: str) -> None:
    ordered = kind in ("date", "timestamp", "timestamp_ntz")
    number = kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if agg.kind == "count" or number or (ordered and agg.kind in ("min", "max")):
        if not (agg.kind in ("min", "max") and kind == "boolean"):
            return
    raise UnsupportedPrivateType(f"private {agg.kind} not implemented for type {kind}")


def _as_number(value: Column, kind: str) -> Column:
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return value.cast("int").cast("double") if kind == "boolean" else value.cast("double")


def _prepared(df: DataFrame, groups: Sequence[Column], kh: Column, aggs: Sequence[Agg], settings: Settings) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Rows with __k, groups __g0.. and values __v0..; the groups' names, and the values' types by aggregate name."""
    names = [f"__g{i}" for i in range(len(groups))]
    values = [(a.value if a.value is not None else F.lit(1)).alias(f"__v{i}") for i, a in enumerate(aggs)]
    rows = df.select(*[g.alias(n) for g, n in zip(groups, names, strict=True)], in_query(kh, settings).alias("__k"), *values)
    kinds = dict(rows.dtypes)
    types = {a.name: kinds[f"__v{i}"] for i, a in enumerate(aggs)}
    for a in aggs:
        _check_type(a, types[a.name])
    numbers = [F.col(f"__v{i}") if a.kind == "count" else _as_number(F.col(f"__v{i}"), types[a.name]).alias(f"__v{i}") for i, a in enumerate(aggs)]
    return rows.where("__k is not null").select(*names, "__k", *numbers), names, types


@dataclass(frozen=True)
class _Slot:
    """64 numbers of a group: how they are put together, whether a unit is only in its worlds, and what changes nothing."""

    name: str
    fold: str  # add, min or max
    in_worlds: bool = True

    @property
    def neutral(self) -> float:
        return {"add": 0.0, "min": float("nan"), "max": float("-inf")}[self.fold]

    @property
    def reduce(self):
        # Spark orders NaN last: a minimum takes it only if there is nothing else
        return {"add": np.add, "min": np.fmin, "max": np.maximum}[self.fold]


def _by_unit(i: int, a: Agg) -> list[tuple[_Slot, Column]]:
    """The slots of an aggregate, and each one's value for a unit; none is null."""
    v = F.col(f"__v{i}")
    n = (F.count_distinct(v) if a.distinct else F.count(v)).cast("double")
    if a.kind == "count":
        return [(_Slot(f"n{i}", "add"), n)]
    have = (_Slot(f"c{i}", "add"), F.least(F.count(v), F.lit(1)).cast("double"))
    if a.kind in ("min", "max"):
        s = _Slot(f"s{i}", a.kind)
        return [(s, F.coalesce(getattr(F, a.kind)(v), F.lit(s.neutral))), have]
    total = F.coalesce(F.sum_distinct(v) if a.distinct else F.sum(v), F.lit(0.0))
    # an average divides by the rows of the whole group
    return [(_Slot(f"s{i}", "add"), total), have] + [(_Slot(f"n{i}", "add", False), n)] * (a.kind == "avg")


#: Units of a group in one batch from which on their 64 sums are smaller than they are.
_DENSE = 32
#: Groups whose sums a task holds back.
_HELD = 512


def _matrix(b: pa.RecordBatch, at: np.ndarray, slot: _Slot, bits: np.ndarray, whole: np.ndarray, blobs: np.ndarray | None, n: int, of: int) -> np.ndarray:
    """A row of 64 for each row of the batch, from a unit's value or from sums that came as they are."""
    v = b.column(slot.name).to_numpy(zero_copy_only=False)[at][:, None]
    out = np.where(bits, v, slot.neutral) if slot.in_worlds else np.repeat(v, WORLDS, axis=1)
    if blobs is not None:
        out[whole] = blobs.reshape(-1, of, WORLDS)[:, n]
    return out


def _runs(b: pa.RecordBatch, slots: Sequence[_Slot], order: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The order of rows by group, where each group starts and ends in it, and each slot's 64 numbers by group."""
    x, y = (b.column(c).to_numpy() for c in ("__a", "__b"))
    at = np.lexsort((y, x)) if order else np.arange(b.num_rows)
    x, y = x[at], y[at]
    starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    k = pa.compute.fill_null(b.column("__k"), 0).to_numpy()[at]
    bits = np.unpackbits(np.ascontiguousarray(k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    col = b.column("__w").take(pa.array(at))
    whole = col.is_valid().to_numpy(zero_copy_only=False)
    blobs = np.frombuffer(b"".join(x.as_py() for x in col.drop_null()), np.float64) if whole.any() else None
    sums = [s.reduce.reduceat(_matrix(b, at, s, bits, whole, blobs, n, len(slots)), starts, axis=0) for n, s in enumerate(slots)]
    return at, starts, np.r_[starts[1:], len(at)], sums


def _condensed(slots: Sequence[_Slot]):
    """Units as they come, but for groups with many of them, which become one row with their sums."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}

        def out():
            for row, sums in held.values():
                cols = [pa.array([None], pa.int64()) if c == "__k" else pa.array([np.stack(sums).tobytes()], pa.binary()) if c == "__w" else row.column(c) for c in row.schema.names]
                yield pa.RecordBatch.from_arrays(cols, schema=row.schema)
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            at, starts, ends, sums = _runs(b, slots, True)
            many = ends - starts >= _DENSE
            few = np.sort(at[np.repeat(~many, ends - starts)])
            if len(few):
                yield b.take(pa.array(few))
            for g in np.flatnonzero(many):
                first = int(at[starts[g]])
                name = (b.column("__a")[first].as_py(), b.column("__b")[first].as_py())
                mine = [x[g] for x in sums]
                if name in held:
                    held[name][1] = [s.reduce(p, q) for s, p, q in zip(slots, held[name][1], mine, strict=True)]
                else:
                    held[name] = [b.take(pa.array([first])), mine]
                    if len(held) >= _HELD:
                        yield from out()
        yield from out()

    return run


def _filled(slots: Sequence[_Slot], kinds: dict[str, str], names: Sequence[str]):
    """From rows sorted by group, one row for each group with a list of worlds for each aggregate."""
    place = {s.name: n for n, s in enumerate(slots)}

    def lists(sums: list[np.ndarray]) -> list[pa.Array]:
        out = []
        for i, kind in enumerate(kinds.values()):
            if kind == "count":
                x = sums[place[f"n{i}"]]
                null = x == 0
            else:
                x, null = sums[place[f"s{i}"]], sums[place[f"c{i}"]] == 0
                if kind == "avg":
                    x = x / np.maximum(sums[place[f"n{i}"]], 1.0)
            offsets = np.arange(0, x.size + 1, WORLDS, dtype=np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel(), pa.float64(), mask=null.ravel()), mask=pa.array(null.all(axis=1))))
        return out

    def run(batches):
        last = None  # the group that may go on: its name, first row and sums

        def emit(rows: list[pa.RecordBatch], sums: list[np.ndarray]):
            t = pa.Table.from_batches(rows).combine_chunks()
            return pa.RecordBatch.from_arrays([*(t.column(c).chunk(0) for c in names), *lists(sums)], [*names, *kinds])

        for b in batches:
            if not b.num_rows:
                continue
            _, starts, _, sums = _runs(b, slots, False)
            name = lambda r: (b.column("__a")[r].as_py(), b.column("__b")[r].as_py())  # noqa: B023, E731
            if last is not None and last[0] == name(0):
                for n, s in enumerate(slots):
                    sums[n][0] = s.reduce(last[2][n], sums[n][0])
                first = [last[1]]
            else:
                if last is not None:
                    yield emit([last[1]], [x[None] for x in last[2]])
                first = [b.slice(0, 1)]
            if len(starts) > 1:
                rest = b.take(pa.array(starts[1:-1]))
                yield emit([*first, rest], [x[:-1] for x in sums])
                first = [b.slice(int(starts[-1]), 1)]
            last = (name(int(starts[-1])), first[0], [x[-1].copy() for x in sums])
        if last is not None:
            yield emit([last[1]], [x[None] for x in last[2]])

    return run


def _listed(rows: DataFrame, names: list[str], aggs: Sequence[Agg]) -> DataFrame:
    of_unit = [x for i, a in enumerate(aggs) for x in _by_unit(i, a)]
    slots = [s for s, _ in of_unit]
    units = rows.groupBy(*names, "__k").agg(*[c.alias(s.name) for s, c in of_unit])
    ids = [F.xxhash64(F.lit(n), *names) for n in (1, 2)]  # 128 bits for a group
    units = units.select(ids[0].alias("__a"), ids[1].alias("__b"), *names, "__k", *[s.name for s in slots], F.lit(None).cast("binary").alias("__w"))
    schema = StructType([StructField(f.name, f.dataType, True) for f in units.schema.fields])
    met = units.mapInArrow(_condensed(slots), schema).repartition("__a", "__b").sortWithinPartitions("__a", "__b")
    worlds = [StructField(a.name, ArrayType(DoubleType())) for a in aggs]
    return met.mapInArrow(_filled(slots, {a.name: a.kind for a in aggs}, names), StructType([*[schema[n] for n in names], *worlds]))


def world_lists(df: DataFrame, groups: Sequence[Column], kh: Column, aggs: Sequence[Agg], settings: Settings = Settings()) -> DataFrame:
    """__g0.. and, by aggregate name, its list of 64 worlds, neither scaled nor corrected; null if no world has a value."""
    return typed_world_lists(df, groups, kh, aggs, settings)[0]


def typed_world_lists(df: DataFrame, groups: Sequence[Column], kh: Column, aggs: Sequence[Agg], settings: Settings = Settings()) -> tuple[DataFrame, dict[str, str]]:
    """The lists, and the type of each aggregate's values."""
    rows, names, types = _prepared(df, groups, kh, aggs, settings)
    # the values stand under names of their own until the end, so that none meets a group's
    plain = [Agg(f"__l{i}", a.kind, a.value, a.distinct, a.correction) for i, a in enumerate(aggs)]
    lists = _listed(rows, names, plain)
    return lists.select(*names, *[F.col(p.name).alias(a.name) for p, a in zip(plain, aggs, strict=True)]), types


def wide_world_lists(df: DataFrame, groups: Sequence[Column], kh: Column, aggs: Sequence[Agg], settings: Settings = Settings()) -> DataFrame:
    """The same lists from one aggregation with a slot for each world; no DISTINCT."""
    return _wide_lists(df, groups, kh, aggs, settings)[0]


def _wide_lists(df: DataFrame, groups: Sequence[Column], kh: Column, aggs: Sequence[Agg], settings: Settings) -> tuple[DataFrame, dict[str, str]]:
    if any(a.distinct for a in aggs):
        raise ValueError("DISTINCT needs the narrow plan")
    rows, names, types = _prepared(df, groups, kh, aggs, settings)
    cols = []
    for i, a in enumerate(aggs):
        v = F.col(f"__v{i}")
        total = F.count(v)
        fn = {"count": F.count, "sum": F.sum, "avg": F.sum, "min": F.min, "max": F.max}[a.kind]
        slots = [fn(F.when(F.getbit("__k", F.lit(j)) == 1, v)) for j in range(WORLDS)]
        slots = [F.nullif(x, F.lit(0)).cast("double") if a.kind == "count" else x / total if a.kind == "avg" else x for x in slots]
        cols.append(F.array(*slots).alias(a.name))
    out = rows.groupBy(*names).agg(*cols)
    return out.select(*names, *[F.when(F.exists(a.name, lambda x: x.isNotNull()), F.col(a.name)).alias(a.name) for a in aggs]), types


def counters(df: DataFrame, groups: dict[str, Column], kh: Column, aggs: Sequence[Agg], settings: Settings = Settings(), wide: bool = False) -> DataFrame:
    """Lists of 64 worlds, doubled (but for min and max) and corrected."""
    lists = (wide_world_lists if wide else world_lists)(df, list(groups.values()), kh, aggs, settings)
    return lists.select(*[F.col(f"__g{i}").alias(g) for i, g in enumerate(groups)], *map(_scaled, aggs))


def _scaled(a: Agg) -> Column:
    factor = a.scale * (1.0 if a.kind in ("min", "max") else a.correction)
    return F.transform(a.name, lambda x: x * F.lit(factor)).alias(a.name)


def released(a: Agg, kind: str, settings: Settings) -> Column:
    """The value released for an aggregate's list, in the aggregate's own type."""
    x = sampled(F.col(a.name), settings, a.correction, a.scale, corrected=a.kind not in ("min", "max"))
    if a.kind == "count":
        return F.round(x).cast("long")
    if a.kind in ("min", "max"):
        if kind == "date":
            return F.date_from_unix_date(F.round(x).cast("int"))
        if kind.startswith("timestamp"):
            return F.timestamp_micros(F.round(x).cast("long"))
        return F.round(x).cast(kind) if kind in ("tinyint", "smallint", "int", "bigint") else x.cast(kind)
    if a.kind == "sum" and kind.startswith("decimal"):
        return x.cast(f"decimal(38,{kind[:-1].split(',')[1]})")
    return x


def aggregate(df: DataFrame, groups: dict[str, Column], kh: Column, aggs: Sequence[Agg], settings: Settings = Settings(), wide: bool = False) -> DataFrame:
    """Group columns and the released value of each aggregate. Empty groups and groups without worlds give null."""
    lists, types = (_wide_lists if wide else typed_world_lists)(df, list(groups.values()), kh, aggs, settings)
    if not groups:
        # an ungrouped query has one row, null without rows
        lists = lists.groupBy().agg(*[F.first(a.name).alias(a.name) for a in aggs])
    return lists.select(*[F.col(f"__g{i}").alias(g) for i, g in enumerate(groups)], *[released(a, types[a.name], settings).alias(a.name) for a in aggs])


# Fixed values of the diversity guard: a group is odd with so many worlds empty and the others equal; it is an error
# from so many rows on, if there are more than so many times as many odd groups as others.
_ODD_EMPTY = (29, 35)
_ODD_ROWS = 100
_ODD_TIMES = 2


def check_diversity(df: DataFrame, groups: Sequence[Column], kh: Column, aggs: Sequence[Agg], settings: Settings = Settings()) -> None:
    """Raises if most groups have rows of too few units: about half of the worlds, all of them equal."""
    lists = world_lists(df, groups, kh, aggs, settings)
    total = df.count()
    for a in aggs:
        x = F.filter(a.name, lambda w: w.isNotNull())
        empty = F.lit(WORLDS) - F.size(x)
        odd = empty.between(*_ODD_EMPTY) & (F.array_min(x) == F.array_max(x))
        r = lists.where(F.col(a.name).isNotNull()).agg(F.coalesce(F.sum(odd.cast("long")), F.lit(0)).alias("odd"), F.count("*").alias("n")).first()
        if total >= _ODD_ROWS and r["odd"] > _ODD_TIMES * (r["n"] - r["odd"]):
            raise ValueError(f"{a.name}: too few privacy units in most groups")
