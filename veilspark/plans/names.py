"""`pac_*` functions by name in SQL.

Calls are replaced in the parsed query, before it is analyzed, by native expressions: aggregates by a slot for each
world (the wide plan), scalars by expressions over masks and lists. So they stand anywhere that Spark takes an
aggregate or a scalar. The first argument of an aggregate is the unit's key hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import noise, votes
from veilspark.functions.keyhash import WORLDS, Settings, in_query
from veilspark.plans.catalyst import Catalyst

_AGGREGATES = ("count", "sum", "avg", "min", "max")
#: Functions whose result is a list, so that a vote over it is a vote over a list.
_LISTS = ("transform", "array", "zip_with", "filter", "array_repeat", "coalesce")


class Names:
    def __init__(self, spark: SparkSession, settings: Settings):
        self.c, self.settings, self.spark = Catalyst(spark), settings, spark

    def frame(self, parsed) -> DataFrame:
        return self.c.frame(self._plan(parsed))

    def _functions(self, parsed) -> list[str]:
        """Names of the functions that a parsed query calls, lower-case."""
        calls = (e for p in self.c.whole(parsed) for x in self.c.list(p.expressions()) for e in self.c.walk(x) if e.nodeName() == "UnresolvedFunction")
        return [self.c.list(e.nameParts())[-1].lower() for e in calls]

    def calls(self, parsed) -> bool:
        return any(n.startswith("pac_") for n in self._functions(parsed))

    def plain_aggregates(self, parsed) -> list[str]:
        """Aggregate and window functions called beside pac_ functions."""
        catalog, out = self.spark._jsparkSession.sessionState().catalog(), []
        for n in dict.fromkeys(self._functions(parsed)):
            name = self.c.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(n)
            if not n.startswith("pac_") and catalog.functionExists(name) and catalog.lookupFunctionInfo(name).getGroup() in ("agg_funcs", "window_funcs"):
                out.append(n)
        return out

    def _plan(self, plan):
        kids = self.c.children(plan)
        new = [self._plan(k) for k in kids]
        if any(a is not b for a, b in zip(kids, new, strict=True)):
            plan = self.c.with_children(plan, new)
        return self.c.with_expressions(plan, lambda e: self.c.replace(e, self._found))

    def _found(self, e):
        if e.nodeName() != "UnresolvedFunction":
            return None
        name = self.c.list(e.nameParts())[-1].lower()
        if not name.startswith("pac_"):
            return None
        args = [self.c.replace(a, self._found) for a in self.c.list(e.arguments())]
        return self.c.expression(self._native(name[4:], [self.c.column(a) for a in args], args, bool(e.isDistinct())))

    def _native(self, name: str, cols: list[Column], exprs: list, distinct: bool) -> Column:
        kind, _, rest = name.partition("_")
        if kind in _AGGREGATES and rest in ("", "counters", "list"):
            return self._list(kind, cols[0]) if rest == "list" else self._aggregate(kind, rest, cols, exprs, distinct)
        if name == "select":
            return votes.select(cols[0])
        if name == "filter":
            listed = exprs[0].nodeName() == "UnresolvedFunction" and self.c.list(exprs[0].nameParts())[-1].lower() in _LISTS
            return votes.filter_list(cols[0], self.settings) if listed else votes.filter_mask(cols[0], self.settings, cols[1] if len(cols) > 1 else 1.0)
        if kind == "filter" and rest in votes.COMPARISONS:
            return votes.filter_compare(rest, cols[0], cols[1], self.settings, cols[2] if len(cols) > 2 else 1.0)
        simple = {"mask_and": votes.mask_and, "mask_or": votes.mask_or, "mask_not": votes.mask_not, "coalesce": votes.coalesce_worlds}
        if name in simple:
            return simple[name](*cols)
        if name == "noised":
            return noise.noised(cols[0], self.settings)
        if name == "aggregate":
            return noise.aggregate_samples(cols[0], cols[1], self._number(exprs[2]), int(self._number(exprs[3])), self.settings)
        raise NotImplementedError(f"unknown function pac_{name}")

    def _number(self, expr) -> float:
        if not expr.foldable():
            raise ValueError("this argument must be a constant")
        x = float(str(expr.eval(None)))
        if x < 0:
            raise ValueError("this argument must not be negative")
        return x

    def _aggregate(self, kind: str, rest: str, cols: list[Column], exprs: list, distinct: bool) -> Column:
        if distinct:
            raise NotImplementedError("DISTINCT in a function by name; ask for count(DISTINCT ...) of a linked table instead")
        most = 1 if kind == "count" else 2
        correction = 1.0
        # the last argument, if it's a constant number, is the correction
        if len(exprs) > most or (kind == "count" and len(exprs) == 2):
            if exprs[-1].nodeName() == "Literal":
                correction, cols = self._number(exprs[-1]), cols[:-1]
        k = in_query(cols[0], self.settings)
        v = cols[1] if len(cols) > 1 else F.lit(1)
        fn = {"count": F.count, "sum": F.sum, "avg": F.sum, "min": F.min, "max": F.max}[kind]
        slots = [fn(F.when(F.getbit(k, F.lit(j)) == 1, v)) for j in range(WORLDS)]
        if kind == "count":
            slots = [F.nullif(x, F.lit(0)) for x in slots]
        if kind == "avg":
            total = F.count(F.when(k.isNotNull(), v))
            slots = [x / total for x in slots]
        scale = 1.0 if kind in ("min", "max") else 2.0
        worlds = F.array(*[x.cast("double") for x in slots])
        worlds = F.when(F.exists(worlds, lambda x: x.isNotNull()), worlds)
        if rest:
            factor = scale * (1.0 if kind in ("min", "max") else correction)
            return F.transform(worlds, lambda x: x * F.lit(factor))
        out = noise.sampled(worlds, self.settings, correction, scale, corrected=kind not in ("min", "max"))
        return F.round(out).cast("long") if kind == "count" else out

    def _list(self, kind: str, col: Column) -> Column:
        fn = {"count": lambda x: F.nullif(F.count(x), F.lit(0)), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind]
        return F.array(*[fn(F.get(col, F.lit(j))).cast("double") for j in range(WORLDS)])
