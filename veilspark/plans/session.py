"""A Spark session that answers queries privately."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from veilspark.functions.keyhash import Settings
from veilspark.operators.diff import Utility, summarise, utility_diff
from veilspark.plans import ddl
from veilspark.plans.admission import Checker, RejectedQuery
from veilspark.plans.catalyst import Catalyst
from veilspark.plans.names import Names
from veilspark.plans.policy import Registry, read_unit_list
from veilspark.plans.rewrite import Rewriter

#: Settings that are taken and change nothing.
NO_EFFECT = ("pac_deterministic_noise", "pac_correction", "pac_m", "enforce_m_values", "pac_compiled_path")
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: What is no query, of parsed plans.
_STATEMENTS = (_LOGICAL + "Command", _LOGICAL + "ParsedStatement", _LOGICAL + "InsertIntoDir", _LOGICAL + "CompoundBody")
#: Statements that show or keep no rows: a view is opened when it is read.
_HARMLESS = ("CreateView", "CreateTempView", "Drop", "Show", "DescribeRelation", "CacheTable", "UncacheTable", "RefreshTable", "Set", "Use")


def _relations(c: Catalyst, node) -> list[str]:
    """Names of the tables and views that a parsed statement speaks of, wherever its parts hold plans."""
    out, queue = [], [node]
    while queue:
        x = queue.pop()
        if c.is_a(x, "org.apache.spark.sql.catalyst.plans.QueryPlan"):
            queue += [s.plan() for s in c.subqueries(x)]
        for name in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedTableOrView", "UnresolvedView"):
            if c.is_a(x, "org.apache.spark.sql.catalyst.analysis." + name):
                out.append(".".join(c.list(x.multipartIdentifier())))
        parts = x.productIterator()
        while parts.hasNext():
            p = parts.next()
            if c.is_a(p, "org.apache.spark.sql.catalyst.trees.TreeNode") and c.is_a(p, "org.apache.spark.sql.catalyst.plans.QueryPlan"):
                queue.append(p)
            elif c.is_a(p, "scala.collection.Seq"):
                queue += [k for k in c.list(p) if c.is_a(k, "org.apache.spark.sql.catalyst.plans.QueryPlan")]
        if x.nodeName() == "UnresolvedWith":
            queue += c.list(x.innerChildren())
    return out


class PrivateSession:
    """sql() takes policy statements, settings and queries; frame() takes a DataFrame.

    Queries over units and linked tables are checked and rewritten; all others run as they are. With `noise` off a
    checked query runs exactly; without `conservative` a query that can't be made private does so, too. Statements that
    would write or show rows of a unit (CREATE TABLE AS, INSERT, column statistics) are refused; EXPLAIN shows the private plan.
    """

    def __init__(self, spark: SparkSession, registry: Registry | None = None, settings: Settings = Settings()):
        self.spark, self.registry, self.settings = spark, registry if registry is not None else Registry(), settings
        self.noise, self.conservative = True, True
        self.conjunctive, self.join_elimination = False, True
        self.diff_columns: tuple[int, str | None] | None = None
        self.last_utility: Utility | None = None
        self.metadata_path: str | None = None
        self._queries = 0

    def _columns(self, table: str) -> list[str] | None:
        return self.spark.table(table).columns if self.spark.catalog.tableExists(table) else None

    def sql(self, text: str) -> DataFrame:
        s = ddl.parse(text, self._columns)
        if s is None:
            return self._statement(text)
        if s.setting:
            self.set(*s.setting)
        elif s.pragma:
            self._pragma(*s.pragma)
        else:
            trial = Registry(dict(self.registry.tables))
            s.then(trial)  # an impossible policy fails before the table exists
            if s.plain:
                self._statement(s.plain)
            s.then(self.registry)
            if self.metadata_path:
                self.registry.save(self.metadata_path)
        return self.spark.createDataFrame([], "ok boolean")

    def _statement(self, text: str) -> DataFrame:
        """A query; or another statement, which must not carry rows of a unit out of Spark's plans."""
        c = Catalyst(self.spark)
        parsed = c.parse(text)
        if parsed.nodeName() == "ExplainCommand":
            shown = self._query(c, parsed.logicalPlan())
            return self.spark.createDataFrame([(shown._jdf.queryExecution().explainString(parsed.mode()),)], "plan string")
        if not any(c.is_a(p, x) for p in c.walk(parsed) for x in _STATEMENTS):
            return self._query(c, parsed)
        if not parsed.nodeName().startswith(_HARMLESS):
            checker = Checker(self.spark, self.registry)
            for name in _relations(c, parsed):
                if self.spark.catalog.tableExists(name) and any(self.registry.paths(t) or self.registry.get(t).protected for t in checker.tables(c.inlined(c.plan(self.spark.table(name))))):
                    raise RejectedQuery(f"a statement of the kind {parsed.nodeName()} is not supported over {name}; write the DataFrame that a query returns")
        return self.spark.sql(text)

    def _query(self, c: Catalyst, parsed) -> DataFrame:
        names = Names(self.spark, self.settings)
        return self._named(names, parsed) if names.calls(parsed) else self.frame(c.frame(parsed))

    def frame(self, df: DataFrame) -> DataFrame:
        c = Catalyst(self.spark)
        plan = c.inlined(c.plan(df))
        try:
            found = Checker(self.spark, self.registry).check(plan)
        except RejectedQuery as e:
            if not self.conservative and ("not supported" in str(e) or "unsupported" in str(e)):
                return df
            raise
        if not found.eligible or not self.noise:
            return df
        self._queries += 1
        used = replace(self.settings, query_number=self._queries) if self.settings.mi else self.settings
        private = c.frame(Rewriter(self.spark, self.registry, used, self.conjunctive, self.join_elimination).plan(plan))
        if self.diff_columns is None:
            return private
        keys, path = self.diff_columns
        out = utility_diff(private, df, keys)
        self.last_utility = summarise(out, keys, path)
        return out

    def _named(self, names: Names, parsed) -> DataFrame:
        """A query that calls pac_ functions itself: left as it is, if it reads a unit, a table linked to one, or no policy's table."""
        plain = names.plain_aggregates(parsed)
        df = names.frame(parsed)
        c = Catalyst(self.spark)
        checker = Checker(self.spark, self.registry)
        plan = c.inlined(c.plan(df))
        tables = checker.tables(plan)
        if self.registry.units and _relations(c, parsed) and not any(self.registry.get(t).is_unit or self.registry.paths(t) for t in tables):
            raise RejectedQuery("a query that calls pac_ functions must read a privacy unit or a table linked to one")
        found = checker.check(plan, named=True)
        if plain and (found.units or found.linked):
            raise RejectedQuery(f"a query that calls pac_ functions must not aggregate a privacy unit by {plain[0]}, too")
        return df

    def set(self, name: str, value: str) -> None:
        on = value.lower() in ("true", "1", "on")
        if name == "pac_mi":
            if float(value) < 0:
                raise ValueError("pac_mi must not be negative")
            self.settings = replace(self.settings, mi=float(value))
        elif name == "pac_seed":
            self.settings = replace(self.settings, seed=int(value))
        elif name == "pac_noise":
            self.noise = on
        elif name == "pac_conservative_mode":
            self.conservative = on
        elif name == "pac_join_elimination":
            self.join_elimination = on
        elif name == "pac_conjunctive_units":
            self.conjunctive = on
        elif name == "pac_diffcols":
            n, _, path = value.partition(":")
            self.diff_columns = None if value.lower() in ("null", "") else (int(n), path or None)
        elif name == "pac_privacy_file":
            for t in read_unit_list(value):
                self.registry.set_unit(t)
        elif name not in NO_EFFECT:
            raise ValueError(f"unknown setting {name}")

    def _pragma(self, action: str, path: str | None) -> None:
        path = path or self.metadata_path
        if action == "save":
            self.registry.save(path)
        elif action == "load":
            self.registry.tables = Registry.load(path).tables
        else:
            self.registry.clear()
            if path:
                from pathlib import Path

                Path(path).unlink(missing_ok=True)
