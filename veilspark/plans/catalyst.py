"""Thin access to analyzed plans: nodes are read and put together again, nothing is executed here."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession


def remembered(method: Callable):
    """A method of one node whose result is kept: plans don't change, and each look at one is a call to the JVM."""

    @functools.wraps(method)
    def once(self, node, *more):
        key = (method.__name__, node._target_id, *more)
        if key not in self.known:
            self.known[key] = (method(self, node, *more), node)  # held, so that its name isn't given to another
        return self.known[key][0]

    return once


class Catalyst:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.known: dict = {}
        self._utils = self.jvm.org.apache.spark.sql.classic.ExpressionUtils
        self._to_expression = self._object("org.apache.spark.sql.classic.ColumnNodeToExpressionConverter")
        self._attribute_map = self._object("org.apache.spark.sql.catalyst.expressions.AttributeMap")
        self._logical = self.jvm.org.apache.spark.sql.catalyst.plans.logical
        self._expr = self.jvm.org.apache.spark.sql.catalyst.expressions

    def _object(self, name: str):
        """A Scala object."""
        loader = self.jvm.java.lang.Thread.currentThread().getContextClassLoader()
        return loader.loadClass(name + "$").getField("MODULE$").get(None)

    def plan(self, df: DataFrame):
        return df._jdf.queryExecution().analyzed()

    def frame(self, plan) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def list(self, seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def seq(self, items: Iterable):
        out = self.jvm.java.util.ArrayList()
        for x in items:
            out.add(x)
        return self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(out).toSeq()

    @remembered
    def children(self, node) -> list:
        return self.list(node.children())

    @remembered
    def kind(self, node) -> str:
        return node.nodeName()

    @remembered
    def output(self, plan) -> list:
        return self.list(plan.output())

    @remembered
    def expressions(self, plan) -> list:
        return self.list(plan.expressions())

    @remembered
    def inner(self, subquery):
        """The plan that an expression holds."""
        return subquery.plan()

    def with_children(self, node, children: Iterable):
        return node.withNewChildren(self.seq(children))

    def column(self, expr) -> Column:
        return Column(self._utils.column(expr))

    def expression(self, col: Column):
        return self._to_expression.apply(col._jc.node())

    def project(self, exprs: Iterable, child):
        return self._logical.Project(self.seq(exprs), child)

    def filter(self, condition, child):
        return self._logical.Filter(condition, child)

    def renamed(self, expr, named, fresh: bool = False):
        """expr under the name and id of `named`, so that nodes above still find it; or under a fresh id."""
        number = self._expr.NamedExpression.newExprId() if fresh else named.exprId()
        return self._expr.Alias(expr, named.name(), number, named.qualifier(), self.jvm.scala.Option.empty(), self.seq([]))

    def with_attributes(self, plan, moved: list[tuple]):
        """The node's own expressions with attributes in place of others."""
        pairs = self.seq(self.jvm.scala.Tuple2(a, b) for a, b in moved)
        return plan.rewriteAttrs(self._attribute_map.apply(pairs))

    def replace(self, expr, found: Callable[[object], object | None]):
        """expr with the first node on each branch for which `found` gives another one replaced."""
        new = found(expr)
        if new is not None:
            return new
        kids = self.children(expr)
        changed = [self.replace(k, found) for k in kids]
        return self.with_children(expr, changed) if any(a is not b for a, b in zip(kids, changed, strict=True)) else expr

    def walk(self, node):
        yield node
        for c in self.children(node):
            yield from self.walk(c)

    def holds_plan(self, expr) -> bool:
        return self.kind(expr) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")

    @remembered
    def subqueries(self, plan) -> list:
        """Expressions of this node that hold plans."""
        return [e for x in self.expressions(plan) for e in self.walk(x) if self.holds_plan(e)]

    def whole(self, plan):
        """Nodes of the plan, of its common table expressions and of the subqueries in it."""
        for p in self.walk(plan):
            yield p
            for s in self.subqueries(p):
                yield from self.whole(self.inner(s))
            if p.nodeName() == "UnresolvedWith":
                for k in self.list(p.innerChildren()):
                    yield from self.whole(k)

    def is_a(self, node, name: str) -> bool:
        """Whether the node is of the class of this name."""
        loader = self.jvm.java.lang.Thread.currentThread().getContextClassLoader()
        return loader.loadClass(name).isInstance(node)

    def parse(self, text: str):
        return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)

    def inlined(self, plan):
        """The plan with its common table expressions put where they are read."""
        return self.jvm.org.apache.spark.sql.catalyst.optimizer.InlineCTE(True, False).apply(plan)

    def is_correlated(self, subquery) -> bool:
        return any(self.kind(e) == "OuterReference" for p in self.whole(self.inner(subquery)) for x in self.expressions(p) for e in self.walk(x))

    def with_expressions(self, plan, change: Callable):
        """The node with its own expressions changed; of the nodes that a parsed query has."""
        kind, logical = plan.nodeName(), self._logical
        if kind == "Project":
            return self.project([change(e) for e in self.list(plan.projectList())], plan.child())
        if kind == "Filter":
            return self.filter(change(plan.condition()), plan.child())
        if kind == "UnresolvedHaving":
            return self.jvm.org.apache.spark.sql.catalyst.analysis.UnresolvedHaving(change(plan.havingCondition()), plan.child())
        if kind == "Aggregate":
            groups = [change(e) for e in self.list(plan.groupingExpressions())]
            return logical.Aggregate(self.seq(groups), self.seq(change(e) for e in self.list(plan.aggregateExpressions())), plan.child(), plan.hint())
        return plan

    def conjuncts(self, expr) -> list:
        if expr.nodeName() == "And":
            return [c for k in self.children(expr) for c in self.conjuncts(k)]
        return [expr]

    def table_name(self, plan, known=()) -> str | None:
        """The name of a base table, or of a view that is known as a table; None for other nodes."""
        name = self.kind(plan)
        if name == "SubqueryAlias":
            (kid,) = self.children(plan)
            if self.kind(kid) == "View":
                return self.table_name(kid, known)
            if not self.children(kid):
                return plan.alias().lower()
        if name == "View":
            found = plan.desc().identifier().table().lower()
            return found if found in known else None
        return None
