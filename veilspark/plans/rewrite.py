"""From an admitted plan to a private one.

Aggregates over privacy units are found in the analyzed plan. Below each one the key's hash is threaded up from the
base table, with the missing links joined in (never the unit itself: its foreign key has the key's values). The
aggregate becomes lists of worlds; a plain aggregate releases one value of its list, and an expression over several
is evaluated in every world before its value is released. A comparison with private subqueries becomes a vote over
their worlds, joined on the correlated columns or with one row; a private subquery anywhere else gives what it releases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.keyhash import Settings, key_hash, mixed_units
from veilspark.functions.noise import noised
from veilspark.functions.votes import filter_list
from veilspark.operators.worlds import Agg, _scaled, released, typed_world_lists
from veilspark.plans.admission import Checker, Origin, RejectedQuery
from veilspark.plans.policy import Registry


class Rewriter:
    """conjunctive: hashes of several units meet by AND, not by XOR; join_elimination: a unit's own table isn't joined for its key."""

    def __init__(self, spark: SparkSession, registry: Registry, settings: Settings = Settings(), conjunctive: bool = False, join_elimination: bool = True):
        self.spark, self.registry, self.settings = spark, registry, settings
        self.conjunctive, self.join_elimination = conjunctive, join_elimination
        self.checker = Checker(spark, registry)
        self.c = self.checker.c
        self._moved: list[tuple] = []  # attributes that have another id above a private aggregate
        self._done = 0

    def rewrite(self, df: DataFrame) -> DataFrame:
        return self.c.frame(self.plan(self.c.inlined(self.c.plan(df))))

    def plan(self, plan):
        wanted = sum(map(self.checker.is_target, self.checker.whole(plan)))
        out = self._plan(plan)
        if self._done != wanted:
            raise RejectedQuery("an aggregate over a privacy unit stands where it can't be made private")
        return out

    def _plan(self, plan):
        if self.checker.table_name(plan) is not None:
            return plan
        if self.c.kind(plan) == "View":
            return self._plan(plan.child())
        if self.checker.is_target(plan):
            return self._private(plan)
        kids = self.c.children(plan)
        new = [self._plan(k) for k in kids]
        if any(a is not b for a, b in zip(kids, new, strict=True)):
            plan = self.c.with_children(plan, new)
            plan = self.c.with_attributes(plan, self._moved) if self._moved else plan
        return self._released_subqueries(self._voted(plan) if self.c.kind(plan) == "Filter" else plan)

    def _released_subqueries(self, plan):
        """Private subqueries that no vote is held on give what they release."""
        if not any(self.checker.has_target(s.plan()) for s in self.c.subqueries(plan)):
            return plan

        def found(e):
            if not self.c.holds_plan(e) or not self.checker.has_target(e.plan()):
                return None
            if self.c.is_correlated(e):
                raise RejectedQuery("a private subquery may be correlated only in a comparison of a WHERE clause, by equalities")
            return e.withNewPlan(self._plan(e.plan()))

        return self.c.with_expressions(plan, lambda e: self.c.replace(e, found))

    # --- the key's hash ---

    def _keyed(self, plan):
        """The plan with a column for each unit that it has rows of, and the columns' names by unit."""
        name = self.checker.table_name(plan)
        if name is not None:
            return self._keyed_table(plan, name)
        kids = self.c.children(plan)
        kind = self.c.kind(plan)
        if kind == "Aggregate":
            return self._keyed_group(plan)
        if kind == "Union":
            return self._keyed_union(plan, kids)
        if kind == "Join" and plan.joinType().toString() in ("LeftSemi", "LeftAnti"):
            left, keys = self._keyed(kids[0])
            return self.c.with_children(plan, [left, kids[1]]), keys
        new, keys = [], {}
        for k in kids:
            p, own = self._keyed(k) if self.checker.sensitive(k) else (k, {})
            twice = {n for u, n in own.items() if u in keys}  # joined rows of a unit have one key
            if twice:
                p = k if twice == set(own.values()) else self.c.project([a for a in self.c.list(p.output()) if a.name() not in twice], p)
            new.append(p)
            keys |= {u: n for u, n in own.items() if u not in keys}
        if not keys:
            return plan, keys
        if kind == "Project":
            attrs = [a for a in self.c.list(new[0].output()) if a.name() in keys.values()]
            return self.c.project([*self.c.list(plan.projectList()), *attrs], new[0]), keys
        return self.c.with_children(plan, new), keys

    def _keyed_table(self, plan, name: str):
        df, keys = self.c.frame(plan), {}
        names = df.columns
        for n, (unit, path) in enumerate(sorted(self.registry.paths(name).items())):
            # a unit without a key has each of its rows, by content, as a unit
            cols = path[0].columns if path else self.registry.key_of(unit) or names
            at = [F.col(f"`{c}`") for c in cols]
            if not path and not self.registry.key_of(unit):
                at = [F.coalesce(c.cast("string"), F.lit("")) for c in at]
            if len(path) > self.join_elimination:
                df, at = self._joined(df, path, n)
            out = f"__kh_{unit}"
            df = df.select(*[F.col(f"`{c}`") for c in [*names, *keys.values()]], key_hash(*at).alias(out))
            keys[unit] = out
        return self.c.plan(df), keys

    def _joined(self, df: DataFrame, path, n: int):
        """df joined along the path, all but the unit; and the columns that have the unit's key."""
        at = [F.col(f"`{c}`") for c in path[0].columns]
        for i, link in enumerate(path[:-1] if self.join_elimination else path):
            ahead = path[i + 1].columns if i + 1 < len(path) else link.referenced
            other = self._fresh(link.table).select(*[F.col(f"`{r}`").alias(f"__r{n}_{i}_{k}") for k, r in enumerate(link.referenced)], *[F.col(f"`{a}`").alias(f"__n{n}_{i}_{k}") for k, a in enumerate(ahead)])
            df = df.join(other, [a == F.col(f"__r{n}_{i}_{k}") for k, a in enumerate(at)])
            at = [F.col(f"__n{n}_{i}_{k}") for k in range(len(ahead))]
        return df, at

    def _fresh(self, table: str) -> DataFrame:
        """The table under attribute ids of its own: the query may read it, too, and must keep its ids."""
        t = self.spark.table(table)
        return self.c.frame(self.c.children(self.c.plan(t.crossJoin(t)))[1])  # never run: only how the right side is named

    def _keyed_group(self, plan):
        """An aggregate that groups by the keys of its units has them in its rows."""
        known = self.checker.origins(plan)
        at = {o: a for a in self.c.list(plan.output()) if len(found := known.get(a.exprId().id(), set())) == 1 for o in found}
        df, keys = self.c.frame(plan), {}
        for unit in sorted(self.checker.units_below(plan.child())):
            for t in sorted({o.table for o in at}):
                cols = [at.get(Origin(t, c)) for c in self.checker.key_columns(t, unit)]
                if cols and all(c is not None for c in cols):
                    keys[unit] = f"__kh_{unit}"
                    df = df.select("*", key_hash(*[self.c.column(c) for c in cols]).alias(keys[unit]))
                    break
            else:
                raise RejectedQuery("an inner aggregate must keep the key that it groups by")
        return self.c.plan(df), keys

    def _keyed_union(self, plan, kids):
        found = [self._keyed(k) for k in kids]
        units = set.intersection(*[set(keys) for _, keys in found])
        if any(set(keys) != units for _, keys in found):
            raise RejectedQuery("the branches of a UNION must have the same privacy units")
        new = []
        for k, (p, keys) in zip(kids, found, strict=True):
            attrs = {a.name(): a for a in self.c.list(p.output())}
            new.append(self.c.project([*self.c.list(k.output()), *[attrs[keys[u]] for u in sorted(units)]], p))
        return self.c.with_children(plan, new), {u: f"__kh_{u}" for u in units}

    # --- aggregates ---

    def _parts(self, plan, extra_groups=()):
        """The keyed input, its groups, and for each aggregate node its Agg."""
        keyed, keys = self._keyed(self._plan(plan.child()))
        if not keys:
            raise RejectedQuery("no privacy unit can be reached from the aggregated rows")
        df = self.c.frame(keyed)
        kh = mixed_units(*[F.col(f"`{keys[u]}`") for u in sorted(keys)], conjunctive=self.conjunctive)
        groups = [*self.c.list(plan.groupingExpressions()), *extra_groups]
        nodes, aggs = [], []
        for e in self.c.list(plan.aggregateExpressions()):
            for x in self.c.walk(e):
                if self.c.kind(x) == "AggregateExpression" and not any(x.semanticEquals(n) for n in nodes):
                    nodes.append(x)
                    aggs.append(self._agg(f"a{len(aggs)}", x))
        return df, kh, groups, nodes, aggs

    def _agg(self, name: str, node) -> Agg:
        fn = node.aggregateFunction()
        kind = fn.prettyName()
        kids = self.c.children(fn)
        if len(kids) != 1:
            raise RejectedQuery(f"unsupported aggregate function {kind} of {len(kids)} columns")
        value = None if kind == "count" and kids[0].nodeName() == "Literal" else self.c.column(kids[0])
        if node.filter().isDefined():
            value = F.when(self.c.column(node.filter().get()), value if value is not None else F.lit(1))
        return Agg(name, kind, value, bool(node.isDistinct()))

    def _lists(self, plan, extra_groups=()):
        self._done += 1
        df, kh, groups, nodes, aggs = self._parts(plan, extra_groups)
        cols = [self.c.column(g) for g in groups]
        if not aggs:
            raise RejectedQuery("a query over a privacy unit needs an aggregate (sum, count, avg, min or max)")
        lists, types = typed_world_lists(df, cols, kh, aggs, self.settings)
        if not groups:
            lists = lists.groupBy().agg(*[F.first(a.name).alias(a.name) for a in aggs])
        return lists, groups, nodes, aggs, types

    def _in_worlds(self, expr, nodes, aggs, groups) -> Column:
        """expr over scaled lists, as a list of its value in each world."""

        def body(z: Column) -> Column:
            def found(e):
                for i, n in enumerate(nodes):
                    if self.c.kind(e) == "AggregateExpression" and e.semanticEquals(n):
                        return self.c.expression(z[f"s{i}"].cast(n.dataType().catalogString()))
                for i, g in enumerate(groups):
                    if e.semanticEquals(g):
                        return self.c.expression(F.col(f"__g{i}"))
                return None

            return self.c.column(self.c.replace(expr, found))

        used = [_scaled(a).alias(f"s{i}") for i, a in enumerate(aggs)]
        return F.transform(F.arrays_zip(*used), body)

    def _private(self, plan):
        lists, groups, nodes, aggs, types = self._lists(plan)
        outs = []
        for e in self.c.list(plan.aggregateExpressions()):
            bare = e.child() if self.c.kind(e) == "Alias" else e
            inner = bare
            while self.c.kind(inner) == "Cast":
                inner = inner.child()
            kind = bare.dataType().catalogString()
            hit = [i for i, n in enumerate(nodes) if self.c.kind(inner) == "AggregateExpression" and inner.semanticEquals(n)]
            group = [i for i, g in enumerate(groups) if bare.semanticEquals(g)]
            if hit:
                col = released(aggs[hit[0]], types[aggs[hit[0]].name], self.settings).cast(kind)
            elif group:
                col = F.col(f"__g{group[0]}")
            elif any(self.c.kind(x) == "AggregateExpression" for x in self.c.walk(bare)):
                col = noised(F.transform(self._in_worlds(bare, nodes, aggs, groups), lambda x: x.cast("double")), self.settings).cast(kind)
            else:
                col = self.c.column(self.c.replace(bare, lambda x: next((self.c.expression(F.col(f"__g{i}")) for i, g in enumerate(groups) if x.semanticEquals(g)), None)))
            outs.append(self.c.renamed(self.c.expression(col), e, fresh=self.c.kind(e) != "Alias"))
        new = self.c.plan(self.c.frame(self.c.project(outs, self.c.plan(lists))))
        pairs = zip(self.c.list(plan.aggregateExpressions()), self.c.list(new.output()), strict=True)
        self._moved += [(e, a) for e, a in pairs if self.c.kind(e) != "Alias"]
        return new

    # --- comparisons with private subqueries ---

    def _voted(self, plan):
        """A filter whose conjuncts compare with private scalar subqueries, as votes."""
        base, rest, votes = plan.child(), [], []
        for cond in self.c.conjuncts(plan.condition()):
            held = [e for e in self.c.walk(cond) if self.c.holds_plan(e) and self.checker.has_target(e.plan())]
            votes_on = bool(held) and all(self.c.kind(e) == "ScalarSubquery" for e in held)
            (votes.append((cond, held)) if votes_on else rest.append(cond))
        if not votes:
            return plan
        outer = self.c.list(base.output())
        df = self.c.frame(base if not rest else self._released_subqueries(self.c.filter(self._and(rest), base)))
        for n, (cond, subs) in enumerate(votes):
            df = self._vote(df, cond, subs, n)
        return self.c.project(outer, self.c.plan(df))

    def _and(self, conds):
        out = self.c.column(conds[0])
        for c in conds[1:]:
            out = out & self.c.column(c)
        return self.c.expression(out)

    def _vote(self, df: DataFrame, cond, subs: list, n: int) -> DataFrame:
        """The rows of df for which the worlds of the subqueries vote for the condition; several are compared world by world."""
        for k, sub in enumerate(subs):
            worlds, outer = self._worlds_of(sub, f"{n}_{k}")
            if outer:
                df = df.join(worlds, [self.c.column(out) == F.col(f"__c{n}_{k}_{i}") for i, out in enumerate(outer)])
            else:
                df = df.join(F.broadcast(worlds))  # one row

        def body(z: Column) -> Column:
            ids = [s.exprId().id() for s in subs]

            def found(x):
                if self.c.kind(x) != "ScalarSubquery" or x.exprId().id() not in ids:
                    return None
                return self.c.expression(z[f"w{ids.index(x.exprId().id())}"])

            return self.c.column(self.c.replace(cond, found))

        zipped = F.arrays_zip(*[F.col(f"__w{n}_{k}").alias(f"w{k}") for k in range(len(subs))])
        return df.where(filter_list(F.transform(zipped, body), self.settings))

    def _worlds_of(self, sub, name: str) -> tuple[DataFrame, list]:
        """__w<name>: the worlds of a private scalar subquery, by __c<name>_i, its values of the outer columns that are returned."""
        wrap, agg = [], sub.plan()
        while self.c.kind(agg) != "Aggregate":
            if self.c.kind(agg) not in ("Project", "SubqueryAlias", "View"):
                raise RejectedQuery("a private subquery must be one aggregate")
            wrap.append(agg)
            agg = agg.child()
        agg, pairs = self._decorrelated(agg)
        lists, groups, nodes, aggs, _ = self._lists(agg, [inner for _, inner in pairs])
        expr = self.c.list(agg.aggregateExpressions())[0]
        expr = expr.child() if self.c.kind(expr) == "Alias" else expr
        ids = {self.c.list(agg.aggregateExpressions())[0].exprId().id(): expr}
        for p in reversed(wrap):  # what is computed of the aggregate above it
            if self.c.kind(p) == "Project":
                top = self.c.list(p.projectList())[0]
                bare = top.child() if top.nodeName() == "Alias" else top
                expr = self.c.replace(bare, lambda x: ids.get(x.exprId().id()) if self.c.kind(x) == "AttributeReference" else None)
                ids[top.exprId().id()] = expr
        worlds = lists.select(*[F.col(f"__g{i}").alias(f"__c{name}_{i}") for i in range(len(groups))], self._in_worlds(expr, nodes, aggs, groups).alias(f"__w{name}"))
        return worlds, [out for out, _ in pairs]

    def _decorrelated(self, agg):
        """The aggregate without conditions on outer columns, and the pairs (outer, inner) that were equal in them."""
        pairs = []

        def strip(plan):
            if self.checker.table_name(plan) is not None:
                return plan
            new = [strip(k) for k in self.c.children(plan)]
            plan = self.c.with_children(plan, new) if new else plan
            if self.c.kind(plan) != "Filter":
                return plan
            keep = []
            for cond in self.c.conjuncts(plan.condition()):
                outer = [e for e in self.c.walk(cond) if self.c.kind(e) == "OuterReference"]
                if not outer:
                    keep.append(cond)
                    continue
                kids = self.c.children(cond)
                if self.c.kind(cond) != "EqualTo" or sum(self.c.kind(k) == "OuterReference" for k in kids) != 1:
                    raise RejectedQuery("a private subquery may be correlated by equalities only")
                out, inner = kids if kids[0].nodeName() == "OuterReference" else kids[::-1]
                pairs.append((self.c.children(out)[0] if self.c.children(out) else out.e(), inner))
            return self.c.filter(self._and(keep), plan.child()) if keep else plan.child()

        child = strip(agg.child())
        return (self.c.with_children(agg, [child]) if pairs else agg), pairs
