"""Syntax trees to DataFrame plans.

A binding table is a DataFrame and a scope. A node variable ``n`` is a column
``n`` with its id and hidden columns ``n.<property>`` and ``n.#labels``, so the
optimizer prunes what is not used; a quantified edge variable is an array of
structs in path order. Correlated subqueries are joins: the subquery runs once
over the distinct values of what it imports, and its rows are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import scalar
from skein.functions.aggregates import aggregate, when_empty
from skein.sources.graph import PropertyGraph, label_fits

from .parser import GqlError
from .syntax import Clause, Compose, EdgePattern, Ex, Explain, Match, Next, NodePattern, Project, Query


#: Most different arguments that a procedure is called with for the rows before it.
MOST_CALLS = 1000


def trees(x: Any) -> Iterator[Any]:
    """Every syntax node below, itself included."""
    if is_dataclass(x):
        yield x
        for f in fields(x):
            yield from trees(getattr(x, f.name))
    elif isinstance(x, list | tuple):
        for y in x:
            yield from trees(y)


def names_used(x: Any) -> set:
    """Variables that a tree mentions."""
    out = {t.data for t in trees(x) if isinstance(t, Ex) and t.op == "var"}
    for t in trees(x):
        if isinstance(t, NodePattern | EdgePattern):
            out.add(t.var)
        if isinstance(t, Clause) and t.kind == "subcall" and t.data[0]:
            out |= set(t.data[0])
    return out


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


@dataclass(frozen=True)
class Bound:
    """kind: node, edge, edges (quantified), path or value. label: the label expression that a node or edge is known to fit, if any."""

    kind: str
    label: Any = None


@dataclass(frozen=True)
class Table:
    """carry: columns that tell apart the rows of an outer query which this one runs for. unique: a variable whose values do not repeat, as it was just scanned.
    times: a column that says how many rows of the pattern a row stands for.
    """

    df: DataFrame | None
    scope: dict
    carry: tuple = ()
    unique: str | None = None
    times: str | None = None

    def owned(self, var: str) -> list[str]:
        return [c for c in self.df.columns if c == var or c.startswith(var + ".")] if self.df is not None else []


@dataclass
class Context:
    graph: PropertyGraph
    params: dict = field(default_factory=dict)
    used: set | None = None
    procedures: Any = None
    catalog: Any = None
    count: int = 0
    extra_vars: set = field(default_factory=set)

    def fresh(self, prefix: str = "s") -> str:
        self.count += 1
        return f"#{prefix}{self.count}"


class Compiler:
    def __init__(self, ctx: Context):
        self.ctx, self.graph, self.spark = ctx, ctx.graph, ctx.graph.spark

    # statements

    def run(self, tree: Any) -> DataFrame:
        if isinstance(tree, Explain):
            df = self.run(tree.query)
            plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(plan,)], "plan string")
        self.ctx.used = {t.data for t in trees(tree) if isinstance(t, Ex) and t.op == "prop"} | {k for t in trees(tree) if isinstance(t, NodePattern | EdgePattern) for k, _ in t.props}
        self.ctx.used |= {a.args[1].data for a in trees(tree) if isinstance(a, Ex) and a.op == "fn" and a.data == "PROPERTY_EXISTS"}
        self.ctx.extra_vars = {a.data for x in trees(tree) if isinstance(x, Ex) and (x.op == "is_labeled" or x.op == "fn" and x.data in ("LABELS", "PROPERTY_EXISTS")) for a in x.args if a.op == "var"}
        return self.visible(self.query(tree, Table(None, {})))

    def visible(self, t: Table) -> DataFrame:
        """What a query returns: ids for nodes and edges, arrays of ids for quantified edges."""
        out = []
        for v, b in t.scope.items():
            c = col(v)
            out.append((F.transform(c, lambda e: e["id"]) if b.kind == "edges" else c).alias(v))
        df = t.df if t.df is not None else self.spark.range(1)
        return df.select(*out)

    def query(self, tree: Any, t: Table) -> Table:
        if isinstance(tree, Query):
            return self.pipeline(tree.clauses, t)
        if isinstance(tree, Compose):
            return self.compose(tree, t)
        if isinstance(tree, Next):
            left = self.query(tree.left, t)
            if names_used(tree.right) & set(left.scope):
                return self.query(tree.right, left)
            return self.query(tree.right, t)
        raise GqlError(f"{type(tree).__name__} is not a query")

    def compose(self, tree: Compose, t: Table) -> Table:
        left, right = self.query(tree.left, t), self.query(tree.right, t)
        if len(left.scope) != len(right.scope):
            raise GqlError("the arms of a set operation differ in their number of columns", "42N03")
        names = list(left.scope)
        keys = list(t.carry)
        a = self.visible_with(left, keys)
        b = self.visible_with(right, keys).toDF(*keys, *names)
        if tree.op == "OTHERWISE":
            there = a.select(*keys).distinct() if keys else a.limit(1).select(F.lit(1).alias("#one"))
            if keys:
                rest = b.join(there, on=[b[q(k)].eqNullSafe(there[q(k)]) for k in keys], how="left_anti")
            else:
                rest = b.join(there, F.lit(True), "left_anti")
            df = a.union(rest)
        else:
            df = {("UNION", True): a.union(b), ("INTERSECT", True): a.intersectAll(b), ("INTERSECT", False): a.intersect(b), ("EXCEPT", True): a.exceptAll(b), ("EXCEPT", False): a.subtract(b), ("UNION", False): a.union(b).distinct()}[tree.op, tree.every]
        return Table(df, {n: Bound("node") if left.scope[n].kind == right.scope.get(n, Bound("value")).kind == "node" else Bound("value") for n in names}, t.carry)

    def visible_with(self, t: Table, keys: list[str]) -> DataFrame:
        out = [F.transform(col(v), lambda e: e["id"]).alias(v) if b.kind == "edges" else col(v) for v, b in t.scope.items()]
        df = t.df if t.df is not None else self.spark.range(1)
        return df.select(*map(col, keys), *out)

    def pipeline(self, clauses: tuple, t: Table) -> Table:
        i = 0
        while i < len(clauses):
            c = clauses[i]
            if isinstance(c, Project) or isinstance(c, Query):
                tail = []
                while i + 1 < len(clauses) and isinstance(clauses[i + 1], Clause) and clauses[i + 1].kind in ("order", "offset", "limit"):
                    i += 1
                    tail.append(clauses[i])
                if isinstance(c, Query):  # SELECT
                    t = self.pipeline((*c.clauses, *tail), t)
                else:
                    t = self.project(c, t, tail)
            elif isinstance(c, Match):
                t = self.match(c, t, self.only_counted(c, clauses[i + 1 :], t))
            elif isinstance(c, Clause):
                if c.kind in ("order", "offset", "limit"):
                    tail = [c]
                    while i + 1 < len(clauses) and isinstance(clauses[i + 1], Clause) and clauses[i + 1].kind in ("order", "offset", "limit"):
                        i += 1
                        tail.append(clauses[i])
                    t = self.sorted(t, tail, lambda e, t=t: self.expr(e, t))
                else:
                    t = getattr(self, c.kind if c.kind not in ("for", "filter") else f"{c.kind}_")(c, t)
            else:
                raise GqlError(f"{type(c).__name__} is not allowed in a read")
            i += 1
        return t

    def only_counted(self, m: Match, after: tuple, t: Table) -> frozenset:
        """Places of a first MATCH's chains that only tell how often a row occurs: they meet what stands before at one end alone, no other
        of their variables is used, and what follows is an aggregate that takes such numbers."""
        if t.df is not None or t.scope or len(m.chains) < 2 or m.optional or m.different_edges or m.mode != "WALK" or m.selector or not after:
            return frozenset()
        p = after[0]
        if not isinstance(p, Project) or p.items is None or p.having is not None or p.where is not None:
            return frozenset()
        tail = [c for c in after[1:] if isinstance(c, Clause) and c.kind in ("order", "offset", "limit")]
        orders = [e for c in tail if c.kind == "order" for e, _, _ in c.data]
        parts = [e for e, _ in p.items] + list(p.group or ()) + orders
        aggs = [x for e in parts for x in e.walk() if x.op == "agg"]
        if not aggs or any(isinstance(x, Query | Compose | Next | Match | Project) for x in trees(parts)):
            return frozenset()
        if not all(a.data[0] in ("COUNT", "MIN", "MAX") or a.data[0] in ("SUM", "AVG", "COLLECT_LIST") and a.data[1] for a in aggs):
            return frozenset()
        used = names_used(after) | names_used(m.where)
        out, seen = set(), {x.var for x in m.chains[0].items}
        for k, chain in enumerate(m.chains[1:], 1):
            own = [x.var for x in chain.items]
            rest = {x.var for i, ch in enumerate(m.chains) if i != k for x in ch.items}
            shared = [v for v in own if v in seen]
            single = len(own) == len(set(own)) and len(shared) == 1 and shared[0] in (own[0], own[-1])
            loose = not (set(own) - set(shared)) & (used | rest)
            simple = chain.path is None and all(e.quantifier is None for e in chain.items[1::2]) and not any(names_used([v for _, v in x.props] + [x.where]) - {x.var} for x in chain.items)
            if len(own) > 1 and single and loose and simple:
                out.add(k)
            else:
                seen |= set(own)
        return frozenset(out)

    def unit(self, t: Table) -> Table:
        return t if t.df is not None else replace(t, df=self.spark.range(1).select(F.lit(1).alias("#unit")))

    def use(self, c: Clause, t: Table) -> Table:
        if self.ctx.catalog is None:
            raise GqlError(f"there is no graph {c.data}", "42002")
        self.graph = self.ctx.catalog.graph(c.data)
        return t

    def filter_(self, c: Clause, t: Table) -> Table:
        return self.filtered(self.unit(t), c.data)

    def filtered(self, t: Table, e: Ex | None) -> Table:
        """Rows for which the condition is true. EXISTS and NOT EXISTS among its conjuncts are semi and anti joins."""
        if e is None:
            return t
        if e.op == "and":
            return self.filtered(self.filtered(t, e.args[0]), e.args[1])
        no = e.op == "not" and e.args[0].op == "exists"
        if e.op == "exists" or no:
            sub = (e.args[0] if no else e).data
            inner, keys = self.correlated(sub, t, once=True)
            if not keys:
                found = inner.df.limit(1).select(F.lit(1).alias("#one"))
                return replace(t, df=t.df.join(found, F.lit(True), "left_anti" if no else "left_semi"))
            found = inner.df.select(*[col(k) for k in inner.carry]).distinct()
            return replace(t, df=t.df.join(found, self.same(keys, inner.carry), "left_anti" if no else "left_semi"))
        t2, e = self.with_subqueries(t, e)
        kept = t2.df.filter(self.truth(e, t2))
        return replace(t, df=kept.select(*map(col, t.df.columns)) if t2 is not t else kept)

    @staticmethod
    def same(keys: list[str], others: tuple) -> Column:
        return reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(o)) for k, o in zip(keys, others, strict=True)])

    def correlated(self, sub: Any, t: Table, once: bool = False, imports: list | None = None) -> tuple[Table, list[str]]:
        """A subquery over the distinct values of the variables it takes from ``t``; and the names of these columns in ``t``."""
        wanted = [v for v in t.scope if v in (names_used(sub) if imports is None else imports)]
        if not wanted:
            return self.query(sub, Table(None, {})) if not once else self.unit(self.query(sub, Table(None, {}))), []
        owned = [c for v in wanted for c in t.owned(v)]
        keys = list(wanted) if all(t.scope[v].kind in ("node", "edge") for v in wanted) else owned
        seeds = t.df.select(*map(col, owned))
        if keys != [t.unique]:
            seeds = seeds.dropDuplicates(keys)
        carry = tuple(self.ctx.fresh("k") for _ in keys)
        seeds = seeds.select(*map(col, owned), *[col(k).alias(n) for k, n in zip(keys, carry, strict=True)])
        inner = self.query(sub, Table(seeds, {v: t.scope[v] for v in wanted}, carry))
        return inner, keys

    def with_subqueries(self, t: Table, e: Ex) -> tuple[Table, Ex]:
        """EXISTS and VALUE inside an expression become columns of ``t``."""
        if not any(x.op in ("exists", "value") for x in e.walk()):
            return t, e
        t = self.unit(t)
        if e.op == "exists":
            inner, keys = self.correlated(e.data, t, once=True)
            name = self.ctx.fresh("x")
            if keys:
                found = inner.df.select(*map(col, inner.carry)).distinct().withColumn(name, F.lit(True))
                df = t.df.join(found, self.same(keys, inner.carry), "left").drop(*inner.carry)
            else:
                df = t.df.crossJoin(inner.df.limit(1).agg((F.count("*") > 0).alias(name)))
            df = df.withColumn(name, F.coalesce(col(name), F.lit(False)))
            return replace(t, df=df), Ex("column", data=name)
        if e.op == "value":
            inner, keys = self.correlated(self.first_row(e.data), t)
            if len(inner.scope) != 1:
                raise GqlError("a value subquery returns one column")
            (out,) = inner.scope
            name = self.ctx.fresh("v")
            one = inner.df.select(*map(col, inner.carry), col(out).alias(name))
            if not isinstance(e.data, Query):
                one = one.dropDuplicates(list(inner.carry)) if keys else one.limit(1)
            df = t.df.join(one, self.same(keys, inner.carry) if keys else F.lit(True), "left").drop(*inner.carry)
            empty = self.empty_value(e.data)
            if empty is not None and keys:
                df = df.withColumn(name, F.coalesce(col(name), F.lit(empty) if not isinstance(empty, list) else F.array().cast(df.schema[name].dataType)))
            return replace(t, df=df), Ex("column", data=name)
        args = []
        for a in e.args:
            t, a = self.with_subqueries(t, a)
            args.append(a)
        return t, replace(e, args=tuple(args))

    def first_row(self, sub: Any) -> Any:
        """A value subquery cut to its first row; without an order, to the one with the least value. A lone aggregate has one row already."""
        if not isinstance(sub, Query):
            return sub
        tail = len(sub.clauses)
        while tail and isinstance(sub.clauses[tail - 1], Clause) and sub.clauses[tail - 1].kind in ("order", "offset", "limit"):
            tail -= 1
        last, rest = sub.clauses[tail - 1] if tail else None, sub.clauses[tail:]
        names = last.clauses[-1] if isinstance(last, Query) else last
        if isinstance(names, Project) and names.items and not names.group and all(e.op == "agg" for e, _ in names.items):
            return sub
        if any(c.kind == "limit" and self.constant(c.data) == 0 for c in rest):
            return sub
        if not any(c.kind == "order" for c in rest) and isinstance(names, Project) and names.items and len(names.items) == 1:
            rest = (Clause("order", ((Ex("var", data=names.items[0][1]), False, None),)), *rest)
        return Query((*sub.clauses[:tail], *rest, Clause("limit", Ex("lit", data=1))))

    @staticmethod
    def empty_value(sub: Any) -> Any:
        """What a subquery's single aggregate gives over no rows, or None."""
        last = sub.clauses[-1] if isinstance(sub, Query) else None
        if isinstance(last, Project) and last.items and len(last.items) == 1 and last.items[0][0].op == "agg" and not last.group:
            return when_empty(last.items[0][0].data[0])
        return None

    def let(self, c: Clause, t: Table) -> Table:
        t = self.unit(t)
        for var, e in c.data:
            if var in t.scope:
                raise GqlError(f"{var} is bound already", "42N04")
            t2, e = self.with_subqueries(t, e)
            t = Table(t2.df.withColumn(var, self.expr(e, t2)), {**t.scope, var: self.kind_of(e, t)}, t.carry)
        return t

    def kind_of(self, e: Ex, t: Table) -> Bound:
        if e.op == "var" and e.data in t.scope:
            return t.scope[e.data]
        return Bound("path") if e.op == "path" else Bound("value")

    def for_(self, c: Clause, t: Table) -> Table:
        var, source, position = c.data
        t = self.unit(t)
        t2, source = self.with_subqueries(t, source)
        values = self.expr(source, t2)
        if not isinstance(t2.df.select(values.alias("x")).schema["x"].dataType, T.ArrayType):
            values = values.cast("array<string>")
        df = t2.df.select(*map(col, t.df.columns), F.posexplode(values).alias("#at", var))
        scope = {**t.scope, var: Bound("value")}
        if position:
            df = df.withColumn(position[1], (col("#at") + (1 if position[0] == "ORDINALITY" else 0)).cast("long"))
            scope[position[1]] = Bound("value")
        return Table(df.drop("#at"), scope, t.carry)

    # projection

    def project(self, p: Project, t: Table, tail: list[Clause]) -> Table:
        t = self.unit(t)
        if p.nothing:
            return Table(t.df.limit(0).select(*map(col, t.carry)), {}, t.carry)
        items = p.items
        if items is None:
            items = tuple((Ex("var", data=v), v) for v in t.scope if not v.startswith("·"))
        if len({n for _, n in items}) != len(items):
            raise GqlError("two columns have one name", "42N05")
        for e, n in items:
            t, e2 = self.with_subqueries(t, e)
            items = tuple((e2, n) if pair == (e, n) else pair for pair in items)
        aggregated = p.group is not None or any(x.op == "agg" for e, _ in items for x in e.walk()) or p.having is not None
        if aggregated:
            return self.grouped(p, items, t, tail)
        scope = {n: self.kind_of(e, t) for e, n in items}
        outs = []
        for e, n in items:
            outs.append(self.expr(e, t).alias(n))
            if e.op == "var" and scope[n].kind in ("node", "edge"):
                outs += [col(c).alias(n + c[len(e.data) :]) for c in t.owned(e.data) if c != e.data]
        aliases = {n: e for e, n in items}
        extra: list[Column] = []
        names: dict[Ex, str] = {}
        for c in tail:
            if c.kind == "order" and not p.distinct:
                for e, _, _ in c.data:
                    if not (e.op == "var" and e.data in aliases) and not (names_used(e) <= set(aliases) and not names_used(e) <= set(t.scope)):
                        names[e] = self.ctx.fresh("o")
                        extra.append(self.expr(e, t).alias(names[e]))
        df = t.df.select(*map(col, t.carry), *outs, *extra)
        if p.distinct:
            keys = [*t.carry, *(n for _, n in items)]
            df = df.dropDuplicates(keys) if len(keys) < len(df.columns) else df.distinct()
        out = Table(df, scope, t.carry)
        if tail:
            out = self.sorted(out, tail, lambda e: col(names[e]) if e in names else self.expr(e, out))
            out = replace(out, df=out.df.drop(*names.values()))
        return self.filtered(out, p.where)

    def grouped(self, p: Project, items: tuple, t: Table, tail: list[Clause]) -> Table:
        aliases = {n: e for e, n in items}
        has_agg = lambda e: any(x.op == "agg" for x in e.walk())
        if p.group is None:
            keys = [e for e, _ in items if not has_agg(e)]
        else:
            keys = [aliases[e.data] if e.op == "var" and e.data in aliases and e.data not in t.scope else e for e in p.group]
        keys = list(dict.fromkeys(keys))
        wanted = [e for e, _ in items] + ([p.having] if p.having is not None else []) + [e for c in tail if c.kind == "order" for e, _, _ in c.data]
        aggs = list(dict.fromkeys(x for e in wanted for x in e.walk() if x.op == "agg"))
        if any(y.op == "agg" for a in aggs for arg in a.args for y in arg.walk()):
            raise GqlError("an aggregate inside an aggregate")
        key_name = {e: f"#g{i}" for i, e in enumerate(keys)}
        agg_name = {a: f"#a{i}" for i, a in enumerate(aggs)}
        by = [*map(col, t.carry), *(self.expr(e, t).alias(key_name[e]) for e in keys)]
        hidden = []
        for e in keys:  # a node or edge as key brings its properties along
            if e.op == "var" and t.scope.get(e.data, Bound("value")).kind in ("node", "edge"):
                hidden += [(c, e.data) for c in t.owned(e.data) if c != e.data]
        calls = [aggregate(a.data[0], a.data[1], [self.expr(x, t) for x in a.args], col(t.times) if t.times else None).alias(agg_name[a]) for a in aggs]
        calls += [F.first(col(c)).alias(c) for c, _ in hidden]
        if by:
            df = t.df.groupBy(*by).agg(*calls) if calls else t.df.select(*by).distinct()
        else:
            df = t.df.agg(*calls) if calls else t.df.limit(1).select(F.lit(1).alias("#unit"))
        inner = Table(df, {}, t.carry)

        def swap(e: Ex) -> Ex:
            if e in agg_name:
                return Ex("column", data=agg_name[e])
            if e in key_name:
                return Ex("column", data=key_name[e])
            if e.op == "var" and e.data in aliases and aliases[e.data] is not e and e.data not in t.scope:
                return swap(aliases[e.data])
            if e.op == "var":
                raise GqlError(f"{e.data} is neither grouped nor aggregated", "42N06")
            return replace(e, args=tuple(swap(a) if isinstance(a, Ex) else a for a in e.args))

        if p.having is not None:
            inner = replace(inner, df=inner.df.filter(self.expr(swap(p.having), inner)))
        scope = {n: self.kind_of(e, t) if e in key_name else Bound("value") for e, n in items}
        outs = [self.expr(swap(e), inner).alias(n) for e, n in items]
        for e, n in items:
            if e.op == "var" and scope[n].kind in ("node", "edge"):
                outs += [col(c).alias(n + c[len(v) :]) for c, v in hidden if v == e.data]
        orders: dict[Ex, str] = {}
        extra = []
        for c in tail:
            if c.kind == "order":
                for e, _, _ in c.data:
                    if not (e.op == "var" and e.data in aliases):
                        orders[e] = self.ctx.fresh("o")
                        extra.append(self.expr(swap(e), inner).alias(orders[e]))
        out = Table(inner.df.select(*map(col, t.carry), *outs, *extra), scope, t.carry)
        if p.distinct:
            out = replace(out, df=out.df.distinct())
        if tail:
            out = self.sorted(out, tail, lambda e: col(orders[e]) if e in orders else self.expr(e, out))
            out = replace(out, df=out.df.drop(*orders.values()))
        return self.filtered(out, p.where)

    def sorted(self, t: Table, tail: list[Clause], value) -> Table:
        """ORDER BY, OFFSET and LIMIT; for each outer row if there is one. Nulls are last in ascending order and first in descending."""
        t = self.unit(t)
        orders = []
        for c in tail:
            if c.kind == "order":
                orders = []
                for e, desc, nulls in c.data:
                    v = value(e)
                    first = nulls == "FIRST" or nulls is None and desc
                    orders.append((v.desc_nulls_first() if first else v.desc_nulls_last()) if desc else (v.asc_nulls_first() if first else v.asc_nulls_last()))
        number = {c.kind: self.constant(c.data) for c in tail if c.kind in ("offset", "limit")}
        for k, n in number.items():
            if not isinstance(n, int) or n < 0:
                raise GqlError(f"{k} takes a whole number that is not negative", "22G02")
        df = t.df
        if t.carry:
            if number:
                w = Window.partitionBy(*map(col, t.carry)).orderBy(*(orders or [F.lit(1)]))
                at = self.ctx.fresh("n")
                df = df.withColumn(at, F.row_number().over(w))
                low = number.get("offset", 0)
                df = df.filter(col(at) > low)
                if "limit" in number:
                    df = df.filter(col(at) <= low + number["limit"])
                df = df.drop(at)
            return replace(t, df=df)
        if orders:
            df = df.orderBy(*orders)
        if "offset" in number:
            df = df.offset(number["offset"])
        if "limit" in number:
            df = df.limit(number["limit"])
        return replace(t, df=df)

    def constant(self, e: Ex) -> Any:
        if e.op == "param":
            if e.data not in self.ctx.params:
                raise GqlError(f"parameter ${e.data} has no value", "42N07")
            return self.ctx.params[e.data]
        if e.op == "lit":
            return e.data
        if e.op == "null":
            return None
        if e.op == "negative":
            return -self.constant(e.args[0])
        if e.op == "list":
            return [self.constant(a) for a in e.args]
        if e.op == "record":
            return dict(zip(e.data, map(self.constant, e.args), strict=True))
        if e.op == "cast":
            return self.constant(e.args[0])
        raise GqlError("a constant is needed here", "42N08")

    # calls

    def subcall(self, c: Clause, t: Table) -> Table:
        scope, sub = c.data
        if t.df is None or not t.scope:
            inner = self.query(sub, Table(None, {}))
            return inner if t.df is None else replace(t, df=t.df.crossJoin(self.visible(inner)), scope={**t.scope, **inner.scope})
        inner, keys = self.correlated(sub, t, imports=scope)
        new = [v for v in inner.scope if v not in t.scope]
        own = [x for v in new for x in inner.owned(v)]
        if not keys:
            how = inner.df.select(*map(col, own))
            df = t.df.join(how, F.lit(True), "left") if c.optional else t.df.crossJoin(how)
            return replace(t, df=df, scope={**t.scope, **{v: inner.scope[v] for v in new}})
        last = sub.clauses[-1] if isinstance(sub, Query) else None
        total = isinstance(last, Project) and last.items and not last.group and all(e.op == "agg" for e, _ in last.items)
        df = t.df.join(inner.df.select(*map(col, inner.carry), *map(col, own)), self.same(keys, inner.carry), "left" if c.optional or total else "inner").drop(*inner.carry)
        if total:
            for e, n in last.items:
                empty = when_empty(e.data[0])
                if empty is not None:
                    df = df.withColumn(n, F.coalesce(col(n), F.array().cast(df.schema[n].dataType) if isinstance(empty, list) else F.lit(empty)))
        return replace(t, df=df, scope={**t.scope, **{v: inner.scope[v] for v in new}})

    def call(self, c: Clause, t: Table) -> Table:
        """A procedure's rows beside those before it. With arguments that depend on these, it runs once for each distinct tuple of arguments."""
        name, args, wanted = c.data
        if self.ctx.procedures is None or name not in self.ctx.procedures:
            raise GqlError(f"there is no procedure {name}", "42N02")
        if any(names_used(a) & set(t.scope) for a in args):
            return self.call_for_each(c, t)
        df = self.yielded(name, [self.constant(a) for a in args], wanted)
        kinds = yielded_kinds(df.columns)
        if t.df is None:
            return Table(df, kinds)
        return Table(t.df.join(df, F.lit(True), "left") if c.optional else t.df.crossJoin(df), {**t.scope, **kinds}, t.carry)

    def yielded(self, name: str, values: list, wanted: Any) -> DataFrame:
        df = self.ctx.procedures[name](self.graph, *values)
        if wanted and wanted[0][0] != "*":
            missing = [n for n, _ in wanted if n not in df.columns]
            if missing:
                raise GqlError(f"{name} does not yield {missing[0]}", "42N09")
            df = df.select(*[col(n).alias(a) for n, a in wanted])
        return df

    def call_for_each(self, c: Clause, t: Table) -> Table:
        """The arguments' distinct tuples come to the driver, within a bound, as a procedure builds a plan of its own; their results are joined back."""
        name, args, wanted = c.data
        varying = [i for i, a in enumerate(args) if names_used(a) & set(t.scope)]
        keys = {i: self.ctx.fresh("c") for i in varying}
        df = t.df
        for i in varying:
            df = df.withColumn(keys[i], self.expr(args[i], t))
        tuples = [tuple(r) for r in df.select(*map(col, keys.values())).distinct().limit(MOST_CALLS + 1).collect()]
        if len(tuples) > MOST_CALLS:
            raise GqlError(f"a procedure is called with {MOST_CALLS} different arguments at most", "5GQL2")
        kinds = df.select(*map(col, keys.values())).schema
        parts = []
        for at, values in enumerate(tuples):
            given = dict(zip(varying, values, strict=True))
            rows = self.yielded(name, [given[i] if i in given else self.constant(a) for i, a in enumerate(args)], wanted)
            parts.append(rows.withColumn("#call", F.lit(at)))
        if not parts:  # no row to call it for
            out = [a for _, a in wanted] if wanted and wanted[0][0] != "*" else self.ctx.procedures.columns(name)
            none = df.limit(0).select(*map(col, t.df.columns), *[F.lit(None).cast("long").alias(n) for n in out])
            return Table(none, {**t.scope, **yielded_kinds(out)}, t.carry)
        found = reduce(lambda a, b: a.unionByName(b), parts)
        numbers = self.spark.createDataFrame([(at, *values) for at, values in enumerate(tuples)], T.StructType([T.StructField("#n", T.IntegerType()), *kinds.fields]))
        renamed = {k: self.ctx.fresh("c") for k in keys.values()}
        numbers = numbers.select("#n", *[col(k).alias(v) for k, v in renamed.items()])
        joined = df.join(F.broadcast(numbers), self.same(list(renamed), tuple(renamed.values()))).drop(*renamed, *renamed.values())
        scope = yielded_kinds([n for n in found.columns if n != "#call"])
        joined = joined.join(found, col("#n") == col("#call"), "left" if c.optional else "inner").drop("#n", "#call")
        return Table(joined, {**t.scope, **scope}, t.carry)

    # patterns

    def match(self, m: Match, t: Table, counted: frozenset = frozenset()) -> Table:
        from skein.operators.paths import match_pattern

        if not m.optional:
            return self.filtered(match_pattern(self, m, t, counted), m.where)
        t = self.unit(t)
        inner_match = replace(m, optional=False)
        new = [x.var for ch in m.chains for x in ch.items if x.named] + [ch.path for ch in m.chains if ch.path]
        new = [v for v in dict.fromkeys(new) if v not in t.scope]
        sub = Query((inner_match,))
        if not t.scope:
            inner = self.query(sub, Table(None, {}))
            df = t.df.join(inner.df, F.lit(True), "left")
            return Table(df, {v: inner.scope[v] for v in new}, t.carry)
        inner, keys = self.correlated(sub, t)
        own = [x for v in new for x in inner.owned(v)]
        right = inner.df.select(*map(col, inner.carry), *map(col, own))
        df = t.df.join(right, self.same(keys, inner.carry) if keys else F.lit(True), "left").drop(*inner.carry)
        return Table(df, {**t.scope, **{v: inner.scope[v] for v in new}}, t.carry)

    # expressions

    def dtype(self, c: Column, t: Table) -> T.DataType:
        df = t.df if t.df is not None else self.spark.range(1)
        return df.select(c.alias("x")).schema["x"].dataType

    def expr(self, e: Ex, t: Table) -> Column:
        f = getattr(self, f"e_{e.op}", None)
        if f is None:
            raise GqlError(f"{e.op} cannot stand here")
        return f(e, t)

    def e_column(self, e: Ex, t: Table) -> Column:
        return col(e.data)

    def e_lit(self, e: Ex, t: Table) -> Column:
        if isinstance(e.data, int) and not isinstance(e.data, bool):
            return F.lit(e.data).cast("long") if abs(e.data) < 1 << 63 else F.lit(str(e.data)).cast("decimal(38,0)")
        return F.lit(e.data)

    def e_null(self, e: Ex, t: Table) -> Column:
        return F.lit(None).cast(e.data) if e.data else F.lit(None)

    def e_param(self, e: Ex, t: Table) -> Column:
        return self.value(self.constant(e))

    def value(self, v: Any) -> Column:
        if isinstance(v, list | tuple):
            return F.array(*map(self.value, v))
        if isinstance(v, dict):
            return F.struct(*[self.value(x).alias(k) for k, x in v.items()])
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("long")
        return F.lit(v)

    def e_var(self, e: Ex, t: Table) -> Column:
        if e.data not in t.scope:
            raise GqlError(f"{e.data} is not bound", "42N10")
        return col(e.data)

    def e_prop(self, e: Ex, t: Table) -> Column:
        base = e.args[0]
        if base.op == "var" and base.data in t.scope:
            b = t.scope[base.data]
            if b.kind in ("node", "edge"):
                name = f"{base.data}.{e.data}"
                return col(name) if name in t.df.columns else F.lit(None)
        c = self.expr(base, t)
        kind = self.dtype(c, t)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: x[e.data] if e.data in kind.elementType.names else F.lit(None))
        if isinstance(kind, T.StructType):
            return c.getField(e.data) if e.data in kind.names else F.lit(None)
        if isinstance(kind, T.MapType):
            return c.getItem(e.data)
        if isinstance(kind, T.NullType):
            return F.lit(None)
        raise GqlError(f"a value of {kind.simpleString()} has no property {e.data}", "22G03")

    def truth(self, e: Ex, t: Table) -> Column:
        """A condition of which only true counts: guards are conjuncts of their own, so that plain comparisons reach the scan."""
        if e.op in ("and", "or"):
            a, b = (self.truth(x, t) for x in e.args)
            return a & b if e.op == "and" else a | b
        if e.op == "compare":
            a, b = (self.expr(x, t) for x in e.args)
            kinds = self.dtype(a, t), self.dtype(b, t)
            if not any(isinstance(k, T.ArrayType | T.StructType) for k in kinds):
                out = self.compared(e.data, a, b)
                for x, c, k in zip(e.args, (a, b), kinds, strict=True):
                    # a NaN lies above all numbers here, so a lesser or equal number on its other side is never true by mistake
                    above = {"<": 1, "<=": 1, ">": 0, ">=": 0}.get(e.data)
                    if isinstance(k, scalar.FLOATING) and x.op != "lit" and not (above is not None and e.args.index(x) != above and e.args[above].op == "lit") and not (e.data == "=" and any(y.op == "lit" for y in e.args)):
                        out = out & ~F.isnan(c)
                return out
        return self.expr(e, t)

    @staticmethod
    def compared(op: str, a: Column, b: Column) -> Column:
        return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()

    def e_and(self, e: Ex, t: Table) -> Column:
        return self.expr(e.args[0], t) & self.expr(e.args[1], t)

    def e_or(self, e: Ex, t: Table) -> Column:
        return self.expr(e.args[0], t) | self.expr(e.args[1], t)

    def e_xor(self, e: Ex, t: Table) -> Column:
        return self.expr(e.args[0], t) != self.expr(e.args[1], t)

    def e_not(self, e: Ex, t: Table) -> Column:
        return ~self.expr(e.args[0], t)

    def e_compare(self, e: Ex, t: Table) -> Column:
        """Three-valued; a NaN operand and, for lists and records, an undecided member give null."""
        a, b = (self.expr(x, t) for x in e.args)
        ka, kb = self.dtype(a, t), self.dtype(b, t)
        if e.data in ("=", "<>") and isinstance(ka, T.ArrayType | T.StructType) and type(ka) is type(kb):
            out = equal(a, b, ka, kb)
            return out if e.data == "=" else ~out
        out = self.compared(e.data, a, b)
        floats = [x for x, k in ((a, ka), (b, kb)) if isinstance(k, scalar.FLOATING)]
        literal = [x.op == "lit" for x in e.args]
        if floats and not all(literal):
            nan = reduce(lambda x, y: x | y, [F.isnan(x) for x, k, lit in ((a, ka, literal[0]), (b, kb, literal[1])) if isinstance(k, scalar.FLOATING) and not lit] or [F.lit(False)])
            return F.when(~nan, out)
        return out

    def e_arith(self, e: Ex, t: Table) -> Column:
        a, b = (self.expr(x, t) for x in e.args)
        if e.data == "/":
            ka, kb = self.dtype(a, t), self.dtype(b, t)
            if isinstance(ka, scalar.INTERVALS):
                return a / b
            return scalar.division(a, b, isinstance(ka, scalar.INTEGRAL) and isinstance(kb, scalar.INTEGRAL))
        if e.data in "+-":
            ka, kb = self.dtype(a, t), self.dtype(b, t)
            if isinstance(ka, T.DateType) and isinstance(kb, scalar.INTERVALS):
                return scalar.date_moved(a, b, kb, 1 if e.data == "+" else -1)
            if isinstance(kb, T.DateType) and isinstance(ka, scalar.INTERVALS) and e.data == "+":
                return scalar.date_moved(b, a, ka, 1)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[e.data]()

    def e_negative(self, e: Ex, t: Table) -> Column:
        return -self.expr(e.args[0], t)

    def e_concat(self, e: Ex, t: Table) -> Column:
        a, b = (self.expr(x, t) for x in e.args)
        return F.concat(a, b)

    def e_in(self, e: Ex, t: Table) -> Column:
        x, y = e.args
        if y.op == "list":
            if not y.args:
                return F.lit(False)
            if all(a.op in ("lit", "null", "param") for a in y.args):
                return self.expr(x, t).isin(*[self.expr(a, t) for a in y.args])
            return reduce(lambda a, b: a | b, [self.expr(Ex("compare", (x, a), "="), t) for a in y.args])
        return F.array_contains(self.expr(y, t), self.expr(x, t))

    def e_startswith(self, e: Ex, t: Table) -> Column:
        return self.expr(e.args[0], t).startswith(self.expr(e.args[1], t))

    def e_endswith(self, e: Ex, t: Table) -> Column:
        return self.expr(e.args[0], t).endswith(self.expr(e.args[1], t))

    def e_contains(self, e: Ex, t: Table) -> Column:
        return self.expr(e.args[0], t).contains(self.expr(e.args[1], t))

    def e_is_null(self, e: Ex, t: Table) -> Column:
        return self.expr(e.args[0], t).isNull()

    def e_is_truth(self, e: Ex, t: Table) -> Column:
        x = self.expr(e.args[0], t).cast("boolean")
        return x.isNull() if e.data == "UNKNOWN" else x.eqNullSafe(F.lit(e.data == "TRUE"))

    def e_is_typed(self, e: Ex, t: Table) -> Column:
        x = self.expr(e.args[0], t)
        kind = self.dtype(x, t)

        def fits(name: str, args: tuple) -> bool:
            if name == "UNION":
                return any(fits(*a) for a in args)
            return name == "ANY" or isinstance(kind, T.NullType) or kind.simpleString() == T._parse_datatype_string(scalar.spark_type((name, args))).simpleString()

        strict = x.isNotNull() if "NOT NULL" in e.data[1] else F.lit(True)
        return strict & F.lit(fits(e.data[0], tuple(a for a in e.data[1] if a != "NOT NULL")))

    def e_is_normalized(self, e: Ex, t: Table) -> Column:
        x = self.expr(e.args[0], t)
        return x == scalar.normalized(x, F.lit(e.data))

    def e_normalize(self, e: Ex, t: Table) -> Column:
        return scalar.normalized(self.expr(e.args[0], t), F.lit(e.data))

    def element(self, e: Ex, t: Table, kinds: tuple[str, ...]) -> str:
        if e.op != "var" or e.data not in t.scope or t.scope[e.data].kind not in kinds:
            raise GqlError(f"{' or '.join(kinds)} is needed here", "22G03")
        return e.data

    def e_is_labeled(self, e: Ex, t: Table) -> Column:
        v = self.element(e.args[0], t, ("node", "edge"))
        name = f"{v}.#labels" if t.scope[v].kind == "node" else f"{v}.#label"
        return label_column(e.data, col(name), t.scope[v].kind == "edge")

    def e_is_directed(self, e: Ex, t: Table) -> Column:
        return col(self.element(e.args[0], t, ("edge",)) + ".#directed")

    def e_is_end(self, e: Ex, t: Table) -> Column:
        node, edge = self.element(e.args[0], t, ("node",)), self.element(e.args[1], t, ("edge",))
        return col(f"{edge}.#directed") & (col(node) == col(f"{edge}.#{e.data}"))

    def e_case(self, e: Ex, t: Table) -> Column:
        *parts, other = e.args
        out = F.when(self.expr(parts[0], t), self.expr(parts[1], t))
        for test, result in zip(parts[2::2], parts[3::2], strict=True):
            out = out.when(self.expr(test, t), self.expr(result, t))
        return out.otherwise(self.expr(other, t))

    def e_cast(self, e: Ex, t: Table) -> Column:
        if e.args[0].op == "var" and t.scope.get(e.args[0].data, Bound("value")).kind != "value":
            raise GqlError("nodes, edges and paths cannot be cast", "22G03")
        x = self.expr(e.args[0], t)
        return scalar.cast(x, e.data, self.dtype(x, t))

    def e_list(self, e: Ex, t: Table) -> Column:
        return F.array(*[self.expr(a, t) for a in e.args])

    def e_record(self, e: Ex, t: Table) -> Column:
        return F.struct(*[self.expr(a, t).alias(k) for k, a in zip(e.data, e.args, strict=True)])

    def e_path(self, e: Ex, t: Table) -> Column:
        items = [self.expr(a, t) for a in e.args]
        nodes, edges = items[::2], items[1::2]
        none = F.array().cast
        dirs = [self.direction(a, nodes[i], t) for i, a in enumerate(e.args[1::2])]
        return F.struct(F.array(*nodes).alias("nodes"), (F.array(*edges) if edges else none("array<long>")).alias("edges"), (F.array(*dirs) if dirs else none("array<tinyint>")).alias("dirs"))

    def direction(self, e: Ex, before: Column, t: Table) -> Column:
        """How a path takes an edge from the node before it: 0 out, 1 in, 2 undirected; null for an edge that is only known by its id."""
        v = e.data if e.op == "var" else None
        if v not in t.scope or t.scope[v].kind != "edge":
            return F.lit(None).cast("tinyint")
        return F.when(~col(f"{v}.#directed"), 2).when(before == col(f"{v}.#src"), 0).otherwise(1).cast("tinyint")

    def e_trim(self, e: Ex, t: Table) -> Column:
        return scalar.trimmed(e.data, self.expr(e.args[0], t), self.expr(e.args[1], t))

    def e_trim_list(self, e: Ex, t: Table) -> Column:
        return scalar.shorter_list(self.expr(e.args[0], t), self.expr(e.args[1], t).cast("int"))

    def e_duration_between(self, e: Ex, t: Table) -> Column:
        return scalar.duration_between(self.expr(e.args[0], t), self.expr(e.args[1], t), e.data)

    def e_now(self, e: Ex, t: Table) -> Column:
        return scalar.NOW[e.data]()

    def e_fn(self, e: Ex, t: Table) -> Column:
        if e.data == "ELEMENT_ID":
            return col(self.element(e.args[0], t, ("node", "edge")))
        if e.data == "LABELS":
            v = self.element(e.args[0], t, ("node", "edge"))
            return col(f"{v}.#labels") if t.scope[v].kind == "node" else F.array(col(f"{v}.#label"))
        if e.data == "PROPERTY_EXISTS":
            v = self.element(e.args[0], t, ("node", "edge"))
            name = f"{v}.{e.args[1].data}"
            return F.when(col(v).isNotNull(), col(name).isNotNull() if name in t.df.columns else F.lit(False))
        if e.data == "DURATION" and len(e.args) == 1 and e.args[0].op == "lit" and isinstance(e.args[0].data, str):
            return scalar.literal_duration(e.args[0].data)
        args = [self.expr(a, t) for a in e.args]
        types = [self.dtype(a, t) for a in args]
        paths = [isinstance(k, T.StructType) and {"nodes", "edges"} <= set(k.names) for k in types]
        return scalar.call(e.data, args, types, paths)


def yielded_kinds(names: list[str]) -> dict[str, Bound]:
    return {n: Bound("node") if n == "node_id" or n.endswith("node") else Bound("value") for n in names}


def equal(a: Column, b: Column, ka: T.DataType, kb: T.DataType) -> Column:
    """Member by member with three values: false if any differs, else null if any is undecided."""
    if isinstance(ka, T.StructType):
        if set(ka.names) != set(kb.names):
            return F.lit(False)
        return reduce(lambda x, y: x & y, [equal(a.getField(n), b.getField(n), ka[n].dataType, kb[n].dataType) for n in ka.names])
    if isinstance(ka, T.ArrayType):
        pairs = F.zip_with(a, b, lambda x, y: equal(x, y, ka.elementType, kb.elementType))
        return F.when(F.size(a) != F.size(b), F.lit(False)).when(a.isNotNull() & b.isNotNull(), F.aggregate(pairs, F.lit(True), lambda s, x: s & x))
    return a == b


def label_column(expr: Any, labels: Column, single: bool) -> Column:
    op, *rest = expr
    if op == "label":
        return labels == rest[0] if single else F.array_contains(labels, rest[0])
    if op == "any":
        return labels.isNotNull() if single else F.size(labels) > 0
    if op == "not":
        return ~label_column(rest[0], labels, single)
    a, b = (label_column(r, labels, single) for r in rest)
    return a & b if op == "and" else a | b


__all__ = ["Compiler", "Context", "Table", "Bound", "SparkSession", "label_fits"]
