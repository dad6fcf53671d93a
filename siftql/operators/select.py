"""SELECT and FILTER statements as DataFrame operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftql.lang import tree as t
from siftql.plans.expressions import Compiler, Scope, auto_name, has_aggregate, is_aggregate
from siftql.plans.values import BOOL, CompileProblem, Val, lit


class Planner:
    """Compiles statements against an engine's tables, filters and variables."""

    def __init__(self, engine, params: tuple = ()):
        self.engine, self.params, self.n = engine, params, 0

    def scope(self, columns: dict[str, Val], **more) -> Scope:
        e = self.engine
        return Scope(columns, variables=e.variables, params=self.params, filters=e.filters, functions=e.functions, **more)

    # Sources. Columns are renamed to unique ones, so that no two tables of a join clash.
    def relation(self, source: t.Source) -> tuple[DataFrame, dict[str, Val], list[tuple[str, str]]]:
        """Frame, names in scope, and (shown name, column) in order."""
        df = self.select(source.query) if source.query else self.engine.table(source.table)
        alias = source.alias or (source.table.split(".")[-1] if source.table else None)
        k = self.n
        self.n += 1
        shown = [(f.name, f"{f.name}#{k}") for f in df.schema.fields]
        types = [f.dataType for f in df.schema.fields]
        df = df.select(*[F.col(f"`{a}`").alias(b) for a, b in shown])
        names: dict[str, Val] = {}
        for (a, b), kind in zip(shown, types):
            v = Val(F.col(f"`{b}`"), kind)
            names.setdefault(a.lower(), v)
            if alias:
                names[f"{alias.lower()}.{a.lower()}"] = v
        return df, names, shown

    def joined(self, s: t.Select):
        if s.source is None:
            return self.engine.spark.range(1).select(), {}, []
        df, names, shown = self.relation(s.source)
        for j in s.joins:
            right, more, more_shown = self.relation(j.source)
            both = {**more, **names}
            if j.on is None:
                df = df.crossJoin(right)
            else:
                df = df.join(right, Compiler(self.scope(both)).truth(j.on).col, j.kind)
            if j.kind not in ("left_semi", "left_anti"):
                names, shown = both, shown + more_shown
        return df, names, shown

    def where(self, df: DataFrame, scope: Scope, node: t.Node) -> DataFrame:
        """Filters; ``x IN (SELECT ...)`` at the top of the condition becomes a semi or anti join."""
        parts = self.conjuncts(node)
        for p in parts:
            if isinstance(p, t.Binary) and p.op == "in" and isinstance(p.right, t.Select):
                sub = self.select(p.right)
                key, on = self.member(scope, p.left, sub)
                df = df.join(key, on, "left_anti" if p.negated else "left_semi")
        rest = [p for p in parts if not (isinstance(p, t.Binary) and isinstance(p.right, t.Select))]
        for p in rest:
            flags: dict[str, Val] = {}

            def flagged(node):
                """``IN (SELECT ...)`` inside a condition: a left join whose match is a column."""
                nonlocal df
                if not (isinstance(node, t.Binary) and node.op == "in" and isinstance(node.right, t.Select)):
                    return node
                key, on = self.member(scope, node.left, self.select(node.right))
                name = f"hit#{self.n}"
                df = df.join(key.withColumn(name, F.lit(True)), on, "left").drop(key.columns[0])
                hit = F.coalesce(F.col(f"`{name}`"), F.lit(False))
                flags[f"\0{name}"] = Val(~hit if node.negated else hit, BOOL)
                return t.Name((f"\0{name}",))

            p = self.lift(p, flagged)
            df = df.filter(Compiler(replace(scope, columns={**scope.columns, **flags}) if flags else scope).condition(p))
        return df

    def member(self, scope: Scope, left: t.Node, sub: DataFrame):
        """The distinct values of a sub-query, and when ``left`` equals one of them, by the language's rules for two types.

        A NULL equals nothing, so it is in no sub-query, and NOT IN keeps it whatever NULLs the sub-query has.
        """
        if len(sub.columns) != 1:
            raise CompileProblem("a sub-query of IN has one column")
        self.n += 1
        key = f"in#{self.n}"
        sub = sub.select(F.col(f"`{sub.columns[0]}`").alias(key)).where(F.col(f"`{key}`").isNotNull()).distinct()
        comp = Compiler(scope)
        x, y = comp.aligned(comp(left), Val(F.col(f"`{key}`"), sub.schema[0].dataType))
        return sub, x == y

    def conjuncts(self, node: t.Node) -> list[t.Node]:
        return self.conjuncts(node.left) + self.conjuncts(node.right) if isinstance(node, t.Binary) and node.op == "and" else [node]

    def select(self, s: t.Select) -> DataFrame:
        df, names, shown = self.joined(s)
        scope = self.scope(names, lenient=s.filtered, time=self.engine.time_of(names))
        if s.where is not None:
            df = self.where(df, scope, s.where)
        columns: list[t.Column] = []
        for c in s.columns:
            if isinstance(c.expr, t.Everything):
                own = [(a, b) for a, b in shown if c.expr.qualifier is None or names.get(f"{c.expr.qualifier.lower()}.{a.lower()}") is not None and str(names[f"{c.expr.qualifier.lower()}.{a.lower()}"].col) == str(F.col(f"`{b}`"))]
                columns += [t.Column(t.Name((f"\0{b}",)), a) for a, b in own]
            else:
                columns.append(c)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        names |= {f"\0{b}".lower(): Val(F.col(f"`{b}`"), kinds[b]) for _, b in shown if b in kinds}
        titles = self.titles(columns)
        if s.group or s.having is not None and any(has_aggregate(c.expr) for c in columns) or any(has_aggregate(c.expr) for c in columns):
            out = self.grouped(df, scope, s, columns, titles)
        else:
            out = self.flat(df, scope, s, columns, titles)
        if s.offset:
            out = out.offset(s.offset)
        if s.limit is not None:
            out = out.limit(s.limit)
        if s.into:
            self.engine.save(s.into, out)
        return out

    def titles(self, columns: list[t.Column]) -> list[str]:
        out: list[str] = []
        for c in columns:
            name = c.alias or auto_name(c.expr)
            k = 2
            base = name
            while name in out:
                name, k = f"{base}_{k}", k + 1
            out.append(name)
        return out

    @staticmethod
    def guarded(v: Val, guard: Val | None) -> Val:
        return v if guard is None else replace(v, col=F.when(guard.col, v.col))

    def flat(self, df, scope, s, columns, titles) -> DataFrame:
        comp = Compiler(scope)
        values = [comp(c.expr) for c in columns]
        # A comparison that cannot be made is false where it is shown, too.
        values = [replace(v, col=comp.solid(v)) for v in values]
        made = [self.guarded(v, comp.truth(c.guard) if c.guard is not None else None) for v, c in zip(values, columns)]
        df = df.select("*", *[v.col.alias(f"out#{k}") for k, v in enumerate(made)])
        by_name = {n.lower(): Val(F.col(f"`out#{k}`"), made[k].type) for k, n in enumerate(titles)}
        last = self.scope({**scope.columns, **by_name}, lenient=scope.lenient, time=scope.time)
        if s.having is not None:
            df = df.filter(Compiler(last).condition(s.having))
        if s.distinct:
            df = df.select(*[f"`out#{k}`" for k in range(len(made))]).distinct()
        df = self.ordered(df, last, s)
        return df.select(*[F.col(f"`out#{k}`").alias(n) for k, n in enumerate(titles)])

    def ordered(self, df, scope, s) -> DataFrame:
        if not s.order:
            return df
        comp = Compiler(scope)
        keys = []
        for o in s.order:
            v = comp(o.expr)
            keys.append(v.col.desc_nulls_last() if o.descending else v.col.asc_nulls_first())
        return df.orderBy(*keys)

    def grouped(self, df, scope, s, columns, titles) -> DataFrame:
        comp = Compiler(scope)
        aliases = {n.lower(): c.expr for n, c in zip(titles, columns)}
        keys: list[tuple[t.Node, Val]] = []
        for g in s.group:
            node = g
            if isinstance(g, t.Name) and g.text.lower() not in scope.columns and g.text.lower() in aliases:
                node = aliases[g.text.lower()]
            keys.append((node, comp(node)))
        aggregates: list[tuple[t.Call, Val]] = []
        comp = Compiler(replace(scope, aggregate=True))

        def lift(node):
            """Aggregates and keys inside an expression become columns of the grouped frame."""
            if is_aggregate(node):
                for k, (n, _) in enumerate(aggregates):
                    if n == node:
                        return t.Name((f"\0agg{k}",))
                aggregates.append((node, comp.aggregate(node.name, node.args)))
                return t.Name((f"\0agg{len(aggregates) - 1}",))
            for k, (n, _) in enumerate(keys):
                if n == node:
                    return t.Name((f"\0key{k}",))
            return node

        lifted = [self.lift(c.expr, lift) for c in columns]
        guards = [self.lift(c.guard, lift) if c.guard is not None else None for c in columns]
        having = self.lift(s.having, lift, aliases) if s.having is not None else None
        order = [(self.lift(o.expr, lift, aliases), o.descending) for o in s.order]
        frame = df.select("*", *[v.col.alias(f"key#{k}") for k, (_, v) in enumerate(keys)])
        aggs = [v.col.alias(f"agg#{k}") for k, (_, v) in enumerate(aggregates)]
        names_of_keys = [F.col(f"`key#{k}`") for k in range(len(keys))]
        if keys:
            frame = frame.groupBy(*names_of_keys).agg(*aggs) if aggs else frame.select(*names_of_keys).distinct()
        else:
            frame = frame.agg(*aggs)
        after = {f"\0key{k}": Val(F.col(f"`key#{k}`"), v.type) for k, (_, v) in enumerate(keys)}
        after |= {f"\0agg{k}": Val(F.col(f"`agg#{k}`"), v.type) for k, (_, v) in enumerate(aggregates)}
        last = Compiler(self.scope(after))
        made = []
        for e, g in zip(lifted, guards):
            try:
                made.append(self.guarded(last(e), last.truth(g) if g is not None else None))
            except CompileProblem as problem:
                raise CompileProblem(f"a column is neither grouped nor aggregated ({problem})") from None
        frame = frame.select("*", *[v.col.alias(f"out#{k}") for k, v in enumerate(made)])
        whole = self.scope({**after, **{n.lower(): Val(F.col(f"`out#{k}`"), made[k].type) for k, n in enumerate(titles)}})
        if having is not None:
            frame = frame.filter(Compiler(whole).condition(having))
        if s.distinct:
            frame = frame.select(*[f"`out#{k}`" for k in range(len(made))]).distinct()
        frame = self.ordered(frame, whole, t.Select((), order=tuple(t.Order(e, d) for e, d in order)))
        return frame.select(*[F.col(f"`out#{k}`").alias(n) for k, n in enumerate(titles)])

    def lift(self, node, change, aliases=None):
        """Rewrite from the top: a whole subtree that is a key or aggregate is replaced at once."""
        got = change(node)
        if got is not node:
            return got
        if isinstance(node, t.Name) and aliases and node.text.lower() in aliases:
            return node
        kids = {k: tuple(self.lift(x, change, aliases) if isinstance(x, t.Node) else x for x in v) if isinstance(v, tuple) else self.lift(v, change, aliases) if isinstance(v, t.Node) else v for k, v in node.__dict__.items()}
        return type(node)(**kids)

    def filter(self, f: t.Filter, df: DataFrame | None = None) -> DataFrame:
        if df is None:
            if f.source is None:
                raise CompileProblem("the filter names no table")
            df = self.engine.table(f.source)
        scope = Scope.of(df)
        scope = self.scope(scope.columns, lenient=True, time=self.engine.time_of(scope.columns))
        out = df.filter(Compiler(scope).condition(f.expr))
        return out if f.limit is None else out.limit(f.limit)

    def select_from(self, s: t.Select, df: DataFrame) -> DataFrame:
        """A SELECT over a given frame, unknown names being missing."""
        inner = _Over(self.engine, df)
        return Planner(inner, self.params).select(replace(s, source=t.Source("rows"), filtered=True, joins=()))


class _Over:
    """An engine whose only table is one frame."""

    def __init__(self, engine, df: DataFrame):
        self.__dict__.update(engine.__dict__)
        self.spark, self.df = engine.spark, df
        self.time_of, self.save = engine.time_of, engine.save

    def table(self, name: str) -> DataFrame:
        return self.df


__all__ = ["Planner", "lit"]
