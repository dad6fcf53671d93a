"""INSERT, REPLACE, UPSERT, UPDATE and DELETE on the engine's own tables.

A table is an immutable frame; a statement adds files to it or replaces it by a new one, written to the warehouse so that
its lineage does not grow with the number of statements.  Frames that were read before keep what they saw, until
``Engine.vacuum`` deletes the files that no table has any more.  Each statement returns how many rows it touched.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from siftql.lang import tree as t
from siftql.operators.select import Planner
from siftql.plans.expressions import Compiler, Scope
from siftql.plans.values import CompileProblem, convert


def insert(engine, s: t.Insert, params: tuple = ()) -> int:
    """Rows of VALUES, or of a query by place.  Under a key, the last row of the statement stays and replaces what the table has.

    The last row of a query with ORDER BY is the last in that order; without one, it is the greatest of the rows of the key.
    Rows whose key is NULL share it.  Where nothing is replaced, the statement adds a file and the table is not rewritten.
    """
    table = engine.own(s.table)
    old, planner = table.df, Planner(engine, params)
    columns = list(s.columns) or old.columns
    kinds = {f.name.lower(): f for f in old.schema.fields}
    if unknown := [c for c in columns if c.lower() not in kinds]:
        raise CompileProblem(f"{s.table} has no column {unknown[0]!r}")
    if s.query is not None:
        got = planner.select(s.query)
        if len(got.columns) != len(columns):
            raise CompileProblem("the query has another number of columns than the table")
        scope = Scope.of(got.toDF(*[f"c{k}" for k in range(len(columns))]))
        made = [convert(scope.columns[f"c{k}"], kinds[c.lower()].dataType).alias(kinds[c.lower()].name) for k, c in enumerate(columns)]
        place = F.monotonically_increasing_id() if s.query.order else F.lit(0).cast("long")
        new = got.toDF(*[f"c{k}" for k in range(len(columns))]).select(*made, place.alias("#place"))
    else:
        comp = Compiler(planner.scope({}))
        rows = []
        for k, r in enumerate(s.rows):
            if len(r) != len(columns):
                raise CompileProblem("a row has another number of values than the table has columns")
            made = [convert(comp(v), kinds[c.lower()].dataType).cast(kinds[c.lower()].dataType).alias(kinds[c.lower()].name) for c, v in zip(columns, r)]
            rows.append(F.struct(*made, F.lit(k).cast("long").alias("#place")))
        new = engine.spark.range(1).select(F.inline(F.array(*rows)))
    missing = [f for n, f in kinds.items() if n not in {c.lower() for c in columns}]
    new = engine.settle(new.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(*old.columns, "#place"))
    count = new.count()
    if not table.key:
        engine.append(s.table, new.drop("#place"))
        return count
    k = F.col(f"`{table.key}`")
    whole = F.struct(*[F.col(f"`{c}`") for c in new.columns])
    comparable = F.struct(F.col("`#place`"), *[F.col(f"`{f.name}`") for f in old.schema.fields if not isinstance(f.dataType, MapType)])
    new = new.groupBy(k.alias("#key")).agg(F.max_by(whole, comparable).alias("#row")).select(*[F.col("#row")[c].alias(c) for c in old.columns])
    gone = new.select(k.alias("#key"))
    if old.join(gone, k.eqNullSafe(F.col("`#key`")), "left_semi").isEmpty():
        engine.append(s.table, new)
        return count
    if s.verb == "upsert" and len(columns) < len(old.columns):
        # Columns that are not named keep what the row under the key has.
        a, b = old.alias("a"), new.alias("b")
        named = {c.lower() for c in columns}
        new = b.join(a, F.col(f"a.`{table.key}`").eqNullSafe(F.col(f"b.`{table.key}`")), "left").select(*[F.col(f"{'b' if c.lower() in named else 'a'}.`{c}`").alias(c) for c in old.columns])
    engine.replace(s.table, old.join(gone, k.eqNullSafe(F.col("`#key`")), "left_anti").unionByName(new))
    return count


def update(engine, s: t.Update, params: tuple = ()) -> int:
    table = engine.own(s.table)
    scope = Scope.of(table.df, s.table)
    comp = Compiler(Planner(engine, params).scope(scope.columns))
    hit = F.coalesce(comp.condition(s.where), F.lit(False)) if s.where is not None else F.lit(True)
    values = {c.lower(): comp(v) for c, v in s.values}
    if unknown := [c for c in values if c not in scope.columns]:
        raise CompileProblem(f"{s.table} has no column {unknown[0]!r}")
    count = table.df.filter(hit).count()
    if count:
        engine.replace(s.table, table.df.select(*[F.when(hit, convert(values[f.name.lower()], f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in values else F.col(f"`{f.name}`") for f in table.df.schema.fields]))
    return count


def delete(engine, s: t.Delete, params: tuple = ()) -> int:
    table = engine.own(s.table)
    comp = Compiler(Planner(engine, params).scope(Scope.of(table.df, s.table).columns))
    hit = F.coalesce(comp.condition(s.where), F.lit(False)) if s.where is not None else F.lit(True)
    count = table.df.filter(hit).count()
    if count:
        engine.replace(s.table, table.df.filter(~hit))
    return count
