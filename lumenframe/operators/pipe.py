"""Pipe syntax as methods: each stage takes the rows of the stage before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialized, save
from . import relations, shape


class Pipe:
    def __init__(self, df: DataFrame):
        self.df = df

    def _to(self, df: DataFrame) -> Pipe:
        return Pipe(df)

    def where(self, condition) -> Pipe:
        return self._to(self.df.filter(condition))

    def select(self, *columns) -> Pipe:
        return self._to(self.df.select(*columns))

    def extend(self, **columns: Column) -> Pipe:
        return self._to(self.df.withColumns(columns))

    def set(self, **columns: Column) -> Pipe:
        missing = [c for c in columns if c.lower() not in {d.lower() for d in self.df.columns}]
        if missing:
            raise ValueError(f"SET of unknown columns {missing}")
        return self._to(self.df.withColumns(columns))

    def drop(self, *names: str) -> Pipe:
        return self._to(self.df.drop(*names))

    def rename(self, **names: str) -> Pipe:
        return self._to(self.df.withColumnsRenamed(names))

    def as_(self, alias: str) -> Pipe:
        return self._to(self.df.alias(alias))

    def aggregate(self, *aggregates: Column, group_by: list = ()) -> Pipe:
        return self._to(self.df.groupBy(*group_by).agg(*aggregates))

    def distinct(self) -> Pipe:
        return self._to(self.df.distinct())

    def order_by(self, *order) -> Pipe:
        return self._to(self.df.orderBy(*order))

    def limit(self, n: int, offset: int = 0) -> Pipe:
        return self._to(self.df.offset(offset).limit(n) if offset else self.df.limit(n))

    def join(self, other: DataFrame, on, how: str = "inner") -> Pipe:
        return self._to(self.df.join(other, on, how))

    def window(self, **columns: Column) -> Pipe:
        return self.extend(**columns)

    def union(self, *others: DataFrame, distinct: bool = False, by_name: bool = False) -> Pipe:
        out = self.df
        for o in others:
            out = shape.union_by_name(out, o) if by_name else out.union(o)
        return self._to(out.distinct() if distinct else out)

    def intersect(self, other: DataFrame, all_: bool = False) -> Pipe:
        return self._to(self.df.intersectAll(other) if all_ else self.df.intersect(other))

    def except_(self, other: DataFrame, all_: bool = False) -> Pipe:
        return self._to(self.df.exceptAll(other) if all_ else self.df.subtract(other))

    def pivot(self, keys: list[str], column: str, values: list, aggregate: Column) -> Pipe:
        return self._to(shape.pivot(self.df, keys, column, values, aggregate))

    def unpivot(self, keys: list[str], columns: list[str], name: str, value: str) -> Pipe:
        return self._to(shape.unpivot(self.df, keys, columns, name, value))

    def tablesample(self, percent: float, seed: int | None = None) -> Pipe:
        return self._to(self.df.sample(percent / 100, seed))

    def call(self, function, *args, **kwargs) -> Pipe:
        return self._to(function(self.df, *args, **kwargs))

    def assert_(self, condition: Column, message: str = "assertion failed") -> Pipe:
        held = F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
        return self._to(self.df.filter(held))

    def recursive_union(self, step: Callable[[DataFrame], DataFrame], all_: bool = True, most_steps: int | None = None) -> Pipe:
        """``RECURSIVE UNION``: the rows, then ``step`` of the rows that the step before gave, until it gives none.

        Each step is written before the next.  Without ``all_`` a row is taken up once only.
        """
        now, seen, steps = materialized(self.df if all_ else self.df.distinct(), "step"), None, 0
        while not now.isEmpty() and (most_steps is None or steps <= most_steps):
            seen = now if seen is None else seen.unionByName(now)
            after = step(now)
            now = materialized(after if all_ else after.subtract(seen), "step")
            steps += 1
        return self._to(now if seen is None else seen)

    def match_recognize(self, *args, **options) -> Pipe:
        return self._to(relations.match_recognize(self.df, *args, **options))

    def with_(self, name: str, make: Callable[[Pipe], Pipe]) -> Pipe:
        """``WITH name AS (...)``: a view that later stages may read; the rows pass on unchanged."""
        make(self).df.createOrReplaceTempView(name)
        return self

    def if_(self, *arms: tuple[bool, Callable[[Pipe], Pipe]], otherwise: Callable[[Pipe], Pipe] | None = None) -> Pipe:
        """``IF … THEN (…) ELSEIF … ELSE (…)``: the stages of the first arm whose condition holds."""
        for condition, stages in arms:
            if condition:
                return stages(self)
        return otherwise(self) if otherwise else self

    def fork(self, *branches: Callable[[Pipe], Pipe]) -> list[Pipe]:
        """One result per branch; the rows are written once and read by each."""
        shared = Pipe(materialized(self.df, "fork"))
        return [branch(shared) for branch in branches]

    def tee(self, *branches: Callable[[Pipe], object]) -> Pipe:
        """Branches besides the main line, which goes on with the same rows."""
        shared = Pipe(materialized(self.df, "tee"))
        for branch in branches:
            branch(shared)
        return shared

    def log(self, show: Callable[[DataFrame], object], stages: Callable[[Pipe], Pipe] | None = None) -> Pipe:
        """``LOG``: hands the rows (after ``stages``) to ``show``; the main line goes on unchanged."""
        show((stages(self) if stages else self).df)
        return self

    def static_describe(self) -> Pipe:
        """``STATIC_DESCRIBE``: the rows with no job run, and the schema in ``described``."""
        out = self._to(self.df)
        out.described = [(f.name, f.dataType.simpleString(), f.nullable) for f in self.df.schema]
        return out

    def describe(self) -> Pipe:
        """``DESCRIBE``: one row per column instead of the rows."""
        rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(self.df.schema)]
        return self._to(self.df.sparkSession.createDataFrame(rows, "position int, name string, type string"))

    def export_data(self, path: str, fmt: str = "parquet", **options) -> None:
        save(self.df, path, fmt, **options)

    def create_table(self, name: str, fmt: str = "parquet", replace: bool = False) -> DataFrame:
        self.df.write.format(fmt).mode("overwrite" if replace else "error").saveAsTable(name)
        return self.df.sparkSession.table(name)

    def insert(self, name: str, by_name: bool = False) -> DataFrame:
        columns = self.df.sparkSession.table(name).columns
        (self.df.select(*(f"`{c}`" for c in columns)) if by_name else self.df).write.insertInto(name)
        return self.df.sparkSession.table(name)
