"""Stars, limits, set operations, windows and reshaping beyond Spark SQL's text."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import fresh_names


def star(df: DataFrame, exclude: list[str] = (), replace: dict[str, Column] | None = None, rename: dict[str, str] | None = None, ilike: str | None = None) -> DataFrame:
    """``* ILIKE p EXCLUDE (...) REPLACE (...) RENAME (...)``, in that order."""
    replace, rename = {k.lower(): v for k, v in (replace or {}).items()}, {k.lower(): v for k, v in (rename or {}).items()}
    gone = {c.lower() for c in exclude}
    names = [c for c in df.columns if c.lower() not in gone]
    if ilike is not None:
        pattern = re.compile("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in ilike), re.I | re.S)
        names = [c for c in names if pattern.fullmatch(c)]
    return df.select(*(replace.get(c.lower(), F.col(f"`{c}`")).alias(rename.get(c.lower(), c)) for c in names))


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row, in ``order``, of each key."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by a condition over window functions."""
    (kept,) = fresh_names("qualify", df)
    return df.withColumn(kept, condition).filter(F.col(kept)).drop(kept)


def top_with_ties(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The first ``n`` rows and all that equal one of them in ``by`` (``-name`` descends; nulls last).

    A row's rank is at most n exactly if its order values are among those of the first n
    rows, so a top-k and a semi join do; nothing is sorted whole.
    """
    names = [c.lstrip("-") for c in by]
    order = [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in by]
    last = df.orderBy(*order).limit(n).select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(names)]).distinct()
    return df.join(F.broadcast(last) if n <= 10_000 else last, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(names)], "left_semi")


def top_percent(df: DataFrame, percent: float, order: list) -> DataFrame:
    """The first ``percent`` of rows, rounded up; ranges of the order are kept whole but the last."""
    from .joins import first_rows

    return first_rows(df, order, math.ceil(df.count() * percent / 100 - 1e-9))


def union_by_name(left: DataFrame, right: DataFrame, distinct: bool = False) -> DataFrame:
    out = left.unionByName(right, allowMissingColumns=True)
    return out.distinct() if distinct else out


def groups_frame(df: DataFrame, value: Column, partition: list[str], order: Column, start: int, end: int, name: str) -> DataFrame:
    """An aggregate over GROUPS BETWEEN start AND end: a RANGE frame over dense ranks."""
    (g,) = fresh_names("g", df)
    ranked = df.withColumn(g, F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    return ranked.withColumn(name, value.over(Window.partitionBy(*partition).orderBy(g).rangeBetween(start, end))).drop(g)


def sum_excluding_current(df: DataFrame, value: str, partition: list[str], order: list, start: int, end: int, name: str) -> DataFrame:
    """SUM over a ROWS frame with EXCLUDE CURRENT ROW; null when no other row is left."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(start, end)
    others = F.count(value).over(w) - F.col(value).isNotNull().cast("int")
    return df.withColumn(name, F.when(others > 0, F.sum(value).over(w) - F.coalesce(F.col(value), F.lit(0))))


def excluding(df: DataFrame, value: str, partition: list[str], order: str, start: int, end: int, name: str, function: str = "sum", exclude: str = "group") -> DataFrame:
    """SUM, COUNT or AVG over GROUPS BETWEEN start AND end with EXCLUDE GROUP, TIES, CURRENT ROW or NO OTHERS.

    ``start <= 0 <= end``: the frame holds the row's own peers, whose share is taken off the frame's
    total; sum and average are null when no value is left.
    """
    if not start <= 0 <= end:
        raise ValueError("the frame must hold the current group")
    (g,) = fresh_names("g", df)
    ranked = df.withColumn(g, F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    frame, peers = Window.partitionBy(*partition).orderBy(g).rangeBetween(start, end), Window.partitionBy(*partition, g)
    own, one = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long")
    total, n = F.coalesce(F.sum(value).over(frame), F.lit(0)), F.count(value).over(frame)
    group, in_group = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
    off, off_n = {"group": (group, in_group), "ties": (group - own, in_group - one), "current row": (own, one), "no others": (F.lit(0), F.lit(0))}[exclude]
    total, n = total - off, n - off_n
    out = {"sum": F.when(n > 0, total), "count": n, "avg": F.when(n > 0, total / n)}[function]
    return ranked.withColumn(name, out).drop(g)


def pivot(df: DataFrame, keys: list[str], column: str, values: list | None, *aggregates: Column) -> DataFrame:
    """Static with ``values``, dynamic (one more pass for the values) without; several aggregates give ``value_name`` columns."""
    return df.groupBy(*keys).pivot(column, values).agg(*aggregates)


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str, nulls: bool = False) -> DataFrame:
    out = df.unpivot(keys, columns, name, value)
    return out if nulls else out.filter(F.col(value).isNotNull())


def flatten(df: DataFrame, value: Column, outer: bool = False, recursive: bool = False, mode: str = "both") -> DataFrame:
    """LATERAL FLATTEN of an array, a map or a struct: adds seq, key, path, index, value and this.

    ``seq`` tells input rows apart.  Arrays give ``index``, maps and structs ``key``; a struct's fields come as JSON text, as their types
    differ.  ``recursive`` goes down nested arrays of one type.  ``mode`` "array" or "object" leaves the other kind out.
    Where ``df`` has columns of these names, the new ones get ``_`` appended.
    """
    seq, key, path, index, item, this = fresh_names("seq key path index value this", df)
    rows = df.withColumn(seq, F.monotonically_increasing_id()).withColumn(this, value)
    kind = rows.schema[this].dataType
    old = [f"`{c}`" for c in df.columns]
    if mode != "both" and (mode == "array") != isinstance(kind, T.ArrayType):
        rows = rows.filter(F.lit(False))
    if isinstance(kind, T.StructType):
        rows = rows.withColumn(this, F.create_map(*(x for f in kind.names for x in (F.lit(f), F.to_json(F.struct(F.col(this)[f].alias("v")))))))
        rows = rows.withColumn(this, F.transform_values(this, lambda _, v: F.get_json_object(v, "$.v")))
        kind = rows.schema[this].dataType
    if isinstance(kind, T.MapType):
        out = rows.select(*old, seq, this, (F.explode_outer if outer else F.explode)(this).alias(key, item))
        return out.select(*old, seq, F.col(key).cast("string").alias(key), F.col(key).cast("string").alias(path), F.lit(None).cast("int").alias(index), item, this)
    out = rows.select(*old, seq, this, (F.posexplode_outer if outer else F.posexplode)(this).alias(index, item))
    out = out.select(*old, seq, F.lit(None).cast("string").alias(key), F.concat(F.lit("["), F.col(index), F.lit("]")).alias(path), index, item, this)
    while recursive and isinstance(out.schema[item].dataType, T.ArrayType):
        deeper = out.select(*old, seq, key, F.col(path).alias("__up"), F.col(item).alias(this), F.posexplode(item).alias(index, item))
        out = deeper.select(*old, seq, key, F.concat("__up", F.lit("["), F.col(index), F.lit("]")).alias(path), index, item, this)
    return out


def json_table(df: DataFrame, text: str, columns: str, path: str | None = None, outer: bool = False, nested: dict[str, str] | None = None, ordinality: str | None = None) -> DataFrame:
    """JSON_TABLE: the array of objects in ``text`` (at ``path``) as typed rows.

    ``nested`` maps a field that holds an array of objects to their columns (NESTED PATH): a row per
    inner object, nulls where there is none; several such fields follow one another, the others'
    columns being null.  ``ordinality`` names a column that counts the objects from 1.
    """
    source = F.col(text) if path is None else F.get_json_object(text, path)
    inner = "".join(f", `{field}`: array<struct<{spec}>>" for field, spec in (nested or {}).items())
    items = F.from_json(source, f"array<struct<{columns}{inner}>>")
    if not nested and not ordinality:
        return df.select("*", (F.inline_outer if outer else F.inline)(items))
    old = [f"`{c}`" for c in df.columns]
    rows = df.select(*old, (F.posexplode_outer if outer else F.posexplode)(items).alias("__n", "__o"))
    own = [F.col("__o")[f].alias(f) for f in T.StructType.fromDDL(columns).names]
    count = [(F.col("__n") + 1).alias(ordinality)] if ordinality else []
    if not nested:
        return rows.select(*old, *count, *own)
    kept, out = [f"`{c}`" for c in [*df.columns, *([ordinality] if ordinality else []), *T.StructType.fromDDL(columns).names]], None
    for field in nested:
        part = rows.select(*old, *count, *own, F.col("__o")[field].alias("__in"))
        part = part.filter(F.size("__in") > 0).select(*kept, F.inline("__in"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    empty = F.lit(True)
    for field in nested:
        empty = empty & (F.coalesce(F.size(F.col("__o")[field]), F.lit(0)) <= 0)
    return out.unionByName(rows.filter(empty).select(*old, *count, *own), allowMissingColumns=True)


def json_pairs(df: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """OPENJSON without a WITH clause: key, value and type (0 null, 1 text, 2 number, 3 boolean, 4 array, 5 object) of an object's members."""
    key, item, kind = fresh_names("key value type", df)
    source = F.col(text) if path is None else F.get_json_object(text, path)
    made = F.from_json(source, "map<string, variant>")
    out = df.select(*(f"`{c}`" for c in df.columns), F.explode(made).alias(key, item))
    of = F.schema_of_variant(item)
    code = F.when(of.isNull() | (of == "VOID"), 0).when(of == "STRING", 1).when(of == "BOOLEAN", 3).when(of.startswith("ARRAY"), 4).when(of.startswith("OBJECT"), 5).otherwise(2)
    plain = F.when(code.isin(4, 5), F.to_json(item)).otherwise(F.try_variant_get(item, "$", "string"))
    return out.select(*(f"`{c}`" for c in df.columns), key, plain.alias(item), code.alias(kind))


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) in a random order that the seed and the rows give: REPEATABLE."""
    from .joins import first_rows

    hashed = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    order = F.xxhash64(F.lit(seed), *hashed)
    return df.orderBy(order).limit(n) if n <= 10_000 else first_rows(df, [order], n)


def split_to_table(df: DataFrame, text: str, delimiter: str) -> DataFrame:
    """SPLIT_TO_TABLE: seq, index (from 1) and value of a text's parts."""
    seq, index, item = fresh_names("seq index value", df)
    parts = F.split(F.col(text), F.concat(F.lit("\\Q"), F.lit(delimiter), F.lit("\\E")))
    out = df.withColumn(seq, F.monotonically_increasing_id()).select("*", F.posexplode(parts).alias(index, item))
    return out.withColumn(index, F.col(index) + 1)


def xml_nodes(df: DataFrame, text: str, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``.nodes()`` / OPENXML: a row per element at ``path`` (``/root/a/b``), with typed columns.

    A column is (place, type): the place is ``@attribute``, ``text()`` or a child's name.
    """
    _, *steps = path.strip("/").split("/")
    if not steps:
        raise ValueError("the path must lead below the root element")
    field = {name: "_" + at[1:] if at[0] == "@" else "_VALUE" if at == "text()" else at for name, (at, _) in columns.items()}
    of = "STRUCT<" + ", ".join(f"`{field[name]}`: {kind}" for name, (_, kind) in columns.items()) + (", `_VALUE`: STRING" if "_VALUE" not in field.values() else "") + ">"
    for step in reversed(steps[1:]):
        of = f"STRUCT<`{step}`: ARRAY<{of}>>"
    (found,) = fresh_names("found", df)
    items = F.from_xml(F.col(text), f"`{steps[0]}` ARRAY<{of}>")[steps[0]]
    for step in steps[1:]:
        items = F.flatten(F.transform(items, lambda x, s=step: x[s]))
    rows = df.withColumn(found, F.explode(items))
    return rows.select(*(f"`{c}`" for c in df.columns), *(F.col(found)[field[name]].alias(name) for name in columns))
