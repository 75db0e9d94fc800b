"""Hierarchies, graph patterns, row patterns and copy-on-write changes."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import fresh_names, materialized


def connect_by(df: DataFrame, key: str, parent: str, start: Column, most_levels: int | None = None, siblings: list | None = None) -> DataFrame:
    """START WITH / CONNECT BY NOCYCLE PRIOR key = parent.

    Adds ``level``, ``path`` (keys from the root), ``root``, ``is_leaf`` and ``is_cycle`` (a
    child lies on the row's own path, which ends it).  With ``siblings`` (columns), ``place``
    orders the rows depth first, children of one row by these columns.

    One join a level; each level is written before the next, so a deep hierarchy has no long
    lineage, and the loop ends at the first empty level.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in siblings], F.col(key)) if siblings else None
    rank = F.array(order) if siblings else F.lit(None)
    now = df.filter(start).select(*own, F.lit(1).alias("level"), F.array(F.col(key)).alias("path"), rank.alias("place"))
    levels = []
    while True:
        now = materialized(now, "level")
        if now.isEmpty():
            break
        levels.append(now)
        if most_levels and len(levels) >= most_levels:
            break
        above = now.select(F.col(key).alias("__above"), F.col("level").alias("__level"), F.col("path").alias("__path"), F.col("place").alias("__place"))
        below = df.join(above, F.col(parent) == F.col("__above")).filter(~F.array_contains("__path", F.col(key)))
        place = F.concat("__place", F.array(order)) if siblings else F.lit(None)
        now = below.select(*own, (F.col("__level") + 1).alias("level"), F.concat("__path", F.array(F.col(key))).alias("path"), place.alias("place"))
    out = levels[0] if levels else now
    for more in levels[1:]:
        out = out.unionByName(more)
    children = df.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("__of")).agg(F.collect_set(key).alias("__children"))
    out = out.join(children, F.col(key) == F.col("__of"), "left")
    inner, cycle = F.size(F.array_except("__children", "path")) > 0, F.arrays_overlap("__children", "path")
    out = out.withColumns({"root": F.col("path")[0], "is_leaf": ~F.coalesce(inner, F.lit(False)), "is_cycle": F.coalesce(cycle, F.lit(False))}).drop("__of", "__children")
    return out if siblings else out.drop("place")


class Graph:
    """A property graph: tables of vertices and of edges, by label.

    A vertex table has ``id`` and an edge table ``src`` and ``dst``, besides properties; each hop
    reads the tables of its own labels only, so filters on labels prune tables and
    filters on properties reach the scans.
    """

    def __init__(self, vertices: DataFrame | dict[str, DataFrame], edges: DataFrame | dict[str, DataFrame]):
        self.vertices = vertices if isinstance(vertices, dict) else {"": vertices}
        self.edges = edges if isinstance(edges, dict) else {"": edges}

    def nodes(self, label: str = "") -> DataFrame:
        return self.vertices[label]

    def _edges(self, labels: str) -> DataFrame:
        out = None
        for label in labels.split("|") if labels else self.edges:
            e = self.edges[label]
            out = e if out is None else out.unionByName(e, allowMissingColumns=True)
        return out

    def hop(self, rows: DataFrame, start: str, end: str, direction: str = "out", where: Column | None = None, label: str = "") -> DataFrame:
        """Extends paths in ``rows`` from column ``start`` over one edge (of the labels, ``|`` between) to ``end``."""
        edges = self._edges(label)
        extra = [f"`{c}`" for c in edges.columns if c not in ("src", "dst")]
        out = edges.select(F.col("src").alias(start), F.col("dst").alias(end), *extra)
        back = edges.select(F.col("dst").alias(start), F.col("src").alias(end), *extra)
        e = {"out": out, "in": back, "any": out.unionByName(back)}[direction]
        e = rows.join(e if where is None else e.filter(where), start)
        return e.select(*(f"`{c}`" for c in rows.columns), end)

    def match(self, pattern: str, columns: dict[str, str], where: str | None = None) -> DataFrame:
        """``GRAPH_TABLE (MATCH (a:Label)-[e:LABEL]->(b) ... COLUMNS (...))``.

        ``columns`` maps result names to SQL over the pattern's variables (``a.name``, ``e.since``),
        ``where`` filters.  Edges point right, left or (``-[]-``) both ways; ``[:A|B]`` takes several labels.
        """
        node, edge = r"\((\w*)(?::(\w+))?\)", r"(<?)-\[(\w*)(?::([\w|]+))?\]-(>?)"
        text = re.sub(r"\s+", "", pattern)
        if not re.fullmatch(f"{node}(?:{edge}{node})*", text):
            raise ValueError(f"not a pattern of nodes and edges: {pattern}")
        parts = [m for m in re.finditer(f"{node}|{edge}", text)]
        names: list[str] = []

        def named(given: str) -> str:
            return given or f"_{len(names)}"

        def vertex(m, name: str) -> DataFrame:
            tables = [self.vertices[m[2]]] if m[2] else [*self.vertices.values()]
            out = tables[0]
            for t in tables[1:]:
                out = out.unionByName(t, allowMissingColumns=True)
            return out.select(F.struct(*(f"`{c}`" for c in out.columns)).alias(name))

        first = named(parts[0][1])
        names.append(first)
        rows, at = vertex(parts[0], first), first
        for e, n in zip(parts[1::2], parts[2::2]):
            ename, table = named(e[4]), self._edges(e[5] or "")
            names.append(ename)
            both = F.struct(*(f"`{c}`" for c in table.columns)).alias(ename)
            out, back = table.select(both, F.col("src").alias("__a"), F.col("dst").alias("__b")), table.select(both, F.col("dst").alias("__a"), F.col("src").alias("__b"))
            hop = back if e[3] and not e[6] else out if e[6] and not e[3] else out.unionByName(back)
            rows = rows.join(hop, F.col(f"{at}.id") == F.col("__a")).drop("__a")
            name = n[1] or f"_{len(names)}"
            if name in names:  # a cycle back to a node of the pattern
                rows = rows.filter(F.col(f"{name}.id") == F.col("__b")).drop("__b")
            else:
                rows = rows.join(vertex(n, name), F.col("__b") == F.col(f"{name}.id")).drop("__b")
                names.append(name)
            at = name
        rows = rows.filter(where) if where else rows
        return rows.select(*(F.expr(sql).alias(name) for name, sql in columns.items()))

    def paths(self, starts: DataFrame, column: str, least: int, most: int) -> DataFrame:
        """Ends (column ``end``) and lengths of walks of ``least`` to ``most`` edges."""
        edges = self._edges("")
        now, out = starts.select(F.col(column).alias(column), F.col(column).alias("_at")), None
        for length in range(0, most + 1):
            if length:
                now = now.join(edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")), "_at").select(column, F.col("_to").alias("_at"))
            if length >= least:
                found = now.select(column, F.col("_at").alias("end"), F.lit(length).alias("length"))
                out = found if out is None else out.unionByName(found)
        return out


def row_pattern(pattern: str, symbols: list[str]) -> tuple[re.Pattern, list[tuple]]:
    """A row pattern as a regular expression over rows, and the same as nested steps.

    A row is one character, whose code (from U+E000) has a bit for each symbol that is true.  A
    symbol stands for all characters with its bit, one without a definition for any.
    """
    if len(symbols) > 12:
        raise ValueError("at most 12 symbols can be defined")
    tokens = re.findall(r"\{[^}]*\}|[A-Za-z_]\w*|\S", pattern)
    if all(len(s) == 1 for s in symbols) and " " not in pattern:
        tokens = re.findall(r"\{[^}]*\}|\S", pattern)
    out, at = [], 0

    def quantifier() -> str:
        nonlocal at
        q = ""
        if at < len(tokens) and (tokens[at] in "*+?" or tokens[at][0] == "{"):
            q, at = tokens[at].replace(" ", ""), at + 1
            if at < len(tokens) and tokens[at] == "?":
                q, at = q + "?", at + 1
        return q

    def alternatives() -> tuple:
        nonlocal at
        options, steps = [], []
        while at < len(tokens) and tokens[at] != ")":
            token = tokens[at]
            at += 1
            if token == "|":
                options.append(steps)
                steps = []
                out.append("|")
                continue
            if token == "(":
                out.append("(?:")
                inner = alternatives()
                if at >= len(tokens):
                    raise ValueError(f"a parenthesis is not closed in {pattern}")
                at += 1
                out.append(")")
            elif re.fullmatch(r"[A-Za-z_]\w*", token):
                bit = symbols.index(token) if token in symbols else -1
                inner = ("row", token, bit)
                out.append("[\\s\\S]" if bit < 0 else "[" + "".join(chr(0xE000 + m) for m in range(1 << len(symbols)) if m >> bit & 1) + "]")
            else:
                raise ValueError(f"{token} has no meaning in the row pattern {pattern}")
            q = quantifier()
            out.append(q.replace("{,", "{0,"))
            steps.append((inner, q))
        options.append(steps)
        return ("any", options)

    steps = alternatives()
    if at < len(tokens):
        raise ValueError(f"a parenthesis was not opened in {pattern}")
    return re.compile("".join(out)), steps


def _bounds(q: str) -> tuple[int, int, bool]:
    lazy = len(q) > 1 and q.endswith("?")
    q = q[:-1] if lazy else q
    if q.startswith("{"):
        low, comma, high = q[1:-1].partition(",")
        return int(low or 0), (int(high) if high else 1 << 60) if comma else int(low), lazy
    return {"": (1, 1), "*": (0, 1 << 60), "+": (1, 1 << 60), "?": (0, 1)}[q] + (lazy,)


def classified(steps: tuple, masks: list[int]) -> list[str]:
    """The symbol of each row of a match, in the order of preference of the pattern."""

    def run(node, at, then):
        if node[0] == "row":
            if at < len(masks) and (node[2] < 0 or masks[at] >> node[2] & 1):
                got = then(at + 1)
                return None if got is None else [node[1], got]
            return None
        for option in node[1]:
            if (got := sequence(option, 0, at, then)) is not None:
                return got
        return None

    def sequence(option, i, at, then):
        if i == len(option):
            return then(at)
        inner, q = option[i]
        low, high, lazy = _bounds(q)
        return repeat(inner, low, high, lazy, at, -1, lambda a: sequence(option, i + 1, a, then))

    def repeat(inner, low, high, lazy, at, last, then):
        def more():
            if high <= 0 or at == last and low <= 0:
                return None
            return run(inner, at, lambda a: repeat(inner, low - 1, high - 1, lazy, a, at, then))

        if low > 0:
            return more()
        if lazy:
            got = then(at)
            return more() if got is None else got
        got = more()
        return then(at) if got is None else got

    got = run(steps, 0, lambda a: [] if a == len(masks) else None)
    out = []
    while got:
        name, got = got
        out.append(name)
    return out


def match_recognize(df: DataFrame, partition: list[str], order: list[str], pattern: str, define: dict[str, Column], measures: dict[str, tuple[str, str, str]], schema: str, skip: str = "past last row", all_rows: bool = False) -> DataFrame:
    """Row patterns: ONE ROW PER MATCH, or with ``all_rows`` each row of a match with its ``classifier``.

    ``define`` gives each symbol a condition, which may use lag and lead over the partition; a
    row may be true for several symbols.  ``pattern`` has SQL's operators: ``A B+ (C | D)*? E{2,3}`` (symbols
    of one letter may stand together).  A measure is (function, symbol, column) with
    function first, last, min, max, sum, count or avg; an empty symbol means all rows of the match.
    ``skip`` is "past last row" or "to next row".  Conditions run in the JVM and rows arrive
    sorted; Python sees a bit mask and the measured columns, one partition's at a time.
    Empty matches give no row.
    """
    symbols = list(define)
    compiled, steps = row_pattern(pattern, symbols)
    columns = sorted({c for _, _, c in measures.values()} | ({*order} if all_rows else set()))
    bits, begin = fresh_names("bits begin", df)
    mask = F.lit(0)
    for i, condition in enumerate(define.values()):
        mask = mask + F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
    begins = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) == 1
    rows = df.select(*dict.fromkeys([*partition, *order, *columns]), mask.alias(bits), begins.alias(begin))
    rows = rows.select(*dict.fromkeys([*partition, *columns]), *(c for c in order if c not in partition and c not in columns), bits, begin).sortWithinPartitions(*partition, *order)
    wanted = [f.name for f in StructType.fromDDL(schema).fields]

    def values(table: pa.Table, at: list[int], function: str, column: str):
        if function == "count":
            return len(at)
        if not at:
            return None
        if function in ("first", "last"):
            return table.column(column)[at[0 if function == "first" else -1]].as_py()
        part = table.column(column).take(pa.array(at)) if at[-1] - at[0] + 1 != len(at) else table.column(column).slice(at[0], len(at))
        return {"min": pc.min, "max": pc.max, "sum": pc.sum, "avg": pc.mean}[function](part).as_py()

    def matches(table: pa.Table) -> dict[str, list]:
        masks = table.column(bits).to_pylist()
        text = "".join([chr(0xE000 + m) for m in masks])
        out: dict[str, list] = {name: [] for name in wanted}
        n, at, needs = 0, 0, all_rows or any(s for _, s, _ in measures.values())
        while at <= len(text) and (m := compiled.search(text, at)):
            first, last = m.span()
            at = last if last > first and skip == "past last row" else first + 1
            if last == first:
                continue
            n += 1
            names = classified(steps, masks[first:last]) if needs else []
            of: dict[str, list[int]] = {"": list(range(first, last))}
            for i, name in enumerate(names, first):
                of.setdefault(name, []).append(i)
            row = {k: values(table, of.get(symbol, []), function, column) for k, (function, symbol, column) in measures.items()}
            for i in range(first, last) if all_rows else (first,):
                extra = {"match_number": n} | ({"classifier": names[i - first]} if all_rows else {})
                for name in wanted:
                    out[name].append(row[name] if name in row else extra[name] if name in extra else table.column(name)[i].as_py())
        return out

    def task(batches):
        held: list[pa.Table] = []
        found: dict[str, list] = {name: [] for name in wanted}

        def close():
            if held:
                for name, v in matches(pa.concat_tables(held)).items():
                    found[name] += v
                held.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            starts = [i for i, b in enumerate(table.column(begin).to_pylist()) if b]
            for k, (a, b) in enumerate(zip([0, *starts], [*starts, len(table)])):
                if k:
                    close()
                if b > a:
                    held.append(table.slice(a, b - a))
            if len(found[wanted[0]]) >= 10_000:
                yield pa.RecordBatch.from_pydict(found, schema=kinds)
                found = {name: [] for name in wanted}
        close()
        yield pa.RecordBatch.from_pydict(found, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(task, schema)


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """UPDATE as a new table: rows where the condition is true get the new values."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """DELETE as a new table: rows where the condition is not true stay."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def insert(df: DataFrame, rows: DataFrame, by_name: bool = True) -> DataFrame:
    return df.unionByName(rows) if by_name else df.union(rows)


#: One arm of MERGE: (kind, condition in SQL or None, action).
MATCHED, NOT_MATCHED, NOT_BY_SOURCE = "matched", "not matched", "not matched by source"


def merge_into(target: DataFrame, source: DataFrame, keys: list[str], arms: list[tuple[str, str | None, object]]) -> DataFrame:
    """MERGE as a new table, by one full outer join on ``keys``; null keys never match.

    ``arms`` are tried in order, and the first whose kind and condition hold acts on the row: kind is
    ``MATCHED``, ``NOT_MATCHED`` (a source row alone) or ``NOT_BY_SOURCE`` (a target row alone), the condition is SQL
    over t and s, the action "delete", "keep", or a dict of columns to SQL, which updates or, for
    ``NOT_MATCHED``, inserts (``{}`` inserts the source's columns of equal names).  Target rows without an arm
    stay, source rows without one are left out.  A target row that several source rows match stops
    the job if an arm acts on it, as MERGE demands.
    """
    has_t, has_s, twins, twin = fresh_names("in_t in_s twins twin", target, source)
    own = Window.partitionBy(*keys)
    counted = source.withColumns({twins: F.count(F.lit(1)).over(own), twin: F.row_number().over(own.orderBy(F.lit(1)))})
    t, s = target.withColumn(has_t, F.lit(True)).alias("t"), counted.withColumn(has_s, F.lit(True)).alias("s")
    joined = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full")
    in_t, in_s = F.col(has_t).isNotNull(), F.col(has_s).isNotNull()
    of = {MATCHED: in_t & in_s, NOT_MATCHED: ~in_t, NOT_BY_SOURCE: ~in_s}
    arm = F.lit(-1)
    for i in reversed(range(len(arms))):
        kind, condition, _ = arms[i]
        holds = of[kind] if condition is None else of[kind] & F.coalesce(F.expr(condition), F.lit(False))
        arm = F.when(holds, F.lit(i)).otherwise(arm)
    twice = F.when(in_t & in_s & (F.col(twins) > 1) & (arm >= 0), F.raise_error(F.lit("several source rows match one target row")).cast("int"))
    (which,) = fresh_names("arm", target, source)
    joined = joined.withColumn(which, F.coalesce(twice, arm))
    gone = [i for i, a in enumerate(arms) if a[2] == "delete"]
    joined = joined.filter(~F.col(which).isin(gone) if gone else F.lit(True)).filter((in_t & ~F.coalesce(F.col(twin) > 1, F.lit(False))) | (F.col(which) >= 0))
    from_source = {c.lower() for c in source.columns}
    out = []
    for c in target.columns:
        value = F.col(f"t.{c}")
        for i, (kind, _, action) in enumerate(arms):
            if isinstance(action, dict):
                sets = {k.lower(): v for k, v in action.items()}
                if kind == NOT_MATCHED and not sets:
                    new = F.col(f"s.{c}") if c.lower() in from_source else F.lit(None)
                elif c.lower() in sets:
                    new = F.expr(sets[c.lower()])
                else:
                    new = F.lit(None) if kind == NOT_MATCHED else F.col(f"t.{c}")
                value = F.when(F.col(which) == i, new).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def merge(target: DataFrame, source: DataFrame, keys: list[str], update_set: dict[str, str] | None = None, insert_rows: bool = True, delete_when: str | None = None) -> DataFrame:
    """The common MERGE: delete where ``delete_when``, else update by ``update_set``, and insert what is new."""
    arms: list[tuple] = [(MATCHED, delete_when, "delete")] if delete_when is not None else []
    arms += [(MATCHED, None, update_set)] if update_set else []
    arms += [(NOT_MATCHED, None, {})] if insert_rows else []
    return merge_into(target, source, keys, arms)
