"""Joins that SQL text in Spark lacks: as-of, positional, range, apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import fresh_names, materialized


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], how: str = "inner", strict: bool = False, direction: str = "backward", right_on: str | None = None, slice_by: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each left row the nearest right row of the same ``by`` at or before (after) ``on``.

    One shuffle by ``by`` and one sort: both sides are put in one stream and the last right
    row seen is carried along.  No pair of rows is ever made, so a key costs its own rows only.
    ``slice_by`` cuts long keys, as in ``lambda t: F.date_trunc("month", t)``: slices of a key are
    sorted apart, and only the last right row of each slice is carried to the next ones.

    Null keys and times match nothing; ``how="left"`` keeps such left rows with nulls.
    """
    right_on = right_on or on
    payload = [c for c in right.columns if c not in by]
    keys = [f"k{i}" for i in range(len(by))]
    both = [F.col(b).alias(k) for k, b in zip(keys, by)]
    whole, half = F.struct(*(F.col(f"`{c}`") for c in left.columns)), F.struct(*(F.col(f"`{c}`") for c in payload))
    held = [F.col(b).isNotNull() for b in by]
    known_l, known_r = F.col(on).isNotNull(), F.col(right_on).isNotNull()
    for h in held:
        known_l, known_r = known_l & h, known_r & h
    l = left.filter(known_l).select(*both, F.col(on).alias("t"), F.lit(0).alias("side"), whole.alias("l"), F.lit(None).cast(right.select(half).schema[0].dataType).alias("r"))
    r = right.filter(known_r).select(*both, F.col(right_on).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(left.select(whole).schema[0].dataType).alias("l"), half.alias("r"))
    # at equal times a right row counts unless the match is strict
    side = F.col("side") if strict else -F.col("side")
    back = direction == "backward"
    order = [F.col("t").asc() if back else F.col("t").desc(), side]
    rows = l.unionByName(r).withColumn("slice", slice_by(F.col("t")) if slice_by else F.lit(0))
    w = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    matched = rows.withColumn("m", F.last("r", ignorenulls=True).over(w)).filter("side = 0")
    if slice_by:
        lasts = rows.filter("side = 1").groupBy(*keys, "slice").agg((F.max_by if back else F.min_by)("r", "t").alias("r"))
        slices = rows.select(*keys, "slice").distinct().join(lasts, [*keys, "slice"], "left")
        earlier = Window.partitionBy(*keys).orderBy(F.col("slice").asc() if back else F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select(*keys, "slice", F.last("r", ignorenulls=True).over(earlier).alias("c")).filter("c IS NOT NULL")
        matched = matched.join(carried, [*keys, "slice"], "left").withColumn("m", F.coalesce("m", "c"))
    matched = matched.select("l", "m")
    if how == "inner":
        matched = matched.filter(F.col("m").isNotNull())
    else:
        none = left.filter(~F.coalesce(known_l, F.lit(False))).select(whole.alias("l"), F.lit(None).cast(right.select(half).schema[0].dataType).alias("m"))
        matched = matched.unionByName(none)
    return matched.select("l.*", *(F.col("m")[c].alias(c if c not in left.columns else f"right_{c}") for c in payload))


def positional_join(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Row i with row i in given orders; the longer side's rest meets nulls.

    Positions are counted per range of the order and shifted by the ranges before, so no
    side passes through one task.
    """
    (pos,) = fresh_names("pos", left, right)
    return numbered(left, left_order, pos).join(numbered(right, right_order, pos), pos, "full").drop(pos)


def _ranged(df: DataFrame, order: list) -> tuple[DataFrame, str, str, list[tuple[int, int]]]:
    """``df`` in ranges of ``order``, with names of columns for range and place in it, and rows per range.

    The ranges are written once: Spark samples their bounds anew each time they are
    asked for.  Rows equal in ``order`` are told apart by a hash of the row, so a frequent
    value is cut like any other.
    """
    range_, place = fresh_names("range place", df)
    hashed = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    keys = [*order, *([F.xxhash64(*hashed)] if hashed else [])]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn(range_, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = materialized(ranged, "ranged")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy(range_).count().collect())  # a row a range
    return ranged, range_, place, counts


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its position, from 0, in ``order``: one range shuffle and one count a range."""
    ranged, range_, place, counts = _ranged(df, order)
    base, before = 0, []
    for k, n in counts:
        before.append((k, base))
        base += n
    starts = df.sparkSession.createDataFrame(before or [(0, 0)], "r int, base long")
    out = ranged.join(F.broadcast(starts), F.col(range_) == F.col("r")).withColumn(name, F.col(place) + F.col("base"))
    return out.select(*(f"`{c}`" for c in df.columns), name)


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, for ``n`` too large for a top-k: whole ranges and a part of one."""
    ranged, range_, place, counts = _ranged(df, order)
    at, last = 0, -1
    for k, size in counts:
        if at + size > n:
            last = k
            break
        at += size
    else:
        return ranged.select(*(f"`{c}`" for c in df.columns))
    kept = (F.col(range_) < last) | ((F.col(range_) == last) & (F.col(place) < n - at))
    return ranged.filter(kept).select(*(f"`{c}`" for c in df.columns))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Points with the ranges [low, high] that hold them, as an equi-join on bins.

    Bins double in width from level to level, the least being ``width``.  A range lies in the
    one or two bins that it touches on the first level as wide as itself, however long it
    is; a point lies in one bin of each level that some range has.
    """
    keys = keys or []
    level, bin_ = fresh_names("level bin", points, ranges)
    size = lambda: F.lit(float(width)) * F.pow(F.lit(2.0), F.col(level))
    bin_of = lambda c: F.floor(F.col(c).cast("double") / size())
    length = (F.col(high).cast("double") - F.col(low).cast("double")) / width
    held = ranges.filter(F.col(low) <= F.col(high)).withColumn(level, F.when(length > 1, F.ceil(F.log2(length))).otherwise(F.lit(0)).cast("int"))
    levels = sorted(r[0] for r in held.select(level).distinct().collect())  # as many as a double has exponents at most
    spread = held.withColumn(bin_, F.explode(F.sequence(bin_of(low), bin_of(high))))
    at = points.withColumn(level, F.explode(F.array(*(F.lit(x) for x in levels or [0])).cast("array<int>"))).withColumn(bin_, bin_of(value))
    hit = at.join(spread, [*keys, level, bin_])
    return hit.filter((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop(level, bin_)


def less_join(left: DataFrame, right: DataFrame, by: list[str], low: str, high: str, large: str, small: str, classes: int = 64, blocks: int = 8, pack: int = 64) -> DataFrame:
    """Pairs of equal ``by`` with left ``low`` < right ``high`` and left ``large`` > right ``small``.

    Right rows fall in at most ``classes`` ranges of ``high`` (numbers or times), and there, in
    the order of ``small``, in packs; a left row meets only the ranges that can hold more than
    its ``low`` and the packs whose least ``small`` is under its ``large``, so few pairs are
    looked at that don't match.  Left rows are cut in ``blocks``, so few keys still make many
    tasks.  It is a merge join on key, range and block: a task holds the packs of one of
    those, never a whole key or side.  Only columns of ``by`` may have one name on both sides.
    """
    class_, block, place, least, rows, at = fresh_names("class block place least rows at", left, right)
    payload = [c for c in right.columns if c not in by]
    bounds = right.select(F.percentile_approx(high, [k / classes for k in range(1, classes)])).first()[0]
    bounds = sorted(set(bounds or []))
    above = lambda c: sum((F.when(F.col(c) > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
    l = left.filter(F.col(low).isNotNull() & F.col(large).isNotNull()).repartition(*(f"`{c}`" for c in left.columns))
    l = l.withColumn(class_, F.explode(F.sequence(above(low), F.lit(len(bounds)))))
    l = l.withColumn(block, F.pmod(F.xxhash64(*(f"`{c}`" for c in left.columns)), F.lit(blocks)).cast("int"))
    r = right.filter(F.col(high).isNotNull() & F.col(small).isNotNull()).withColumn(class_, above(high))
    order = Window.partitionBy(*by, class_).orderBy(small)
    r = r.withColumn(place, F.floor((F.row_number().over(order) - 1) / pack))
    r = r.groupBy(*by, class_, place).agg(F.min(small).alias(least), F.collect_list(F.struct(*(f"`{c}`" for c in payload))).alias(rows))
    r = r.select(*by, class_, least, *(F.col(rows)[c].alias(c) for c in payload), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(block))
    # the hint keeps Spark from sending one side to the few tasks that read the other
    met = l.join(r.hint("merge"), [*by, class_, block]).filter(F.col(large) > F.col(least))
    each = met.select("*", F.posexplode(payload[0]).alias(at, rows))
    of = lambda c: F.get(F.col(c), F.col(at)) if c != payload[0] else F.col(rows)
    held = each.filter((F.col(low) < of(high)) & (F.col(large) > of(small)))
    return held.select(*(f"`{c}`" for c in left.columns), *(of(c).alias(c) for c in payload))


def apply_top(left: DataFrame, right: DataFrame, on: str, right_on: str, order: list, n: int, outer: bool = False) -> DataFrame:
    """CROSS (OUTER) APPLY of the first ``n`` right rows per key."""
    (rank,) = fresh_names("rank", right)
    w = Window.partitionBy(right_on).orderBy(*order)
    top = right.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).drop(rank)
    return left.join(top, F.col(on) == F.col(right_on), "left" if outer else "inner")


def apply(left: DataFrame, make: Callable[[Column], Column], name: str, outer: bool = False) -> DataFrame:
    """CROSS (OUTER) APPLY of an array expression over each row."""
    return left.withColumn(name, (F.explode_outer if outer else F.explode)(make(left)))
