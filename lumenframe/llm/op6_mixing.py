"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: all words are shared by weight, no target
above ``most`` times its source's words, what is above being shared again.  A document of
a source with target T and size S is expected T / S times.  The whole part of that are
certain copies; for the rest, a fraction, each document has an inclusion probability p,
that fraction times 1 + the whole root of its size (over the source's mean, words counted), at
most 1, so that long texts, which are few, are drawn more often.  Each document has a random u from its id and
the seed, its odds u / (1 - u) are divided by the inclusion odds p / (1 - p), and the
documents with the smallest quotients are taken until the source's target is met (to the
nearest document).  With ``weight_col``, copies are in proportion to the document's weight instead.

No source is sorted as a whole: words are first summed over 65,536 ranges of the quotient,
these over 256 wider ones, and only the range in which the target is met is sorted.  What is
left is one threshold a source, against which documents are filtered.

DataFrame functions only.  A null source is a source of its own, the last; a null text has
size 0; a null id draws like an id of its own; rows with equal id and size in one source
draw alike and are taken alike; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_name, read_table, shared_folder, written

MOST, SEED, RANGES = 3, 17, 65_536
WEIGHTS = (1, 2, 3)
BROADCAST_ROWS = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(ident: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))), "UTF-8"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for (source, size); one row a source.

    The targets are min(most * size, level * weight) with one level for all.  Sources are
    ordered by size over weight; the first source whose own level is within its bound, and
    all after it, share what the ones before leave.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in weights)), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("bound", F.col("source_size") * most)
    order = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0))
    w_left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("own_level", left.cast("double") / w_left)
    level = F.min(F.when(F.col("own_level") * F.col("w") <= F.col("bound"), F.struct(F.col("bound") / F.col("w"), F.col("own_level").alias("level")))).over(whole)["level"]
    return per.withColumn("level", level).select("source", "source_size", F.least(F.col("bound").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("bound").cast("double"))).alias("target"))


def _drawn(sizes: DataFrame, most: int) -> DataFrame:
    """Adds ``whole``, the certain copies, and ``quotient`` in (0, 1), null if only those are taken.

    ``quotient`` is q / (1 + q) for the Pareto quotient q, which keeps the order.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.least(ratio * F.col("weight"), F.lit(float(most)))
    whole = F.floor(copies)
    p = (copies - whole) * F.col("tilt")
    odds = (F.col("u") / (1 - F.col("u"))) / F.when(p > 0, p / (1 - p))
    return sizes.withColumns({"whole": whole, "quotient": F.when(p >= 1, F.lit(0.0)).otherwise(odds / (1 + odds))})


def _scaled(rows: DataFrame, weighted: bool) -> DataFrame:
    """Weights over their source's mean, and ``tilt``, which makes inclusion probabilities unequal where no weights do."""
    over = F.when(F.col("scale") > 0, F.col("weight") / F.col("scale"))
    if weighted:
        return rows.withColumns({"weight": over.otherwise(F.lit(1.0)), "tilt": F.lit(1.0)})
    return rows.withColumns({"weight": F.lit(1.0), "tilt": over.otherwise(F.lit(0.0))})


def _joined(left: DataFrame, small: DataFrame, rows: int) -> DataFrame:
    """Join on ``source``, null with null; broadcast only if ``small`` has few rows."""
    right = small.withColumnRenamed("source", "right_source")
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, F.col("source").eqNullSafe(F.col("right_source"))).drop("right_source")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: int) -> dict[str, Column]:
    root = F.floor(F.sqrt(n_words(F.col(text_col)).cast("double"))) + 1
    weight = root if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    return {"doc_id": F.col(id_col), "source": F.col(source_col), "size": n_words(F.col(text_col)), "u": uniform(F.col(id_col), seed), "weight": weight}


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None = None, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame, int]:
    """(sizes of all documents, thresholds of all sources, number of sources), both written.

    A threshold row: source, source_size, target, scale (of weights) and ``edge``, the
    largest (quotient, id, size) that is taken, null if no fraction is.
    """
    folder = shared_folder(docs.sparkSession, "mix")
    sizes = written(docs.select(*(c.alias(n) for n, c in _sizes(docs, id_col, text_col, source_col, weight_col, seed).items())), f"{folder}/sizes")
    targets = source_targets(sizes, weights, most)
    mean = sizes.groupBy(F.col("source").alias("s")).agg((F.sum(F.col("weight") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("scale"))
    targets = targets.join(mean, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    targets = written(targets, f"{folder}/targets")
    n = targets.count()
    drawn = _drawn(_scaled(_joined(sizes, targets, n), weight_col is not None), most)

    ranges = drawn.groupBy("source", F.least(F.floor(F.col("quotient") * RANGES), F.lit(RANGES - 1)).alias("range")).agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("target"))
    ranges = written(ranges, f"{folder}/ranges")
    by_source = Window.partitionBy("source")
    below = Window.unboundedPreceding, -1
    wide = ranges.groupBy("source", F.floor(F.col("range") / 256).alias("part")).agg(F.sum("words").alias("words"), F.sum("sure").alias("sure"), F.first("target").alias("target"))
    wide = wide.withColumn("rest", F.col("target") - F.sum("sure").over(by_source)).filter(F.col("part").isNotNull())
    wide = wide.withColumn("before", F.coalesce(F.sum("words").over(by_source.orderBy("part").rowsBetween(*below)), F.lit(0)))
    wide = wide.filter(F.col("before") < F.col("rest")).groupBy("source").agg(F.max_by(F.struct("part", "before", "rest"), "part").alias("m")).select("source", "m.*")
    wide = written(wide, f"{folder}/wide")
    met = _joined(ranges.filter(F.col("range").isNotNull()), wide, n).filter(F.floor(F.col("range") / 256) == F.col("part"))
    met = met.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(by_source.orderBy("range").rowsBetween(*below)), F.lit(0)))
    met = met.filter(F.col("before") < F.col("rest")).groupBy("source").agg(F.max_by(F.struct("range", "before", "rest"), "range").alias("m")).select("source", "m.*")
    met = written(met, f"{folder}/met")

    near = _joined(drawn, met, n).filter(F.least(F.floor(F.col("quotient") * RANGES), F.lit(RANGES - 1)) <= F.col("range"))
    last = near.filter(F.floor(F.col("quotient") * RANGES) >= F.col("range"))
    run = F.coalesce(F.sum("size").over(by_source.orderBy("quotient", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    edge = F.struct("quotient", "doc_id", "size")
    taken = last.withColumn("run", run).filter(F.col("run") + F.col("size") / 2.0 <= F.col("rest")).groupBy("source").agg(F.max(edge).alias("edge"))
    earlier = near.filter(F.floor(F.col("quotient") * RANGES) < F.col("range")).groupBy("source").agg(F.max(edge).alias("edge"))
    edges = taken.unionByName(earlier).groupBy(F.col("source").alias("s")).agg(F.max("edge").alias("edge"))
    thresholds = written(targets.join(edges, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), f"{folder}/thresholds")
    return sizes, thresholds, n


def copies_of(rows: DataFrame, thresholds: DataFrame, n: int, most: int = MOST, weighted: bool = False) -> DataFrame:
    """Adds ``copies`` to rows with doc_id, source, size, u and weight."""
    drawn = _drawn(_scaled(_joined(rows, thresholds, n), weighted), most)
    extra = F.coalesce(F.col("quotient").isNotNull() & (F.struct("quotient", "doc_id", "size") <= F.col("edge")), F.lit(False))
    return drawn.withColumn("copies", F.col("whole") + extra.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken."""
    _, thresholds, n = plan(docs, id_col, text_col, source_col, **options)
    most, seed, weight_col = options.get("most", MOST), options.get("seed", SEED), options.get("weight_col")
    row = fresh_name(docs, "__lf_row")
    own = _sizes(docs, id_col, text_col, source_col, weight_col, seed)
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias(row), *(c.alias(k) for k, c in own.items()))
    taken = copies_of(rows, thresholds, n, most, weight_col is not None).filter(F.col("copies") > 0)
    return taken.select(row, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(f"{row}.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, thresholds, n = plan(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return copies_of(sizes, thresholds, n).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {
    "op6_mixing": """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, (r - 1) % 3 + 1 AS w, source_size * 3 AS bound FROM per),
l AS (SELECT *, bound::DOUBLE / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(bound) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS own
  FROM w WINDOW o AS (ORDER BY bound::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(own, ratio) AS level FROM l WHERE own * w <= bound),
t AS (SELECT source, source_size, least(bound::DOUBLE, coalesce(level * w, bound::DOUBLE)) AS target FROM l, level),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies,
    (floor(sqrt(size::DOUBLE)) + 1) / (sum((floor(sqrt(size::DOUBLE)) + 1) * size) OVER (PARTITION BY d.source) / nullif(source_size, 0)) AS tilt FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(copies) AS whole, (copies - floor(copies)) * coalesce(tilt, 0) AS p FROM c),
k AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM q),
s AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN p > 0 AND run + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM s
"""
}
