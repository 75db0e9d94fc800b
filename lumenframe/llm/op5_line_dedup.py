"""Exact line deduplication with levelled sorted runs of line hashes.

Documents are taken in batches.  A batch's line keys are counted, then merge-anti-joined
with the runs: keys that no run holds become a new run of their own, sorted and bucketed by
key, with the number of documents and the largest document id; keys that some run
holds already go to a small table of repeats.  When a level has ``fanout`` runs they are
merged into one run of the next level, so a key meets a logarithmic number of runs.  Since
every key lies in exactly one run, a merge only concatenates and sorts, and the total of a
key is its run's entry plus its repeats.

A key is the line without blanks at its ends and with A-Z in lower case, as MD5.  A key of
at least ``least_chars`` code points in at least ``least_docs`` documents loses its lines,
except in the document with the largest id that holds it.

The runs outlive a call: ``LineRuns.reopen`` takes up those of a folder, and later
batches are joined with them.

DataFrame functions only.  A document is a pair of id and text, so repeated rows count
once and lose the same lines; a null id is below all others; null and empty texts are one
empty line; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, read_table, removed, shared_folder, written

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS, BATCHES, FANOUT = 20, 3, 4, 4
NO_ID = -(1 << 63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Runs of (key, documents, largest id), disjoint in key, in levels; and the repeats.

    Which runs there are stands in a manifest below ``folder``, written anew after each batch, so
    ``reopen`` carries on in another session; what a merge replaces is deleted after that.
    """

    RUN = "level int, name string, buckets int"

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[DataFrame] = []
        self.old: list[str] = []
        self.version = 0

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> LineRuns:
        """The runs that lie below ``folder``, as the last batch left them."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        names = [f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
        done = [int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-") and cls._whole(spark, f"{folder}/{n}")]
        rows = spark.read.schema(cls.RUN).json(f"{folder}/manifest-{max(done)}").collect() if done else []  # a row a run
        buckets = next((r.buckets for r in rows), None)
        runs = cls(spark, folder, fanout, buckets)
        runs.version = max(done, default=0)
        for r in sorted(rows, key=lambda r: (r.level, r.name)):
            if r.level < 0:
                runs.repeats.append(spark.read.schema("key string, n long, last long").parquet(f"{folder}/{r.name}"))
                runs.again = [*runs.again, r.name]
                continue
            runs.levels += [[] for _ in range(r.level + 1 - len(runs.levels))]
            runs.levels[r.level].append(r.name)
            if not spark.catalog.tableExists(r.name):
                spark.sql(f"CREATE TABLE {r.name} (key STRING, n BIGINT, last BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {r.buckets} BUCKETS LOCATION '{folder}/{r.name}'")
        return runs

    @staticmethod
    def _whole(spark: SparkSession, folder: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    again: list[str] = []

    def _recorded(self) -> None:
        """Write the manifest, then delete what it no longer names."""
        self.version += 1
        rows = [(level, name, self.buckets) for level, names in enumerate(self.levels) for name in names] + [(-1, name, self.buckets) for name in self.again]
        self.spark.createDataFrame(rows, self.RUN).coalesce(1).write.json(f"{self.folder}/manifest-{self.version}")
        for name in self.old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, f"{self.folder}/{name}")
        removed(self.spark, f"{self.folder}/manifest-{self.version - 1}")
        self.old = []

    def _store(self, run: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        run.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _add(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, *rest = (self.spark.table(n) for n in self.levels[level])
            for run in rest:
                merged = merged.unionByName(run)
            old, self.levels[level] = self.levels[level], []
            self._add(self._store(merged), level + 1)
            self.old += old

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def add(self, batch: DataFrame) -> None:
        """Take one batch: (key, n, last), one row per key."""
        folder = f"{self.folder}/batch-{uuid.uuid4().hex}"
        batch = written(batch, folder)
        fresh = batch
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), "key", "left_anti")
        held = self.runs()
        name = self._store(fresh)
        if held:
            again = batch.join(self.spark.table(name).hint("merge"), "key", "left_anti")
            self.again = [*self.again, f"again-{uuid.uuid4().hex}"]
            self.repeats.append(written(again, f"{self.folder}/{self.again[-1]}"))
        self._add(name, 0)
        removed(self.spark, folder)
        self._recorded()

    def totals(self, least: int) -> DataFrame:
        """(key, n, last) of all keys in at least ``least`` documents."""
        out = self.spark.createDataFrame([], "key string, n long, last long") if not self.runs() else None
        again = None
        for r in self.repeats:
            again = r if again is None else again.unionByName(r)
        if again is not None:
            again = again.groupBy("key").agg(F.sum("n").alias("more"), F.max("last").alias("later"))
        for run in self.runs():
            if again is None:
                part = run
            else:
                part = run.join(again, "key", "left").select("key", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))
            out = part if out is None else out.unionByName(part)
        return out.filter(F.col("n") >= least)

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, self.folder)
        self.levels = []


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text_col`` without dropped lines, and columns ``n_lines`` and ``n_dropped``.

    The two new columns get ``_`` appended where ``docs`` has such names.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "lines")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    each = docs.select(ident.alias("doc"), mark.alias("mark"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    each = each.select("doc", "mark", "pos", line_key(F.col("line")).alias("line")).filter(F.char_length("line") >= least_chars)
    each = each.select(F.md5(F.encode("line", "UTF-8")).alias("key"), "doc", "mark", "pos", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch"))
    each.write.partitionBy("batch").parquet(f"{folder}/lines")
    each = spark.read.schema(each.schema).parquet(f"{folder}/lines")

    runs = LineRuns(spark, f"{folder}/runs", fanout)
    for b in range(batches):
        some = each.filter(F.col("batch") == b)
        runs.add(some.groupBy("key").agg(F.count_distinct("doc", "mark").alias("n"), F.max("doc").alias("last")))
    common = written(runs.totals(least_docs).select("key", "last"), f"{folder}/common")
    runs.drop()

    dropped = each.join(common, "key").filter(F.col("doc") != F.col("last"))
    dropped = dropped.groupBy("doc", "mark").agg(F.array_distinct(F.collect_list("pos")).alias("gone"))

    keep_id, keep_mark, gone, lines = (fresh_name(docs, f"__lf_{n}") for n in ("doc", "mark", "gone", "lines"))
    n_lines, n_dropped = fresh_name(docs, "n_lines"), fresh_name(docs, "n_dropped")
    dropped = dropped.select(F.col("doc").alias(keep_id), F.col("mark").alias(keep_mark), F.col("gone").alias(gone))
    out = docs.withColumns({keep_id: ident, keep_mark: mark}).join(dropped.hint("shuffle_hash"), [keep_id, keep_mark], "left")
    out = out.withColumn(lines, lines_of(F.col(text_col)))
    count = F.size(lines)
    kept = F.array_except(F.sequence(F.lit(0), count - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    out = out.withColumns({n_lines: count.cast("long"), n_dropped: F.coalesce(F.size(gone), F.lit(0)).cast("long"), text_col: text})
    return out.select(*docs.columns, n_lines, n_dropped)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE_SQL = {
    "op5_line_dedup": """
WITH lines AS (
  SELECT doc_id, pos, l[pos] AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
