"""Learned decision lists for document quality, by sequential covering.

From labelled documents, rules for rejection are learned one after the other: a rule is
grown on two thirds of the rows by adding the threshold test with the largest gain until it covers
no good row, then pruned on the last third by dropping its last tests while that raises
(p - n) / (p + n).  Rows that a rule covers leave, and learning ends when a pruned rule is
no longer precise.  The list becomes an ordered Spark CASE expression: the first rule
that holds decides, the default keeps.

The fit uses at most ``most_rows`` labelled documents, those with the smallest hashes of
their ids; statistics and verdicts cover every document and its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, read_table, shared_folder, text_groups, written

#: Bound on the labelled documents that a fit uses.
MOST_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_marks", "n_bars", "n_digits", "n_distinct", "n_short", "n_ends"]
STATS = "struct<" + ", ".join(f"{c}: long" for c in COUNTS) + ">"
DELETE = {n: bytes(set(range(256)) - set(keep)) for n, keep in (("n_upper", range(65, 91)), ("n_marks", b"!?"), ("n_bars", b"|"), ("n_digits", range(48, 58)), ("n_symbols", b"#*$%&|<>"), ("n_ends", b"."))}
CONTINUATION, BLANKS = bytes(range(0x80, 0xC0)), b" \t\n\x0b\x0c\r"


def statistics(text: bytes) -> tuple[int, ...]:
    """COUNTS of one UTF-8 text.

    Words are runs without the six ASCII blanks.  n_dup_lines counts lines that have a word
    and equal an earlier line; n_repeat_words counts words in any three-word window that
    occurs at least twice, first occurrences included.
    """
    words = text.split()
    n = len(words)
    kept = text.translate(None, CONTINUATION)
    word_chars = len(kept.translate(None, BLANKS))
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeated = 0
    if n > 3:
        spans = list(zip(words, words[1:], words[2:]))
        if len(set(spans)) < len(spans):
            once: set[tuple] = set()
            twice = {s for s in spans if s in once or once.add(s)}
            end = 0
            for i, s in enumerate(spans):
                if s in twice:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    only = {k: len(text.translate(None, d)) for k, d in DELETE.items()}
    distinct = set(words)
    short = sum(1 for w in words if len(w) <= 3)
    return n, word_chars, only["n_symbols"], dup, repeated, len(kept), len(lines), only["n_upper"], only["n_marks"], only["n_bars"], only["n_digits"], len(distinct), short, only["n_ends"]


def stats_column(text: Column) -> Column:
    """COUNTS of every whole text as a struct; null is empty."""

    @F.arrow_udf(STATS)
    def counted(texts: pa.Array) -> pa.Array:
        rows = [statistics(t) for _, group in text_groups(texts) for t in group]
        columns = list(zip(*rows)) or [()] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)

    return counted(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


#: Features: one count over another, 0 over 0 being 0.
RATIOS = {
    "symbols_a_word": ("n_symbols", "n_words"),
    "marks_a_word": ("n_marks", "n_words"),
    "bars_a_word": ("n_bars", "n_words"),
    "upper_a_char": ("n_upper", "n_chars"),
    "digits_a_char": ("n_digits", "n_chars"),
    "chars_a_word": ("word_chars", "n_words"),
    "repeats_a_word": ("n_repeat_words", "n_words"),
    "dup_lines_a_line": ("n_dup_lines", "n_lines"),
    "distinct_a_word": ("n_distinct", "n_words"),
    "short_a_word": ("n_short", "n_words"),
    "ends_a_word": ("n_ends", "n_words"),
    "words": ("n_words", None),
}


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: float

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        c = features[self.feature]
        return c >= self.threshold if self.at_least else c <= self.threshold


Rule = tuple[Test, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.rows(x)
    return out


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Test | None:
    """The test with the largest information gain for bad rows within ``inside``."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    start = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for feature, values in x.items():
        v, b = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order]
        change = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(change):
            continue
        if len(change) > 256:
            change = change[np.linspace(0, len(change) - 1, 256).astype(int)]
        below_p = np.r_[0, np.cumsum(b)][change]
        for at_least, p, t in ((False, below_p, change), (True, p0 - below_p, len(v) - change)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / t) - start), -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = gain[i], Test(feature, at_least, float((v[change[i] - 1] + v[change[i]]) / 2))
    return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, least_rows: int = 5, most_rules: int = 32, most_tests: int = 6) -> list[Rule]:
    """Rules for bad rows, by sequential covering; rows must come in an order without meaning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    grow = np.arange(len(bad)) % 3 > 0
    while len(rules) < most_rules and bad[left & grow].sum() >= least_rows:
        rule: Rule = ()
        inside = left & grow
        while len(rule) < most_tests and (~bad[inside]).any():
            test = _best_test(x, bad, inside)
            if test is None:
                break
            rule += (test,)
            inside = inside & test.rows(x)
        if not rule:
            break
        held = left & ~grow

        def worth(r: Rule) -> float:
            c = covered(r, x, len(bad)) & held
            p = int(bad[c].sum())
            return (2 * p - int(c.sum())) / max(1, int(c.sum()))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = covered(rule, x, len(bad)) & left
        if bad[c].sum() < least_rows or bad[c].mean() < least_precision or (worth(rule) + 1) / 2 < least_precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def features_of(stats: Column) -> dict[str, Column]:
    out = {}
    for name, (above, below) in RATIOS.items():
        top = stats[above].cast("double")
        out[name] = top if below is None else F.when(stats[below] > 0, top / stats[below]).otherwise(F.lit(0.0))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> list[Rule]:
    """Rules from labelled documents that pass the base; ids with null or unequal labels are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z"), F.count("*").alias("n"), F.count("y").alias("m"))
    known = known.filter((F.col("y") == F.col("z")) & (F.col("n") == F.col("m")) & F.col("id").isNotNull() & F.col("y").isin(0, 1))
    folder = shared_folder(docs.sparkSession, "labels")
    known = written(known.orderBy(F.xxhash64("id"), "id").limit(most_rows).select("id", "y"), f"{folder}/known")
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    # written first: else the filter on statistics moves below the join, and every document gets them
    some = written(some, f"{folder}/texts").repartition(docs.sparkSession.sparkContext.defaultParallelism).select("id", "y", stats_column(F.col("text")).alias("s"))
    some = some.filter(~base_failed(F.col("s")))
    wide = some.select("id", "y", *(c.alias(k) for k, c in features_of(F.col("s")).items())).orderBy(F.xxhash64("id", F.lit(1)), "id", *RATIOS).limit(most_rows)
    rows = wide.toPandas()
    return learn({k: rows[k].to_numpy() for k in RATIOS}, rows["y"].to_numpy() == 0)


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The decision list as one ordered CASE expression: true keeps."""
    features = features_of(stats)
    out = None
    for rule in rules:
        holds = rule[0].column(features)
        for test in rule[1:]:
            holds = holds & test.column(features)
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``stats`` (``_`` appended where that name is taken).

    The struct has COUNTS, base_failed and kept.  Null and empty texts have no words, so
    their base fails; repeated rows get equal verdicts; an empty table stays empty.
    """
    raw, name = fresh_name(docs, "__lf_stats"), fresh_name(docs, "stats")
    s = F.col(raw)
    failed = base_failed(s)
    return docs.withColumn(raw, stats_column(F.col(text_col))).select(*docs.columns, F.struct(*(s[c].alias(c) for c in COUNTS), failed.alias("base_failed"), (~failed & verdict(rules, s)).alias("kept")).alias(name))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, read_table(spark, sf_dir, "labels"))
    judged = judge(docs, rules)
    return judged.select("doc_id", *(F.col("stats")[c].alias(c) for c in (*COUNTS[:5], "base_failed", "kept")))


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE_SQL: dict[str, str] = {}
