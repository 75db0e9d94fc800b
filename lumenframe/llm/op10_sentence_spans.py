"""Repeated passages across documents, by hashes of sliding sentence spans.

A text is cut into sentences after ``.``, ``!`` or ``?`` before a blank and at line ends;
a sentence of 20 words or more counts as several, cut where hashes of its words say, so
equal passages are cut alike whatever precedes them.  From every sentence a span runs on
until it has at least ``least_sentences`` sentences and ``least_words`` words.  All spans
are hashed (words with A-Z in lower case, single blanks between) and met over the whole
corpus.  Of equal spans the first, by document id and place, stays; sentences covered by
any other are removed.

Hashes are counted by their first 64 bits with partial sums; only spans whose count is
above one are compared by all 128 bits and placed, so most rows cross the network as
one small count.  Spans of a document are gathered per document only.  The sides of both
joins are written first: under a join that reads aggregates straight from their exchange
Spark can't split the partition of a hot span.
"""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, read_table, shared_folder, text_groups, written

LEAST_SENTENCES, LEAST_WORDS, LONGEST, REACH = 2, 20, 25, 3
END = re.compile(rb"(?<=[.!?])[ \t\x0b\x0c\r]+|\n+")
NO_ID = (1 << 63) - 1
SPAN = "doc long, mark long, pos int, n int, h1 long, h2 long"


def breaks(words: list[bytes]) -> list[int]:
    """Places before which a sentence is cut; they depend on the words nearby.

    A cut follows a word whose hash with the one before is the smallest of ``REACH`` on
    either side.  Parts of 20 words or more without one (repeated words) are cut at steps
    of half of ``LONGEST``.
    """
    h = [zlib.crc32(b, zlib.crc32(a) + 1) for a, b in pairwise(words)]
    out, last = [], 0
    for i in range(REACH, len(h)):
        at = i + 2
        if i + REACH < len(h) and h[i] < min(h[i - REACH : i]) and h[i] <= min(h[i + 1 : i + REACH + 1]) or at > len(h):
            if at - last >= LEAST_WORDS:
                out += range(last + LONGEST // 2, at - 1, LONGEST // 2)
            if at <= len(h):
                out.append(at)
            last = at
    return out


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each sentence in byte offsets; blanks after it belong to it."""
    out, start = [], 0
    for stop in [*(m.end() for m in END.finditer(text)), len(text)]:
        words = text[start:stop].lower().split()
        if len(words) >= LEAST_WORDS:
            at, ends = start, [start + m.end() for m in re.finditer(rb"\S+\s*", text[start:stop])]
            ends[-1] = stop
            for i, j in pairwise([0, *breaks(words), len(words)]):
                out.append((at, ends[j - 1], words[i:j]))
                at = ends[j - 1]
        elif words:
            out.append((start, stop, words))
        elif out and stop > start:
            out[-1] = (out[-1][0], stop, out[-1][2])
        start = stop
    return out


def spans(found: list[tuple[int, int, list[bytes]]], least_sentences: int, least_words: int):
    """(first sentence, number of sentences, text) of every shortest span that is long enough."""
    joined = [b" ".join(w) for _, _, w in found]
    sizes = [len(w) for _, _, w in found]
    end, words = 0, 0
    for i in range(len(found)):
        while end < len(found) and (end - i < least_sentences or words < least_words):
            words += sizes[end]
            end += 1
        if end - i < least_sentences or words < least_words:
            return
        yield i, end - i, b" ".join(joined[i:end])
        words -= sizes[i]


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), F.encode(text, "UTF-8").alias("text"))


def span_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, sizes: bool = False) -> DataFrame:
    """A row per span: document, hash of its text, first sentence, sentences, 128-bit hash.

    With ``sizes`` also a row per document at place -1 with its number of sentences.
    """

    def task(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, group in text_groups(batch.column(2)):
                doc, mark, pos, n, data = [], [], [], [], []
                for i, text in enumerate(group, first):
                    found = sentences(text)
                    if sizes:
                        pos.append(-1)
                        n.append(len(found))
                        data.append(bytes(16))
                    for at, count, span in spans(found, least_sentences, least_words):
                        pos.append(at)
                        n.append(count)
                        data.append(xxh3_128_digest(span))
                    doc += [ids[i]] * (len(pos) - len(doc))
                    mark += [marks[i]] * (len(pos) - len(mark))
                import numpy as np

                halves = np.frombuffer(b"".join(data), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=[c.split()[0] for c in SPAN.split(", ")])

    return _inputs(docs, id_col, text_col).mapInArrow(task, SPAN)


def repeated(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc, mark, gone), per document the spans (pos, n) that repeat an earlier one; and (doc, mark, n_sentences) of all.

    Texts go through Python once; the hashes are written and read twice.
    """
    whole = written(span_hashes(docs, id_col, text_col, least_sentences, least_words, sizes=True), f"{folder}/hashes")
    sizes = whole.filter("pos < 0").select("doc", "mark", F.col("n").cast("long").alias("n_sentences"))
    found = whole.filter("pos >= 0")
    often = written(found.groupBy("h1").agg(F.count("*").alias("c")).filter("c > 1").select("h1"), f"{folder}/often")
    some = written(found.join(often, "h1"), f"{folder}/some")
    place = F.struct("doc", "mark", "pos")
    first = written(some.groupBy("h1", "h2").agg(F.min(place).alias("first")), f"{folder}/first")
    later = some.join(first, ["h1", "h2"]).filter(place != F.col("first"))
    return written(later.groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("gone")), f"{folder}/gone"), sizes


def _cover(spans_: list, n: int) -> list[tuple[int, int]]:
    """Runs [first, after last) of sentences that sorted spans cover."""
    out: list[list[int]] = []
    for s in spans_:
        a, b = s["pos"], min(n, s["pos"] + s["n"])
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed and removed, runs [first, after last) of sentences.

    Null and empty texts have no sentences; a null id comes after all others; rows equal
    in id and text are one document and get equal rows; an empty table gives none; other
    columns are ignored.
    """
    folder = shared_folder(docs.sparkSession, "spans")
    gone, sizes = repeated(docs, folder, id_col, text_col, least_sentences, least_words)

    @F.arrow_udf("array<struct<first: int, after: int>>")
    def cover(of: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
        return pa.array([[{"first": a, "after": b} for a, b in _cover(x or [], 1 << 31)] for x in of.to_pylist()], kind)

    covered = gone.select("doc", "mark", cover("gone").alias("removed"))
    out = sizes.join(covered, ["doc", "mark"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<first: int, after: int>>")))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["after"] - r["first"])
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_sentences", removed.alias("n_removed"), "removed")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text_col`` without the removed sentences; other columns as they are.

    Where a removed span follows the rest of a sentence, a line end takes its place.  Null and
    empty texts stay as they are, a null id comes after all others, rows equal in id and text are one document and
    get equal texts, an empty table stays empty.
    """
    folder = shared_folder(docs.sparkSession, "spans")
    gone, _ = repeated(docs, folder, id_col, text_col, least_sentences, least_words)
    doc, mark, name = (fresh_name(docs, f"__lf_{c}") for c in ("doc", "mark", "gone"))

    def one(text: str, spans_: list) -> str:
        data = text.encode()
        found = sentences(data)
        out, last = [], 0
        for a, b in _cover(spans_, len(found)):
            out.append(data[last : found[a][0]])
            if out[-1] and not END.search(out[-1][-64:].rstrip()[-1:] + b" ") and b"\n" not in out[-1][len(out[-1].rstrip()) :]:
                out.append(b"\n")  # the rest of a sentence is no part of the next
            last = found[b - 1][1]
        return b"".join([*out, data[last:]]).decode()

    @F.arrow_udf("string")
    def kept(texts: pa.Array, of: pa.Array) -> pa.Array:
        pairs = ((texts[i].as_py(), of[i].as_py()) for i in range(len(texts)))  # one text at a time
        return pa.array([one(t, s) if s else t for t, s in pairs], pa.string())  # Spark may ask for rows that the branch below leaves out

    keys = {doc: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), mark: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    out = docs.withColumns(keys).join(gone.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("gone").alias(name)), [doc, mark], "left")
    return out.withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(kept(F.col(text_col), F.col(name)))).select(*docs.columns)


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = span_report(read_table(spark, sf_dir, "documents"))
    return report.withColumn("removed", F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["first"].cast("string"), (r["after"] - 1).cast("string"))), ","))


QUERIES = {"op10_sentence_spans": op10_sentence_spans}
ORACLE_SQL: dict[str, str] = {}
