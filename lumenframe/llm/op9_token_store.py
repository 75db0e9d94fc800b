"""A content-addressed store of token ids.

Format, below one folder:

* ``packs/*.pack``: the magic ``LFPK0001``, then Zstandard frames.  A frame holds chunks
  one after the other, ids as little-endian unsigned integers of ``width`` bytes (2 if the
  vocabulary allows it, else 4).
* ``chunks/``: Parquet, one row per unique chunk: digest (BLAKE2b, 16 bytes, of the ids as
  32-bit integers), pack, frame offset and length, place in the frame, number of ids.
* ``recipes/``: Parquet in ascending document id: the digests of a document's chunks in
  order and its Merkle root; ``start`` is the number of ids of all documents before it.

A rolling hash over the last four ids decides where an id stream is cut, so equal
passages give equal chunks.  Tasks write packs under names of their own attempt; only
packs that a finished task reported count, so lost and repeated tasks do no harm.  Each
task keeps its unique chunks, then one owner is chosen per digest over all packs, and
packs with chunks owned elsewhere are rewritten without them.

Reading goes pack by pack, in order: each chunk's digest is checked and its crc32 taken
where it lies; a document's crc32 is combined from its chunks', and its Merkle root is
compared with the recipe's.  No id crosses the network.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Files, read_table, shared_folder, text_groups, written
from .token_ids import word_ids

MAGIC = b"LFPK0001"
LEAST, MEAN_BITS, MOST, SPAN = 64, 9, 4096, 4
FRAME_BYTES, PACK_BYTES = 1 << 18, 256 << 20
ENTRY = "doc_id long, part long, ord long, seq long, digest binary, n_ids long, pack string, frame long, frame_bytes long, at long"
PLACE = "digest binary, pack string, frame long, frame_bytes long, at long, n_ids long"


def _weights() -> np.ndarray:
    """One odd 64-bit multiplier a place of the rolling window."""
    return np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(SPAN)], np.uint64)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of ``ids``: after hashes with zero high bits, within LEAST and MOST."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    rolled = np.zeros(n - SPAN + 1, np.uint64)
    for i, w in enumerate(_weights()):
        rolled += mixed[i : i + len(rolled)] * w
    candidates = np.flatnonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0) + SPAN
    ends, last = [], 0
    for c in candidates.tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST and c < n:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    ends.append(n)
    return ends


def chunk_digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + d, digest_size=16).digest() for d in digests] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


POLYNOMIAL = 0xEDB88320


def _multiply(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo crc32's, bits reversed as crc32 has them."""
    product, bit = 0, 1 << 31
    while bit:
        if a & bit:
            product ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
        bit >>= 1
    return product


@functools.cache
def _shift_tables(k: int) -> np.ndarray:
    """Row i has, for each value of byte i of a crc32, what 2^k more bytes after it make of that byte."""
    power = 1 << 23
    for _ in range(k):
        power = _multiply(power, power)
    return np.array([[_multiply(power, byte << 8 * i) for byte in range(256)] for i in range(4)], np.uint32)


def crc32_of_runs(crcs: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """crc32 of each run of byte strings in a row from the strings' own crc32 and sizes.

    A run begins at each of ``starts`` and has a string at least.
    """
    if not len(starts):
        return np.zeros(0, np.uint32)
    upto, ends = np.cumsum(sizes), np.append(starts[1:], len(sizes)) - 1
    after = np.repeat(upto[ends], ends - starts + 1) - upto
    out = crcs.astype(np.uint32)
    for k in range(int(after.max()).bit_length()):
        at = np.flatnonzero(after >> k & 1)
        tables, v = _shift_tables(k), out[at]
        out[at] = tables[0][v & 255] ^ tables[1][v >> 8 & 255] ^ tables[2][v >> 16 & 255] ^ tables[3][v >> 24]
    return np.bitwise_xor.reduceat(out, starts)


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings in a row from their own."""
    return int(crc32_of_runs(np.array([first, second]), np.array([0, second_bytes]), np.array([0]))[0])


class PackWriter:
    """Writes chunks into packs of an attempt; ``add`` gives each chunk's place.

    ``done`` is called with each frame's places as soon as they are known.
    """

    def __init__(self, folder: str, width: int):
        import zstandard

        self.files, self.width = Files(f"{folder}/packs"), width
        self.compressor = zstandard.ZstdCompressor(level=1, write_content_size=True)
        self.file = None
        self.raw: list[bytes] = []
        self.waiting: list[tuple] = []
        self.size = 0

    def add(self, data: bytes, tag) -> list[tuple]:
        """data: ids as 32-bit integers.  Gives (tag, pack, frame, frame bytes, place) of frames that are full."""
        if self.width == 2:
            data = np.frombuffer(data, "<u4").astype("<u2").tobytes()
        self.waiting.append((tag, self.size))
        self.raw.append(data)
        self.size += len(data)
        return self.flush() if self.size >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        if not self.raw:
            return []
        if self.file is None:
            self.pack = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.pack"
            self.file = self.files.writer(self.pack)
            self.file.write(MAGIC)
            self.offset = len(MAGIC)
        frame = self.compressor.compress(b"".join(self.raw))
        self.file.write(frame)
        places = [(tag, self.pack, self.offset, len(frame), at) for tag, at in self.waiting]
        self.offset += len(frame)
        self.raw, self.waiting, self.size = [], [], 0
        if self.offset >= PACK_BYTES:
            self.close()
        return places

    def close(self) -> list[tuple]:
        places = self.flush()
        if self.file is not None:
            self.file.close()
            self.file = None
        return places


def read_chunk(raw: bytes, at: int, n_ids: int, width: int) -> bytes:
    """A chunk of a frame as 32-bit integers."""
    data = raw[at : at + n_ids * width]
    return np.frombuffer(data, "<u2").astype("<u4").tobytes() if width == 2 else data


def _frames(folder: str, rows):
    """(row, bytes of its frame) for rows (digest, pack, frame, frame bytes, ...) in that order."""
    import zstandard

    files, decompress = Files(f"{folder}/packs"), zstandard.ZstdDecompressor()
    pack, frame, source, raw = None, None, None, b""
    try:
        for row in rows:
            if row[1] != pack:
                if source is not None:
                    source.close()
                pack, frame, source = row[1], None, files.reader(row[1])
                if source.read(len(MAGIC)) != MAGIC:
                    raise ValueError(f"{pack} is no pack")
            if row[2] != frame:
                frame = row[2]
                source.seek(frame)
                raw = decompress.decompress(source.read(row[3]))
            yield row, raw
    finally:
        if source is not None:
            source.close()


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _encoded(docs: DataFrame, folder: str, tokenizer: str, id_col: str, text_col: str, end_id: int, width: int) -> DataFrame:
    """Writes first packs; a row per document and chunk, with the chunk's place."""
    end = end_id.to_bytes(4, "little")

    def task(batches):
        encode, part, ord_ = word_ids(tokenizer).encode, TaskContext.get().partitionId(), 0
        writer, here, out = PackWriter(folder, width), {}, []
        waiting: list[tuple] = []  # entries whose frame is not yet written

        def placed(places):
            for digest, *place in places:
                here[digest] = tuple(place)
            ready = [w for w in waiting if here[w[4]] is not None]
            waiting[:] = [w for w in waiting if here[w[4]] is None]
            out.extend((*w, *here[w[4]]) for w in ready)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, group in text_groups(batch.column(1), 8 << 20):
                for i, data in enumerate(encode(group), first):
                    data += end
                    last = 0
                    for seq, cut in enumerate(cuts(np.frombuffer(data, "<u4"))):
                        chunk = data[4 * last : 4 * cut]
                        digest = chunk_digest(chunk)
                        entry = (ids[i], part, ord_, seq, digest, cut - last)
                        last = cut
                        place = here.get(digest, 0)
                        if place:
                            out.append((*entry, *place))
                        else:
                            waiting.append(entry)
                            if place == 0:
                                here[digest] = None
                                if places := writer.add(chunk, digest):
                                    placed(places)
                    ord_ += 1
                if len(here) > 500_000 and not waiting:
                    here.clear()  # bounds memory; copies across the gap meet in the next step
                if len(out) >= 20_000:
                    yield _batch(out, ENTRY)
                    out = []
        placed(writer.close())
        yield _batch(out, ENTRY)

    return docs.select(F.col(id_col).cast("long"), F.encode(F.col(text_col), "UTF-8")).mapInArrow(task, ENTRY)


def _compacted(entries: DataFrame, folder: str, width: int) -> DataFrame:
    """Rewrites packs so that each chunk is stored once; a row per chunk with its new place."""
    places = entries.select("digest", "n_ids", F.struct("pack", "frame", "frame_bytes", "at").alias("place"))
    owned = places.groupBy("digest").agg(F.min("place").alias("place"), F.first("n_ids").alias("n_ids"))
    owned = owned.select("digest", "place.*", "n_ids").select(*(c.split()[0] for c in PLACE.split(", ")))

    def task(batches):
        writer, lengths, out = PackWriter(folder, width), {}, []

        def placed(places):
            out.extend((digest, *place, lengths.pop(digest)) for digest, *place in places)

        for row, raw in _frames(folder, _rows(batches)):
            lengths[row[0]] = row[5]
            placed(writer.add(read_chunk(raw, row[4], row[5], width), row[0]))
            if len(out) >= 20_000:
                yield _batch(out, PLACE)
                out = []
        placed(writer.close())
        yield _batch(out, PLACE)

    return owned.repartition(F.col("pack")).sortWithinPartitions("pack", "frame", "at").mapInArrow(task, PLACE)


def _before(sums: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Adds ``start``, the sum of n_tokens before each row in ascending (doc_id, part, ord).

    Rows are dealt by ranges; only one sum a range comes to the driver.
    """
    ranged = sums.repartitionByRange(F.col("doc_id").asc_nulls_first(), "part", "ord").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, f"{folder}/ranged")
    totals = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()}
    base, rows = 0, []
    for r in sorted(totals):
        rows.append((r, base))
        base += totals[r]
    bases = spark.createDataFrame(rows, "range int, base long")
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "part", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(bases), "range").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).drop("range", "base")


def _roots(entries: DataFrame) -> DataFrame:
    @F.arrow_udf("binary")
    def root(digests: pa.Array) -> pa.Array:
        return pa.array([merkle_root(d) for d in digests.to_pylist()], pa.binary())

    recipe = entries.groupBy("doc_id", "part", "ord").agg(F.sort_array(F.collect_list(F.struct("seq", "digest"))).alias("recipe"), F.sum("n_ids").alias("n_tokens"))
    return recipe.select("doc_id", "part", "ord", "n_tokens", F.col("recipe.digest").alias("digests")).withColumn("root", root("digests"))


class TokenStore:
    """A written store: ``chunks`` and ``recipes`` as DataFrames, ``folder`` with all files."""

    def __init__(self, spark: SparkSession, folder: str, width: int):
        self.spark, self.folder, self.width = spark, folder, width
        self.chunks = spark.read.schema(PLACE).parquet(f"{folder}/chunks")
        self.recipes = spark.read.parquet(f"{folder}/recipes")

    def checked(self) -> DataFrame:
        """Every chunk as read from the packs: digest, n_ids, crc32 of its 32-bit ids.

        A chunk whose bytes do not give its digest stops the job.
        """
        folder, width, schema = self.folder, self.width, "digest binary, n_ids long, crc long"

        def task(batches):
            out = []
            for row, raw in _frames(folder, _rows(batches)):
                data = read_chunk(raw, row[4], row[5], width)
                if chunk_digest(data) != row[0]:
                    raise ValueError(f"pack {row[1]}: a chunk differs from its digest")
                out.append((row[0], row[5], zlib.crc32(data)))
                if len(out) >= 20_000:
                    yield _batch(out, schema)
                    out = []
            yield _batch(out, schema)

        return self.chunks.repartition(F.col("pack")).sortWithinPartitions("pack", "frame", "at").mapInArrow(task, schema)

    def documents(self) -> DataFrame:
        """One row per document, read back: doc_id, start, n_tokens, ids_crc32, verified."""

        @F.arrow_udf("struct<crc: long, root: binary>")
        def rebuilt(parts: pa.Array) -> pa.Array:
            counts, chunks = parts.value_lengths().to_numpy(), parts.flatten()
            starts, digests = np.cumsum(counts) - counts, chunks.field("digest").to_pylist()
            crcs = crc32_of_runs(chunks.field("crc").to_numpy(), 4 * chunks.field("n_ids").to_numpy(), starts)
            roots = [merkle_root(digests[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist())]
            return pa.StructArray.from_arrays([pa.array(crcs, pa.int64()), pa.array(roots, pa.binary())], ["crc", "root"])

        pieces = self.recipes.select("doc_id", "part", "ord", "start", "root", F.posexplode("digests").alias("seq", "digest"))
        read = pieces.join(self.checked(), "digest")
        docs = read.groupBy("doc_id", "part", "ord").agg(F.first("start").alias("start"), F.first("root").alias("root"), F.sum("n_ids").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "digest", "n_ids", "crc"))).alias("parts"))
        docs = docs.withColumn("rebuilt", rebuilt("parts"))
        return docs.select("doc_id", "start", "n_tokens", F.col("rebuilt.crc").alias("ids_crc32"), (F.col("rebuilt.root") == F.col("root")).alias("verified"))

    def ids(self) -> DataFrame:
        """Every document's ids as 32-bit little-endian bytes, read from the packs."""
        folder, width, schema = self.folder, self.width, "digest binary, data binary"

        def task(batches):
            out, size = [], 0
            for row, raw in _frames(folder, _rows(batches)):
                out.append((row[0], read_chunk(raw, row[4], row[5], width)))
                size += len(out[-1][1])
                if size > 8 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
            yield _batch(out, schema)

        data = self.chunks.repartition(F.col("pack")).sortWithinPartitions("pack", "frame", "at").mapInArrow(task, schema)
        pieces = self.recipes.select("doc_id", "part", "ord", "start", F.posexplode("digests").alias("seq", "digest")).join(data, "digest")
        whole = pieces.groupBy("doc_id", "part", "ord").agg(F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("parts"))

        @F.arrow_udf("binary")
        def joined(parts: pa.Array) -> pa.Array:
            return pa.array([b"".join([p["data"] for p in row]) for row in (parts[i].as_py() for i in range(len(parts)))], pa.binary())

        return whole.select("doc_id", "start", joined("parts").alias("ids"))


def write_store(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> TokenStore:
    """Encode ``docs`` and write a store below ``folder``.

    Null and empty texts give the end id alone; repeated rows are documents of their own,
    in the order in which they are read; null ids come first; an empty table gives an
    empty store; other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    entries = written(_encoded(docs, folder, tokenizer, id_col, text_col, end_id, width), f"{folder}/entries")
    written(_compacted(entries, folder, width), f"{folder}/chunks")
    kept = {r[0] for r in spark.read.parquet(f"{folder}/chunks").select("pack").distinct().collect()}
    files = Files(f"{folder}/packs")
    for (pack,) in entries.select("pack").distinct().collect():  # one name a task
        if pack not in kept:
            files.remove(pack)
    recipes = _before(_roots(entries), spark, folder)
    recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), "part", "ord").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "part", "ord").write.parquet(f"{folder}/recipes")
    return TokenStore(spark, folder, width)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = write_store(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark, "op9"))
    wrong = F.raise_error(F.lit("a document differs from its Merkle manifest"))
    return store.documents().select("doc_id", "start", "n_tokens", F.when(F.col("verified"), F.col("ids_crc32")).otherwise(wrong).alias("ids_crc32"))


QUERIES = {"op9_token_store": op9_token_store}
ORACLE_SQL: dict[str, str] = {}
