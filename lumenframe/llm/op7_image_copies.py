"""Copies of pictures, cropped or edited, by local descriptors.

Every picture is reduced to a pyramid of scales.  On each level corners are found
(smaller eigenvalue of the local gradient matrix, a local maximum), their direction is
that of the patch's centre of brightness, and a descriptor is 256 comparisons of pairs of
smoothed pixels, the pairs being turned to that direction.  Up to ``most_corners``
corners of each tile of about 64 by 64 pixels, strongest first, describe it, so crops of
large pictures keep enough.

Hamming tables (two orders of the 256 bits, each cut into 16 keys of 16 bits) join the
corners of the query pictures with all pictures', block by block.  Pictures of which
three corners at most 48 bits apart meet are compared whole, and those with as many
mutually nearest corners as the consensus needs (five) are candidates: one similarity
transform (scale, turn, shift) over the matched corners must hold.  Of five corners that
all lie 48 bits apart, the farthest that counts, three meet with probability 0.84; of five 40
bits apart with 0.99, and copies have more.

Equal pictures are merged before anything is described, so a group of copies is one row
with its members' count.  ``find_copies`` gives every link, ``copy_classes`` one row per
picture with its class and number of links.  The installed tables hold no pictures; the
query draws one from each ``embeddings`` row, a sum of fixed noise pictures weighted by
its values, and an edited copy of each query's.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_folder, written
from .near import components

MOST_CORNERS, TILE, RADIUS, LEVELS, STEP = 24, 64, 9, 4, 0.8
BLOCK = 8192
NEAR, LEAST_INLIERS = 48, 5
#: Near corners of a pair that the tables may miss; comparisons held at once.
MISSED, AT_ONCE = 2, 1 << 20
#: Orders in which a descriptor's bits are cut into keys: their own and a random one.
ORDERS = (np.arange(256), np.random.default_rng(16).permutation(256))
FEATURES = "xs: array<float>, ys: array<float>, sizes: array<float>, turns: array<float>, bits: binary"


def _pairs() -> np.ndarray:
    """256 pairs of places in the patch, by a fixed rule: a seeded normal distribution.

    Both places of a pair lie about as far along the patch's direction, in which all patches
    grow brighter; so each test is about as often true as false.
    """
    draws = np.random.default_rng(256).normal(0, RADIUS / 1.8, (40_000, 4))
    draws[:, 2] = draws[:, 0] + draws[:, 2] * 0.15
    far = np.abs(draws[:, 1] - draws[:, 3]) > RADIUS / 3
    inside = (np.hypot(draws[:, 0], draws[:, 1]) < RADIUS - 1) & (np.hypot(draws[:, 2], draws[:, 3]) < RADIUS - 1)
    return draws[inside & far][:256]


PAIRS = _pairs()
_g = np.arange(-RADIUS, RADIUS + 1)
DISC_Y, DISC_X = (a[np.hypot(*np.meshgrid(_g, _g, indexing="ij")) <= RADIUS] for a in np.meshgrid(_g, _g, indexing="ij"))


def decode(data: bytes) -> np.ndarray | None:
    """Brightness of a binary PGM/PPM or an 8-bit, not interlaced PNG; None if it is neither."""
    try:
        if data[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while not data[end : end + 1].isspace():
                    end += 1
                head.append(int(data[at:end]))
                at = end
            w, h, _ = head
            c = 3 if data[:2] == b"P6" else 1
            pixels = np.frombuffer(data, np.uint8, w * h * c, at + 1).reshape(h, w, c)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            at, packed = 8, b""
            while at < len(data):
                size, kind = struct.unpack(">I4s", data[at : at + 8])
                body = data[at + 8 : at + 8 + size]
                if kind == b"IHDR":
                    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
                    if depth != 8 or interlace or colour not in (0, 2, 4, 6):
                        return None
                    c = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
                elif kind == b"IDAT":
                    packed += body
                at += 12 + size
            pixels = _unfiltered(zlib.decompress(packed), w, h, c)
            pixels = pixels[:, :, : c - (c in (2, 4))]
        else:
            return None
        return pixels.astype(np.float32).mean(axis=2) if min(w, h) > 0 else None
    except (ValueError, IndexError, struct.error, zlib.error, UnboundLocalError):
        return None


def _unfiltered(raw: bytes, w: int, h: int, c: int) -> np.ndarray:
    rows, above = np.zeros((h, w * c), np.uint8), np.zeros(w * c, np.int64)
    for y in range(h):
        kind, line = raw[y * (w * c + 1)], np.frombuffer(raw, np.uint8, w * c, y * (w * c + 1) + 1).astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = line.reshape(w, c).cumsum(axis=0).reshape(-1)
        elif kind in (3, 4):
            for i in range(w * c):
                left, up, corner = line[i - c] if i >= c else 0, above[i], above[i - c] if i >= c else 0
                if kind == 3:
                    line[i] = (line[i] + (left + up) // 2) & 255
                else:
                    guess = left + up - corner
                    line[i] = (line[i] + min((left, up, corner), key=lambda v: abs(guess - v))) & 255
        above = line & 255
        rows[y] = above
    return rows.reshape(h, w, c)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1; edges repeat."""
    for axis in (0, 1):
        p = np.pad(a, [(r + 1, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge").cumsum(axis=axis, dtype=np.float64)
        n = a.shape[axis]
        a = (np.take(p, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(p, range(0, n), axis)) / (2 * r + 1)
    return a


def _sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Linear interpolation at places within ``a``."""
    y, x = np.clip(y, 0, a.shape[0] - 1.001), np.clip(x, 0, a.shape[1] - 1.001)
    j, i = y.astype(int), x.astype(int)
    v, u = y - j, x - i
    return (a[j, i] * (1 - u) + a[j, i + 1] * u) * (1 - v) + (a[j + 1, i] * (1 - u) + a[j + 1, i + 1] * u) * v


def describe(picture: np.ndarray | None, most_corners: int = MOST_CORNERS) -> tuple | None:
    """(xs, ys, sizes, turns, bits) in the picture's own pixels; None without corners."""
    found = []
    if picture is None:
        return None
    for level in range(LEVELS):
        factor = STEP**level
        h, w = int(picture.shape[0] * factor), int(picture.shape[1] * factor)
        if min(h, w) < 2 * RADIUS + 4:
            break
        ys, xs = np.meshgrid((np.arange(h) + 0.5) / factor - 0.5, (np.arange(w) + 0.5) / factor - 0.5, indexing="ij")
        a = _box(picture if level == 0 else _sample(picture, ys, xs), 1)
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        b = RADIUS + 1
        inner = strength[b:-b, b:-b]
        if not inner.size:
            continue
        top = inner > 1e-3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = strength[b + dy : strength.shape[0] - b + dy, b + dx : strength.shape[1] - b + dx]
                    top &= inner > other if (dy, dx) > (0, 0) else inner >= other
        y, x = np.nonzero(top)
        found += [(s, level, j + b, i + b) for s, j, i in zip(inner[y, x].tolist(), y.tolist(), x.tolist())]
        if level == 0:
            pyramid = {}
        pyramid[level] = _box(a, 1)
    if not found:
        return None
    tall, wide = (max(1, round(side / TILE)) for side in picture.shape)
    tiles: dict[tuple[int, int], list] = {}
    for f in sorted(found, key=lambda f: (-f[0], f[1:])):
        y, x = ((f[i] + 0.5) / STEP ** f[1] for i in (2, 3))
        tiles.setdefault((int(y * tall / picture.shape[0]), int(x * wide / picture.shape[1])), []).append(f)
    found = [f for tile in tiles.values() for f in tile[:most_corners]]
    out_x, out_y, sizes, turns, bits = [], [], [], [], []
    for _, level, j, i in found:
        a = pyramid[level]
        patch = a[j + DISC_Y, i + DISC_X]
        turn = float(np.arctan2((patch * DISC_Y).sum(), (patch * DISC_X).sum()))
        c, s = np.cos(turn), np.sin(turn)
        px, py = PAIRS[:, 0::2] * c - PAIRS[:, 1::2] * s, PAIRS[:, 0::2] * s + PAIRS[:, 1::2] * c
        v = _sample(a, j + py, i + px)
        bits.append(np.packbits(v[:, 0] < v[:, 1]).tobytes())
        factor = STEP**level
        out_x.append((i + 0.5) / factor - 0.5)
        out_y.append((j + 0.5) / factor - 0.5)
        sizes.append(1 / factor)
        turns.append(turn)
    return out_x, out_y, sizes, turns, b"".join(bits)


def consensus(a: dict, b: dict, near: int = NEAR, within: float = 3.0) -> tuple[int, float, float, float, float]:
    """(inliers, scale, turn, dx, dy) of the best similarity transform from a's to b's corners.

    Each matched pair of corners, with its sizes and turns, proposes one transform.
    """
    x, y = np.frombuffer(a["bits"], np.uint64).reshape(-1, 4), np.frombuffer(b["bits"], np.uint64).reshape(-1, 4)
    apart = np.bitwise_count(x[:, None] ^ y[None]).sum(axis=2, dtype=np.int64)
    mine = apart.argmin(axis=1)
    i = np.flatnonzero((apart[np.arange(len(x)), mine] <= near) & (apart.argmin(axis=0)[mine] == np.arange(len(x))))
    j = mine[i]
    best = (0, 1.0, 0.0, 0.0, 0.0)
    if not len(i):
        return best
    p = np.array(a["xs"])[i] + 1j * np.array(a["ys"])[i]
    q = np.array(b["xs"])[j] + 1j * np.array(b["ys"])[j]
    scale, turn = np.array(b["sizes"])[j] / np.array(a["sizes"])[i], np.array(b["turns"])[j] - np.array(a["turns"])[i]
    proposals = list(scale * np.exp(1j * turn))
    for k in range(len(p)):
        gap = np.abs(p - p[k])
        far = int(gap.argmax())
        if gap[far] > 8:
            proposals.append((q[far] - q[k]) / (p[far] - p[k]))
    anchors = [*range(len(p)), *(k for k in range(len(p)) if np.abs(p - p[k]).max() > 8)]
    for m, k in zip(proposals, anchors):
        if not 0.25 < abs(m) < 4:
            continue
        shift = q[k] - m * p[k]
        n = len(set(np.round(p[np.abs(m * p + shift - q) <= within * max(1.0, abs(m))] / 3).tolist()))
        if n > best[0]:
            best = (n, float(abs(m)), float(np.angle(m)), float(shift.real), float(shift.imag))
    return best


def features(picture: Column, most_corners: int = MOST_CORNERS) -> Column:
    """The descriptors of a binary picture column; null for no picture or no corner."""

    @F.arrow_udf(f"struct<{FEATURES}>")
    def described(data: pa.Array) -> pa.Array:
        names = [c.split(":")[0] for c in FEATURES.split(", ")]
        kind = pa.struct([(n, pa.binary() if n == "bits" else pa.list_(pa.float32())) for n in names])
        rows = (describe(decode(d), most_corners) if d else None for d in data.to_pylist())
        return pa.array([dict(zip(names, r)) if r else None for r in rows], kind)

    return described(picture)


def table_keys(x: np.ndarray) -> np.ndarray:
    """The keys of each descriptor (a row of four uint64) in all Hamming tables: one row a table of 16 bits."""
    plain = np.ascontiguousarray(x).view(np.uint8)
    bits = np.unpackbits(plain, axis=1)
    return np.concatenate([np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(np.uint16) for order in ORDERS], axis=1).T


def met_corners(x: np.ndarray, y: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of descriptors at most ``near`` bits apart that share a key of some table.

    Two descriptors 48 bits apart miss one another in all tables with probability 0.31, 32 bits apart
    0.02; two pictures miss one another only if all their matching corners do.
    """
    keys, found = table_keys(x), []
    for part, own in zip(table_keys(y), keys):
        order = np.argsort(part, kind="stable")
        held = part[order]
        first = np.searchsorted(held, own, "left")
        n = np.searchsorted(held, own, "right") - first
        for at in range(0, len(x), 256):  # a key that many corners have makes no larger arrays
            some = n[at : at + 256]
            i = np.repeat(np.arange(at, at + len(some)), some)
            j = order[np.repeat(first[at : at + 256] - np.cumsum(some) + some, some) + np.arange(some.sum())]
            apart = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int64)
            found.append(i[apart <= near] * len(y) + j[apart <= near])
    return np.divmod(np.unique(np.concatenate(found)), len(y))


def mutual_counts(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, pairs: np.ndarray, near: int) -> np.ndarray:
    """For each pair (row of ``x``'s, row of ``y``'s picture) how many corners are each other's nearest and near enough.

    Picture i has the rows ``at_x[i]`` to ``at_x[i + 1]``.  Many pairs are compared at a time; consensus needs as many matches.
    """
    out = np.zeros(len(pairs), np.int64)
    size_x, size_y = np.diff(at_x)[pairs[:, 0]], np.diff(at_y)[pairs[:, 1]]
    for shape in np.unique(np.stack([size_x, size_y], axis=1), axis=0):
        same = np.flatnonzero((size_x == shape[0]) & (size_y == shape[1]))
        rows, columns = np.arange(shape[0]), np.arange(shape[1])
        step = max(1, AT_ONCE // int(shape[0] * shape[1]))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            left = x[at_x[pairs[some, 0]][:, None] + rows]
            right = y[at_y[pairs[some, 1]][:, None] + columns]
            apart = np.zeros((len(some), shape[0], shape[1]), np.uint16)
            for word in range(4):
                for r in range(0, shape[0], 64):  # large pictures need no larger arrays
                    apart[:, r : r + 64] += np.bitwise_count(left[:, r : r + 64, None, word] ^ right[:, None, :, word])
            mine = apart.argmin(axis=2)
            best = np.take_along_axis(apart, mine[:, :, None], axis=2)[:, :, 0]
            back = np.take_along_axis(apart.argmin(axis=1), mine, axis=1)
            out[some] = ((best <= near) & (back == rows)).sum(axis=1)
    return out


def blocks(described: DataFrame) -> DataFrame:
    """(digests, counts, bits): runs of at most ``BLOCK`` corners, or one picture, from (digest, bits)."""

    def pack(batches):
        for batch in batches:
            digests, counts, bits = [], [], []
            for d, b in [*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), (None, b"")]:
                if digests and (d is None or sum(counts) + len(b) // 32 > BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([digests]), pa.array([counts], pa.list_(pa.int32())), pa.array([b"".join(bits)])], names=["digests", "counts", "bits"])
                    digests, counts, bits = [], [], []
                if d is not None:
                    digests, counts, bits = [*digests, d], [*counts, len(b) // 32], [*bits, b]

    return described.mapInArrow(pack, "digests array<string>, counts array<int>, bits binary")


def shared_corners(queries: DataFrame, classes: DataFrame, least: int, folder: str) -> DataFrame:
    """(q, digest): pairs in which ``least`` corners of q and of digest are each other's nearest and near.

    Blocks of queries meet blocks of pictures, and in each pair of blocks the Hamming tables join
    their corners, so no key is shuffled and none is hot; pairs of pictures of which at least
    ``least - MISSED`` corners meet are compared whole.
    """

    @F.udf("array<struct<q: string, digest: string>>")
    def pairs(q_digests, q_counts, q_bits, digests, counts, bits):
        x, y = np.frombuffer(q_bits, np.uint64).reshape(-1, 4), np.frombuffer(bits, np.uint64).reshape(-1, 4)
        of_x, of_y = np.repeat(np.arange(len(q_counts)), q_counts), np.repeat(np.arange(len(counts)), counts)
        at_x, at_y = np.append(0, np.cumsum(q_counts)), np.append(0, np.cumsum(counts))
        i, j = met_corners(x, y, NEAR)
        corners = np.unique(i * len(counts) + of_y[j])  # a corner of a query and a picture that has one near it
        met, votes = np.unique(of_x[corners // len(counts)] * len(counts) + corners % len(counts), return_counts=True)
        some = np.stack(np.divmod(met[votes >= least - MISSED], len(counts)), axis=1)
        some = some[mutual_counts(x, y, at_x, at_y, some, NEAR) >= least]
        return [(q_digests[q], digests[d]) for q, d in some.tolist() if q_digests[q] != digests[d]]

    tasks = classes.sparkSession.sparkContext.defaultParallelism * 4
    left = written(blocks(queries), f"{folder}/query-blocks").toDF("q_digests", "q_counts", "q_bits")
    right = written(blocks(classes), f"{folder}/blocks").repartition(tasks)
    return right.crossJoin(left).select(F.explode(pairs("q_digests", "q_counts", "q_bits", "digests", "counts", "bits")).alias("p")).select("p.q", "p.digest")


def _searched(pictures: DataFrame, id_col: str, picture_col: str, is_query: Column, most_corners: int, least_inliers: int, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows: id, digest, asks; classes of equal pictures; asked: digest, query_id; links: q, digest, t), all written."""
    rows = pictures.select(F.col(id_col).cast("long").alias("id"), F.col(picture_col).alias("picture"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.withColumn("digest", F.sha2("picture", 256))
    same = rows.filter(F.col("picture").isNotNull()).groupBy("digest").agg(F.min("id").alias("copy_id"), F.count("*").alias("n_equal"), F.max("asks").alias("asks"), F.first("picture").alias("picture"))
    classes = written(same.select("digest", "copy_id", "n_equal", "asks", features(F.col("picture"), most_corners).alias("f")), f"{folder}/classes")
    rows = written(rows.select("id", "digest", "asks"), f"{folder}/rows")
    asked = written(rows.filter(F.col("asks") & F.col("id").isNotNull() & F.col("digest").isNotNull()).select("digest", F.col("id").alias("query_id")).distinct(), f"{folder}/asked")

    bits = classes.filter(F.col("f").isNotNull()).select("digest", F.col("f.bits").alias("bits"), "asks")
    votes = shared_corners(bits.filter("asks").drop("asks"), bits.drop("asks"), least_inliers, folder)
    votes = written(votes, f"{folder}/votes")

    @F.arrow_udf("struct<inliers: int, scale: double, turn: double, dx: double, dy: double>")
    def agreed(a: pa.Array, b: pa.Array) -> pa.Array:
        kind = pa.struct([("inliers", pa.int32()), *((c, pa.float64()) for c in ("scale", "turn", "dx", "dy"))])
        return pa.array([dict(zip(kind.names, consensus(x, y))) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    pairs = votes.join(classes.select(F.col("digest").alias("q"), F.col("f").alias("qf")), "q").join(classes.select("digest", "f"), "digest")
    links = written(pairs.select("q", "digest", agreed("qf", "f").alias("t")).filter(F.col("t.inliers") >= least_inliers), f"{folder}/links")
    return rows, classes.drop("f"), asked, links


def find_copies(pictures: DataFrame, id_col: str, picture_col: str, is_query: Column, most_corners: int = MOST_CORNERS, least_inliers: int = LEAST_INLIERS) -> DataFrame:
    """Copies of the query pictures among all pictures, link by link.

    One row per query id and class of equal pictures that are its copies: query_id, copy_id
    (the class's smallest id), n_equal (its rows), inliers, scale, turn, dx and dy of the
    picture against the query.  A query's own class is a row if it has other members.
    Null pictures and those that can't be read or have no corner only match equal bytes
    (null matches nothing); null ids are counted, but are no query; repeated rows count each; an
    empty table gives no rows; other columns are ignored.
    """
    folder = shared_folder(pictures.sparkSession, "pictures")
    _, classes, asked, links = _searched(pictures, id_col, picture_col, is_query, most_corners, least_inliers, folder)
    other = asked.withColumnRenamed("digest", "q").join(links, "q").join(classes, "digest").select("query_id", "copy_id", "n_equal", "t.*")
    own = asked.join(classes.filter("n_equal > 1"), "digest").select("query_id", "copy_id", "n_equal", F.lit(None).cast("int").alias("inliers"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("turn"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    return other.unionByName(own)


def copy_classes(pictures: DataFrame, id_col: str, picture_col: str, is_query: Column, most_corners: int = MOST_CORNERS, least_inliers: int = LEAST_INLIERS) -> DataFrame:
    """One row per picture: id, class_id, n_links, and its best link.

    ``class_id`` is the smallest id reachable over links between queries and their copies (equal
    pictures are linked), the own one if there is none.  ``n_links`` counts the query ids, other than the own, of
    which the picture is a copy.  query_id, inliers, scale, turn, dx and dy are of the link with the most
    inliers (of equal ones the least query), null without.  So rows grow with the pictures, not with their pairs.
    Odd rows are taken as by ``find_copies``; a null picture is a class of its own.
    """
    folder = shared_folder(pictures.sparkSession, "pictures")
    rows, classes, asked, links = _searched(pictures, id_col, picture_col, is_query, most_corners, least_inliers, folder)
    asking = written(asked.groupBy("digest").agg(F.count("*").alias("n_asking"), F.min("query_id").alias("query_id")), f"{folder}/asking")
    groups = written(components(links.select(F.col("q").alias("a"), F.col("digest").alias("b")), folder), f"{folder}/groups").select(F.col("node").alias("digest"), "root")
    least = groups.join(classes, "digest").groupBy("root").agg(F.min("copy_id").alias("class_id"))
    best = F.max_by(F.struct("query_id", "t.*"), F.struct("t.inliers", -F.col("query_id")))
    linked = links.join(asking.withColumnRenamed("digest", "q"), "q").groupBy("digest").agg(F.sum("n_asking").alias("n"), best.alias("b"))
    of = classes.join(groups.join(least, "root").drop("root"), "digest", "left").join(linked, "digest", "left").join(asking.select("digest", "n_asking"), "digest", "left")
    of = of.select("digest", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_asking", F.lit(0)).alias("n_asking"), "b.*")
    out = rows.join(written(of, f"{folder}/of"), "digest", "left")
    own = (F.col("asks") & F.col("id").isNotNull()).cast("long")
    n_links = F.coalesce(F.col("n") + F.col("n_asking") - own, F.lit(0)).alias("n_links")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), n_links, "query_id", "inliers", "scale", "turn", "dx", "dy")


_noise: dict[tuple[int, int], np.ndarray] = {}


def draw(embedding: Column, side: int = 64) -> Column:
    """A PGM picture of a vector: fixed noise pictures, one a place of the vector, weighted by its values.

    A null vector, or one with a null in it, gives null; NaN and infinity count as 0.
    """

    @F.arrow_udf("binary")
    def drawn(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors.to_pylist():
            if v is None or any(x is None for x in v):
                out.append(None)
                continue
            a = np.nan_to_num(np.array(v, np.float64), posinf=0, neginf=0)
            if (len(a), side) not in _noise:
                _noise[len(a), side] = np.stack([np.zeros((side, side)), *(_box(_box(np.random.default_rng(k).normal(size=(side, side)), 1), 1) for k in range(len(a)))])
            x = np.tensordot(a, _noise[len(a), side][1:], 1)
            pixels = np.clip(np.round(128 + 50 * x / (x.std() or 1.0)), 0, 255).astype(np.uint8)
            out.append(f"P5 {side} {side} 255\n".encode() + pixels.tobytes())
        return pa.array(out, pa.binary())

    return drawn(embedding)


def edited(picture: Column) -> Column:
    """An edited copy of a drawn picture: without an eighth of its rows and columns, brighter and with less contrast."""

    @F.arrow_udf("binary")
    def cut(data: pa.Array) -> pa.Array:
        out = []
        for d in data.to_pylist():
            a = decode(d) if d else None
            if a is not None:
                h, w = a.shape
                a = np.round(a[h // 8 :, w // 8 :] * 0.85 + 10).astype(np.uint8)
            out.append(None if a is None else f"P5 {a.shape[1]} {a.shape[0]} 255\n".encode() + a.tobytes())
        return pa.array(out, pa.binary())

    return cut(picture)


#: Ids from here on are planted copies of the pictures of the ids below.
PLANTED = 1 << 40


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures drawn from ``embeddings``, and for each query (every id divisible by 50) an edited copy that must be found."""
    drawn = read_table(spark, sf_dir, "embeddings").select("vec_id", draw(F.col("embedding")).alias("picture"))
    planted = drawn.filter(F.col("vec_id") % 50 == 0).select((F.col("vec_id") + PLANTED).alias("vec_id"), edited(F.col("picture")).alias("picture"))
    asks = (F.col("vec_id") % 50 == 0) & (F.col("vec_id") < PLANTED)
    found = copy_classes(drawn.unionByName(planted), "vec_id", "picture", asks)
    return found.select(F.col("id").alias("vec_id"), "class_id", "n_links", "query_id", "inliers", *(F.round(c, 3).alias(c) for c in ("scale", "turn", "dx", "dy")))


QUERIES = {"op7_image_copies": op7_image_copies}
ORACLE_SQL: dict[str, str] = {}
