"""Near-duplicate documents by SimHash and vantage-point trees.

A fingerprint's bit is 1 if it is set in over half of the 64-bit hashes of a document's
word shingles.  Equal fingerprints are merged first, so no group of copies is compared.

A vantage-point tree over a bounded sample of fingerprints deals the distinct fingerprints
to shards: at each node a fingerprint goes left if its Hamming distance from the vantage
point is at most the node's bound, and those on the left that are within the radius of
the bound also go right.  Two fingerprints within the radius that a node parts differ by at most
the radius in distance, so the left one is among those that also go right: each such pair
meets in some shard.  Bounds lie well below the middle of the distances, where few
fingerprints cross.

In a shard a second tree over all its fingerprints is searched, pruning branches by the
triangle bound.  A found fingerprint is linked once and not searched for again, so a
group of n gives n - 1 links, not n^2; links of all shards are joined by connected
components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, read_table, removed, shared_folder, text_groups, written
from .near import components

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints a shard, up to half a billion; beyond, shards grow by 8 bytes a fingerprint.
SHARD, MOST_SHARDS, SAMPLE_A_SHARD = 8192, 65_536, 48
BROADCAST_ROWS = 500_000
SAMPLE_DOCS, MOST_COMMON = 20_000, 65_536
SIGNATURE = 512
#: Sets of fewer shingles are met exactly; pairs of others are lost with this probability at most.
SHORT, LOSS, ROWS = 100, 1e-6, 3
LEAF = 48
ALL_BYTES = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int32)


def fingerprint(text: bytes, n: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, the six ASCII blanks only
    if not words:
        return 0
    if len(words) <= n:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        hashes = [xxh64_intdigest(b" ".join(w), seed) for w in zip(*(words[i:] for i in range(n)))]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number of the bits that are set in over half of ``hashes``."""
    data = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(data) < 2000:
        counts = np.unpackbits(data, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    else:
        counts = np.concatenate([np.bincount(data[:, i], minlength=256) @ ALL_BYTES for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other 64-bit hashes from given ones, by seed."""
    x = hashes + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_fingerprints(text: bytes, views: int) -> list[int]:
    """SimHashes of the set of a text's distinct words, which few edits change little."""
    from xxhash import xxh64_intdigest

    words = set(text.lower().split())
    if not words:
        return [0] * views
    hashes = np.array([xxh64_intdigest(w) for w in words], np.uint64)
    return [majority(mixed(hashes, v)) for v in range(views)]


def fingerprints(text: Column, n: int = WORDS, views: int = 1) -> Column:
    """An array of signed fingerprints: of ``n``-word shingles, or with n = 0 ``views`` of the word set."""

    @F.arrow_udf("array<long>")
    def hashed(texts: pa.Array) -> pa.Array:
        out = [word_fingerprints(t, views) if n == 0 else [fingerprint(t, n)] for _, group in text_groups(texts) for t in group]
        return pa.array(list(np.array(out, np.uint64).astype(np.int64)) if out else [], pa.list_(pa.int64()))

    return hashed(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


class VantageTree:
    """A tree over ``points`` (uint64) with leaves of at most ``leaf`` where bounds allow it.

    ``bound_share`` is the share of points that a bound leaves on the left.
    """

    def __init__(self, points: np.ndarray, leaf: int, radius: int, bound_share: float, overlap: bool = False, most_depth: int = 40):
        self.radius, self.leaves = radius, []
        self.root = self._make(points, np.arange(len(points)), leaf, bound_share, overlap, most_depth)

    def _make(self, points, index, leaf, share, overlap, depth):
        if len(index) > leaf and depth:
            vantage = points[index[len(index) // 2]]
            away = np.bitwise_count(points[index] ^ vantage).astype(np.int64)
            bound = int(np.sort(away)[min(int(len(away) * share), len(away) - 1)])
            left = away <= bound
            if 0 < left.sum() < len(index):
                return (vantage, bound, self._make(points, index[left], leaf, share, overlap, depth - 1), self._make(points, index[~left], leaf, share, overlap, depth - 1))
        self.leaves.append(index)
        return len(self.leaves) - 1

    def deal(self, points: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, positions in ``points``) with the one-sided overlap."""
        out, stack = [], [(self.root, np.arange(len(points)))]
        while stack:
            node, index = stack.pop()
            if not len(index):
                continue
            if isinstance(node, int):
                out.append((node, index))
                continue
            vantage, bound, left, right = node
            away = np.bitwise_count(points[index] ^ vantage).astype(np.int64)
            stack += [(left, index[away <= bound]), (right, index[away > bound - self.radius])]
        return out

    def counts(self, points: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """How many points lie within the radius of each query; pairs are counted, never listed."""
        out, stack = np.zeros(len(queries), np.int64), [(self.root, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            if not len(asked):
                continue
            if isinstance(node, int):
                held = points[self.leaves[node]]
                for at in range(0, len(asked), 4096):
                    some = asked[at : at + 4096]
                    for b in range(0, len(held), 4096):  # a leaf that no bound divides
                        out[some] += (np.bitwise_count(queries[some, None] ^ held[None, b : b + 4096]) <= self.radius).sum(axis=1)
                continue
            vantage, bound, left, right = node
            away = np.bitwise_count(queries[asked] ^ vantage).astype(np.int64)
            stack += [(left, asked[away <= bound + self.radius]), (right, asked[away > bound - self.radius])]
        return out

    def near(self, points: np.ndarray, queries: np.ndarray, open_: np.ndarray):
        """(query position, point position) for open points within the radius of each query."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            if not len(asked):
                continue
            if isinstance(node, int):
                index = self.leaves[node]
                index = index[open_[index]]
                if len(index):
                    for at in range(0, len(asked), 4096):
                        some = asked[at : at + 4096]
                        q, p = np.nonzero(np.bitwise_count(queries[some, None] ^ points[None, index]) <= self.radius)
                        yield some[q], index[p]
                continue
            vantage, bound, left, right = node
            away = np.bitwise_count(queries[asked] ^ vantage).astype(np.int64)
            stack += [(left, asked[away <= bound + self.radius]), (right, asked[away > bound - self.radius])]


def shard_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(position, position of a neighbour) that join all points which have neighbours.

    First one search for all points counts everyone's neighbours.  Then groups are grown
    from the points with the most, each found point being linked to the one that found it
    and taken out of the search, so n points give at most n - 1 links.
    """
    tree = VantageTree(points, LEAF, radius, 0.5)
    degree = tree.counts(points, points)
    some = np.flatnonzero(degree > 1)  # everyone finds itself
    points, degree = points[some], degree[some]
    tree = VantageTree(points, LEAF, radius, 0.5)
    open_, out = np.ones(len(points), bool), []
    for root in np.argsort(-degree, kind="stable").tolist():
        if not open_[root]:
            continue
        open_[root] = False
        edge = np.array([root])
        while len(edge):
            found = list(tree.near(points, points[edge], open_))
            if not found:
                break
            by, p = np.concatenate([edge[q] for q, _ in found]), np.concatenate([p for _, p in found])
            order = np.lexsort((-degree[by], p))
            edge, first = np.unique(p[order], return_index=True)
            open_[edge] = False
            out += zip(some[edge].tolist(), some[by[order][first]].tolist())
    return out


def fingerprint_links(prints: DataFrame, folder: str, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b) links that join all fingerprints within ``radius``, for distinct ``fp`` (long)."""
    return links_by_view(prints.select(F.lit(0).alias("view"), "fp"), 1, folder, radius, shard).select("a", "b")


def links_by_view(prints: DataFrame, views: int, folder: str, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(view, a, b), such links within each ``view`` (int from 0), for distinct (view, fp); every view has a tree of its own."""
    sizes = {r["view"]: r["count"] for r in prints.groupBy("view").count().collect()}
    shards = [min(MOST_SHARDS // views, sizes.get(v, 0) // shard + 1) for v in range(views)]
    points = [np.zeros(0, np.uint64)] * views
    if max(shards) > 1:
        shares = [min(1.0, n * SAMPLE_A_SHARD / max(1, sizes.get(v, 0))) for v, n in enumerate(shards)]
        share = F.array(*(F.lit(int(x * (1 << 30))) for x in shares))[F.col("view")]
        sample = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share).limit(2 * MOST_SHARDS * SAMPLE_A_SHARD)
        sample = sample.select("view", "fp").toArrow()
        of, fps = sample.column(0).to_numpy(), sample.column(1).to_numpy()
        points = [np.sort(fps[of == v]).astype(np.uint64) for v in range(views)]
    trees = [VantageTree(p, max(1, len(p) // n) if n > 1 else max(1, len(p)), radius, 0.2) for p, n in zip(points, shards)]
    sent = prints.sparkSession.sparkContext.broadcast(trees)

    def deal(batches):
        for batch in batches:
            view, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for v in np.unique(view).tolist():
                own = fp[view == v]
                for leaf, index in sent.value[v].deal(own.astype(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), v), pa.int32()), pa.array(np.full(len(index), leaf), pa.int32()), pa.array(own[index])], names=["view", "shard", "fp"])

    def join(table):
        fp = np.sort(table.column("fp").to_numpy().astype(np.int64))
        found = np.array(shard_links(fp.astype(np.uint64), radius), np.int64).reshape(-1, 2)
        return pa.table({"view": pa.array(np.full(len(found), table.column("view")[0].as_py()), pa.int32()), "a": fp[found[:, 0]], "b": fp[found[:, 1]]})

    dealt = prints.select("view", "fp").mapInArrow(deal, "view int, shard int, fp long")
    return written(dealt.groupBy("view", "shard").applyInArrow(join, "view int, a long, b long"), f"{folder}/links-{radius}")


def classes(docs: DataFrame, prints: DataFrame, folder: str, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, fp) with component_id, the smallest doc_id reachable over links."""
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/first")
    groups = written(components(fingerprint_links(first, folder, radius), folder), f"{folder}/groups")
    of_root = groups.join(first, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("component_id"))
    grouped = groups.join(of_root, "root").select(F.col("node").alias("fp"), "component_id")
    by_print = first.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(by_print, "fp")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other; a null id is
    no component's id unless all ids of a component are null; repeated rows give a row
    each; an empty table gives none; other columns are ignored.
    """
    folder = shared_folder(docs.sparkSession, "simhash")
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col), n)[0].alias("fp"))
    out = classes(docs, written(prints, f"{folder}/prints"), folder, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def jaccard(a: bytes, b: bytes, n: int) -> float:
    """Jaccard similarity of the sets of n-word shingles (fewer words: of the whole sequences)."""

    def shingles(text):
        words = text.lower().split()
        return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def _matched(left: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join that broadcasts ``small`` (written, with two hashes and an id a row) only if it has few rows."""
    return left.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's n-word shingles (fewer words: of the whole sequence), ascending."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    hashes = np.array([xxh64_intdigest(w) for w in words], np.uint64)
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out ^ hashes[i : i + len(out)], i)
    return np.unique(out)


def ordered(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``hashes`` in one order of all shingles: by their count among the ``common`` ones (others: 0), then by hash."""
    if not len(common):
        return np.sort(hashes)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))]


def prefix_size(n: int, similarity: float) -> int:
    """So many of n shingles, the first in one order, that two sets of at least the similarity share one.

    Such sets share at least ``similarity`` of each, so each has one of the shared among
    all but that share of its own, plus one; the first of the shared in the order is in both.
    """
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def bands(similarity: float) -> int:
    """So many keys of ``ROWS`` smallest hashes that sets of the similarity share none with probability ``LOSS`` at most."""
    return int(np.ceil(np.log(LOSS) / np.log1p(-min(similarity, 1 - 1e-9) ** ROWS)))


def smallest(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` keys, each of the smallest of ``hashes`` in ``ROWS`` random orders."""
    draws = np.random.default_rng(8).integers(0, 1 << 63, (2, n * ROWS), np.int64).astype(np.uint64)
    least = np.full(n * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, at : at + 4096] ^ draws[0, :, None]) * (draws[1, :, None] | np.uint64(1))).min(axis=1))
    out = np.arange(n, dtype=np.uint64)
    for row in least.reshape(n, ROWS).T:
        out = mixed(out ^ row, 5)
    return out


def meeting_keys(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """(keys at which a set meets others, how many of them are its prefix).

    Two similar sets, of which one has fewer than ``SHORT`` shingles, both have fewer than ``SHORT`` over the
    similarity, and share a shingle of their prefixes; others share a key of smallest hashes but for ``LOSS``.
    """
    keys, lead = [], 0
    if similarity * len(hashes) < SHORT:
        keys.append(ordered(hashes, common, counts)[: prefix_size(len(hashes), similarity)])
        lead = len(keys[0])
    if len(hashes) >= SHORT:
        keys.append(smallest(hashes, bands(similarity)))
    return np.concatenate(keys), lead


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parities of ``hashes`` by their lowest bits: two sets differ in at least as many shingles as signatures in bits."""
    odd = np.bincount((hashes % np.uint64(SIGNATURE)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def may_be_similar(similarity: float) -> Column:
    """Whether sets that share a shingle, at ``pos`` and ``pos_b`` in the order, can be similar enough.

    False only for pairs that aren't, or whose first shared shingle is another one.
    """
    sizes = F.col("size") + F.col("size_b")
    shared = F.lit(similarity / (1 + similarity)) * sizes - 1e-6
    apart = sum((F.bit_count(F.col("sig")[i].bitwiseXOR(F.col("sig_b")[i])) for i in range(SIGNATURE // 64)), F.lit(0))
    fits = F.least("size", "size_b") >= F.lit(similarity) * F.greatest("size", "size_b") - 1e-6
    return fits & (F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b")) >= shared) & (apart <= sizes - 2 * shared)


def common_shingles(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that many documents of a bounded sample hold; they only order the shingles."""

    @F.arrow_udf("array<long>")
    def all_of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t, n).astype(np.int64) for _, group in text_groups(texts) for t in group], pa.list_(pa.int64()))

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    held = some.select(F.explode(all_of(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))).alias("shingle")).groupBy("shingle").count()
    top = held.filter("count > 3").orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).collect()
    hashes, counts = np.array([r.shingle for r in top], np.int64).astype(np.uint64), np.array([r["count"] for r in top], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def view_links(sets: DataFrame, views: int, folder: str, radius: int = RADIUS) -> DataFrame:
    """(a, b) nodes of ``sets`` (node, fps) that join all of which a fingerprint of some view is within ``radius``."""
    prints = sets.select("node", F.posexplode("fps").alias("view", "fp"))
    first = written(prints.groupBy("view", "fp").agg(F.min("node").alias("first"), F.count("*").alias("c")), f"{folder}/first")
    same = _matched(prints, first.filter("c > 1").drop("c"), ["view", "fp"], "inner").filter(F.col("node") != F.col("first"))
    between = links_by_view(first.select("view", "fp"), views, folder, radius)
    for end in ("a", "b"):
        between = between.join(first.select("view", F.col("fp").alias(end), F.col("first").alias(f"node_{end}")), ["view", end])
    links = same.select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(between.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")))
    return written(links.distinct(), f"{folder}/links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, views: int = 6, radius: int = RADIUS) -> DataFrame:
    """``docs`` without near copies: of each group one document stays, that with the smallest id.

    Two documents are linked if the sets of n-word shingles of their whole texts have at
    least the similarity; groups are the connected components of all such links.

    Vantage-point trees meet the SimHashes of the texts, that of ``fingerprint`` and those of ``views`` of the
    set of distinct words, which few edits change little; whole texts decide on each link (see ``view_links``).

    SimHashes miss similar texts (passages added or cut), and a link that fails hides those behind it, so pairs not
    in one group by then are met again: sets that share one of a few keys (see ``meeting_keys``) are candidates; a
    similar pair of long texts is no candidate with probability ``LOSS`` at most, of short ones never.  Equal sets are
    one set.  Sizes, places in the order and signatures rule out most that aren't similar (see
    ``may_be_similar``) before any text is fetched.  First each holder of a shingle is checked against one of up to eight
    hubs of it, which joins groups of many copies by few checks.  Then every pair of
    holders that is not in one group by then is checked, so a failed check closes no other.

    Equal texts are one document (null and empty are equal), null ids come last; rows
    equal in id and text stay or go together; other columns are kept as they are; an
    empty table stays empty.
    """
    folder = shared_folder(docs.sparkSession, "neardup")
    last = (1 << 63) - 1
    h1, h2, ident, least, gone = (fresh_name(docs, f"__lf_{c}") for c in ("h1", "h2", "id", "least", "gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {h1: F.xxhash64(text), h2: F.xxhash64(F.lit("text"), text)}
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, id_col, text_col, n))

    @F.arrow_udf("struct<s1: long, s2: long, size: int, lead: int, start: array<long>, sig: array<long>, fps: array<long>>")
    def sketched(texts: pa.Array) -> pa.Array:
        from xxhash import xxh3_128_digest

        whole, sizes, leads, starts, signatures, prints = [], [], [], [], [], []
        for _, group in text_groups(texts):
            for t in group:
                hashes = shingle_hashes(t, n)
                whole.append(xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                start, lead = meeting_keys(hashes, *common.value, similarity)
                starts.append(start.astype(np.int64))
                leads.append(lead)
                signatures.append(signature(hashes))
                prints.append(np.array([fingerprint(t), *word_fingerprints(t, views)], np.uint64).astype(np.int64))
        halves = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int32()), pa.array(leads, pa.int32()), pa.array(starts, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.int64()))], names=["s1", "s2", "size", "lead", "start", "sig", "fps"])

    seen = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), *(c.alias(k) for k, c in keys.items()), sketched(F.encode(text, "UTF-8")).alias("s"))
    texts = seen.groupBy(h1, h2).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.first("s").alias("s"))
    texts = written(texts.select(h1, h2, "least", "most", "s.*", F.struct(h1, h2).alias("node")), f"{folder}/sketches")
    sets = texts.groupBy("s1", "s2").agg(F.min("node").alias("node"), F.min_by(F.struct("size", "lead", "start", "sig", "fps"), "node").alias("s"))
    sets = written(sets.select("s1", "s2", "node", "s.*"), f"{folder}/sets")
    texts = written(texts.select(h1, h2, "least", "most", "s1", "s2", "node"), f"{folder}/texts")
    removed(docs.sparkSession, f"{folder}/sketches")
    same = texts.select("s1", "s2", F.col("node").alias("a")).join(sets.select("s1", "s2", F.col("node").alias("b")), ["s1", "s2"]).filter(F.col("a") != F.col("b")).select("a", "b")

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([jaccard(x, y, n) >= similarity for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(last))

    def checked(links: DataFrame, step: str) -> DataFrame:
        """Those of ``links`` (a, b; written) whose whole texts are similar."""
        linked = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
        linked = written(linked.join(texts, "node").select(h1, h2, F.col("least").alias(ident)), f"{folder}/linked-{step}")
        bodies = _matched(docs.select(own_id.alias(ident), *(c.alias(k) for k, c in keys.items()), F.encode(text, "UTF-8").alias("body")), linked, [h1, h2, ident], "left_semi")
        bodies = written(bodies.select(F.struct(h1, h2).alias("node"), "body"), f"{folder}/bodies-{step}").dropDuplicates(["node"])
        pairs = links.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
        out = written(pairs.filter(similar("x", "y")).select("a", "b"), f"{folder}/true-{step}")
        removed(docs.sparkSession, f"{folder}/bodies-{step}")
        return out

    met = view_links(sets, views + 1, f"{folder}/prints", radius)
    own = sets.select("node", "size", F.lit(0).alias("pos"), "sig")
    met = met.join(own.withColumnsRenamed({"node": "a"}), "a").join(own.withColumnsRenamed({c: "b" if c == "node" else f"{c}_b" for c in own.columns}), "b")
    met = written(same.unionByName(met.filter(may_be_similar(similarity)).select("a", "b")).distinct(), f"{folder}/links-prints")
    true = checked(met, "prints")
    groups = written(components(true, f"{folder}/prints-groups"), f"{folder}/groups-prints")

    traits = ("node", "size", "pos", "sig", "root")
    held = sets.select("node", "size", "sig", "lead", F.posexplode("start").alias("at", "shingle"))
    held = held.select("shingle", "node", "size", "sig", F.when(F.col("at") < F.col("lead"), F.col("at")).otherwise(0).alias("pos"))
    often = written(held.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1").select("shingle"), f"{folder}/often")
    held = held.join(often, "shingle").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = written(held.select("shingle", *traits), f"{folder}/held")
    hubs = held.groupBy("shingle").agg(F.min_by(F.struct(*traits), F.xxhash64("node", F.col("shingle").bitwiseAND(7))).alias("hub"))
    hubs = written(hubs.select("shingle", *(F.col("hub")[c].alias(f"{c}_b") for c in traits)), f"{folder}/hubs")
    star = held.join(hubs, "shingle").filter((F.col("root") != F.col("root_b")) & may_be_similar(similarity)).select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b"))
    star = written(star.distinct().join(met, ["a", "b"], "left_anti"), f"{folder}/links-hubs")
    true = true.unionByName(checked(star, "hubs"))
    groups = written(components(true, f"{folder}/hubs-groups"), f"{folder}/groups-hubs")

    placed = held.drop("root").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed.select("shingle", *traits), f"{folder}/placed")
    removed(docs.sparkSession, f"{folder}/held")
    apart = placed.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("shingle")
    apart = written(apart, f"{folder}/apart")
    left = written(placed.join(apart, "shingle"), f"{folder}/left")
    removed(docs.sparkSession, f"{folder}/placed")
    right = left.select("shingle", *(F.col(c).alias(f"{c}_b") for c in traits))
    rest = left.join(right, "shingle").filter((F.col("node") > F.col("node_b")) & (F.col("root") != F.col("root_b")) & may_be_similar(similarity))
    rest = written(rest.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct().join(met.unionByName(star), ["a", "b"], "left_anti"), f"{folder}/links-rest")
    true = true.unionByName(checked(rest, "rest"))

    groups = written(components(true, folder), f"{folder}/groups").join(texts.select("node", "least"), "node")
    stays = groups.groupBy("root").agg(F.min(F.struct("least", "node")).alias("stays"))
    losers = groups.join(stays, "root").filter(F.col("node") != F.col("stays.node")).select("node", F.lit(True).alias("gone"))
    told = texts.join(losers, "node", "left").filter(F.col("gone") | (F.col("least") != F.col("most")))
    told = written(told.select(h1, h2, F.col("least").alias(least), F.coalesce("gone", F.lit(False)).alias(gone)), f"{folder}/told")
    out = _matched(docs.withColumns(keys), told, [h1, h2], "left")
    return out.filter(F.col(gone).isNull() | (~F.col(gone) & (own_id == F.col(least)))).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
