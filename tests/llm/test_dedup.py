import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import op2_warc as op2
from lumenframe.llm import op3_quality_rules as op3
from lumenframe.llm import op5_line_dedup as op5
from lumenframe.llm import op6_mixing as op6
from lumenframe.llm import op7_image_copies as op7
from lumenframe.llm import op8_simhash as op8
from lumenframe.llm import op10_sentence_spans as op10
from lumenframe.llm import queries
from lumenframe.llm.common import shared_folder
from lumenframe.llm.near import components
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
LONG = "Passages that many documents share run over lines.\n" * 3
ROWS = [
    (1, LONG + "own line of the first document here", "a"), (2, LONG, "a"), (3, LONG.upper() + " x", None), (4, None, "b"), (5, "", "b"),
    (5, "", "b"), (None, LONG + "no id", "b"), (None, None, None), (6, "word " * 30_000, "c"), (7, "\n\n \n", "c"), (2, "same id other text\n" + LONG, "d"),
    (8, "é ü 日本 \x1c\x85 ' \" \\ | # $", "é"), (9, "A b.\nA b.\nA b.\nA b.", "a"), (9, "A b.\nA b.\nA b.\nA b.", "a"),
]


def odd(spark, rows=ROWS):
    """Nulls, empties, repeats, a long text, and columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(7) for c in ("lang", "n_chars", "stats", "__lf_gone", "N_LINES", "key", "fp", "mark", "size")}).repartition(3)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF) is None


def lines_by_hand(rows):
    docs, key = {(d, t or "") for d, t, _ in rows}, lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(op5.UPPER, op5.LOWER))
    holders = {}
    for d, t in docs:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add((-(1 << 63) if d is None else d, t))
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        own = -(1 << 63) if d is None else d
        keep = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(h[0] for h in holders[key(x)]) == own]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def test_lines(spark):
    got = op5.dedup_lines(odd(spark), batches=3, fanout=2)
    assert got.columns[:12] == odd(spark).columns and got.columns[-2:] == ["n_lines_", "n_dropped"]
    assert sorted(((r.doc_id, r.text or "", r.n_lines_, r.n_dropped) for r in got.collect()), key=repr) == lines_by_hand(ROWS)
    assert op5.dedup_lines(odd(spark, [])).collect() == []


def test_line_runs_are_disjoint_and_levelled(spark):
    runs, r = op5.LineRuns(spark, shared_folder(spark, "runs"), fanout=2, buckets=2), random.Random(2)
    want = {}
    for _ in range(5):
        batch = {f"k{r.randint(0, 60)}": (r.randint(1, 2), r.randint(0, 99)) for _ in range(40)}
        runs.add(spark.createDataFrame([(k, *v) for k, v in batch.items()], "key string, n long, last long"))
        for k, (n, last) in batch.items():
            want[k] = (want.get(k, (0, 0))[0] + n, max(want.get(k, (0, 0))[1], last))
        if r.random() < 0.5:
            runs = op5.LineRuns.reopen(spark, runs.folder, fanout=2)
    assert max(map(len, runs.levels)) < 2 and len(runs.levels) > 1
    for name in [n for level in runs.levels for n in level]:  # as in another session
        spark.sql(f"DROP TABLE {name}")
    runs = op5.LineRuns.reopen(spark, runs.folder, fanout=2)
    assert not runs.spark.sparkContext._jvm.java.io.File(runs.folder.removeprefix("file:")).list() is None
    keys = [row.key for run in runs.runs() for row in run.collect()]
    assert len(keys) == len(set(keys))
    assert {(x.key, x.n, x["last"]) for x in runs.totals(4).collect()} == {(k, *v) for k, v in want.items() if v[0] >= 4}
    runs.drop()


def test_mix_meets_targets_and_repeats(spark):
    r = random.Random(5)
    rows = [(i, "w " * min(2000, int(r.expovariate(0.01)) + 1), r.choice(["a"] * 6 + ["b", "c", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, thresholds, n = op6.plan(docs, "doc_id", "text", "source")
    got = op6.copies_of(sizes, thresholds, n).collect()
    again = op6.copies_of(*op6.plan(docs.repartition(5), "doc_id", "text", "source")).collect()
    assert {(x.doc_id, x.copies) for x in got} == {(x.doc_id, x.copies) for x in again}
    for t in thresholds.collect():
        own = [x for x in got if x.source == t.source]
        taken = sum(x.copies * x["size"] for x in own)
        assert abs(taken - t.target) <= max(x["size"] for x in own)
        assert {x.copies for x in own} <= {int(t.target // t.source_size), int(t.target // t.source_size) + 1}
    assert abs(sum(t.target for t in thresholds.collect()) - sum(x["size"] for x in got)) < 1e-3
    weighted = docs.withColumn("weight", (F.col("doc_id") % 3).cast("double"))
    taken = op6.mix(weighted, weight_col="weight")
    assert taken.columns == weighted.columns and taken.filter("weight = 0 and source = 'a'").count() == 0
    assert taken.filter("weight = 2 and source = 'a'").count() > 1.4 * taken.filter("weight = 1 and source = 'a'").count()


def test_mix_of_odd_rows(spark):
    assert op6.mix(odd(spark)).columns == odd(spark).columns
    assert op6.mix(odd(spark, [])).collect() == []


def test_archive(spark):
    page = "<p>" + "x" * 1500 + "é</p>"
    rows = [(1, "u", page), (2, "v\r\nw", page), (3, None, "s"), (4, "u", "s"), (5, "u", None), (None, "n", page), (2, "z", page), (7, "u", "WARC/1.1\r\n\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    archive = op2.write_archive(pages, shared_folder(spark, "t2"), frame_bytes=2000, bundle_bytes=3000)
    got = archive.records(payloads=True).collect()
    assert sorted((str(x.page_id), x.record_type, x.refers_to) for x in got) == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("None", "revisit", 2), ("7", "response", None)], key=lambda x: (x[0], x[1], x[2] or 0))
    assert {x.payload_bytes for x in got if x.page_id in (1, 2)} == {len(page.encode())}
    assert bytes(next(x.payload for x in got if x.page_id == 7)) == b"WARC/1.1\r\n\r\n" * 200
    at = archive.fetch(archive.index.filter("page_id = 7")).collect()
    head, http, payload, _, _ = next(op2.parse_records(bytes(at[0].record)))
    assert len(at) == 1 and head["WARC-Record-ID"] == "<urn:page:7>" and len(payload) == 2400
    assert op2.write_archive(pages.limit(0), shared_folder(spark, "t2")).records().collect() == []


def stats_by_hand(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_statistics_by_hand():
    r = random.Random(0)
    for _ in range(200):
        text = "".join(r.choices(["a", "b", " ", " ", "\n", "é", "#", "|", "\t", "日", "\x85", "c d e", "!"], k=r.randint(0, 80)))
        assert op3.statistics(text.encode())[:5] == stats_by_hand(text), repr(text)


def test_rules_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = op3.fit(docs, labels.filter("doc_id % 2 = 0"))
    seen = op3.judge(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT stats.base_failed").collect()
    right = [(x.stats.kept, x.quality) for x in seen]
    assert sum(k == bool(q) for k, q in right) / len(right) > 0.97
    assert op3.learn({"a": np.arange(10.0)}, np.zeros(10, bool)) == []


def test_rules_cover_odd_rows(spark):
    rule = [(op3.Test("symbols_a_word", True, 0.5),)]
    got = op3.judge(odd(spark), rule)
    assert got.columns == [*odd(spark).columns, "stats_"] and got.filter("stats_.base_failed AND stats_.kept").count() == 0
    assert op3.judge(odd(spark, []), []).collect() == []


def print_by_hand(text, n=3):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans(op5.UPPER, op5.LOWER)))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([words] if len(words) < n else [words[i : i + n] for i in range(len(words) - n + 1)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_links(nodes, linked):
    root = {a: a for a in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {a: find(a) for a in nodes}


def test_simhash_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {d: print_by_hand(t) for d, t in rows}
    ids = sorted(prints)
    want = by_links(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = op8.op8_simhash(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{prints[d]:016x}", want[d]) for d in ids}


def test_simhash_of_odd_rows(spark):
    got = op8.simhash_classes(odd(spark)).collect()
    assert len(got) == len(ROWS)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {4}
    assert op8.simhash_classes(odd(spark, [])).collect() == []


@pytest.mark.parametrize("shard", [200, 100_000])
def test_tree_shards_lose_no_pair(spark, shard):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 600, dtype=np.uint64)
    near = base[r.integers(0, 600, 1500)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << r.integers(0, 64, 1500).astype(np.uint64))
    chain = np.array([(1 << k) - 1 for k in range(0, 64, 3)], np.uint64)
    points = np.unique(np.concatenate([base, near, near[:300] ^ np.uint64(5), chain]))
    pairs = [(int(a), int(points[j])) for i, a in enumerate(points) for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ a) <= 3) + i + 1]
    want = by_links(points.tolist(), pairs)
    df = spark.createDataFrame([(int(p),) for p in points.astype(np.int64)], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in op8.fingerprint_links(df, shared_folder(spark, "t8"), shard=shard).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert by_links(points.tolist(), links) == want
    at = {p: i for i, p in enumerate(points.tolist())}
    roots = {r.node: r.root for r in components(spark.createDataFrame([(at[a], at[b]) for a, b in links], "a long, b long"), shared_folder(spark, "t8")).collect()}
    assert all(roots.get(i, i) == at[want[p]] for p, i in at.items())


def test_near_dedup_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text.lower().split()) for r in docs.collect()]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in rows}
    holders, linked = {}, set()
    for d, s in sets.items():
        for x in s:
            for e in holders.setdefault(x, []):
                if (e, d) not in linked and len(s & sets[e]) >= 0.8 * len(s | sets[e]):
                    linked.add((e, d))
            holders[x].append(d)
    want = by_links(sorted(sets), linked)
    stay = {r.doc_id for r in op8.near_dedup(docs).collect()}
    goes = {d for d, root in want.items() if d != root}
    assert not {d for d, root in want.items() if d == root} - stay
    assert len(goes - stay) >= 0.97 * len(goes)


def test_near_dedup_finds_links_beside_failed_ones(spark):
    import itertools

    r = random.Random(3)
    rows = []
    for g in range(20):  # same words, so equal fingerprints of word sets; the first document's order is its own
        words = [f"w{g}x{k}" for k in range(120)]
        other = r.sample(words, len(words))
        rows += [(100 * g, " ".join(other)), (100 * g + 1, " ".join(words)), (100 * g + 2, " ".join(words[:60] + [words[61], words[60]] + words[62:]))]
    sim = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if op8.jaccard(a[1].encode(), b[1].encode(), 5) >= 0.8}
    assert sim == {(100 * g + 1, 100 * g + 2) for g in range(20)}
    got = {x.doc_id for x in op8.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d for d, _ in rows if d % 100 != 2}


def test_near_dedup_finds_longer_and_cut_copies(spark):
    r = random.Random(7)
    rows, pairs = [], 0
    for i in range(150):
        words = [f"v{r.randint(0, 5000)}" for _ in range(r.randint(60, 600))]
        k = len(words) * r.choice([10, 15, 18]) // 100
        copy = words + [f"v{r.randint(0, 5000)}" for _ in range(k)] if i % 2 else words[: len(words) - k]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        pairs += op8.jaccard(rows[-2][1].encode(), rows[-1][1].encode(), 5) >= 0.8
    got = {x.doc_id for x in op8.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert pairs > 120 and len(got) == len(rows) - pairs and got >= {d for d, _ in rows if d % 2 == 0}


def test_near_dedup_meets_by_simhash_and_trees(spark, monkeypatch):
    met, dealt = [], []
    view_links, links_by_view = op8.view_links, op8.links_by_view

    def meeting(sets, *rest):
        met.append((sets, view_links(sets, *rest)))
        return met[-1][1]

    def searched(prints, *rest):
        dealt.extend((r["view"], r.fp % (1 << 64)) for r in prints.collect())
        return links_by_view(prints, *rest)

    monkeypatch.setattr(op8, "view_links", meeting)
    monkeypatch.setattr(op8, "links_by_view", searched)
    r = random.Random(5)
    texts = [" ".join(f"u{r.randint(0, 900)}" for _ in range(r.randint(50, 300))) for _ in range(60)]
    for t in texts[:40]:
        words = t.split()
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stay = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    (sets, links), prints = met[0], [[print_by_hand(t), *op8.word_fingerprints(t.encode(), 6)] for t in texts]
    assert sorted(dealt) == sorted({(v, p) for x in prints for v, p in enumerate(x)})
    fps = {x.node: [f % (1 << 64) for f in x.fps] for x in sets.collect()}
    nodes = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if any((x ^ y).bit_count() <= 3 for x, y in zip(fps[a], fps[b]))]
    got = [(x.a, x.b) for x in links.collect()]
    assert len(pairs) > 20 and {tuple(sorted(x)) for x in got} <= set(pairs)
    assert by_links(nodes, got) == by_links(nodes, pairs)
    similar = [(i, 60 + i) for i in range(40) if op8.jaccard(texts[i].encode(), texts[60 + i].encode(), 5) >= 0.8]
    assert stay == set(range(100)) - {b for _, b in similar}


def test_near_dedup_of_odd_rows(spark):
    got = op8.near_dedup(odd(spark))
    assert got.columns == odd(spark).columns
    assert {r.doc_id for r in got.collect() if not r.text} == {4}
    assert op8.near_dedup(odd(spark, [])).collect() == []


def test_spans_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    seen, want = set(), {}
    for d, t in rows:
        found = op10.sentences(t.encode())
        gone = set()
        for i in range(len(found)):
            j, words = i, []
            while j < len(found) and (j - i < 2 or len(words) < 20):
                words += found[j][2]
                j += 1
            if j - i >= 2 and len(words) >= 20:
                s = b" ".join(words)
                gone |= set(range(i, j)) if s in seen else set()
                seen.add(s)
        want[d] = (len(found), len(gone))
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in op10.op10_sentence_spans(spark, SF).collect()}
    assert got == want
    texts = {r.doc_id: r.text for r in op10.dedup_spans(docs).collect()}
    assert all(len(op10.sentences(texts[d].encode())) <= n - g for d, (n, g) in want.items())


def test_spans_catch_planted_passages(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + ". "
    passage = "".join(sentence(9) for _ in range(7))
    rows = [(i, "".join(sentence(8) for _ in range(5)) + word() + " " + (passage if i % 3 == 0 else "") + "".join(sentence(8) for _ in range(5))) for i in range(30)]
    got = {x.doc_id: x for x in op10.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[i].n_removed >= 5) == (i % 3 == 0 and i > 0) and got[i].n_removed <= 8 for i in got)
    kept = {x.doc_id: x.text for x in op10.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[0] == rows[0][1] and kept[1] == rows[1][1] and len(kept[3]) < len(rows[3][1]) - 200


def test_spans_meet_after_other_lead_ins(spark):
    r = random.Random(11)
    some = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    rows, want = [], set()
    kinds = [lambda: some(60), lambda: some(120), lambda: some(400), lambda: f"{some(30)}. {some(22)}.", lambda: f"{some(35)}. {some(25)}."]
    for i in range(100):
        passage = kinds[i % 5]()
        for d in (2 * i, 2 * i + 1):
            rows.append((d, f"{some(12)}. {some(r.randint(1, 19))} {passage} {some(r.randint(1, 19))}. {some(12)}."))
        want.add(2 * i + 1)
    lone = some(22)
    rows += [(900 + k, f"{some(8)}. {lone}. {some(8)}.") for k in range(2)]
    got = {x.doc_id: x.n_removed for x in op10.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {d for d, n in got.items() if n}
    assert 901 in found and not found - want - {901} and len(found & want) >= 97


def test_spans_of_odd_rows(spark):
    assert op10.span_report(odd(spark)).count() == len(ROWS)
    assert op10.dedup_spans(odd(spark)).columns == odd(spark).columns
    assert op10.span_report(odd(spark, [])).collect() == []


def picture(seed, size=72):
    r = np.random.default_rng(seed)
    a = op7._box(op7._box(r.normal(size=(size, size)), 1), 1)
    return np.clip(128 + 50 * a / a.std(), 0, 255).astype(np.uint8)


def pgm(a):
    return f"P5 {a.shape[1]} {a.shape[0]} 255\n".encode() + a.astype(np.uint8).tobytes()


def png(a):
    import struct
    import zlib

    part = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(b"\0" + row.tobytes() for row in a))) + part(b"IEND", b"")


def test_image_copies(spark):
    rows, copies = [], {}
    for i in range(30):
        rows.append((i, pgm(picture(i))))
    edits = {100: lambda a: np.rot90(a), 101: lambda a: np.clip(a * 1.15 + 8.0, 0, 255), 102: lambda a: a[:, 8:], 103: lambda a: np.clip(a + np.random.default_rng(1).normal(0, 4, a.shape), 0, 255)}
    for n, edit in edits.items():
        rows.append((n, png(edit(picture(n - 100)).astype(np.uint8))))
        copies[n - 100] = n
    rows += [(200, pgm(picture(5))), (201, None), (202, b"junk"), (203, b"junk"), (None, pgm(picture(6))), (204, pgm(np.zeros((70, 70)))), (205, pgm(np.zeros((3, 3))))]
    df = spark.createDataFrame(rows, "id long, picture binary").withColumn("digest", F.lit(1))
    got = op7.find_copies(df, "id", "picture", F.col("id") < 8).collect()
    assert {(r.query_id, r.copy_id) for r in got} == {*copies.items(), (5, 5), (6, 6)}
    turned = next(r for r in got if r.copy_id == 100)
    assert abs(abs(turned.turn) - np.pi / 2) < 0.1 and abs(turned.scale - 1) < 0.1
    assert op7.find_copies(df.limit(0), "id", "picture", F.lit(True)).collect() == []


def test_image_crops_of_large_pictures(spark):
    rows = [(i, pgm(picture(300 + i, 320))) for i in range(6)]
    for i in range(6):
        side = (160, 120, 100)[i % 3]
        rows.append((100 + i, pgm(picture(300 + i, 320)[40 : 40 + side, 70 : 70 + side])))
    got = {(r.query_id, r.copy_id) for r in op7.find_copies(spark.createDataFrame(rows, "id long, picture binary"), "id", "picture", F.col("id") < 100).collect()}
    assert got == {(i, 100 + i) for i in range(6)}


def test_image_candidates_equal_brute_force(spark):
    rows, by_hand = [], {}
    for i in range(40):
        a, r = picture(500 + i).astype(float), np.random.default_rng(i)
        ys, xs = np.meshgrid(np.arange(54) * 72 / 54, np.arange(54) * 72 / 54, indexing="ij")
        copy = [np.clip(a + r.normal(0, 25, a.shape), 0, 255), op7._sample(a, ys, xs), a[12:68, 4:60] + r.normal(0, 12, (56, 56))][i % 3]
        rows += [(i, pgm(a)), (100 + i, pgm(np.clip(copy, 0, 255)))]
    seen = [(d, dict(zip(("xs", "ys", "sizes", "turns", "bits"), op7.describe(op7.decode(p))))) for d, p in rows]
    want = {(q, d) for q, f in seen if q < 100 for d, g in seen if d != q and op7.consensus(f, g)[0] >= op7.LEAST_INLIERS}
    got = {(r.query_id, r.copy_id) for r in op7.find_copies(spark.createDataFrame(rows, "id long, picture binary"), "id", "picture", F.col("id") < 100).collect()}
    assert got == want and len(want) >= 20
    classes = {(r.id, r.class_id, r.n_links) for r in op7.copy_classes(spark.createDataFrame(rows, "id long, picture binary"), "id", "picture", F.col("id") < 100).collect()}
    least = {d: d for d, _ in rows}
    for _ in rows:
        for q, d in want:
            least[q] = least[d] = min(least[q], least[d])
    assert classes == {(d, least[d], sum(x == d for _, x in want)) for d, _ in rows}
    odd_ = spark.createDataFrame([(1, None), (None, b"junk"), (None, b"junk"), (2, b""), (2, b"")], "id long, picture binary").withColumn("class_id", F.lit(1))
    assert sorted(map(str, ((r.id, r.class_id, r.n_links) for r in op7.copy_classes(odd_, "id", "picture", F.lit(True)).collect()))) == ["(1, 1, 0)", "(2, 2, 0)", "(2, 2, 0)", "(None, None, 0)", "(None, None, 0)"]
    assert op7.copy_classes(odd_.limit(0), "id", "picture", F.lit(True)).collect() == []


def test_image_query_finds_equal_vectors(spark, tmp_path):
    r = np.random.default_rng(0)
    v = [[float(x) for x in r.normal(size=64)] for _ in range(60)]
    rows = [(i, x) for i, x in enumerate(v)] + [(100, v[3]), (150, [x * 1.01 + 0.02 * y for x, y in zip(v[7], r.normal(size=64))]), (200, v[50]), (201, None), (202, [])]
    spark.createDataFrame([(i, [float(y) for y in x] if x is not None else None) for i, x in rows], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.class_id, r.n_links, r.query_id) for r in op7.op7_image_copies(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 5 and got[201] == (201, 0, None)
    at = op7.PLANTED
    assert {i: got[i] for i in (50, 200, 3, 100, 7, 150, 8)} == {50: (50, 1, None), 200: (50, 1, None), 3: (3, 1, None), 100: (3, 0, None), 7: (7, 1, 150), 150: (7, 0, None), 8: (8, 0, None)}
    assert {i: got[at + i] for i in (0, 50, 100, 150, 200)} == {0: (0, 1, 0), 50: (50, 2, 50), 100: (3, 1, 100), 150: (7, 1, 150), 200: (50, 2, 50)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    assert out.count() > 0 and corpus_pipeline.run(spark, SF).count() == out.count()


@pytest.mark.parametrize("rows, labels", [(ROWS, []), (ROWS, [(1, 1), (1, 0), (2, None), (None, 1), (77, 0)]), ([], [(1, 1)])])
def test_pipeline_of_odd_rows(spark, tmp_path, rows, labels):
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    good = [(100 + i, " ".join(f"w{i}x{j}" for j in range(80)) + ".", "a") for i in range(5)] if rows else []
    docs = odd(spark, [*rows, *good, *good[:1]])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    got = out.collect()
    assert (len(got) == 0) == (not rows) and {100, 101, 102, 103, 104} <= {r.doc_id for r in got} | ({100, 101, 102, 103, 104} if not rows else set())


def judged_by_hand(text, rules):
    counts = dict(zip(op3.COUNTS, op3.statistics(text.encode())))
    if counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]:
        return False
    x = {name: float(counts[a]) if b is None else counts[a] / counts[b] if counts[b] else 0.0 for name, (a, b) in op3.RATIOS.items()}
    return not any(all(x[t.feature] >= t.threshold if t.at_least else x[t.feature] <= t.threshold for t in rule) for rule in rules)


def leaders_by_hand(rows):
    """The rows that stay: of each group of similar texts those equal to the one with the smallest id."""
    sets = [set(zip(*(w[i:] for i in range(5)))) if len(w := t.lower().split()) >= 5 else {tuple(w)} for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    return [r for i, r in enumerate(rows) if r[0] == min(q[0] for j, q in enumerate(rows) if top(j) == top(i))]


def mix_by_hand(rows, most=3):
    """doc_id -> copies, by the words of the contract: sources share by weight below bounds, then order sampling."""
    import hashlib

    size = {d: len(t.split()) for d, t, _ in rows}
    sources = sorted({x for _, _, x in rows if x is not None}) + ([None] if any(x is None for _, _, x in rows) else [])
    words = {x: sum(size[d] for d, _, y in rows if y == x) for x in sources}
    weight = {x: i % 3 + 1 for i, x in enumerate(sources)}
    target, open_ = {}, set(sources)
    left = sum(words.values())
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = [x for x in open_ if level * weight[x] > most * words[x]]
        for x in full or list(open_):
            target[x] = most * words[x] if full else level * weight[x]
            open_.discard(x)
            left -= target[x]
    copies = {}
    for x in sources:
        own = [d for d, _, y in rows if y == x]
        ratio = target[x] / words[x] if words[x] else 0.0
        whole, root = int(ratio), {d: int(size[d] ** 0.5) + 1 for d in own}
        scale = sum(root[d] * size[d] for d in own) / words[x] if words[x] else 1.0
        quotient = {}
        for d in own:
            u = (int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            p = (ratio - whole) * root[d] / scale
            quotient[d] = 0.0 if p >= 1 else None if p <= 0 else (o := (u / (1 - u)) / (p / (1 - p))) / (1 + o)
        rest, run = target[x] - whole * words[x], 0
        copies |= dict.fromkeys(own, whole)
        for d in sorted((d for d in own if quotient[d] is not None), key=lambda d: (quotient[d], d, size[d])):
            if run + size[d] / 2 > rest:
                break
            copies[d] += 1
            run += size[d]
    return copies


def test_pipeline_equals_brute_force(spark):
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = op3.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    rows = [r for r in rows if judged_by_hand(r[1], rules)]
    lines = {d: t for d, t, *_ in lines_by_hand(rows)}
    stay = {d for d, _ in leaders_by_hand([(d, lines[d]) for d, _, _ in rows])}
    copies = mix_by_hand([(d, lines[d], x) for d, _, x in rows if d in stay])
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({(d, len(encode.encode(lines[d], add_special_tokens=False).ids) + 1): n for d, n in copies.items() if n})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want and len(want) > 50
    held = Counter()
    for r in got:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and sum(held.values()) == sum(k[1] * n for k, n in want.items())
    assert all(Counter((r.doc_id, r.start) for r in got if r.doc_id == d)[d, 0] == n for (d, _), n in want.items())
