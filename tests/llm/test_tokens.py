import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import op1_token_counts as op1
from lumenframe.llm import op4_packing as op4
from lumenframe.llm import op9_token_store as op9
from lumenframe.llm.common import shared_folder
from lumenframe.llm.token_ids import WordIds

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "Straße ΣΑΣ it's 12  é́́ x́", "<|endoftext|>a <|endoftext|> b", "a b c\x1cd\x85e", "▁ a ▁▁b", "日本語 テスト🙂🙂 ", "   lead", "trail  ", "<0x41> <s> </s>", "x" * 3000, "a\r\nb\tc\x0bd", "ñ" * 70 + " ퟿"]


def texts(n=120, seed=3):
    r = random.Random(seed)
    words = ["the", "The", "tion.", "ouer,", "éau", "!!", "***", "|", "zürich", "don't", "x1", "42"] + ["".join(r.choices("aeioustr", k=r.randint(1, 9))) for _ in range(60)]
    made = [r.choice([" ", " ", "\n"]).join(r.choices(words, k=r.choice([1, 3, 40, 300, 2500]))) for _ in range(n)]
    return ODD + made + made[:20]


def frame(spark, rows=None):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (3, "again"), (None, "no id")] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("sequence_id", F.lit("x")).withColumn("N_TOKENS", F.lit(1)).repartition(3)


def plain_ids(text):
    from tokenizers import Tokenizer

    plain_ids.t = getattr(plain_ids, "t", None) or Tokenizer.from_file(WORD_BPE)
    return [*plain_ids.t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_ids_of_whole_texts():
    w = WordIds(WORD_BPE, most_words=500)
    assert w.by_words
    got = w.encode([t.encode() for t in texts()])
    for t, g in zip(texts(), got):
        assert np.frombuffer(g, "<u4").tolist() == plain_ids(t)[:-1], t[:50]


def unigram(pieces):
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, any(p == "<0x00>" for p, _ in pieces)))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


@pytest.mark.parametrize("kind", ["file", "no bytes", "inner marks", "fractions"])
def test_unigram_counts_match_the_library(kind):
    pieces = op1.model_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    if kind == "no bytes":
        pieces = [p for p in pieces if not p[0].startswith("<0x")][:4000] + [("▁", -5000.0)]
    if kind == "inner marks":
        pieces = [*pieces[:9000], ("t▁t", -3.0), ("e▁", -1.0)]
    if kind == "fractions":
        pieces = [(p, s / 7) for p, s in pieces]
    least = min(s for _, s in pieces)
    pieces = [(p, max(s, -1e6)) for p, s in pieces] if kind != "file" else pieces
    assert least < 0
    counter, library = op1.UnigramCounter(pieces, most_cuts=200), unigram(pieces)
    assert counter.by_cuts == (kind in ("file", "no bytes"))
    for t in texts(40):
        if kind == "no bytes" and "\n" in t:
            continue
        assert counter.count(t)[1] == len(library.encode(t, add_special_tokens=False).ids), t[:60]


def test_ties_keep_the_longest_last_piece():
    counter = op1.UnigramCounter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("aaa", -3.0)])
    assert counter.count("aaa")[1] == len(unigram([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("aaa", -3.0)]).encode("aaa").ids)


def test_op1_frame(spark):
    rows = op1.token_counts(frame(spark), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(texts()) + 3
    assert {(r.n_tokens, r.n_chars) for r in rows if r.doc_id == 900} == {(0, 0)}
    assert op1.token_counts(frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_differencing_is_near_equal_and_rises():
    r = random.Random(1)
    lengths = [r.randint(1, 512) for _ in range(700)]
    window, k = op4.windows(lengths, 2048)
    sums = np.bincount(window, lengths, minlength=k)
    assert sums.max() <= 2048 and sums.max() - sums.min() < 200 and k * 2048 < 1.04 * sum(lengths)
    assert op4.windows([2048, 2048, 1], 2048)[1] == 3
    assert op4.windows([5], 2048) == (np.array([0]), 1)


def check_packing(rows, docs):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want = sorted(((d or -1, len(i := plain_ids(t)), crc(i)) for d, t in docs))
    have = []
    for (d, n), pieces in by_doc.items():
        starts = sorted((p.start, p.length) for p in pieces)
        copies = sum(1 for s, _ in starts if s == 0)
        assert sum(length for _, length in starts) == copies * n
        have += [(d or -1, n)] * copies
    assert sorted(have) == [w[:2] for w in want]


def test_op4_pieces_cover_documents(spark):
    docs = frame(spark)
    rows = op4.pack(docs, WORD_BPE, block=16).collect()
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(rows, pairs)
    texts_of = {}
    for d, t in pairs:
        texts_of.setdefault(d, []).append(plain_ids(t))
    for r in rows:
        assert any(crc(i[r.start : r.start + r.length]) == r.ids_crc32 for i in texts_of[r.doc_id])
    assert op4.pack(frame(spark, []), WORD_BPE).collect() == []


def test_crc_and_merkle():
    a, b = b"abc" * 9, b"defg" * 1000
    assert op9.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert op9.crc32_joined(0, zlib.crc32(b), len(b)) == zlib.crc32(b)
    runs = [[a, b], [b""], [b], [b, b"", a, a]]
    flat, n = [x for r in runs for x in r], np.array([len(r) for r in runs])
    joined = op9.crc32_of_runs(np.array([zlib.crc32(x) for x in flat]), np.array([len(x) for x in flat]), np.cumsum(n) - n)
    assert joined.tolist() == [zlib.crc32(b"".join(r)) for r in runs]
    assert op9.merkle_root([b"1", b"2", b"3"]) != op9.merkle_root([b"1", b"3", b"2"])


def test_cuts_follow_content():
    r = np.random.default_rng(0)
    ids = r.integers(0, 49000, 30000).astype("<u4")
    one, two = op9.cuts(ids), op9.cuts(np.r_[ids[:5], ids])
    assert one[-1] == 30000 and max(np.diff([0, *one])) <= op9.MOST
    assert len({e + 5 for e in one} & set(two)) > 0.9 * len(one)
    assert op9.cuts(ids[:0]) == [] and op9.cuts(ids[:1]) == [1]


def test_op9_round_trip(spark):
    docs = frame(spark)
    store = op9.write_store(docs, WORD_BPE, shared_folder(spark, "t9"))
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.verified) for r in store.documents().collect()))
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(i := plain_ids(r.text)), crc(i)) for r in docs.collect())
    assert sorted((g[0], g[2], g[3]) for g in got) == want and all(g[4] for g in got)
    at = 0
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == at
        at += g[2]
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == sorted(g[0] for g in got)
    assert store.chunks.select("digest").distinct().count() == store.chunks.count()
    back = {(r.doc_id, r.start): bytes(r.ids) for r in store.ids().collect()}
    assert all(zlib.crc32(back[(None if g[0] == -1 else g[0], g[1])]) == g[3] for g in got)
    assert op9.write_store(frame(spark, []), WORD_BPE, shared_folder(spark, "t9")).documents().collect() == []
