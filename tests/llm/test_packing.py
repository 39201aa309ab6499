import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing


def test_pieces_hold_the_tokenizers_ids(table):
    texts = ["Hello, World! it's 2024\n\tnew  line", "", None, "é ß Œuvre 日本語  x", "<|endoftext|> a", "word " * 5000, "x" * 9000]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    docs = table(list(enumerate(texts)))
    plan = packing.pack(docs)
    rows = plan.collect()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(a, min(2048, len(ids) - a)) for a in range(0, len(ids), 2048)]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)]
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs, plan).collect()}
    for r in rows:
        part = np.array(whole[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
    assert all(len(x) <= 2048 for x in whole.values())


def test_sequences_are_gapless_and_few(table, spark):
    r = np.random.default_rng(3)
    rows = [(i, int(i), 0, 0, int(n), 0) for i, n in enumerate(r.integers(1, 2049, 3000))]
    cut = spark.createDataFrame(rows, "_row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.packed(cut, group=500).toPandas()
    assert len(out) == 3000
    fill = out.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 2048
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()
    assert len(fill) <= 1.02 * np.ceil(out["length"].sum() / 2048)


def test_local_search_empties_bins():
    lengths = np.array([6, 4, 5, 5, 3, 7, 2, 8, 1, 9])
    bins = packing.drained(lengths, [[i] for i in range(10)], 10)
    assert len(bins) == 5 and sorted(x for b in bins for x in b) == list(range(10))
    assert all(lengths[b].sum() <= 10 for b in bins)


def test_odd_tables(table):
    docs = table([(None, "a b"), (None, "a b"), (2**60 + 1, None), (5, "")])
    rows = packing.pack(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["None", "None", str(2**60 + 1), "5"])
    assert sorted(r.length for r in rows) == [1, 1, 3, 3] and len({r.sequence_id for r in rows}) == 1
    assert sorted(r.offset for r in rows) == sorted(sum(sorted_[:i]) for sorted_ in [[r.length for r in sorted(rows, key=lambda r: r.offset)]] for i in range(4))
    named = docs.withColumn("doc_id", packing.F.lit("x"))
    assert {r.doc_id for r in packing.pack(named).collect()} == {"x"}
    assert packing.pack(docs.filter("doc_id < 0")).count() == 0


def test_equal_lengths_leave_one_partial_bin(spark):
    """No bin is nearly full, so the groups' emptiest bins are merged."""
    rows = [(i, i, 0, 0, 1000, 0) for i in range(501)]
    cut = spark.createDataFrame(rows, "_row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.packed(cut, group=50).toPandas()
    assert out.sequence_id.nunique() == 251


def test_exchanges_reach_what_all_pairs_reach():
    """One for two of a bin's, and two for one, also where the two are no neighbours by length."""
    lengths = np.array([9, 2, 6, 1, 8, 3])
    bins = packing.drained(lengths, [[0], [1, 2, 3], [4], [5]], 10)
    assert len(bins) == 3
    r = np.random.default_rng(1)
    for _ in range(30):
        lengths = r.integers(1, 700, 40)
        first = packing.best_fit(lengths, 1000)
        after = packing.drained(lengths, first, 1000)
        assert sorted(x for b in after for x in b) == list(range(40)) and all(lengths[b].sum() <= 1000 for b in after)
        assert len(after) <= len(first)


def test_odd_words(table):
    """Ids are the tokenizer's for words that lower-casing or composing changes, and for any white space."""
    import random

    r = random.Random(2)
    alphabet = "abzABZ019 '\"!.,-_#\n\t\r\x0b\x0c\x1c\x1f\x85\u2028\u00a0éßİıΣσς日本\u0301ñ'sS'tT'reLL<|endoftext|>"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(3000)]
    tokenizer = packing._tokenizer(packing.default_vocabulary())
    ids, begin = packing._Ids(packing.default_vocabulary()).of(texts)
    for i, t in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
