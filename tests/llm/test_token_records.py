import json
import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import crc32c, token_records

ODD = [
    "a  b", "a   b ", " a", "a \nb", "a\n b", "  ", "", None, "x\t y", "  lead", "é ß  z", "a  b", "a  b", "I'm  don't 12 3,4 <|endoftext|> x", "\n\n a\n\n\n b",
    "日本 語  x", "tail ", "a\x1c b \x85 c", "　 b c", "a​  b", "word " * 50_000, "x" * 30_000, "two words", "two words",
]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def plain_checksum(b):
    c = 0xFFFFFFFF
    for x in b:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ 0x82F63B78 if c & 1 else c >> 1
    return c ^ 0xFFFFFFFF


def plain_masked(b):
    c = plain_checksum(b)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    assert crc32c.checksums([b"123456789"]).tolist() == [0xE3069283]
    r = random.Random(1)
    strings = [r.randbytes(r.choice([0, 1, 7, 8, 63, 64, 65, 128, 500, 3000])) for _ in range(60)]
    assert crc32c.checksums(strings).tolist() == [plain_checksum(s) for s in strings]
    assert crc32c.masked(crc32c.checksums(strings)).tolist() == [plain_masked(s) for s in strings]
    assert crc32c.checksums([]).tolist() == []


def test_words_by_cache_are_the_tokenizers(tokenizer):
    r = random.Random(6)
    signs = ["a", "B", "é", "7", " ", " ", "\n", "\t", " ", " ", "'s", "'", "!", "日", "_", "\x1c", "\u0085", "<|endoftext|>"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 14))) for _ in range(3000)]
    ids, begin = token_records._ids_of(public_tokenizers.path("byte_bpe_50k.json")).of(list(texts))
    for t, a, b, e in zip(texts, begin, begin[1:], tokenizer.encode_batch(texts, add_special_tokens=False), strict=False):
        assert ids[a:b].tolist() == e.ids, repr(t)


def test_files_by_plain_python(table, tokenizer, spark, tmp_path):
    docs = table([(7 * i % 31, t) for i, t in enumerate(ODD)] + [(None, "no key"), (None, None), (3, "three"), (3, "three")])
    folder = str(tmp_path / "out")
    index = token_records.write(docs, folder)
    given = docs.select("doc_id", "text").collect()
    want = sorted(([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in given), key=str)
    rows = sorted(index.collect(), key=lambda r: r.start)
    form = json.loads((tmp_path / "out" / "about.json").read_text())["ids"]
    got, at = [], 0
    for r in rows:
        data = (tmp_path / "out" / r.file).read_bytes()[r.offset : r.offset + r.length]
        size = struct.unpack_from("<Q", data)[0]
        body = data[12 : 12 + size]
        assert len(data) == size + 16 and struct.unpack_from("<I", data, 8)[0] == plain_masked(data[:8]) and struct.unpack_from("<I", data, 12 + size)[0] == plain_masked(body)
        ids = np.frombuffer(body, form).tolist()
        assert r.start == at and r.n_tokens == len(ids)
        at += len(ids)
        got.append((r.doc_id, ids))
    keys = [k for k, _ in got]
    assert keys == [None, None, *sorted(k for k in keys if k is not None)]
    assert sorted((x for _, x in got), key=str) == want
    # every file is full of records and named by the index; what comes back is what went in
    assert {f for f in os.listdir(folder) if f.endswith(".records")} == {r.file for r in rows}
    assert sum(os.path.getsize(f"{folder}/{f}") for f in {r.file for r in rows}) == sum(r.length for r in rows)
    back = token_records.read(spark, folder, index.orderBy(F.rand(5)))
    assert sorted(((r.start, r.n_tokens, r.ids, r.ids_crc32) for r in back.collect())) == [
        (r.start, len(x), x, zlib.crc32(np.array(x, "<u4").tobytes())) for r, (_, x) in zip(rows, got, strict=True)
    ]
    some = token_records.read(spark, folder, index.filter("doc_id = 3")).collect()
    assert len(some) == len([k for k in keys if k == 3])


def test_damage_is_found(table, spark, tmp_path):
    folder = str(tmp_path / "out")
    index = token_records.write(table([(1, "some text"), (2, "more text")]), folder)
    r = index.filter("doc_id = 2").first()
    for place in (r.offset + 1, r.offset + 9, r.offset + 13, r.offset + r.length - 1):
        data = bytearray((tmp_path / "out" / r.file).read_bytes())
        data[place] ^= 1
        (tmp_path / "out" / r.file).write_bytes(data)
        with pytest.raises(Exception, match="damaged record"):
            token_records.read(spark, folder, index).count()
        data[place] ^= 1
        (tmp_path / "out" / r.file).write_bytes(data)
    assert token_records.read(spark, folder, index).count() == 2


def test_empty_table_and_leftovers(table, spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "part-00000-lost.records").write_bytes(b"of an attempt that was lost")
    index = token_records.write(table([]), str(folder))
    assert index.count() == 0 and token_records.read(spark, str(folder)).count() == 0
    assert not [f for f in os.listdir(folder) if f.endswith(".records")]
