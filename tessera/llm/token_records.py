"""Token ids in length-delimited binary records, with an offset index for reads in any order.

Documents are range-partitioned and sorted by key, tokenised in that order and
framed as they come: length (8 bytes), its masked CRC-32C, the ids as little-endian
numbers of 2 bytes (4 where the vocabulary needs them), their masked CRC-32C. These
are the frames that record readers of training frameworks know. A task writes its
own file, under a name of its own attempt, and gives back one index row for each
record; only rows of finished attempts reach the index, so a lost executor leaves
at most a file that no index names, and ``write`` deletes it in the end.

The index (key, file, offset, length, n_tokens, start) is a Parquet table of its own.
``read`` takes any rows of it, in any order, deals them by file ranges of bounded
size and checks length and checksums of every record.

Defined results: a null text is empty and has one id, the closing one; texts of any
length are one record each; null keys come first; equal keys and repeated rows
are records of their own, in the order of the input's files; an empty table gives an
empty index; other columns are ignored. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .crc32c import checksums, masked

CLOSING = 0
#: Bytes of text that are tokenised together, and of a file that one reading task takes in a row.
_TOGETHER, _RANGE = 8_000_000, 32_000_000
#: Words of the cache; what is not in the batch at hand goes when they are more.
_CACHE = 1_500_000
#: Fixed value: how a byte-level vocabulary writes a space.
_SPACE = "\u0120"
_FRAME = 16
#: White space around a space: there the tokenizer's words do not begin at every space.
_RUNS = re.compile(r"\s \s|\s $")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Ids:
    """Ids of many texts at once, by a bounded cache of words.

    A byte-level vocabulary's words begin at a space that stands before a letter, a digit
    or a sign, so a text's ids are those of its space-separated parts. Words and ids of the
    cache are flat arrays; new words are tokenised as one text, whose tokens with a leading
    space tell where each begins. Texts with runs of white space that end in a space, words
    with white space at an end and first words go to the tokenizer one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(_SPACE)]] = True
        self._keep(pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, np.uint32))

    def _keep(self, words: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        self.words, self.size, self.ids = words, size, ids

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one behind the other, and where each text's begin (and the last one's end)."""
        whole = [bool(_RUNS.search(t)) for t in texts]
        split = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        coded, first = split.values.dictionary_encode(), split.offsets.to_numpy()
        place = self._places(coded.dictionary)
        code = place[coded.indices.to_numpy()]
        # a text's first word has no space before it; a text that is taken whole has no other
        own_size, own_ids = self._one_by_one([t if w else t.split(" ", 1)[0] for t, w in zip(texts, whole, strict=True)])
        code[first[:-1]] = len(self.size) + np.arange(len(texts))
        size, ids = np.concatenate([self.size, own_size]), np.concatenate([self.ids, own_ids])
        n, begin = size[code], (np.cumsum(size) - size)[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin - ends[:-1], n)
        at += np.arange(ends[-1])
        return ids[at], ends[first]

    def _places(self, words: pa.Array) -> np.ndarray:
        """The places of the words in the cache, new ones learned."""
        if len(self.words) + len(words) > _CACHE:
            self._only(words)
        found = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(found)
        places = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        new = words.filter(missing)
        if len(new):
            places[missing.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
            size, ids = self._learned(new.to_pylist())
            self._keep(pa.concat_arrays([self.words, new]), np.concatenate([self.size, size]), np.concatenate([self.ids, ids]))
        return places

    def _only(self, words: pa.Array) -> None:
        """Forgets all but these words."""
        kept = pc.is_in(self.words, value_set=words)
        mask = kept.to_numpy(zero_copy_only=False).astype(bool)
        self._keep(self.words.filter(kept), self.size[mask], self.ids[np.repeat(mask, self.size)])

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words that stand behind a space."""
        odd = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in words), bool, len(words))
        plain = [w for w, o in zip(words, odd, strict=True) if not o]
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids if plain else [], np.uint32)
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(plain):
            raise ValueError("the vocabulary does not mark the space before a word")
        if not odd.any():
            return np.diff(np.append(at, len(ids))), ids
        size = np.empty(len(words), np.int64)
        size[~odd] = np.diff(np.append(at, len(ids)))
        size[odd], rest = self._one_by_one([f" {w}" for w, o in zip(words, odd, strict=True) if o])
        out = np.empty(int(size.sum()), np.uint32)
        mine = np.repeat(odd, size)
        out[~mine], out[mine] = ids, rest
        return size, out

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return size, np.fromiter((i for own in found for i in own), np.uint32, int(size.sum()))


@lru_cache(1)
def _ids_of(path: str) -> _Ids:
    """The worker's cache, kept from task to task."""
    return _Ids(path)


def _files(folder: str):
    """(file system, path in it) of a folder that driver and executors share; a plain path is a mounted one."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def framed(payloads: list[bytes]) -> list[bytes]:
    """The records of the payloads."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(checksums(lengths)), masked(checksums(payloads))
    return [b"".join((n, struct.pack("<I", h), p, struct.pack("<I", t))) for n, h, p, t in zip(lengths, heads.tolist(), payloads, tails.tolist(), strict=True)]


def payloads_of(records: list[bytes], where: str = "") -> list[bytes]:
    """The payloads of whole records; a wrong length or checksum is an error that names the place."""
    payloads = [r[12:-4] for r in records]
    good = [len(r) >= _FRAME and struct.unpack_from("<Q", r)[0] == len(p) for r, p in zip(records, payloads, strict=True)]
    heads, tails = masked(checksums([r[:8] for r in records])), masked(checksums(payloads))
    for ok, r, h, t in zip(good, records, heads.tolist(), tails.tolist(), strict=True):
        if not ok or struct.unpack_from("<I", r, 8)[0] != h or struct.unpack_from("<I", r, len(r) - 4)[0] != t:
            raise ValueError(f"damaged record in {where}")
    return payloads


def _writer(folder: str, vocabulary: str, form: str, closing: int):
    """Arrow batches of (key, text), in order, to a file; index rows without the ids before the task's first."""

    def write(record_batches):
        store, root = _files(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.records"
        out, offset, before = None, 0, 0
        try:
            for batch in record_batches:
                ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
                at = 0
                while at < batch.num_rows:
                    n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, "right")) - at)
                    rows = batch.slice(at, n)
                    ids, begin = _ids_of(vocabulary).of([t or "" for t in rows.column(1).to_pylist()])
                    ids = np.insert(ids, begin[1:], closing).astype(form)
                    begin = begin + np.arange(n + 1)
                    records = framed([ids[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])
                    if out is None:
                        out = store.open_output_stream(f"{root}/{name}")
                    out.write(b"".join(records))
                    size = np.fromiter(map(len, records), np.int64, n)
                    places = offset + np.cumsum(size) - size
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(places), pa.array(size), pa.array(np.diff(begin)), pa.array(before + begin[:-1])],
                        ["key", "part", "file", "offset", "length", "n_tokens", "start"],
                    )
                    offset, before, at = offset + int(size.sum()), before + int(begin[-1]), at + n
        finally:
            if out is not None:
                out.close()

    return write


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", closing: int = CLOSING) -> DataFrame:
    """Writes all documents' ids in order of the key below ``folder`` (new or empty): data files, ``index`` and ``about.json``.

    Returns the index: key, file, offset, length, n_tokens, start (ids of all records before it).
    """
    vocabulary = vocabulary or default_vocabulary()
    form = "<u2" if max(len(_ids_of(vocabulary).begins), closing + 1) <= 1 << 16 else "<u4"
    store, root = _files(folder)
    store.create_dir(root, recursive=True)
    kind = dict(docs.dtypes)[key]
    rows = common.with_row_id(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    # the row number parts even the rows of one key
    dealt = rows.repartitionByRange("key", "_row").sortWithinPartitions("key", "_row").select("key", "text")
    done = common.staged(dealt.mapInArrow(_writer(folder, vocabulary, form, closing), f"key {kind}, part int, file string, offset long, length long, n_tokens long, start long"))
    from pyspark.sql import Window

    # one row for each file; a task's ids come after those of the tasks before it
    files = done.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = files.select("part", "file", ahead.alias("_ahead"))
    index = done.join(F.broadcast(offsets.select("part", "_ahead")), "part").select(
        F.col("key").alias(key), "file", "offset", "length", "n_tokens", (F.col("start") + F.col("_ahead")).alias("start")
    )
    index.write.parquet(f"{folder}/index")
    common.release(done)
    from pyarrow import fs

    spark = docs.sparkSession
    index = spark.read.schema(index.schema).parquet(f"{folder}/index")
    named = {r.file for r in index.select("file").distinct().toLocalIterator()}
    for found in store.get_file_info(fs.FileSelector(root)):
        if found.base_name.endswith(".records") and found.base_name not in named:
            store.delete_file(found.path)
    with store.open_output_stream(f"{root}/about.json") as out:
        out.write(json.dumps({"ids": form, "vocabulary": os.path.basename(vocabulary), "closing": closing}, sort_keys=True).encode())
    return index


def read(spark: SparkSession, folder: str, index: DataFrame | None = None, kept: list[str] | None = None, ids: bool = True) -> DataFrame:
    """The records of ``index`` (the whole one where none is given), checked: its columns ``kept``, n_tokens, ids_crc32 and ``ids``.

    n_tokens and ids_crc32 (over the ids as little-endian numbers of 4 bytes) come from the data files.
    """
    index = spark.read.parquet(f"{folder}/index") if index is None else index
    kept = [c for c in index.columns if c not in ("file", "offset", "length", "n_tokens")] if kept is None else kept
    store, root = _files(folder)
    with store.open_input_stream(f"{root}/about.json") as f:
        form = json.loads(f.read())["ids"]

    def run(record_batches):
        own, root = _files(folder)
        name, opened = None, None
        for batch in record_batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in (0, 1, 2))
            at = 0
            while at < len(files):
                # rows of one file together, in bounded steps
                to, size = at, 0
                while to < len(files) and files[to] == files[at] and (to == at or size + lengths[to] <= _TOGETHER):
                    size, to = size + lengths[to], to + 1
                if files[at] != name:
                    if opened:
                        opened.close()
                    name, opened = files[at], own.open_input_file(f"{root}/{files[at]}")
                records = [opened.read_at(n, o) for n, o in zip(lengths[at:to], offsets[at:to], strict=True)]
                found = [np.frombuffer(p, form).astype("<u4") for p in payloads_of(records, name)]
                columns = [batch.column(3 + i).slice(at, to - at) for i in range(len(kept))]
                columns += [pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64())]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_tokens", "ids_crc32", *["ids"] * ids])
                at = to
        if opened:
            opened.close()

    form_ = T.StructType([index.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)
    # neighbours in a file are read by one task, in order
    stretch = F.call_function("div", F.col("offset"), F.lit(_RANGE).cast("long"))
    dealt = index.select("file", "offset", "length", *[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)])
    return dealt.repartition(F.col("file"), stretch).sortWithinPartitions("file", "offset").mapInArrow(run, form_)


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as records in order of doc_id, and read back."""
    folder = f"{common.shared_dir(spark)}/records-{uuid.uuid4().hex}"
    index = write(common.read(spark, sf_dir, "documents"), folder)
    return read(spark, folder, index, ["doc_id", "start"], ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op13_token_records": op13_token_records}
#: Tokens and binary files are beyond SQL; tests/llm reads the files with plain Python and compares them with the tokenizer's ids.
ORACLE_SQL: dict[str, str] = {}
