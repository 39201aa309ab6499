"""Best-fit packing of tokenised documents, improved by swap-based local search.

Documents are tokenised where they lie; only (row, piece, length) travels. Pieces
are dealt in groups of about ``GROUP``, each packed by best fit and then by
local search: moves, and one-for-one, one-for-two and two-for-one exchanges over
all items and pairs of underfull bins, each of which raises the sum of squared
fills, so that the emptiest bin drains until it is gone or nothing improves. What
is left in bins that are not nearly full is dealt anew, with what other groups
left, round by round; where no bin is nearly full, each group's emptiest one is.

A piece of full length is a sequence of its own. Defined results: a null text
is empty and has one token, the closing id; a text of any length is cut in pieces;
repeated rows and null doc_ids (of any simple type) are packed like any other; ties
of length go by row and piece; an empty table gives no rows; other columns are ignored.
Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, CLOSING, GROUP = 2048, 0, 8192
#: Bins filled less than this share go into the next round.
NEARLY_FULL = 0.98
_CACHE, _LONGEST_CACHED = 400_000, 64
#: Bytes of text that are looked up together.
_TOGETHER = 8_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

#: Fixed value: how this vocabulary's tokenizer splits lower-case ASCII text.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\t\n\x0b\x0c\ra-z0-9]+")


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _folded(text: str) -> str:
    """Lower case where that changes no id: in Latin-1 the tokenizer's own folding is the same, letter by letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class _Ids(dict):
    """Word to its ids as bytes. This vocabulary's words end at white space, so a text's ids are those of its words.

    Many texts are looked up together, each distinct word of theirs once. Two
    generations bound the memory: when the young one is full it becomes the old
    one, and words met again move back to the young.
    """

    def __init__(self, path: str):
        self.path, self.old, self.parts = path, {}, {}

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one behind the other, and where each text's begin (and the last one's end)."""
        split = pc.split_pattern(pa.array([_folded(t or "").replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = self._known(words)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])
        return ids[at], ends[split.offsets.to_numpy()]

    def _known(self, words: list[str]) -> list[bytes]:
        missing = [w for w in words if w not in self]
        if len(self) + len(missing) > _CACHE:
            self.old = dict(self)
            self.clear()
        kept = {w: self.old[w] for w in missing if w in self.old}
        self.update(kept)
        new = [w for w in missing if w not in kept]
        long = {}
        for w, own in zip(new, self._composed(new), strict=True):
            (self if len(w) <= _LONGEST_CACHED else long)[w] = own
        # words of the generation that has just gone are still in the old one
        return [self.get(w) or self.old.get(w) or long.get(w, b"") for w in words]

    def _composed(self, words: list[str]) -> list[bytes]:
        """Ids of new words. Plain ones are split as the tokenizer splits them, as most of their parts have been met before."""
        parts = [_PART.findall(w.lower()) if w.isascii() else [w] for w in words]
        missing = list({x for own in parts for x in own if x not in self.parts})
        if len(self.parts) + len(missing) > _CACHE:
            self.parts.clear()
            missing = list({x for own in parts for x in own})
        long = {}
        for x, own in zip(missing, self._learned(missing), strict=True):
            (self.parts if len(x) <= _LONGEST_CACHED else long)[x] = own
        if long:
            return [b"".join([long[x] if x in long else self.parts[x] for x in own]) for own in parts]
        known = self.parts.__getitem__
        return [b"".join(map(known, own)) for own in parts]

    def _learned(self, words: list[str]) -> list[bytes]:
        found = _tokenizer(self.path).encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]


@lru_cache(1)
def _ids_of(path: str) -> _Ids:
    """The worker's cache, kept from task to task."""
    return _Ids(path)


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", ids: bool = False, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """(_row, doc_id, piece, start, length, ids_crc32) of every piece; ``ids``: also the tokens."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, begin = _ids_of(vocabulary).of(batch.column(2).to_pylist())
        # each text's ids, and its closing one
        found = np.insert(found, begin[1:], closing).astype("<u4", copy=False)
        size = np.diff(begin) + 1
        begin = begin[:-1] + np.arange(len(size))
        n = -(-size // capacity)
        text_ = np.repeat(np.arange(len(size)), n)
        piece = np.arange(len(text_)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(size[text_] - start, capacity)
        low = begin[text_] + start
        crc = [zlib.crc32(found[a:b]) for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(text_)), batch.column(1).take(pa.array(text_)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        if ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, len(found)), pa.int32()), pa.array(found.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids])

    def run(record_batches):
        for batch in record_batches:
            # so many rows that a batch's text stays small, one at least
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, "right")) - at)
                yield cut(batch.slice(at, n))
                at += n

    kind = dict(docs.dtypes)[key]
    rows = common.with_row_id(docs.select(F.col(key).alias("key"), F.col(text).alias("t"))).select("_row", "key", "t")
    form = f"_row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return rows.mapInArrow(run, form)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where it leaves the least room."""
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    bins: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(item)
        else:
            left, b = capacity, len(bins)
            bins.append([item])
        if left > n:
            insort(room, (left - n, b))
    return bins


def drained(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search: empties the emptiest bins while the number of bins can still fall."""
    owner = np.empty(len(lengths), np.int64)
    for b, own in enumerate(bins):
        owner[own] = b
    fill = np.bincount(owner, lengths, len(bins)).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    left = len(bins)
    stuck = np.zeros(len(bins), bool)
    while left > least:
        open_ = np.flatnonzero((fill > 0) & ~stuck)
        if not len(open_):
            break
        source = int(open_[np.argmin(fill[open_])])
        if _drain(lengths, owner, fill, source, capacity):
            left -= 1
            stuck[:] = False  # the others have changed
        else:
            stuck[source] = True
    out: dict[int, list[int]] = {}
    for item in np.argsort(owner, kind="stable").tolist():
        out.setdefault(int(owner[item]), []).append(item)
    return list(out.values())


def _drain(lengths, owner, fill, source: int, capacity: int) -> bool:
    """Takes from one bin what raises the squared fill; True if it is empty in the end."""
    while fill[source]:
        mine = np.flatnonzero(owner == source)
        mine = mine[np.argsort(-lengths[mine], kind="stable")]
        room = capacity - fill
        room[source] = 0
        room[fill < fill[source]] = 0  # only into fuller bins, or the squares fall
        room[fill == 0] = 0
        step = _move(lengths, room, mine) or _exchange(lengths, owner, room, mine)
        if step is None:
            return False
        out, back, b = step
        moved = int(lengths[out].sum()) - int(lengths[back].sum())
        owner[out] = b
        owner[back] = source
        fill[b] += moved
        fill[source] -= moved
    return True


def _move(lengths, room, mine):
    """The longest item that fits, into the bin it fits tightest."""
    for item in mine.tolist():
        fits = np.flatnonzero(room >= lengths[item])
        if len(fits):
            return [item], np.empty(0, np.int64), int(fits[np.argmin(room[fits])])
    return None


def _pairs(items: np.ndarray, bin_of: np.ndarray) -> np.ndarray:
    """All pairs (rows of two) of items that lie in one bin; ``items`` in order of their bins."""
    found, d = [np.empty((0, 2), np.int64)], 1
    while d < len(items):
        same = bin_of[:-d] == bin_of[d:]
        if not same.any():
            break
        found.append(np.column_stack([items[:-d][same], items[d:][same]]))
        d += 1
    return np.concatenate(found)


def _exchange(lengths, owner, room, mine):
    """The exchange with the greatest gain: one for one, one for two of a bin's, or two for one."""
    others = np.flatnonzero(room[owner] > 0)
    if not len(others):
        return None
    others = others[np.argsort(owner[others], kind="stable")]
    one, two = others[:, None], _pairs(others, owner[others])
    own_two = _pairs(mine, np.zeros(len(mine), np.int64))
    best, gain = None, 0
    for given, taken in ((mine[:, None], one), (mine[:, None], two), (own_two, one)):
        size, spare = lengths[taken].sum(1), room[owner[taken[:, 0]]] if len(taken) else np.empty(0, np.int64)
        # equal lengths are alike: each is tried once, and none that could not gain more than the best so far
        total, first = np.unique(lengths[given].sum(1), return_index=True)
        for n, k in zip(total[::-1].tolist(), first[::-1].tolist(), strict=True):
            got = n - size
            good = (got > gain) & (got <= spare)
            if good.any():
                place = int(np.flatnonzero(good)[np.argmax(got[good])])
                best, gain = (given[k], taken[place], int(owner[taken[place, 0]])), int(got[place])
    return best


def _packed(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins = drained(lengths, best_fit(lengths, capacity), capacity)
        sequence, offset, fill = (np.empty(len(frame), np.int64) for _ in range(3))
        for b, own in enumerate(bins):
            n = lengths[own]
            sequence[own], offset[own], fill[own] = b, np.cumsum(n) - n, n.sum()
        return frame.drop(columns="g").assign(bin=sequence, offset=offset, fill=fill, least=sequence == sequence[np.argmin(fill)], g=frame["g"])

    return pack


def packed(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``cut`` (staged pieces) with sequence_id and offset."""
    held = ["_row", "doc_id", "piece", "start", "length", "ids_crc32"]
    kind = dict(cut.dtypes)["doc_id"]
    form = "_row long, doc_id string, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, least boolean, g long"
    # as text, for pandas would make numbers with nulls inexact
    todo, done, turn = cut.select(*held).withColumn("doc_id", F.col("doc_id").cast("string")), None, 0
    n = todo.count()
    while True:
        groups = max(1, -(-n // group))
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("_row", "piece", F.lit(turn)), F.lit(groups)))
        out = common.staged(dealt.groupBy("g").applyInPandas(_packed(capacity), form))
        number = F.lit(turn).cast("long") * F.lit(1 << 56) + F.col("g") * F.lit(1 << 24) + F.col("bin")
        out = out.withColumn("sequence_id", number)
        low = F.col("fill") < int(capacity * NEARLY_FULL)
        left = out.filter(low).count() if groups > 1 else 0
        if left == n > 0:
            # no bin is nearly full: only what could be left over, each group's emptiest bin
            low = F.col("least")
            left = out.filter(low).count()
        again = 0 < left < n
        kept = (out.filter(~low) if again else out).select(*held, "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if not again:
            return done.withColumn("doc_id", F.col("doc_id").cast(kind))
        todo, n, turn = out.filter(low).select(*held), left, turn + 1


def pack(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its place: _row, doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(common.staged(pieces(docs, vocabulary or default_vocabulary(), key, text)))


def sequences(docs: DataFrame, plan: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(sequence_id, ids) of the plan, with the documents tokenised again."""
    tokens = pieces(docs, vocabulary or default_vocabulary(), key, text, ids=True).select("_row", "piece", "ids")
    placed = tokens.join(plan.select("_row", "piece", "sequence_id", "offset"), ["_row", "piece"])
    whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    return whole.select("sequence_id", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(common.read(spark, sf_dir, "documents")).drop("_row")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
