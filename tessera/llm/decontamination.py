"""Benchmark decontamination: size-partitioned MinHash containment, verified exactly.

A test item of 30 words in a document of 10,000 has a tiny Jaccard similarity,
so documents are looked at in windows as long as the items sought. Items are
partitioned by their number of shingles (powers of two); for items of at most
w shingles a document is cut in blocks of w, and two neighbouring blocks form a
window of 2w, so that every item lies wholly in one. In a partition the Jaccard
similarity of item and window is at least ``t * w/2 / (w/2 + 2w - t * w/2)``
for containment t, which gives the number of hash functions for the target
recall (one row a band, as similarities are low). A window that shares a
minimum with an item makes (document, item) a candidate (windows may reach into
the next document of a batch, both are then candidates); the candidate counts if the document's shingle set holds ``threshold`` of the item's.

The items are the stated query set: they are taken in blocks of at most
``MOST_SHINGLES`` shingles, sorted by hash so that item repeats do not matter,
and each block passes once over all documents, without a shuffle.

Defined results: null or empty items and documents match nothing; an item under
five words is one shingle of its own length; repeated items and rows are each
reported; null ids are kept, ids may be of any simple type; texts of any length
are taken whole; empty tables give no rows; other columns pass, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, shingles

THRESHOLD, RECALL, SEED = 0.8, 0.999, 4
#: Shingles of one block of items that a task holds: 32 MB of hashes.
MOST_SHINGLES = 4_000_000
#: Words of documents that are looked at together, so that a hash function is one pass over many texts.
_TOGETHER = 100_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def functions_for(threshold: float, recall: float, width: int) -> int:
    """Hash functions (bands of one row) that find an item of a size partition in its window."""
    least = width // 2 + 1 if width > 1 else 1
    held = threshold * least
    jaccard = held / (least + 2 * width - held)
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard))


class _Items:
    """A block of items in the form tasks search: per (words in a shingle, width) and hash function the sorted minima.

    A bitmap over some mixed bits of the minima tells most windows at once that
    no item has their minimum; only the rest are looked up.
    """

    def __init__(self, texts: list[str | None], threshold: float, recall: float):
        self.sets, self.lengths = [], []
        groups: dict[int, dict[int, list[int]]] = {}
        for i, t in enumerate(texts):
            words = shingles.words_of(t)
            n = min(shingles.WORDS, len(words))
            s = np.unique(shingles.shingle_hashes(shingles.hash_words(words)))
            self.sets.append(s)
            self.lengths.append(n)
            if n:
                groups.setdefault(n, {}).setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        self.parts: dict[int, list[tuple[np.uint64, list]]] = {}
        for n, by_width in sorted(groups.items()):
            counts = {w: functions_for(threshold, recall, w) for w in sorted(by_width)}
            factors, _ = shingles.permutations(max(counts.values()), SEED)
            self.parts[n] = [(x, [self._minima(x, w, by_width[w]) for w, k in counts.items() if f < k]) for f, x in enumerate(factors)]

    def _minima(self, factor: np.uint64, width: int, own: list[int]):
        low = np.array([(self.sets[i] * factor).min() for i in own], np.uint64)
        order = np.argsort(low, kind="stable")
        shift = np.uint64(64 - min(24, max(12, len(own).bit_length() + 7)))
        bits = np.zeros(1 << int(64 - shift), bool)
        bits[(low * _SPREAD) >> shift] = True
        return width, low[order], np.array(own)[order], bits, shift

    def candidates(self, n: int, s: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) for documents that stand one behind the other in ``s`` and end at ``ends``."""
        found: set[tuple[int, int]] = set()
        for factor, parts in self.parts[n]:
            at, block = 1, s * factor
            for width, low, own, bits, shift in parts:
                if width > at:
                    block, at = np.minimum.reduceat(block, np.arange(0, len(block), width // at)), width
                window = np.minimum(block[:-1], block[1:]) if len(block) > 1 else block
                for w in np.flatnonzero(bits[(window * _SPREAD) >> shift]).tolist():
                    left, right = np.searchsorted(low, window[w], "left"), np.searchsorted(low, window[w], "right")
                    if left < right:
                        first, last = np.searchsorted(ends, [w * width, min((w + 2) * width, len(s)) - 1], "right")
                        found.update((d, i) for d in range(int(first), int(last) + 1) for i in own[left:right].tolist())
        return found


def _hits(items: _Items, ids: list, threshold: float):
    def found_in(rows: list, hashes: list[np.ndarray]) -> list:
        out, unique = [], {}
        for n in items.parts:
            own = [shingles.shingle_hashes(w, n) if len(w) >= n else w[:0] for w in hashes]
            ends = np.cumsum([len(x) for x in own])
            if not ends[-1]:
                continue
            for d, i in sorted(items.candidates(n, np.concatenate(own), ends)):
                if (d, n) not in unique:
                    unique[d, n] = np.unique(own[d])
                s = items.sets[i]
                shared = len(np.intersect1d(s, unique[d, n], assume_unique=True)) if items.lengths[i] == n else 0
                if shared >= threshold * len(s) - 1e-9:
                    out.append((*rows[d], ids[i], shared, len(s)))
        return out

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, rows, hashes, size = [], [], [], 0
            for row, key, t in zip(frame["_row"], frame["key"], frame["t"], strict=True):
                rows.append((row, key))
                hashes.append(shingles.hash_words(shingles.words_of(t)))
                size += len(hashes[-1])
                if size >= _TOGETHER:
                    out += found_in(rows, hashes)
                    rows, hashes, size = [], [], 0
            if rows:
                out += found_in(rows, hashes)
            yield pd.DataFrame(out, columns=["_row", "key", "item", "n_shared", "n_shingles"])

    return search


def _blocks(benchmark: DataFrame, key: str, text: str, most: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of the items, block by block: running sums of their words deal them out."""
    size = F.size(F.split(common.text_or_empty(text), r"\s+"))
    slim = benchmark.select(F.col(key).alias("key"), F.col(text).alias("t"), size.alias("n"))
    slim = common.numbered(slim, ["key", "t"], "i")
    # the prefix sum runs over coarse groups of items first, then inside each
    coarse = slim.groupBy((F.col("i") / 4096).cast("long").alias("c")).agg(F.sum("n").alias("s"))
    before = coarse.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = F.sum("n").over(Window.partitionBy("c").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    dealt = slim.withColumn("c", (F.col("i") / 4096).cast("long")).join(before, "c")
    dealt = common.staged(dealt.withColumn("b", ((F.col("before") + F.coalesce(inside, F.lit(0))) / most).cast("long")))
    for (b,) in dealt.select("b").distinct().orderBy("b").toLocalIterator():
        own = dealt.filter(F.col("b") == b).select(F.col("key").cast("string").alias("key"), "t").toArrow()
        yield own["key"].to_pylist(), own["t"].to_pylist()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id",
    text: str = "text", item_key: str = "item_id", item_text: str = "text", most: int = MOST_SHINGLES,
) -> DataFrame:
    """(_row, key, item, n_shared, n_shingles) for each document that holds an item at the threshold."""
    # keys go as text, for pandas would make numbers with nulls inexact
    form = "_row long, key string, item string, n_shared long, n_shingles long"
    rows = common.with_row_id(docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("t")))
    found = docs.sparkSession.createDataFrame([], form)
    for ids, texts in _blocks(benchmark, item_key, item_text, most):
        items = _Items(texts, threshold, recall)
        if items.parts:
            found = found.unionByName(rows.mapInPandas(_hits(items, ids, threshold), form))
    kinds = {"key": dict(docs.dtypes)[key], "item": dict(benchmark.dtypes)[item_key]}
    return found.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    gone = common.staged(contaminated(docs, benchmark, **options).select("_row").distinct())
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = common.with_row_id(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return rows.join(gone, "_row", "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) at a shingle containment of 0.8 or more."""
    found = contaminated(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_shingles",
        F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"),
    )


QUERIES = {"op4_decontamination": op4_decontamination}

#: Words as Python's lower().split() has them, on text whose white space is ASCII.
SQL = r"""WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT kind, id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS g FROM w WHERE len(ws) >= 5),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n AS n_shingles, round(n_shared / n, 6) AS containment FROM p JOIN n ON n.id = p.item_id WHERE n_shared >= 0.8 * n - 1e-9"""

ORACLE_SQL = {"op4_decontamination": SQL}
