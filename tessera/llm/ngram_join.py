"""N-gram Jaccard join: MinHash banding, shuffled on band hashes, verified on full sets.

Documents with equal sets of five-word shingles form one copy class and go on
as its first document. Band and row counts follow from the threshold and the
target recall. A bucket of one band is dealt in blocks of ``BLOCK`` classes, a
task for each pair of blocks; a pair is looked at in its first common band
only. Verified pairs never become rows: a task sends the number of links of
each class and a spanning forest of them, both linear in its block.

Defined results: null and empty texts have no shingles and no links, each is a
group of its own; a text under five words is one shingle; repeated rows are
copies and link to each other; null doc_ids are allowed (the least known
doc_id of a group names it), and ids of any simple type; texts of any length are
taken whole; ties of id go by place; an empty table gives no rows; other columns
pass, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, common, components, shingles

THRESHOLD, RECALL, MOST_HASHES, SEED = 0.8, 0.999, 64, 6
BLOCK = 512
_FEW, _SLICE = 12, 4096


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, that reach the recall at the threshold."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        n = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if n * rows > most:
            break
        best = (n, rows)
    return best


def sketches(docs: DataFrame, key: str, text: str, threshold: float, recall: float) -> DataFrame:
    """(_row, key, set1, set2, bands): the set's 128-bit hash and a hash for each band; null without shingles."""
    n, rows = bands(threshold, recall)
    a, b = shingles.permutations(n * rows, SEED)

    def sketch(frames):
        for frame in frames:
            set1, set2, found = [], [], []
            for t in frame["t"]:
                s = np.unique(shingles.shingle_hashes(shingles.hash_words(shingles.words_of(t))))
                if not len(s):
                    set1.append(None), set2.append(None), found.append(None)
                    continue
                x = xxhash.xxh3_128_digest(s.tobytes())
                both = np.frombuffer(x, np.int64)
                set1.append(int(both[0])), set2.append(int(both[1]))
                lows = shingles.signature(s, a, b).reshape(n, rows)
                h = lows[:, 0]
                for i in range(1, rows):
                    h = shingles.mixed(h * np.uint64(31) + lows[:, i])
                found.append(h.view(np.int64))
            yield pd.DataFrame({"_row": frame["_row"], "key": frame["key"], "set1": pd.array(set1, "Int64"), "set2": pd.array(set2, "Int64"), "bands": found})

    # keys go as text, for pandas would make numbers with nulls inexact
    rows_in = common.with_row_id(docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("t")))
    found = rows_in.mapInPandas(sketch, "_row long, key string, set1 long, set2 long, bands array<long>")
    return found.withColumn("key", F.col("key").cast(dict(docs.dtypes)[key]))


def _first_common(vectors: np.ndarray, band: int, chunk: np.ndarray, i: int, j: int) -> np.ndarray:
    """Pairs of the bucket (upper triangle, between the two blocks) that no earlier band has together."""
    pairs = np.triu(np.ones((len(vectors), len(vectors)), bool), 1)
    if i != j:
        pairs &= chunk[:, None] != chunk[None, :]
    for x in range(band):
        pairs &= vectors[:, x][:, None] != vectors[:, x][None, :]
    return pairs


def _wanted(frames):
    """The classes of a block pair that have a pair of their own to verify there."""
    for g in batches.groups(frames, ["band", "hash", "i", "j"]):
        if len(g["rep"]) > 1:
            band, i, j = int(g["band"][0]), int(g["i"][0]), int(g["j"][0])
            pairs = _first_common(np.stack(g["bands"]), band, g["chunk"], i, j)
            own = np.flatnonzero(pairs.any(0) | pairs.any(1))
            if len(own):
                yield pd.DataFrame({c: g[c][own] for c in ("band", "hash", "i", "j", "chunk", "rep", "copies", "bands")})


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets (only where ``pairs`` holds, for few sets)."""
    n = len(sets)
    if n <= _FEW:
        out = np.zeros((n, n))
        for x, y in zip(*np.nonzero(pairs)):
            out[x, y] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    order = np.cumsum(count > 1) - 1
    owner, column = owner[shared], order[place[shared]]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    out = np.zeros((n, n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _SLICE):
        a, b = np.searchsorted(column, [start, start + _SLICE])
        m = np.zeros((n, _SLICE), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        out += m @ m.T
    return out


def _forest(links: np.ndarray) -> np.ndarray:
    """The least place of each place's component under a symmetric link matrix."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(threshold: float):
    def verify(frames):
        for g in batches.groups(frames, ["band", "hash", "i", "j"]):
            pairs = _first_common(np.stack(g["bands"]), int(g["band"][0]), g["chunk"], int(g["i"][0]), int(g["j"][0]))
            sets = [np.unique(shingles.shingle_hashes(shingles.hash_words(shingles.words_of(t)))) for t in g["t"]]
            size = np.array([len(s) for s in sets], float)
            common_ = _overlaps(sets, pairs)
            linked = pairs & (common_ >= threshold * (size[:, None] + size[None, :] - common_) - 1e-9)
            linked |= linked.T
            some = linked.any(1)
            if some.any():
                label, rep = _forest(linked), g["rep"]
                yield pd.DataFrame({"a": rep[some], "b": rep[label][some], "links": (linked @ g["copies"])[some]})

    return verify


def linked_documents(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: _row, key, n_links (other documents at or above the threshold), class_row and class_id (the group's first row, its least key).

    ``docs`` must be read from files, as rows are told apart by their place.
    """
    rows = common.staged(sketches(docs, key, text, threshold, recall))
    first = F.min(F.struct("key", "_row", "bands")).alias("first")
    classes = rows.filter("set1 is not null").groupBy("set1", "set2").agg(first, F.count("*").alias("copies"))
    classes = common.staged(classes.select("set1", "set2", "copies", F.col("first._row").alias("rep"), F.col("first.key").alias("rep_key"), F.col("first.bands").alias("bands")))

    each = classes.select("rep", "copies", "bands", F.posexplode("bands").alias("band", "hash"))
    buckets = each.groupBy("band", "hash").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = each.join(buckets, ["band", "hash"]).withColumn("blocks", blocks)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "band", "hash", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "copies", "bands"
    )
    keys = ["band", "hash", "i", "j"]
    form = "band int, hash long, i int, j int, chunk int, rep long, copies long, bands array<long>"
    wanted = common.staged(batches.by_key(dealt, keys).mapInPandas(_wanted, form))
    texts = common.with_row_id(docs.select(F.col(text).alias("t"))).withColumnRenamed("_row", "rep")
    to_verify = batches.by_key(wanted.join(texts, "rep"), keys)
    found = common.staged(to_verify.mapInPandas(_verified(threshold), "a long, b long, links long"))

    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components.components(found).withColumnRenamed("node", "rep")
    grouped = classes.join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = grouped.groupBy("root").agg(F.min(F.struct("rep_key", "rep")).alias("least"), F.min("rep_key").alias("class_id"))
    grouped = grouped.join(least, "root").select(
        "set1", "set2", F.col("least.rep").alias("class_row"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return rows.select("_row", "key", "set1", "set2").join(grouped, ["set1", "set2"], "left").select(
        "_row", "key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_row", "_row").alias("class_row"), F.coalesce("class_id", "key").alias("class_id")
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the least (key, place)."""
    gone = linked_documents(docs, threshold, recall, key, text).filter("class_row <> _row").select("_row")
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = common.with_row_id(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return rows.join(gone, "_row", "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class and its number of links at a Jaccard similarity of 0.8 or more."""
    return linked_documents(common.read(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "class_id", "n_links")


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
