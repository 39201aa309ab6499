"""LM scoring by cross-entropy difference (the Moore-Lewis criterion).

Two bigram models share one vocabulary, order and smoothing: the target model
counts the documents labelled good, the background model all documents. A
document's score is the mean over its tokens of target loss minus background
loss, in nats: the lower, the more like the target.

Counts cover every word, context and bigram of every document: the model grows
with the corpus and is never in one place. Documents are put in chunks of about
``CHUNK`` tokens, as numbers into the chunk's list of words. A chunk asks once
for each word, context and bigram in it, as a 64-bit hash with the chunk's own
counts; these requests are dealt by the hash's high bits into parts, whose number
follows the number of chunks. A part sums up its keys and answers each chunk in
the order of its requests. So a hot bigram is one entry for each chunk, a task
holds one chunk or one part, and only three sums reach the driver.

Defined results: null and blank texts have no tokens and null losses; labels
that are null or for unknown documents count nothing, a document labelled twice
is good if any label says so; repeated rows are counted and scored each; without
labelled documents the target model is uniform smoothing. A caller may ask for a
vocabulary of the ``size`` most frequent words (ties: by the word), all others
are then one unknown word; the query does not. Other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, common, shingles

PRIOR = 50.0
#: Tokens of a chunk (a document is never cut), and the least number of parts, as a power of two.
CHUNK, LEAST_BITS = 1_000_000, 10
#: Labels that are broadcast to the documents; beyond it the join shuffles.
MOST_BROADCAST_LABELS = 1_000_000
_FLUSH = 400_000
UNKNOWN, START = np.uint64(0), np.uint64(1)
_WORD = np.uint64(1)
_CONTEXT = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(docs: DataFrame, size: int, text: str = "text") -> list[str]:
    """The most frequent words of all documents."""

    def count(frames):
        seen: Counter[str] = Counter()
        for frame in frames:
            for t in frame["t"]:
                seen.update(shingles.words_of(t))
                if len(seen) > _FLUSH:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"word": object, "n": "int64"})

    counts = docs.select(F.col(text).alias("t")).mapInPandas(count, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in top.collect()]


@dataclass
class Model:
    """Documents to count, with ``good`` marking those of the target; ``words`` is null for the whole vocabulary."""

    docs: DataFrame
    rows: DataFrame
    words: list[str] | None


def train(docs: DataFrame, good: DataFrame, key: str = "doc_id", text: str = "text", size: int | None = None) -> Model:
    """``good`` has the keys of the target documents in column ``key``."""
    marked = good.select(F.col(key).alias("_good")).where(F.col("_good").isNotNull()).distinct()
    if marked.count() <= MOST_BROADCAST_LABELS:
        marked = F.broadcast(marked)
    weight = F.when(F.col("_good").isNull(), 1).otherwise(2)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    rows = slim.join(marked, F.col("key") == F.col("_good"), "left").select("key", "t", weight.alias("weight"))
    return Model(docs, rows, None if size is None else vocabulary(docs, size, text))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in their narrowest width, byte by byte of all, compressed."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, kind: type = np.int64) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(pa.decompress(blob[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"u{width}").ravel().astype(kind)


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences, which need fewer bytes."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _chunks(known: np.ndarray | None, most: int):
    """Rows (key, t, weight) as chunks; weight 2 counts in both models, 1 in the background, 0 in none."""

    def packed(place, hashes, weights, keys):
        codes, words = pd.factorize(np.concatenate(hashes))
        own = pa.concat_arrays(keys)
        blobs = [words.astype(np.uint64), codes, np.array([len(h) for h in hashes]), np.array(weights)]
        columns = [pa.array([place], pa.int64()), *[pa.array([_packed(x)], pa.binary()) for x in blobs]]
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
        return pa.RecordBatch.from_arrays(columns, ["chunk", "words", "codes", "sizes", "weights", "keys"])

    def chunk(record_batches):
        place = TaskContext.get().partitionId() << 32
        hashes, weights, keys, tokens = [], [], [], 0
        for batch in record_batches:
            start = 0
            for i, (t, weight) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                h = shingles.hash_words(shingles.words_of(t))
                if known is not None:
                    h[~np.isin(h, known)] = UNKNOWN
                hashes.append(h)
                weights.append(weight)
                tokens += len(h)
                if tokens >= most:
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    yield packed(place, hashes, weights, keys)
                    hashes, weights, keys, tokens, start, place = [], [], [], 0, i + 1, place + 1
            if start < batch.num_rows:
                keys.append(batch.column(0).slice(start))
        if hashes:
            yield packed(place, hashes, weights, keys)

    return chunk


class _Chunk:
    """A chunk's tokens as places in its lists of words and distinct bigrams, and its sorted request keys."""

    def __init__(self, words: bytes, codes: bytes, sizes: bytes, weights: bytes):
        hashes = np.append(_unpacked(words, np.uint64), START)
        self.word, self.sizes = _unpacked(codes), _unpacked(sizes)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.weight = _unpacked(weights)[self.text]
        self.n_words = len(hashes)
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = self.n_words - 1
        self.pair, pairs = pd.factorize(self.before * self.n_words + self.word)
        self.pair_before, self.pair_word = pairs // self.n_words, pairs % self.n_words
        mixed = shingles.mixed
        two = mixed(mixed(hashes[self.pair_before]) * _PAIR + hashes[self.pair_word])
        # the last bit tells words from contexts and bigrams
        keys = np.concatenate([mixed(hashes) | _WORD, mixed(hashes ^ _CONTEXT) & ~_WORD, two & ~_WORD])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def cuts(self, bits: int) -> np.ndarray:
        """Where the keys of each part begin and end."""
        return np.searchsorted(self.keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))

    def counts(self) -> list[np.ndarray]:
        """The chunk's own counts (target, background) in order of the keys."""
        out = []
        for least in (2, 1):
            some = self.weight >= least
            own = [np.bincount(x[some], minlength=n) for x, n in ((self.word, self.n_words), (self.before, self.n_words), (self.pair, len(self.pair_word)))]
            out.append(np.concatenate(own)[self.order])
        return out

    def losses(self, counts: np.ndarray, n_tokens: int, n_words: int) -> np.ndarray:
        """Each text's loss, out of the model's counts in order of the keys."""
        all_ = np.empty(len(counts), np.int64)
        all_[self.order] = counts
        alone, own, pair = np.split(all_, [self.n_words, 2 * self.n_words])
        smooth = (alone[self.pair_word] + 0.5) / (n_tokens + 0.5 * n_words)
        loss = -np.log((pair + PRIOR * smooth) / (own[self.pair_before] + PRIOR))
        return np.bincount(self.text, loss[self.pair], len(self.sizes)) / np.maximum(self.sizes, 1)


_BLOBS = ("words", "codes", "sizes", "weights")


def _requests(bits: int):
    def ask(frames):
        for frame in frames:
            for row in frame.itertuples():
                chunk = _Chunk(*[getattr(row, x) for x in _BLOBS])
                target, background = chunk.counts()
                cuts = chunk.cuts(bits)
                some = np.flatnonzero(cuts[1:] > cuts[:-1])
                spans = [slice(cuts[i], cuts[i + 1]) for i in some]
                yield pd.DataFrame({
                    "part": some, "chunk": row.chunk, "keys": [_steps(chunk.keys[s]) for s in spans],
                    "target": [_packed(target[s]) for s in spans], "background": [_packed(background[s]) for s in spans],
                })

    return ask


def _answers(frames):
    for part in batches.groups(frames, ["part"]):
        each = [np.cumsum(_unpacked(k, np.uint64)) for k in part["keys"]]
        sizes = [len(k) for k in each]
        keys = np.concatenate(each)
        order = np.argsort(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        words = (keys[first] & _WORD) == _WORD
        out, sums = {}, []
        for name in ("target", "background"):
            own = np.concatenate([_unpacked(b) for b in part[name]])
            total = np.add.reduceat(own[order], first)
            sums.append(total[words])
            answer = np.empty(len(keys), np.int64)
            answer[order] = total[group]
            out[name] = [_packed(x) for x in np.split(answer, np.cumsum(sizes)[:-1])]
        # the part's sums stand in one of its rows
        one = np.arange(len(sizes)) == 0
        sums = {"n_target": sums[0].sum(), "n_background": sums[1].sum(), "n_words": (sums[1] > 0).sum()}
        yield pd.DataFrame({"part": part["part"], "chunk": part["chunk"], **out, **{k: one * int(v) for k, v in sums.items()}})


def _scores(tokens: tuple[int, int], n_words: int):
    def score(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: chunks.column(c)[0] for c in chunks.column_names}
        chunk = _Chunk(*[row[x].as_py() for x in _BLOBS])
        answers = answers.sort_by("part")
        found = []
        for name, n in zip(("target", "background"), tokens, strict=True):
            counts = np.concatenate([_unpacked(b) for b in answers.column(name).to_pylist()])
            found.append(pa.array(chunk.losses(counts, n, n_words)))
        return pa.table([row["keys"].values, pa.array(chunk.sizes), *found], ["key", "n_tokens", "target_loss", "background_loss"])

    return score


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, target_loss, background_loss, score) of every document."""
    kind = dict(docs.dtypes)[key]
    known = None if model.words is None else shingles.hash_words(model.words)
    form = f"chunk long, words binary, codes binary, sizes binary, weights binary, keys array<{kind}>"
    rows = model.rows if docs is model.docs else docs.select(F.col(key).alias("key"), F.col(text).alias("t"), F.lit(0).alias("weight"))
    chunks = common.staged(rows.mapInArrow(_chunks(known, CHUNK), form))
    counted = chunks
    if docs is not model.docs:
        # chunks that only count get numbers below zero and are not scored
        other = model.rows.withColumn("key", F.lit(None).cast(kind)).mapInArrow(_chunks(known, CHUNK), form)
        counted = common.staged(chunks.unionByName(other.withColumn("chunk", -1 - F.col("chunk"))))
    bits = max(LEAST_BITS, (counted.count() // 2).bit_length())
    asked = counted.select("chunk", *_BLOBS).mapInPandas(_requests(bits), "part long, chunk long, keys binary, target binary, background binary")
    form = "part long, chunk long, target binary, background binary, n_target long, n_background long, n_words long"
    answers = common.staged(batches.by_key(asked, ["part"]).mapInPandas(_answers, form))
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_target", "n_background", "n_words")]).first()
    n_words = (sums[2] if model.words is None else len(model.words)) + 2
    replies = answers.filter("chunk >= 0").select("part", "chunk", "target", "background").groupBy("chunk")
    form = f"key {kind}, n_tokens long, target_loss double, background_loss double"
    out = chunks.groupBy("chunk").cogroup(replies).applyInArrow(_scores((sums[0], sums[1]), n_words), form)
    losses = {c: F.when(F.col("n_tokens") > 0, F.round(c, 6)) for c in ("target_loss", "background_loss")}
    out = out.withColumn("score", F.when(F.col("n_tokens") > 0, F.round(F.col("target_loss") - F.col("background_loss"), 6)))
    return out.withColumns(losses)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference between good documents and all documents."""
    docs = common.read(spark, sf_dir, "documents")
    good = common.read(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return scored(docs, train(docs, good)).withColumnRenamed("key", "doc_id")


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
