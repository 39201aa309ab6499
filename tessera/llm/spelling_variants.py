"""Groups of spelling variants: words of a corpus and their neighbours at one edit.

Words are counted in the JVM. A pair at one edit, whose shorter word has m letters,
shares a prefix and a suffix of m - 1 letters together. So either the prefix or the
suffix has (m - 1) / 2, and each word goes into buckets by such keys; a bucket with
too many words is parted again in the same way around the rest of its letters, until
the key leaves one letter open, so no bucket grows with the corpus. A pair meets in
one bucket only: the one that the length of its whole common prefix names.

In a bucket, words are bits. For each position and letter a bitset holds the words
with that letter there, built position by position. All of the bucket's words then
run over the bitsets together: Z holds the words equal so far; where a word leaves Z
it enters three sets of one error, which go on comparing at the same position, one
further, and one back. What is in them in the end, at the length that belongs to the
set, is near. Bits are in order of (count, word), so the best near word is the lowest
bit. A task gives back a count and a best word for each word, never pairs.

Forms are followed to roots by doubling the pointers.

Defined results: null texts have no words, a null doc_id counts as an empty one in
the corrupting hash; words of any length and letters as the pattern allows; repeated
rows count again; ties go to the word smaller in code points; an empty table or one
without frequent words gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_LETTERS, LEAST_COUNT, CORRUPT, RATIO = 5, 3, 97, 2
#: A bucket of more words is parted by longer keys.
BUCKET = 2048
#: Letters, and pairs of a word and a lane of 64 others, that run together.
_LETTERS, _PAIRS = 4_000_000, 1_000_000
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", corrupt: int = CORRUPT, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of five and more, one in ``corrupt`` without one of its letters, that occur often enough."""
    # shorter runs stay too short; the pattern takes a run whole or not at all
    found = F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LETTERS},}}"), F.lit(0))
    start = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(start.alias("start"), F.explode(found).alias("run"))
    lower = runs.select("start", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("start", "run")).alias("h"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    word = F.when(F.pmod("h", F.lit(corrupt).cast("long")) != 0, F.col("run")).otherwise(
        F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    )
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= least))


def _bucketed(rows: DataFrame) -> DataFrame:
    """With the letters that a word shows to its bucket: those before a, and those that must agree behind an edit before ``below``."""
    back = F.expr("right(word, greatest(m - below, 0))")
    return rows.withColumn("key", F.concat_ws(" ", F.expr("left(word, a)"), back))


def _first_buckets(vocabulary: DataFrame) -> DataFrame:
    """Each word as shorter (or equal) and as longer one of a pair; the edit lies in front of the middle or behind it.

    The edit is at the end of the common prefix: a <= its length < below.
    """
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = vocabulary.select("word", "n", lengths.alias("m")).filter(F.col("m") >= LEAST_LETTERS)
    return _parted(rows.select("*", F.lit(0).alias("a"), (F.col("m") + 1).alias("below")))


def _parted(rows: DataFrame) -> DataFrame:
    """Each row in the two buckets that part its own; their keys are equally long."""
    middle = F.expr("(a + below) div 2").cast("int")
    halves = F.array(F.struct(middle.alias("a"), F.col("below")), F.struct(F.col("a"), middle.alias("below")))
    parts = rows.select("word", "n", "m", F.explode(halves).alias("s")).select("word", "n", "m", "s.a", "s.below")
    return _bucketed(parts)


_BUCKET_COLUMNS = ["m", "a", "below", "key"]


def buckets(vocabulary: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(m, a, below, key, word, n): every word in its buckets, none of which has many more than ``bucket`` words."""
    rows, done = common.staged(_first_buckets(vocabulary)), None
    while True:
        sizes = rows.groupBy(*_BUCKET_COLUMNS).agg(F.count("*").alias("_n"))
        hot = common.staged(sizes.filter((F.col("_n") > bucket) & (F.col("below") - F.col("a") > 1)).select(*_BUCKET_COLUMNS))
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        # a large bucket's rows meet its key in many tasks
        salts = rows.sparkSession.sparkContext.defaultParallelism
        side = hot.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int"))
        on = [*_BUCKET_COLUMNS, "_salt"]
        kept = salted.join(side, on, "left_anti").drop("_salt")
        done = kept if done is None else done.unionByName(kept)
        rows = common.staged(_parted(salted.join(side, on, "left_semi")))


def _near(m: int, a: np.ndarray, below: np.ndarray, size: np.ndarray, letters: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: how many words of its bucket are at one edit, and the least place of one in the bucket.

    ``a`` and ``below`` are per bucket, ``size`` its words, which follow one another.
    ``letters`` is a matrix of numbers from 1, 0 behind a word's end.
    """
    first = np.cumsum(size) - size
    lanes = -(-size // 64)
    lane0 = np.cumsum(lanes) - lanes
    bucket = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(letters)) - first[bucket]
    lane, bit = lane0[bucket] + place // 64, _ONE << (place % 64).astype(np.uint64)
    n_lanes, alphabet = int(lanes.sum()), int(letters.max()) + 1

    def slice_at(i: int) -> np.ndarray:
        """For each letter and lane the words with that letter at place i; letter 0 has none."""
        out = np.zeros(alphabet * n_lanes, np.uint64)
        if 0 <= i < letters.shape[1]:
            own = letters[:, i] > 0
            np.bitwise_or.at(out, letters[own, i] * n_lanes + lane[own], bit[own])
        return out

    of_length = np.zeros((2, n_lanes), np.uint64)
    np.bitwise_or.at(of_length, (length - m, lane), bit)

    # a row for each word and each lane of its bucket
    times = lanes[bucket]
    begin = np.cumsum(times) - times
    word = np.repeat(np.arange(len(letters)), times)
    within = np.arange(len(word)) - begin[word]
    at = lane0[bucket[word]] + within
    low, high = a[bucket[word]], below[bucket[word]]
    short, long = np.flatnonzero(length[word] == m), np.flatnonzero(length[word] > m)
    everyone = np.zeros(n_lanes, np.uint64)
    np.bitwise_or.at(everyone, lane, bit)
    zero_s, zero_l = everyone[at[short]], everyone[at[long]]
    same, longer, shorter = np.zeros_like(zero_s), np.zeros_like(zero_s), np.zeros_like(zero_l)
    before, here = slice_at(-1), slice_at(0)
    for i in range(m + 1):
        after = slice_at(i + 1)
        code = letters[word[long], i] * n_lanes + at[long]
        equal = here[code]
        leaves = np.where((low[long] <= i) & (i < high[long]), zero_l & ~equal, 0)
        shorter = (shorter & before[code]) | leaves
        zero_l &= equal
        if i < m:
            code = letters[word[short], i] * n_lanes + at[short]
            equal = here[code]
            leaves = np.where((low[short] <= i) & (i < high[short]), zero_s & ~equal, 0)
            same = (same & equal) | leaves
            longer = (longer | leaves) & after[code]
            zero_s &= equal
        before, here = here, after
    near = np.zeros(len(word), np.uint64)
    longer |= np.where(high[short] > m, zero_s, 0)
    near[short] = (same & of_length[0, at[short]]) | (longer & of_length[1, at[short]])
    near[long] = shorter & of_length[0, at[long]]
    count = np.add.reduceat(np.bitwise_count(near).astype(np.int64), begin)
    lowest = np.bitwise_count((near & (~near + _ONE)) - _ONE).astype(np.int64)
    best = np.minimum.reduceat(np.where(near > 0, within * 64 + lowest, len(letters)), begin)
    return count, best


def _found(frame: pd.DataFrame) -> pd.DataFrame:
    """Near words of whole buckets of one m, which follow one another."""
    m = int(frame["m"].iloc[0])
    a, below, key = frame["a"].to_numpy(), frame["below"].to_numpy(), frame["key"].to_numpy()
    new = np.ones(len(frame), bool)
    new[1:] = (a[1:] != a[:-1]) | (below[1:] != below[:-1]) | (key[1:] != key[:-1])
    number = np.cumsum(new) - 1
    size = np.bincount(number)
    kept = size[number] > 1
    if not kept.any():
        return frame.iloc[:0].assign(near=0, best_n=0, best="")[["word", "near", "best_n", "best"]]
    word, n, a, below, size = frame["word"].to_numpy()[kept], frame["n"].to_numpy()[kept], a[new][size > 1], below[new][size > 1], size[size > 1]
    letters = np.array(word, dtype=f"U{m + 1}").view(np.uint32).reshape(len(word), m + 1)
    length = (letters > 0).sum(1)
    values = np.unique(letters)
    values = values[values > 0]
    letters = np.where(letters > 0, np.searchsorted(values, letters) + 1, 0)
    first = np.cumsum(size) - size
    count, best = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    # so many buckets together as fit in the bound, one at least
    pairs = np.cumsum(size * -(-size // 64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + _PAIRS, "right")))
        rows = slice(int(first[at]), int(first[to - 1] + size[to - 1]))
        count[rows], best[rows] = _near(m, a[at:to], below[at:to], size[at:to], letters[rows], length[rows])
        at = to
    has = np.flatnonzero(count)
    place = np.repeat(first, size)[has] + best[has]
    return pd.DataFrame({"word": word[has], "near": count[has], "best_n": n[place], "best": word[place]})


def _whole_buckets(frames):
    """Frames of whole buckets of one m out of sorted frames."""
    rest: list[pd.DataFrame] = []
    held = 0
    for frame in frames:
        if not len(frame):
            continue
        # bounded by letters, and at every change of m
        m = frame["m"].to_numpy()
        cuts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(frame)]
        for x, y in zip(cuts, cuts[1:]):
            part = frame.iloc[x:y]
            if rest and rest[-1]["m"].iloc[-1] != part["m"].iloc[0]:
                yield pd.concat(rest)
                rest, held = [], 0
            rest.append(part)
            held += len(part) * int(part["m"].iloc[0])
            if held > _LETTERS:
                whole = pd.concat(rest)
                a, below, key = (whole[c].to_numpy() for c in ("a", "below", "key"))
                last = np.flatnonzero((a[1:] != a[:-1]) | (below[1:] != below[:-1]) | (key[1:] != key[:-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield whole.iloc[:cut]
                rest, held = [whole.iloc[cut:]], (len(whole) - cut) * int(whole["m"].iloc[0])
    if rest:
        yield pd.concat(rest)


def near_words(vocabulary: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, n_near, best, best_n) of every word with a near one; the best has the largest n, of several the smallest."""
    rows = common.staged(buckets(vocabulary, bucket))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 50_000))
    dealt = rows.repartition(parts, *_BUCKET_COLUMNS).sortWithinPartitions(*_BUCKET_COLUMNS, F.desc("n"), "word")

    def run(frames):
        for frame in _whole_buckets(frames):
            yield _found(frame)

    found = dealt.mapInPandas(run, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.word").alias("best"), (-F.col("_b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms of each word in (word, form), which has no circle."""
    held = common.staged(forms.select("word", F.col("form").alias("root")))
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = common.staged(common.join_groups(held, further, ["root"], how="left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        held = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return held


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    vocabulary = common.staged(words(docs, key, text))
    near = near_words(vocabulary).select(F.col("word").alias("_word"), "n_near", "best", "best_n")
    joined = vocabulary.join(near, F.col("word") == F.col("_word"), "left")
    strong = F.col("best_n") >= ratio * F.col("n")
    own = common.staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")))
    ends = roots(own.filter("form IS NOT NULL")).withColumnRenamed("word", "_word")
    return own.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with their near words, forms and roots."""
    return variants(common.read(spark, sf_dir, "documents"))


#: The checksum comes from a table made here; near pairs meet by a word's letters without one.
SQL = r"""WITH RECURSIVE tables AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS start, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT run, n, list_concat([4294967295], list_transform(range(1, octet_length(encode(start || run)) + 1),
    lambda i: CAST('0x' || substr(hex(encode(start || run)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, tables),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * words.n THEN near END AS form, CASE WHEN near_n >= 2 * words.n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, coalesce(c.root, f.word) AS root, f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c USING (word)"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE_SQL = {"op11_spelling_variants": SQL}
