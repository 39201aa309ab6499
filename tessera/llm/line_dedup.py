"""Line dedup: suffix array over line IDs by prefix doubling, later copies of runs deleted.

The corpus is a sequence of line IDs with an end mark after each document.
Level k of the doubling ranks every suffix by its first 2^k lines: the ranks of
level k-1 at i and at i + 2^(k-1), sorted, give those of level k. Suffixes that
share a rank are one interval of the suffix array whose longest common prefix
is at least 2^k lines; for a height w between 2^k and 2^(k+1) the interval is
that of two ranks of level k, at i and at i + w - 2^k. A suffix alone in its
interval takes part no longer, so a level holds only places where a run of 2^k
lines occurs twice or more.

A run is deleted where it has ``min_chars`` characters or more and occurs
earlier (by doc_id, row, line). A maximal repeated run is the union of its least
windows: from each of its lines on, and up to each of its lines, the fewest
lines with ``min_chars`` characters. Each such window is looked up in the
interval of its own height, and all but the interval's first place are copies;
so runs of any number of lines count with the length they have, the tests need
no more levels than a window of ``min_chars`` one-letter lines, and the first
text of a run stays whole.

Blank lines are no part of the sequence and stay as they are. Defined results:
null text counts as empty and has no lines to delete; null doc_ids sort first; repeated
rows are told apart by their place in the input, the first stays whole; a
document all of whose lines are copies gets an empty text; texts and lines of any
length are taken whole; an empty table gives no rows; other columns pass, whatever
their names. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 20
_SPACE = " \t\n\x0b\f\r"


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line that is not blank: _row, key, idx (among these), line (among all), h1, h2, chars."""
    rows = common.with_row_id(docs.select(F.col(key).alias("key"), common.text_or_empty(text).alias("t")))
    each = F.transform(F.split("t", "\n"), lambda s, i: F.struct(i.alias("line"), s.alias("s")))
    each = F.filter(each, lambda x: F.translate(x["s"], _SPACE, "") != "")
    return rows.select("_row", "key", F.posexplode(each).alias("idx", "x")).select(
        "_row", "key", "idx", "x.line", F.xxhash64("x.s").alias("h1"), F.hash("x.s").alias("h2"), F.length("x.s").cast("long").alias("chars")
    )


def _windows(lines: DataFrame, min_chars: int) -> DataFrame:
    """(_row, start, width, level): from each line on, and up to each, the fewest lines of at least ``min_chars`` characters."""
    in_row = Window.partitionBy("_row").orderBy("idx")
    sums = lines.select("_row", "idx", "chars").withColumn("end", F.sum("chars").over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("begin", F.col("end") - F.col("chars")).withColumn("all", F.max("end").over(Window.partitionBy("_row")))
    more = F.count("*").over(Window.partitionBy("_row").orderBy("begin").rangeBetween(0, min_chars - 1))
    less = F.count("*").over(Window.partitionBy("_row").orderBy("end").rangeBetween(1 - min_chars, 0))
    sums = sums.withColumns({"more": more, "less": less})
    ahead = sums.filter(F.col("begin") + min_chars <= F.col("all")).select("_row", F.col("idx").alias("start"), F.col("more").alias("width"))
    back = sums.filter(F.col("end") >= min_chars).select("_row", (F.col("idx") - F.col("less") + 1).alias("start"), F.col("less").alias("width"))
    found = ahead.union(back).select("_row", F.col("start").cast("int").alias("start"), F.col("width").cast("int").alias("width")).distinct()
    return found.withColumn("level", (F.length(F.bin("width")) - 1).cast("int"))


def _with_group(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (staged) with the columns of their group; ``groups`` (staged) has n > 1, the size."""
    hot = groups.filter(F.col("n") * common.HOT > rows.count()).select(*on)
    return common.join_groups(rows, groups.drop("n"), on, hot)


def _intervals(rows: DataFrame, on: list[str]) -> DataFrame:
    """(on, n, first) of the groups with two places or more; first is the least place."""
    place = F.min(F.struct("key", "_row", "idx")).alias("first")
    return rows.groupBy(*on).agg(F.count("*").alias("n"), place).filter("n > 1")


def repeated_runs(lines: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Places (_row, idx, line) of repeated lines, and the windows (_row, idx, width) that are copies of an earlier one.

    ``lines`` must be staged.
    """
    min_chars = max(1, min_chars)
    wanted = common.staged(_windows(lines, min_chars))
    on, width, places, copied = ["h1", "h2"], 1, None, None
    level = lines
    while True:
        ranked = common.numbered(_intervals(level, on).drop("first"), on, "rank")
        level = common.staged(_with_group(level, common.staged(ranked), on).drop(*on))
        places = level if places is None else places
        # windows at least as high as this level, and not as the next one
        own = wanted.filter(F.col("level") == width.bit_length() - 1)
        begin = level.select("key", "_row", "idx", F.col("rank").alias("rank1"))
        end = level.select("_row", F.col("idx").alias("at"), F.col("rank").alias("rank2"))
        high = own.withColumn("at", F.col("start") + F.col("width") - width).withColumnRenamed("start", "idx")
        high = common.staged(high.join(begin, ["_row", "idx"]).join(end, ["_row", "at"]).drop("at", "level"))
        every = ["width", "rank1", "rank2"]
        members = _with_group(high, common.staged(_intervals(high, every)), every)
        members = members.filter(F.struct("key", "_row", "idx") != F.col("first")).select("_row", "idx", "width")
        copied = members if copied is None else copied.unionByName(members)
        if 2 * width > min_chars or level.isEmpty():
            return places, copied
        ahead = level.select("_row", (F.col("idx") - width).alias("idx"), F.col("rank").alias("rank2"))
        level = common.staged(level.withColumnRenamed("rank", "rank1").join(ahead, ["_row", "idx"]))
        on, width = ["rank1", "rank2"], 2 * width


def _between(lines: str, gone: str) -> Column:
    """The lines without those numbered in ``gone`` (ascending), as slices: linear in the document."""
    ends = F.concat(F.col(gone), F.array(F.size(lines)))

    def slice_before(end, j):
        after = F.coalesce(F.get(F.col(gone), j - 1), F.lit(-1))
        return F.slice(F.col(lines), after + 2, end - after - 1)

    return F.flatten(F.transform(ends, slice_before))


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text", counts: bool | tuple[str, str] = False
) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``.

    ``counts`` adds n_lines (all lines) and n_removed, under the two names where they are given.
    ``docs`` must be read from files.
    """
    lines = common.staged(_lines(docs, key, text))
    places, starts = repeated_runs(lines, min_chars)
    starts = starts.groupBy("_row", "idx").agg(F.max("width").alias("width"))
    reach = F.max(F.col("idx") + F.col("width")).over(Window.partitionBy("_row").orderBy("idx"))
    removed = (
        places.select("_row", "idx", "line")
        .join(starts, ["_row", "idx"], "left")
        .select("_row", "line", (reach > F.col("idx")).alias("gone"))
        .filter("gone")
    )
    touched = removed.groupBy("_row").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = common.with_row_id(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    joined = rows.join(touched, "_row", "left")
    joined = joined.withColumn("_split", F.split(common.text_or_empty(names[text]), "\n"))
    kept = F.when(F.col("gone").isNull(), F.col(names[text])).otherwise(F.array_join(_between("_split", "gone"), "\n"))
    out = [kept.alias(c) if c == text else F.col(n).alias(c) for c, n in names.items()]
    if counts:
        n_lines, n_removed = ("n_lines", "n_removed") if counts is True else counts
        out += [F.size("_split").cast("long").alias(n_lines), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_removed)]
    return joined.select(*out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines counted, removed and kept, and a digest of the kept text."""
    done = dedup_lines(common.read(spark, sf_dir, "documents"), counts=True)
    kept = common.text_or_empty("text")
    return done.select(
        "doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256")
    )


def _sql(docs: str) -> str:
    """Deduped documents as common table expressions; the last is ld_out (the columns of docs, n_lines, n_removed).

    Windows of every width up to ``MIN_CHARS`` lines are compared. A longer repeated run is made up of such ones,
    as a window of that many lines that are not blank has enough characters.
    """
    parts = [
        f"ld_d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, * FROM {docs})",
        "ld_a AS (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM ld_d)",
        r"ld_0 AS (SELECT rid, ln, s AS g, md5(s) AS h, length(s) AS c, row_number() OVER (PARTITION BY rid ORDER BY ln) AS i FROM ld_a WHERE regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g') <> '')",
        "ld_l AS (SELECT rid, i, h, c FROM ld_0)",
        "ld_1 AS (SELECT rid, i, h AS g, c FROM ld_0)",
    ]
    for w in range(2, MIN_CHARS + 1):
        parts.append(f"ld_{w} AS (SELECT a.rid, a.i, md5(a.g || b.h) AS g, a.c + b.c AS c FROM ld_{w - 1} a JOIN ld_l b ON a.rid = b.rid AND b.i = a.i + {w - 1})")
    windows = " UNION ALL ".join(
        f"SELECT rid, i, {w} AS w FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rid, i) AS n FROM ld_{w} WHERE c >= {MIN_CHARS}) WHERE n > 1"
        for w in range(1, MIN_CHARS + 1)
    )
    parts += [
        f"ld_w AS (SELECT rid, i, max(w) AS w FROM ({windows}) GROUP BY rid, i)",
        "ld_g AS (SELECT rid, ln FROM (SELECT a.rid, a.ln, a.i, max(a.i + w) OVER (PARTITION BY a.rid ORDER BY a.i) AS e "
        "FROM ld_0 a LEFT JOIN ld_w b ON a.rid = b.rid AND a.i = b.i) WHERE e > i)",
        "ld_t AS (SELECT a.rid, string_agg(s, chr(10) ORDER BY a.ln) AS kept FROM ld_a a ANTI JOIN ld_g g ON a.rid = g.rid AND a.ln = g.ln GROUP BY a.rid)",
        "ld_n AS (SELECT rid, count(*) AS n FROM ld_g GROUP BY rid)",
        "ld_out AS (SELECT d.* REPLACE (CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(t.kept, '') END AS text), "
        "len(string_split(coalesce(d.text, ''), chr(10))) AS n_lines, coalesce(n.n, 0) AS n_removed "
        "FROM ld_d d LEFT JOIN ld_t t ON d.rid = t.rid LEFT JOIN ld_n n ON d.rid = n.rid)",
    ]
    return ",\n".join(parts)


SQL = f"""WITH {_sql("documents")}
SELECT doc_id, n_lines, n_removed, length(coalesce(text, '')) AS kept_chars, sha256(coalesce(text, '')) AS kept_sha256 FROM ld_out"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL = {"op3_line_dedup": SQL}
