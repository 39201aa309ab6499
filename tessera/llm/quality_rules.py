"""Quality rules: a threshold table compiled into Spark projections.

Every figure is a built-in expression over the whole text; no user functions,
no shuffle. A rule is a row of ``RULES``: a document that breaks any rule is
rejected, and the names of the broken rules are reported.

Defined results: a null or blank text has 0 words and is rejected; any other
column may be null; repeated rows are judged alike; columns of the input are
kept as they are (clashing names: the input's column gives way to the report's).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


class Rule(NamedTuple):
    name: str
    figure: str
    broken_if: str  # "<" or ">"
    bound: float


#: The table. Figures without a value (no words, no lines) break nothing here.
RULES = (
    Rule("few_words", "n_words", "<", 50),
    Rule("repeated_windows", "repeat_ratio", ">", 0.5),
    Rule("short_words", "mean_word_chars", "<", 2.0),
    Rule("long_words", "mean_word_chars", ">", 15.0),
    Rule("symbols", "symbol_ratio", ">", 0.1),
    Rule("few_stop_words", "stop_words", "<", 2),
    Rule("shouting", "upper_ratio", ">", 0.6),
    Rule("no_letters", "letter_ratio", "<", 0.6),
    Rule("bullets", "bullet_line_ratio", ">", 0.9),
    Rule("ellipses", "ellipsis_line_ratio", ">", 0.3),
    Rule("copied_lines", "dup_line_ratio", ">", 0.5),
)

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on a as by this was are from or an at not "
    "der die das und ist nicht von mit den dem ein eine zu auf für sich als auch im "
    "le la les de des et est un une que qui dans pour pas sur par au du en avec "
    "el los las y por con no se lo para es una su como más"
).split()

_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _without(column: Column, chars: str) -> Column:
    return F.translate(column, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are sorted by their words, so that equal ones stand together; the
    starts of repeated windows, sorted again, cover three words each less what
    the next window covers.
    """
    n = F.size(words)
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(
                F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")
            ),
        )
    )
    return F.when(n >= 4, windows)


def _covered(windows: Column) -> Column:
    def own(x, j):
        before, after = F.get(windows, j - 1)["g"], F.get(windows, j + 1)["g"]
        return F.when((x["g"] == before) | (x["g"] == after), x["i"])

    return F.sort_array(F.filter(F.transform(windows, own), lambda i: i.isNotNull()))


def with_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column for each figure; helper columns start with ``_q_``."""
    t, words, lines = F.col("_q_text"), F.col("_q_words"), F.col("_q_lines")
    n_words, n_lines = F.col("n_words"), F.col("_q_n_lines")
    starts = F.col("_q_starts")
    out = docs.withColumn("_q_text", common.text_or_empty(text))
    out = out.withColumns(
        {
            "_q_words": F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "_q_lines": F.filter(F.split(t, "\n"), lambda x: _without(x, _SPACE) != ""),
            "word_chars": F.length(_without(t, _SPACE)).cast("long"),
            "n_symbols": (F.length(t) - F.length(_without(t, _SYMBOLS))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "_q_n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "_q_windows": _repeat_words(words),
            "stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "_q_upper": F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long"),
            "_q_letter": F.size(F.filter(words, lambda w: F.upper(w) != F.lower(w))).cast("long"),
            "_q_bullets": F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long"),
            "_q_ellipses": F.size(
                F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))
            ).cast("long"),
        }
    )
    out = out.withColumn("_q_starts", _covered(F.col("_q_windows")))
    gaps = F.aggregate(
        F.transform(starts, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - i, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    out = out.withColumn("n_repeat_words", F.coalesce(gaps, F.lit(0)).cast("long"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    return out.withColumns(
        {
            "mean_word_chars": ratio("word_chars", n_words),
            "symbol_ratio": ratio("n_symbols", n_words),
            "repeat_ratio": ratio("n_repeat_words", n_words),
            "upper_ratio": ratio("_q_upper", n_words),
            "letter_ratio": ratio("_q_letter", n_words),
            "bullet_line_ratio": ratio("_q_bullets", n_lines),
            "ellipsis_line_ratio": ratio("_q_ellipses", n_lines),
            "dup_line_ratio": ratio("n_dup_lines", n_lines),
        }
    )


FIGURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stop_words", "mean_word_chars", "symbol_ratio",
    "repeat_ratio", "upper_ratio", "letter_ratio", "bullet_line_ratio", "ellipsis_line_ratio", "dup_line_ratio",
)


def compiled(rules=RULES) -> Column:
    """The rules as one expression: the array of broken rules' names."""

    def broken(r: Rule) -> Column:
        figure, bound = F.col(r.figure), F.lit(r.bound)
        return F.when(figure < bound if r.broken_if == "<" else figure > bound, F.lit(r.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with all figures, ``broken_rules`` (array) and ``kept``."""
    held = {f"_in_{i}": c for i, c in enumerate(docs.columns) if c not in FIGURES and c not in ("broken_rules", "kept")}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in held.items()], F.col(f"`{text}`").alias("_text"))
    named = with_figures(renamed, "_text").withColumn("broken_rules", compiled(rules))
    return named.select(*[F.col(n).alias(c) for n, c in held.items()], *FIGURES, "broken_rules", (F.size("broken_rules") == 0).alias("kept"))


def keep(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The documents that break no rule, with the input's columns only."""
    broken = common.free_name(docs, "broken_rules_of_text")
    held = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    figures = with_figures(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in held.items()]), held[text])
    passed = common.filter_after(figures.withColumn(broken, compiled(rules)), F.size(broken) == 0)
    return passed.select(*[F.col(n).alias(c) for c, n in held.items()])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures and the verdict of every row of ``documents``."""
    judged = judge(common.read(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"),
    )


_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: Rows of documents with the figures and verdict, as DuckDB SQL. ``{docs}`` is the table.
JUDGED_SQL = r"""
q_d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {docs}),
q_w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
               list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls FROM q_d),
q_i AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM q_w WHERE len(ws) >= 4),
q_g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM q_i),
q_r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM q_g WHERE c > 1) GROUP BY rid),
q_f AS (SELECT q_w.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(q_r.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda w: lower(w) IN ({stop_words}))) AS stop_words,
    len(list_filter(ws, lambda w: w = upper(w) AND w <> lower(w))) AS n_upper,
    len(list_filter(ws, lambda w: upper(w) <> lower(w))) AS n_letter,
    len(list_filter(ls, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•'))) AS n_bullets,
    len(list_filter(ls, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS n_ellipses
  FROM q_w LEFT JOIN q_r USING (rid)),
q_v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR n_repeat_words / n_words > 0.5 OR word_chars / n_words < 2 OR word_chars / n_words > 15
      OR n_symbols / n_words > 0.1 OR stop_words < 2 OR n_upper / n_words > 0.6 OR n_letter / n_words < 0.6
      OR n_bullets / n_lines > 0.9 OR n_ellipses / n_lines > 0.3 OR n_dup_lines / n_lines > 0.5) AS kept FROM q_f)
""".replace("{stop_words}", _LIST)

SQL = f"""WITH {JUDGED_SQL.replace("{docs}", "documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_v"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL = {"op8_quality_rules": SQL}
