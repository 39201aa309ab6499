"""PII by bootstrapped contextual extraction, in DataFrame functions only.

Four seed kinds are found by fixed forms (email, ip, card, phone; with checks of
ranges, the Luhn sum and digit counts); of a fifth, secret, a share of the long
mixed or hexadecimal tokens (one in ``SEED_SHARE``, by hash) stand in for a list
of known ones. Every identifier-shaped token of the corpus is an instance, the
words around it are patterns. A pattern's confidence for a kind is the share of
its instances that are believed to be of the kind, among those believed to be of
any and those that look like none of the kind's seeds (by characters and
length). Confident patterns give belief to unseen instances; those believed
enough count as known from then on, round by round until none is added. The
graph's edges are distinct pairs with no row per occurrence. In the end each
token that confident patterns believe to be of a kind adds a span, secret seeds too:
no form but the four fixed ones adds a span by itself. Spans of the fixed forms
always stay, and an added span never overlaps one; of added spans within each
other the longest stays.

Positions come from the texts between the matches (a split by the same
pattern), summed up per document. Patterns are possessive forms of the stated
ones, so that no text, however long, recurses or backtracks.

Defined results: a null text is empty and has no spans; null doc_ids and
repeated rows are kept row by row; texts, tokens and words of any length are
taken whole; ties of belief go to the later kind by name; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The kinds in their order, and their forms. Each is the stated form with possessive loops;
#: \G and the lookbehind let a match start only where an earlier one ended or a run begins, as elsewhere none can.
KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = "secret"
#: Runs of tokens with a digit or an at sign: where instances are looked for.
TOKEN = r"(?<!\S)\S*[0-9@]\S*(?:\x20\S*[0-9]\S*)*+"
CORE = r"[+(]?[0-9A-Za-z](?:.*[0-9A-Za-z)])?"
SECRET_FORM = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{24,})$"
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
IP_VALID = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

SEED_SHARE = 2
LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_BELIEF = 3.0, 0.8, 0.8


def _luhn(digits: Column) -> Column:
    """Luhn's sum of a string of digits is a multiple of ten."""
    n = F.length(digits)

    def weighed(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    card = F.translate(match, " -", "")
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", match.rlike(IP_VALID))
        .when(kind == "card", F.when(F.length(card).between(12, 19), _luhn(card)).otherwise(False))
        .when(kind == "phone", digits.between(9, 15))
        .otherwise(False)
    )


def _seed_kind(core: Column) -> Column:
    """The kind whose whole form the instance has, or null."""
    found = None
    for kind in KINDS:
        test = core.rlike(rf"^(?:{FORMS[kind]})$") & _valid(F.lit(kind), core)
        found = F.when(test, F.lit(kind)) if found is None else found.when(test, F.lit(kind))
    listed = F.pmod(F.xxhash64(core), F.lit(SEED_SHARE)) == 0
    return found.when(core.rlike(SECRET_FORM) & listed, F.lit(SECRET))


def _shape(core: Column) -> Column:
    """Which characters an instance has, and its length to a power of two: some hundreds of shapes in all."""
    marks = [F.when(core.rlike(form), F.lit(mark)) for form, mark in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), ("[^A-Za-z0-9]", "-"))]
    return F.concat_ws("", *marks, F.length(F.bin(F.length(core))).cast("string"))


def _match_of(kind: str):
    def match(x, i):
        words = [x[side] if kind == "token" else F.lit("") for side in ("before", "after")]
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["m"].alias("match"), words[0].alias("before"), words[1].alias("after")
        )

    return match


def _gap_of(kind: str):
    """A gap's length, and for tokens its last two words and its first."""

    def gap(g):
        if kind != "token":
            return F.struct(F.length(g).alias("gap"), F.lit("").alias("before"), F.lit("").alias("after"))
        words = F.trim(F.regexp_replace(g, r"\s++", " "))
        return F.struct(F.length(g).alias("gap"), F.substring_index(words, " ", -2).alias("before"), F.substring_index(words, " ", 1).alias("after"))

    return gap


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, kind, start, match, before, after) of all matches of the four forms and of tokens (kind "token")."""
    rows = common.with_row_id(docs.select(common.text_or_empty(text).alias("t")))
    t = F.col("t")
    rows = rows.withColumn("digits", t.rlike("[0-9]"))
    worth = {"email": t.contains("@"), "phone": t.contains("+") & F.col("digits"), "token": F.col("digits") | t.contains("@")}
    names = [*KINDS, "token"]
    for kind in names:
        form, some = F.lit(FORMS.get(kind, TOKEN)), worth.get(kind, F.col("digits"))
        rows = rows.withColumns({
            f"m_{kind}": F.when(some, F.regexp_extract_all(t, form, F.lit(0))),
            f"g_{kind}": F.when(some, F.transform(F.split(t, FORMS.get(kind, TOKEN), -1), _gap_of(kind))),
        })
    found = []
    for kind in names:
        gaps = F.col(f"g_{kind}")
        next_ = F.slice(gaps["after"], F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
        zipped = F.arrays_zip(F.col(f"m_{kind}").alias("m"), gaps["gap"].alias("gap"), gaps["before"].alias("before"), next_.alias("after"))
        found.append(F.transform(zipped, _match_of(kind)))
    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,before:string,after:string>>")
    every = F.concat(*[F.coalesce(F.filter(x, lambda s: s["match"].isNotNull()), empty) for x in found])
    each = rows.select("_row", F.explode(every).alias("x")).select("_row", "x.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    return each.withColumn("start", (end - F.length("match")).cast("long")).drop("gap", "i")


def _parts(runs: DataFrame) -> DataFrame:
    """The single tokens of runs of several, with their own places and surroundings.

    A token carries its run's place, not its text: a run may be as long as the document.
    """
    in_run = Window.partitionBy("_row", "run").orderBy("i")
    # what stands around the run is an entry before the first token and one behind the last
    around = [F.array(F.coalesce(x, F.lit(""))) for x in (F.rtrim("before"), F.col("after"))]
    entries = F.concat(around[0], F.split("match", " "), around[1])
    out = runs.select("_row", F.col("start").alias("run"), F.posexplode(entries).alias("i", "tok"))
    size = F.when(F.col("i") == 0, 0).otherwise(F.length("tok") + 1)
    near = {"b2": F.lag("tok", 2).over(in_run), "b1": F.lag("tok", 1).over(in_run), "a1": F.lead("tok", 1).over(in_run)}
    out = out.withColumns({"at": F.sum(size).over(in_run.rowsBetween(Window.unboundedPreceding, 0)) - size, **near}).filter("i > 0 and a1 is not null")
    return out.select(
        "_row", (F.col("run") + F.col("at")).alias("start"), F.col("tok").alias("match"), F.lit(True).alias("counted"), "run", F.lit(True).alias("part"),
        F.concat_ws(" ", "b2", "b1").alias("before"), F.col("a1").alias("after"),
    )


def instances(tokens: DataFrame) -> DataFrame:
    """Tokens cut to their core, with its place, seed kind and patterns.

    A run of tokens is an instance as a whole; where it is no seed, each of its tokens is one too: then both have
    the run's place as ``run``, and the tokens are marked ``part``. The first token shares the run's pattern, and is
    the one that counts there.
    """
    columns = ["_row", "start", "match", "counted", "run", "part", "before", "after"]
    several = F.col("match").contains(" ") & _seed_kind(F.regexp_extract("match", CORE, 0)).isNull()
    whole = tokens.withColumns({"counted": ~several, "run": F.when(several, F.col("start")), "part": F.lit(False)}).select(*columns)
    out = whole.unionByName(_parts(tokens.filter(several)).select(*columns)).withColumn("core", F.regexp_extract("match", CORE, 0)).filter(F.col("core") != "")
    out = out.withColumns({
        "start": F.col("start") + F.call_function("locate", F.col("core"), F.col("match")) - 1,
        "words": F.split(F.translate(F.lower(F.trim("before")), "0123456789", "0000000000"), r"\s+"),
        "next": F.get(F.split(F.translate(F.lower(F.ltrim("after")), "0123456789", "0000000000"), r"\s+"), F.lit(0)),
    })
    last, last2 = F.element_at("words", -1), F.try_element_at(F.col("words"), F.lit(-2))
    patterns = F.array(
        F.concat(F.lit("1 "), last), F.concat(F.lit("2 "), last2, F.lit(" "), last), F.concat(F.lit("3 "), last, F.lit(" _ "), F.col("next"))
    )
    patterns = F.when(last != "", F.array_compact(patterns)).alias("patterns")
    return out.select("_row", "start", "core", "counted", "run", "part", _seed_kind(F.col("core")).alias("seed"), patterns)


def believed(found: DataFrame) -> DataFrame:
    """(core, kind, seed) of the instances that confident patterns of the graph cover.

    ``found`` has core, seed, patterns and counted for each occurrence. ``seed`` tells
    whether the core was a seed of the kind; the others are discovered.
    """
    each = found.select("core", "seed", "counted", F.explode("patterns").alias("pattern"))
    edges = each.groupBy("core", "pattern").agg(F.max("seed").alias("seed"), F.max("counted").alias("counted"))
    edges = common.staged(edges.withColumn("shape", _shape(F.col("core"))))
    seeds = edges.filter("seed is not null").groupBy("core").agg(F.max("seed").alias("kind"))
    known = common.staged(seeds.withColumn("belief", F.lit(1.0)))
    shapes = common.staged(edges.filter("seed is not null").select(F.col("seed").alias("kind"), "shape").distinct())
    while True:
        scored = common.staged(_confident(edges, known, shapes))
        covered = common.join_groups(edges, scored.groupBy("pattern").agg(F.collect_list(F.struct("kind", "confidence")).alias("all")), ["pattern"])
        doubt = F.sum(F.log(1 - 0.95 * F.col("x.confidence")))
        belief = covered.select("core", "seed", F.explode("all").alias("x")).groupBy("core", F.col("x.kind").alias("kind")).agg((1 - F.exp(doubt)).alias("belief"), F.max("seed").alias("seed"))
        belief = common.staged(belief.filter(F.col("belief") >= LEAST_BELIEF))
        best = belief.groupBy("core").agg(F.max(F.struct("belief", "kind")).alias("best"), F.max("seed").alias("seed"))
        best = best.select("core", F.col("best.kind").alias("kind"), F.col("best.belief").alias("belief"), "seed")
        new = common.staged(best.filter("seed is null").join(known.select("core"), "core", "left_anti").drop("seed"))
        if new.isEmpty():
            return best.select("core", "kind", (F.col("seed") == F.col("kind")).alias("seed"))
        known = common.staged(known.unionByName(new))


def _confident(edges: DataFrame, known: DataFrame, shapes: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns with enough support and confidence.

    A kind has some hundreds of shapes at most, so ``shapes`` is broadcast.
    """
    counted = common.staged(common.join_groups(edges.filter("counted or seed is not null"), known, ["core"], how="left"))
    of_kind = counted.filter("kind is not null").groupBy("pattern", "kind").agg(F.sum("belief").alias("support"))
    totals = counted.filter("counted").groupBy("pattern").agg(
        F.coalesce(F.sum("belief"), F.lit(0.0)).alias("any"), F.count(F.when(F.col("kind").isNull(), 1)).alias("unknown")
    )
    alike = counted.filter("counted and kind is null").drop("kind").join(F.broadcast(shapes), "shape").groupBy("pattern", "kind").agg(F.count("*").alias("alike"))
    all_ = of_kind.filter(F.col("support") >= LEAST_SUPPORT).join(totals, "pattern").join(alike, ["pattern", "kind"], "left")
    against = F.greatest(F.col("any"), F.col("support")) + F.col("unknown") - F.coalesce("alike", F.lit(0))
    return all_.select("pattern", "kind", (F.col("support") / (against + 0.5)).alias("confidence")).filter(F.col("confidence") >= LEAST_CONFIDENCE)


def pii_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, kind, start, end, base) of all spans; ``docs`` must be read from files."""
    found = common.staged(occurrences(docs, text))
    base = found.filter(F.col("kind") != "token").filter(_valid(F.col("kind"), F.col("match")))
    base = base.select("_row", "kind", "start", (F.col("start") + F.length("match")).alias("end"), F.lit(True).alias("base"))
    tokens = common.staged(instances(found.filter(F.col("kind") == "token")))
    enough = (F.length(F.regexp_replace("core", "[^0-9]", "")) >= 4) | F.col("core").contains("@")
    kinds = common.staged(believed(tokens).filter(enough).select("core", "kind"))
    # a token has its own kind, or its run's: where a run meets a base span, its other tokens stay
    own = common.staged(common.join_groups(tokens, kinds, ["core"]).select("_row", "start", "core", "kind", "run", "part"))
    runs = own.filter("run is not null and not part").select("_row", "run", "kind")
    of_run = tokens.filter("part").filter(enough).select("_row", "start", "core", "run").join(runs, ["_row", "run"])
    both = own.select("_row", "start", "core", "kind").unionByName(of_run.select("_row", "start", "core", "kind"))
    added = both.select("_row", "kind", "start", (F.col("start") + F.length("core")).alias("end"), F.lit(False).alias("base"))
    in_row = Window.partitionBy("_row").orderBy("start", "end")
    earlier = F.max(F.when(F.col("base"), F.col("end"))).over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(in_row.rowsBetween(1, Window.unboundedFollowing))
    both = base.unionByName(added).withColumns({"_earlier": earlier, "_later": later})
    free = (F.coalesce("_earlier", F.lit(0)) <= F.col("start")) & (F.coalesce("_later", F.col("end")) >= F.col("end"))
    # of added spans that lie in each other the longest stays
    wide = Window.partitionBy("_row", "base").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    kept = common.filter_after(both, F.col("base") | free).withColumn("_covered", F.max("end").over(wide) >= F.col("end"))
    return kept.filter(F.col("base") | ~F.coalesce("_covered", F.lit(False))).drop("_earlier", "_later", "_covered")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and span digests of every document."""
    docs = common.read(spark, sf_dir, "documents")
    order = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, SECRET)]), F.col("kind"))
    spans = pii_spans(docs).withColumn("s", F.struct("start", order.alias("o"), "kind", "end", "base"))
    counts = [F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in KINDS]
    per_row = spans.groupBy("_row").agg(*counts, F.count(F.when(~F.col("base"), 1)).alias("n_added"), F.sort_array(F.collect_list("s")).alias("all"))

    def joined(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("all", lambda x: x["base"])
    per_row = per_row.select("_row", *[f"n_{k}" for k in KINDS], "n_added", joined(base).alias("base_spans"), joined(F.col("all")).alias("spans"))
    rows = common.with_row_id(docs.select("doc_id")).join(per_row, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "doc_id", *[zero(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"),
    )


QUERIES = {"op1_pii": op1_pii}
ORACLE_SQL: dict[str, str] = {}
