"""Scalar column expressions: codes, texts, numbers, shares, years. All run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def padded_code(value, width: int) -> Column:
    """left zeros up to the width; longer codes stay whole."""
    s = _c(value).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def state_of_county(code) -> Column:
    """the first two digits of a five-digit code."""
    return F.substring(padded_code(code, 5), 1, 2)


def coerced_code(value, width: int) -> Column:
    """numbers become padded integers; else the right-most digits; null without any."""
    s = F.trim(_c(value).cast("string"))
    number = s.try_cast("double")
    whole = F.when(number.isNotNull(), F.floor(number).cast("long").cast("string"))
    digits = F.regexp_replace(s, r"\D", "")
    return F.when(s.isNull() | (digits == ""), F.lit(None)).otherwise(padded_code(F.coalesce(whole, F.right(digits, F.lit(width))), width))


def resolved_key(value, by_name: dict[str, str], width: int = 2) -> Column:
    """digits, short name or full name to a code, by a literal map of a few dozen keys."""
    s = F.upper(F.trim(_c(value)))
    table = F.create_map(*[F.lit(x) for kv in by_name.items() for x in (kv[0].upper(), kv[1])])
    return F.coalesce(F.when(s.rlike(r"^\d+$"), padded_code(s, width)), F.try_element_at(table, s))


def slug(value) -> Column:
    """lower case, runs of other characters to one underscore, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(_c(value)), "[^a-z0-9]+", "_"), F.lit("_"))


def text_token(value) -> Column:
    """no-break spaces and line ends to spaces, collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(_c(value), " \n\r\t", "    "), " +", " ")))


#: Words that county names end in.
COUNTY_WORDS = ("county", "parish", "borough", "census area", "municipality", "city and borough", "city")


def county_key(name) -> Column:
    """punctuation out, saint to st, the kind of county dropped."""
    s = F.regexp_replace(F.lower(_c(name)), r"[^a-z0-9 ]", "")
    s = F.regexp_replace(s, r"\b(saint|ste)\b", "st")
    s = F.regexp_replace(s, rf"\b({'|'.join(sorted(COUNTY_WORDS, key=len, reverse=True))})\b", "")
    return F.trim(F.regexp_replace(s, " +", " "))


def magnitude_money(value) -> Column:
    """10.00K, 1.5M, 2B to dollars; anything else 0."""
    s = F.upper(F.trim(_c(value)))
    number = F.regexp_extract(s, r"^([0-9]*\.?[0-9]+)[KMB]?$", 1).try_cast("double")
    factor = F.when(s.endswith("K"), 1e3).when(s.endswith("M"), 1e6).when(s.endswith("B"), 1e9).otherwise(1.0)
    return F.coalesce(number * factor, F.lit(0.0))


def accounting_number(value) -> Column:
    """F8: strips , $ %, brackets mean minus, a dash is null."""
    s = F.regexp_replace(F.trim(_c(value)), r"[,$%\s]", "")
    negative = s.startswith("(") & s.endswith(")")
    n = F.regexp_replace(s, r"[()]", "").try_cast("double")
    return F.when(s.isin("", "-", "--"), F.lit(None)).otherwise(F.when(negative, -n).otherwise(n))


def suppressed_count(value) -> Column:
    """thousands separators and a trailing mark dropped; words are null."""
    return F.regexp_replace(F.trim(_c(value)), r"[,*]", "").try_cast("double")


def suppression_note(value) -> Column:
    """which keyword stands in place of a number."""
    s = F.lower(_c(value))
    return F.when(s.contains("suppressed"), "suppressed").when(s.contains("missing"), "missing").when(s.contains("not available"), "not_available")


def share(value) -> Column:
    """percentages to shares; below 0 or above 100 is null."""
    v = _c(value)
    return F.when((v < 0) | (v > 100), F.lit(None)).when(v > 1, v / 100).otherwise(v)


def not_negative(value) -> Column:
    """null and negative to 0."""
    return F.greatest(F.coalesce(_c(value), F.lit(0.0)), F.lit(0.0))


def clean_text(value) -> Column:
    """quotes and blanks off; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(_c(value), "^[\"']+|[\"']+$", "")), F.lit(""))


def label_of(code, labels: dict, default: str) -> Column:
    """a literal lookup with a default."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _c(code)), F.lit(default))


def yes_no(value) -> Column:
    """yes/no texts and 1/2 codes to boolean."""
    s = F.lower(F.trim(_c(value).cast("string")))
    return F.when(s.isin("yes", "y", "true", "1", "1.0"), True).when(s.isin("no", "n", "false", "0", "2", "2.0", "0.0"), False)


def year_in(*values) -> Column:
    """the first 20xx year in any of the texts."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(v), r"(20\d{2})", 1), F.lit("")).try_cast("int") for v in values])


def effective_years(start, end, sheet_year, longest: int = 30, open_end: int = 2100) -> Column:
    """F16: the years of an effective-dated range; an open end is the sheet's year, odd ranges are the start alone."""
    s, e = _c(start), F.when(_c(end) >= open_end, _c(sheet_year)).otherwise(F.coalesce(_c(end), _c(sheet_year), _c(start)))
    last = F.when((e < s) | (e - s > longest), s).otherwise(e)
    return F.when(s.isNotNull(), F.sequence(s, last))


def series_id(area: str, code, measure) -> Column:
    """encodes an area code and a measure in one id; ``series_parts`` decodes it."""
    return F.concat(F.lit(f"LA{area}"), padded_code(code, 13), padded_code(measure, 2))


def series_parts(value) -> tuple[Column, Column, Column]:
    """(area letters, code, measure) of an id."""
    s = _c(value)
    return F.substring(s, 3, 3), F.substring(s, 6, 13), F.substring(s, 19, 2)


def first_number(*values) -> Column:
    """the first of several columns that reads as a number."""
    return F.coalesce(*[_c(v).try_cast("double") for v in values])


def support_tier(status) -> Column:
    """ordered keyword rules; the first that holds names the tier."""
    s = F.lower(F.coalesce(_c(status), F.lit("")))
    return (
        F.when(s == "", "missing").when(s.contains("missing"), "missing").when(s.contains("proxy") | s.contains("downgraded"), "proxy")
        .when(s.contains("inferred") | s.contains("complement") | s.contains("partial"), "inferred")
        .when(s.contains("explicit") | s.contains("observed"), "explicit").otherwise("other")
    )


def first_stage_tier(f) -> Column:
    """F20."""
    f = _c(f)
    return F.when(f >= 10, "strong").when(f >= 5, "moderate").when(f.isNotNull(), "weak").otherwise("unknown")


def treated_tier(n) -> Column:
    """F20."""
    n = _c(n)
    return F.when(n >= 5, "sufficient").when(n >= 3, "limited").otherwise("insufficient")


def use_tier(f, treated, clusters) -> Column:
    """what the evidence may be used for."""
    few = F.coalesce(_c(clusters) < 30, F.lit(True))
    return (
        F.when((first_stage_tier(f) == "strong") & (treated_tier(treated) == "sufficient") & ~few, "headline")
        .when((first_stage_tier(f) != "weak") & (treated_tier(treated) != "insufficient"), "supporting").otherwise("diagnostic")
    )


def semantic_type(column) -> Column:
    """the meaning of a column by its name."""
    s = F.lower(_c(column))
    return (
        F.when(s.rlike("(^|_)(key|id|code|fips)$|key$"), "identifier").when(s.rlike("year|date|(^|_)ts$"), "time")
        .when(s.rlike("price|cost|wage|acctbal|tax|value"), "money").when(s.rlike("share|rate|discount|ratio"), "share")
        .when(s.rlike("count|^n_|number|quantity|size"), "quantity").when(s.rlike("status|flag|type|segment|priority|label"), "category").otherwise("text")
    )


def unit_of(column) -> Column:
    """F21."""
    kind = semantic_type(column)
    return F.when(kind == "money", "dollars").when(kind == "share", "fraction").when(kind == "quantity", "count").when(kind == "time", "calendar").otherwise("none")


def close(a, b, rel: float = 1e-5, absolute: float = 1e-8) -> Column:
    """equality within tolerances."""
    return F.abs(_c(a) - _c(b)) <= absolute + rel * F.abs(_c(b))
