"""Column builders: scalar rules that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that text is trimmed of: all of Unicode's, not only U+0020.
SPACES = r"\x{09}-\x{0d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def normal_text(x: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+$", ""), F.lit(""))


def strict_date(x: Column) -> Column:
    """A date written YYYY-MM-DD that exists, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def provenance_kind(source: Column, normal: Column) -> Column:
    return F.when(source.eqNullSafe(normal), "DIRECT").otherwise("DETERMINISTIC")


def shown(x: Column) -> Column:
    """What a report shows for a value that may be missing."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("Unknown"))


def humanised(x: Column) -> Column:
    return shown(F.initcap(F.replace(F.lower(x), F.lit("_"), F.lit(" "))))


def token_count(x: Column) -> Column:
    """A count that is a whole number of at least 0, else null: unknown is not zero."""
    number = x.try_cast("double")
    return F.when((number >= 0) & (number == F.floor(number)), number.cast("long"))


def operation_cost(tokens_in: Column, cached: Column, out: Column, price: dict[str, Column]) -> Column:
    """Exact decimal(…,12) cost; null if a count is unknown or more is cached than was sent in.

    price: input, cached, output (per million), threshold, input_factor, output_factor; the factors apply above the threshold.
    """
    number = lambda x: x.cast("decimal(10,0)")
    money = lambda x: x.cast("decimal(8,4)")
    factor = lambda x: F.when(tokens_in > price["threshold"], x).otherwise(F.lit(1)).cast("decimal(4,2)")
    million = F.lit("0.000001").cast("decimal(6,6)")
    sent = number(tokens_in - cached) * money(price["input"]) * factor(price["input_factor"]) * million
    kept = number(cached) * money(price["cached"]) * factor(price["input_factor"]) * million
    got = number(out) * money(price["output"]) * factor(price["output_factor"]) * million
    known = tokens_in.isNotNull() & cached.isNotNull() & out.isNotNull() & (cached <= tokens_in)
    return F.when(known, (sent + kept + got).cast("decimal(30,12)"))


def strict_sum(x: Column) -> Column:
    """The sum, or null if there are no rows or any is null."""
    return F.when((F.count("*") > 0) & (F.count(x) == F.count("*")), F.sum(x))


#: Days since posting, and score cuts with their labels.
AGE_CLASSES = [(3, "HIGHEST_PRIORITY"), (7, "STRONG_PRIORITY"), (14, "GOOD_OPPORTUNITY"), (21, "REVIEW")]
AGE_LAST = "CAUTION"
BAND_CUTS = [19, 39, 59, 79]
BANDS = {
    "priority": ["VERY_LOW", "LOW", "MIXED_MODERATE", "HIGH", "VERY_HIGH"],
    "burnout": ["VERY_LOW", "LOW", "MIXED_MODERATE", "HIGH", "VERY_HIGH"],
    "resume_match": ["VERY_LOW", "LOW", "MIXED_MODERATE", "GOOD_HIGH", "VERY_STRONG_VERY_HIGH"],
    "maturity": ["VERY_LOW", "LOW", "MIXED_MODERATE", "GOOD_HIGH", "VERY_STRONG_VERY_HIGH"],
}


def posting_age(evaluated: Column, posted: Column) -> Column:
    """Whole UTC days since the posting; null if it is missing or in the future."""
    days = F.datediff(F.to_date(evaluated), F.to_date(posted))
    return F.when(days >= 0, days)


def age_class(days: Column) -> Column:
    out = F.when(days.isNull(), "UNKNOWN")
    for most, name in AGE_CLASSES:
        out = out.when(days <= most, name)
    return out.otherwise(AGE_LAST)


def band(score: Column, kind: str) -> Column:
    """The label of a score from 0 to 100; null outside."""
    out = F.when((score < 0) | (score > 100) | score.isNull(), F.lit(None).cast("string"))
    for most, name in zip(BAND_CUTS, BANDS[kind]):
        out = out.when(score <= most, name)
    return out.otherwise(BANDS[kind][-1])


def identifier(x: Column) -> Column:
    """At most 64 characters, with _ for what isn't a word character."""
    return F.substring(F.regexp_replace(x, r"[^A-Za-z0-9_]", "_"), 1, 64)


def issue_path(segments: Column) -> Column:
    """Where an issue is, from structs of name and index: `$.field[2].other`; what isn't a word character is masked, names are cut."""
    part = lambda s: F.when(s["index"].isNotNull(), F.concat(F.lit("["), s["index"], F.lit("]"))).otherwise(F.concat(F.lit("."), F.coalesce(F.nullif(masked(s["name"]), F.lit("")), F.lit("field"))))
    return F.concat(F.lit("$"), F.array_join(F.transform(segments, part), ""))


def masked(name: Column) -> Column:
    """A name as identifiers allow it, 64 characters at most."""
    return F.substring(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"), 1, 64)


def provider_message(status: Column, code: Column, param: Column, kind: Column) -> Column:
    """What may be told of a provider's error: a sentence by its status, and those of three fields that look harmless."""
    # The sentences and what a field may look like
    said = F.when(status == 429, "The semantic provider rate limit was reached").when(status >= 500, "The semantic provider is temporarily unavailable").otherwise("The semantic provider rejected the request")
    told = lambda name, x, most, extra: F.when((F.length(x) <= most) & x.rlike(f"^[a-zA-Z0-9][a-zA-Z0-9_.{extra}-]*$"), F.concat(F.lit(f"{name}="), x))
    fields = F.concat_ws(", ", told("code", code, 64, ""), told("param", param, 128, r"\[\]"), told("type", kind, 64, ""))
    return F.when(fields == "", said).otherwise(F.concat(said, F.lit(" (provider "), fields, F.lit(")")))
