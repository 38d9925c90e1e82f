"""Facts that a posting's text states, as columns; what isn't stated is null or UNKNOWN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import patterns as p
from sievework.functions.columns import SPACES


def has(x: Column, pattern: str) -> Column:
    return x.rlike(f"(?i){pattern}")


def part(x: Column, pattern: str, group: int = 1, any_case: bool = True) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(x, ("(?i)" if any_case else "") + pattern, group), F.lit(""))


def choose(x: Column, options: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that occurs."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in options:
        out = out.when(has(x, pattern), name)
    return out.otherwise(F.lit(default).cast("string"))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences and lines."""
    split = F.split(text, r"(?<=[.!?])\s+|\r?\n")
    return F.filter(F.transform(split, lambda s: F.regexp_replace(s, f"^[{SPACES}]+|[{SPACES}]+$", "")), lambda s: s != "")


def first_matching_sentence(text: Column, pattern: str) -> Column:
    """Null if there is none. Only a text that matches as a whole has a sentence that does, so others aren't split."""
    return F.when(has(text, pattern), F.get(F.filter(sentences(text), lambda s: has(s, pattern)), F.lit(0)))


def _amount(digits: Column, thousands: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).cast("long") * F.when(thousands.isNull(), 1).otherwise(1000)


def money(x: Column) -> Column:
    return _amount(part(x, p.MONEY), part(x, p.MONEY, 2))


def salary(salary_text: Column, description: Column, low: Column, high: Column, currency: Column) -> Column:
    """struct(minimum, maximum, currency, disclosure): given numbers first, then a range, then one amount."""
    text = F.coalesce(salary_text, description)
    ranged = part(text, p.MONEY_RANGE, 0).isNotNull()
    minimum = F.coalesce(low, F.when(ranged, _amount(part(text, p.MONEY_RANGE, 1), part(text, p.MONEY_RANGE, 2))).otherwise(money(text)))
    maximum = F.coalesce(high, F.when(ranged, _amount(part(text, p.MONEY_RANGE, 3), part(text, p.MONEY_RANGE, 4))), minimum)
    known = minimum.isNotNull()
    return F.struct(
        minimum.alias("minimum"),
        F.when(known, maximum).alias("maximum"),
        F.when(known, F.coalesce(currency, F.lit("USD"))).alias("currency"),
        F.when(known, "DISCLOSED").when(has(text, p.COMPETITIVE), "COMPETITIVE").otherwise("UNDISCLOSED").alias("disclosure"),
    )


def location(place: Column, description: Column) -> Column:
    """struct of arrangement, country, zones (in order, each once), eligibility, visa, relocation and employer of record."""
    text = F.concat(F.coalesce(place, F.lit("")), F.lit("\n"), description)
    us = has(text, p.US_ONLY)
    return F.struct(
        choose(text, [("HYBRID", p.HYBRID), ("ONSITE", p.ONSITE), ("REMOTE", p.REMOTE)], "UNKNOWN").alias("arrangement"),
        F.when(us, "United States").otherwise(F.trim(part(text, p.COUNTRY, 1, any_case=False))).alias("country"),
        F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({p.TIME_ZONE})"))), ",").alias("zones"),
        F.when(has(text, p.WORLDWIDE), "EXPLICITLY_ALLOWED").when(us, "EXPLICITLY_NOT_ALLOWED").otherwise("UNKNOWN").alias("eligibility"),
        choose(text, [("AVAILABLE", p.VISA_YES), ("NOT_AVAILABLE", p.VISA_NO)], "UNKNOWN").alias("visa"),
        choose(text, [("AVAILABLE", p.RELOCATION_YES), ("REQUIRED", p.RELOCATION_MUST), ("NOT_AVAILABLE", p.RELOCATION_NO)], "UNKNOWN").alias("relocation"),
        choose(text, [("AVAILABLE", p.EMPLOYER_OF_RECORD)], "UNKNOWN").alias("employer_of_record"),
    )


PURPOSES = [("NONE", p.NO_TRAVEL), ("FIELD_TRAVEL", p.FIELD_TRAVEL), ("CUSTOMER_ONSITE", p.CUSTOMER_TRAVEL), ("COMPANY_EVENT", p.COMPANY_EVENT), ("CONFERENCE", p.CONFERENCE)]
SCOPES = [("BOTH", p.BOTH_SCOPES), ("INTERNATIONAL", "international"), ("DOMESTIC", "domestic")]


def travel(sentence: Column) -> Column:
    """struct of purpose, percentage, frequency, mandatory and scope, from the first sentence about travel (or null)."""
    told = sentence.isNotNull()
    purpose = F.when(told, choose(sentence, PURPOSES, "OTHER")).otherwise("UNKNOWN")
    return F.struct(
        purpose.alias("purpose"),
        part(sentence, p.PERCENT).cast("int").alias("percentage"),
        part(sentence, p.FREQUENCY).alias("frequency"),
        F.when(~told, F.lit(None).cast("boolean")).when(has(sentence, p.NO_TRAVEL), False).when(has(sentence, p.MANDATORY), True).when(has(sentence, p.OPTIONAL), False).alias("mandatory"),
        F.when(told, choose(sentence, SCOPES, "UNKNOWN")).otherwise("UNKNOWN").alias("scope"),
    )


def requirements(text: Column) -> Column:
    """Candidate sentences; a bullet goes only where it begins the line, before white space is trimmed.

    None in a text that doesn't match as a whole, which isn't split; null for a null text.
    """
    parts = F.split(text, r"\r?\n|(?<=[.!?])\s+")
    bare = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, f"^[-*•][{SPACES}]*", ""), f"^[{SPACES}]+|[{SPACES}]+$", ""))
    found = F.filter(bare, lambda s: (F.length(s) >= 8) & has(s, p.REQUIREMENT))
    return F.when(~has(text, p.REQUIREMENT), F.array().cast("array<string>")).otherwise(found)


def requirement(x: Column) -> list[Column]:
    """The columns that describe one candidate sentence."""
    ranged = part(x, p.YEARS_RANGE, 0).isNotNull()
    plus = F.coalesce(F.when(ranged, part(x, p.YEARS_RANGE, 3)), part(x, p.YEARS, 2))
    strength = choose(x, p.STRENGTHS, "AMBIGUOUS")
    return [
        choose(x, p.CATEGORIES, "CAPABILITY").alias("category"),
        strength.alias("strength"),
        choose(x, [("Customer Success", "customer success"), ("Experience area stated in source text", "experience")], None).alias("specificity"),
        (strength == "AMBIGUOUS").alias("ambiguous"),
        F.when(strength == "AMBIGUOUS", "The source states experience but does not label its strength.").alias("ambiguity"),
        F.coalesce(part(x, p.YEARS_RANGE), part(x, p.YEARS)).cast("int").alias("years"),
        part(x, p.YEARS_RANGE, 2).cast("int").alias("years_most"),
        plus.isNotNull().alias("open_ended"),
    ]


def evidence_rows(postings: DataFrame, description: str = "description") -> DataFrame:
    """postings (id, salary_text, place, description, low) -> one row for each fact that a posting states, in order.

    (id, reference_id, criterion, claim, source_field, source_text); an amount that was given as a number is told as such.
    """
    text = F.col(description)
    pay = salary(F.col("salary_text"), text, F.col("low"), F.lit(None).cast("bigint"), F.lit(None).cast("string"))
    given = F.col("salary_text").isNotNull()
    of = F.when(given, "salaryText").otherwise("jobDescription")
    named = part(F.coalesce("salary_text", text), p.MONEY_RANGE, 0)
    rows = postings.withColumns({
        "pay_": pay,
        "place_": first_matching_sentence(F.concat(F.coalesce("place", F.lit("")), F.lit("\n"), text), p.PLACE),
        "travel_": first_matching_sentence(text, p.TRAVEL),
    })

    def row(reference, criterion, claim, field, source):
        return F.struct(*(x.alias(n) for n, x in zip(("reference_id", "criterion", "claim", "source_field", "source_text"), (reference, F.lit(criterion), claim, field, source))))

    jd = F.lit("jobDescription")
    disclosed = F.col("pay_.disclosure") == "DISCLOSED"
    facts_ = F.array(
        F.when(F.col("pay_.disclosure") == "COMPETITIVE", row(F.lit("salary-competitive"), "salary", F.lit("The job describes compensation only as competitive."), of, F.coalesce("salary_text", F.lit("Competitive salary")))),
        F.when(disclosed, row(F.lit("salary-disclosed"), "salary", F.concat(F.lit("The disclosed salary range begins at "), "pay_.minimum", F.lit(".")), of, F.coalesce("salary_text", named, F.concat(F.lit("$"), "pay_.minimum")))),
        F.when(F.col("place_").isNotNull(), row(F.lit("location-facts"), "location", F.lit("The job states location or work-arrangement information."), jd, F.col("place_"))),
        F.when(F.col("travel_").isNotNull(), row(F.lit("travel-facts"), "travel", F.lit("The job states a travel expectation."), jd, F.col("travel_"))),
    )
    asked = F.transform(
        requirements(text), lambda s, i: row(F.concat(F.lit("requirement-"), i + 1), "candidate-requirement", F.lit("The job states a candidate requirement."), jd, s)
    )
    every = F.concat(F.filter(facts_, lambda x: x.isNotNull()), asked)
    return rows.select("id", F.posexplode(every).alias("pos", "fact")).select("id", "pos", "fact.*")
