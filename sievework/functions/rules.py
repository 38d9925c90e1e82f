"""Rules over facts: hard criteria, folds and the decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.facts import has
from sievework.functions.patterns import RECURRING

#: Fixed values.
SALARY_PASS, SALARY_REVIEW = 60_000, 55_000


def listed(x: Column, names: list[str]) -> Column:
    return F.coalesce(F.lower(x).isin([n.lower() for n in names]), F.lit(False)) if names else F.lit(False)


def salary_criterion(disclosure: Column, low: Column, high: Column, us_required: Column, eligible: Column, country: Column, cheaper: list[str]) -> Column:
    """Below the review line a US residency rule decides first, then whether the pay may be lived on elsewhere."""
    elsewhere = (eligible & F.lit(bool(cheaper))) | listed(country, cheaper)
    return (
        F.when((disclosure != "DISCLOSED") | low.isNull(), "UNKNOWN").when(low >= SALARY_PASS, "PASS").when((low >= SALARY_REVIEW) | (high >= SALARY_REVIEW), "REVIEW")
        .when(us_required, "FAIL").when(elsewhere, "PASS").otherwise("REVIEW")
    )


def location_criterion(country: Column, eligible: Column, banned: list[str], allowed: list[str], accept_us_only: bool) -> Column:
    stated = country.isNotNull()
    outside = stated & F.lit(bool(allowed)) & ~listed(country, allowed)
    us_only = (F.lower(country) == "united states") & F.lit(not accept_us_only)
    return F.when(listed(country, banned) | outside | F.coalesce(us_only, F.lit(False)), "FAIL").when(~stated & ~eligible, "UNKNOWN").otherwise("PASS")


def arrangement_criterion(arrangement: Column, allowed: list[str], unknown: str) -> Column:
    return F.when(arrangement == "UNKNOWN", unknown).when(arrangement.isin(allowed), "PASS").otherwise("FAIL")


def travel_criterion(purpose: Column, frequency: Column, visits: bool, events: bool) -> Column:
    """An unanchored match tells recurring travel, so that even `infrequent` counts as recurring."""
    recurring = F.coalesce(has(frequency, RECURRING), F.lit(False))
    event = purpose.isin("COMPANY_EVENT", "CONFERENCE")
    return (
        F.when(purpose == "UNKNOWN", "UNKNOWN").when(purpose == "NONE", "PASS").when(purpose == "FIELD_TRAVEL", "FAIL")
        .when(purpose == "CUSTOMER_ONSITE", F.when(~recurring & F.lit(visits), "REVIEW").otherwise("FAIL"))
        .when(event & ~recurring & F.lit(events), "PASS").otherwise("REVIEW")
    )


def role_criterion(role: Column) -> Column:
    return F.when(role == "UNRELATED", "FAIL").otherwise("PASS")


def overall(*criteria: Column) -> Column:
    every = F.array(*criteria)
    return F.when(F.array_contains(every, "FAIL"), "FAIL").when(F.array_contains(every, "REVIEW") | F.array_contains(every, "UNKNOWN"), "REVIEW").otherwise("PASS")


def reasons(options: list[tuple[str, Column]]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in options)), lambda x: x.isNotNull())


def decision(skip: Column, review: Column) -> Column:
    return F.when(F.size(skip) > 0, "SKIP").when(F.size(review) > 0, "REVIEW").otherwise("APPLY")


def confidence(levels: Column, conflicting: Column) -> Column:
    """From the set of evidence levels that support a result; POSSIBLE only if one of them is."""
    strong = F.exists(levels, lambda x: x.isin("CONFIRMED", "STRONG_EVIDENCE"))
    return F.when(conflicting, "CONFLICTING").when(strong, "STRONG_EVIDENCE").when(F.array_contains(levels, "POSSIBLE"), "POSSIBLE").otherwise("UNKNOWN")


def preference_findings(business: Column, product: Column, customer: Column, segment: Column, wanted: dict[str, list[str]]) -> Column:
    """One sentence for each of four dimensions; wanted: business, also_business, product, customer, segment."""

    def told(name, x, *options, default):
        out = F.when(x.isNull() | (x == "UNKNOWN"), f"Configured {name} alignment remains Unknown.")
        for values, text in options:
            out = out.when(x.isin(values), F.concat(x, F.lit(text)))
        return out.otherwise(F.concat(x, F.lit(default)))

    # The sentences, here and below
    here, out = " is represented in the configured customer-{} preferences.", " is outside the configured customer-{} preferences."
    return F.array(
        told(
            "business-model", business, (wanted["business"], " is a configured preferred business model."), (wanted["also_business"], " is a configured also-aligned business model."),
            default=" is not listed as a preferred or also-aligned business model.",
        ),
        told("product-type", product, (wanted["product"], " is a configured preferred product type."), default=" requires contextual alignment evaluation."),
        told("customer-type", customer, (wanted["customer"], here.format("type")), default=out.format("type")),
        told("customer-segment", segment, (wanted["segment"], here.format("segment")), default=out.format("segment")),
    )


def first_error(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that fails; null if all hold."""
    return reduce(lambda out, c: out.when(c[1], c[0]), checks[1:], F.when(checks[0][1], checks[0][0]))
