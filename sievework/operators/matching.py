"""Requirements against assessments of them, evidence that may support an assessment, and citations in narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.facts import has

# Kinds of match, how close the experience is, what it rests on, and kinds of requirement and evidence.
CLASSES = ["STRONG_MATCH", "TRANSFERABLE_MATCH", "PARTIAL_MATCH"]
SPECIFICITIES = ["DIRECT_SAAS_CUSTOMER_SUCCESS", "DIRECT_CUSTOMER_SUCCESS", "RELATED_CUSTOMER_RELATIONSHIP", "BROADER_CUSTOMER_FACING", "TRANSFERABLE", "UNSUPPORTED", "UNKNOWN"]
BASES = ["DIRECT_OR_RELATED_WORK_EXPERIENCE", "BROADER_OR_TRANSFERABLE_WORK_EXPERIENCE", "REQUIREMENT_RELEVANT_SKILL_OR_KNOWLEDGE"]
CATEGORIES = ["EXPERIENCE", "CAPABILITY", "TOOL", "INDUSTRY", "EDUCATION", "CERTIFICATION", "TECHNICAL_KNOWLEDGE", "LANGUAGE", "LOCATION", "TRAVEL"]
EVIDENCE_OF = {
    "DIRECT_OR_RELATED_WORK_EXPERIENCE": ["DIRECT_EXPERIENCE", "RELATED_EXPERIENCE"],
    "BROADER_OR_TRANSFERABLE_WORK_EXPERIENCE": ["DIRECT_EXPERIENCE", "RELATED_EXPERIENCE", "TRANSFERABLE_EXPERIENCE", "TRANSFERABLE_SKILL"],
    "REQUIREMENT_RELEVANT_SKILL_OR_KNOWLEDGE": ["SKILL", "TRANSFERABLE_SKILL"],
}
DIRECT_WORK, WORK, SKILL = BASES
STARTUP = r"\b(?:startup|start-up|startups|start-ups)\b"
#: Wording that says information is missing.
MISSING_INFORMATION = (
    r"\b(?:missing|not (?:described|stated|specified|provided|available|established|evidenced)|no (?:evidence|information|details?|description|mention)|"
    r"absence of (?:evidence|information|details?|description)|insufficient (?:evidence|information)|unclear|unknown|cannot (?:determine|establish)|could not (?:determine|establish))\b"
)


def direct_work_required(category: Column, requirement: Column, specificity: Column) -> Column:
    """Industry requirements, and experience that is asked for as direct, need direct experience."""
    says = has(F.concat_ws(" ", requirement, specificity), r"\bdirect\b")
    return (category == "INDUSTRY") | ((category == "EXPERIENCE") & says)


def allowed_evidence(kind: Column, specificity: Column, basis: Column, category: Column, says_direct: Column) -> Column:
    """The evidence types that may support an assessment, joined by commas; empty where the combination isn't legal."""
    legal = (
        F.when(kind == "STRONG_MATCH", specificity.isin(SPECIFICITIES[:4])).when(kind == "TRANSFERABLE_MATCH", (specificity == "TRANSFERABLE") & (basis == WORK)).otherwise(True)
        & ~((category == "EXPERIENCE") & (basis == SKILL))
    )
    direct = specificity.isin(SPECIFICITIES[:2]) | (category == "INDUSTRY") | ((category == "EXPERIENCE") & says_direct)
    by_basis = F.when(basis == DIRECT_WORK, ",".join(EVIDENCE_OF[DIRECT_WORK])).when(basis == WORK, ",".join(EVIDENCE_OF[WORK])).otherwise(",".join(EVIDENCE_OF[SKILL]))
    return F.when(~legal, "").when(direct, F.when(basis == DIRECT_WORK, "DIRECT_EXPERIENCE").otherwise("")).otherwise(by_basis)


def eligible(requirements: DataFrame) -> DataFrame:
    """Requirements that aren't ambiguous, under their own index."""
    return requirements.where(~F.col("ambiguous")).select("opportunity_id", F.col("idx").alias("requirement_index"), "text")


def matched(requirements: DataFrame, assessments: DataFrame) -> DataFrame:
    """A row a requirement or stray assessment, with what is wrong; ambiguous requirements get a fixed UNKNOWN assessment."""
    counted = assessments.groupBy("opportunity_id", "idx").agg(F.count("*").alias("times"), F.min("classification").alias("given"))
    both = requirements.join(counted, ["opportunity_id", "idx"], "full_outer")
    wrong = (
        F.when(F.col("text").isNull(), "unknown_index").when(F.col("times") > 1, "repeated_index")
        .when(F.col("ambiguous") & F.col("times").isNotNull(), "ambiguous_index").when(~F.col("ambiguous") & F.col("times").isNull(), "missing_index")
    )
    return both.select("opportunity_id", "idx", F.when(F.col("ambiguous"), "UNKNOWN").otherwise(F.col("given")).alias("classification"), wrong.alias("violation"))


def assessment_rules() -> list[tuple[str, Column]]:
    """What an assessment must not be, in order; over classification, specificity, impact, strength, ambiguous, portions and references."""
    kind, specificity, impact = F.col("classification"), F.col("specificity"), F.col("impact")
    return [
        ("assessed_needs_profile_evidence", (kind != "UNKNOWN") & (F.size("profile_refs") == 0)),
        ("transferable_stays_transferable", (kind == "TRANSFERABLE_MATCH") & (specificity != "TRANSFERABLE")),
        ("strong_is_not_transferable", (kind == "STRONG_MATCH") & specificity.isin("TRANSFERABLE", "UNSUPPORTED", "UNKNOWN")),
        ("unknown_has_no_specificity", (kind == "UNKNOWN") & (specificity != "UNKNOWN")),
        ("gap_is_unsupported", (kind == "GENUINE_GAP") & (specificity != "UNSUPPORTED")),
        ("ambiguous_is_no_gap", (kind == "GENUINE_GAP") & F.col("ambiguous")),
        ("only_gaps_have_impact", (kind != "GENUINE_GAP") & (impact != "NON_DECISIVE")),
        ("decisive_must_be_required", (impact == "DECISIVE_DISQUALIFIER") & (F.col("strength") != "REQUIRED")),
        ("decisive_needs_evidence", (impact == "DECISIVE_DISQUALIFIER") & (F.size("impact_refs") == 0)),
        ("partial_needs_both_portions", (kind == "PARTIAL_MATCH") & (F.col("supported").isNull() | F.col("unsupported").isNull())),
    ]


def evidence_rules() -> list[tuple[str, Column]]:
    """What the evidence of an assessment must not be, in order; types: the kinds of its profile evidence."""
    kind, basis, category = F.col("classification"), F.col("basis"), F.col("category")
    has_type = lambda names: F.arrays_overlap("types", F.array(*map(F.lit, names)))
    positive = kind.isin(CLASSES)
    direct = (basis == DIRECT_WORK) & has_type(["DIRECT_EXPERIENCE"])
    asked = (category == "EXPERIENCE") & has(F.concat_ws(" ", "requirement", "requested"), r"\bdirect\b")
    both = F.array_union("jd_refs", "profile_refs")
    return [
        ("no_direct_or_related_evidence", (basis == DIRECT_WORK) & ~has_type(EVIDENCE_OF[DIRECT_WORK])),
        ("no_experience_evidence", (basis == WORK) & ~has_type(EVIDENCE_OF[WORK])),
        ("no_skill_evidence", (basis == SKILL) & ~has_type(EVIDENCE_OF[SKILL])),
        ("industry_without_direct", (category == "INDUSTRY") & positive & ~direct),
        ("skill_as_employment", (category == "EXPERIENCE") & (basis == SKILL) & (kind != "UNKNOWN")),
        ("direct_not_shown", asked & positive & ~direct),
        ("claims_direct_without_evidence", F.col("specificity").isin(SPECIFICITIES[:2]) & ~direct),
        ("not_connected_to_source", ~F.arrays_overlap("jd_refs", "source_refs")),
        ("impact_outside_assessment", F.size(F.array_except("impact_refs", both)) > 0),
        ("impact_needs_both_sides", (F.col("impact") == "DECISIVE_DISQUALIFIER") & ~(F.arrays_overlap("impact_refs", "jd_refs") & F.arrays_overlap("impact_refs", "profile_refs"))),
    ]


def startup_required(category: Column, requirement: Column, specificity: Column) -> Column:
    return (category == "EXPERIENCE") & has(F.concat_ws(" ", requirement, specificity), STARTUP)


def startup_supported(source: Column, kind: Column, claim: Column, text: Column, marked: Column) -> Column:
    """Profile evidence that is marked so or, without a mark, work experience that speaks of it."""
    says = kind.isin(EVIDENCE_OF[WORK]) & has(F.concat_ws(" ", claim, text), STARTUP)
    return (source == "USER_PROFILE") & F.coalesce(marked, says)


def cited(narrative: Column, names: Column) -> Column:
    """struct(text, violation): ids like [jd-3] and bare jd-3 by their references in `names` (a map); brackets stay.

    An id that isn't in the map, or a bracket that only resembles a citation, is a violation, and there is no text.
    """
    pieces = F.split(F.regexp_replace(narrative, r"\[((?:jd|profile)-\d+)\]", "\u0001$1\u0001"), "\u0001")  # every other piece is an id
    restored = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("["), names[x], F.lit("]"))).otherwise(x)), "")
    unknown = F.exists(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, names[x].isNull()).otherwise(False)), lambda b: b)
    tokens = F.regexp_extract_all(restored, F.lit(r"([A-Za-z0-9_-]+|[^A-Za-z0-9_-]+)"), F.lit(1))
    bare = lambda t: t.rlike(r"^(?:jd|profile)-\d+$") & ~F.array_contains(F.map_values(names), t)
    text = F.array_join(F.transform(tokens, lambda t: F.when(bare(t), names[t]).otherwise(t)), "")
    wrong = (
        F.when(unknown, "unknown_evidence").when(has(restored, r"\[(?:jd|profile)-[^\]]*\]"), "malformed_citation")
        .when(F.exists(tokens, lambda t: bare(t) & names[t].isNull()), "unknown_evidence")
    )
    return F.struct(F.when(wrong.isNull(), text).alias("text"), wrong.alias("violation"))


def maturity(dimensions: DataFrame) -> DataFrame:
    """Evidence states of dimensions as conclusions: what isn't established is unknown; a conclusion from missing information is a violation."""
    open_ = F.col("state") == "NOT_ESTABLISHED"
    return dimensions.select(
        "opportunity_id", "dimension", F.when(~open_, F.col("conclusion")).alias("conclusion"), open_.alias("unknown"),
        F.when(~open_ & has(F.col("conclusion"), MISSING_INFORMATION), "evidence_state_invalid").alias("violation"),
    )


# Functions in their order with their labels, and how relationships are told.
FUNCTIONS = {
    "customerSuccess": "Customer Success", "sales": "Sales", "support": "Support", "product": "Product", "implementation": "Implementation",
    "education": "Education", "community": "Community", "marketing": "Marketing", "projectManagement": "Project Management",
}
RELATIONSHIPS = {"SHARES": "shares work with", "COLLABORATES": "collaborates with", "HANDS_OFF_TO": "hands off to", "RECEIVES_FROM": "receives work from"}
NOT_ESTABLISHED = "organizational-maturity-cross-functional-relationships-not-established"


def named(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def relationships(rows: DataFrame) -> DataFrame:
    """rows (opportunity_id, function, relationship, refs) -> (opportunity_id, state, conclusion, refs) of every opportunity.

    One part of the sentence a relationship, in the fixed order of functions; owned and unclear ones are left out. A function
    has one relationship, so an opportunity has at most nine.
    """
    place = F.array_position(F.array(*map(F.lit, FUNCTIONS)), F.col("function"))
    told = F.concat_ws(" ", named(RELATIONSHIPS)[F.col("relationship")], named(FUNCTIONS)[F.col("function")])
    kept = ~F.col("relationship").isin("OWNS", "UNCLEAR_BOUNDARIES") & (place > 0)
    parts = F.array_sort(F.collect_list(F.when(kept, F.struct(place.alias("place"), told.alias("told"), "refs"))))
    found = rows.groupBy("opportunity_id").agg(parts.alias("parts"))
    some = F.size("parts") > 0
    return found.select(
        "opportunity_id",
        F.when(some, "SUPPORTED_PRESENT").otherwise("NOT_ESTABLISHED").alias("state"),
        F.when(some, F.concat(F.lit("Cross-functional relationships: "), F.array_join(F.transform("parts", lambda x: x["told"]), "; "), F.lit("."))).alias("conclusion"),
        F.array_distinct(F.flatten(F.transform("parts", lambda x: x["refs"]))).alias("refs"),
    )


def restored_relationships(maturity: DataFrame, catalog: DataFrame) -> DataFrame:
    """maturity (opportunity_id, conclusion, unknowns: array of codes) with the catalog's conclusion, and its code among the unknowns only if nothing is established."""
    both = maturity.drop("conclusion").join(catalog, "opportunity_id")
    others = F.filter("unknowns", lambda c: c != NOT_ESTABLISHED)
    open_ = F.col("state") == "NOT_ESTABLISHED"
    return both.select("opportunity_id", "conclusion", "refs", open_.alias("unknown"), F.when(open_, F.array_append(others, F.lit(NOT_ESTABLISHED))).otherwise(others).alias("unknowns"))
