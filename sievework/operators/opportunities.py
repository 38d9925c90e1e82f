"""Opportunities: from a raw record to a normal one with provenance, what an evaluation loads of it, and what a stage leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import normal_text, provenance_kind, strict_date

#: What a manual submission never fills; such columns are there, and null.
OPEN_TEXT = (
    "source_updated_at brand parent_company industry headquarters company_size department seniority remote_status time_zone_requirements bonus equity currency compensation_notes "
    "closing_date ats_platform responsibilities requirements benefits additional_notes"
).split()
#: (field, raw column, whether it is trimmed) in the order provenance is written.
SUPPLIED = [
    ("jobDescription", "rawText", "description", False), ("title", "title", "title", True), ("company.name", "company", "company", True), ("location", "location", "location", True),
    ("salaryText", "compensationText", "salary_text", True), ("domain", "domain", "domain", True), ("canonicalUrl", "sourceUrl", "source_url", False), ("applicationUrl", "applicationUrl", "application_url", False),
]


def normalized(raw: DataFrame) -> DataFrame:
    """Every raw record as an opportunity of 39 fields with a `violation`; the description stays as it came."""
    date = strict_date(F.col("posting_date"))
    violation = (
        F.when(F.col("source_type") != "MANUAL", "not_manual").when(F.col("description").isNull(), "text_required")
        .when(F.col("posting_date").isNotNull() & date.isNull(), "date_invalid")
    )
    trimmed = {n: normal_text(F.col(n)) for n in ("domain", "title", "location", "salary_text", "employment_type")}
    return raw.select(
        "record_id", *(c.alias(n) for n, c in trimmed.items()), normal_text(F.col("company")).alias("company_name"),
        F.col("external_id").alias("external_listing_id"), F.col("requisition_id").alias("ats_requisition_id"), F.col("source_url").alias("canonical_url"), "application_url",
        F.col("source").alias("original_source"), "discovered_at", F.col("discovered_at").alias("first_seen_at"), F.col("discovered_at").alias("last_seen_at"),
        F.lit(None).cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), date.alias("posting_date"), "source", "source_type",
        F.col("description").alias("job_description"), F.lit("DISCOVERED").alias("status"), *(F.lit(None).cast("string").alias(n) for n in OPEN_TEXT), violation.alias("violation"),
    )


def provenance(raw: DataFrame) -> DataFrame:
    """A row for every field that was supplied and of which something is left: where it came from, and whether it was changed."""
    rows = []
    for field, source_field, column, trims in SUPPLIED:
        x = F.col(column)
        normal = normal_text(x) if trims else x
        kept = x.isNotNull() & normal.isNotNull()
        rows.append(F.when(kept, F.struct(F.lit(field).alias("field"), F.lit(source_field).alias("source_field"), provenance_kind(x, normal).alias("kind"), normal.alias("value"), x.alias("source_text"))))
    date = strict_date(F.col("posting_date"))
    shown = F.date_format(date, "yyyy-MM-dd'T00:00:00.000Z'")
    rows.append(F.when(date.isNotNull(), F.struct(F.lit("postingDate").alias("field"), F.lit("postingDate").alias("source_field"), F.lit("DETERMINISTIC").alias("kind"), shown.alias("value"), F.col("posting_date").alias("source_text"))))
    every = F.filter(F.array(*rows), lambda r: r.isNotNull())
    valid = raw.where((F.col("source_type") == "MANUAL") & F.col("description").isNotNull() & (F.col("posting_date").isNull() | date.isNotNull()))
    return valid.select("record_id", F.posexplode(every).alias("position", "p")).select("record_id", "position", "p.*", F.lit("manual-submission").alias("source_reference"))


def linked(records: DataFrame, opportunities: DataFrame) -> DataFrame:
    """What writing the normal rows makes of every record: an opportunity and a company of its own, or why it is refused.

    records (record_id, opportunity_id), opportunities as normalized() gives them. Ids follow from the record, so a repeated
    write is refused and changes nothing; companies are not shared between opportunities.
    """
    joined = opportunities.select("record_id", "company_name", F.col("violation").alias("invalid")).join(records, "record_id", "left")
    refused = F.when(F.col("invalid").isNotNull(), F.col("invalid")).when(F.col("found").isNull(), "record_missing").when(F.col("opportunity_id").isNotNull(), "already_linked")
    own = lambda prefix: F.concat(F.lit(f"{prefix}-"), "record_id")
    return joined.select(
        "record_id", F.when(refused.isNull(), own("opportunity")).otherwise(F.col("opportunity_id")).alias("opportunity_id"),
        F.when(refused.isNull() & F.col("company_name").isNotNull(), own("company")).alias("company_id"), refused.alias("violation"),
    )


def subjects(opportunities: DataFrame, sources: DataFrame, given: DataFrame, profiles: DataFrame) -> DataFrame:
    """What an evaluation starts from: the opportunity, its sources in order, and the profile that was asked for.

    given (opportunity_id, profile_id); no row comes back where the opportunity or a profile that was asked for is missing.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "source_id"))), lambda s: s["source_id"])
    nested = sources.groupBy("opportunity_id").agg(ordered.alias("sources"))
    asked = given.join(profiles.select("profile_id", "profile_version", F.lit(True).alias("known")), "profile_id", "left").where("profile_id is null or known")
    return asked.join(opportunities, "opportunity_id").join(nested, "opportunity_id", "left").drop("known")


def snapshots(evaluations: DataFrame, stages: DataFrame, evidence: DataFrame, recommendations: DataFrame) -> DataFrame:
    """An evaluation with its stages by position, its evidence by time and its recommendation, if it has one."""
    by_position = F.transform(F.array_sort(F.collect_list(F.struct("position", "stage"))), lambda s: s["stage"])
    by_time = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "reference_id"))), lambda e: e["reference_id"])
    out = evaluations.join(stages.groupBy("evaluation_id").agg(by_position.alias("stages")), "evaluation_id", "left")
    return out.join(evidence.groupBy("evaluation_id").agg(by_time.alias("evidence")), "evaluation_id", "left").join(recommendations, "evaluation_id", "left")


def flattened(opportunities: DataFrame, companies: DataFrame) -> DataFrame:
    """Opportunities with their company's columns beside their own, and decimals as numbers."""
    decimals = {n: F.col(n).cast("double") for n, t in opportunities.dtypes if t.startswith("decimal")}
    return opportunities.withColumns(decimals).join(companies, "company_id", "left") if decimals else opportunities.join(companies, "company_id", "left")


def derived(evidence: DataFrame) -> DataFrame:
    return evidence.where("origin = 'DERIVED'")


def contract_violations(evidence: DataFrame, contradictions: DataFrame, parts: int | None = None) -> DataFrame:
    """(stage_id, rule, reference_id): references that a stage gives twice, and those its contradictions cite but it doesn't give.

    Both are told by one grouping of all references, in `parts` partitions if given, so that a task's memory can be bounded.
    """
    cited = contradictions.select("stage_id", F.explode(F.concat("refs_a", "refs_b")).alias("reference_id"), F.lit(0).alias("given"))
    rows = evidence.select("stage_id", "reference_id", F.lit(1).alias("given")).unionByName(cited)
    rows = rows.repartition(parts, "stage_id", "reference_id") if parts else rows
    told = rows.groupBy("stage_id", "reference_id").agg(F.sum("given").alias("given"), F.min("given").alias("least"))
    unnamed = F.col("stage_id").isNull() | F.col("reference_id").isNull()  # equal to nothing that is given
    rules = F.when(F.col("given") > 1, "duplicate_reference"), F.when((F.col("least") == 0) & ((F.col("given") == 0) | unnamed), "unknown_reference")
    return told.select("stage_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"), "reference_id")


def completed(stages: DataFrame, drafts: DataFrame, sources: DataFrame, contradictions: DataFrame) -> DataFrame:
    """What completing each stage with its output makes of it; nothing of a refused output is written.

    stages (stage_id, opportunity_id, status), drafts (stage_id, reference_id, source_id), sources (source_id, opportunity_id),
    contradictions (stage_id, position, refs_a, refs_b: arrays). A stage must be running, and each source it cites belong to its
    opportunity. Evidence gets stored ids; contradictions keep their order with references mapped to those ids.
    """
    stored = F.concat_ws(":", "stage_id", "reference_id")
    owner = sources.select("source_id", F.col("opportunity_id").alias("owner"))
    checked = drafts.join(owner, "source_id", "left").join(stages.select("stage_id", "opportunity_id"), "stage_id")
    foreign = F.bool_or(F.col("source_id").isNotNull() & ~F.col("owner").eqNullSafe(F.col("opportunity_id")))
    evidence = checked.groupBy("stage_id").agg(foreign.alias("foreign"), F.array_sort(F.collect_set(stored)).alias("evidence_ids"))
    ids = lambda refs: F.transform(refs, lambda r: F.concat_ws(":", "stage_id", r))
    mapped = contradictions.select("stage_id", "position", F.concat_ws("|", F.array_join(ids(F.col("refs_a")), ","), F.array_join(ids(F.col("refs_b")), ",")).alias("pair"))
    told = mapped.groupBy("stage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "pair"))), lambda c: c["pair"]).alias("contradictions"))
    refused = F.when(F.col("status") != "RUNNING", "invalid_stage_state").when(F.coalesce("foreign", F.lit(False)), "foreign_source")
    out = stages.join(evidence, "stage_id", "left").join(told, "stage_id", "left")
    kept = lambda c: F.when(refused.isNull(), F.coalesce(c, F.array().cast("array<string>")))
    return out.select(
        "stage_id", F.when(refused.isNull(), "COMPLETED").otherwise(F.col("status")).alias("status"), kept("evidence_ids").alias("evidence_ids"), kept("contradictions").alias("contradictions"), refused.alias("violation"),
    )


#: The keys whose lists hold references, anywhere in a result.
REFERENCE_KEYS = ["evidenceReferences", "jdEvidenceReferences", "profileEvidenceReferences", "decisionImpactReferences", "assessmentOnlyReferences", "evidenceReferencesA", "evidenceReferencesB"]
KEY = '"(?:' + "|".join(REFERENCE_KEYS) + r')"\s*:\s*'
LIST = KEY + r'\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]'


def rewritten(json: Column, names: Column) -> Column:
    """struct(json, violation): the references under the known keys, however deep, by their names (a map).

    Quotes inside a string are escaped, so text that only looks like such a key is left alone. A list that isn't one of
    strings, or a reference without a name, is a violation, and there is no text.
    """
    pieces = F.split(F.regexp_replace(json, f"({LIST})", "\u0001$1\u0001"), "\u0001")  # every other piece is a list with its key
    parts = lambda x: F.split(F.regexp_replace(x, r'("(?:[^"\\]|\\.)*")', "\u0002$1\u0002"), "\u0002")
    bare = lambda s: F.substring(s, F.lit(2), F.length(s) - 2)
    is_ref = lambda i: (i % 2 == 1) & (i > 1)  # noqa: E731  the first string is the key
    told = lambda x: F.array_join(F.transform(parts(x), lambda s, i: F.when(is_ref(i), F.concat(F.lit('"'), names[bare(s)], F.lit('"'))).otherwise(s)), "", "\u0003")
    out = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, told(x)).otherwise(x)), "")
    malformed = F.regexp_count(json, F.lit(KEY)) != F.regexp_count(json, F.lit(LIST))
    wrong = lambda x: F.when(x["malformed"], "malformed_references").when(F.contains(x["text"], F.lit("\u0003")), "unknown_reference")
    # bound by a lambda, so that text and counts are made once a row and not wherever they are named
    once = F.array(F.struct(malformed.alias("malformed"), F.when(~malformed, out).alias("text")))
    return F.transform(once, lambda x: F.struct(F.when(wrong(x).isNull(), x["text"]).alias("json"), wrong(x).alias("violation")))[0]
