"""Evidence: which of it counts, what references resolve to, and what must hold of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from sievework.functions.columns import normal_text


def affirmative(evidence: DataFrame) -> DataFrame:
    """Explicit, well-supported evidence with visible text that isn't the user's own, numbered from 0."""
    kept = evidence.where(
        (F.col("origin") == "EXPLICIT") & F.col("level").isin("CONFIRMED", "STRONG_EVIDENCE") & (F.col("kind") != "USER_PROFILE") & normal_text(F.col("claim")).isNotNull()
    )
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy("evaluation_id").orderBy("pos")) - 1)


def compact(evidence: DataFrame) -> DataFrame:
    """Without what can be derived: an excerpt that only repeats the claim."""
    return evidence.withColumn("excerpt", F.nullif("excerpt", "claim"))


def resolved(refs: Column, ids: Column) -> Column:
    """Stored ids of references, in their order; an unknown reference gives null."""
    return F.transform(refs, lambda r: ids[r])


def overlaps(refs: Column, contradictions: Column) -> Column:
    return F.exists(contradictions, lambda c: F.arrays_overlap(c, refs))


def only_from(refs: Column, source: Column) -> Column:
    """Whether there are references and all of them come from source."""
    return (F.size(refs) > 0) & F.forall(refs, lambda r: F.array_contains(source, r))


def partition_problem(first: Column, second: Column) -> Column:
    """Duplicates within a list or across two lists are errors; nothing is repaired."""
    return (
        F.when(F.size(F.array_distinct(first)) != F.size(first), "duplicate_in_first").when(F.size(F.array_distinct(second)) != F.size(second), "duplicate_in_second")
        .when(F.arrays_overlap(first, second), "in_both")
    )


def selected(references: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """references (key, pos, reference) -> each once where it first comes, with nth (from 0) and the catalog's columns; `missing` where there is none.

    catalog (reference, ...) has each reference once.
    """
    first = references.groupBy(key, "reference").agg(F.min("pos").alias("pos"))
    found = first.join(catalog.withColumn("known_", F.lit(True)), "reference", "left")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos", "reference")) - 1
    return found.withColumns({"nth": nth, "missing": F.col("known_").isNull()}).drop("pos", "known_")


def one_sided(references: DataFrame, keys: list[str], profile: str) -> DataFrame:
    """(keys, missing): claims whose references (keys, side) come from one side only; `side` is null for a reference that isn't known."""
    sides = references.groupBy(*keys).agg(F.bool_or(F.col("side") == profile).alias("own"), F.bool_or(~F.col("side").eqNullSafe(F.lit(profile))).alias("other"))
    missing = F.when(~F.coalesce("own", F.lit(False)), "profile").when(~F.col("other"), "job")
    return sides.select(*keys, missing.alias("missing")).where("missing is not null")


def issues(found: Column, most: int = 8) -> Column:
    """The first `most` issues, and how many more there are."""
    more = F.size(found) - most
    return F.concat(F.array_join(F.slice(found, 1, most), "; "), F.when(more > 0, F.concat(F.lit(" (+"), more, F.lit(" more)"))).otherwise(""))


def first_issues(found: DataFrame, key: str, issue: str, most: int = 8) -> DataFrame:
    """issues() of rows: each key's first `most` issues in order; the others are only counted, never gathered."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(issue))
    first = found.withColumn("nth_", nth).where(F.col("nth_") <= most).groupBy(key).agg(F.array_sort(F.collect_list(issue)).alias("first_"))
    more = found.groupBy(key).agg((F.count("*") - most).alias("more_"))
    message = F.concat(F.array_join("first_", "; "), F.when(F.col("more_") > 0, F.concat(F.lit(" (+"), "more_", F.lit(" more)"))).otherwise(""))
    return first.join(more, key).select(key, message.alias("message"))


def canonical(x: Column, kind: DataType) -> Column:
    """The same value with the keys of all objects in order, however deep; lists keep theirs."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(x.isNotNull(), F.struct(*(canonical(x[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, MapType):
        entries = F.transform(F.array_sort(F.map_entries(x)), lambda e: F.struct(e["key"], canonical(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: canonical(e, kind.elementType))
    return x


def content_hash(x: Column, kind: DataType) -> Column:
    """sha256 of a struct as JSON with sorted keys; nulls are written."""
    return F.sha2(F.to_json(canonical(x, kind), {"ignoreNullFields": "false"}), 256)
