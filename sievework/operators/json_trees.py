"""JSON documents of any shape, walked level by level: a canonical text, and references rewritten wherever they stand.

A document is a tree of rows (id, path, parent, pos, key, kind, text). Each level comes from the one above by
variant_explode and is written to the shared folder; texts are put together again from the deepest level upwards, a grouping
by (id, path) a level. So depth costs steps, and a large document's nodes are spread like any other rows. Tables with a row a
document or node are never broadcast, however small their files: nodes compress well, and the driver would hold them whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.sources.shared import materialise, release

#: Keys are ordered as a locale-aware comparison orders them (root collation: case only breaks ties).
COLLATION = "UNICODE"


def _described(rows: DataFrame) -> DataFrame:
    """With the kind of each node, by what its text begins with; rows (id, path, parent, pos, key, under, text)."""
    begins = F.substring("text", 1, 1)
    return rows.withColumn("kind", F.when(begins == "{", "object").when(begins == "[", "array").when(begins == '"', "string").otherwise("other"))


def levels(docs: DataFrame) -> list[DataFrame]:
    """The nodes of each level of docs (id, json), from the roots down; at least one level. Text that is no JSON has no nodes.

    `under` is the key of the list that a node is an item of, `text` the JSON of a node (of containers too, until rebuilt).
    Ids must be known and each once. An object that has a key twice is no valid document.
    """
    root = docs.select(
        "id", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("under"),
        F.to_json(F.try_parse_json("json")).alias("text"),
    )
    # dealt anew, as few files may hold many documents; each level keeps the files of the one above
    out = [materialise(_described(root.repartition("id").where("id is not null and text is not null")), "level")]
    while True:
        inner = out[-1].where("kind in ('object', 'array')")
        if inner.isEmpty():
            return out
        opened = inner.select("id", "path", F.col("key").alias("own_key"), F.col("kind").alias("own_kind"), F.parse_json("text").alias("tree"))
        children = opened.lateralJoin(opened.sparkSession.tvf.variant_explode(F.col("tree").outer()))
        out.append(materialise(_described(children.select(
            "id", F.concat_ws(".", F.nullif("path", F.lit("")), "pos").alias("path"), F.col("path").alias("parent"), "pos", "key", F.when(F.col("own_kind") == "array", F.col("own_key")).alias("under"), F.to_json("value").alias("text"),
        )), "level"))


def rebuilt(nodes: list[DataFrame]) -> DataFrame:
    """(id, json): the texts of the roots, put together from the levels upwards, the keys of all objects in order."""
    quoted = F.to_json(F.struct(F.col("key").alias("k")))  # {"k":"..."}
    member = F.concat(F.expr("substring(quoted, 6, length(quoted) - 6)"), F.lit(":"), "text")
    below = None
    for level in reversed(nodes):
        own = level.select("id", "path", "parent", "pos", "key", "kind", "text")
        if below is not None:
            inner = F.col("kind").isin("object", "array")
            item = F.struct(F.collate("key", COLLATION).alias("k"), "pos", F.when(F.col("key").isNotNull(), member).otherwise(F.col("text")).alias("text"))
            items = below.withColumn("quoted", quoted).select("id", F.col("parent").alias("path"), item.alias("item"), F.lit(None).alias("own"))
            outer = own.where(inner).select("id", "path", F.lit(None).alias("item"), F.struct("parent", "pos", "key", "kind").alias("own"))
            inside = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"]), ",")
            joined = items.unionByName(outer).groupBy("id", "path").agg(inside.alias("inside"), F.first("own", ignorenulls=True).alias("own"))
            text = F.when(F.col("own.kind") == "object", F.concat(F.lit("{"), "inside", F.lit("}"))).otherwise(F.concat(F.lit("["), "inside", F.lit("]")))
            own = own.where(~inner).unionByName(joined.select("id", "path", "own.*", text.alias("text")))
        below = own
    return below.select("id", F.col("text").alias("json"))


def canonical_json(docs: DataFrame) -> DataFrame:
    """docs (id, json) -> (id, json, content_hash): the same document with the keys of all objects in order, however deep.

    Lists keep their order, white space between tokens goes, numbers lose trailing zeros. Text that is no JSON, a null among it,
    comes back with null in both. content_hash is the sha256 of the text.
    """
    found = rebuilt(levels(docs))
    out = docs.select("id").join(found.hint("merge"), "id", "left")
    return out.select("id", "json", F.sha2("json", 256).alias("content_hash"))


def rewrite_references(docs: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """docs (id, json) -> (id, json, violation): the strings in lists under the given keys, however deep, by their names.

    names (reference, stored), or (id, reference, stored) where each document has names of its own; each once. A known key whose
    value isn't a list of strings is `malformed_references`, a reference without a name `unknown_reference` (the former counts
    first); text that is no JSON is `not_json`. Then there is no text. The others come back with the keys of objects in order.
    """
    nodes = levels(docs)
    known: Column = F.col("under").isin(keys)
    wrong, told = [], []
    for level in nodes:
        bad = level.where((F.col("key").isin(keys) & (F.col("kind") != "array")) | (known & (F.col("kind") != "string")))
        wrong.append(bad.select("id", F.lit("malformed_references").alias("violation")))
        bare = F.from_json(F.concat(F.lit('{"s":'), "text", F.lit("}")), "s string")["s"]
        asked = level.withColumn("reference", F.when(known & (F.col("kind") == "string"), bare))
        on = [c for c in names.columns if c != "stored"]
        found = asked.join(names, on, "left")
        quoted = F.to_json(F.struct(F.col("stored").alias("k")))
        told.append(materialise(found.withColumn("lost", F.col("reference").isNotNull() & F.col("stored").isNull()).withColumn("quoted", quoted).withColumn(
            "text", F.when(F.col("stored").isNotNull(), F.expr("substring(quoted, 6, length(quoted) - 6)")).otherwise(F.col("text"))).drop("quoted"), "told"))
        wrong.append(told[-1].where("lost").select("id", F.lit("unknown_reference").alias("violation")))
    first = reduce(DataFrame.unionByName, wrong).groupBy("id").agg(F.min("violation").alias("found"))
    roots = nodes[0].select("id", F.lit(True).alias("is_json"))
    out = docs.select("id")
    for told_of in (rebuilt(told), first, roots):
        out = out.join(told_of.hint("merge"), "id", "left")
    violation = F.when(F.col("is_json").isNull(), "not_json").otherwise(F.col("found"))
    result = materialise(out.select("id", F.when(violation.isNull(), F.col("json")).alias("json"), violation.alias("violation")), "rewritten")
    for level in [*nodes, *told]:
        release(level)
    return result
