"""Generated values merged into scenario documents of any form: whitelisted paths are filled, nothing that is there is overwritten.

Documents are JSON texts, read as VARIANT and taken apart into leaves (a path and a value) level by level with variant_explode; a level is one
lateral join over what is still nested, written once. Steps of a path are keys, or, for items of a list, the item's name where it has one, else its place.
Merging is then a join on (document, path), whatever the documents' forms, and refusals are rows. Documents are put together
again from the deepest level up; a document is in one group there, as its text was before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.functions.bounds import spread
from egresslake.operators.graph import cut

#: Levels that documents may be nested.
DEPTH = 24
SEP = "/"
#: Added to the places of new items, so that they come after those that are there.
LATER = 1 << 40


def _step(key: Column) -> Column:
    """A key as a step of a path: "~" and "/" are escaped as in JSON pointers."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def leaves(docs: DataFrame, id_col: str, payload: str, by_name: str | None = "name") -> DataFrame:
    """(id, path, containers, places, value): the scalars and empty containers of each document, values as JSON.

    containers are the kinds (o or a) of the levels above a leaf, places the order of its steps there. A payload that is NULL or no JSON has no leaves.
    """
    spark = docs.sparkSession
    top = spread(docs.select(F.col(id_col).alias("id"), F.col(payload).alias("v"))).withColumn("v", F.try_parse_json("v")).filter("v is not null")
    front = top.select("id", F.lit("").alias("path"), F.lit("").alias("containers"), F.array().cast("array<long>").alias("places"), "v")
    out: DataFrame | None = None
    for _ in range(DEPTH):
        front = cut(front)  # else each level would take all levels above it apart again
        kind = _kind(F.col("v"))
        nested = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~F.to_json("v").isin("{}", "[]")
        done = front.filter(~F.coalesce(nested, F.lit(False))).select("id", "path", "containers", "places", F.to_json("v").alias("value"))
        out = done if out is None else out.unionByName(done)
        deeper = front.filter(nested)
        if not deeper.limit(1).count():
            return out
        item = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        cols = item.columns  # id, path, containers, places, v, pos, key, value
        named = item.toDF(*[f"_{c}" if i < 5 else c for i, c in enumerate(cols)])
        name = F.try_variant_get("value", f"$.{by_name}", "string") if by_name else F.lit(None).cast("string")
        step = F.when(F.col("key").isNotNull(), _step(F.col("key"))).otherwise(F.coalesce(F.concat(F.lit("="), _step(name)), F.col("pos").cast("string")))
        front = named.select(
            F.col("_id").alias("id"), F.concat("_path", F.lit(SEP), step).alias("path"), F.concat("_containers", F.when(F.col("key").isNotNull(), "o").otherwise("a")).alias("containers"),
            F.concat("_places", F.array(F.col("pos").cast("long"))).alias("places"), F.col("value").alias("v"),
        )
    raise ValueError(f"documents are nested over {DEPTH} levels")


def above(path: Column) -> Column:
    """The paths of all containers that a path lies in, without the document itself."""
    n = F.size(F.split(path, SEP)) - 1
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.when(k < n, F.array_join(F.slice(F.split(path, SEP), F.lit(1), k + 1), SEP)))


def merged_leaves(existing: DataFrame, generated: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(leaves that the documents get, all of generated with a status).

    allowed are patterns of whole paths (regular expressions). status: applied; not_allowed; existing_value (a value is there, which stays, or something
    lies below the path); existing_parent (a scalar is where a container would have to be).
    """
    fits = F.lit(False)
    for a in allowed:
        fits = fits | F.col("path").rlike(f"^(?:{a})$")
    have = existing.select("id", "path", F.lit(1).alias("_leaf"))
    inner = existing.select("id", F.explode(F.array_compact(above(F.col("path")))).alias("path")).filter("path <> ''").distinct().withColumn("_inner", F.lit(1))
    g = generated.withColumn("_fits", fits).join(have, ["id", "path"], "left").join(inner, ["id", "path"], "left")
    up = g.select("id", "path", F.explode(F.array_compact(above(F.col("path")))).alias("_up")).filter("_up <> path")
    scalar = existing.filter("value not in ('{}', '[]')").select("id", F.col("path").alias("_up"))
    blocked = up.join(scalar, ["id", "_up"], "left_semi").select("id", "path").distinct().withColumn("_blocked", F.lit(1))
    g = g.join(blocked, ["id", "path"], "left")
    status = (
        F.when(~F.col("_fits"), "not_allowed").when(F.col("_leaf").isNotNull() | F.col("_inner").isNotNull(), "existing_value").when(F.col("_blocked").isNotNull(), "existing_parent").otherwise("applied")
    )
    g = cut(g.withColumn("status", status).drop("_fits", "_leaf", "_inner", "_blocked"))
    new = g.filter("status = 'applied'").withColumn("places", F.transform("places", lambda p: p + LATER))
    # an empty container that gets something is no leaf any more
    filled = new.select("id", F.explode(F.array_compact(above(F.col("path")))).alias("path")).distinct()
    kept = existing.join(filled, ["id", "path"], "left_anti")
    return kept.unionByName(new.drop("status")), g.select("id", "path", "value", "status")


def documents(parts: DataFrame) -> DataFrame:
    """(id, payload): documents put together from leaves. Keys are in order, items in the order of their places."""
    level = parts.select("id", "path", "containers", "places", "value", F.length("containers").alias("depth"))
    deepest = parts.agg(F.max(F.length("containers"))).first()[0] or 0
    built: DataFrame | None = None  # containers of a level, put together from those below and the level's own leaves
    for depth in range(deepest, 0, -1):
        here = level.filter(F.col("depth") == depth)
        here = here if built is None else here.unionByName(built)
        key = F.substring_index("path", SEP, -1)
        key = F.to_json(F.array(F.replace(F.replace(key, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))))
        quoted = F.substring(key, F.lit(2), F.length(key) - 2)
        keyed = F.substring("containers", depth, 1) == "o"
        part = F.struct(F.when(keyed, F.lit(0)).otherwise(F.try_element_at("places", F.lit(-1))).alias("place"), F.when(keyed, quoted).alias("key"), "value")
        g = here.select("id", F.substring_index("path", SEP, depth).alias("path"), F.substring("containers", 1, depth - 1).alias("containers"), F.slice("places", F.lit(1), F.greatest(F.size("places") - 1, F.lit(0))).alias("places"), part.alias("p"))
        g = g.groupBy("id", "path").agg(F.first("containers").alias("containers"), F.min("places").alias("places"), F.array_sort(F.collect_list("p")).alias("p"))  # one container of a document
        inside = F.array_join(F.transform("p", lambda x: F.concat(F.coalesce(F.concat(x["key"], F.lit(":")), F.lit("")), x["value"])), ",")
        value = F.when(F.col("p")[0]["key"].isNotNull(), F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]")))
        built = g.select("id", "path", "containers", "places", value.alias("value"), F.lit(depth - 1).alias("depth"))
    top = level.filter("depth = 0")
    return (top if built is None else top.unionByName(built)).select("id", F.col("value").alias("payload"))


def fill_documents(docs: DataFrame, generated: DataFrame, allowed: Sequence[str], id_col: str = "id", payload: str = "payload", by_name: str | None = "name") -> tuple[DataFrame, DataFrame]:
    """(id, payload) of the documents with what generated (same columns) adds at allowed paths, and (id, path, value, status) of all it offers.

    Documents for which nothing is generated stay; what is generated for unknown documents is refused: unknown_document.
    """
    have = cut(leaves(docs, id_col, payload, by_name))
    offered = cut(leaves(generated, id_col, payload, by_name))
    known = docs.select(F.col(id_col).alias("id")).distinct()
    unknown = offered.join(known, "id", "left_anti").select("id", "path", "value", F.lit("unknown_document").alias("status"))
    parts, report = merged_leaves(have, offered.join(known, "id", "left_semi"), allowed)
    return documents(cut(parts)), report.unionByName(unknown)
