"""Readers for trajectory, flow, ridership, hazard, layout, cache and map files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import clip, num
from egresslake.functions.scalars import METRES_PER_LAT_GTFS, METRES_PER_LAT_OSM, METRES_PER_LON
from egresslake.functions.text import levels
from egresslake.operators.submissions import hash_drift


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def trajectory_table(spark: SparkSession, path: str) -> DataFrame:
    """A trajectory from a bundle directory, a .parquet or a .csv file."""
    from egresslake.sources.bundle import exists, read_table

    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if exists(spark, f"{path}/tables"):
        return read_table(spark, path, "agent_steps")
    raise ValueError(f"no trajectory table: {path}")


def petrack(spark: SparkSession, path: str, rate_hz: float = 25.0) -> DataFrame:
    """Lines `id frame x y [z]`; blanks and # lines are skipped; time is frame / rate."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    p = t.select(F.split("v", r"\s+").alias("p")).filter(F.size("p") >= 4)
    z = F.when(F.size("p") > 4, F.get("p", F.lit(4)).try_cast("double")).otherwise(0.0)
    out = p.select(F.col("p")[0].cast("long").alias("agent_id"), F.col("p")[1].cast("long").alias("frame"), F.col("p")[2].cast("double").alias("x"), F.col("p")[3].cast("double").alias("y"), F.coalesce(z, F.lit(0.0)).alias("z"))
    return out.withColumn("time_s", F.col("frame") / rate_hz)


def specific_flow(spark: SparkSession, path: str) -> DataFrame:
    """Reference flow by width; a number that does not parse fails the query."""
    df = required(spark.read.option("header", True).csv(path), ["width_m", "specific_flow_ped_m_s"])
    return df.withColumn("width_m", F.col("width_m").cast("double")).withColumn("specific_flow_ped_m_s", F.col("specific_flow_ped_m_s").cast("double")).orderBy("width_m")


def ridership(spark: SparkSession, path: str, station: str | None = None) -> DataFrame:
    """Hourly riders by time and station from CSV or JSON; a negative count fails the query."""
    df = spark.read.option("multiLine", True).json(path) if path.endswith(".json") else spark.read.option("header", True).csv(path)
    if "sum_ridership" in df.columns and "ridership" not in df.columns:
        df = df.withColumnRenamed("sum_ridership", "ridership")
    df = required(df, ["transit_timestamp", "station_complex", "ridership"])
    df = df.filter(F.col("station_complex") == station) if station else df
    n = F.col("ridership").cast("double")
    n = F.when(n < 0, F.raise_error(F.lit("negative ridership")).cast("double")).otherwise(n)
    return df.groupBy(F.to_timestamp("transit_timestamp").alias("transit_timestamp"), "station_complex").agg(F.sum(n).alias("ridership")).orderBy("transit_timestamp")


#: Names that a hazard column may have, the first that is there counts.
HAZARD_ALIASES = {
    "intensity": ("intensity",), "visibility": ("visibility",), "visibility_m": ("visibility_m",), "obscuration": ("obscuration", "obscuration_percent_m"),
    "gas_concentration": ("gas_concentration", "gas_concentration_grid", "gas_concentration_kg_kg", "soot_mass_fraction"),
}


def hazard_csv(spark: SparkSession, path: str) -> DataFrame:
    """A hazard raster (ix, iy, intensity, visibility, visibility_m, gas_concentration, obscuration), indices by rank of x and y."""
    df = spark.read.option("header", True).csv(path)
    df = required(df.toDF(*[c.strip().lower() for c in df.columns]), ["x", "y"])

    def first(name: str) -> Column:
        found = [num(a) for a in HAZARD_ALIASES[name] if a in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    metres = F.coalesce(first("visibility_m"), F.lit(30.0))
    gas = first("gas_concentration")
    df = df.crossJoin(F.broadcast(df.agg(F.max(gas).alias("_most"))))
    scaled = F.coalesce(F.try_divide(gas, F.col("_most")), F.lit(0.0))
    out = df.select(
        num("x").alias("x"), num("y").alias("y"), F.coalesce(first("intensity"), scaled).alias("intensity"), F.coalesce(first("visibility"), clip(metres / 30.0, 0.0, 1.0)).alias("visibility"),
        metres.alias("visibility_m"), F.coalesce(gas, F.lit(0.0)).alias("gas_concentration"), F.coalesce(first("obscuration"), F.lit(0.0)).alias("obscuration"),
    )
    xs, ys = (out.select(c).distinct().withColumn(f"i{c}", (F.dense_rank().over(Window.orderBy(c)) - 1).cast("int")) for c in ("x", "y"))
    return out.join(xs, "x").join(ys, "y")


def hazard_json(spark: SparkSession, path: str) -> DataFrame:
    """A hazard raster from JSON grids (rows of numbers under the same names)."""
    df = spark.read.option("multiLine", True).json(path)
    names = {n: next((a for a in HAZARD_ALIASES[n] if a in df.columns), None) for n in HAZARD_ALIASES}
    out = None
    for name, col in names.items():
        if col:
            g = df.select(F.posexplode(col).alias("iy", "row")).select("iy", F.posexplode("row").alias("ix", name))
            out = g if out is None else out.join(g, ["ix", "iy"], "full")
    if out is None:
        raise ValueError("no hazard grid")
    grids = [n for n in names if names[n]]
    missing = F.lit(False)
    for n in grids:
        missing = missing | F.col(n).isNull()
    out = out.select("ix", "iy", *[F.when(missing, F.raise_error(F.lit("hazard grids differ in shape")).cast("double")).otherwise(F.col(n).cast("double")).alias(n) for n in grids])
    for n in set(HAZARD_ALIASES) - set(grids):
        out = out.withColumn(n, F.lit(None).cast("double"))
    gas = out.crossJoin(F.broadcast(out.agg(F.max("gas_concentration").alias("_most"))))
    scaled = F.coalesce(F.try_divide(F.col("gas_concentration"), F.col("_most")), F.lit(0.0))
    metres = F.coalesce("visibility_m", F.lit(30.0))
    return gas.select(
        "ix", "iy", F.coalesce("intensity", scaled).alias("intensity"), F.coalesce("visibility", clip(metres / 30.0, 0.0, 1.0)).alias("visibility"), metres.alias("visibility_m"),
        F.coalesce("gas_concentration", F.lit(0.0)).alias("gas_concentration"), F.coalesce("obscuration", F.lit(0.0)).alias("obscuration"),
    )


def hazard_field(spark: SparkSession, path: str) -> DataFrame:
    """A hazard raster by its file's suffix: .csv or .json."""
    readers = {"csv": hazard_csv, "json": hazard_json}
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in readers:
        raise ValueError(f"hazard field of unknown kind: {path}")
    return readers[suffix](spark, path)


def layout_text(layouts: DataFrame) -> DataFrame:
    """Cells (floor_id, x, y, token) of layout texts (floor_id, text); short lines are padded with walls."""
    lines = layouts.select("floor_id", F.posexplode(F.split(F.rtrim("text"), "\n")).alias("y", "line"))
    wide = layouts.select("floor_id", F.array_max(F.transform(F.split(F.rtrim("text"), "\n"), F.length)).alias("w"))
    padded = lines.join(wide, "floor_id").select("floor_id", "y", F.expr("rpad(line, w, 'X')").alias("line"))
    return padded.select("floor_id", F.posexplode(F.filter(F.split("line", ""), lambda c: c != "")).alias("x", "token"), "y").select("floor_id", "x", "y", "token")


def layout_back(cells: DataFrame) -> DataFrame:
    """(floor_id, text) of cells: the inverse of layout_text, up to padding."""
    rows = cells.groupBy("floor_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "token"))), lambda s: s["token"]), "").alias("line"))
    return rows.groupBy("floor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda s: s["line"]), "\n").alias("text"))


def cache_records(spark: SparkSession, root: str) -> DataFrame:
    """Generation records below a folder: key, provider, model, status, ;-joined reasons, tokens by either usage name."""
    schema = "key string, provider string, model string, validation struct<status:string, reasons:array<string>>, usage struct<input_tokens:long, prompt_tokens:long, output_tokens:long, completion_tokens:long>"
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(root)

    def either(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"usage.{a}"), F.lit(0)), F.col(f"usage.{b}"), F.lit(0))

    return df.select(
        "key", "provider", "model", F.col("validation.status").alias("validation_status"), F.array_join("validation.reasons", ";").alias("validation_reasons"),
        either("input_tokens", "prompt_tokens").alias("input_tokens"), either("output_tokens", "completion_tokens").alias("output_tokens"), F.col("_metadata.file_path").alias("source_file"),
    )


def population_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of generated population calibrations below a folder; files without a calibration and its validation are left out.

    cache_key (the file's name where the record has none), scenario_name, provider, model, validation_status, lists joined by ;, confidence, abstain, tokens by either usage name.
    """
    usage = "struct<input_tokens:long, prompt_tokens:long, output_tokens:long, completion_tokens:long>"
    schema = (
        "cache_key string, request struct<scenario_name:string, allowed_targets:array<string>>, validation struct<accepted:boolean, reasons:array<string>>, application struct<applied_targets:array<string>, skipped:array<string>>, "
        f"calibration struct<provider:string, model:string, confidence:double, abstain:boolean, raw_response:struct<usage:{usage}, response:struct<usage:{usage}>>>"
    )
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(root)
    df = df.withColumn("path", F.col("_metadata.file_path")).filter("calibration is not null and validation is not null")

    def either(a: str, b: str) -> Column:
        own, inner = "calibration.raw_response.usage", "calibration.raw_response.response.usage"
        first = F.when(F.col(own).isNotNull(), F.coalesce(F.nullif(F.col(f"{own}.{a}"), F.lit(0)), F.col(f"{own}.{b}")))
        return F.coalesce(first, F.when(F.col(own).isNull(), F.coalesce(F.nullif(F.col(f"{inner}.{a}"), F.lit(0)), F.col(f"{inner}.{b}"))), F.lit(0)).cast("long")

    def joined(c: str) -> Column:
        return F.coalesce(F.array_join(c, ";"), F.lit(""))

    return df.select(
        F.coalesce("cache_key", F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("cache_key"), F.coalesce("request.scenario_name", F.lit("")).alias("scenario_name"), F.coalesce("calibration.provider", F.lit("")).alias("provider"), F.coalesce("calibration.model", F.lit("")).alias("model"),
        F.when(F.col("validation.accepted"), "accepted").otherwise("rejected").alias("validation_status"), joined("validation.reasons").alias("validation_reasons"), F.coalesce("calibration.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("calibration.abstain", F.lit(False)).alias("abstain"),
        joined("request.allowed_targets").alias("allowed_targets"), joined("application.applied_targets").alias("applied_targets"), joined("application.skipped").alias("skipped_overwrite_attempts"), either("input_tokens", "prompt_tokens").alias("input_tokens"), either("output_tokens", "completion_tokens").alias("output_tokens"), "path",
    )


def projected(df: DataFrame, lat: str, lon: str, per_lat: float, corner: bool) -> DataFrame:
    """Adds px, py metres east and north of the south-west corner (or of the mean), equirectangular."""
    at = F.min if corner else F.avg
    one = df.agg(at(lat).alias("_lat0"), at(lon).alias("_lon0"), F.radians(F.avg(lat)).alias("_mean"))
    j = df.crossJoin(F.broadcast(one))
    return j.withColumn("px", (F.col(lon) - F.col("_lon0")) * METRES_PER_LON * F.cos("_mean")).withColumn("py", (F.col(lat) - F.col("_lat0")) * per_lat).drop("_lat0", "_lon0", "_mean")


def overpass(spark: SparkSession, path: str) -> DataFrame:
    """Ways of a saved Overpass answer: id, tags, kind (Polygon when closed), points (projected); ways of under two points are left out."""
    schema = "elements array<struct<type:string, id:long, lat:double, lon:double, nodes:array<long>, tags:map<string,string>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    n = projected(e.filter("type = 'node'").select(F.col("id").alias("node"), "lat", "lon"), "lat", "lon", METRES_PER_LAT_OSM, True)
    ways = e.filter("type = 'way'").select("id", "tags", "nodes", F.posexplode("nodes").alias("pos", "node")).join(n, "node")
    p = ways.groupBy("id").agg(F.first("tags").alias("tags"), F.first("nodes").alias("nodes"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "px", "py"))), lambda s: F.array(s["px"], s["py"])).alias("points"))
    closed = (F.col("nodes")[0] == F.element_at("nodes", -1)) & (F.size("nodes") > 3)
    return p.filter(F.size("points") >= 2).select("id", "tags", F.when(closed, "Polygon").otherwise("LineString").alias("kind"), "points")


#: GTFS pathway_mode to connector type, fixed by that format.
PATHWAY_MODES = ((1, "walkway"), (2, "stair"), (3, "moving_walkway"), (4, "escalator"), (5, "elevator"), (6, "fare_gate"), (7, "exit_gate"))


def gtfs_pathways(spark: SparkSession, folder: str, level_height: float = 3.0) -> DataFrame:
    """Pathways with both ends' metres, level and height, and connector type."""
    read = spark.read.option("header", True)
    stops, paths, lev = read.csv(f"{folder}/stops.txt"), read.csv(f"{folder}/pathways.txt"), read.csv(f"{folder}/levels.txt")
    s = stops.select("stop_id", "stop_name", num("stop_lat").alias("lat"), num("stop_lon").alias("lon"), F.coalesce(F.nullif("level_id", F.lit("")), F.lit("0")).alias("level_id"))
    s = projected(s, "lat", "lon", METRES_PER_LAT_GTFS, True).join(lev.select("level_id", num("level_index").alias("level_index")), "level_id", "left")
    s = s.withColumn("z", F.coalesce("level_index", F.lit(0.0)) * level_height).select("stop_id", "px", "py", "z", "level_id")
    a, b = (s.toDF(*[f"{p}_{c}" for c in s.columns]) for p in ("from", "to"))
    mode = F.lit("walkway")
    for code, kind in PATHWAY_MODES:
        mode = F.when(F.col("pathway_mode").try_cast("int") == code, kind).otherwise(mode)
    j = paths.join(a, paths.from_stop_id == a.from_stop_id).drop(a.from_stop_id).join(b, paths.to_stop_id == b.to_stop_id).drop(b.to_stop_id)
    return j.withColumn("connector", mode).withColumn("bidirectional", F.col("is_bidirectional") == "1")


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of a FeatureCollection, a Feature, or a bare geometry: feature_id, properties, kind, coordinates (JSON), floor levels."""
    feature = "struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>"
    schema = f"type string, features array<{feature}>, properties map<string,string>, geometry struct<type:string, coordinates:string>, coordinates string"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    one = F.struct(F.col("properties"), F.when(F.col("type") == "Feature", F.col("geometry")).otherwise(F.struct("type", "coordinates")).alias("geometry"))
    every = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.array(one.cast(feature)))
    f = d.select(F.posexplode(every).alias("feature_id", "f"))
    floor = F.coalesce(F.col("f.properties")["level"], F.col("f.properties")["level_id"], F.col("f.properties")["floor"], F.lit("0"))
    out = f.select("feature_id", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), levels(floor).alias("levels"))
    known = ("Polygon", "MultiPolygon", "LineString", "MultiLineString", "Point", "MultiPoint")
    return out.withColumn("kind", F.when(F.col("kind").isin(*known), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("geometry type "), F.coalesce("kind", F.lit("none")))).cast("string")))


def behaviour_priors(spark: SparkSession, path: str) -> DataFrame:
    """(group, seconds, probability, cumulative) of milling times; probabilities that do not sum to 1 fail the query."""
    schema = "priors map<string, struct<milling_time_seconds:struct<buckets:array<struct<seconds:double, probability:double>>>>>"
    p = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("priors").alias("group", "p")).select("group", F.posexplode("p.milling_time_seconds.buckets").alias("pos", "b"))
    w = Window.partitionBy("group")
    total = F.sum("b.probability").over(w)
    checked = F.when(F.abs(total - 1) > 1e-6, F.raise_error(F.lit("probabilities do not sum to 1")).cast("double")).otherwise(F.col("b.probability"))
    return p.select("group", F.col("b.seconds").alias("seconds"), checked.alias("probability"), F.sum("b.probability").over(w.orderBy("pos")).alias("cumulative"))


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("sha256"))


def hash_audit(spark: SparkSession, document: str, root: str) -> DataFrame:
    """(path, documented, actual, status) of the files below root against the manifest lines `digest  path` of a document: same, changed, missing, undocumented."""
    line = F.regexp_extract("value", r"^\s*([0-9a-f]{64})  (.+?)\s*$", 2)
    told = spark.read.text(document).select(line.alias("path"), F.regexp_extract("value", r"^\s*([0-9a-f]{64})  ", 1).alias("sha256")).filter("path <> ''")
    base = root.split("://")[-1].split(":", 1)[-1].rstrip("/") + "/"
    have = file_hashes(spark, root).withColumn("path", F.element_at(F.split("path", re.escape(base), 2), -1))
    return hash_drift(told, have)


def documented_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of manifest lines in a text file."""
    t = spark.read.text(path)
    return t.select(F.regexp_extract("value", r"([0-9a-f]{64})", 1).alias("sha256"), F.regexp_extract("value", r"[`\s|]([\w./-]+\.\w+)[`\s|]?", 1).alias("file")).filter("sha256 <> '' and file <> ''")


def scenario(path: str) -> dict:
    """A scenario or study document from YAML, without its envelope."""
    import yaml

    with open(path) as f:
        doc = yaml.safe_load(f)
    doc = doc.get("scenario", doc)
    return {**doc, "_source_file": path}


def dxf_primitives(spark: SparkSession, text: str) -> DataFrame:
    """Primitives (kind, layer, x, y arrays, radius) of LINE, CIRCLE, POINT and LWPOLYLINE entities in a DXF text."""
    lines = [x.strip() for x in text.splitlines()]
    pairs = list(zip(lines[::2], lines[1::2], strict=False))
    rows, kind, layer, xs, ys, r = [], None, "", [], [], None
    for code, value in [*pairs, ("0", "EOF")]:
        if code == "0":
            if kind in ("LINE", "CIRCLE", "POINT", "LWPOLYLINE"):
                rows.append((kind, layer, xs, ys, r))
            kind, layer, xs, ys, r = value, "", [], [], None
        elif code == "8":
            layer = value
        elif code in ("10", "11"):
            xs.append(float(value))
        elif code in ("20", "21"):
            ys.append(float(value))
        elif code == "40":
            r = float(value)
    return spark.createDataFrame(rows, "kind string, layer string, xs array<double>, ys array<double>, radius double")
