"""Fields at points, submissions, hashes, provenance, attributes and natural joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.functions.bounds import spread
from egresslake.operators import fields as D
from egresslake.operators import submissions as S
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import TRAJ_SQL, table, traj
from egresslake.sources import references as R

FIELD = D.Field(origin=(1.0, 1.0), cell_size=0.8, base_z=0.5, height_aware=True, layer_base_m=1.0, layer_top_m=2.0, vertical_decay_m=1.5)
X_EDGES, Y_EDGES = (0.0, 1.0, 2.5, 4.5, 7.0, 10.0), (0.0, 0.5, 3.0, 9.0)
HASHES = {k: S.content_hash(s.document()) for k, s in S.suites().items()}


def raster(spark, sf_dir):
    """A raster of 9 by 9 cells: mean discounts and taxes of line items by part and supplier; some values are missing.

    Values are rounded to whole hundredths as doubles, and means half up to six digits, so they do not depend on the order of the sums.
    """
    li = table(spark, sf_dir, "lineitem")
    mean = {n: F.expr(f"((20000 * sum(cast(round({c} * 100) as decimal(18,0))) + count({c})) div nullif(2 * count({c}), 0)) / 1000000d").alias(n) for n, c in (("d", "l_discount"), ("t", "l_tax"))}
    g = li.groupBy((F.col("l_partkey") % 9).cast("int").alias("ix"), (F.col("l_suppkey") % 9).cast("int").alias("iy")).agg(mean["d"], mean["t"])
    odd = (F.col("ix") + F.col("iy")) % 5 == 0
    return g.select("ix", "iy", (F.col("d") * 10).alias("intensity"), (1 - F.col("d") * 8).alias("visibility"), F.when(~odd, F.col("t") * 200).alias("visibility_m"), F.col("t").alias("gas_concentration"), (F.col("d") * 3).alias("obscuration"))


def points(spark, sf_dir):
    return traj(spark, sf_dir).select("event_id", "x", "y", (F.col("k") / 4.0).alias("z"))


def q_field_samples(spark, sf_dir):
    return rounded(D.sampled_field(points(spark, sf_dir), raster(spark, sf_dir), FIELD, z="z"))


def q_field_edges(spark, sf_dir):
    return rounded(D.sampled_field(points(spark, sf_dir).drop("z"), raster(spark, sf_dir), D.Field(x_edges=X_EDGES, y_edges=Y_EDGES)))


def q_route_penalty(spark, sf_dir):
    """Points whose height is not known have no penalty, but for closed ones."""
    s = D.sampled_field(points(spark, sf_dir), raster(spark, sf_dir), FIELD, z="z")
    closed = F.col("event_id") % 11 == 0
    cost = D.route_penalty(F.col("intensity"), F.col("obscuration"), F.col("z") / 5, closed, 1.2371)
    return rounded(s.select("event_id", F.when(closed | F.col("z").isNotNull(), cost).alias("penalty")), 5)


def payloads(spark, sf_dir):
    """Customers' submissions: right ones, and ones with a wrong hash, order, seed, suite or scenario."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    k = F.col("c_custkey")
    names = F.when(k % 7 == 0, F.array(F.lit("flood_urban"))).otherwise(F.array(F.lit("flood_urban"), F.lit("quake_aftershock")))
    low = F.when(k % 5 == 0, F.lit(60.5)).otherwise(F.lit(40.5))
    seeds = F.when(k % 11 == 0, F.array(F.lit(42), F.lit(42))).otherwise(F.array(F.lit(42), F.lit(137)))
    block = [F.lit(50.25).alias("mean_score"), low.alias("score_ci_low"), F.lit(61.5).alias("score_ci_high"), F.lit(2).alias("run_count")]
    doc = F.struct(
        F.lit("s1").alias("schema_version"), F.when(k % 13 == 0, F.lit("v9")).otherwise(F.lit("v3")).alias("suite"), F.col("c_name").alias("submitter"),
        F.when(k % 3 == 0, F.lit("xyz")).otherwise(F.lit("0123456789abcdef")).alias("policy_hash"), F.lit(HASHES["v3"]).alias("config_hash"), F.struct(F.lit("3").alias("python"), F.lit("linux").alias("platform")).alias("env_version"),
        seeds.alias("seed_set"), F.struct(*block, F.lit("smoke").alias("tier")).alias("overall"), F.transform(names, lambda n: F.struct(n.alias("scenario"), F.lit(1.5).alias("mean_score"), F.lit(1).alias("score_ci_low"), F.lit(2).alias("score_ci_high"), F.lit(1).alias("run_count"), seeds.alias("seeds_used"))).alias("scenarios"),
    )
    return c.select(k.alias("submission_id"), F.when(k % 17 == 0, F.lit("[1]")).otherwise(F.to_json(doc)).alias("payload"))


def q_submission_issues(spark, sf_dir):
    return S.submission_issues(payloads(spark, sf_dir), schema_version="s1")


def q_hash_drift(spark, sf_dir):
    """Documented and computed hashes of suppliers' names: every tenth is changed, every seventh undocumented, every ninth gone."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("path"))
    a = s.filter("k % 7 <> 0").select("path", F.sha2(F.when(F.col("k") % 10 == 0, F.concat("path", F.lit("!"))).otherwise(F.col("path")), 256).alias("sha256"))
    return S.hash_drift(a, s.filter("k % 9 <> 0").select("path", F.sha2("path", 256).alias("sha256")))


def q_attribute_columns(spark, sf_dir):
    """Properties of events, whose names only the data know, as typed columns."""
    e = table(spark, sf_dir, "events")
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("half"), (F.col("event_id") / 2).cast("string"), F.lit("even"), (F.col("event_id") % 2 == 0).cast("string"), F.lit("kind"), F.col("event_type")))
    return R.widened(e.select("event_id", m.alias("m")), "m")


def q_natural_join(spark, sf_dir):
    """Orders and line items' sums share two columns, of which one may be missing."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "o_totalprice")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_linestatus").alias("status"), F.count(F.lit(1)).alias("lines"))
    return R.natural_join(o, li.withColumn("status", F.when(F.col("key") % 4 != 0, F.col("status"))))


def q_station_issues(spark, sf_dir):
    """Provenance of suppliers as stations; fields are missing or empty by key."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    full = {c: F.lit(c) for c in R.STATION if c not in ("manual_edits", "known_missing_indoor_topology", "validation_use", "level")}
    doc = F.struct(
        *[v.alias(c) for c, v in full.items()], F.when(k % 3 != 0, F.lit("B1")).alias("level"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("manual_edits"),
        F.array(F.lit("b")).alias("known_missing_indoor_topology"), F.when(k % 5 == 0, F.lit("proof")).otherwise(F.lit("Diagnostic only")).alias("validation_use"), F.when(k % 6 != 0, F.array(F.lit("f"))).alias("source_files"),
    )
    return R.station_issues(s.select("s_suppkey", F.when(k % 8 != 0, F.to_json(doc)).alias("payload"), (k % 2 == 0).alias("report")), "s_suppkey", "payload", "report")


QUERIES = {f.__name__: f for f in (q_field_samples, q_field_edges, q_route_penalty, q_submission_issues, q_hash_drift, q_attribute_columns, q_natural_join, q_station_issues)}

# fmt: off
_mean = lambda c: f"((20000 * sum(round({c} * 100)::BIGINT) + count({c})) // (2 * nullif(count({c}), 0)))::DOUBLE / 1000000"  # noqa: E731 - of hundredths, half up
_raster = f"""r AS (SELECT l_partkey % 9 AS ix, l_suppkey % 9 AS iy, {_mean('l_discount')} AS d, {_mean('l_tax')} AS t FROM lineitem GROUP BY 1, 2)"""
_values = """coalesce(d * 10 * f, 0) AS intensity, CASE WHEN d IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - (1 - greatest(0.0, least(1.0, 1 - d * 8))) * f)) END AS visibility, coalesce(t * f, 0) AS gas_concentration, coalesce(d * 3 * f, 0) AS obscuration,
  CASE WHEN (ix + iy) % 5 <> 0 THEN greatest(0.0, least(30.0, 30 - (30 - greatest(0.0, least(30.0, t * 200))) * f)) END AS vm"""
_samples = f"""{TRAJ_SQL}, {_raster}, p AS (SELECT event_id, x, y, k / 4.0::DOUBLE AS z, floor((x - 1.0) / 0.8::DOUBLE)::INT AS ix, floor((y - 1.0) / 0.8::DOUBLE)::INT AS iy FROM traj),
  s AS (SELECT event_id, x, y, z, {_values} FROM (SELECT p.*, d, t, exp(-greatest(1.0 - (z - 0.5), (z - 0.5) - 2.0, 0.0) / 1.5::DOUBLE) AS f FROM p LEFT JOIN r USING (ix, iy)))"""
_rounded = "round(intensity, 6) AS intensity, round(visibility, 6) AS visibility, round(coalesce(vm, visibility * 30), 6) AS visibility_m, round(gas_concentration, 6) AS gas_concentration, round(obscuration, 6) AS obscuration"
_at = lambda v, edges: "CASE " + " ".join(f"WHEN {v} >= {a} AND {v} < {b} THEN {i}" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))) + " END"
SQL = {
    "q_field_samples": f"WITH {_samples} SELECT event_id, x, y, z, {_rounded} FROM s",
    "q_field_edges": f"""WITH {TRAJ_SQL}, {_raster}, p AS (SELECT event_id, x, y, {_at('x', X_EDGES)} AS ix, {_at('y', Y_EDGES)} AS iy FROM traj), s AS (SELECT event_id, x, y, {_values} FROM (SELECT p.*, d, t, 1.0::DOUBLE AS f FROM p LEFT JOIN r USING (ix, iy)))
      SELECT event_id, x, y, {_rounded} FROM s""",
    "q_route_penalty": f"""WITH {_samples} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Infinity'::DOUBLE ELSE round((1.2371::DOUBLE * (intensity + obscuration + CASE WHEN z <= 0 THEN 0 ELSE (z / 5) / 0.3::DOUBLE + CASE WHEN z / 5 >= 0.9 THEN 10 ELSE 0 END END))::VARCHAR::DECIMAL(38, 20), 5)::DOUBLE END AS penalty FROM s""",
    "q_submission_issues": f"""WITH c AS (SELECT c_custkey AS submission_id, c_custkey AS k FROM customer), g AS (SELECT * FROM c WHERE k % 17 <> 0)
      SELECT submission_id, '$' AS path, 'submission must be a JSON object' AS message FROM c WHERE k % 17 = 0
      UNION ALL SELECT submission_id, '$.suite', 'must be one of v1, v2, v3' FROM g WHERE k % 13 = 0
      UNION ALL SELECT submission_id, '$.policy_hash', 'must be 16 to 64 hexadecimal digits' FROM g WHERE k % 3 = 0
      UNION ALL SELECT submission_id, '$.seed_set', 'seeds must be unique' FROM g WHERE k % 11 = 0
      UNION ALL SELECT submission_id, '$.overall', 'score CI must satisfy low <= mean <= high' FROM g WHERE k % 5 = 0
      UNION ALL SELECT submission_id, '$.scenarios[' || i::VARCHAR || '].seeds_used', 'seeds must be unique' FROM g, (SELECT unnest([0, 1]) AS i) WHERE k % 11 = 0 AND (i = 0 OR k % 7 <> 0)
      UNION ALL SELECT submission_id, '$.scenarios', 'must match suite scenarios: missing quake_aftershock; extra ' FROM g WHERE k % 7 = 0 AND k % 13 <> 0""",
    "q_hash_drift": """WITH a AS (SELECT s_name AS path, sha256(CASE WHEN s_suppkey % 10 = 0 THEN s_name || '!' ELSE s_name END) AS documented FROM supplier WHERE s_suppkey % 7 <> 0), b AS (SELECT s_name AS path, sha256(s_name) AS actual FROM supplier WHERE s_suppkey % 9 <> 0)
      SELECT path, documented, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN documented IS NULL THEN 'undocumented' WHEN actual = documented THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path)""",
    "q_attribute_columns": "SELECT event_id, event_id % 2 = 0 AS attribute_even, event_id / 2 AS attribute_half, json_extract(props, '$.k')::BIGINT AS attribute_k, event_type AS attribute_kind FROM events",
    "q_natural_join": """WITH o AS (SELECT o_orderkey AS key, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_totalprice FROM orders), l AS (SELECT l_orderkey AS key, CASE WHEN l_orderkey % 4 <> 0 THEN min(l_linestatus) END AS status, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
      SELECT o.key, o.status, o_totalprice, lines FROM o LEFT JOIN l ON o.key = l.key AND o.status IS NOT DISTINCT FROM l.status""",
    "q_station_issues": """WITH s AS (SELECT s_suppkey, s_suppkey AS k FROM supplier), g AS (SELECT * FROM s WHERE k % 8 <> 0)
      SELECT s_suppkey, 'provenance is missing' AS issue FROM s WHERE k % 8 = 0 AND k % 2 = 0 UNION ALL SELECT s_suppkey, 'missing: level' FROM g WHERE k % 3 = 0 UNION ALL SELECT s_suppkey, 'missing: manual_edits' FROM g WHERE k % 4 = 0
      UNION ALL SELECT s_suppkey, 'one of gtfs_feeds, osm_objects, source_files is needed' FROM g WHERE k % 6 = 0 UNION ALL SELECT s_suppkey, 'limits of validation must be stated' FROM g WHERE k % 5 = 0 AND k % 2 = 0""",
}
# fmt: on
