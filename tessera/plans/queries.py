"""Registered queries over the star-schema tables, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import haversine_miles
from ..operators import evaluation as E
from ..operators import locations as L
from ..operators import overlaps as O
from ..operators import projects as P
from ..operators.quotes import pages_holding
from ..sources.shared import durable
from ..sources.tables import page_numbers, read_table
from .proxies import DISTANCE_SQL, ELIGIBLE_SQL, OWNER_A, OWNER_B, PROJECTS_SQL, RANK_SQL, pairs_sql, projects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query of its own name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _found(spark, sf_dir: str, **how) -> O.Classes:
    """Classes of projects in pairs; the projects are read once for both sides."""
    return O.score_classes(durable(projects(spark, sf_dir)), OWNER_A, OWNER_B, **how)


def _pairs(spark: SparkSession, sf_dir: str, *columns: str, **how) -> DataFrame:
    """Scored pairs with overlap_id, the named columns of their projects, and rounded_miles."""
    return _found(spark, sf_dir, **how).rows(*columns or ["overlap_id"], told={"rounded_miles": _miles()})


def _ranked(spark, sf_dir, mode: str = "score") -> DataFrame:
    """Ranked pairs with the columns that reports of ranks need."""
    return O.ranked_pairs(_found(spark, sf_dir), mode, *O.SCORES, "total_score").withColumn("overlap_id", O.overlap_id())


def _miles():
    return F.round("distance_miles", 4).alias("distance_miles")


@query(f"WITH {pairs_sql()} SELECT overlap_id, round(distance_miles, 4) AS distance_miles, days_apart FROM pairs")
def overlap_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("overlap_id", F.col("rounded_miles").alias("distance_miles"), "days_apart")


def _globe(spark, sf_dir, side: str, table: str, key: str, factors: tuple[int, int]) -> DataFrame:
    k = F.col(key)
    return read_table(spark, sf_dir, table).select(k.alias(f"id_{side}"), ((k * factors[0] % 1801) / 10.0 - 90.0).alias(f"latitude_{side}"), ((k * factors[1] % 3601) / 10.0 - 180.0).alias(f"longitude_{side}"))


@query(f"""WITH a AS (SELECT s_suppkey AS id_a, s_suppkey * 37 % 1801 / 10.0::DOUBLE - 90.0 AS latitude, s_suppkey * 1091 % 3601 / 10.0::DOUBLE - 180.0 AS longitude FROM supplier),
b AS (SELECT c_custkey AS id_b, c_custkey * 53 % 1801 / 10.0::DOUBLE - 90.0 AS latitude, c_custkey * 71 % 3601 / 10.0::DOUBLE - 180.0 AS longitude FROM customer),
pairs AS (SELECT id_a, id_b, {DISTANCE_SQL} AS miles FROM a, b)
SELECT id_a, id_b, round(miles, 4) AS distance_miles FROM pairs WHERE miles <= 300.0""")
def overlap_grid_join(spark, sf_dir):
    """Pairs of points all over the globe, poles and the meridian of 180 degrees included; the twin compares every pair."""
    a, b = _globe(spark, sf_dir, "a", "supplier", "s_suppkey", (37, 1091)), _globe(spark, sf_dir, "b", "customer", "c_custkey", (53, 71))
    return O.pairs_by_grid(a, b, 300.0).select("id_a", "id_b", _miles())


_SCORES = "distance_score, timeline_overlap_score, days_apart_score, power_voltage_score, project_type_score, total_score"


@query(f"WITH {pairs_sql()} SELECT {RANK_SQL['score']} AS rank, overlap_id, {_SCORES} FROM pairs")
def overlap_ranked_score(spark, sf_dir):
    return _ranked(spark, sf_dir).select("rank", "overlap_id", *O.SCORES, "total_score")


@query(f"WITH {pairs_sql()} SELECT {RANK_SQL['distance_first']} AS rank, overlap_id, {_SCORES} FROM pairs")
def overlap_ranked_distance_first(spark, sf_dir):
    return _ranked(spark, sf_dir, "distance_first").select("rank", "overlap_id", *O.SCORES, "total_score")


@query(f"""WITH {pairs_sql()} SELECT (SELECT count(*) FROM projects) AS source_projects, (SELECT count(*) FROM eligible) AS eligible_centers,
  (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM pairs WHERE timeline_overlap = 'Yes') AS overlapping_windows,
  (SELECT count(*) FROM (SELECT utility_a, project_id_a FROM pairs UNION SELECT utility_b, project_id_b FROM pairs)) AS projects_with_pairs""")
def overlap_kpis(spark, sf_dir):
    return O.overlap_kpis(projects(spark, sf_dir), OWNER_A, OWNER_B)


_FIRM = "a.confidence IN ('High', 'Medium') AND b.confidence IN ('High', 'Medium')"


@query(f"WITH {pairs_sql(where=_FIRM)} SELECT overlap_id, round(distance_miles, 4) AS distance_miles, total_score FROM pairs")
def overlap_exclude_low(spark, sf_dir):
    return _pairs(spark, sf_dir, include_low=False).select("overlap_id", F.col("rounded_miles").alias("distance_miles"), "total_score")


@query(f"WITH {ELIGIBLE_SQL} SELECT utility, project_id, confidence, project_type FROM eligible")
def eligible_projects(spark, sf_dir):
    return O.eligible_projects(projects(spark, sf_dir)).select("utility", "project_id", "confidence", "project_type")


def _endpoints(spark, sf_dir) -> DataFrame:
    """Suppliers with two endpoints of which some are missing or out of bounds."""
    k = F.col("s_suppkey")
    rows = read_table(spark, sf_dir, "supplier")
    return rows.select(
        F.concat_ws("", F.lit("S"), k).alias("project_id"), F.lit(OWNER_A).alias("utility"), F.col("s_name").alias("project_name"),
        F.when(k % 3 != 0, F.lit(30.0) + (k * 37 % 1000) / F.lit(100.0)).alias("point_1_latitude"), F.when(k % 5 != 0, F.lit(-85.0) + (k * 91 % 1000) / F.lit(100.0)).alias("point_1_longitude"),
        F.when(k % 4 != 0, F.lit(31.0) + (k * 53 % 9000) / F.lit(100.0)).alias("point_2_latitude"), F.when(k % 4 != 0, F.lit(-84.0) + (k * 71 % 1000) / F.lit(100.0)).alias("point_2_longitude"),
        F.when(k % 2 == 0, "North").otherwise("").alias("point_1_name"), F.when(k % 6 == 0, "South").otherwise("").alias("point_2_name"),
        F.when(k % 7 == 0, 33.5).alias("latitude"), F.when(k % 7 == 0, -81.25).alias("longitude"),
        F.when(k % 10 == 0, "2/30/2024").when(k % 10 == 1, "12/31/23").when(k % 10 == 2, "").otherwise("2024-06-01").alias("start_date"),
        F.when(k % 9 == 0, "2023-01-01").when(k % 9 == 1, "soon").otherwise("2026-01-01").alias("in_service_date"),
        F.when(k % 5 == 0, "HIGH").when(k % 5 == 1, "medium").otherwise("?").alias("confidence"),
    )


_ENDPOINTS_SQL = f"""raw AS (
  SELECT 'S' || s_suppkey AS project_id, s_suppkey AS k,
    CASE WHEN s_suppkey % 3 <> 0 THEN 30.0::DOUBLE + (s_suppkey * 37 % 1000) / 100.0::DOUBLE END AS y1, CASE WHEN s_suppkey % 5 <> 0 THEN -85.0::DOUBLE + (s_suppkey * 91 % 1000) / 100.0::DOUBLE END AS x1,
    CASE WHEN s_suppkey % 4 <> 0 THEN 31.0::DOUBLE + (s_suppkey * 53 % 9000) / 100.0::DOUBLE END AS y2, CASE WHEN s_suppkey % 4 <> 0 THEN -84.0::DOUBLE + (s_suppkey * 71 % 1000) / 100.0::DOUBLE END AS x2,
    s_suppkey % 2 = 0 AS named1, s_suppkey % 6 = 0 AS named2, s_suppkey % 7 = 0 AS own
  FROM supplier),
ends AS (
  SELECT *, coalesce(y1 BETWEEN -90 AND 90 AND x1 BETWEEN -180 AND 180, false) AS p1, coalesce(y2 BETWEEN -90 AND 90 AND x2 BETWEEN -180 AND 180, false) AS p2,
    named1 OR y1 IS NOT NULL OR x1 IS NOT NULL AS w1, named2 OR y2 IS NOT NULL OR x2 IS NOT NULL AS w2 FROM raw),
centers AS (
  SELECT *, CASE WHEN p1 AND p2 THEN (y1 + y2) / 2 WHEN p1 THEN y1 WHEN p2 THEN y2 WHEN own AND NOT w1 AND NOT w2 THEN 33.5::DOUBLE END AS latitude,
    CASE WHEN p1 AND p2 THEN (x1 + x2) / 2 WHEN p1 THEN x1 WHEN p2 THEN x2 WHEN own AND NOT w1 AND NOT w2 THEN -81.25::DOUBLE END AS longitude,
    CASE WHEN p1 AND p2 THEN 'endpoint_midpoint' WHEN (p1 OR p2) AND w1 AND w2 THEN 'one_of_two_endpoints' WHEN p1 OR p2 THEN 'single_location'
      WHEN w1 OR w2 THEN 'unavailable' WHEN own THEN 'provided_center' ELSE 'unavailable' END AS center_method,
    CASE k % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS confidence
  FROM ends)"""


@query(f"WITH {_ENDPOINTS_SQL} SELECT project_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, center_method, confidence, CASE WHEN latitude IS NULL THEN 'Missing' ELSE 'Candidate' END AS location_status FROM centers")
def project_centers(spark, sf_dir):
    rows = P.prepare_projects(_endpoints(spark, sf_dir))
    return rows.select("project_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "center_method", "confidence", "location_status")


@query(f"""WITH {_ENDPOINTS_SQL}, dates AS (
  SELECT *, CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN DATE '2023-12-31' WHEN 2 THEN NULL ELSE DATE '2024-06-01' END AS s, k % 10 = 0 AS bad_s,
    CASE k % 9 WHEN 0 THEN DATE '2023-01-01' WHEN 1 THEN NULL ELSE DATE '2026-01-01' END AS e, k % 9 = 1 AS bad_e FROM centers)
SELECT project_id, concat_ws('; ',
  CASE WHEN NOT p1 AND (y1 IS NOT NULL OR x1 IS NOT NULL) THEN 'Point 1 incomplete or outside coordinate bounds' END,
  CASE WHEN NOT p2 AND (y2 IS NOT NULL OR x2 IS NOT NULL) THEN 'Point 2 incomplete or outside coordinate bounds' END,
  CASE WHEN latitude IS NULL THEN 'No usable project center' END, CASE WHEN bad_s THEN 'Invalid Start Date' END,
  CASE WHEN bad_e THEN 'Invalid In-Service Date' END, CASE WHEN s > e THEN 'Start Date is after In-Service Date' END) AS data_warnings FROM dates""")
def project_warnings(spark, sf_dir):
    return P.prepare_projects(_endpoints(spark, sf_dir)).select("project_id", "data_warnings")


_WIDTH = "CASE {0} WHEN 115000 THEN 100 WHEN 230000 THEN 100 WHEN 500000 THEN 150 END"
_STATE = "CASE WHEN {1} IN ('South Carolina', 'Georgia') THEN {1} WHEN {0} = 'a' THEN 'South Carolina' ELSE 'Georgia' END"
_VALUE = "CASE {0} WHEN 'Georgia' THEN 4950 ELSE 4900 END"


def _missing(side: str) -> str:
    p, k, m, v = f"project_id_{side}", f"k{side}", f"m{side}", f"v{side}"
    return f"CASE WHEN {k} NOT IN ('LINE', 'BOTH') THEN {p} || ' is not line work' WHEN {m} IS NULL OR {m} <= 0 THEN {p} || ' has no single line length in its plan' WHEN ({_WIDTH.format(v)}) IS NULL THEN {p} || '''s voltage has no typical easement width' END"


_IMPACT_SQL = f"""{pairs_sql()},
missing AS (SELECT *, concat_ws('; ', {_missing('a')}, {_missing('b')}) AS reasons,
  {_STATE.format("'a'", 'ra')} AS state_a, {_STATE.format("'b'", 'rb')} AS state_b FROM pairs)"""


@query(f"""WITH {_IMPACT_SQL}, known AS (
  SELECT overlap_id, state_a, state_b, least(ma, mb) AS shared_miles, least({_WIDTH.format('va')}, {_WIDTH.format('vb')}) AS row_width_feet,
    ({_VALUE.format('state_a')} + {_VALUE.format('state_b')}) / 2.0::DOUBLE AS land_value_per_acre FROM missing WHERE reasons = '')
SELECT *, round(shared_miles * 5280.0 * row_width_feet / 43560.0, 6) AS land_saved_acres,
  round(shared_miles * 5280.0 * row_width_feet / 43560.0 * land_value_per_acre, 2) AS land_saved_value_usd FROM known""")
def impact_estimate(spark, sf_dir):
    known = lambda s: F.col(f"_land_{s}.missing").isNull()
    rows = O.estimate_land(_pairs(spark, sf_dir, "_land_a", "_land_b", keep=known)).where("shared_miles is not null")
    return rows.select("overlap_id", "state_a", "state_b", "shared_miles", "row_width_feet", "land_value_per_acre", F.round("land_saved_acres", 6).alias("land_saved_acres"), F.round("land_saved_value_usd", 2).alias("land_saved_value_usd"))


@query(f"WITH {_IMPACT_SQL} SELECT overlap_id, 'No estimate: ' || reasons || '.' AS impact_explanation FROM missing WHERE reasons <> ''")
def impact_missing_reason(spark, sf_dir):
    return O.estimate_land(_pairs(spark, sf_dir, "_land_a", "_land_b")).where("shared_miles is null").select("overlap_id", "impact_explanation")


def _score_query(name: str, *columns: str):
    sql = f"WITH {pairs_sql()} SELECT overlap_id, {', '.join(columns)} FROM pairs"

    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("overlap_id", *columns)

    run.__name__ = name
    query(sql)(run)


_score_query("timeline_score", "timeline_overlap_score", "timeline_overlap")
_score_query("days_apart_score", "days_apart", "days_apart_score")
_score_query("voltage_score", "power_voltage_score")
_score_query("type_score", "project_type_score")


@query(f"""WITH {pairs_sql()}, reasons AS (SELECT *, CASE WHEN ka = '' OR kb = '' THEN 'project type unavailable' WHEN ka = kb THEN 'matching ' || lower(ka) || ' type'
    WHEN ka = 'BOTH' OR kb = 'BOTH' THEN 'one project supports both line and substation work' ELSE 'different project types' END AS kind_reason FROM pairs)
SELECT overlap_id, 'distance ' || printf('%.2f', distance_miles) || ' miles; ' || CASE state WHEN 'overlap' THEN 'build windows overlap' WHEN 'apart' THEN 'build windows do not overlap' WHEN 'unavailable' THEN 'timeline overlap unavailable' ELSE 'timeline dates inconsistent' END
  || '; ' || CASE WHEN days_apart IS NULL THEN 'days apart unavailable' ELSE days_apart || ' days apart' END
  || '; ' || ['voltage unavailable', 'different known voltages', 'similar voltage', 'same voltage'][power_voltage_score + 1] || '; ' || kind_reason AS reason FROM reasons""")
def ranking_reasons(spark, sf_dir):
    return _pairs(spark, sf_dir).select("overlap_id", F.col("ranking_reason").alias("reason"))


@query(f"""WITH {pairs_sql()}, ranked AS (SELECT *, {RANK_SQL['score']} AS rank FROM pairs),
sides AS (SELECT utility_a AS utility, project_id_a AS project_id, rank, overlap_id FROM ranked UNION ALL SELECT utility_b, project_id_b, rank, overlap_id FROM ranked)
SELECT utility, project_id, min(rank) AS rank, arg_min(overlap_id, rank) AS overlap_id FROM sides GROUP BY 1, 2""")
def best_pair_per_project(spark, sf_dir):
    return O.best_of_classes(_found(spark, sf_dir))


@query(f"""WITH {pairs_sql()} SELECT utility, project_id FROM projects WHERE (utility, project_id) NOT IN
  (SELECT (utility_a, project_id_a) FROM pairs UNION SELECT (utility_b, project_id_b) FROM pairs)""")
def projects_without_pair(spark, sf_dir):
    rows = durable(projects(spark, sf_dir))
    return O.projects_without_pair(rows, O.projects_in_pairs(rows, OWNER_A, OWNER_B)).select("utility", "project_id")


def _locations(spark, sf_dir) -> DataFrame:
    """Up to seven location rows per order, some of them twice, some without a point."""
    item = read_table(spark, sf_dir, "lineitem")
    return item.select(
        F.lit("L").alias("utility"), F.col("l_orderkey").cast("string").alias("project_id"), F.concat_ws("", F.lit("location_"), F.col("l_linenumber")).alias("location_role"),
        F.concat_ws("", F.lit("P"), F.col("l_partkey")).alias("target_location"), F.col("l_suppkey").alias("suppkey"),
        F.when(F.col("l_partkey") % 5 != 0, F.lit(30.0) + (F.col("l_partkey") % 1000) / F.lit(97.0)).alias("latitude"),
        F.when(F.col("l_partkey") % 5 != 0, F.lit(-85.0) + (F.col("l_suppkey") % 1000) / F.lit(97.0)).alias("longitude"),
        F.element_at(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("confidence"),
        F.col("l_returnflag").alias("source"), "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


_LOCATIONS_SQL = """locations AS (
  SELECT 'L' AS utility, CAST(l_orderkey AS VARCHAR) AS project_id, 'location_' || l_linenumber AS location_role, 'P' || l_partkey AS target_location, l_suppkey AS suppkey,
    CASE WHEN l_partkey % 5 <> 0 THEN 30.0::DOUBLE + (l_partkey % 1000) / 97.0::DOUBLE END AS latitude,
    CASE WHEN l_partkey % 5 <> 0 THEN -85.0::DOUBLE + (l_suppkey % 1000) / 97.0::DOUBLE END AS longitude,
    ['HIGH', 'MEDIUM', 'LOW'][l_suppkey % 3 + 1] AS confidence, l_returnflag AS source, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"""
_ROLE_ORDER = ("target_location", "suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "source")


@query(f"""WITH {_LOCATIONS_SQL}, per AS (SELECT project_id, count(*) AS total_locations, count(latitude) AS located_locations,
    ['HIGH', 'MEDIUM', 'LOW'][max(CASE confidence WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END)] AS overall_confidence,
    round(avg(latitude), 6) AS centroid_latitude, round(avg(longitude), 6) AS centroid_longitude FROM locations GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS project_id, coalesce(total_locations, 0) AS total_locations, coalesce(located_locations, 0) AS located_locations,
  coalesce(overall_confidence, 'LOW') AS overall_confidence, centroid_latitude, centroid_longitude FROM orders LEFT JOIN per ON per.project_id = CAST(o_orderkey AS VARCHAR)""")
def location_summary(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.lit("L").alias("utility"), F.col("o_orderkey").cast("string").alias("project_id"))
    rows = L.summarize_locations(orders, _locations(spark, sf_dir))
    return rows.select("project_id", "total_locations", "located_locations", "overall_confidence", F.round("centroid_latitude", 6).alias("centroid_latitude"), F.round("centroid_longitude", 6).alias("centroid_longitude"))


_FIRST_SQL = f"{_LOCATIONS_SQL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY utility, project_id, location_role ORDER BY {', '.join(_ROLE_ORDER)}) AS r FROM locations)"


@query(f"WITH {_FIRST_SQL} SELECT project_id, location_role, target_location, suppkey FROM firsts WHERE r = 1")
def location_first_per_role(spark, sf_dir):
    return L.first_per_role(_locations(spark, sf_dir), *_ROLE_ORDER).select("project_id", "location_role", "target_location", "suppkey")


@query(f"""WITH {_FIRST_SQL}, one AS (SELECT * FROM firsts WHERE r = 1)
SELECT project_id, max(target_location) FILTER (WHERE location_role = 'location_1') AS point_1_name, max(latitude) FILTER (WHERE location_role = 'location_1') AS point_1_latitude,
  max(target_location) FILTER (WHERE location_role = 'location_2') AS point_2_name, max(latitude) FILTER (WHERE location_role = 'location_2') AS point_2_latitude,
  ['High', 'Medium', 'Low'][max(CASE WHEN latitude IS NULL THEN 3 WHEN confidence = 'HIGH' THEN 1 WHEN confidence = 'MEDIUM' THEN 2 ELSE 3 END)] AS confidence FROM one GROUP BY 1""")
def locations_attached(spark, sf_dir):
    rows = _locations(spark, sf_dir)
    wide = L.attach_locations(rows.select("utility", "project_id").distinct(), rows, *_ROLE_ORDER)
    return wide.select("project_id", "point_1_name", "point_1_latitude", "point_2_name", "point_2_latitude", "confidence")


def _overrides(spark, sf_dir) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    exact = nation.select(F.lit("L").alias("utility"), (F.col("n_nationkey") * 3 + 1).cast("string").alias("project_id"), F.concat_ws("", F.lit("p"), F.col("n_nationkey") + 1).alias("target_location"), F.col("n_name").alias("matched_name"))
    general = nation.select(F.lit("L").alias("utility"), F.lit("").alias("project_id"), F.concat_ws("", F.lit("P"), F.col("n_nationkey") * 2).alias("target_location"), F.lower("n_name").alias("matched_name"))
    return exact.unionByName(general)


@query(f"""WITH {_LOCATIONS_SQL}, exact AS (SELECT CAST(n_nationkey * 3 + 1 AS VARCHAR) AS p, 'p' || (n_nationkey + 1) AS t, n_name AS m FROM nation),
general AS (SELECT 'p' || (n_nationkey * 2) AS t, lower(n_name) AS m FROM nation)
SELECT project_id, location_role, target_location, suppkey, coalesce(exact.m, general.m) AS override_matched_name, coalesce(exact.m, general.m) IS NOT NULL AS overridden
FROM locations LEFT JOIN exact ON exact.p = project_id AND exact.t = lower(target_location) LEFT JOIN general ON general.t = lower(target_location)""")
def override_priority_join(spark, sf_dir):
    rows = L.with_overrides(_locations(spark, sf_dir), _overrides(spark, sf_dir), ["matched_name"])
    return rows.select("project_id", "location_role", "target_location", "suppkey", "override_matched_name", "overridden")


def _candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers near suppliers as map features near seeds."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    seeds = read_table(spark, sf_dir, "supplier").select(
        k.alias("seed"), F.lit("Georgia Power").alias("utility"), F.concat_ws(" ", F.lit("Oak"), (k % 7).cast("string"), F.lit("Creek Substation")).alias("target_location"),
        F.array(F.lit("115000"), F.lit("230000")).alias("expected_voltages"), (F.lit(30.0) + (k * 37 % 1000) / F.lit(100.0)).alias("seed_latitude"), (F.lit(-85.0) + (k * 91 % 1000) / F.lit(100.0)).alias("seed_longitude"))
    features = read_table(spark, sf_dir, "customer").select(
        F.lit("node").alias("type"), c.alias("id"), (F.lit(30.0) + (c * 53 % 1000) / F.lit(100.0)).alias("latitude"), (F.lit(-85.0) + (c * 71 % 1000) / F.lit(100.0)).alias("longitude"),
        F.when(c % 3 == 0, "").when(c % 3 == 1, F.concat_ws(" ", F.lit("Oak"), (c % 7).cast("string"), F.lit("Creek"))).otherwise(F.concat_ws(" ", F.lit("Oak"), (c % 7).cast("string"))).alias("name"),
        F.when(c % 2 == 0, "Georgia Power Co").otherwise("").alias("operator"), F.when(c % 4 == 0, "115000;230000").when(c % 4 == 1, "230000").otherwise("46000").alias("voltage"))
    return seeds, features


def candidate_sql(seeds: str) -> str:
    """The CTEs up to `scored`: seeds (seed, target, latitude, longitude) against customers as features."""
    return f"""a AS ({seeds}),
b AS (SELECT c_custkey AS id, 30.0::DOUBLE + (c_custkey * 53 % 1000) / 100.0::DOUBLE AS latitude, -85.0::DOUBLE + (c_custkey * 71 % 1000) / 100.0::DOUBLE AS longitude,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'oak ' || (c_custkey % 7) || ' creek' ELSE 'oak ' || (c_custkey % 7) END AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS operator_points, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS volt_points FROM customer),
near AS (SELECT seed, id, target, name, operator_points, volt_points, {DISTANCE_SQL} AS miles FROM a, b WHERE {DISTANCE_SQL} <= 25000 / 1609.344::DOUBLE),
scored AS (SELECT *, CASE WHEN name = '' THEN 0 WHEN name = target THEN 6 WHEN contains(target, name) OR contains(name, target) THEN 5
    WHEN len(list_intersect(string_split(name, ' '), string_split(target, ' '))) / len(list_distinct(list_concat(string_split(name, ' '), string_split(target, ' ')))) >= 0.67 THEN 4
    WHEN len(list_intersect(string_split(name, ' '), string_split(target, ' '))) / len(list_distinct(list_concat(string_split(name, ' '), string_split(target, ' ')))) >= 0.40 THEN 2 ELSE 0 END
  + operator_points + volt_points + CASE WHEN miles <= 2 THEN 2.0 WHEN miles <= 8 THEN 1.0 WHEN miles <= 15 THEN 0.5 ELSE 0.0 END::DOUBLE AS match_score FROM near)"""


_CANDIDATE_SQL = candidate_sql("SELECT s_suppkey AS seed, 'oak ' || (s_suppkey % 7) || ' creek' AS target, 30.0::DOUBLE + (s_suppkey * 37 % 1000) / 100.0::DOUBLE AS latitude, -85.0::DOUBLE + (s_suppkey * 91 % 1000) / 100.0::DOUBLE AS longitude FROM supplier")


@query(f"WITH {_CANDIDATE_SQL} SELECT seed, id, round(miles, 4) AS miles, match_score FROM scored")
def name_match_score(spark, sf_dir):
    return L.scored_near(*_candidates(spark, sf_dir)).select("seed", "id", F.round("distance_from_seed_miles", 4).alias("miles"), "match_score")


@query(f"""WITH {_CANDIDATE_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY match_score DESC, id) AS r FROM scored)
SELECT seed, id, match_score, CASE WHEN match_score >= 8 AND name <> '' THEN 'HIGH' WHEN match_score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM best WHERE r = 1""")
def candidate_best_match(spark, sf_dir):
    return L.best_near(*_candidates(spark, sf_dir)).where("_b is not null").select("seed", "_b.id", "_b.match_score", "_b.confidence")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return P.duplicate_keys(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def utility_union_by_name(spark, sf_dir):
    a = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = read_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return P.union_projects([a, b])


def _titles(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    title = F.concat_ws("", F.col("p_name"), F.lit(" - "), F.col("p_brand"), F.when(k % 3 == 0, F.lit(" 230/115 kV ")).when(k % 3 == 1, F.lit(" 46kV ")).otherwise(F.lit(" ")), F.col("p_size"), F.when(k % 4 == 0, F.lit(" miles and 2.5 miles")).when(k % 4 == 1, F.lit(" miles")).otherwise(F.lit(" ft")))
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_size", title.alias("title"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '230000;115000' WHEN 1 THEN '46000' ELSE '' END AS voltages FROM part")
def extract_voltages(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", F.array_join(T.voltages_in(F.col("title")).cast("array<string>"), ";").alias("voltages"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [CAST(p_size AS DOUBLE), 2.5::DOUBLE] WHEN 1 THEN [CAST(p_size AS DOUBLE)] ELSE [] END[1] AS first_miles, CAST(CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS n_miles FROM part")
def extract_miles(spark, sf_dir):
    miles = T.miles_in(F.col("title"))
    return _titles(spark, sf_dir).select("p_partkey", F.get(miles, F.lit(0)).alias("first_miles"), F.size(miles).cast("long").alias("n_miles"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size AS DOUBLE) END AS line_miles FROM part")
def single_mileage(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", T.single(T.miles_in(F.col("title"))).alias("line_miles"))


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders").withColumn("utility", F.col("o_orderstatus")).withColumn("project_id", k.cast("string"))
    found = rows.where(k % 17 != 0).select(
        "utility", "project_id", F.when(k % 5 == 0, F.upper("o_orderpriority")).when(k % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("project_name"),
        F.when(k % 3 == 0, "1.50").otherwise("2").alias("line_miles"), F.when(k % 4 == 0, "2024-01-01").otherwise("").alias("start_date"), F.when(k % 2 == 0, "VERIFIED").otherwise("REVIEW").alias("status"))
    reference = rows.where(k % 19 != 0).select(
        "utility", "project_id", F.col("o_orderpriority").alias("project_name"), F.when(k % 6 == 0, "1.5").otherwise("2.0").alias("line_miles"), F.when(k % 8 == 0, "2024-01-01").when(k % 9 == 0, "2023-01-01").otherwise("").alias("start_date"))
    return found, reference


_CELLS_SQL = """matched AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0),
cells AS (
  SELECT k, 'project_name' AS "column", CASE WHEN k % 5 = 0 THEN 'same' WHEN k % 7 = 0 THEN 'blank in AI' ELSE 'same' END AS outcome FROM matched
  UNION ALL SELECT k, 'line_miles', CASE WHEN (k % 3 = 0) = (k % 6 = 0) THEN 'same' ELSE 'differ' END FROM matched
  UNION ALL SELECT k, 'start_date', CASE WHEN k % 8 = 0 THEN 'same' WHEN k % 9 = 0 THEN CASE WHEN k % 4 = 0 THEN 'differ' ELSE 'blank in AI' END WHEN k % 4 = 0 THEN 'only in AI' ELSE 'same' END FROM matched)"""


@query(f"""WITH {_CELLS_SQL} SELECT "column", count(*) FILTER (WHERE outcome = 'same') AS "same", count(*) FILTER (WHERE outcome = 'differ') AS "differ",
  count(*) FILTER (WHERE outcome = 'blank in AI') AS "blank in AI", count(*) FILTER (WHERE outcome = 'only in AI') AS "only in AI" FROM cells GROUP BY 1""")
def eval_outcome_crosstab(spark, sf_dir):
    return E.outcome_crosstab(E.compare_cells(*_versions(spark, sf_dir)))


@query(f"""WITH {_CELLS_SQL}, per AS (SELECT k, bool_or("column" IN ('project_name', 'start_date') AND outcome <> 'same' AND NOT ("column" = 'start_date' AND outcome = 'blank in AI')) AS wrong,
    count(*) FILTER (WHERE outcome = 'differ' AND "column" = 'line_miles') AS differ FROM cells WHERE k % 2 = 0 GROUP BY 1)
SELECT count(*) AS verified, count(*) FILTER (WHERE wrong) AS verified_but_wrong, CAST(coalesce(sum(differ), 0) AS BIGINT) AS verified_differences FROM per""")
def eval_verified_summary(spark, sf_dir):
    return E.verified_summary(E.compare_cells(*_versions(spark, sf_dir)))


@query("""SELECT o_orderstatus AS utility, CAST(o_orderkey AS VARCHAR) AS project_id, CASE WHEN o_orderkey % 17 = 0 THEN 'missing' WHEN o_orderkey % 19 = 0 THEN 'extra' ELSE 'matched' END AS state
FROM orders WHERE o_orderkey % (17 * 19) <> 0""")
def eval_missing_extra(spark, sf_dir):
    return E.match_rows(*_versions(spark, sf_dir))


def _quoted(spark, sf_dir, whole_words: bool) -> DataFrame:
    quotes = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    pages = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = pages_holding(quotes, pages, ["doc_id"], whole_words=whole_words)
    per = hits.groupBy("quote").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document"))
    return quotes.join(per, "quote", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "first_document")


@query("""WITH clean AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM documents), quotes AS (SELECT item_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS q FROM benchmark)
SELECT item_id, count(doc_id) AS n_documents, min(doc_id) AS first_document FROM quotes LEFT JOIN clean ON contains(t, q) AND q <> '' GROUP BY 1""")
def quote_on_page(spark, sf_dir):
    """Benchmark texts as quotes, documents as pages: how many hold each, words or parts of words."""
    return _quoted(spark, sf_dir, whole_words=False)


_PLAIN_SQL = "trim(lower(regexp_replace(translate(text, '\u2012\u2013\u2014\u2212', '----'), '\\s+', ' ', 'g')))"


@query(f"""WITH clean AS (SELECT doc_id, {_PLAIN_SQL} AS t FROM documents), quotes AS (SELECT item_id, replace({_PLAIN_SQL}, ' ', '') AS q FROM benchmark),
patterns AS (SELECT item_id, q, CASE WHEN regexp_matches(q, '^[\\pL\\pN]') THEN '(^|[^\\pL\\pN])' ELSE '' END || regexp_replace(q, '(.)', '\\\\Q\\1\\\\E ?', 'gs')
    || CASE WHEN regexp_matches(q, '[\\pL\\pN]$') THEN '($|[^\\pL\\pN])' ELSE '' END AS p FROM quotes)
SELECT item_id, count(doc_id) AS n_documents, min(doc_id) AS first_document FROM patterns LEFT JOIN clean ON q <> '' AND contains(replace(t, ' ', ''), q) AND regexp_matches(t, p) GROUP BY 1""")
def quote_whole_words(spark, sf_dir):
    """As quote_on_page, but a quote counts only as whole words."""
    return _quoted(spark, sf_dir, whole_words=True)


@query("SELECT DISTINCT unnest(range(o_custkey, o_custkey + 3)) AS page FROM orders")
def page_ranges(spark, sf_dir):
    spec = F.concat_ws("", F.col("o_custkey"), F.lit("-"), F.col("o_custkey") + 1, F.lit(", "), F.col("o_custkey") + 2)
    return page_numbers(read_table(spark, sf_dir, "orders").select(spec.alias("pages"))).select(F.col("page").cast("long").alias("page"))


@query(f"WITH {PROJECTS_SQL} SELECT project_type, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, project_type) AS place FROM projects GROUP BY 1")
def type_frequencies(spark, sf_dir):
    counts = projects(spark, sf_dir).groupBy("project_type").agg(F.count("*").alias("n"))
    return O.rank_rows(counts, [F.desc("n"), F.asc("project_type")], "place")


@query("""SELECT a.s_suppkey AS a, b.n_nationkey AS b, round(2.0 * 3958.8 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(b.n_nationkey * 3.0::DOUBLE) - radians(a.s_suppkey % 80 * 1.0::DOUBLE)) / 2.0), 2.0)
    + cos(radians(a.s_suppkey % 80 * 1.0::DOUBLE)) * cos(radians(b.n_nationkey * 3.0::DOUBLE)) * pow(sin((radians(-80.0::DOUBLE) - radians(-85.0::DOUBLE)) / 2.0), 2.0))))), 4) AS miles FROM supplier a JOIN nation b ON a.s_nationkey = b.n_nationkey""")
def haversine(spark, sf_dir):
    pairs = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    miles = haversine_miles((F.col("s_suppkey") % 80).cast("double"), F.lit(-85.0), F.col("n_nationkey") * F.lit(3.0), F.lit(-80.0))
    return pairs.select(F.col("s_suppkey").alias("a"), F.col("n_nationkey").alias("b"), F.round(miles, 4).alias("miles"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def reply_fields(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


from . import extraction_queries, plan_queries  # noqa: E402, F401  register their queries here
