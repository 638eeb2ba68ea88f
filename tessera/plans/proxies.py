"""Project tables derived from the star-schema test tables, for queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

OWNER_A, OWNER_B = "Dominion Energy South Carolina", "Georgia Power"


def _attributes(key: str, lat_factor: int, lon_factor: int) -> dict:
    k = F.col(key)
    return {
        "latitude": F.lit(30.0) + (k * lat_factor % 1000) / F.lit(100.0),
        "longitude": F.lit(-85.0) + (k * lon_factor % 1000) / F.lit(100.0),
        "voltage": F.when(k % 7 != 0, F.element_at(F.array(*map(F.lit, (46000, 115000, 230000, 500000))), (k % 4 + 1).cast("int"))),
        "project_type": F.element_at(F.array(*map(F.lit, ("LINE", "MULTI_LINE", "SUBSTATION", "MULTI_SITE", "BOTH", "UNKNOWN"))), (k % 6 + 1).cast("int")),
        "confidence": F.element_at(F.array(*map(F.lit, ("LOW", "medium", "High", " high ", ""))), (k % 5 + 1).cast("int")),
        "match_status": F.when(k % 11 == 0, "Excluded").otherwise("Matched"),
        "location_status": F.when(k % 13 == 5, "excluded").otherwise(""),
        "line_miles": F.when(k % 40 != 0, (k % 40) / F.lit(2.0)),
        "region": F.when(k % 3 == 0, "South Carolina").when(k % 3 == 1, "Georgia").otherwise(""),
    }


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as one owner's projects and customers as the other's, with build windows from their items and orders."""
    windows_a = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(F.to_date("l_shipdate")).alias("lo"), F.max(F.to_date("l_shipdate")).alias("hi"))
    windows_b = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))

    def side(table, key, name, owner, prefix, windows, window_key, factors):
        rows = table.select(key, name).join(windows, F.col(key) == F.col(window_key), "left")
        start, end = F.when(F.col(key) % 9 != 0, F.col("lo")), F.when(F.col(key) % 13 != 0, F.col("hi"))
        return rows.select(
            F.concat_ws("", F.lit(prefix), F.col(key)).alias("project_id"),
            F.lit(owner).alias("utility"),
            F.col(name).alias("project_name"),
            *[c.alias(n) for n, c in _attributes(key, *factors).items()],
            F.date_format(start, "yyyy-MM-dd").alias("start_date"),
            F.date_format(end, "yyyy-MM-dd").alias("in_service_date"),
        )

    a = side(read_table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", OWNER_A, "A", windows_a, "l_suppkey", (37, 91))
    b = side(read_table(spark, sf_dir, "customer"), "c_custkey", "c_name", OWNER_B, "B", windows_b, "o_custkey", (53, 71))
    return a.unionByName(b).withColumn("confidence", F.when(F.initcap(F.trim("confidence")).isin("High", "Medium", "Low"), F.initcap(F.trim("confidence"))).otherwise("Low"))


def _side_sql(table: str, key: str, name: str, owner: str, prefix: str, source: str, source_key: str, date: str, lat: int, lon: int) -> str:
    return f"""
  SELECT '{prefix}' || {key} AS project_id, '{owner}' AS utility, {name} AS project_name,
    CAST(30 AS DOUBLE) + ({key} * {lat} % 1000) / CAST(100 AS DOUBLE) AS latitude,
    CAST(-85 AS DOUBLE) + ({key} * {lon} % 1000) / CAST(100 AS DOUBLE) AS longitude,
    CASE WHEN {key} % 7 <> 0 THEN CAST([46000, 115000, 230000, 500000][{key} % 4 + 1] AS INTEGER) END AS voltage,
    ['LINE', 'MULTI_LINE', 'SUBSTATION', 'MULTI_SITE', 'BOTH', 'UNKNOWN'][{key} % 6 + 1] AS project_type,
    ['Low', 'Medium', 'High', 'High', 'Low'][{key} % 5 + 1] AS confidence,
    CASE WHEN {key} % 11 = 0 THEN 'Excluded' ELSE 'Matched' END AS match_status,
    CASE WHEN {key} % 13 = 5 THEN 'excluded' ELSE '' END AS location_status,
    CASE WHEN {key} % 40 <> 0 THEN ({key} % 40) / CAST(2 AS DOUBLE) END AS line_miles,
    CASE {key} % 3 WHEN 0 THEN 'South Carolina' WHEN 1 THEN 'Georgia' ELSE '' END AS region,
    CASE WHEN {key} % 9 <> 0 THEN lo END AS start_date,
    CASE WHEN {key} % 13 <> 0 THEN hi END AS in_service_date
  FROM {table} LEFT JOIN (
    SELECT {source_key} AS k, CAST(min({date}) AS DATE) AS lo, CAST(max({date}) AS DATE) AS hi FROM {source} GROUP BY 1) ON k = {key}"""


PROJECTS_SQL = f"""projects AS ({_side_sql("supplier", "s_suppkey", "s_name", OWNER_A, "A", "lineitem", "l_suppkey", "l_shipdate", 37, 91)}
  UNION ALL {_side_sql("customer", "c_custkey", "c_name", OWNER_B, "B", "orders", "o_custkey", "o_orderdate", 53, 71)})"""

ELIGIBLE_SQL = f"""{PROJECTS_SQL},
eligible AS (SELECT * FROM projects WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
  AND lower(match_status) <> 'excluded' AND lower(location_status) <> 'excluded')"""

_HALF = "pow(sin((radians(b.{0}) - radians(a.{0})) / 2.0), 2.0)"
DISTANCE_SQL = f"""2.0 * 3958.8 * asin(sqrt(least(1.0, greatest(0.0, {_HALF.format("latitude")}
    + cos(radians(a.latitude)) * cos(radians(b.latitude)) * {_HALF.format("longitude")}))))"""


def pairs_sql(miles: float = 25, where: str = "true") -> str:
    """The CTEs up to `pairs`: all pairs, scored."""
    kind = lambda c: f"CASE WHEN {c} IN ('LINE', 'MULTI_LINE') THEN 'LINE' WHEN {c} = 'SUBSTATION' THEN 'SUBSTATION' WHEN {c} IN ('BOTH', 'MULTI_SITE') THEN 'BOTH' ELSE '' END"
    return f"""{ELIGIBLE_SQL},
near AS (
  SELECT a.utility AS utility_a, a.project_id AS project_id_a, b.utility AS utility_b, b.project_id AS project_id_b,
    {DISTANCE_SQL} AS distance_miles,
    CASE WHEN a.in_service_date >= b.in_service_date THEN a.in_service_date - b.in_service_date ELSE b.in_service_date - a.in_service_date END AS days_apart,
    a.start_date AS sa, a.in_service_date AS ea, b.start_date AS sb, b.in_service_date AS eb,
    CAST(a.voltage AS DOUBLE) AS va, CAST(b.voltage AS DOUBLE) AS vb, {kind("a.project_type")} AS ka, {kind("b.project_type")} AS kb,
    a.line_miles AS ma, b.line_miles AS mb, a.region AS ra, b.region AS rb
  FROM eligible a, eligible b
  WHERE a.utility = '{OWNER_A}' AND b.utility = '{OWNER_B}' AND {DISTANCE_SQL} <= {miles} AND {where}),
states AS (
  SELECT *, utility_a || ':' || project_id_a || ' | ' || utility_b || ':' || project_id_b AS overlap_id,
    CASE WHEN ea IS NULL OR eb IS NULL THEN 'unavailable' WHEN sb IS NULL THEN 'unavailable'
      WHEN coalesce(sa, DATE '0001-01-01') > ea OR sb > eb THEN 'inconsistent'
      WHEN greatest(coalesce(sa, DATE '0001-01-01'), sb) <= least(ea, eb) THEN 'overlap' ELSE 'apart' END AS state
  FROM near),
scored AS (
  SELECT *,
    CASE WHEN distance_miles <= 5 THEN 3 WHEN distance_miles <= 15 THEN 2 WHEN distance_miles <= 25 THEN 1 ELSE 0 END AS distance_score,
    CASE WHEN state = 'overlap' THEN 3 ELSE 0 END AS timeline_overlap_score,
    CASE WHEN days_apart <= 30 THEN 3 WHEN days_apart <= 180 THEN 2 WHEN days_apart <= 365 THEN 1 ELSE 0 END AS days_apart_score,
    CASE WHEN va IS NULL OR vb IS NULL THEN 0 WHEN va = vb THEN 3 WHEN abs(va - vb) / greatest(va, vb) <= 0.10 THEN 2 ELSE 1 END AS power_voltage_score,
    CASE WHEN ka = '' OR kb = '' THEN 0 WHEN ka = kb THEN 3 WHEN ka = 'BOTH' OR kb = 'BOTH' THEN 2 ELSE 0 END AS project_type_score,
    CASE state WHEN 'overlap' THEN 'Yes' WHEN 'apart' THEN 'No' ELSE 'Unknown' END AS timeline_overlap
  FROM states),
pairs AS (
  SELECT *, distance_score + timeline_overlap_score + days_apart_score + power_voltage_score + project_type_score AS total_score FROM scored)"""


RANK_SQL = {
    "score": "row_number() OVER (ORDER BY total_score DESC, distance_miles, utility_a, project_id_a, utility_b, project_id_b)",
    "distance_first": """row_number() OVER (ORDER BY distance_score DESC, timeline_overlap_score DESC, days_apart NULLS LAST,
      power_voltage_score DESC, project_type_score DESC, distance_miles, utility_a, project_id_a, utility_b, project_id_b)""",
}
