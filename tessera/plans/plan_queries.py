"""Registered queries of plan texts, cleaning, look-ups and sources, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, nested
from ..functions import text as T
from ..operators import cleaning, evaluation, extraction, locations, map_layers, overlaps, plan_text, projects
from ..sources import evidence, ragged, sinks
from ..sources.lookup_cache import LookupCache
from ..sources.shared import fresh_path
from ..sources.tables import read_table
from ..streaming import progress
from .proxies import DISTANCE_SQL, OWNER_A, OWNER_B, pairs_sql
from .proxies import projects as plan_projects
from .queries import _CELLS_SQL, _ENDPOINTS_SQL, _endpoints, _versions, candidate_sql, query


def _text(*parts) -> Column:
    return F.concat(*[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def _plan_pages(spark, sf_dir) -> DataFrame:
    """Parts as rows of plan documents: 40 rows a document, wrapped over lines and pages, some incomplete, some IDs twice; and their detail pages."""
    k, place = F.col("p_partkey"), F.col("p_partkey") % 40
    document = F.floor(k / 40)
    number = F.lit(10_000) + k - F.when(k % 29 == 7, 1).otherwise(0)
    line = lambda page, at, text: F.struct(page.cast("int").alias("page"), at.cast("int").alias("at"), text.alias("text"))
    head = line(F.floor(place / 8), 2 * place, _text(100 + k % 900, " 2025 ", number, " ", F.upper("p_name")))
    tail = line(F.floor((place + 1) / 8), 2 * place + 1, F.concat(F.upper("p_brand"), F.when(k % 13 == 5, "").otherwise(_text(" 6/1/2027 ", F.when(k % 3 == 0, "GTC").otherwise("GPC"), " REDACTED"))))
    caption = F.when((place == 0) & (document % 17 != 3), line(F.lit(0), F.lit(-1), F.lit(plan_text.TABLE_CAPTION)))
    total = F.when((place == 0) & (document % 11 != 4), line(F.lit(6), F.lit(99), F.lit("Total REDACTED 5")))
    detail = F.when(k % 7 != 2, line(100 + place, place, _text("OAK\nTeams # ", number, "\nNeed Date ", F.when(k % 5 == 1, "7/1/2027").otherwise("6/1/2027"), " Start Date 1/5/2025\nDescription\nRebuild ", F.col("p_size"), " miles\nREDACTED\nNone\nNew")))
    lines = read_table(spark, sf_dir, "part").select(document.cast("long").alias("document"), F.explode(F.array_compact(F.array(head, tail, caption, total, detail))).alias("l"))
    pages = lines.groupBy("document", "l.page").agg(F.sort_array(F.collect_list(F.struct("l.at", "l.text"))).alias("t"))
    return pages.select("document", "page", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


_PLAN_SQL = """p AS (SELECT p_partkey AS k, p_partkey // 40 AS document, p_partkey % 40 AS place, 10000 + p_partkey - CASE WHEN p_partkey % 29 = 7 THEN 1 ELSE 0 END AS id,
  upper(p_name) || ' ' || upper(p_brand) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'GTC' ELSE 'GPC' END AS sponsor, p_partkey % 13 <> 5 AS complete FROM part),
t AS (SELECT *, CASE WHEN complete THEN CAST(id AS VARCHAR) ELSE '' END AS project_id FROM p WHERE document % 17 <> 3)"""


@query(f"""WITH {_PLAN_SQL} SELECT document, project_id, CASE WHEN complete THEN name ELSE '' END AS project_name, CASE WHEN complete THEN '2027-06-01' END AS need_date,
  CASE WHEN complete THEN sponsor ELSE '' END AS sponsor, CAST(place // 8 AS INTEGER) AS page, CASE WHEN NOT complete THEN 'incomplete row' END AS problem FROM t""")
def plan_table_rows(spark, sf_dir):
    rows = plan_text.table_rows(_plan_pages(spark, sf_dir))
    return rows.select("document", "project_id", "project_name", F.col("need_date").cast("string").alias("need_date"), "sponsor", "page", "problem")


@query(f"""WITH {_PLAN_SQL}, ids AS (SELECT document, id, count(*) AS n FROM t WHERE complete GROUP BY 1, 2), twice AS (SELECT document, count(*) AS duplicates FROM ids WHERE n > 1 GROUP BY 1),
per AS (SELECT p.document, count(t.k) AS starts, count(t.k) FILTER (WHERE t.complete) AS complete FROM p LEFT JOIN t USING (k) GROUP BY 1)
SELECT document, starts, complete, coalesce(duplicates, 0) AS duplicates, CASE WHEN document % 17 = 3 THEN 'table caption not found' WHEN document % 11 = 4 THEN 'end of the table not found'
  WHEN starts <> complete THEN 'the table has ' || starts || ' row starts but ' || complete || ' complete rows; a row''s layout changed' WHEN duplicates > 0 THEN 'project IDs are there twice' END AS problem
FROM per LEFT JOIN twice USING (document)""")
def table_reconciliation(spark, sf_dir):
    return plan_text.table_counts(_plan_pages(spark, sf_dir))


@query(f"""WITH {_PLAN_SQL}, d AS (SELECT document, CAST(id AS VARCHAR) AS project_id, k % 5 = 1 AS other FROM p WHERE k % 7 <> 2),
b AS (SELECT coalesce(t.document, d.document) AS document, coalesce(t.project_id, d.project_id) AS project_id, t.project_id IS NOT NULL AS there, d.project_id IS NOT NULL AS told, other, complete
  FROM t FULL JOIN d ON t.document = d.document AND t.project_id = d.project_id)
SELECT document, project_id, 'no detail page' AS reason FROM b WHERE there AND NOT told UNION ALL SELECT document, project_id, 'need dates differ' FROM b WHERE there AND told AND other
UNION ALL SELECT document, project_id, 'unknown sponsor' FROM b WHERE there AND NOT complete UNION ALL SELECT document, project_id, 'no table row' FROM b WHERE NOT there""")
def plan_inconsistencies(spark, sf_dir):
    return plan_text.plan_inconsistencies(_plan_pages(spark, sf_dir))


def _name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.translate(number.cast("string"), "0123456789", "ABCDEFGHIJ"))


_NAME_SQL = "'{0}' || translate(CAST(p_partkey % {1} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"
_A, _B = _NAME_SQL.format("OAK", 1000), _NAME_SQL.format("ELM", 77)


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {_A} || '; ' || {_B} WHEN 1 THEN {_A} WHEN 2 THEN 'NORTH ' || {_A} || '; ' || {_B} ELSE {_A} || '; ' || {_B} END AS locations,
  ['LINE', 'SUBSTATION', 'BOTH', 'MULTI_SITE'][p_partkey % 4 + 1] AS project_type, ['115000', '230000; 115000', '', ''][p_partkey % 4 + 1] AS voltages, ['', 'GTC', '', ''][p_partkey % 4 + 1] AS owner_tags FROM part""")
def plan_titles(spark, sf_dir):
    """Titles of four kinds, read for places, type, voltages and owners."""
    k = F.col("p_partkey")
    a, b = _name("OAK", k % 1000), _name("ELM", k % 77)
    title = F.when(k % 4 == 0, _text(a, " - ", b, " 115KV REBUILD")).when(k % 4 == 1, _text("GTC: ", a, " (GTC) SUBSTATION 230/115 KV AUTOBANK")).when(k % 4 == 2, _text("N ", a, " - ", b, " LOOP IN")).otherwise(_text(a, " AND ", b, " RELAY PANEL"))
    rows = plan_text.parse_titles(read_table(spark, sf_dir, "part").select("p_partkey", title.alias("project_name")))
    return rows.select("p_partkey", F.array_join("locations", "; ").alias("locations"), "project_type", F.array_join(F.col("voltages").cast("array<string>"), "; ").alias("voltages"), F.array_join("owner_tags", "; ").alias("owner_tags"))


@query("""SELECT s_suppkey, 'S-' || s_suppkey || ', H' AS project_id, '2028-06-01' AS in_service_date, ['2025-01-01', NULL, '2024-01-01'][s_suppkey % 3 + 1] AS start_date,
  CAST(s_suppkey % 30 AS DOUBLE) AS line_miles, [1000, 5, 8][s_suppkey % 3 + 1]::BIGINT AS cost_total, CASE WHEN s_suppkey % 3 = 2 THEN 'yearly costs do not add up to the total' END AS warning FROM supplier""")
def page_costs(spark, sf_dir):
    """One project a page: dates, costs by year and their sum, the first year with a cost."""
    k = F.col("s_suppkey")
    costs = F.when(k % 3 == 0, "$0 $0 $1,000 $0 $0 $0 $1,000").when(k % 3 == 1, "$5 $0 $0 $0 $0 $0 $5").otherwise("$0 $7 $0 $0 $0 $0 $8")
    text = _text("5 Year Budget Line ", k % 30, " miles Project ID S – ", k, ", H Project Description Rebuild Project Need x Planned In-Service Date 5/1/2027 and 6/1/2028 Estimated Project Cost ", costs)
    rows = plan_text.page_projects(read_table(spark, sf_dir, "supplier").select(F.lit("d").alias("document"), k.alias("page"), text.alias("text")))
    return rows.select(F.col("page").alias("s_suppkey"), "project_id", F.col("in_service_date").cast("string").alias("in_service_date"), F.col("start_date").cast("string").alias("start_date"), "line_miles", "cost_total", "warning")


@query("""WITH p AS (SELECT doc_id, doc_id // 25 AS document, length(coalesce(text, '')) AS n FROM documents)
SELECT document, CAST(count(*) AS BIGINT) AS pages FROM p GROUP BY 1""")
def page_runs(spark, sf_dir):
    """Runs of pages that share a page with the run before: every page of a document is in one, twice where two runs meet."""
    pages = read_table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 25).alias("document"), F.col("doc_id").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    runs = plan_text.chunk_pages(pages, 20_000)
    return runs.groupBy("document").agg((F.sum(F.size("pages")) - F.count("*") + 1).cast("long").alias("pages"))


_WRONG = "CASE WHEN k % 16 = 3 THEN 'wrong number of values' ELSE concat_ws('; ', CASE WHEN k % 11 = 0 THEN 'unknown project_type' END, CASE WHEN k % 7 = 0 THEN 'in_service_date is not a date' END, CASE WHEN k % 5 = 0 THEN 'voltage_1 is not whole volts' END) END"


@query(f"""WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k, {_WRONG} AS problems, CASE WHEN k % 5 = 0 THEN 'abc' WHEN k % 3 = 0 THEN '115000.0' ELSE '46000' END AS v FROM o)
SELECT k AS line, CASE WHEN problems = '' THEN replace(v, '.0', '') ELSE v END AS voltage_1, problems FROM p""")
def cleaned_rows(spark, sf_dir):
    """Rows with one or two stray blanks, or too many values, put back into their columns and checked by type."""
    k, header = F.col("o_orderkey"), cleaning.BASE_COLUMNS
    told = {"project_id": k.cast("string"), "utility": F.lit("A"), "project_type": F.when(k % 11 == 0, "XX").otherwise("LINE"), "voltage_1": F.when(k % 5 == 0, "abc").when(k % 3 == 0, "115000.0").otherwise("46000"), "in_service_date": F.when(k % 7 == 0, "soon").otherwise("2027-06-01")}
    one, two = header.index("other_locations") + 1, header.index("owner_tags") + 1
    values = [told.get(c, F.lit("")) for c in header]
    part = lambda i, j: F.array(*values[i:j])
    blank = F.array(F.lit(""))
    cells = F.when(k % 16 == 3, F.concat(part(0, None), F.array(*[F.lit("x")] * 5))).when(k % 4 == 1, F.concat(part(0, one), blank, part(one, None))).when(k % 4 == 2, F.concat(part(0, one), blank, part(one, two), blank, part(two, None))).otherwise(part(0, None))
    rows = cleaning.clean_rows(cleaning.realign(read_table(spark, sf_dir, "orders").select(k.alias("line"), cells.alias("cells")), header))
    return rows.select("line", "voltage_1", F.array_join("problems", "; ").alias("problems"))


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS id FROM orders), twice AS (SELECT id, count(*) AS n FROM o GROUP BY 1 HAVING count(*) > 1)
SELECT CAST(id AS VARCHAR) AS project_id, 'starts after it is in service' AS problem FROM o WHERE k % 4 = 0 UNION ALL SELECT CAST(id AS VARCHAR), 'a line named like a station' FROM o WHERE k % 9 = 0
UNION ALL SELECT CAST(id AS VARCHAR), 'appears ' || n || ' times for A' FROM twice""")
def data_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders").select(
        F.when(k % 6 == 0, k - 1).otherwise(k).cast("string").alias("project_id"), F.lit("A").alias("utility"), F.when(k % 4 == 0, "2028-01-01").otherwise("2026-01-01").alias("start_date"), F.lit("2027-01-01").alias("in_service_date"),
        F.lit("LINE").alias("project_type"), F.when(k % 9 == 0, "Oak Switchyard").otherwise("Oak").alias("project_name"), F.lit("").alias("location_2"), F.lit("").alias("line_miles"))
    return cleaning.data_problems(rows)


_SEEDS_SQL = "SELECT n_nationkey AS seed, 'oak ' || n_nationkey || ' creek' AS target, 31.0::DOUBLE + n_nationkey AS latitude, -84.0::DOUBLE + n_nationkey AS longitude FROM nation WHERE n_nationkey < 7 AND n_nationkey <> 3"


@query(f"""WITH {candidate_sql(_SEEDS_SQL)}, best AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY match_score DESC, id) AS r FROM scored),
l AS (SELECT s_suppkey AS k, n_name AS over, seed AS there FROM supplier LEFT JOIN nation ON s_suppkey = n_nationkey * 10 LEFT JOIN a ON a.seed = s_suppkey % 7)
SELECT CAST(k AS VARCHAR) AS project_id, CASE WHEN over IS NOT NULL THEN over WHEN best.id IS NULL THEN '' WHEN best.name = '' THEN 'Unnamed' ELSE replace(best.name, 'oak', 'Oak') END AS matched_name,
  CASE WHEN over IS NOT NULL THEN NULL WHEN best.id IS NULL THEN 0.0 ELSE best.match_score END AS match_score,
  CASE WHEN over IS NOT NULL THEN 'HIGH' WHEN best.id IS NULL THEN 'LOW' WHEN best.match_score >= 8 AND best.name <> '' THEN 'HIGH' WHEN best.match_score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN over IS NOT NULL THEN 'Manual override' WHEN best.id IS NOT NULL THEN 'Map feature' WHEN there IS NOT NULL THEN 'General location' ELSE 'No match' END AS source
FROM l LEFT JOIN (SELECT seed, id, replace(name, 'creek', 'Creek') AS name, match_score FROM best WHERE r = 1) best ON best.seed = k % 7""")
def located_projects(spark, sf_dir):
    """Locations of projects: an override, the best feature near the seed, the seed itself, or none."""
    k, c, n = F.col("s_suppkey"), F.col("c_custkey"), F.col("n_nationkey")
    place = lambda number: _text("Oak ", number, " Creek Substation")
    wanted = read_table(spark, sf_dir, "supplier").select(F.lit("Georgia Power").alias("utility"), k.cast("string").alias("project_id"), F.lit("location_1").alias("location_role"), place(k % 7).alias("target_location"), F.array(F.lit("115000"), F.lit("230000")).alias("expected_voltages"), F.lit("Georgia").alias("state"))
    nation = read_table(spark, sf_dir, "nation")
    over = nation.select(F.lit("Georgia Power").alias("utility"), (n * 10).cast("string").alias("project_id"), F.upper(place(n * 10 % 7)).alias("target_location"), F.lit(31.0).alias("latitude"), F.lit(-81.0).alias("longitude"), F.col("n_name").alias("matched_name"), F.lit("s").alias("source"), F.lit("").alias("note"))
    seeds = nation.where((n < 7) & (n != 3)).select(place(n).alias("search_name"), F.lit("Georgia").alias("state"), (n + 31.0).alias("seed_latitude"), (n - 84.0).alias("seed_longitude"))
    features = read_table(spark, sf_dir, "customer").select(
        F.lit("node").alias("type"), c.alias("id"), (F.lit(30.0) + (c * 53 % 1000) / F.lit(100.0)).alias("latitude"), (F.lit(-85.0) + (c * 71 % 1000) / F.lit(100.0)).alias("longitude"),
        F.when(c % 3 == 0, "").when(c % 3 == 1, _text("Oak ", c % 7, " Creek")).otherwise(_text("Oak ", c % 7)).alias("name"),
        F.when(c % 2 == 0, "Georgia Power Co").otherwise("").alias("operator"), F.when(c % 4 == 0, "115000;230000").when(c % 4 == 1, "230000").otherwise("46000").alias("voltage"))
    return locations.locate(wanted, over, seeds, features).select("project_id", "matched_name", F.col("match_score").cast("double").alias("match_score"), "confidence", "source")


@query("""WITH l AS (SELECT l_orderkey // 50 AS document, l_linenumber AS page, CASE l_suppkey % 4 WHEN 0 THEN 'project_list' WHEN 1 THEN 'project_detail' WHEN 2 THEN 'other' END AS kind FROM lineitem),
k AS (SELECT document, page, list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)) AS kinds FROM l GROUP BY 1, 2), c AS (SELECT DISTINCT l_orderkey // 50 AS document, l_linenumber AS page FROM lineitem WHERE l_partkey % 40 = 0)
SELECT document, page, 'the model didn''t label this page' AS problem FROM k WHERE kinds IS NULL OR len(kinds) = 0
UNION ALL SELECT document, page, 'labelled ' || array_to_string(kinds, ' and ') || ', but no project was read from it' FROM k WHERE (list_contains(kinds, 'project_list') OR list_contains(kinds, 'project_detail')) AND (document, page) NOT IN (SELECT (document, page) FROM c)""")
def page_problems(spark, sf_dir):
    """Pages without a label, and project pages from which no project was read."""
    item = read_table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 50).alias("document"), F.col("l_linenumber").alias("page"), "l_suppkey", "l_partkey")
    k = F.col("l_suppkey") % 4
    labels = item.select("document", "page", F.when(k == 0, "project_list").when(k == 1, "project_detail").when(k == 2, "other").alias("kind"))
    return evaluation.page_problems(item.select("document", "page"), labels, item.where("l_partkey % 40 = 0").select("document", "page").distinct())


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS project_id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0 THEN 40.0 ELSE 30.0 END::DOUBLE AS latitude, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0 THEN 30.0 END::DOUBLE AS original_latitude,
  CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0 THEN 'Low' ELSE 'High' END AS confidence, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 = 0 THEN 'center follows from endpoints; edit ignored' ELSE '' END AS review_note FROM supplier""")
def location_review(spark, sf_dir):
    """Centers edited by a person: taken, but for those that follow from endpoints."""
    k = F.col("s_suppkey")
    before = read_table(spark, sf_dir, "supplier").select(F.lit("A").alias("utility"), k.cast("string").alias("project_id"), F.lit(30.0).alias("latitude"), F.lit(-80.0).alias("longitude"), F.when(k % 4 == 0, "endpoint_midpoint").otherwise("provided_center").alias("center_method"), F.lit("High").alias("confidence"), F.lit("Matched").alias("location_status"), F.lit("s").alias("location_source"), F.lit("").alias("verification_notes"))
    edited = before.select("utility", "project_id", F.when(F.col("project_id").cast("long") % 3 == 0, 40.0).otherwise(F.col("latitude")).alias("latitude"), "longitude")
    return projects.apply_location_review(before, edited).select("project_id", "latitude", "original_latitude", "confidence", "review_note")


@query("""SELECT doc_id, CAST(3 + doc_id % 3 AS BIGINT) AS n_cells, md5(coalesce(text, '')) AS text_md5, coalesce(source, '') AS source FROM documents""")
def ragged_documents(spark, sf_dir):
    """Whole documents written as CSV with three to five cells a row, texts quoted with their line ends, and read back in byte ranges."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = _text(F.col("doc_id"), ",", quoted(F.col("text")), ",", quoted(F.col("source")), F.repeat(F.lit(","), (F.col("doc_id") % 3).cast("int")))
    path = fresh_path(spark, "ragged")
    read_table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    cells = F.col("cells")
    return ragged.records(spark, path).select(cells[0].cast("long").alias("doc_id"), F.size(cells).cast("long").alias("n_cells"), F.md5(cells[1]).alias("text_md5"), cells[2].alias("source"))


@query("""SELECT event_id, '{"type":"node","id":' || event_id || ',"tags":{"name":"' || event_type || '"}}' AS feature FROM events""")
def trimmed_features(spark, sf_dir):
    """Events as map features with more fields than scoring reads."""
    feature = _text('{"type":"node","id":', F.col("event_id"), ',"props":', F.coalesce("props", F.lit("null")), ',"tags":{"name":"', F.col("event_type"), '","power":"line"},"nodes":[1,2]}')
    return read_table(spark, sf_dir, "events").select("event_id", nested.trim_feature(feature).alias("feature"))


@query("""SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS key, CASE WHEN s_nationkey < 20 AND s_nationkey <> 7 THEN n_name END AS value, CASE WHEN s_nationkey <> 7 THEN s_nationkey < 20 END AS found
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def cached_lookups(spark, sf_dir):
    """Places looked up twice through the cache: found, not there (key 20 and above), failed (key 7)."""
    cache, known = LookupCache(spark, fresh_path(spark, "lookups")), read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    asked = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("key"))

    def fetch(keys: DataFrame) -> DataFrame:
        return keys.join(known.where("cast(key as int) < 20"), "key", "left").withColumn("failed", F.col("key") == "7")

    cache.look_up(asked.where("cast(key as int) % 2 = 0"), fetch)
    return cache.look_up(asked, fetch)


@query("""SELECT c_custkey, lower(c_name) AS name FROM customer""")
def located_in_steps(spark, sf_dir):
    """Customers, dealt to files, worked on file by file with the progress kept; the second run finds nothing left to do."""
    folder = fresh_path(spark, "steps")
    source, schema = f"{folder}/source", read_table(spark, sf_dir, "customer").schema
    read_table(spark, sf_dir, "customer").repartition(4).write.parquet(source)
    work = lambda rows: rows.select("c_custkey", T.canon(F.col("c_name")).alias("name"))
    for _ in range(2):
        progress.work_in_steps(spark, source, schema, work, f"{folder}/out", f"{folder}/notes")
    return progress.finished(spark, f"{folder}/out").select("c_custkey", "name")


@query("""WITH p AS (SELECT CAST(s_suppkey AS VARCHAR) AS project_id, CAST(s_suppkey % 40 AS DOUBLE) + 0.5 AS miles, s_suppkey % 400 AS days, s_suppkey % 2 = 0 AS same FROM supplier),
s AS (SELECT *, CASE WHEN miles <= 5 THEN 3 WHEN miles <= 15 THEN 2 WHEN miles <= 25 THEN 1 ELSE 0 END + CASE WHEN days <= 30 THEN 3 WHEN days <= 180 THEN 2 WHEN days <= 365 THEN 1 ELSE 0 END + CASE WHEN same THEN 3 ELSE 1 END + CASE WHEN same THEN 3 ELSE 0 END AS total_score FROM p)
SELECT project_id, row_number() OVER (ORDER BY total_score DESC, miles, project_id) AS rank, total_score, days AS days_apart FROM s""")
def ranked_pair_table(spark, sf_dir):
    """A pair table under other column names, with gaps in days that count before dates."""
    k = F.col("s_suppkey")
    rows = read_table(spark, sf_dir, "supplier").select(
        F.lit("A").alias("Utility_A"), k.cast("string").alias("a project id"), F.lit("B").alias("b utility"), F.lit("9").alias("project_id_b"), _text(k % 40 + 0.5).alias("Distance Miles"), F.lit(" ").alias("days_apart"), _text(k % 400).alias(" time_gap "),
        F.lit("2025-01-01").alias("utility a date"), F.lit("2025-01-02").alias("in-service date b"), F.lit("115 kV").alias("max_voltage_a"), F.when(k % 2 == 0, "115000").otherwise("230").alias("utility b voltage"), F.lit("LINE").alias("type_a"), F.when(k % 2 == 0, "line").otherwise("STATION").alias("type_b"))
    return overlaps.rank_table(rows).select(F.col("project_id_a").alias("project_id"), "rank", "total_score", "days_apart")


@query(f"""WITH a AS (SELECT s_suppkey AS k, s_suppkey * 37 % 1801 / 10.0::DOUBLE - 90.0 AS latitude, s_suppkey * 1091 % 3601 / 10.0::DOUBLE - 180.0 AS longitude, s_nationkey FROM supplier), b AS (SELECT n_nationkey, n_nationkey * 3.0::DOUBLE AS latitude, n_nationkey * -5.0::DOUBLE AS longitude FROM nation)
SELECT a.k AS s_suppkey, round({DISTANCE_SQL}, 4) AS miles FROM a JOIN b ON a.s_nationkey = b.n_nationkey""")
def haversine_by_atan2(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    pairs = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == n)
    miles = geo.haversine_miles_by_atan2((k * 37 % 1801) / 10.0 - 90.0, (k * 1091 % 3601) / 10.0 - 180.0, n * 3.0, n * -5.0)
    return pairs.select("s_suppkey", F.round(miles, 4).alias("miles"))


@query("""WITH p AS (SELECT doc_id // 10 AS document, md5(string_agg('=== PAGE ' || doc_id || E' ===\\n' || coalesce(text, ''), E'\\n\\n' ORDER BY doc_id)) AS reply, count(*) AS pages FROM documents GROUP BY 1)
SELECT document, pages, reply FROM p""")
def replayed_documents(spark, sf_dir):
    """Documents of ten pages asked in one request each, answered from replies that were kept by key."""
    pages = read_table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("document"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    shaping = {"model": F.lit("m"), "instructions": F.lit("list projects")}
    replies = extraction.document_requests(pages, 100_000_000, shaping).select("key", F.md5("text").alias("reply"))
    told = extraction.replay_documents(pages, replies, 100_000_000, shaping)
    return told.select("document", F.size("pages").cast("long").alias("pages"), "reply")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 AS r, s_suppkey % 5 <> 0 AS point FROM supplier)
SELECT CAST(k AS VARCHAR) AS project_id, CASE r WHEN 0 THEN 'unavailable' WHEN 1 THEN CASE WHEN point THEN 'single_location' ELSE 'unavailable' END ELSE CASE WHEN point THEN 'endpoint_midpoint' ELSE 'one_of_two_endpoints' END END AS center_method,
  CASE WHEN r = 0 THEN 'Low' WHEN NOT point THEN 'Low' WHEN r = 1 THEN 'High' ELSE 'Medium' END AS confidence, CASE r WHEN 0 THEN '' WHEN 1 THEN 'Map feature' ELSE 'Map feature; Manual override' END AS location_source,
  CASE r WHEN 0 THEN '' WHEN 1 THEN 'Oak: near' ELSE 'Oak: near | Elm: far' END AS verification_notes, CASE WHEN r = 0 THEN '' ELSE '230000' END AS voltage,
  CASE WHEN r = 0 OR (r = 1 AND NOT point) THEN NULL WHEN r = 1 THEN 33.0 WHEN point THEN 33.5 ELSE 34.0 END::DOUBLE AS latitude FROM s""")
def projects_with_evidence(spark, sf_dir):
    """Projects of a saved table with none, one or two places found; the second row of a role does not count."""
    k = F.col("s_suppkey")
    supplier = read_table(spark, sf_dir, "supplier")
    table = supplier.select(F.lit("A").alias("utility"), k.cast("string").alias("project_id"), F.col("s_name").alias("project_name"), F.lit("").alias("voltage_1"), F.lit("").alias("voltage_2"))
    lat = F.when(k % 5 != 0, "33").otherwise("")
    place = lambda number, role, name, latitude, confidence, source, why: F.struct(F.lit(number).alias("number"), F.lit(role).alias("location_role"), F.lit(name).alias("target_location"), latitude.alias("latitude"), F.lit("-80").alias("longitude"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.lit(why).alias("reasons"))
    one, again = place(1, "location_1", "Oak", lat, "HIGH", "Map feature", "near"), place(3, "location_1", "Ash", F.lit("20"), "LOW", "x", "y")
    two = place(2, "location_2", "Elm", F.lit("34"), "MEDIUM", "Manual override", "far")
    found = F.when(k % 3 == 1, F.array(one, again)).when(k % 3 == 2, F.array(again, two, one))
    rows = supplier.select(F.lit("A").alias("utility"), k.cast("string").alias("project_id"), F.explode(found).alias("e")).select("utility", "project_id", "e.*", F.lit("LINE").alias("project_type"), F.lit("230000;115000").alias("expected_voltages"), F.lit("way").alias("osm_type"), F.lit("1").alias("osm_id"))
    ready = projects.prepare_projects(evidence.with_evidence(table, rows, "saved.csv"))
    return ready.select("project_id", "center_method", "confidence", "location_source", "verification_notes", "voltage", "latitude")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS georgia FROM orders)
SELECT CAST(k AS VARCHAR) AS project_id, CASE WHEN georgia THEN 'MEAG Power' ELSE 'Georgia Power' END AS utility, 'OAK ' || k || ' 230/115 kV' AS project_name, CASE WHEN k % 3 = 0 THEN 'Elm' ELSE 'Oak' END AS location_1,
  CASE WHEN k % 3 = 0 THEN '' ELSE 'Elm' END AS location_2, '230000' AS voltage_1, CASE WHEN k % 5 = 0 THEN '12.5' ELSE '' END AS line_miles, CASE WHEN k % 3 = 0 THEN '1; 2; 4' ELSE '1; 2; 3; 4' END AS pages, CASE WHEN k % 7 = 0 THEN 'REVIEW' ELSE 'VERIFIED' END AS status FROM o""")
def project_rows(spark, sf_dir):
    """Checked fields and places of orders' projects, one row each."""
    k = F.col("o_orderkey")
    orders = read_table(spark, sf_dir, "orders").select(F.lit("d").alias("document"), k.cast("string").alias("project_id"), k.alias("k"))
    field = lambda name, value, page: F.struct(F.lit(name).alias("field"), value.alias("value"), F.lit(page).alias("page"))
    fields = F.array(field("project_name", _text("OAK ", F.col("k"), " 230/115 kV"), 1), field("sponsor", F.when(F.col("k") % 2 == 0, "MEAG").otherwise("GPC"), 2), field("description", F.when(F.col("k") % 5 == 0, "12.5 miles").otherwise("none"), 1))
    place = lambda n, value, page: F.struct(F.lit(n).alias("place"), F.lit(value).alias("value"), F.lit(page).alias("page"))
    oak, again, elm = place(0, "Oak", 3), place(2, "OAK", 9), place(1, "Elm", 4)
    places = orders.select("document", "project_id", F.explode(F.when(F.col("k") % 3 == 0, F.array(elm)).otherwise(F.array(again, elm, oak))).alias("p")).select("document", "project_id", "p.*")
    rows = extraction.project_rows(orders.select("document", "project_id", F.explode(fields).alias("f")).select("document", "project_id", "f.*"), places, orders.where("k % 7 = 0"), "Georgia Power", "Georgia")
    return rows.select("project_id", "utility", "project_name", "location_1", "location_2", "voltage_1", "line_miles", "pages", "status")


@query(f"""WITH {pairs_sql()}, sides AS (SELECT utility_a AS utility, project_id_a AS project_id FROM pairs UNION SELECT utility_b, project_id_b FROM pairs)
SELECT p.project_id, p.project_id || ' ' || project_name AS label, s.project_id IS NOT NULL AS has_pair, 12.5::DOUBLE * 1609.344::DOUBLE AS radius_meters FROM projects p LEFT JOIN sides s ON p.utility = s.utility AND p.project_id = s.project_id""")
def map_points(spark, sf_dir):
    """A point with its circle for every project, and whether it has a pair."""
    rows = plan_projects(spark, sf_dir)
    points = sinks.map_points(rows, overlaps.find_pairs(rows, OWNER_A, OWNER_B), 25.0)
    return points.select("project_id", "label", "has_pair", "radius_meters")


@query(f"""WITH {_ENDPOINTS_SQL}, n AS (SELECT *, CASE WHEN named1 THEN 'North' ELSE 'Point 1' END AS n1, CASE WHEN named2 THEN 'South' ELSE 'Point 2' END AS n2 FROM centers)
SELECT project_id, CASE WHEN center_method = 'endpoint_midpoint' THEN 'Center: midpoint of ' || n1 || ' and ' || n2
  WHEN center_method = 'one_of_two_endpoints' THEN 'Center: ' || CASE WHEN p1 THEN n1 ELSE n2 END || ' only; ' || CASE WHEN p1 AND named2 THEN 'South' WHEN p2 AND named1 THEN 'North' ELSE 'the other substation' END || ' has no coordinates'
  WHEN center_method = 'single_location' THEN 'Center: ' || CASE WHEN p1 THEN n1 ELSE n2 END || ' (the project''s one substation)' ELSE 'Center: supplied coordinates' END AS note FROM n""")
def center_notes(spark, sf_dir):
    return projects.prepare_projects(_endpoints(spark, sf_dir)).select("project_id", map_layers.center_note().alias("note"))


@query(f"""WITH {_ENDPOINTS_SQL}, s AS (SELECT s_suppkey AS k, s_name FROM supplier)
SELECT project_id, 1 AS endpoint, y1 AS latitude, CASE WHEN named1 THEN 'North' ELSE 'Point 1' END || ' substation (Unknown)' AS first_line FROM centers WHERE p1
UNION ALL SELECT project_id, 2, y2, CASE WHEN named2 THEN 'South' ELSE 'Point 2' END || ' substation (Unknown)' FROM centers WHERE p2""")
def endpoint_points(spark, sf_dir):
    rows = map_layers.endpoint_points(projects.prepare_projects(_endpoints(spark, sf_dir)))
    return rows.select("project_id", "endpoint", "latitude", F.substring_index("label", "\n", 1).alias("first_line"))


@query(f"""WITH {_ENDPOINTS_SQL}, v AS (SELECT min(latitude) AS a, max(latitude) AS b, min(longitude) AS c, max(longitude) AS d FROM centers WHERE latitude IS NOT NULL)
SELECT round((a + b) / 2, 6) AS latitude, round((c + d) / 2, 6) AS longitude, round(least(greatest(log2(360.0::DOUBLE / greatest(d - c, (b - a) * 1.25, 0.01)) + 0.8, 6.0), 12.0), 6) AS zoom FROM v""")
def map_view(spark, sf_dir):
    view = map_layers.fit_view(projects.prepare_projects(_endpoints(spark, sf_dir)).where("latitude is not null"))
    return view.select(*[F.round(c, 6).alias(c) for c in ("latitude", "longitude", "zoom")])


@query(f"""WITH {_CELLS_SQL} SELECT CAST(k AS VARCHAR) AS project_id, "column", outcome FROM cells WHERE outcome <> 'same'""")
def eval_differences(spark, sf_dir):
    return evaluation.differences(evaluation.compare_cells(*_versions(spark, sf_dir))).select("project_id", "column", "outcome")
