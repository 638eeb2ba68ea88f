"""Registered queries of the checked-extraction operators, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import extraction as X
from ..operators import overlaps as O
from ..operators import plan_text
from ..sources.tables import read_table
from .queries import query


@query("""WITH p AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus, o_orderkey % 7 ORDER BY o_orderkey DESC) AS r FROM orders)
SELECT s_suppkey, x.o_orderpriority AS sponsor_a, y.o_orderpriority AS sponsor_b, 'kept' AS note_a FROM supplier
LEFT JOIN (SELECT * FROM p WHERE r = 1) x ON x.o_orderstatus = 'F' AND x.k = s_suppkey % 9 LEFT JOIN (SELECT * FROM p WHERE r = 1) y ON y.o_orderstatus = 'O' AND y.k = s_suppkey % 11""")
def pairs_enriched(spark, sf_dir):
    """Pairs get what they lack from the last project of the same key; a column they have is never touched."""
    k = F.col("s_suppkey")
    pairs = read_table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lit("F").alias("utility_a"), (k % 9).cast("string").alias("project_id_a"), F.lit("O").alias("utility_b"), (k % 11).cast("string").alias("project_id_b"), F.lit("kept").alias("note_a"))
    known = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("utility"), (F.col("o_orderkey") % 7).cast("string").alias("project_id"), F.col("o_orderpriority").alias("sponsor"), F.lit("lost").alias("note"), "o_orderkey")
    return O.enrich_pairs(pairs, known, "o_orderkey").select("s_suppkey", "sponsor_a", "sponsor_b", "note_a")


def _fragments(spark, sf_dir) -> DataFrame:
    """Lines of orders as fragments of a project's field; a value depends on its page and place alone."""
    page, place = F.col("l_linenumber"), F.col("l_partkey")
    value = F.when(place % 5 != 0, F.concat_ws("", F.when(place % 3 == 0, "OAK").otherwise("Oak"), F.lit(" "), page % 3))
    return read_table(spark, sf_dir, "lineitem").select(
        F.lit("d").alias("document"), F.col("l_orderkey").cast("string").alias("project_id"), F.lit("place").alias("field"), page.alias("page"), place.alias("place"),
        F.lit("q").alias("quote"), value.alias("value"), F.when(value.isNull(), "refused").otherwise("").alias("reason"))


_FRAGMENTS_SQL = """f AS (SELECT l_orderkey AS o, l_linenumber AS page, l_partkey AS place,
  CASE WHEN l_partkey % 5 <> 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 'OAK ' ELSE 'Oak ' END || l_linenumber % 3 END AS value FROM lineitem),
firsts AS (SELECT o, arg_min(value, (page, place)) AS kept, arg_min(page, (page, place)) AS kept_page FROM f WHERE value IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_FRAGMENTS_SQL} SELECT CAST(o AS VARCHAR) AS project_id, kept AS value, kept_page AS page FROM firsts")
def merged_fields(spark, sf_dir):
    return X.merge_checked(_fragments(spark, sf_dir))[0].select("project_id", "value", "page")


@query(f"""WITH {_FRAGMENTS_SQL} SELECT DISTINCT CAST(o AS VARCHAR) AS project_id, page, '' AS value, 'refused' AS reason FROM f WHERE value IS NULL
UNION ALL SELECT DISTINCT CAST(f.o AS VARCHAR), page, value, format('page {{}} says ''{{}}'' but page {{}} says ''{{}}''; keeping page {{}}', kept_page, kept, page, value, kept_page) FROM f JOIN firsts USING (o) WHERE lower(value) <> lower(kept)""")
def merge_problems(spark, sf_dir):
    return X.merge_checked(_fragments(spark, sf_dir))[1].select("project_id", "page", "value", "reason")


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS first_date, CAST(CAST(o_orderdate AS DATE) + 40 AS VARCHAR) AS last_date, 3 AS n_dates,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN strftime(CAST(o_orderdate AS DATE) + 1, '%Y-%m-%d') || ' isn''t a date in ''by ' || strftime(o_orderdate, '%-m/%-d/%Y') || '''' ELSE '''soon'' isn''t a YYYY-MM-DD date' END AS reason FROM orders""")
def quoted_dates(spark, sf_dir):
    """Dates that a text writes in three ways, and ISO dates checked against their quotes."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    us = F.concat(F.lit("by "), F.date_format(day, "M/d/yyyy"))
    told = F.when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 3 == 1, F.date_format(F.date_add(day, 1), "yyyy-MM-dd")).otherwise("soon")
    text = F.concat(us, F.lit(" or 2/30/2025, "), F.date_format(F.date_add(day, 20), "yyyy-MM-dd"), F.lit(" and "), F.date_format(F.date_add(day, 40), "MMMM d, yyyy"))
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", D.dates_in(text).alias("d"), D.check_date(told, us).alias("c"))
    return rows.select("o_orderkey", F.get("d", F.lit(0)).cast("string").alias("first_date"), F.element_at("d", -1).cast("string").alias("last_date"), F.size("d").alias("n_dates"), F.col("c.reason").alias("reason"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'A-' || o_orderkey || ', B' AS id, o_orderpriority AS said FROM orders""")
def label_texts(spark, sf_dir):
    """US dates, IDs with dashes of any kind, and what stands between two labels."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    us = F.when(key % 2 == 0, F.date_format(day, "M/d/yy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    text = F.concat(F.lit("Line X\nproject status  "), F.col("o_orderpriority"), F.lit("\n NEXT label"))
    identity = F.concat(F.lit(" A – "), key.cast("string"), F.lit(",  B"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", T.us_date(us).cast("string").alias("day"), T.tidy_id(identity).alias("id"), T.text_between(text, "Project Status", "Next Label").alias("said"))


_SPONSORS = ["GPC", "sav", "MEAG Power", "", "Acme"]


@query("""SELECT c_custkey, ['Georgia Power', 'Georgia Power', 'MEAG Power', '', 'Acme'][c_custkey % 5 + 1] AS utility,
  ['', '', '', 'no sponsor found in a mixed-utility plan; utility left blank', 'unknown Georgia sponsor; utility kept as printed sponsor pending review'][c_custkey % 5 + 1] AS reason FROM customer""")
def sponsor_owners(spark, sf_dir):
    sponsor = F.element_at(F.array(*map(F.lit, _SPONSORS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", X.owner_of(sponsor, "Georgia Power").alias("o")).select("c_custkey", "o.*")


@query("""WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE '' END AS name, strftime(o_orderdate, '%Y-%m-%d') AS s,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '2077-01-01' ELSE strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) - 1, '%Y-%m-%d') END AS e FROM orders)
SELECT CAST(k AS VARCHAR) AS project_id, 'project_name' AS field, 'not found in the document' AS reason FROM p WHERE name = '' AND k % 8 <> 0
UNION ALL SELECT CAST(k AS VARCHAR), 'in_service_date', 'not found in the document' FROM p WHERE e = ''
UNION ALL SELECT CAST(k AS VARCHAR), 'in_service_date', 'year outside 1990-2060' FROM p WHERE e = '2077-01-01'
UNION ALL SELECT CAST(k AS VARCHAR), 'start_date', 'starts after its in-service date ' || e FROM p WHERE e <> '' AND s > e
UNION ALL SELECT CAST(k AS VARCHAR), 'miles_mentioned', 'mentions more than 300 miles' FROM p WHERE k % 500 > 300""")
def sanity_checks(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    end = F.when(k % 5 == 0, "").when(k % 7 == 0, "2077-01-01").otherwise(F.date_format(F.date_add(day, (k % 3 - 1).cast("int")), "yyyy-MM-dd"))
    rows = read_table(spark, sf_dir, "orders").select(
        F.lit("d").alias("document"), k.cast("string").alias("project_id"), F.when(k % 4 != 0, F.col("o_orderpriority")).otherwise("").alias("project_name"), end.alias("in_service_date"),
        F.date_format(day, "yyyy-MM-dd").alias("start_date"), F.concat((k % 500).cast("string"), F.lit(" miles")).alias("description"), F.when(k % 8 == 0, F.array(F.lit("project_name"))).alias("flagged"))
    return X.sanity_problems(rows).select("project_id", "field", "reason")


@query("""WITH here AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), listed AS (SELECT l_orderkey AS k, min(l_linenumber) AS page FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT CAST(coalesce(here.k, listed.k) AS VARCHAR) AS project_id, page, CASE WHEN here.k IS NULL THEN 'listed by the ID pass, but no project was read for it' ELSE 'the ID pass didn''t list this project' END AS reason
FROM here FULL JOIN listed ON here.k = listed.k WHERE here.k IS NULL OR listed.k IS NULL""")
def inventory_check(spark, sf_dir):
    here = read_table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.lit("d").alias("document"), F.col("o_orderkey").cast("string").alias("project_id"))
    listed = read_table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select(F.lit("d").alias("document"), F.col("l_orderkey").cast("string").alias("project_id"), F.col("l_linenumber").alias("page"))
    return X.inventory_problems(here, listed).select("project_id", "page", "reason")


@query("""WITH p AS (SELECT p_partkey AS page, p_partkey // 10 AS document, CAST(CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE '' END || p_size AS VARCHAR) AS n, CAST(p_size AS VARCHAR) AS w FROM part),
other AS (SELECT q.document, q.w, list_sort(list(DISTINCT p.page))[1:3] AS pages FROM p q JOIN p ON p.document = q.document AND p.n = q.w GROUP BY 1, 2)
SELECT p.page, CASE WHEN p.n = p.w THEN p.w || 'KV' END AS value, CASE WHEN p.n = p.w THEN '' WHEN pages IS NOT NULL THEN 'not on page ' || p.page || ', but on page ' || array_to_string(pages, ', ') ELSE 'not on page ' || p.page || ' or any other page' END AS reason
FROM p LEFT JOIN other ON other.document = p.document AND other.w = p.w""")
def quote_spelling(spark, sf_dir):
    """Quotes such as "15 kv" against pages that write 15KV or 115KV: the page's spelling, or where else the quote stands."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat(F.lit("a "), F.when(k % 3 == 0, "1").otherwise(""), size, F.lit("KV line"))
    part = read_table(spark, sf_dir, "part").select(F.floor(k / 10).alias("document"), k.cast("int").alias("page"), text.alias("text"), F.concat(size, F.lit(" kv")).alias("quote"))
    return X.locate_quotes(part.select("document", "page", "quote"), part.select("document", "page", "text")).select(F.col("page").cast("long").alias("page"), "value", "reason")


@query("""SELECT doc_id, source, CAST(coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents""")
def page_starts(spark, sf_dir):
    """Where each page begins in its document's joined text."""
    pages = read_table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return plan_text.page_offsets(pages).select(F.col("page").alias("doc_id"), F.col("document").alias("source"), "start")
