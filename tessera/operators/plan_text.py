"""Plan documents as text pages: cleaned, joined, cut into table rows and detail pages, titles read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What the plans' pages look like, and the words of their titles.
BOILERPLATE = [
    r"(?s)CRITICAL ENERGY INFRASTRUCTURE INFORMATION.*?employees\.",
    r"\d{4} GA ITS Ten-Year Plan \(\d{4}-\d{4}\)\s+Page \d+ of \d+",
    r"PUBLIC DISCLOSURE",
    r"(?s)Zone Year TEAMS.*?DU Totals",
]
DATE = r"\d{1,2}/\d{1,2}/\d{2,4}"
TABLE_CAPTION = "Table 2 Georgia ITS 10 Year Plan Project List"
TABLE_END = r"(?m)^Total\s+REDACTED"
ROW_START = r"\d{3} 20\d\d \d{4,} "
TABLE_ROW = rf"(?s)^(\d{{3}}) (20\d\d) (\d{{4,}}) (.+?)\s*({DATE}) ([A-Z]{{2,5}})\s+REDACTED"
LEAKED_TEXT = "REDACTED|Estimated Cost|Zone Year|TEAMS"
DETAIL_HEADER = rf"[^\n]*\n[ \t]*Teams # (\d+)[ \t]*\n[ \t]*Need Date ({DATE}) Start Date ({DATE})"
FORM_TEXT = [
    r"Estimated Cost\s*[–-]\s*ITS\s*Assigned\*\s*REDACTED",
    r"Estimated Cost\s*[–-]\s*(?:GPC|GTC|MEAG|DU)\s*REDACTED",
    r"\* The ITS Assigned designation is for parity forecast purposes only",
    r"(?m)^[ \t]*(?:Description|Supporting Statement|Change From Previous Ten Year Plan|Change From Previous IRP)[ \t]*$",
]
SUPPORTING_STATEMENT = "REDACTED"
TAGS_IN_TITLES = ["APC", "FPL", "GPC", "GTC", "MEAG", "SAV", "USA"]
TITLE_PREFIXES = r"^(?:(?:(?:SAV|GTC|MEAG|DU|GPC)\s*:|(?:CC|GRID)\s+-)\s*)+"
TITLE_FIXES = [(r"(?<=\d\d)O(?=\s*KV)", "0"), (r"\bV\.\s*RICA\b", "VILLA RICA"), (r"\bPRI\b\.?", "PRIMARY"), (r"\bRD\b\.?", "ROAD"), (r"\bTALLBOT\b", "TALBOT")]
COMPASS_NAMES = {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST"}
ONLY_VOLTS = r"^(?:46|69|115|230|500)(?:/\d{2,3})?$"
WORDS_OF_WORK = """
    AKA AREA AUTO AUTOBANK BANK BREAKER BUS BUSES CAP CAPACITOR CC CONVERSION CUSTOMER DATA
    DUAL EQUIPMENT EXPANSION HALF IMPROVEMENT IMPROVEMENTS IMPROVMNT INSTALLATION JUMPER
    LIMITING LOOP LOW MODERNIZATION MODIFICATION NEEDS NETWORK PANEL PARTIAL PROJECT
    PROTECTIVE REACTOR REACTORS REBUILD RECONDUCTOR RELAY RELAYING REMOVAL REPLACEMENT
    SECOND SERIES SMART SOLUTION STATCOM STATION STRATEGIC SUB SUBSTATION SWITCHING TIE
    TRANSFORMER TRANSFORMERS TRANSMISSION TRAP UPGRADE UPGRADES XFMR 2ND
    """.split()
WORDS_OF_WORK_LATER = ["LINE", "LINES", "NEW", "SWITCH"]
SPONSOR_OWNERS = {"GPC": "Georgia Power", "GTC": "Georgia Transmission Corporation", "MEAG": "MEAG Power", "DU": "Dalton Utilities", "SAV": "Georgia Power"}
COST_COLUMNS = ["cost_previous", "cost_2024", "cost_2025", "cost_2026", "cost_2027", "cost_2028", "cost_total"]


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages (document, page, text) without the banners and headers that repeat on each."""
    text = F.coalesce("text", F.lit(""))
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, pattern, "")
    return pages.withColumn("text", text)


def page_offsets(pages: DataFrame) -> DataFrame:
    """Adds start: where each page begins in its document's joined text."""
    before = Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def join_pages(pages: DataFrame) -> DataFrame:
    """(document, text, starts): each document's pages in order, and an array of (start, page)."""
    rows = page_offsets(pages).groupBy("document").agg(F.sort_array(F.collect_list(F.struct("page", "text", "start"))).alias("p"))
    return rows.select("document", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["page"].alias("page"))).alias("starts"))


def bookmarked_range(bookmarks: DataFrame, title: str) -> DataFrame:
    """(document, first, last) of the first bookmark (document, place, title, page) that matches; last is null to the end."""
    hit = bookmarks.where(F.col("title").rlike(title)).groupBy("document").agg(F.min_by("page", "place").alias("first"))
    later = bookmarks.join(hit, "document").where("page > first").groupBy("document").agg((F.min("page") - 1).alias("last"))
    return hit.join(later, "document", "left")


def cut_pages(pages: DataFrame, pattern: str) -> DataFrame:
    """(document, part, text, page): what stands from each match of pattern at a line's begin to the next, and the page it begins on.

    pages: document, page, text. Each page is cut on its own, with the first two
    lines of the next one in sight for a header of up to three lines that begins at
    its end; a piece without a header goes on with the header before it. So a row
    holds one section and never a whole document.
    """
    order = Window.partitionBy("document").orderBy("page")
    ahead = F.coalesce(F.substring_index(F.lead("text").over(order), "\n", 2), F.lit(""))
    rows = pages.select("document", "page", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("_own"), ahead.alias("_ahead"))
    pieces = F.split(F.concat("_own", "_ahead"), rf"(?m)(?=^{pattern})")
    rows = rows.withColumn("_pieces", pieces)
    before = lambda i: F.aggregate(F.slice("_pieces", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
    placed = F.transform("_pieces", lambda x, i: F.struct(i.alias("place"), before(i).alias("at"), x.rlike(rf"\A(?m){pattern}").cast("int").alias("head"), x.alias("text")))
    own = rows.select("document", "page", F.length("_own").alias("_n"), F.explode(placed).alias("p")).where("p.at < _n")
    own = own.select("document", "page", "p.place", "p.head", F.substring("p.text", F.lit(1), F.col("_n") - F.col("p.at")).alias("text"))
    section = F.sum("head").over(Window.partitionBy("document").orderBy("page", "place").rowsBetween(Window.unboundedPreceding, 0))
    whole = own.withColumn("part", section).where("part > 0").groupBy("document", "part").agg(F.sort_array(F.collect_list(F.struct("page", "place", "text"))).alias("s"))
    return whole.select("document", "part", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), F.get("s", F.lit(0))["page"].alias("page"))


def table_pages(pages: DataFrame) -> DataFrame:
    """The pages of the project table, from its caption to the line of its total (to the end without one), and columns _begun, _ended."""
    pages = pages.select("document", "page", F.coalesce("text", F.lit("")).alias("text"))
    begin = F.locate(TABLE_CAPTION, F.col("text"))
    first = pages.where(begin > 0).groupBy("document").agg(F.min(F.struct("page", begin.alias("at"))).alias("_b"))
    rows = pages.join(first, "document", "left").where(F.col("_b").isNull() | (F.col("page") >= F.col("_b.page")))
    rows = rows.withColumn("text", F.when(F.col("page") == F.col("_b.page"), F.substring("text", F.col("_b.at"), F.length("text"))).otherwise(F.col("text")))
    stop = F.regexp_instr("text", F.lit(TABLE_END))
    last = rows.where(F.col("_b").isNotNull() & (stop > 0)).groupBy("document").agg(F.min(F.struct("page", stop.alias("at"))).alias("_e"))
    rows = rows.join(last, "document", "left").where(F.col("_e").isNull() | (F.col("page") <= F.col("_e.page")))
    text = F.when(F.col("page") == F.col("_e.page"), F.substring("text", F.lit(1), F.col("_e.at") - 1)).otherwise(F.col("text"))
    return rows.select("document", "page", text.alias("text"), F.col("_b").isNotNull().alias("_begun"), F.col("_e").isNotNull().alias("_ended"))


def table_rows(pages: DataFrame) -> DataFrame:
    """The rows of the project table: zone, plan_year, project_id, project_name, need_date, sponsor, page, problem.

    Rows wrap over lines and pages, so each runs from its start to the next; problem
    tells of a row that is not complete or swallowed its neighbour.
    """
    rows = cut_pages(table_pages(pages).where("_begun").select("document", "page", "text"), ROW_START)
    part = lambda k: F.regexp_extract("text", TABLE_ROW, k)
    return rows.select(
        "document", part(1).alias("zone"), part(2).try_cast("int").alias("plan_year"), part(3).alias("project_id"), T.tidy(part(4)).alias("project_name"),
        T.us_date(part(5)).alias("need_date"), part(6).alias("sponsor"), "page",
        F.when(~F.col("text").rlike(TABLE_ROW), "incomplete row").when(part(4).rlike(LEAKED_TEXT), "row swallowed neighbouring text").alias("problem"),
    )


class PlanTableError(ValueError):
    """A plan's table is not what its rows say it should be."""


def reconciled_rows(pages: DataFrame) -> tuple[DataFrame, Callable[[], dict]]:
    """`table_rows`, and a function that raises if not every row start became a complete row.

    The starts and the complete rows are counted by the pass that parses them, when
    the rows are written or collected; the function is to be called after that.
    """
    told = Observation()
    ok = F.col("problem").isNull()
    rows = table_rows(pages).observe(told, F.count("*").alias("starts"), F.count_if(ok).alias("complete"), F.count_if(F.col("problem") == "row swallowed neighbouring text").alias("swallowed"))

    def check() -> dict:
        counts = told.get
        if not counts["starts"]:
            raise PlanTableError("the table has no rows")
        if counts["swallowed"]:
            raise PlanTableError(f"{counts['swallowed']} rows swallowed neighbouring text")
        if counts["starts"] != counts["complete"]:
            raise PlanTableError(f"the table has {counts['starts']} row starts but {counts['complete']} complete rows; a row's layout changed")
        return counts

    return rows, check


def table_counts(pages: DataFrame) -> DataFrame:
    """(document, starts, complete, duplicates, problem) of every document's table; problem is null if all is well."""
    per_id = table_rows(pages).groupBy("document", "project_id").agg(F.count("*").alias("starts"), F.count_if(F.col("problem").isNull()).alias("complete"), F.count_if(F.col("problem").startswith("row swallowed")).alias("swallowed"))
    twice = F.count_if((F.col("complete") > 1) & (F.col("project_id") != ""))
    per = per_id.groupBy("document").agg(F.sum("starts").alias("starts"), F.sum("complete").alias("complete"), twice.alias("duplicates"), F.sum("swallowed").alias("swallowed"))
    seen = table_pages(pages).groupBy("document").agg(F.max("_begun").alias("begun"), F.max("_ended").alias("ended"))
    rows = seen.join(per, "document", "left").na.fill(0, ["starts", "complete", "duplicates", "swallowed"])
    problem = (
        F.when(~F.col("begun"), "table caption not found").when(~F.col("ended"), "end of the table not found").when(F.col("starts") == 0, "the table has no rows")
        .when(F.col("swallowed") > 0, "rows swallowed neighbouring text")
        .when(F.col("starts") != F.col("complete"), F.format_string("the table has %d row starts but %d complete rows; a row's layout changed", "starts", "complete"))
        .when(F.col("duplicates") > 0, "project IDs are there twice")
    )
    return rows.select("document", "starts", "complete", "duplicates", problem.alias("problem"))


def detail_pages(pages: DataFrame) -> DataFrame:
    """Project details: project_id, need_date, start_date, description, two changes, page, problem."""
    rows = cut_pages(pages, DETAIL_HEADER)
    rest = F.regexp_replace("text", rf"^{DETAIL_HEADER}", "")
    for pattern in FORM_TEXT:
        rest = F.regexp_replace(rest, pattern, "")
    lines = F.filter(F.transform(F.split(rest, "\n"), F.trim), lambda x: x != "")
    rows = rows.withColumn("lines", lines).withColumn("cut", F.array_position("lines", SUPPORTING_STATEMENT))
    head = lambda k: F.regexp_extract("text", rf"^{DETAIL_HEADER}", k)
    after = lambda k: F.when(F.col("cut") > 0, F.coalesce(F.get("lines", (F.col("cut") + k).cast("int")), F.lit(""))).otherwise("")
    return rows.select(
        "document", head(1).alias("project_id"), T.us_date(head(2)).alias("need_date"), T.us_date(head(3)).alias("start_date"),
        T.tidy(F.when(F.col("cut") > 1, F.array_join(F.slice("lines", F.lit(1), (F.col("cut") - 1).cast("int")), " ")).otherwise("")).alias("description"),
        after(0).alias("change_from_previous_plan"), after(1).alias("change_from_previous_irp"), "page",
        F.when(F.col("cut") == 0, "no redacted supporting statement").alias("problem"),
    )


def _site(part: Column) -> Column:
    """The place name at the begin of a part of a title: words up to the first that describes the work."""
    words = F.filter(F.split(F.trim(F.regexp_replace(part, r"#\s*\d+", " ")), r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("over"))

    def step(state: Column, word: Column) -> Column:
        plain = F.regexp_replace(word, r"\.+$", "")
        over = state["over"] | plain.isin(WORDS_OF_WORK) | ((F.size(state["kept"]) > 0) & plain.isin(WORDS_OF_WORK_LATER))
        skip = over | word.rlike(ONLY_VOLTS)
        return F.struct(F.when(skip, state["kept"]).otherwise(F.concat(state["kept"], F.array(word))).alias("kept"), over.alias("over"))

    def finish(state: Column) -> Column:
        kept = state["kept"]
        first = F.get(kept, F.lit(0))
        long = first
        for short, name in COMPASS_NAMES.items():
            long = F.when(first == short, name).otherwise(long)
        whole = F.when(F.size(kept) > 1, F.concat(F.array(long), F.slice(kept, F.lit(2), F.size(kept)))).otherwise(kept)
        return F.regexp_replace(F.array_join(whole, " "), r"^[ .,\-&]+|[ .,\-&]+$", "")

    return F.aggregate(words, start, step, finish)


def parse_titles(rows: DataFrame, title: str = "project_name") -> DataFrame:
    """Adds locations, owner_tags, project_type and voltages, read from a title such as "A - B 115KV REBUILD"."""
    text = F.upper(T.tidy(F.col(title)))
    for pattern, fixed in TITLE_FIXES:
        text = F.regexp_replace(text, pattern, fixed)
    rows = rows.withColumns({"_t": text}).withColumns({"voltages": T.voltages_in(F.col("_t")), "_loop": F.col("_t").rlike(r"\bLOOP[- ]?IN\b|\bFOLD[- ]?IN\b"), "_t": F.regexp_replace("_t", TITLE_PREFIXES, "")})
    tags = F.transform(F.regexp_extract_all("_t", F.lit(r"\(([^)]*)\)"), F.lit(1)), F.trim)
    rows = rows.withColumn("owner_tags", F.array_distinct(F.filter(tags, lambda x: x.isin(TAGS_IN_TITLES))))
    rest = F.regexp_replace("_t", r"\([^)]*\)", " ")
    rest = F.regexp_replace(rest, r"(?s)\b\d{2,3}(?:\s*[/-]\s*\d{2,3})*\s*KV\b.*$", "")
    rest = F.regexp_replace(rest, r"^.*?\bAT\s+", "")
    segments = F.split(rest, r"\s+-\s*|\s*-\s+|(?<=[A-Z.])-(?=[A-Z])")
    sites = F.transform(segments, lambda s: F.filter(F.transform(F.split(s, r"\s+(?:AND|&)\s+|\s*[,:]\s*"), _site), lambda x: x != ""))
    rows = rows.withColumn("_s", F.filter(sites, lambda x: F.size(x) > 0))
    n = F.size("_s")
    kind = (
        F.when(F.col("_loop"), "BOTH").when(n == 0, "UNKNOWN").when((n == 1) & (F.size(F.get("_s", F.lit(0))) > 1), "MULTI_SITE")
        .when(n == 1, "SUBSTATION").when(n == 2, "LINE").otherwise("MULTI_LINE")
    )
    return rows.withColumns({"locations": F.array_distinct(F.flatten("_s")), "project_type": kind}).drop("_t", "_s", "_loop")


def plan_projects(pages: DataFrame) -> DataFrame:
    """One row per table row with its detail page, title parts and mileage."""
    table = parse_titles(table_rows(pages).where("problem is null"))
    detail = detail_pages(pages).select("document", "project_id", "start_date", "description", "change_from_previous_plan", "change_from_previous_irp", F.col("need_date").alias("detail_need_date"), F.col("page").alias("detail_page"))
    rows = table.join(detail, ["document", "project_id"], "left")
    miles = T.miles_in(F.coalesce("description", F.lit("")))
    at = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(""))
    owner = F.lit("")
    for sponsor, name in SPONSOR_OWNERS.items():
        owner = F.when(F.col("sponsor") == sponsor, name).otherwise(owner)
    return rows.select(
        "document", "project_id", owner.alias("utility"), "sponsor", F.lit("Georgia").alias("state"), "project_name", "project_type",
        *[at("locations", k).alias(f"location_{k + 1}") for k in range(3)], F.array_join(F.slice("locations", 4, 100), "; ").alias("other_locations"),
        F.get("voltages", F.lit(0)).alias("voltage_1"), F.get("voltages", F.lit(1)).alias("voltage_2"), F.col("need_date").alias("in_service_date"), "start_date", "plan_year", "zone",
        F.array_join("owner_tags", "; ").alias("owner_tags"), T.single(miles).alias("line_miles"), F.array_join(miles.cast("array<string>"), "; ").alias("miles_mentioned"),
        "description", "change_from_previous_plan", "change_from_previous_irp", "detail_need_date", F.col("page").alias("table_page"), "detail_page",
    )


def plan_inconsistencies(pages: DataFrame) -> DataFrame:
    """(document, project_id, reason): rows without a detail page or with another date, empty descriptions, unknown sponsors, orphan details."""
    table, detail = table_rows(pages).alias("t"), detail_pages(pages).alias("d")
    both = table.join(detail, (F.col("t.document") == F.col("d.document")) & (F.col("t.project_id") == F.col("d.project_id")), "full_outer")
    there, told = F.col("t.project_id").isNotNull(), F.col("d.project_id").isNotNull()
    reasons = F.array(
        F.when(there & ~told, "no detail page"), F.when(there & told & (F.col("t.need_date") != F.col("d.need_date")), "need dates differ"),
        F.when(there & told & (F.col("d.description") == ""), "empty description"), F.when(there & ~F.col("t.sponsor").isin(list(SPONSOR_OWNERS)), "unknown sponsor"), F.when(~there, "no table row"),
    )
    return both.select(F.coalesce("t.document", "d.document").alias("document"), F.coalesce("t.project_id", "d.project_id").alias("project_id"), F.explode(F.array_compact(reasons)).alias("reason"))


def page_projects(pages: DataFrame) -> DataFrame:
    """One project per page that has a "Project ID": id, title, last date, description, costs, mileage, warning."""
    rows = pages.withColumn("text", T.tidy(F.col("text"))).where(F.contains("text", F.lit("Project ID")))
    between = lambda a, b: T.text_between(F.col("text"), a, b)
    dates = F.transform(F.regexp_extract_all(between("Planned In-Service Date", "Estimated Project Cost"), F.lit(DATE), F.lit(0)), T.us_date)
    costs = F.transform(F.regexp_extract_all(F.regexp_extract("text", "(?s)Estimated Project Cost(.*)", 1), F.lit(r"\$([\d,]+)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long"))
    rows = rows.select("document", "page", T.tidy_id(between("Project ID", "Project Description")).alias("project_id"), between("5 Year Budget", "Project ID").alias("project_name"), F.array_max(dates).alias("in_service_date"), between("Project Description", "Project Need").alias("description"), costs.alias("costs"))
    miles = T.miles_in(F.concat_ws(" ", "project_name", "description"))
    year = F.element_at(F.filter(F.zip_with(F.slice("costs", 1, 6), F.array(F.lit(0), *[F.lit(y) for y in range(2024, 2029)]), lambda c, y: F.when(c > 0, y)), lambda y: y.isNotNull()), 1)
    first = F.when(F.size(F.filter(F.slice("costs", 1, 6), lambda c: c > 0)) > 0, year)
    total = F.aggregate(F.slice("costs", 1, 6), F.lit(0).cast("long"), lambda a, c: a + c)
    return rows.select(
        "document", "page", "project_id", "project_name", "in_service_date", F.when(first > 0, F.make_date(first, F.lit(1), F.lit(1))).alias("start_date"),
        T.single(miles).alias("line_miles"), F.array_join(miles.cast("array<string>"), "; ").alias("miles_mentioned"), "description",
        *[F.get("costs", F.lit(k)).alias(c) for k, c in enumerate(COST_COLUMNS)],
        F.when(F.size("costs") != 7, "not seven costs").when(total != F.get("costs", F.lit(6)), "yearly costs do not add up to the total").alias("warning"),
    )


def chunk_pages(pages: DataFrame, max_chars: int) -> DataFrame:
    """(document, chunk, pages): runs of pages up to max_chars that share a page with the run before, two pages at least.

    The cut of a run depends on the one before, so each document's page lengths
    are folded in order; texts stay outside of the fold.
    """
    listed = pages.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("page", F.length("text").alias("n")))).alias("p"))
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("open"), F.lit(0).alias("size"), F.lit(0).alias("last"))

    def step(s: Column, x: Column) -> Column:
        page, n = x["page"].cast("int"), x["n"]
        fits = (F.size(s["open"]) < 2) | (s["size"] + n <= max_chars)
        return F.struct(
            F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"),
            F.when(fits, F.concat(s["open"], F.array(page))).otherwise(F.array(F.element_at(s["open"], -1), page)).alias("open"),
            F.when(fits, s["size"] + n).otherwise(s["last"] + n).alias("size"),
            n.alias("last"),
        )

    runs = F.aggregate("p", start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    return listed.select("document", F.posexplode(runs).alias("chunk", "pages"))


def render_pages(pages: DataFrame) -> DataFrame:
    """(document, text): a document's pages, each under a line with its number."""
    shown = F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n"), F.col("text"))
    rows = pages.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("page", shown.alias("shown")))).alias("p"))
    return rows.select("document", F.array_join(F.transform("p", lambda x: x["shown"]), "\n\n").alias("text"))
