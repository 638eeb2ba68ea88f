"""Values that a model quoted from page texts: found on their pages, checked, merged into project rows.

Tables: pages (document, page, text); quotes (document, page, quote, ...);
problems (document, project_id, field, value, quote, page, reason).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import durable
from .plan_text import SPONSOR_OWNERS, chunk_pages
from .quotes import pages_holding

PROBLEM = ["document", "project_id", "field", "value", "quote", "page", "reason"]
# What a project must have, years that dates may have, and the longest credible mileage.
NEEDED_FIELDS = ["project_name", "in_service_date"]
FIRST_YEAR, LAST_YEAR, MOST_MILES = 1990, 2060, 300


def readable_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with text, and (document, page) of those without."""
    there = T.filled(F.col("text"))
    return pages.where(there), pages.where(~there).select("document", "page")


def locate_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds value, the cited page's own spelling of the quote or null, reason, why there is none (else empty), and elsewhere.

    The cited page is an equi-join; only quotes that are not on it are looked for
    on the other pages of their document, each distinct one once, by their grams.
    Spellings are looked for once and dealt by page to the session's number of
    shuffle partitions: Spark would join these few bytes to one task.
    """
    n = int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    page = pages.select("document", "page", F.col("text").alias("_text")).repartition(n, "document", "page")
    rows = quotes.repartition(n, "document", "page").join(page, ["document", "page"], "left")
    rows = durable(rows.select(*quotes.columns, F.col("_text").isNotNull().alias("_here"), T.own_spelling(F.col("_text"), F.col("quote")).alias("_own")))
    lost = durable(rows.where(F.col("_own").isNull() & T.filled(F.col("quote")) & F.col("_here")).select("document", "quote").distinct())
    other = pages_holding(lost, pages.select("document", F.col("page").alias("_page"), "text"), ["_page"], ["document"])
    other = other.groupBy("document", "quote").agg(F.slice(F.sort_array(F.collect_set("_page")), 1, 3).alias("elsewhere"))
    rows = rows.join(other, ["document", "quote"], "left")
    cited = F.col("page").cast("string")
    reason = (
        F.when(F.col("_own").isNotNull(), "")
        .when(~T.filled(F.col("quote")), "empty text")
        .when(F.col("page").isNull(), "cites no page")
        .when(~F.col("_here"), F.concat(F.lit("cites page "), cited, F.lit(", which wasn't in this run")))
        .when(F.col("elsewhere").isNotNull(), F.concat(F.lit("not on page "), cited, F.lit(", but on page "), F.array_join(F.col("elsewhere").cast("array<string>"), ", ")))
        .otherwise(F.concat(F.lit("not on page "), cited, F.lit(" or any other page")))
    )
    none = F.array().cast(f"array<{quotes.schema['page'].dataType.simpleString()}>")
    return rows.select(*quotes.columns, F.col("_own").alias("value"), reason.alias("reason"), F.when(F.col("_own").isNull(), F.coalesce("elsewhere", none)).otherwise(none).alias("elsewhere"))


def merge_checked(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields (document, project_id, field, value, quote, page) and problems of checked fragments.

    fragments: document, project_id, field, page, place, quote, value (null if
    refused), reason. In order of (page, place) the first value counts; refused
    ones, and values that read differently from it, are problems.
    """
    keys = ["document", "project_id", "field"]
    good = fragments.where("value is not null")
    fields = good.groupBy(*keys).agg(F.min_by(F.struct("value", "quote", "page"), F.struct("page", "place")).alias("f")).select(*keys, "f.*")
    refused = fragments.where("value is null").select("document", "project_id", "field", F.lit("").alias("value"), "quote", "page", "reason")
    kept = fields.select(*keys, F.col("value").alias("_kept"), F.col("page").alias("_page"))
    differ = good.join(kept, keys).where(~T.same_text(F.col("value"), F.col("_kept")))
    said = F.format_string("page %s says '%s' but page %s says '%s'; keeping page %s", F.col("_page").cast("string"), F.col("_kept"), F.col("page").cast("string"), F.col("value"), F.col("_page").cast("string"))
    return fields, refused.select(*PROBLEM).unionByName(differ.withColumn("reason", said).select(*PROBLEM)).distinct()


def stray_problems(problems: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problems of projects that were read, and those that belong to none."""
    key = ["document", "project_id"]
    return problems.join(projects.select(*key).distinct(), key, "left_semi"), problems.join(projects, key, "left_anti")


def sanity_problems(projects: DataFrame) -> DataFrame:
    """Problems of values that passed their checks but look wrong, or are missing.

    projects: document, project_id, project_name, in_service_date, start_date (ISO
    texts), description and flagged (array of fields that have a problem already).
    """
    at = lambda c: T.blank(F.col(c))
    flagged = F.coalesce("flagged", F.array().cast("array<string>"))
    found = [F.when((at(c) == "") & ~F.array_contains(flagged, c), F.struct(F.lit(c).alias("field"), F.lit("").alias("value"), F.lit("not found in the document").alias("reason"))) for c in NEEDED_FIELDS]
    for c in ("in_service_date", "start_date"):
        odd = ~F.substring(at(c), 1, 4).try_cast("int").between(FIRST_YEAR, LAST_YEAR)
        found.append(F.when((at(c) != "") & odd, F.struct(F.lit(c).alias("field"), at(c).alias("value"), F.lit(f"year outside {FIRST_YEAR}-{LAST_YEAR}").alias("reason"))))
    late = (at("start_date") != "") & (at("in_service_date") != "") & (at("start_date") > at("in_service_date"))
    found.append(F.when(late, F.struct(F.lit("start_date").alias("field"), at("start_date").alias("value"), F.concat(F.lit("starts after its in-service date "), at("in_service_date")).alias("reason"))))
    miles = T.miles_in(F.concat(at("project_name"), F.lit(" "), at("description")))
    found.append(F.when(F.exists(miles, lambda m: m > MOST_MILES), F.struct(F.lit("miles_mentioned").alias("field"), F.lit("").alias("value"), F.lit(f"mentions more than {MOST_MILES} miles").alias("reason"))))
    rows = projects.select("document", "project_id", F.explode(F.array_compact(F.array(*found))).alias("p"))
    return rows.select("document", "project_id", "p.field", "p.value", F.lit("").alias("quote"), F.lit(None).cast("int").alias("page"), "p.reason")


def inventory_problems(projects: DataFrame, listed: DataFrame) -> DataFrame:
    """Projects (document, project_id) against the IDs that another pass listed (document, project_id, page): problems of either side's own."""
    key = ["document", "project_id"]
    first = listed.groupBy(*key).agg(F.min("page").cast("int").alias("page"))
    here = projects.select(*key, F.lit(True).alias("_here")).distinct()
    rows = here.join(first.withColumn("_listed", F.lit(True)), key, "full_outer").where("_here is null or _listed is null")
    reason = F.when(F.col("_here").isNull(), "listed by the ID pass, but no project was read for it").otherwise("the ID pass didn't list this project")
    return rows.select(*key, F.lit("project_id").alias("field"), F.lit("").alias("value"), F.lit("").alias("quote"), "page", reason.alias("reason"))


def page_labels(replies: DataFrame) -> DataFrame:
    """(document, page, kinds): the sorted kinds that replies (document, page, kind) give each page."""
    return replies.where("kind is not null").groupBy("document", "page").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def owner_of(sponsor: Column, document_owner: str, default_sponsor: str = "") -> Column:
    """struct(utility, reason): the owner that a printed sponsor stands for in a document, and why a person should look at it."""
    told = F.coalesce(F.nullif(T.blank(sponsor), F.lit("")), F.lit(default_sponsor))
    pair = lambda who, why="": F.struct((who if isinstance(who, Column) else F.lit(who)).alias("utility"), F.lit(why).alias("reason"))
    if document_owner.strip().lower() == "georgia power":
        names = {k.lower(): v for k, v in SPONSOR_OWNERS.items()} | {v.lower(): v for v in SPONSOR_OWNERS.values()}
        known = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), T.canon(told))
        return (
            F.when(known.isNotNull(), pair(known))
            .when(told == "", pair("", "no sponsor found in a mixed-utility plan; utility left blank"))
            .otherwise(pair(told, "unknown Georgia sponsor; utility kept as printed sponsor pending review"))
        )
    own = (told == "") | T.same_text(told, F.lit(document_owner))
    if default_sponsor:
        own |= T.same_text(told, F.lit(default_sponsor))
    return F.when(own, pair(document_owner)).otherwise(pair(told, "unmapped sponsor differs from document utility; utility kept as printed sponsor pending review"))


def project_rows(fields: DataFrame, locations: DataFrame, problems: DataFrame, document_owner: str, state: str, default_sponsor: str = "") -> DataFrame:
    """One row per project from its fields (document, project_id, field, value, page) and locations (document, project_id, place, value, page).

    Voltages and miles are read from the checked title and description. status is
    VERIFIED for a project without problems, else REVIEW.
    """
    key = ["document", "project_id"]
    of = lambda name: F.coalesce(F.max(F.when(F.col("field") == name, F.col("value"))), F.lit("")).alias(name)
    wide = fields.groupBy(*key).agg(*map(of, ("project_name", "sponsor", "in_service_date", "start_date", "description")), F.collect_set("page").alias("_pages"))
    first = locations.withColumn("_r", F.row_number().over(Window.partitionBy(*key, T.squash(F.col("value"))).orderBy("page", "place"))).where("_r = 1")
    named = first.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "place", "value"))), lambda x: x["value"]).alias("_l"), F.collect_set("page").alias("_lp"))
    bad = problems.select(*key).distinct().withColumn("_bad", F.lit(True))
    rows = wide.join(named, key, "left").join(bad, key, "left")
    none = F.array().cast("array<string>")
    places, nth = F.coalesce("_l", none), lambda a, n: F.coalesce(F.get(a, F.lit(n)).cast("string"), F.lit(""))
    title, whole = T.voltages_in(F.col("project_name")), F.concat(F.col("project_name"), F.lit(" "), F.col("description"))
    volts, miles = F.when(F.size(title) > 0, title).otherwise(T.voltages_in(F.col("description"))), T.miles_in(whole)
    plain = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    pages = F.array_sort(F.array_distinct(F.concat("_pages", F.coalesce(F.col("_lp"), F.array().cast("array<int>")))))
    return rows.select(
        *key,
        owner_of(F.col("sponsor"), document_owner, default_sponsor)["utility"].alias("utility"),
        F.coalesce(F.nullif("sponsor", F.lit("")), F.lit(default_sponsor)).alias("sponsor"),
        F.lit(state).alias("state"), "project_name", F.lit("").alias("project_type"),
        *[nth(places, n).alias(f"location_{n + 1}") for n in range(3)],
        F.array_join(F.slice(places, F.lit(4), F.greatest(F.size(places) - 3, F.lit(0))), "; ").alias("other_locations"),
        *[nth(volts, n).alias(f"voltage_{n + 1}") for n in range(2)],
        "in_service_date", "start_date",
        F.coalesce(T.single(miles).cast("string"), F.lit("")).alias("line_miles"),
        F.array_join(F.transform(miles, plain), "; ").alias("miles_mentioned"),
        "description", F.array_join(pages.cast("array<string>"), "; ").alias("pages"),
        F.when(F.col("_bad"), "REVIEW").otherwise("VERIFIED").alias("status"),
    )


def review_rows(problems: DataFrame) -> DataFrame:
    """What a person is to look at, texts without nulls."""
    return problems.select("document", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("project_id", "field", "value", "quote", "page", "reason")])


def shifted_chunks(pages: DataFrame, max_chars: int) -> DataFrame:
    """(document, chunk, pages) as `chunk_pages` has them, with boundaries moved by half of a document's first run, one page at least.

    A project cut at a boundary of one set of runs is in the middle of a run of the
    other. A document that has no page behind the moved boundary keeps its runs.
    """
    runs = chunk_pages(pages, max_chars)
    shift = runs.where("chunk = 0").select("document", F.greatest(F.lit(1), F.floor(F.size("pages") / 2)).cast("int").alias("_shift"))
    count = pages.groupBy("document").agg(F.count("*").alias("_n"))
    moved = shift.join(count, "document").where("_shift + 1 < _n").select("document", "_shift")
    placed = pages.withColumn("_at", F.row_number().over(Window.partitionBy("document").orderBy("page")) - 1).join(moved, "document")
    first = placed.where("_at <= _shift").groupBy("document").agg(F.sort_array(F.collect_list(F.col("page").cast("int"))).alias("pages"))
    later = chunk_pages(placed.where("_at >= _shift").select(*pages.columns), max_chars).withColumn("chunk", F.col("chunk") + 1)
    same = runs.join(moved, "document", "left_anti")
    return same.unionByName(first.select("document", F.lit(0).alias("chunk"), "pages")).unionByName(later)


def halves(pages: Column) -> Column:
    """struct(first, second) of a run of pages that was too long: both hold the middle page if that makes them shorter; a single page is an error."""
    n = F.size(pages)
    middle = F.floor(n / 2).cast("int")
    first = F.slice(pages, F.lit(1), F.when(n == 2, F.lit(1)).otherwise(middle + 1))
    second = F.slice(pages, middle + 1, n)
    return F.when(n < 2, F.raise_error(F.lit("a single page cannot be split")).cast("struct<first:array<int>,second:array<int>>")).otherwise(F.struct(first.alias("first"), second.alias("second")))


def reply_key(shaping: dict[str, Column]) -> Column:
    """The cache key of a reply: a digest over everything that shaped it, by name."""
    named = [F.struct(F.lit(k).alias("k"), F.coalesce(shaping[k].cast("string"), F.lit("")).alias("v")) for k in sorted(shaping)]
    return F.substring(F.sha2(F.to_json(F.array(*named)), 256), 1, 32)


def cached_replies(requests: DataFrame, cache: DataFrame, replay: bool = False) -> DataFrame:
    """Requests (key, ...) with the reply of the cache (key, reply); offline, a request without one is an error."""
    rows = requests.join(cache.select("key", "reply").dropDuplicates(["key"]), "key", "left")
    if replay:
        gone = F.raise_error(F.concat(F.lit("no cached reply for request "), F.col("key"))).cast("string")
        return rows.withColumn("reply", F.when(F.col("reply").isNull(), gone).otherwise(F.col("reply")))
    return rows


def document_requests(pages: DataFrame, max_chars: int, shaping: dict[str, Column] | None = None) -> DataFrame:
    """(document, chunk, pages, text, key): a request for each run of a document's pages, with the key of its reply.

    shaping: what else shapes a reply (model, instructions), a column or literal by name.
    """
    runs = chunk_pages(pages, max_chars)
    each = runs.select("document", "chunk", F.explode("pages").alias("page")).join(pages.select("document", F.col("page").cast("int").alias("page"), "text"), ["document", "page"])
    shown = F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n"), F.coalesce("text", F.lit("")))
    texts = each.groupBy("document", "chunk").agg(F.sort_array(F.collect_list(F.struct("page", shown.alias("shown")))).alias("p"))  # as many pages as a run may have
    text = F.array_join(F.transform("p", lambda x: x["shown"]), "\n\n")
    rows = texts.select("document", "chunk", F.transform("p", lambda x: x["page"]).alias("pages"), text.alias("text"))
    return rows.withColumn("key", reply_key({**(shaping or {}), "text": F.col("text")}))


def replay_documents(pages: DataFrame, cache: DataFrame, max_chars: int, shaping: dict[str, Column] | None = None) -> DataFrame:
    """(document, chunk, pages, reply) of whole documents from cached replies (key, reply) alone; one that is missing is an error."""
    return cached_replies(document_requests(pages, max_chars, shaping), cache, replay=True).select("document", "chunk", "pages", "reply")


def token_estimate(chars: Column, per_request: int, chars_per_token: float) -> Column:
    """Input tokens of a request, about: what each one costs and its characters by a ratio."""
    return (F.lit(per_request) + F.ceil(chars / F.lit(chars_per_token))).cast("long")
