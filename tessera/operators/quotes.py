"""Quotes looked up in many pages through an index of character grams.

A page that holds a quote holds every run of letters of it, spaces apart. So a
quote is looked up by one gram, the rarest of its own in a sample of pages: an
equi-join of grams finds the pages that can hold it, and only those are read and
compared. Most quotes go by grams that begin with some of the rarer letters, about
an eighth of all; short ones and those of other scripts by all of their grams.
A quote takes the first level at which it has a gram, and pages are indexed at the
levels that quotes use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import durable

#: Letters of a gram, and what it begins with.
LEVELS = ((16, "[bgkpvwy0-9]"), (8, "[bgkpvwy0-9]"), (8, "."), (3, "."), (1, "."))
#: Pages in which grams are counted to tell rare ones; only speed depends on it.
SAMPLE = 500
#: The most that is sent to every task.
BROADCAST_BYTES = 8 << 20


def grams(squashed: Column, letters: int, begin: str) -> Column:
    """Hashes of the distinct indexed grams of a text without spaces."""
    found = F.regexp_extract_all(squashed, F.lit(rf"(?s)(?=({begin}.{{{letters - 1}}}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda g: F.xxhash64(g)))


def _indexed(pages: DataFrame, levels: list[int], columns: list[str]) -> DataFrame:
    """columns, level and gram of every indexed gram of pages (text)."""
    squashed = pages.select(*columns, T.squash(F.col("text")).alias("_s"))
    at = lambda k: F.transform(grams(F.col("_s"), *LEVELS[k]), lambda g: F.struct(F.lit(k).alias("level"), g.alias("gram")))
    return squashed.select(*columns, F.explode(F.concat(*map(at, levels))).alias("_g")).select(*columns, "_g.*")


def _joined(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """An equi-join whose smaller side is computed once, and broadcast only if its texts are measured to be small."""
    few = durable(few)
    size = few.agg(F.sum(F.octet_length("quote") + F.lit(64))).first()[0] or 0
    return many.join(F.broadcast(few) if size <= BROADCAST_BYTES else few.hint("merge"), on)


def _dealt(pages: DataFrame) -> DataFrame:
    """pages over all cores: a table whose scan has fewer parts than there are cores may be one large part, and is small enough to deal anew."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def _keys(quotes: DataFrame, pages: DataFrame, within: list[str]) -> tuple[DataFrame, list[int]]:
    """quotes with the level and gram by which each is looked up, and the levels in use."""
    first = F.coalesce(*[F.when(F.size(g) > 0, F.struct(F.lit(k).alias("level"), g.alias("grams"))) for k, g in enumerate(grams(F.col("_s"), *level) for level in LEVELS)])
    own = quotes.withColumn("_s", T.squash(F.col("quote"))).where("_s <> ''").withColumn("_g", first).select(*within, "quote", "_g.*")
    levels = sorted(r["level"] for r in own.select("level").distinct().collect())  # five at most
    if not levels:
        return own.select(*within, "quote", "level", F.lit(0).cast("long").alias("gram")), []
    share = min(1.0, SAMPLE / max(1, pages.count()))
    drawn = F.pmod(F.xxhash64(*[c for c in pages.columns if c != "text"]), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    often = _indexed(pages.where(drawn), levels, []).groupBy("level", "gram").agg(F.count("*").alias("pages"))
    each = own.select(*within, "quote", "level", F.explode("grams").alias("gram")).join(often, ["level", "gram"], "left")
    rarest = each.groupBy(*within, "quote", "level").agg(F.min_by("gram", F.struct(F.coalesce("pages", F.lit(0)), "gram")).alias("gram"))
    return rarest, levels


def pages_holding(quotes: DataFrame, pages: DataFrame, key: list[str], within: list[str] | None = None, whole_words: bool = True) -> DataFrame:
    """(within, quote, key): the distinct pages that hold each distinct quote.

    quotes: within, quote; pages: within, key, text. A quote is looked up among the
    pages that agree in within. Case, dashes and white space don't count; with
    whole_words "Lee" is not in "Leesville". Null and blank quotes are on no page.
    """
    within = within or []
    pages = pages.select(*within, *key, "text")
    asked, levels = _keys(quotes.select(*within, "quote").distinct(), pages, within)
    if not levels:
        return asked.join(pages, within, "inner").select(*within, "quote", *key).where("false") if within else pages.select(F.lit("").alias("quote"), *key).where("false")
    pages = _dealt(pages)
    hits = _joined(_indexed(pages, levels, within + key), asked, [*within, "level", "gram"]).select(*within, "quote", *key).distinct()
    told = _joined(pages, hits, within + key)
    holds = T.holds_words(F.col("text"), F.col("quote")) if whole_words else F.contains(T.squash(F.col("text")), T.squash(F.col("quote")))
    return told.where(holds).select(*within, "quote", *key).distinct()
