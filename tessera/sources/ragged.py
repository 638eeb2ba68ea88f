"""CSV with any number of cells a row, read in byte ranges: a quoted cell may span lines and range borders.

A line that begins outside of a quoted cell ends inside or outside of one, and so
does a line that begins inside; a line is a map of two states onto two. A chain of
such maps has a short form: the last line that ends alike either way, and how many
lines after it swap the states. So the state at each line comes from a running
window over its range, that of each range from a window over the ranges of its
file (one row a range), and no file has to be in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def ends_inside(line: Column, inside: bool) -> Column:
    """Does a line end inside a quoted cell? What is left of it without its closed quoted cells still opens one then."""
    text = F.concat(F.lit(',"' if inside else ","), line)
    return F.contains(F.regexp_replace(text, f",{_QUOTED}[^,]*+", ","), F.lit(',"'))


def cells_of(record: Column) -> Column:
    """The cells of a record: quotes taken off and doubled ones undone; text after a closing quote belongs to its cell."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf',(?:{_QUOTED}[^,]*+|"(?s:.*+)|[^,]*+)'), F.lit(0))
    undone = lambda x: F.replace(x, F.lit('""'), F.lit('"'))

    def plain(cell: Column) -> Column:
        body = F.substring(cell, F.lit(2), F.length(cell))
        quoted = F.regexp_substr(body, F.lit(rf"\A{_QUOTED}"))
        closed = F.concat(undone(F.substring(quoted, F.lit(2), F.length(quoted) - 2)), F.substring(body, F.length(quoted) + 1, F.length(body)))
        return F.when(~F.startswith(body, F.lit('"')), body).when(quoted.isNotNull(), closed).otherwise(undone(F.substring(body, F.lit(2), F.length(body))))

    return F.transform(found, plain)


def _chain(swap: Column, fixed: Column, value: Column, window) -> tuple[Column, Column]:
    """The short form of the maps of a window: the last fixed one (its value and the swaps up to it), and all swaps."""
    swaps = F.coalesce(F.sum(F.when(swap, 1).otherwise(0)).over(window), F.lit(0))
    return F.last(F.when(fixed, F.struct(value.cast("int").alias("v"), F.col("_swaps").alias("s"))), True).over(window), swaps


def _after(start: Column, last: Column, swaps: Column) -> Column:
    """The state (1: inside) behind a chain that begins in start."""
    return F.when(last.isNull(), F.pmod(start + swaps, F.lit(2))).otherwise(F.pmod(last["v"] + swaps - last["s"], F.lit(2))).cast("int")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cells): every record of the files at path, numbered in each from 0, blank ones too."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = lines.withColumns({"out": ends_inside(F.col("value"), False), "in": ends_inside(F.col("value"), True)})
    swap, fixed = F.col("out") & ~F.col("in"), F.col("out") == F.col("in")
    order = Window.partitionBy("file", "range").orderBy("at")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_swaps", F.sum(F.when(swap, 1).otherwise(0)).over(upto))
    last, swaps = _chain(swap, fixed, F.col("out"), before)
    lines = lines.withColumns({"_last": last, "_before": swaps})
    whole = F.max_by(F.struct(F.when(fixed, F.struct(F.col("out").cast("int").alias("v"), F.col("_swaps").alias("s"))).otherwise(F.col("_last")).alias("last"), F.col("_swaps").alias("swaps")), "at")
    ranges = lines.groupBy("file", "range").agg(whole.alias("w")).select("file", "range", F.col("w.last").alias("last"), F.col("w.swaps").alias("swaps"))
    # a range as one map: fixed if any of its lines is, else a swap if it swaps an odd number of times
    along = Window.partitionBy("file").orderBy("range")
    ranges = ranges.withColumns({"fixed": F.col("last").isNotNull(), "swap": F.col("last").isNull() & (F.col("swaps") % 2 == 1), "value": F.pmod(F.col("last.v") + F.col("swaps") - F.col("last.s"), F.lit(2))})
    ranges = ranges.withColumn("_swaps", F.sum(F.when(F.col("swap"), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    last, swaps = _chain(F.col("swap"), F.col("fixed"), F.col("value"), along.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumns({"_l": last, "_s": swaps}).select("file", "range", _after(F.lit(0), F.col("_l"), F.col("_s")).alias("start"))
    lines = lines.join(ranges, ["file", "range"]).withColumn("begins", F.when(_after(F.col("start"), F.col("_last"), F.col("_before")) == 0, 1).otherwise(0))
    lines = lines.withColumn("_n", F.sum("begins").over(upto))
    counts = lines.groupBy("file", "range").agg(F.sum("begins").alias("n")).withColumn("_first", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "range", "_first")
    numbered = lines.join(counts, ["file", "range"]).select("file", (F.col("_first") + F.col("_n") - 1).alias("line"), F.struct("range", "at", "value").alias("part"))
    whole = numbered.groupBy("file", "line").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["value"]), "\n"), r"\r\z", "")
    return whole.select("file", "line", cells_of(text).alias("cells"))
