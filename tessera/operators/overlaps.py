"""Pairs of projects of two owners that lie near each other: found, scored, ranked, priced."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions.geo import cell_of, cells_around, haversine_miles, point_key, valid_point
from ..sources.shared import durable, keyed_session
from . import grid
from .grid import join_cells

PAIR_FIELDS = [
    "utility", "project_id", "project_name", "project_type", "region", "line_miles", "start_date", "in_service_date", "voltage",
    "confidence", "center_method", "latitude", "longitude", "source_file", "source_pages", "verification_notes", "data_warnings",
]
SCORES = ["distance_score", "timeline_overlap_score", "days_apart_score", "power_voltage_score", "project_type_score"]
IMPACT = ["state_a", "state_b", "shared_miles", "row_width_feet", "land_saved_acres", "land_value_per_acre", "land_saved_value_usd", "impact_explanation"]
MODES = ("score", "distance_first")
# Other names under which pair tables have these columns, in the order they count.
PAIR_ALIASES = {
    "distance_miles": ["distance miles"], "days_apart": ["date_gap_days", "date gap days", "time_gap"],
    "start_date_a": ["utility a start date"], "start_date_b": ["utility b start date"],
    "in_service_date_a": ["utility a date", "in-service date a"], "in_service_date_b": ["utility b date", "in-service date b"],
    "voltage_a": ["voltage_1_a", "max_voltage_a", "utility a voltage"], "voltage_b": ["voltage_1_b", "max_voltage_b", "utility b voltage"],
    "project_type_a": ["type_a", "utility a project type"], "project_type_b": ["type_b", "utility b project type"],
}


def eligible_projects(projects: DataFrame, include_low: bool = True) -> DataFrame:
    """Rows with a usable center that no status excludes; without LOW confidence on request."""
    excluded = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) == "excluded"
    keep = valid_point(F.col("latitude"), F.col("longitude")) & ~excluded("location_status") & ~excluded("match_status")
    if not include_low:
        keep &= F.col("confidence").isin("High", "Medium")
    return projects.where(keep)


def _as_written(projects: DataFrame, field: str) -> Column:
    """A project's field as a pair has it: blanks for missing texts, and dates as ISO texts where they are dates of any known form."""
    if field not in projects.columns:
        return F.lit(None).cast("string")
    if field in ("start_date", "in_service_date"):
        return F.coalesce(F.date_format(T.any_date(F.col(field)), "yyyy-MM-dd"), T.blank(F.col(field)))
    return F.coalesce(F.col(field), F.lit("")) if projects.schema[field].dataType.simpleString() == "string" else F.col(field)


def _sides(projects: DataFrame, owner_a: str, owner_b: str) -> tuple[DataFrame, DataFrame]:
    return tuple(projects.where(F.col("utility") == owner).select([_as_written(projects, f).alias(f"{f}_{side}") for f in PAIR_FIELDS]) for owner, side in ((owner_a, "a"), (owner_b, "b")))


def _distance() -> Column:
    return haversine_miles(*(F.col(c) for c in ("latitude_a", "longitude_a", "latitude_b", "longitude_b")))


def readings(rows: DataFrame, side: str) -> dict[str, Column]:
    """What scores and estimates read of one side of a pair, and no more than that side says. Pairs that are found have it from their projects, so it is read once a project."""
    date = {f: T.any_date(F.col(f"{f}_{side}")) for f in ("start_date", "in_service_date")}
    label = [F.col(f"utility_{side}"), F.lit(":"), F.col(f"project_id_{side}")]
    read = {f"_{f}_{side}": d for f, d in date.items()} | {
        f"_bad_{side}": T.filled(F.col(f"start_date_{side}")) & date["start_date"].isNull(),
        f"_volts_{side}": T.volts(F.col(f"voltage_{side}")),
        f"_kind_{side}": T.project_kind(F.col(f"project_type_{side}")),
        f"_label_{side}": F.concat_ws("", *label, *([F.lit(" | ")] if side == "a" else [])),
    }
    return {name: value for name, value in read.items() if name not in rows.columns}


def land_readings(rows: DataFrame, side: str) -> dict[str, Column]:
    """What `estimate_land` reads of one side of a pair: _land_a or _land_b with its state, miles, feet, value of an acre, and what is missing (null if nothing is)."""
    if f"_land_{side}" in rows.columns:
        return {}
    region = F.col(f"region_{side}") if f"region_{side}" in rows.columns else F.lit("")
    state = S.project_state(F.col(f"utility_{side}"), region)
    missing = F.nullif(F.array_join(S.missing_for_estimate(side, state), "; "), F.lit(""))
    told = {"state": state, "miles": T.number(F.col(f"line_miles_{side}")), "feet": S.easement_feet(F.col(f"voltage_{side}")), "value": S.lookup(S.LAND_VALUE_PER_ACRE, state), "missing": missing}
    return {f"_land_{side}": F.struct(*[value.alias(name) for name, value in told.items()])}


def near_points(a: DataFrame, b: DataFrame, miles: float, most: int | None = None) -> DataFrame:
    """Rows of a and b within miles, with distance_miles, through an equi-join on grid cells as wide as the threshold.

    Side a is copied to every cell its circle touches, side b stays in its own,
    so each pair meets once. A crowded cell is joined in slices.
    """
    size = max(miles / 69.0, 1e-4)
    a = a.withColumn("_cell", F.explode(cells_around(F.col("latitude_a"), F.col("longitude_a"), miles, size)))
    b = b.withColumn("_cell", cell_of(F.col("latitude_b"), F.col("longitude_b"), size))
    return join_cells(a, b, most).where(_distance() <= miles).drop("_cell").withColumn("distance_miles", _distance())


def pairs_by_grid(a: DataFrame, b: DataFrame, miles: float, told: dict[str, Column] | None = None) -> DataFrame:
    """Pairs within miles, with distance_miles and the columns told of it.

    Where many rows share their points, the distinct points are joined, and each
    point's rows then take its place: a distance, and what is told of it, is
    computed once for two points, not for each pair of their rows.
    """
    sides = {s: durable(rows) for s, rows in (("a", a), ("b", b))}
    points = {s: durable(rows.select(f"latitude_{s}", f"longitude_{s}").distinct()) for s, rows in sides.items()}
    if math.prod(x.count() for x in points.values()) * 4 > math.prod(x.count() for x in sides.values()):
        return near_points(sides["a"], sides["b"], miles).withColumns(told or {})
    key = lambda rows, s: rows.withColumn("_cell", point_key(F.col(f"latitude_{s}"), F.col(f"longitude_{s}")))
    of = lambda s: (f"latitude_{s}", f"longitude_{s}")
    pairs = near_points(points["a"], points["b"], miles).withColumns(told or {})
    for s in "ab":
        pairs = join_cells(key(pairs, s).drop(*of(s)), key(sides[s], s)).drop("_cell")
    return pairs


def _read_sides(projects: DataFrame, owner_a: str, owner_b: str, threshold: float, include_low: bool) -> list[DataFrame]:
    """Each owner's eligible projects as one side of pairs, with what is read of them."""
    if not owner_a or not owner_b or owner_a == owner_b:
        raise ValueError("two distinct owners are needed")
    if not math.isfinite(threshold) or threshold <= 0:
        raise ValueError("the distance threshold must be positive and finite")
    cores = projects.sparkSession.sparkContext.defaultParallelism
    sides = _sides(eligible_projects(projects, include_low), owner_a, owner_b)
    dealt = (rows.repartition(cores) for rows in sides)  # reading dates and numbers is most of the work of a side, and its bytes are few
    return [rows.withColumns(readings(rows, s) | land_readings(rows, s)) for rows, s in zip(dealt, "ab")]


#: What scores read of one side of a pair.
READ = ["utility", "latitude", "longitude", "_start_date", "_in_service_date", "_bad", "_volts", "_kind"]


#: Projects that one row of `_gathered` holds at most.
GATHERED = 512


def _gathered(rows: DataFrame, side: str, carried: list[str]) -> DataFrame:
    """Rows of one point each that hold up to GATHERED of its projects (_w): _of_a or _of_b, an array of classes with what scores read of them and the carried columns of their projects (_rows_a or _rows_b)."""
    at, rest = ([f"{c}_{side}" for c in x] for x in (READ[1:3], READ[:1] + READ[3:]))
    # -0.0 and 0.0 are one place
    rows = rows.select(F.struct(*carried).alias("_row"), *[(F.col(c) + F.lit(0.0)).alias(c) for c in at], *rest)
    chunk = F.floor((F.row_number().over(Window.partitionBy(*at).orderBy(*rest)) - 1) / F.lit(GATHERED))
    classes = rows.withColumn("_chunk", chunk).groupBy(*at, "_chunk", *rest).agg(F.collect_list("_row").alias(f"_rows_{side}"))
    return classes.groupBy(*at, "_chunk").agg(F.sum(F.size(f"_rows_{side}")).alias("_w"), F.collect_list(F.struct(*rest, f"_rows_{side}")).alias(f"_of_{side}")).drop("_chunk")


@dataclass(frozen=True)
class Classes:
    """Pairs of projects by classes. Projects of one class have the same point and agree in all that scores read, so their pairs have one score, reason and distance.

    sides: the projects of side a and b with what is read of them; miles: the greatest distance of a pair; owners: those of a and b.
    """

    sides: dict[str, DataFrame]
    miles: float
    owners: tuple[str, str]

    @cached_property
    def classed(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        spark = keyed_session(self.sides["a"].sparkSession)
        return {s: _classed(rows, s, spark) for s, rows in self.sides.items()}

    @property
    def a(self) -> DataFrame:
        """The projects of side a with their class."""
        return self.classed["a"][0]

    @property
    def b(self) -> DataFrame:
        return self.classed["b"][0]

    @cached_property
    def pairs(self) -> DataFrame:
        """_class_a, _class_b, _n_a, _n_b (their projects) and what scores tell."""
        met = pairs_by_grid(*(self.classed[s][1] for s in "ab"), self.miles, _told_of_distance()).withColumn("days_apart", _gap())
        return durable(_scores(met).drop(*[f"{c}_{s}" for s in "ab" for c in READ]))

    def rows(self, *columns: str, told: dict[str, Column] | None = None) -> DataFrame:
        """The pairs of projects themselves, with overlap_id and the named columns of their sides, or all of them; told: columns of their distance, computed once for two points.

        What is dealt is projects, gathered by points: a pair of points is met, then its classes are scored, and
        at last their projects take the place of classes, all in one task. So nothing of the size of pairs is written or sorted.
        """
        kept = lambda rows, s: [c for c in rows.columns if c == f"_label_{s}" or (c in columns if columns else not c.startswith("_") or c == f"_land_{s}")]
        met = near_points(*[_gathered(rows, s, kept(rows, s)) for s, rows in self.sides.items()], self.miles, grid.PAIRS_A_KEY * 8).withColumns(_told_of_distance() | (told or {}))
        for s in "ab":
            met = met.drop(*[f"{c}_{s}" for c in READ[1:3]]).select("*", F.inline(f"_of_{s}")).drop(f"_of_{s}")
        pairs = _scores(met.withColumn("days_apart", _gap())).drop(*[f"{c}_{s}" for s in "ab" for c in READ])
        for s in "ab":
            pairs = pairs.select("*", F.inline(f"_rows_{s}")).drop(f"_rows_{s}")
        return pairs.withColumn("overlap_id", F.concat("_label_a", "_label_b")).drop("_label_a", "_label_b")


def _classed(rows: DataFrame, side: str, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """rows with the number of their class (_class_a or _class_b), and the classes with their numbers of rows, as tables of the session given."""
    read, number = [f"{c}_{side}" for c in READ], f"_class_{side}"
    # -0.0 and 0.0 are one place; a text of all columns, as nulls are equal here
    like = F.to_json(F.struct(*[(F.col(c) + F.lit(0.0) if c.startswith(("lat", "lon")) else F.col(c)).alias(c) for c in read]), {"ignoreNullFields": "false"})
    rows = durable(rows.withColumn("_like", like), spark)
    classes = durable(rows.groupBy("_like").agg(*[F.first(c).alias(c) for c in read], F.count("*").alias(f"_n_{side}")).withColumn(number, F.monotonically_increasing_id()))
    return durable(rows.join(classes.select("_like", number), "_like").drop("_like")), classes.drop("_like")


def score_classes(projects: DataFrame, owner_a: str, owner_b: str, threshold: float = 25.0, include_low: bool = True, keep: Callable[[str], Column] | None = None) -> Classes:
    """All pairs within threshold, found and scored by classes of projects; keep: the condition under which a project of side a or b counts."""
    sides = dict(zip("ab", _read_sides(projects, owner_a, owner_b, threshold, include_low)))
    if keep is not None:
        sides = {s: rows.where(keep(s)) for s, rows in sides.items()}
    return Classes(sides, threshold, (owner_a, owner_b))


def scored_pairs(projects: DataFrame, owner_a: str, owner_b: str, threshold: float = 25.0, include_low: bool = True) -> DataFrame:
    """`score_pairs` of `find_pairs`; what pairs of a class share is told once for them."""
    return score_classes(projects, owner_a, owner_b, threshold, include_low).rows()


def find_pairs(projects: DataFrame, owner_a: str, owner_b: str, threshold: float = 25.0, include_low: bool = True) -> DataFrame:
    """All pairs whose unrounded distance is threshold at most, with distance_miles and days_apart, and what is read of each side in columns of names that begin with _."""
    pairs = pairs_by_grid(*_read_sides(projects, owner_a, owner_b, threshold, include_low), threshold, _told_of_distance())
    return pairs.withColumn("days_apart", _gap())


def _distance_text() -> Column:
    return F.when(F.col("distance_miles").isNull(), "distance unavailable").otherwise(F.format_string("distance %.2f miles", "distance_miles"))


def _told_of_distance() -> dict[str, Column]:
    return {"_distance_text": _distance_text(), "distance_score": S.distance_score(F.col("distance_miles"))}


def _gap() -> Column:
    return F.abs(F.datediff("_in_service_date_a", "_in_service_date_b")).cast("long")


def days_apart(given: str | None = None) -> Column:
    """Days between the in-service dates; a number in the column given counts before them."""
    gap = F.abs(F.datediff(T.any_date(F.col("in_service_date_a")), T.any_date(F.col("in_service_date_b")))).cast("long")
    return gap if given is None else F.coalesce(T.number(F.col(given)).cast("long"), gap)


def enrich_pairs(pairs: DataFrame, projects: DataFrame, order: str) -> DataFrame:
    """Adds the project columns that pairs lack, as <name>_a and <name>_b; of equal keys the row last in order wins.

    A column that pairs already has is never touched, blank or not.
    """
    keyed = projects.where(T.filled(F.col("utility")) & T.filled(F.col("project_id")))
    key = [F.trim("utility").alias("utility"), F.trim("project_id").alias("project_id")]
    fields = [c for c in projects.columns if c not in ("utility", "project_id", order)]
    last = keyed.groupBy(*key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("last"))
    for side in ("a", "b"):
        new = [f for f in fields if f"{f}_{side}" not in pairs.columns]
        right = last.select(F.col("utility").alias(f"utility_{side}"), F.col("project_id").alias(f"project_id_{side}"), *(F.col(f"last.{f}").alias(f"{f}_{side}") for f in new))
        pairs = pairs.join(right, [f"utility_{side}", f"project_id_{side}"], "left")
    return pairs


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds the five scores, their total, timeline_overlap, the reason and overlap_id."""
    # read once in a step of their own: each is used many times below
    pairs = pairs.withColumns({name: value for s in "ab" for name, value in readings(pairs, s).items()})
    if "_distance_text" not in pairs.columns:
        pairs = pairs.withColumns(_told_of_distance())
    scored = _scores(pairs.withColumn("overlap_id", F.concat("_label_a", "_label_b")))
    return scored.drop(*[f"_{c}_{s}" for c in ("start_date", "in_service_date", "bad", "volts", "kind", "label") for s in "ab"])


def _scores(pairs: DataFrame) -> DataFrame:
    """Adds the scores, their total, timeline_overlap and the reason to pairs whose sides are read."""
    pairs = pairs.withColumn("_state", _timeline())
    volts, kinds = ({s: F.col(f"_{c}_{s}") for s in "ab"} for c in ("volts", "kind"))
    pairs = pairs.withColumns(
        {
            "timeline_overlap_score": S.timeline_score(F.col("_state")),
            "days_apart_score": S.days_score(F.col("days_apart")),
            "power_voltage_score": S.voltage_score(volts["a"], volts["b"]),
            "project_type_score": S.kind_score(kinds["a"], kinds["b"]),
            "timeline_overlap": S.timeline_flag(F.col("_state")),
        }
    )
    reason = F.concat_ws(
        "; ",
        F.col("_distance_text"),
        S.lookup(S.TIMELINE_REASONS, F.col("_state")),
        F.when(F.col("days_apart").isNull(), "days apart unavailable").otherwise(F.concat(F.col("days_apart").cast("string"), F.lit(" days apart"))),
        S.lookup(S.VOLTAGE_REASONS, F.col("power_voltage_score")),
        S.kind_reason(kinds["a"], kinds["b"]),
    )
    total = sum((F.col(s) for s in SCORES[1:]), F.col(SCORES[0]))
    return pairs.withColumns({"total_score": total, "ranking_reason": reason}).drop("_state", "_distance_text")


def overlap_id() -> Column:
    """A pair's name, of its owners and ids."""
    return F.concat_ws("", "utility_a", F.lit(":"), "project_id_a", F.lit(" | "), "utility_b", F.lit(":"), "project_id_b")


def _timeline() -> Column:
    """The timeline state of a pair whose sides are read."""
    side = lambda s: [F.col(f"utility_{s}"), F.col(f"_start_date_{s}"), F.col(f"_in_service_date_{s}")]
    return S.timeline_state(*side("a"), *side("b"), F.col("_bad_a"), F.col("_bad_b"))


def pairs_of_table(rows: DataFrame, projects: DataFrame | None = None, order: str = "order") -> DataFrame:
    """A pair table of any known column names, with what it lacks from projects (see `enrich_pairs`), ready to be scored.

    Of the names of a column the first that is filled counts. A days_apart that is a
    number counts before the dates; a distance that is none is null.
    """
    for side in "ab":
        rows = rows.withColumns({f"{f}_{side}": T.named(rows, f"{f}_{side}", f"{side} {f.replace('_', ' ')}") for f in ("utility", "project_id")})
    if projects is not None:
        rows = enrich_pairs(rows, projects, order)
    told = {name: T.named(rows, name, *others) for name, others in PAIR_ALIASES.items()}
    pairs = rows.withColumns({name: value for name, value in told.items() if name not in ("distance_miles", "days_apart")})
    pairs = pairs.withColumns({"distance_miles": T.number(told["distance_miles"]), "_given": told["days_apart"]})
    return pairs.withColumn("days_apart", days_apart("_given")).drop("_given")


def rank_table(rows: DataFrame, projects: DataFrame | None = None, mode: str = "score") -> DataFrame:
    """Scores and ranks of a pair table of any known column names."""
    return rank_pairs(score_pairs(pairs_of_table(rows, projects)), mode)


def _placed(rows: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    """rows with the number of their range (_range) and their place in it (_place, from 0), written once."""
    ranged = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    placed = durable(ranged.withColumn("_id", F.monotonically_increasing_id()))
    return placed.select(*rows.columns, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place"))


def rank_rows(rows: DataFrame, order: list[Column], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """Numbers rows from 1 in the given order, however many share a value of its first columns.

    Rows are dealt to ranges of the whole order and sorted there; a row's place in
    its range plus the rows of the ranges before it is its number. The ranges are
    written once, as each evaluation would draw others. Only their sizes meet in
    one place, a row a range. Without a number of ranges, Spark joins small ones.
    """
    placed = _placed(rows, order, ranges)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_place") + 1).cast("long")).drop("_range", "_place", "_start")


_KEYS = {s: [f"utility_{s}", f"project_id_{s}"] for s in "ab"}


def _lead(mode: str) -> dict[str, Column]:
    """The order of ranks before the names of a pair, as rising columns that are never null."""
    if mode not in MODES:
        raise ValueError(f"the ranking mode is one of {MODES}")
    miles, days = (F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))) for c in ("distance_miles", "days_apart"))
    falling = lambda c: -F.col(c)
    if mode == "score":
        return {"_o0": falling("total_score"), "_o1": miles}
    return dict(zip([f"_o{i}" for i in range(6)], (falling("distance_score"), falling("timeline_overlap_score"), days, falling("power_voltage_score"), falling("project_type_score"), miles)))


def rank_pairs(scored: DataFrame, mode: str = "score") -> DataFrame:
    """Adds rank (1 is best) and ranking_mode."""
    lead = _lead(mode)
    return rank_rows(scored, [*lead.values(), *map(F.asc, _KEYS["a"] + _KEYS["b"])]).withColumn("ranking_mode", F.lit(mode))


#: Pairs of one distance lie in one task, or where they are many, in one of so many slots at most.
SLOTS = 64
_AT = ["_far", "_slot"]  # the number of a distance, not itself: Spark normalizes doubles in keys, and then deals rows anew for each step


@dataclass(frozen=True)
class _Begun:
    """What ranks are counted from, all of it dealt by distance (_AT): as the distance is part of the order, pairs that agree in it before names lie in one task.

    pairs: pairs of classes with _start, how many pairs of projects come before all that agree with theirs in the order before names;
    pairs of one _start are ordered by their names alone. a, b: projects (_class_a or _class_b, project_id_a or project_id_b) at each distance that they have.
    """

    pairs: DataFrame
    a: DataFrame
    b: DataFrame
    dealt: Callable[[DataFrame], DataFrame]


def _begun(found: Classes, mode: str) -> _Begun:
    """Sides are copied to each distance they have, a row for a point and a distance; pairs are made from them where they are read, and not written."""
    lead, (rows, classes) = _lead(mode), (dict(zip("ab", x)) for x in zip(*(found.classed[s] for s in "ab")))
    at = {s: [f"latitude_{s}", f"longitude_{s}"] for s in "ab"}
    near = durable(near_points(*[x.groupBy(*at[s]).agg(F.sum(f"_n_{s}").alias(f"_at_{s}")) for s, x in classes.items()], found.miles))
    many = durable(near.groupBy("distance_miles").agg(F.sum(F.col("_at_a") * F.col("_at_b")).alias("_many")).withColumn("_far", F.monotonically_increasing_id()))
    partitions = max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((many.agg(F.sum("_many")).first()[0] or 0) / grid.PAIRS_A_KEY))
    dealt = lambda x: x.repartition(partitions, *_AT)
    slots = many.select("distance_miles", "_far", F.least(F.ceil(F.col("_many") / F.lit(grid.PAIRS_A_KEY)), F.lit(SLOTS)).cast("int").alias("_slots"))
    near = durable(near.drop("_at_a", "_at_b").join(slots, "distance_miles").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1))))
    places = {s: near.select(*_AT, *at[s]).distinct() for s in "ab"}
    met = dealt(near.withColumns(_told_of_distance()).join(classes["a"], at["a"])).join(dealt(places["b"].join(classes["b"], at["b"])), [*_AT, *at["b"]])
    pairs = _scores(met.withColumn("days_apart", _gap())).withColumns(lead).where((F.col("_slots") == 1) | (F.pmod(F.hash(*lead), "_slots") == F.col("_slot")))
    n = pairs.groupBy(*_AT, *lead).agg(F.sum(F.col("_n_a") * F.col("_n_b")).alias("_pairs"))
    ranged = _placed(n, [F.col(c) for c in lead], None)
    within = F.sum("_pairs").over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("_all").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranged.groupBy("_range").agg(F.sum("_pairs").alias("_all")).select("_range", F.coalesce(before, F.lit(0)).alias("_first"))
    starts = ranged.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(ranges), "_range").select(*_AT, *lead, (F.col("_first") + F.col("_within")).alias("_start"))
    members = (dealt(places[s].join(x.select(f"_class_{s}", f"project_id_{s}", *at[s]), at[s]).drop(*at[s])) for s, x in rows.items())
    return _Begun(pairs.join(dealt(durable(starts)), [*_AT, *lead]).drop(*lead), *members, dealt)


def _offsets(begun: _Begun, pairs: DataFrame) -> DataFrame:
    """(_AT, _start, _class_a, project_id_a, _offset): how many of the pairs of the same _start are of projects before that one."""
    n = pairs.groupBy(*_AT, "_start", "_class_a").agg(F.sum("_n_b").alias("_own"))
    before = Window.partitionBy(*_AT, "_start").orderBy("project_id_a").rowsBetween(Window.unboundedPreceding, -1)
    return n.join(begun.a, [*_AT, "_class_a"]).withColumn("_offset", F.coalesce(F.sum("_own").over(before), F.lit(0))).drop("_own")


def _lists(begun: _Begun, pairs: DataFrame, *columns: str) -> DataFrame:
    """(_AT, _start, _class_a, project_id_b, columns of their pairs, _at): the projects with which each of a class makes pairs of that _start, numbered from 1."""
    met = pairs.select(*_AT, "_start", "_class_a", "_class_b", *columns).join(begun.b, [*_AT, "_class_b"])
    return met.withColumn("_at", F.row_number().over(Window.partitionBy(*_AT, "_start", "_class_a").orderBy("project_id_b")))


def _named(found: Classes, rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"utility_{s}": F.lit(owner) for s, owner in zip("ab", found.owners)})


def ranked_pairs(found: Classes, mode: str = "score", *columns: str) -> DataFrame:
    """rank, the names of a pair and columns of it, in the order of `rank_pairs`, without a sort of all pairs.

    A rank is _start, plus the pairs of that _start that projects before a have, plus the place of b in the list that a shares
    with its class. So only these lists are sorted, in the task that holds their distance.
    """
    begun = _begun(found, mode)
    pairs = _lists(begun, begun.pairs, *columns).join(_offsets(begun, begun.pairs), [*_AT, "_start", "_class_a"])
    return _named(found, pairs).select((F.col("_start") + F.col("_offset") + F.col("_at")).alias("rank"), *_KEYS["a"], *_KEYS["b"], *columns)


def best_of_classes(found: Classes) -> DataFrame:
    """`best_pairs` of ranks by score: only the lists and offsets in which a best pair stands are made."""
    begun = _begun(found, "score")
    best = lambda s: begun.pairs.groupBy(f"_class_{s}").agg(F.min(F.struct("_start", *_AT)).alias("_best")).select(f"_class_{s}", "_best.*")
    own, other = (durable(best(s)) for s in "ab")
    used = begun.pairs.join(begun.dealt(own.union(other).select(*_AT, "_start").distinct()), [*_AT, "_start"], "left_semi")
    offsets = begun.dealt(durable(_offsets(begun, used)))
    own, other = begun.dealt(own), begun.dealt(other)
    first = offsets.groupBy(*_AT, "_start", "_class_a").agg(F.min(F.struct("_offset", "project_id_a")).alias("_first"))
    stands = used.join(other, [*_AT, "_start", "_class_b"], "left_semi").join(first, [*_AT, "_start", "_class_a"])
    stands = durable(stands.groupBy(*_AT, "_start", "_class_b").agg(F.min(F.struct("_first", "_class_a")).alias("_best")).select(*_AT, "_start", "_class_b", "_best._first", "_best._class_a"))
    lists_of = [*_AT, "_start", "_class_a"]
    needed = begun.dealt(own.select(*lists_of).union(stands.select(*lists_of)).distinct())
    lists = durable(_lists(begun, used.join(needed, lists_of, "left_semi"), "_class_b"))
    of_a = offsets.join(own, lists_of, "left_semi").join(lists.where("_at = 1"), lists_of)
    of_b = lists.join(stands, [*lists_of, "_class_b"]).withColumns({"_offset": F.col("_first._offset"), "project_id_a": F.col("_first.project_id_a")})
    told = lambda rows, s: _named(found, rows).withColumn("overlap_id", overlap_id()).select(F.col(f"utility_{s}").alias("utility"), F.col(f"project_id_{s}").alias("project_id"), (F.col("_start") + F.col("_offset") + F.col("_at")).alias("rank"), "overlap_id")
    # rows of equal names, if a table has them, are one project
    return told(of_a, "a").unionAll(told(of_b, "b")).groupBy("utility", "project_id").agg(F.min("rank").alias("rank"), F.min_by("overlap_id", "rank").alias("overlap_id"))


def estimate_land(pairs: DataFrame) -> DataFrame:
    """Adds IMPACT: acres and dollars that one shared corridor could save, or why there is no estimate."""
    pairs = pairs.withColumns({name: value for s in "ab" for name, value in land_readings(pairs, s).items()})
    land = lambda name: [F.col(f"_land_{s}.{name}") for s in "ab"]
    missing = land("missing")
    known = missing[0].isNull() & missing[1].isNull()
    value = land("value")
    pairs = pairs.withColumns(
        {
            **{f"state_{s}": state for s, state in zip("ab", land("state"))},
            "shared_miles": F.when(known, F.least(*land("miles"))),
            "row_width_feet": F.when(known, F.least(*land("feet"))),
            "land_value_per_acre": F.when(known, (value[0] + value[1]) / F.lit(2.0)),
        }
    )
    pairs = pairs.withColumn("land_saved_acres", F.col("shared_miles") * F.lit(S.FEET_PER_MILE) * F.col("row_width_feet") / F.lit(S.SQUARE_FEET_PER_ACRE))
    pairs = pairs.withColumn("land_saved_value_usd", F.col("land_saved_acres") * F.col("land_value_per_acre"))
    plain_miles = F.regexp_replace(F.format_string("%.6f", "shared_miles"), r"\.?0+$", "")
    told = F.concat(
        F.lit("If both lines shared one corridor for the shorter line's "), plain_miles, F.lit(" miles, the narrower "), F.col("row_width_feet").cast("string"),
        F.lit("-foot easement would not be needed there: about "), F.format_string("%,.1f", "land_saved_acres"), F.lit(" acres, worth roughly $"),
        F.format_string("%,.0f", "land_saved_value_usd"), F.lit(" at $"), F.format_string("%,.0f", "land_value_per_acre"), F.lit(" an acre."),
    )
    return pairs.withColumn("impact_explanation", F.when(known, told).otherwise(F.concat(F.lit("No estimate: "), F.concat_ws("; ", *missing), F.lit(".")))).drop("_land_a", "_land_b")


def calculate_overlaps(projects: DataFrame, owner_a: str, owner_b: str, threshold: float = 25.0, include_low: bool = True, mode: str = "score") -> DataFrame:
    """The whole analysis: pairs, scores, ranks and land estimates, one row per pair."""
    if mode not in MODES:
        raise ValueError(f"the ranking mode is one of {MODES}")
    ranked = rank_pairs(scored_pairs(projects, owner_a, owner_b, threshold, include_low), mode)
    found = estimate_land(ranked)
    fields = [f"{f}_{s}" for s in "ab" for f in PAIR_FIELDS if f"{f}_{s}" in found.columns]
    return found.select("rank", "overlap_id", "distance_miles", "days_apart", "timeline_overlap", *fields, *SCORES, "total_score", "ranking_reason", "ranking_mode", *IMPACT)


def both_sides(pairs: DataFrame, *columns: str) -> DataFrame:
    """Each pair twice, once for each of its projects: utility, project_id and the named columns."""
    sides = F.explode(F.array(*[F.struct(F.col(f"utility_{s}").alias("utility"), F.col(f"project_id_{s}").alias("project_id")) for s in "ab"]))
    return pairs.select(sides.alias("_p"), *columns).select("_p.utility", "_p.project_id", *columns)


def best_pairs(ranked: DataFrame) -> DataFrame:
    """Each project's pair of the best rank: utility, project_id, rank, overlap_id."""
    return both_sides(ranked, "rank", "overlap_id").groupBy("utility", "project_id").agg(F.min("rank").alias("rank"), F.min_by("overlap_id", "rank").alias("overlap_id"))


def overlap_kpis(projects: DataFrame, owner_a: str, owner_b: str, threshold: float = 25.0, include_low: bool = True) -> DataFrame:
    """One row: source_projects, eligible_centers, pairs, overlapping_windows, projects_with_pairs.

    Projects of one point and one build window count as one row with their number.
    """
    own = projects = durable(projects.where(F.col("utility").isin(owner_a, owner_b)))
    sources = own.agg(F.count("*").alias("source_projects"))
    sides = _read_sides(projects, owner_a, owner_b, threshold, include_low)
    centers = eligible_projects(own, include_low).agg(F.count("*").alias("eligible_centers"))
    window = ("utility", "latitude", "longitude", "_start_date", "_in_service_date", "_bad")
    like = [rows.groupBy(*[f"{c}_{s}" for c in window]).agg(F.count("*").alias(f"_n_{s}")) for rows, s in zip(sides, "ab")]
    n = F.col("_n_a") * F.col("_n_b")
    found = pairs_by_grid(*like, threshold).agg(F.coalesce(F.sum(n), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.when(_timeline() == "overlap", n)), F.lit(0)).alias("overlapping_windows"))
    with_pairs = projects_in_pairs(projects, owner_a, owner_b, threshold, include_low).agg(F.count("*").alias("projects_with_pairs"))
    return sources.join(F.broadcast(centers)).join(F.broadcast(found)).join(F.broadcast(with_pairs))  # one row each


def projects_in_pairs(projects: DataFrame, owner_a: str, owner_b: str, threshold: float = 25.0, include_low: bool = True) -> DataFrame:
    """The distinct (utility, project_id) that have a pair: those at points with one of the other owner's near, without the pairs of their rows."""
    sides = {s: durable(rows.select(*_KEYS[s], f"latitude_{s}", f"longitude_{s}")) for s, rows in zip("ab", _read_sides(projects, owner_a, owner_b, threshold, include_low))}
    points = [rows.select(f"latitude_{s}", f"longitude_{s}").distinct() for s, rows in sides.items()]
    near = durable(near_points(*points, threshold).select("latitude_a", "longitude_a", "latitude_b", "longitude_b"))
    at = {s: rows.join(near.select(f"latitude_{s}", f"longitude_{s}").distinct(), [f"latitude_{s}", f"longitude_{s}"], "left_semi") for s, rows in sides.items()}
    return at["a"].select(F.col("utility_a").alias("utility"), F.col("project_id_a").alias("project_id")).unionAll(at["b"].select("utility_b", "project_id_b")).distinct()


def projects_without_pair(projects: DataFrame, paired: DataFrame) -> DataFrame:
    """projects but those in paired (utility, project_id)."""
    return projects.join(paired, ["utility", "project_id"], "left_anti")
