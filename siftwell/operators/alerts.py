"""Alert documents as typed columns: path nodes, primary locations, batch keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, whole_number
from ..schemas import NODE, PRIMARY_ROLES


def path_nodes() -> Column:
    """Nodes of `path`, then the allocation, then those of all `paths`; nulls dropped."""
    none = F.array().cast(f"array<{NODE}>")
    others = F.flatten(F.transform(F.coalesce("paths", F.array().cast(f"array<struct<path: array<{NODE}>>>")), lambda p: F.coalesce(p["path"], none)))
    return F.array_compact(F.concat(F.coalesce("path", none), F.array("allocation"), others))


def location(loc: Column) -> Column:
    """{fl, ln, cl} of a location; a missing or empty column is 0, numbers that don't convert or are too large are null."""
    column = F.coalesce(F.nullif(loc["column"].cast("string"), F.lit("")), F.lit("0"))
    return F.when(loc.isNotNull(), F.struct(loc["file"].alias("fl"), whole_number(loc["line"].cast("string")).alias("ln"), whole_number(column).alias("cl")))


def path_place() -> Column:
    """The location of the last node of the first preferred role that has one, in one pass over the nodes."""
    roles = F.array(*map(F.lit, PRIMARY_ROLES))
    ranked = F.transform(path_nodes(), lambda n, i: F.struct((-F.array_position(roles, n["role"])).alias("role"), i.alias("i"), n["location"].alias("location")))
    return F.array_max(F.filter(ranked, lambda x: (x["role"] < 0) & x["location"].isNotNull()))["location"]


def access_place() -> Column:
    return F.col("access.location")


@dataclass(frozen=True)
class Behaviour:
    """What depends on the category: builders of Columns (the place as file, line, column), and the hint of the prompt."""

    primary_location: Callable[[], Column]
    batch_key: Callable[[], Column]
    hint: str


def _key(*parts: Column) -> Column:
    """Text that orders like the printed tuple of category and parts; null if a part is null."""
    shown = [F.concat(F.lit("'"), F.col("category"), F.lit("'"))]
    for p, quoted in parts:
        shown.append(F.concat(F.lit("'"), p, F.lit("'")) if quoted else p.cast("string"))
    text = F.concat(F.lit("("), shown[0])
    for s in shown[1:]:
        text = F.concat(text, F.lit(", "), s)
    return F.concat(text, F.lit(")"))


def _alone() -> Column:
    return _key((F.col("alert_id"), True))


def _by_free() -> Column:
    at = F.get(F.filter("path", lambda n: n["role"] == "free"), F.lit(0))["location"]
    return let(at, lambda x: _key((x["file"], True), (x["line"], False)))


def _by_memory() -> Column:
    memory = F.col("evidence.memory_object")
    return _key((F.coalesce(F.nullif(memory["type"], F.lit("")), memory["descriptor"]), True))


def _by_access() -> Column:
    return _key((F.col("access.kind"), True))


#: Hints of the prompts.
PATH_HINT = "`path` is a pruned SVFG value-flow witness; branch entries carry the required control outcome."
LEAK_HINT = "`paths` are possible safe freeing witnesses and `leak_condition` is the complement that constitutes danger."
RANGE_HINT = "`range_analysis` is the ordered value-range derivation from variables and guards through the final bounds comparison."

BEHAVIOURS: dict[str, Behaviour] = {
    "MEMORY_LEAK": Behaviour(path_place, _alone, LEAK_HINT),
    "DOUBLE_FREE": Behaviour(path_place, _alone, PATH_HINT),
    "USE_AFTER_FREE": Behaviour(path_place, _by_free, PATH_HINT),
    "UNINIT_USE": Behaviour(path_place, _by_memory, PATH_HINT),
    "BUFFER_OVERFLOW": Behaviour(access_place, _by_access, RANGE_HINT),
}


def by_category(choose: Callable[[Behaviour], Column], behaviours: dict[str, Behaviour] | None = None) -> Column:
    """A column chosen by category; null for an unknown one."""
    out = F.lit(None)
    groups: dict[Callable, list[str]] = {}
    for name, b in (behaviours or BEHAVIOURS).items():
        groups.setdefault(choose(b), []).append(name)
    for value, names in groups.items():
        column = value() if callable(value) else F.lit(value)
        out = F.when(F.col("category").isin(names), column).otherwise(out)
    return out


def keyed(alerts: DataFrame, behaviours: dict[str, Behaviour] | None = None) -> DataFrame:
    """alerts with primary location (fl, ln, cl), source_location, batch_key and hint."""
    rows = alerts.withColumns({
        "_place": by_category(lambda b: b.primary_location, behaviours),
        "batch_key": by_category(lambda b: b.batch_key, behaviours),
        "hint": by_category(lambda b: b.hint, behaviours),
    })
    # let: a filter on loc is pushed below this projection and would repeat _place at each use
    return rows.withColumn("loc", let(F.col("_place"), location)).drop("_place").withColumn("source_location", F.concat("loc.fl", F.lit(":"), "loc.ln"))


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable alerts, those without a usable location or a batch key, with the reason)."""

    def misplaced(loc: Column) -> Column:
        return F.when(loc.isNull(), "no primary location").when(loc["fl"].isNull() | loc["ln"].isNull() | loc["cl"].isNull(), "unusable location")

    reason = F.coalesce(F.when(F.col("hint").isNull(), "unknown category"), let(F.col("loc"), misplaced), F.when(F.col("batch_key").isNull(), "no batch key"))
    marked = rows.withColumn("problem", reason)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")


def pending(alerts: DataFrame) -> DataFrame:
    return alerts.where("classification is null")


def stats(alerts: DataFrame) -> DataFrame:
    """Alerts per category and in all, classified and pending: one pass with grouping sets."""
    rows = alerts.groupingSets([["category"], []], "category").agg(F.grouping("category").alias("_all"), F.count(F.lit(1)).alias("n_alerts"), F.count("classification").alias("n_classified"))
    return rows.select(F.when(F.col("_all") == 1, "*").otherwise(F.col("category")).alias("category"), "n_alerts", "n_classified", (F.col("n_alerts") - F.col("n_classified")).alias("n_pending"))
