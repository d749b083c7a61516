"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are grouped by the set of sources that hold them. A flow carries words from these
groups to the sources' quotas; each further copy of a group's words costs more than the last, so
words are repeated only where a quota can't be met otherwise. What a group gives is then turned
into documents: whole copies of all, and a seeded choice for the rest: documents in the order of
their codes, up to the one whose middle lies within. The place where a group's choice ends is found
by sums per leading digits of the codes, level by level, so no group is ever ordered as a whole.

The flow runs on the driver over membership patterns and sources, which are names given by people
and don't grow with the rows; more than PATTERNS patterns are refused. A null or empty membership
counts as a source of its own, last in order; null texts, empty ones and blank ones have size 0 and
give nothing; a very long text counts whole. A code depends on seed, id and text; rows that are
alike in both tie and are told apart by their place in the written table, as many taken as the
quota needs. An empty table gives an empty mix. Other columns than those carried are dropped.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, word_count

#: No document is taken more often than this.
COPIES = 3
#: Digits of a code, in base 16, that each of the first levels of the choice goes by.
DIGITS = (3, 3)
#: The most membership patterns that a flow is made for.
PATTERNS = 100_000
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)


def targets(sizes: dict, weights: dict, total: int, copies: int = COPIES) -> dict[object, Fraction]:
    """Share total by weight; no source above `copies` times its size, the excess shared again."""
    out: dict[object, Fraction] = {}
    left, free = Fraction(total), dict.fromkeys(sizes)
    while free:
        share = left / sum(weights[s] for s in free)
        full = [s for s in free if weights[s] * share > copies * sizes[s]]
        if not full:
            return out | {s: weights[s] * share for s in free}
        for s in full:
            out[s] = Fraction(copies * sizes[s])
            left -= out[s]
            del free[s]
    return out


def min_cost_flow(groups: dict[tuple, int], quotas: dict[object, int], copies: int = COPIES) -> dict[tuple, dict[object, int]]:
    """Words that each group gives to each of its sources. The k-th copy of a word costs k*k; successive cheapest paths.

    Nodes are groups and sources; a group's copies are parallel arcs from the start.
    """
    names: dict[object, int] = {"start": 0, "end": 1}
    heads: list[list[int]] = [[], []]
    arcs: list[list[int]] = []  # [to, room, cost]; arc ^ 1 goes back

    def node(key: object) -> int:
        if key not in names:
            names[key] = len(heads)
            heads.append([])
        return names[key]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            heads[x].append(len(arcs))
            arcs.append([y, r, c])

    for group, size in groups.items():
        g = node(("group", group))
        for k in range(1, copies + 1):
            arc(0, g, size, k * k)
        for source in group:
            arc(g, node(("source", source)), copies * size, 0)
    for source, quota in quotas.items():
        arc(node(("source", source)), 1, quota, 0)
    height = [0] * len(heads)
    while True:
        far, via, heap = [None] * len(heads), [-1] * len(heads), [(0, 0)]
        far[0] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in heads[x]:
                y, room, cost = arcs[e]
                new = d + cost + height[x] - height[y]
                if room and (far[y] is None or new < far[y]):
                    far[y], via[y] = new, e
                    heapq.heappush(heap, (new, y))
        if far[1] is None:
            break
        height = [h + (d if d is not None else 0) for h, d in zip(height, far)]
        path, x = [], 1
        while x:
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        room = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= room
            arcs[e ^ 1][1] += room
    return {g: {s: arcs[e ^ 1][1] for s in g for e in heads[names["group", g]] if e % 2 == 0 and arcs[e][0] == names["source", s]} for g in groups}


def _ends(rows: DataFrame, rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Where each group's choice ends: rows (_group, keys, size) in the order of keys, room words. Per level i, `_last{i}` is the last key taken whole and `_edge{i}` the one taken in part."""
    ends, edge, inside = rooms.select("_group"), rooms.select("_group", F.col("_rest").alias("_room")), rows
    for i, key in enumerate(keys):
        sums = inside.groupBy("_group", key).agg(F.sum("size").alias("_sum")).join(edge.select("_group", "_room"), "_group")
        sums = sums.withColumn("_upto", F.sum("_sum").over(W.partitionBy("_group").orderBy(key)))
        taken = F.col("_upto") <= F.col("_room") if i < len(keys) - 1 else 2 * F.col("_upto") - F.col("_sum") <= 2 * F.col("_room")
        part = (F.col("_upto") > F.col("_room")) & (F.col("_upto") - F.col("_sum") < F.col("_room"))
        room = F.col("_room") - F.col("_upto") + F.col("_sum")
        level = saved(sums.groupBy("_group").agg(F.max(F.when(taken, F.col(key))).alias(f"_last{i}"), F.max(F.when(part, F.struct(F.col(key), room.alias("_room")))).alias("_part")))
        ends = ends.join(level.select("_group", f"_last{i}", F.col(f"_part.{key}").alias(f"_edge{i}")), "_group", "left")
        edge = level.where("_part is not null").select("_group", F.col(f"_part.{key}").alias(key), "_part._room")
        inside = saved(inside.join(edge.select("_group", key), ["_group", key])) if i < len(keys) - 1 else inside
    return saved(ends)


def mix(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), sources: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """The carried columns with size, source_size, target and taken. `sources` is a name or an array of names.

    source_size and target are those of the document's first source. What is used twice is written
    first, so reruns and retries agree.
    """
    spark = docs.sparkSession
    many = dict(docs.dtypes)[sources].startswith("array")
    names = F.array_sort(F.array_distinct(sources)) if many else F.array(F.col(sources))
    names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(None).cast("string")))
    code = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    rows = saved(docs.select(F.struct(*carry).alias("_row"), names.alias("_members"), word_count(F.col("text")).alias("size"), code.alias("_code"), F.monotonically_increasing_id().alias("_place")))
    found = rows.groupBy("_members").agg(F.sum("size")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} sets of sources")
    groups = {tuple(r[0]): r[1] for r in found}
    order = sorted({s for g in groups for s in g}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for g, n in groups.items() if s in g) for s in order}
    share = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, sum(groups.values()), copies)
    flow = min_cost_flow(groups, {s: round(share[s]) for s in order}, copies)
    given = {g: sum(to.values()) for g, to in flow.items()}
    plan = [(list(g), i, sizes[g[0]], float(share[g[0]]), given[g] // n if n else 0, given[g] % n if n else 0) for i, (g, n) in enumerate(groups.items())]
    plan = spark.createDataFrame(plan, "_members array<string>, _group int, source_size long, target double, _whole long, _rest long")
    rows = rows.join(plan, "_members").drop("_members")
    digits = [F.substring("_code", 1 + sum(DIGITS[:i]), n).alias(f"_key{i}") for i, n in enumerate(DIGITS)]
    keys = [*digits, F.col("_code").alias("_key2"), F.shiftright("_place", 33).alias("_key3"), F.col("_place").alias("_key4")]
    ends = _ends(rows.select("_group", "size", *keys), plan.select("_group", "_rest"), [f"_key{i}" for i in range(len(keys))])
    more = F.lit(False)
    for i in reversed(range(len(keys))):
        more = F.coalesce(F.col(f"_key{i}") <= F.col(f"_last{i}"), F.lit(False)) | (F.coalesce(F.col(f"_key{i}") == F.col(f"_edge{i}"), F.lit(False)) & more)
    taken = F.col("size") * (F.col("_whole") + more.cast("long"))
    return rows.select("*", *keys).join(ends, "_group").select("_row.*", "size", "source_size", "target", taken.alias("taken"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
