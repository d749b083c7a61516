"""Quality rules: base rules, then robust multivariate outliers.

Each document gets a vector of transformed statistics in whole steps of 1/SCALE. For every language
and source a minimum-covariance-determinant fit is made: the half of the documents whose covariance
has the least determinant. From several starts (medians and absolute deviations, mean and covariance
of all, seeded elemental sets) concentration steps move to the mean and covariance of the documents
with the smallest distances; after BEGIN steps the BEST starts of least determinant go on until no
step lowers any determinant, however many that takes, and the least one is the fit. Half of a group is the least share
there is, so that a group of copies of up to half a fit can't take it over. Documents beyond a
chi-square bound by their Mahalanobis distance go.

A fit needs `least` documents: five a dimension by default, below which half of a group says little
about a covariance. Smaller groups use the fit of their language, then that of all documents.
Covariances have a floor added (FLOORS), so that constant statistics don't reject by a hair. Sums are
of whole numbers, and where documents tie for the last places of a half (distances equal to 1/BINS of
their logarithm), each counts with the missing share; so reruns agree to the last bit. Vectors are
grouped with their counts before anything is joined, and dealt over tasks by their hash, not by group.

Null, empty and blank texts have zero statistics and fail the base rules; very long ones are handled
by themselves. A null language or source is a group of its own. Repeated rows count as often as they
occur and get equal results. Other columns are dropped. An empty table gives an empty result.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, saved

#: Base rules: fewest words, and the largest percentage of words in repeated windows of so many words.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Steps of a statistic; documents of a fit at least; steps of all starts, and starts that go on.
SCALE, LEAST, BEGIN, BEST = 256, 20, 2, 2
#: Elemental sets that starts are made of, and parts that a group's vectors are dealt over.
DRAWS, PARTS = 3, 16
#: Standard deviations that a fit never goes below, so that constant statistics reject nothing by a hair.
FLOORS = (0.15, 0.05, 0.10, 0.10)
#: A clean document is rejected once in so many.
ODDS = 100_000
SYMBOLS = "#*$%&|<>"
#: Distances fall into bins of 1/BINS of their logarithm.
BINS = 1024


def chi_square(x: float, k: int) -> float:
    """The chi-square distribution for even k."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi_square_at(share: float, k: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < share else (low, mid)
    return high


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of `width` words found twice or more in the array.

    Short hashes only tell that no window can repeat; where some are equal, SHA-256 of the windows decides.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width))))

    def names(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.size(w) - (width - 1)), lambda x, i: F.sha2(F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, width))), 256))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, i: F.coalesce(x["g"] == F.get(s, i + 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, i - 1)["g"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def count(g: Column) -> Column:
        ordered = _let(names(words), lambda n: F.sort_array(F.transform(n, lambda x, i: F.struct(x.alias("g"), i.alias("i")))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), _let(_let(ordered, places), covered)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > width, _let(_let(hashes, windows), count)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(_row with the carried columns, doc_id, lang, source, the base counts, base_failed, v0..v3)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeats")))
    lines = _let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *carry).alias("_row"),
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        words.alias("_words"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
    )
    rows = rows.select("_row", "doc_id", "lang", "source", F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_words.repeats").alias("n_repeat_words"))
    n, failed = F.greatest(F.col("n_words"), F.lit(1)), (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    vector = [F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return rows.select("*", failed.alias("base_failed"), *(F.round(v * SCALE).cast("long").alias(f"v{i}") for i, v in enumerate(vector)))


P = len(FLOORS)
V = [f"v{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
FIT = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in PAIRS]
#: What makes a covariance of half a normal sample consistent.
GROW = 0.5 / chi_square(chi_square_at(0.5, P), P + 2)


def _minus(value: str, products: list[str]) -> str:
    return " - ".join([value, *products])


def _factor(cov: dict[tuple[int, int], str], rows: DataFrame) -> DataFrame:
    """Columns l00, l10, l11, ...: the Cholesky factor of a covariance, one row per group; columns of one select that refer to those before them."""
    steps = []
    for j in range(P):
        inner = _minus(f"c{j}{j}", [f"l{j}{k} * l{j}{k}" for k in range(j)])
        steps.append(f"sqrt(greatest({inner}, 1e-9D)) AS l{j}{j}")
        steps += [f"({_minus(f'c{i}{j}', [f'l{i}{k} * l{j}{k}' for k in range(j)])}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P)]
    return rows.selectExpr("*", *(f"{c} AS c{i}{j}" for (i, j), c in cov.items()), *steps)


def distance(rows: DataFrame, name: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    steps = [f"({_minus(f'v{i} / {SCALE}D - m{i}', [f'l{i}{k} * _z{k}' for k in range(i)])}) / l{i}{i} AS _z{i}" for i in range(P)]
    total = " + ".join(f"_z{i} * _z{i}" for i in range(P))
    return rows.selectExpr("*", *steps, f"{total} AS {name}").drop(*(f"_z{i}" for i in range(P)))


def _by_group(rows: DataFrame, small: DataFrame, *more: str) -> DataFrame:
    """rows joined with the rows of their group, both dealt over PARTS parts of it."""
    return rows.join(small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["g", "_part", *more])


def _fit(sums: DataFrame, grow: float) -> DataFrame:
    """(g, s, centre m, factor l, det) from weights k, sums s0.. and sums of products p00..; det is that of the covariance."""
    floor = {(i, i): f" + {FLOORS[i] ** 2}D" for i in range(P)}
    cov = {(i, j): f"{grow}D * (p{i}{j} / k - s{i} / k * (s{j} / k)) / {SCALE**2}D" + floor.get((i, j), "") for i, j in PAIRS}
    return _scored(_factor(cov, sums.selectExpr("*", *(f"s{i} / k / {SCALE}D AS m{i}" for i in range(P)))))


def _scored(fit: DataFrame) -> DataFrame:
    det = " * ".join(f"l{i}{i} * l{i}{i}" for i in range(P))
    return fit.selectExpr("g", "s", *FIT, f"{det} AS det")


SUMS = ["k", *(f"s{i}" for i in range(P)), *(f"p{i}{j}" for i, j in PAIRS)]


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Weights, sums and sums of products of vectors with weight w."""
    return rows.groupBy(*by).agg(*(F.expr(f"sum({x}) AS {c}") for c, x in zip(SUMS, ["w", *(f"w * {v}" for v in V), *(f"w * {V[i]} * {V[j]}" for i, j in PAIRS)])))


def _starts(vectors: DataFrame) -> DataFrame:
    """A first fit per group and start s."""
    middle = saved(vectors.groupBy("g").agg(*(F.expr(f"percentile({v}, 0.5, w)").alias(f"q{i}") for i, v in enumerate(V))))
    spread = _by_group(vectors, middle).groupBy("g").agg(*(F.expr(f"percentile(abs({v} - q{i}), 0.5, w)").alias(f"a{i}") for i, v in enumerate(V)), *(F.max(f"q{i}").alias(f"q{i}") for i in range(P)))
    diagonal = {(i, j): f"pow(greatest(a{i} * 1.4826D / {SCALE}D, {FLOORS[i]}D), 2)" if i == j else "0D" for i, j in PAIRS}
    medians = _scored(_factor(diagonal, spread.selectExpr("*", "0 AS s", *(f"q{i} / {SCALE}D AS m{i}" for i in range(P)))))
    whole = _fit(_sums(vectors, "g").withColumn("s", F.lit(1)), 1.0)
    # an elemental set: for each of P + 1 seeded orders the vector that comes first
    drawn = vectors.groupBy("g").agg(*(F.min(F.struct(F.xxhash64(F.lit(k), *V), *V)).alias(f"e{k}") for k in range(DRAWS * (P + 1))))
    sets = F.explode(F.array(*(F.struct(F.lit(2 + n).alias("s"), F.array(*(f"e{n * (P + 1) + k}" for k in range(P + 1))).alias("e")) for n in range(DRAWS))))
    elements = drawn.select("g", sets.alias("x")).select("g", "x.s", F.explode("x.e").alias("e")).select("g", "s", *(F.col(f"e.{v}").alias(v) for v in V), F.lit(1).cast("long").alias("w"))
    return saved(medians.unionByName(whole).unionByName(_fit(_sums(elements, "g", "s"), 1.0)))


def _step(vectors: DataFrame, fit: DataFrame) -> DataFrame:
    """The fit of each group's and start's nearest documents, half of the group by weight.

    One pass: sums per bin of the distance, added up from the nearest bin on; of the bin where half is reached only the missing share counts.
    """
    near = distance(_by_group(vectors, fit)).selectExpr("g", "s", "n", f"CAST(floor({BINS} * log1p(d2)) AS int) AS bin", *V, "w")
    nearest = "OVER (PARTITION BY g, s ORDER BY bin)"
    upto = _sums(near, "g", "s", "n", "bin").selectExpr(f"least((n + {P + 1}) div 2, n) AS h", "g", "s", *SUMS, *(f"sum({c}) {nearest} AS {c}_upto" for c in SUMS))
    cut = upto.where("k_upto >= h AND k_upto - k < h").withColumn("share", F.expr("(h - (k_upto - k)) / k"))
    return _fit(cut.selectExpr("g", "s", *(f"{c}_upto - {c} + {c} * share AS {c}" for c in SUMS)), GROW)


def _best(fit: DataFrame, n: int) -> DataFrame:
    """The n starts of least determinant of each group, which has a handful."""
    return fit.withColumn("_r", F.row_number().over(W.partitionBy("g").orderBy("det", "s"))).where(F.col("_r") <= n).drop("_r")


def choices(counted: DataFrame, least: int) -> DataFrame:
    """(_lang, _source, g): the group whose fit judges a language and source."""
    sizes = counted.groupBy("_lang", "_source").agg(F.sum("w").alias("n2"))
    langs = sizes.groupBy("_lang").agg(F.sum("n2").alias("n1"))
    own, lang, every = _names()
    return sizes.join(langs, "_lang").select("_lang", "_source", F.when(F.col("n2") >= least, own).when(F.col("n1") >= least, lang).otherwise(every).alias("g"))


def fits(vectors: DataFrame) -> DataFrame:
    """(g, centre m, factor l, det): the fit of each group of vectors (g, _part, v0..v3, weight w, n: documents of the group)."""
    fit = _starts(vectors)
    for k in range(1, BEGIN + 1):
        fit = _step(vectors, fit)
        fit = saved(_best(fit, BEST) if k == BEGIN else fit)
    moving = True
    while moving:  # ends, as only lower determinants are taken and floors keep them from falling below a bound
        lower = _step(vectors, fit).select("g", "s", F.struct("det", *FIT).alias("new"))
        both = saved(fit.join(lower, ["g", "s"]).withColumn("moved", F.col("new.det") < F.col("det") * (1 - 1e-9)))
        fit = both.selectExpr("g", "s", *(f"IF(moved, new.{c}, {c}) AS {c}" for c in (*FIT, "det")))
        moving = both.where("moved").limit(1).count() > 0
    return _best(fit, 1).drop("s")


def _names() -> tuple[Column, Column, Column]:
    """Names of a document's groups, from the narrowest."""
    return F.to_json(F.array("_lang", "_source")), F.to_json(F.array("_lang")), F.lit("[]")


def grouped(stats: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(vectors of the groups that are asked for, choices)."""
    lang, source = _groups()
    counted = saved(stats.where("not base_failed").groupBy(lang.alias("_lang"), source.alias("_source"), *V).agg(F.count(F.lit(1)).alias("w")))
    chosen = saved(choices(counted, least))
    members = counted.select(F.explode(F.array(*_names())).alias("g"), *V, "w").join(chosen.select("g").distinct(), "g", "left_semi")
    members = saved(members.groupBy("g", *V).agg(F.sum("w").alias("w")).withColumn("_part", F.pmod(F.xxhash64(*V), F.lit(PARTS)).cast("int")))
    sizes = members.groupBy("g").agg(F.sum("w").alias("n"))
    return saved(_by_group(members, sizes)), chosen


def _groups() -> tuple[Column, Column]:
    """Language and source as text that tells null from any name."""
    return tuple(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source"))


def judge(docs: DataFrame, carry: tuple[str, ...] = (), least: int = LEAST) -> DataFrame:
    """(_row with the carried columns, doc_id, base counts, base_failed, distance, kept) for each row."""
    stats = saved(statistics(docs, carry))
    vectors, chosen = grouped(stats, least)
    chosen = saved(chosen.join(fits(vectors), "g").select("_lang", "_source", *FIT))
    lang, source = _groups()
    rows = distance(stats.withColumns({"_lang": lang, "_source": source}).join(chosen, ["_lang", "_source"], "left"), "distance")
    bound = chi_square_at(1 - 1 / ODDS, P)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= bound, F.lit(True)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
