"""Line dedup: drops lines that equal an earlier line of the corpus or lie one edit from it.

Only lines that hold a word take part: for equality from `shortest` code points on, for an edit
from `near_from` on (in shorter ones an edit changes the meaning); the rest stays as it is. An
edit inserts, deletes or replaces one code point. A line goes if an earlier line (by document,
then place) is equal or one edit away, whether or not that line itself stays.

Equal lines are those of one SHA-256. Of the distinct lines, those that may be near another are
narrowed first: a line is cut into BLOCKS blocks; an edit lies within one of them, so two lines one
edit apart agree on all others: each line emits hashed keys of itself without one block. Where
different lines share a key, their blocks are cut again in the same way, level by level until a
block is short, and only what still agrees emits its full deletion neighbourhood: the block
without each code point. Equal variants are joined, smallest places per variant are enough, no
pairs are made; the edit distance of what is found is then verified on the lines themselves.

Null texts are empty. A null id comes after all others. Rows that repeat an id and its text are
one document and get the same result. Very long lines cost levels, not the square of their length.
An empty table gives an empty result. Columns other than those carried are dropped. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, saved

#: Code points of the shortest line compared by equality and by an edit.
SHORTEST, NEAR_FROM = 1, 16
#: Blocks of a line and of a block, and the width of blocks that aren't cut any further.
BLOCKS, FINER, SHORT = 3, 8, 24
LAST = (1 << 63) - 1


def _identified_columns() -> list[Column]:
    """d and h tell documents apart and order them; and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("h"), text.alias("text")]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def short_keys(text: Column, b: int) -> Column:
    """Array of 64-bit hashes of the text without one of its blocks, to rule lines out; without a lambda, so that it is compiled."""
    n = F.char_length(text)

    def keys(s: Column) -> Column:
        return F.array(*(F.xxhash64(s, F.lit(q), text.substr(F.lit(1), q * s), F.right(text, (b - 1 - q) * s)) for q in range(b)))

    return F.when(n % b == 0, F.concat(keys(F.floor(n / b).cast("int")), keys(F.floor((n - 1) / b).cast("int")))).otherwise(keys(F.floor(n / b).cast("int")))


def blocks(text: Column, scope: Column, b: int) -> Column:
    """Array of (key, width, before, block): SHA-256 of the text without the block, the blocks' width, code points before the block, and the block."""
    n = F.char_length(text)

    def one(s: Column, q: Column) -> Column:
        before, after = q * s, (b - 1 - q) * s
        around = (text.substr(F.lit(1), before), text.substr(n - after + 1, after))
        key = F.unhex(F.sha2(F.concat_ws(":", F.hex(scope), s.cast("string"), q.cast("string"), *around), 256))
        return F.struct(key.alias("key"), s.alias("width"), before.alias("before"), text.substr(before + 1, n - before - after).alias("block"))

    widths = F.array_distinct(F.array(F.floor(n / b).cast("int"), F.floor((n - 1) / b).cast("int")))
    return F.flatten(F.transform(widths, lambda s: F.transform(F.sequence(F.lit(0), F.when(s == 0, 0).otherwise(b - 1)), lambda q: one(s, q))))


def neighbourhood(block: Column, key: Column) -> Column:
    """Array of (variant, role): 0 with one place replaced, 1 the block itself, 2 the block without one place."""
    n = F.char_length(block)

    def variant(*parts: Column) -> Column:
        return F.unhex(F.sha2(F.concat_ws(":", F.hex(key), *parts), 256)).alias("variant")

    def at(i: Column) -> Column:
        rest = F.concat(block.substr(F.lit(1), i), block.substr(i + 2, n))
        return F.array(F.struct(variant(i.cast("string"), rest), F.lit(0).alias("role")), F.struct(variant(F.lit(""), rest), F.lit(2).alias("role")))

    whole = F.array(F.struct(variant(F.lit(""), block), F.lit(1).alias("role")))
    each = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)))
    return F.concat(whole, F.coalesce(each, F.array().cast("array<struct<variant:binary,role:int>>")))


def shared_only(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs with different lines (id)."""
    several = rows.groupBy(key).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo < _hi").select(key)
    return rows.join(several, key, "left_semi")


def cut(rows: DataFrame, text: str, scope: Column, start: Column, b: int) -> DataFrame:
    """(id, at, key, width, start, block) of the blocks of a column that another line may share all but; start counts from the line's."""
    pieces = rows.select("id", "at", start.alias("_start"), F.explode(blocks(F.col(text), scope, b)).alias("x"))
    return shared_only(pieces.select("id", "at", "x.key", "x.width", (F.col("_start") + F.col("x.before")).alias("start"), "x.block"), "key")


def one_edit_apart(line: Column, other: Column, start: Column, size: Column, other_size: Column) -> Column:
    """Whether two lines differ by one edit at most, all of it in the blocks at start; an edit distance of long lines would cost their square."""
    around = (line.substr(F.lit(1), start) == other.substr(F.lit(1), start)) & (line.substr(start + size + 1, F.char_length(line)) == other.substr(start + other_size + 1, F.char_length(other)))
    return around & F.levenshtein(line.substr(start + 1, size), other.substr(start + 1, other_size), 1).between(0, 1)


def near_lines(firsts: DataFrame) -> DataFrame:
    """(d, h, ln) of those of the distinct lines (id, at, line) that have an earlier one one edit away."""
    none, zero = F.lit(""), F.lit(0)
    keys = saved(firsts.select("id", F.explode(short_keys(F.col("line"), BLOCKS)).alias("key")))
    suspects = saved(firsts.join(shared_only(keys, "key").select("id").distinct(), "id"))
    rows = saved(cut(suspects, "line", none, zero, BLOCKS))
    short = rows.where(F.col("width") <= SHORT)
    while (rows := rows.where(F.col("width") > SHORT)).limit(1).count():
        rows = saved(cut(rows, "block", F.col("key"), F.col("start"), FINER))
        short = short.union(rows.where(F.col("width") <= SHORT))
    variants = short.select("id", "at", "start", F.char_length("block").alias("size"), F.explode(neighbourhood(F.col("block"), F.col("key"))).alias("x"))
    variants = saved(shared_only(variants.select("id", "at", "start", "size", "x.*"), "variant"))
    least = [F.min(F.when(F.col("role") == k, F.struct("at", "id", "size"))).alias(f"role{k}") for k in range(3)]
    later = variants.join(variants.groupBy("variant").agg(*least), "variant")
    earlier = F.when(F.col("role") == 0, F.col("role0")).when(F.col("role") == 1, F.col("role2")).otherwise(F.col("role1"))
    pairs = later.select("id", "at", "start", "size", earlier.alias("e")).where(F.col("at") > F.col("e.at"))
    pairs = pairs.select("id", "at", "start", "size", F.col("e.id").alias("other"), F.col("e.size").alias("other_size")).distinct()
    one, two = suspects.select("id", "line"), suspects.select(F.col("id").alias("other"), F.col("line").alias("line2"))
    near = one_edit_apart(*map(F.col, ("line", "line2", "start", "size", "other_size")))
    return pairs.join(one, "id").join(two, "other").where(near).select("at.*").distinct()


def without_repeated_lines(docs: DataFrame, carry: tuple[str, ...] = (), shortest: int = SHORTEST, near_from: int = NEAR_FROM) -> DataFrame:
    """(doc_id, carried columns, text, n_lines, n_dropped) for each row, text without the dropped lines.

    Lines of `shortest` code points go if they equal an earlier one, those of `near_from` also if they are one edit away.
    """
    plain = docs.select(*_identified_columns())
    size = F.char_length("line")
    lines = plain.select("d", "h", F.posexplode(_split(F.col("text"))).alias("ln", "line")).where((size >= min(shortest, near_from)) & F.col("line").rlike(WORD))
    lines = lines.select("line", F.struct("d", "h", "ln").alias("at"), F.unhex(F.sha2("line", 256)).alias("a"))
    firsts = lines.groupBy("a").agg(F.min(F.struct("at", "line")).alias("first")).select("a", "first.*", F.monotonically_increasing_id().alias("id"))
    firsts = saved(firsts)
    again = lines.where(size >= shortest).select("a", "at").join(firsts.select("a", F.col("at").alias("first")), "a").where("at > first").select("at.*")
    near = near_lines(firsts.where(size >= near_from).select("id", "at", "line"))
    drops = again.union(near).groupBy("d", "h").agg(F.collect_set("ln").alias("drops"))
    rows = docs.select(*(F.col(c).alias(f"_{c}") for c in carry), *_identified_columns())
    rows = rows.join(drops, ["d", "h"], "left").withColumns({"_lines": _split(F.col("text")), "drops": F.coalesce("drops", F.array().cast("array<int>"))})
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "drops"), lambda i: F.get("_lines", i))
    text = F.when(F.size("drops") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return rows.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), *(F.col(f"_{c}").alias(c) for c in carry), text.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH pieces AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents
), firsts AS (
  SELECT line, min((doc_id, ln)) AS first FROM pieces WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
), long AS (
  SELECT * FROM firsts WHERE length(line) >= 16
), variants AS (
  SELECT line, first, 1 AS role, hash('d', line) AS variant FROM long
  UNION ALL SELECT line, first, 0, hash('s', i, rest) FROM (SELECT line, first, i, substr(line, 1, i - 1) || substr(line, i + 1) AS rest FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM long))
  UNION ALL SELECT line, first, 2, hash('d', substr(line, 1, i - 1) || substr(line, i + 1)) FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM long)
), least AS (
  SELECT variant, min(first) FILTER (role = 0) AS r0, min(first) FILTER (role = 1) AS r1, min(first) FILTER (role = 2) AS r2 FROM variants GROUP BY variant HAVING count(*) > 1
), near AS (
  SELECT DISTINCT line FROM variants JOIN least USING (variant) WHERE first > CASE role WHEN 0 THEN r0 WHEN 1 THEN r2 ELSE r1 END
), marked AS (
  SELECT p.doc_id, p.ln, p.line, coalesce((p.doc_id, p.ln) > f.first OR n.line IS NOT NULL, false) AS dropped
  FROM pieces p LEFT JOIN firsts f ON p.line = f.line LEFT JOIN near n ON p.line = n.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
