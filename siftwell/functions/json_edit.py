"""Edits of JSON text in place: top-level keys are replaced or added, every other byte stays.

The text is cut into tokens (strings, brackets, commas, and what lies between), and one fold over
them keeps the depth and where members of the outer object begin and end. Order, nested content,
spelling of numbers, repeated keys and white space are therefore never read, only copied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Tokens cover the text without gaps. Strings first; possessive, so that long ones need no stack.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
TOKEN = STRING + r'|[{}\[\],]|[^"{}\[\],]++'
#: White space of JSON.
SPACE = " \t\n\r"
_MEMBER = "struct<key: string, start: int, end: int>"


def json_string(text: Column) -> Column:
    """Text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def is_object(raw: Column) -> Column:
    """Whether the text is one JSON object and nothing else."""
    inner = F.trim(raw, F.lit(SPACE))
    quotes = F.contains(F.regexp_replace(raw, STRING, ""), F.lit("'"))  # Spark's reader takes them around strings
    one = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    return F.coalesce(inner.startswith("{") & inner.endswith("}") & ~quotes & one, F.lit(False))


def _walk(raw: Column, keys: tuple[str, ...]) -> Column:
    """{members: the named ones with the span between key and next comma or brace, first: where the first key begins, head: where it ends, last: where the last member ends}."""

    def name(token: Column) -> Column:
        decoded = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]
        return F.when(F.contains(token, F.lit("\\")), decoded).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))

    def step(s: Column, token: Column) -> Column:
        c = F.substring(token, 1, 1)
        end = s["at"] + F.length(token)
        opens, closes = c.isin("{", "["), c.isin("}", "]")
        is_key = (s["depth"] == 1) & s["awaits"] & (c == '"')
        ends = (s["depth"] == 1) & (closes | (c == ","))
        member = F.struct(s["key"].alias("key"), s["start"].alias("start"), s["at"].alias("end"))
        return F.struct(
            end.alias("at"),
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(is_key, False).when(ends | ((s["depth"] == 0) & opens), True).otherwise(s["awaits"]).alias("awaits"),
            F.when(is_key, name(token)).when(ends, F.lit(None)).otherwise(s["key"]).alias("key"),
            F.when(is_key, end).otherwise(s["start"]).alias("start"),
            F.when(ends & s["key"].isin(*keys), F.array_append(s["members"], member)).otherwise(s["members"]).alias("members"),
            F.when(is_key & s["first"].isNull(), s["at"]).otherwise(s["first"]).alias("first"),
            F.when(is_key & s["first"].isNull(), end).otherwise(s["head"]).alias("head"),
            F.when(ends, s["at"]).otherwise(s["last"]).alias("last"),
        )

    null, zero = F.lit(None), F.lit(0)
    start = F.struct(zero.alias("at"), zero.alias("depth"), F.lit(False).alias("awaits"), null.cast("string").alias("key"), zero.alias("start"), F.array().cast(f"array<{_MEMBER}>").alias("members"), null.cast("int").alias("first"), null.cast("int").alias("head"), null.cast("int").alias("last"))
    return F.aggregate(F.regexp_extract_all(raw, F.lit(TOKEN), F.lit(0)), start, step)


def _between(raw: Column, start: Column, end: Column) -> Column:
    return F.substring(raw, start + 1, end - start)


def _tail(text: Column) -> Column:
    """The white space that text ends with."""
    return F.right(text, F.length(text) - F.length(F.rtrim(text, F.lit(SPACE))))


def edited(raw: Column, values: dict[str, Column]) -> Column:
    """raw, the text of a JSON object, with top-level keys set to JSON texts; a null value leaves its key alone.

    A key that occurs more than once gets the value at each place, so that every reader sees it. A
    new one goes behind the last member, spaced like the first. Text that isn't an object stays.
    """

    def value_of(key: Column) -> Column:
        return reduce(lambda out, kv: out.when(key == kv[0], kv[1]), list(values.items())[1:], F.when(key == next(iter(values)), next(iter(values.values()))))

    def replaced(w: Column) -> Column:
        """The pieces of the text up to the end of its last named member, and where that is."""

        def put(s: Column, m: Column) -> Column:
            span = _between(raw, m["start"], m["end"])
            new = F.concat(F.regexp_extract(span, r"^[ \t\n\r]*:[ \t\n\r]*", 0), value_of(m["key"]), _tail(span))
            return F.struct(m["end"].alias("at"), F.concat(s["parts"], F.array(_between(raw, s["at"], m["start"]), F.coalesce(new, span))).alias("parts"))

        return F.aggregate(w["members"], F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), put)

    def text(w: Column) -> Column:
        lead = F.when(w["first"].isNull(), "").otherwise(F.regexp_extract(_between(raw, F.lit(0), w["first"]), r"[ \t\n\r]*$", 0))
        colon = F.when(w["first"].isNull(), ":").otherwise(F.regexp_extract(F.substring(raw, w["head"] + 1, F.length(raw)), r"^[ \t\n\r]*:[ \t\n\r]*", 0))
        there = F.transform(w["members"], lambda m: m["key"])
        added = F.array_compact(F.array(*(F.when(v.isNotNull() & ~F.array_contains(there, k), F.concat(lead, json_string(F.lit(k)), colon, v)) for k, v in values.items())))
        joined = F.when(F.size(added) == 0, "").otherwise(F.concat(F.when(w["first"].isNull(), "").otherwise(F.lit(",")), F.array_join(added, ",")))

        def whole(done: Column) -> Column:
            rest = _between(raw, done["at"], w["last"])
            body = F.concat(F.array_join(done["parts"], ""), rest)
            return F.concat(F.rtrim(body, F.lit(SPACE)), joined, _tail(body), F.substring(raw, w["last"] + 1, F.length(raw)))

        return let(replaced(w), whole)

    return F.when(is_object(raw), let(_walk(raw, tuple(values)), text)).otherwise(raw)
