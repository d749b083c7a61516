"""Scalar text and location functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are followed by a parenthesis without being a call.
KEYWORDS = (
    "if", "while", "for", "switch", "do", "return", "break", "continue", "goto", "case", "default", "sizeof", "typeof", "__typeof__",
    "static", "extern", "auto", "register", "volatile", "const", "struct", "union", "enum", "typedef",
)
#: A location with a source file, and constructor and destructor marks of mangled names with their stand-ins.
SOURCE_LOCATION = r"^[^:]+\.(c|h|cpp|inl):[0-9]+$"
ALIASES = (("C1", "C2"), ("D1", "D2"), ("C3", "C2"), ("D0", "D2"))


#: White space as texts are stripped of: Unicode's, and the four separators from \x1c on.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole_number(text: Column) -> Column:
    """An integer from text as int() takes it (blanks, sign, single underscores), or from a JSON number or boolean; fractions are cut off; null if that fails or is no 32-bit integer."""
    t = stripped(text)
    whole = F.replace(t, F.lit("_")).try_cast("int")
    cut = t.try_cast("double").try_cast("int")
    return F.when(t.rlike("^[+-]?[0-9]+(_[0-9]+)*$"), whole).when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), cut).when(t == "true", 1).when(t == "false", 0)


def parse_location(text: Column) -> Column:
    """{fl, ln} of `file:line`, split at the last colon; null if that isn't possible or the number is too large for a line."""
    file, line = (F.regexp_extract(text, r"(?s)^(.+):([0-9]+)$", k) for k in (1, 2))
    return F.when(line.try_cast("int").isNotNull(), F.struct(file.alias("fl"), line.try_cast("int").alias("ln")))


def location_text(fl: Column, ln: Column) -> Column:
    return F.concat(fl, F.lit(":"), ln.cast("string"))


def normalized_location(fl: Column, ln: Column, cl: Column, text: Column) -> Column:
    """{fl, ln, cl} from fields if both are there, else from the text."""
    parsed = parse_location(text)
    return F.when(fl.isNotNull() & ln.isNotNull(), F.struct(fl.alias("fl"), ln.try_cast("int").alias("ln"), cl.try_cast("int").alias("cl"))).otherwise(
        F.when(parsed.isNotNull(), F.struct(parsed["fl"].alias("fl"), parsed["ln"].alias("ln"), F.lit(None).cast("int").alias("cl")))
    )


def ensure_location(location: Column, fl: Column, filename: Column, ln: Column, line: Column) -> Column:
    """The location if there is one, else file and line as text; null where one of them is missing."""
    return F.coalesce(F.nullif(location, F.lit("")), location_text(F.coalesce(F.nullif(fl, F.lit("")), filename), F.coalesce(ln, line)))


def described_location(text: Column) -> Column:
    """`file:line` of the location object in a description, with or without a column; null if there is none."""
    found = let(F.from_json(F.regexp_extract(text, r'(\{ "ln": [^{}]*\})', 1), "ln string, cl string, fl string"), lambda o: F.when(o["ln"].rlike("^[0-9]+$"), location_text(o["fl"], o["ln"])))
    return F.nullif(found, F.lit(""))


def described_group(descriptions: Column) -> Column:
    """First word and location of each description."""
    return F.transform(descriptions, lambda d: F.struct(F.substring_index(d, " ", 1).alias("vfg_node_kind"), described_location(d).alias("location")))


def body_aliases(name: Column) -> Column:
    """The name, then its variants with another constructor or destructor mark, in order."""
    variants = [F.when(name.rlike(f"{a}(?=E)"), F.regexp_replace(name, f"^(.*?){a}(?=E)", f"$1{b}")) for a, b in ALIASES]
    return F.array_distinct(F.array_compact(F.array(name, *variants)))


def strip_false_error(error: Column) -> Column:
    """An error as JSON text, or null where it is a false value."""
    return F.when(~error.isin("", '""', "false", "null", "0", "0.0", "[]", "{}"), error)


def tolerant_json(text: Column) -> Column:
    """A variant from text that is nearly JSON: as is, then repaired step by step; an empty object from no text, null if nothing helps."""
    # fixed values: the order of the repairs, and the patterns that say what they take away

    def unquoted(clean: Column) -> Column:
        quotes = F.char_length(clean) - F.char_length(F.replace(clean, F.lit('"')))
        return F.when((quotes % 2 == 1) & clean.endswith('"'), clean.substr(F.lit(1), F.char_length(clean) - 1)).otherwise(clean)

    def repaired(clean: Column) -> Column:
        single = F.when(clean.contains("'") & ~clean.contains('"'), F.replace(clean, F.lit("'"), F.lit('"')))
        commas = F.regexp_replace(clean, r",\s*(\]|\})", "$1")
        inner = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
        return F.coalesce(*map(F.try_parse_json, (single, commas, F.nullif(inner, F.lit("")))))

    text = F.coalesce(text, F.lit(""))
    clean = let(stripped(text), lambda t: F.when(t.startswith("`") & t.endswith("`") & (F.char_length(t) > 1), stripped(t.substr(F.lit(2), F.char_length(t) - 2))).otherwise(t))
    # each step once, and only where the text as it is can't be parsed
    return F.coalesce(F.try_parse_json(F.when(text == "", F.lit("{}")).otherwise(text)), let(let(clean, unquoted), repaired))


def call_names(line: Column) -> Column:
    """Names before a parenthesis, without keywords, distinct in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(line, F.lit(r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), F.lit(1)), lambda n: ~n.isin(list(KEYWORDS))))
