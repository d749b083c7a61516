"""Tool responses: failure kinds, shortened records, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, stripped

#: The two exact failure messages, and lengths of shortened texts.
NO_FILE = "No such file, please check filename."
NO_LINE = "The line number is invalid or out of range for the file."
DETAIL, BODY, RESPONSE = 500, 300, 500


def text_kind(text: Column) -> Column:
    """The failure kind of a response text, or null."""

    def kind(s: Column) -> Column:
        return (
            F.when(s == "", None)
            .when(s == NO_FILE, "no_such_file")
            .when(s == NO_LINE, "invalid_line")
            .when(F.lower(s).startswith("error:"), "error_string")
            .when(s.startswith("File not found:"), "file_not_found")
            .when(s.contains(NO_FILE), "no_such_file")
        )

    return let(stripped(text), kind)


def _found(kind: Column, detail: Column) -> Column:
    return F.struct(kind.alias("kind"), F.left(detail, F.lit(DETAIL)).alias("detail"))


def _text_failure(text: Column, prefix: str = "") -> Column:
    return let(text_kind(text), lambda k: F.when(k.isNotNull(), _found(F.concat(F.lit(prefix), k), text)))


def _object_failure(value: Column) -> Column:
    """The failure of an object: a true `error`, else a failed body."""

    def of_error(error: Column) -> Column:
        kind = F.schema_of_variant(error)
        text = F.when(kind == "STRING", F.try_variant_get(error, "$", "string")).when(kind == "BOOLEAN", "True").otherwise(F.to_json(error))
        true = F.when(kind == "BOOLEAN", F.try_variant_get(error, "$", "boolean")).when(kind == "STRING", text != "").when(kind == "VOID", False)
        return F.when(F.coalesce(true, ~F.coalesce(F.try_variant_get(error, "$", "double") == 0, F.lit(False))), _found(F.lit("error_dict"), text))

    def of_body(body: Column) -> Column:
        return F.when(F.schema_of_variant(body) == "STRING", let(F.try_variant_get(body, "$", "string"), lambda text: _text_failure(text, "degraded_")))

    error = F.try_variant_get(value, "$.error", "variant")
    return F.coalesce(let(error, lambda e: F.when(e.isNotNull(), of_error(e))), let(F.try_variant_get(value, "$.function_body", "variant"), of_body))


def classify(response: Column) -> Column:
    """{kind, detail} of a response given as JSON text, or null; it is parsed once. Null and JSON null count as no response, text that isn't JSON as a string."""
    none = F.struct(F.lit("null_response").alias("kind"), F.lit("tool returned None").alias("detail"))

    def of_value(value: Column) -> Column:
        def of_kind(kind: Column) -> Column:
            return (
                F.when(value.isNull(), _text_failure(response))
                .when(F.is_variant_null(value), none)
                .when(kind == "STRING", let(F.try_variant_get(value, "$", "string"), lambda text: _text_failure(text)))
                .when(kind.startswith("OBJECT"), _object_failure(value))
            )

        return let(F.schema_of_variant(value), of_kind)

    return F.when(response.isNull(), none).otherwise(let(F.try_parse_json(response), of_value))


def compact(response: Column) -> Column:
    """The response as JSON text with a long body or text cut; it is parsed once."""

    def text_json(text: Column, most: int) -> Column:
        return F.to_json(F.struct(F.concat(F.left(text, F.lit(most)), F.lit("...")).alias("b")))

    def of_value(value: Column) -> Column:
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        body = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$.function_body", "string"))
        fields = F.from_json(F.to_json(value), "map<string, variant>")

        def shorter(b: Column) -> Column:
            cut = F.parse_json(text_json(b, BODY))
            return F.to_json(F.transform_values(fields, lambda k, v: F.when(k == "function_body", F.variant_get(cut, "$.b", "variant")).otherwise(v)))

        long_text = let(text, lambda t: F.when(F.char_length(t) > RESPONSE, F.regexp_extract(text_json(t, RESPONSE), r'^\{"b":(.*)\}$', 1)))
        return F.coalesce(long_text, let(body, lambda b: F.when(F.char_length(b) > BODY, shorter(b))), F.to_json(value))

    return let(F.try_parse_json(response), of_value)


def failures(events: DataFrame) -> DataFrame:
    """The events that failed, with failure_kind and detail. events: ts, batch_id, turn, tool, context, arguments, response."""
    rows = events.withColumn("_f", classify(F.col("response")))
    # kept from being pushed below and computed again: the filter reads a field of what is selected
    rows = rows.select(*events.columns, "_f").where("_f.kind is not null")
    return rows.select(*[c for c in events.columns], F.col("_f.kind").alias("failure_kind"), F.col("_f.detail").alias("detail"))


def summary(records: DataFrame) -> DataFrame:
    """Counts by tool, by kind and in all: (by, name, n)."""
    rows = records.groupingSets([["tool"], ["failure_kind"], []], "tool", "failure_kind").agg(F.grouping_id("tool", "failure_kind").alias("_g"), F.count(F.lit(1)).alias("n"))
    by = F.when(F.col("_g") == 1, "tool").when(F.col("_g") == 2, "kind").otherwise("total")
    return rows.select(by.alias("by"), F.when(F.col("_g") == 1, F.col("tool")).when(F.col("_g") == 2, F.col("failure_kind")).alias("name"), "n")
