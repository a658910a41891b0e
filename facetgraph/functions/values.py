"""Values of configuration documents (VARIANT columns) as text, lists and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A JSON text's strings, signs and other scalars; possessive, so that long strings need no stack.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]++'


def at(value: Column, path: str) -> Column:
    """The value at a path; null where there is none or a step is no object."""
    return F.try_variant_get(value, path, "variant")


def is_given(value: Column) -> Column:
    """Neither missing nor null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def kind_of(value: Column) -> Column:
    """STRING, BOOLEAN, OBJECT, ARRAY, VOID (null) or the name of a number's type; null if missing."""
    return F.regexp_replace(F.schema_of_variant(value), r"[<(].*$", "")


def entries(value: Column) -> Column:
    """An object's entries as a map of variants; null for anything else."""
    return F.when(kind_of(value) == "OBJECT", F.try_variant_get(value, "$", "map<string,variant>"))


def items(value: Column) -> Column:
    """An array's items; null for anything else."""
    return F.when(kind_of(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def string(value: Column) -> Column:
    """The text of a string; null for anything else."""
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def quoted_literal(text: Column) -> Column:
    """A text in single quotes, in double ones if it holds single ones only; the quote, backslashes, line ends and tabs escaped."""
    quote = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), quote, F.concat(F.lit("\\"), quote))
    for sign, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(escaped))
    return F.concat(quote, out, quote)


def nested_text(json: Column) -> Column:
    """A JSON text of any depth, rewritten sign by sign: keys in order, strings quoted, None, True and False."""

    def rewritten(token: Column) -> Column:
        plain = {",": ", ", ":": ": ", "null": "None", "true": "True", "false": "False"}
        out = F.when(F.startswith(token, F.lit('"')), quoted_literal(F.try_variant_get(F.try_parse_json(token), "$", "string")))
        for given, text in plain.items():
            out = out.when(token == given, text)
        return out.otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0)), rewritten), "")


def value_text(value: Column) -> Column:
    """Any value as text: strings as they are, missing ones and null as None, booleans with a capital, objects and arrays by nested_text()."""
    kind, text = kind_of(value), F.try_variant_get(value, "$", "string")
    out = F.when(value.isNull() | (kind == "VOID"), "None").when(kind == "BOOLEAN", F.initcap(text))
    return out.when(kind.isin("OBJECT", "ARRAY"), nested_text(F.to_json(value))).otherwise(text)


def text_list(value: Column) -> Column:
    """An array's items or an object's keys as texts; nothing if missing or null; else the one value's text."""
    keys = F.map_keys(entries(value))
    return F.coalesce(F.transform(items(value), value_text), keys, F.when(is_given(value), F.array(value_text(value))), F.array().cast("array<string>"))


def string_list(value: Column) -> Column:
    """A string, or the strings of an array, others left out; else nothing."""
    found = F.filter(F.transform(items(value), string), lambda x: x.isNotNull())
    return F.coalesce(found, F.when(string(value).isNotNull(), F.array(string(value))), F.array().cast("array<string>"))
