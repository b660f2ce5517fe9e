"""Text that goes into logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sanitize_text(text: Column) -> Column:
    """Control characters to blanks, invisible marks dropped, blanks collapsed, 500 characters."""
    cleaned = F.regexp_replace(text, "[\\x00-\\x1f\\x7f-\\x9f]", " ")
    cleaned = F.regexp_replace(cleaned, r"[\u200b-\u200f\u2028\u2029\ufeff]", "")
    cleaned = F.trim(F.regexp_replace(cleaned, r"(?U)\s+", " "))
    return F.coalesce(F.substring(cleaned, 1, 500), F.lit(""))


def sanitize_input(text: Column, max_length: int = 50) -> Column:
    """The security-log form: cut at ``max_length`` with a note."""
    clean = sanitize_text(text)
    cut = F.concat(F.substring(clean, 1, max_length), F.lit("...(truncated)"))
    return F.when(F.length(clean) > max_length, cut).otherwise(clean)


def sanitize_value(value: Column, kind: T.DataType) -> Column:
    """Texts (200) at any depth of a declared type; numbers, booleans and nulls stay, what is left becomes text."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value
    if isinstance(kind, T.MapType):
        return F.when(value.isNotNull(), sanitize_context(value, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[sanitize_value(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.NumericType, T.BooleanType)):
            return value
        as_text = F.to_json if isinstance(inner, (T.StructType, T.MapType, T.ArrayType)) else lambda x: x.cast("string")
        return F.transform(value, lambda x: F.when(x.isNotNull(), sanitize_input(as_text(x), 200)))
    return F.when(value.isNotNull(), sanitize_input(value.cast("string"), 200))


def sanitize_context(context: Column, values: T.DataType = T.StringType()) -> Column:
    """All keys (100) and values of a map from strings, nested as deep as the type of its values says."""
    safe_key = lambda k, _: F.when(k == "", "unknown").otherwise(sanitize_input(k, 100))
    safe_value = lambda _, v: sanitize_value(v, values)
    # Two keys may become equal once cleaned; the later one wins, as in any map update.
    entries = F.map_entries(F.transform_values(context, safe_value))
    keyed = F.transform(entries, lambda e: F.struct(safe_key(e["key"], None).alias("key"), e["value"].alias("value")))
    latest = F.filter(
        keyed,
        lambda e, i: ~F.exists(
            F.slice(keyed, i + 2, F.greatest(F.size(keyed), F.lit(1))), lambda later: later["key"] == e["key"]
        ),
    )
    return F.map_from_entries(latest)
