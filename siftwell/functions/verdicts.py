"""Typed fields of the JSON objects in language-model replies, by way of VARIANT: a bad field is null and spoils no other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reply_object(text: Column) -> Column:
    """The object from the first ``{`` to the last ``}``; null where there is none or it does not parse."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def number(obj: Column, field: str) -> Column:
    """A JSON number as double. Text and booleans are not numbers."""
    at = F.try_variant_get(obj, f"$.{field}", "variant")
    kind = F.schema_of_variant(at)
    return F.when(kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(obj, f"$.{field}", "double"))


def flag(obj: Column, field: str) -> Column:
    """A JSON boolean; anything else is null."""
    at = F.try_variant_get(obj, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(at) == "BOOLEAN", F.try_variant_get(obj, f"$.{field}", "boolean"))


def string(obj: Column, field: str) -> Column:
    at = F.try_variant_get(obj, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(obj, f"$.{field}", "string"))


def indices(obj: Column, field: str, n: Column | int) -> Column:
    """The whole numbers in ``0 .. n-1`` of a JSON array, in order; other elements are left out, and no array gives none."""
    items = F.try_variant_get(obj, f"$.{field}", "array<variant>")
    whole = F.filter(items, lambda v: F.schema_of_variant(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT"))
    return in_range(F.coalesce(F.transform(whole, lambda v: F.try_variant_get(v, "$", "int")), F.expr("cast(array() as array<int>)")), n)


def in_range(items: Column, n: Column | int) -> Column:
    limit = n if isinstance(n, Column) else F.lit(n)
    return F.filter(items, lambda x: (x >= 0) & (x < limit))
