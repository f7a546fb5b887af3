"""Canonical text of nested records, whatever order their lists come in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Decimals that a number keeps.
DECIMALS = 6


def number(col: Column) -> Column:
    """A number with at most DECIMALS decimals and no zero more than it needs."""
    text = F.round(col.cast("double"), DECIMALS).cast(f"decimal(30,{DECIMALS})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"\.?0+$", ""), "^-0$", "0")


def quoted(col: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(col, r'(["\\])', r"\\$1"), F.lit('"'))


def canonical(col: Column, kind: T.DataType) -> Column:
    """JSON of a value of that type: fields in the schema's order, lists of records that have an id by their id, numbers by number()."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), canonical(col[f.name], f.dataType)) for f in kind.fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        item = kind.elementType
        if isinstance(item, T.StructType) and "id" in item.names:
            texts = F.array_sort(F.transform(col, lambda x: F.struct(x["id"].alias("id"), canonical(x, item).alias("j"))))["j"]
        else:
            texts = F.transform(col, lambda x: canonical(x, item))
        out = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    elif isinstance(kind, T.BooleanType):
        out = col.cast("string")
    else:
        out = number(col) if isinstance(kind, T.NumericType) else quoted(col.cast("string"))
    return F.coalesce(out, F.lit("null"))
