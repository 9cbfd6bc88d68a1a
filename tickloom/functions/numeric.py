"""Numeric clean-up shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def to_number(col: Column) -> Column:
    """Text to double; what does not parse becomes null."""
    return col.try_cast("double")


def finite(col: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(F.isnan(col) | (F.abs(col) == INF), F.lit(None)).otherwise(col)


def safe_div(num: Column, den: Column) -> Column:
    """Null where the divisor is null or zero."""
    return F.when(den != 0, num / den)


def _clean(col: Column, kind: T.DataType) -> Column | None:
    """``col`` with every floating value inside it made finite; None if there is none."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(col)
    if isinstance(kind, T.ArrayType):
        if _clean(F.lit(None), kind.elementType) is None:
            return None
        return F.transform(col, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.StructType):
        parts = [_clean(col[f.name], f.dataType) for f in kind.fields]
        if all(p is None for p in parts):
            return None
        whole = F.struct(*[
            (col[f.name] if p is None else p).alias(f.name) for f, p in zip(kind.fields, parts)
        ])
        return F.when(col.isNotNull(), whole)
    if isinstance(kind, T.MapType):
        if _clean(F.lit(None), kind.valueType) is None:
            return None
        return F.transform_values(col, lambda _, v: _clean(v, kind.valueType))
    return None


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every floating column, nested ones included."""
    out = []
    for f in df.schema.fields:
        cleaned = _clean(F.col(f.name), f.dataType)
        out.append(F.col(f.name) if cleaned is None else cleaned.alias(f.name))
    return df.select(*out)
