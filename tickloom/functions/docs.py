"""Schemaless documents and packed series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.core import Keys, key_list, number_rows


def field(data: Column, path: str) -> Column:
    """A value inside a JSON text, as text: ``field(col, "a.b")``."""
    return F.get_json_object(data, f"$.{path}")


def typed(data: Column, ddl: str) -> Column:
    """The JSON text as a struct of the given schema."""
    return F.from_json(data, ddl)


def to_document(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def find_documents(docs: DataFrame, collection: str, filters: Mapping[str, object] | None = None,
                   limit: int | None = None) -> DataFrame:
    """Documents of a collection whose fields equal all the given values, newest first.

    A document without a filtered field does not match; the limit applies after the filters.
    """
    d = docs.where(F.col("collection") == collection)
    for path, value in (filters or {}).items():
        d = d.where(field(F.col("data"), path) == F.lit(str(value)))
    d = d.orderBy(F.col("created_at").desc(), F.col("document_id").desc())
    return d if limit is None else d.limit(limit)


def pack_points(df: DataFrame, value: str, per: str = "month", by: Keys = "ticker", ts: str = "ts", every: str = "1d",
                per_page: int = 10_000) -> DataFrame:
    """Points packed into arrays of (ts, value): one per key and calendar unit, and ``page`` of at most ``per_page`` points."""
    keys = key_list(by)
    points = number_rows(df.select(*keys, ts, value), keys, ts, every).withColumn("pack", F.date_trunc(per, ts))
    first = points.groupBy(*keys, "pack").agg(F.min("_i").alias("_first"))
    points = points.join(first, [*keys, "pack"]).withColumn("page", F.floor((F.col("_i") - F.col("_first")) / per_page).cast("int"))
    return (
        points.groupBy(*keys, "pack", "page")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(value).alias("value")))).alias("data_points"))
        .withColumns({"timestamp_start": F.col("data_points")[0]["ts"],
                      "timestamp_end": F.element_at("data_points", -1)["ts"]})
    )


def unpack_points(packed: DataFrame, by: Keys = "ticker") -> DataFrame:
    return packed.select(*key_list(by), F.inline("data_points"))
