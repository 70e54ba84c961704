"""Header lookups: first value of a case-insensitive name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names(headers: Column) -> Column:
    return F.coalesce(F.transform(headers, lambda h: F.lower(h["name"])), F.array().cast("array<string>"))


def value_at(lower_names: Column, headers: Column, name: str) -> Column:
    """``headers`` by position, so that one lower-cased name array serves every lookup."""
    return F.get(headers["value"], F.array_position(lower_names, name.lower()) - 1)


def values_of(headers: Column, name: str) -> Column:
    kept = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.transform(kept, lambda h: h["value"]), F.array().cast("array<string>"))


def with_header_names(ex: DataFrame) -> DataFrame:
    return ex.withColumn("rq_names", names(F.col("req_headers"))).withColumn("rs_names", names(F.col("resp_headers")))


def req(name: str) -> Column:
    return value_at(F.col("rq_names"), F.col("req_headers"), name)


def resp(name: str) -> Column:
    return value_at(F.col("rs_names"), F.col("resp_headers"), name)
