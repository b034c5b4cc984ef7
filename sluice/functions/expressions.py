"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.schemas import UNREALISED_STATUSES


def ts(value: str) -> Column:
    """A timestamp literal in the session zone."""
    return F.lit(value).cast("timestamp")


def null_or_blank(col: str) -> Column:
    """NULL, or nothing but spaces (tabs count as text)."""
    return F.col(col).isNull() | (F.trim(F.col(col)) == "")


def shown(col: Column) -> Column:
    """Text of a value, with NULL written out."""
    return F.coalesce(col.cast("string"), F.lit("null"))


def quoted(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.col(col), F.lit("'")), F.lit("null"))


def outside(col: str, domain: Iterable[str]) -> Column:
    """NULL or not a member of a closed domain."""
    return F.col(col).isNull() | ~F.col(col).isin(*domain)


def days_between(later: str, earlier: str) -> Column:
    """Calendar-day boundaries crossed, not 24-hour spans."""
    return F.datediff(F.col(later), F.col(earlier))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def realised(amount: str = "total_amount", status: str = "status") -> Column:
    """The amount, with cancelled and returned orders counted as zero."""
    zero = F.lit(0).cast("decimal(12,2)")
    return F.when(F.col(status).isin(*UNREALISED_STATUSES), zero).otherwise(F.col(amount))


def strip(col: Column) -> Column:
    """Drop white space of every kind at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def round_to(col: Column, digits: int) -> Column:
    """Round a double at a fixed number of digits by scaling it first."""
    scale = float(10**digits)
    return F.round(col * scale) / scale


def sort_columns(order: Iterable[tuple[str, bool]]) -> list[Column]:
    """(name, descending) pairs as sort columns with NULLs last both ways."""
    return [F.desc_nulls_last(c) if desc else F.asc_nulls_last(c) for c, desc in order]


def portable(df: DataFrame) -> DataFrame:
    """Values any client can read back unchanged: money as text, times as ISO text."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.DateType)):
            col = col.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(col.alias(field.name))
    return df.select(*out)


def comparable(df: DataFrame) -> DataFrame:
    """Plain result types that read the same from every engine's client."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, T.DateType):
            col = col.cast("string")
        elif isinstance(field.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.ArrayType):
            col = F.array_join(col, ",")
        out.append(col.alias(field.name))
    return df.select(*out)
