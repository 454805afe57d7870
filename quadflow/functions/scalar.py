"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_position(col: Column | str, values: list[str]) -> Column:
    """MySQL ``FIELD(col, v1, v2, ...)``: 1-based position, 0 when absent or NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), col), F.lit(0)).cast("int")


def contains_ci(col: Column | str, keyword: str) -> Column:
    """``col LIKE '%kw%'`` under a case-insensitive collation.

    The keyword's own ``%`` and ``_`` stay wildcards, as in the reference.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.collate(col, "UTF8_LCASE").like(f"%{keyword}%")


def rate_pct(num: Column | str, den: Column | str) -> Column:
    """``ROUND(CASE WHEN den = 0 THEN 0 ELSE num / den * 100 END, 2)`` with exact
    decimal division (half-up), returned as double."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    exact = F.round(num.cast("decimal(20,0)") * F.lit(100) / den.cast("decimal(20,0)"), 2)
    return F.when(den == 0, F.lit(0.0)).otherwise(exact.cast("double"))


BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())  # what a form field is stripped of


def strip(col: Column | str) -> Column:
    """Text without the white space (of any kind) around it."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


COLLATION = "UNICODE_CI_AI"  # of the database: case and accents don't tell names apart, trailing blanks do


def collated(col: Column | str) -> Column:
    """A key under the database's collation, for joins, groups and orders."""
    return F.collate(F.col(col) if isinstance(col, str) else col, COLLATION)


def strip_or_null(col: Column | str) -> Column:
    """An optional form field: stripped text, null if nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def clamp(col: Column, lo: int, hi: int) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col))


def role_of(user_id: Column) -> Column:
    """Role of a campus user id under the adapter's id scheme."""
    return (F.when(user_id % 10 == 0, "admin").when((user_id % 10).isin(1, 2), "club")
            .otherwise("student"))


def order_uid(order_id: Column, day: Column) -> Column:
    """``BOR-yyyyMMdd-`` + zero-padded id, six digits at least, never truncated."""
    digits = order_id.cast("string")
    return F.concat(F.lit("BOR-"), F.date_format(day, "yyyyMMdd"), F.lit("-"),
                    F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), "0"))


def json_of(**fields: Column) -> Column:
    """``JSON_OBJECT(k, v, ...)`` keeping NULL members. Timestamps are rendered
    as ``yyyy-MM-dd HH:mm:ss`` text, like a relational JSON object."""
    parts = []
    for name, value in fields.items():
        parts.append(value.alias(name))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def ts_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
