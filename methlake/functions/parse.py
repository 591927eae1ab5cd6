"""Strict text-to-value expressions. A bare cast is too lenient: it trims blanks and takes `0.5f`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The spellings of a missing beta that are skipped without a report.
MISSING_BETA = ("", "na", "nan", "null", "none", ".")

_UINT = r"^\+?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INF = r"(?i)^[+-]?inf(inity)?$"
_NAN = r"(?i)^[+-]?nan$"


def strict_uint(c: Column) -> Column:
    """Unsigned integer, or null: digits with an optional leading plus, nothing else."""
    return F.when(c.rlike(_UINT), c.try_cast("bigint"))


def strict_float(c: Column) -> Column:
    """Single-precision number, or null. Infinities and NaN are spelled in any case."""
    infinite = F.when(c.startswith("-"), F.lit("-Infinity")).otherwise(F.lit("Infinity")).cast("float")
    return (
        F.when(c.rlike(_FLOAT), c.try_cast("float"))
        .when(c.rlike(_INF), infinite)
        .when(c.rlike(_NAN), F.lit("NaN").cast("float"))
    )


def is_missing_beta(c: Column) -> Column:
    return F.lower(c).isin(*MISSING_BETA)


def csv_fields(line: Column) -> Column:
    """The fields of a line of comma-separated text; a field in double quotes may hold commas and doubled quotes.

    Every field is matched together with the comma before it, so one is put in front of the line.
    """
    # possessive runs: one step per quote instead of one per character, and no backtracking
    quoted = r'"[^"]*+(?:""[^"]*+)*+"[^,]*'
    unclosed = r'"[^"]*+(?:""[^"]*+)*+$'
    fields = F.regexp_extract_all(
        F.concat(F.lit(","), F.regexp_replace(line, r"\r$", "")),
        F.lit(f",({quoted}|{unclosed}|[^,]*)"),
        F.lit(1),
    )

    def unquote(f: Column) -> Column:
        body = F.regexp_replace(f, r'^"([^"]*+(?:""[^"]*+)*+)"?', "$1")
        return F.when(f.startswith('"'), F.replace(body, F.lit('""'), F.lit('"'))).otherwise(f)

    return F.transform(fields, unquote)


def field(fields: Column, i: int | Column) -> Column:
    """Zero-based field of a split line; null when the line is too short."""
    return F.get(fields, i if isinstance(i, Column) else F.lit(i))
