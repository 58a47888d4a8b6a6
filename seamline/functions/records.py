"""Raw delimited records as columns: strict form, fields, header names. All in codegen, no Python rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: one field: quoted with doubled inner quotes, or bare without any quote. Possessive, so long fields cost no stack.
FIELD = r'"(?:[^"]++|"")*+"|[^",]*+'
STRICT = rf"^(?:{FIELD})(?:,(?:{FIELD}))*+$"


def bare_line(line: Column) -> Column:
    """without a byte-order mark and without the line end of either style"""
    return F.regexp_replace(F.regexp_replace(line, "^﻿", ""), r"[\r\n]+$", "")


def is_strict(line: Column) -> Column:
    """every quote closes its field and stands nowhere else; expects a bare_line"""
    return line.rlike(STRICT)


def fields(line: Column) -> Column:
    """The unquoted fields of a strict bare line."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f",({FIELD})"), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def header_names(line: Column) -> Column:
    return F.transform(fields(bare_line(line)), lambda x: F.lower(F.trim(x)))
