"""Entities in full: every named and numbered one, in Arrow batches, for texts that hold any."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@F.pandas_udf("string")
def _unescape(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def strip_html(c: Column) -> Column:
    """entities first, then tags as blanks, runs of blanks (of any script) as one, trimmed; null stays null"""
    c = F.when(c.contains("&"), _unescape(c)).otherwise(c)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "), r"^ | $", "")
