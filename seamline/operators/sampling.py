"""Stratified draws in the order of a keyed hash: repeatable, whatever the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(key: str, seed: str = "13") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)


def stratified(df: DataFrame, stratum: str, key: str, n: int, floor: int | None = None, seed: str = "13") -> DataFrame:
    """n rows: up to `floor` (by default max(4, n // (2 * strata))) of each stratum, topped up in hash order.

    Ranks within strata are limited to n, which the optimizer turns into a limit before the shuffle:
    no stratum is sorted as a whole."""
    if floor is None:
        floor = max(4, n // (2 * max(df.select(stratum).distinct().count(), 1)))
    d = df.withColumn("__k", draw_key(key, seed))
    w = Window.partitionBy(stratum).orderBy("__k", key)
    first = d.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    picked = first.withColumn("__top", (F.col("__r") > floor).cast("int")).orderBy("__top", "__k", key).limit(n)
    return picked.drop("__k", "__r", "__top")


def outcome_class(wicket: Column, runs_batter: Column, extras_type: Column, runs_total: Column) -> Column:
    """classes of example balls: wicket, six, four, extra (of any kind, whatever it is worth), dot, runs"""
    return F.when(wicket, "wicket").when(runs_batter == 6, "six").when(runs_batter == 4, "four").when(extras_type != "none", "extra").when(runs_total == 0, "dot").otherwise("runs")


def category(wicket: Column, runs_batter: Column, runs_total: Column, phase: Column, target: Column, tension: Column) -> Column:
    """what an example shows: wicket, six, four, dot_death, tense_chase; null for all else"""
    return (
        F.when(wicket, "wicket").when(runs_batter == 6, "six").when(runs_batter == 4, "four")
        .when((runs_total == 0) & (phase == "death"), "dot_death")
        .when(target.isNotNull() & (tension > 0.6), "tense_chase")
    )


def of_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """The rows of one split, or of all; raises if there is none (one row is looked for, nothing is counted)."""
    d = df if split == "all" else df.filter(F.col(column) == split)
    if d.isEmpty():
        raise ValueError(f"no rows in split {split!r}")
    return d


def few_shot(df: DataFrame, klass: str, key: str, n: int, seed: str = "13") -> DataFrame:
    """One of each class, topped up without replacement."""
    return stratified(df, klass, key, n, floor=1, seed=seed)


def annotation(df: DataFrame, flags: list[str], key: str, n: int, seed: str = "13") -> DataFrame:
    """Up to n // 3 rows of each flagged stratum (a row belongs to its first flag), the rest from the unflagged."""
    stratum = F.lit("clean")
    for f in reversed(flags):
        stratum = F.when(F.col(f), f).otherwise(stratum)
    d = df.withColumn("stratum", stratum).withColumn("__k", draw_key(key, seed))
    r = d.withColumn("__r", F.row_number().over(Window.partitionBy("stratum").orderBy("__k", key)))
    flagged = r.filter((F.col("stratum") != "clean") & (F.col("__r") <= n // 3))
    clean = r.filter((F.col("stratum") == "clean") & (F.col("__r") <= n))
    got = flagged.withColumn("__last", F.lit(0)).unionByName(clean.withColumn("__last", F.lit(1)))
    return got.orderBy("__last", "__k", key).limit(n).drop("__k", "__r", "__last")


def per_category(df: DataFrame, category: str, order: list[str], k: int) -> DataFrame:
    """the first k rows of each category"""
    w = Window.partitionBy(category).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
