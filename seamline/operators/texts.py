"""Cleaning, deduplication and splitting of reference texts, and their join to balls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions import rules
from seamline.session import cut


def names_in(*people: Column) -> Column:
    """surnames of the people named (blank ones left out), distinct"""
    return F.array_distinct(F.filter(F.transform(F.concat(*people), rules.surname), lambda x: x.isNotNull() & (x != "")))


def entity_mismatch(text: Column, involved: Column, squad: Column) -> Column:
    """The text names a surname of the squad that is not involved in the ball, and none that is."""
    words = F.regexp_extract_all(text, F.lit("[A-Z][a-z]+"), F.lit(0))
    return F.arrays_overlap(words, F.array_except(squad, involved)) & ~F.arrays_overlap(words, involved)


def drop_reason(text: Column, mismatch: Column, least: int = 4, most: int = 80) -> Column:
    """The first reason that applies: empty, too_short, too_long, entity_mismatch; null keeps the text."""
    n = rules.word_count(text)
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(n < least, "too_short")
        .when(n > most, "too_long")
        .when(mismatch, "entity_mismatch")
    )


def first_occurrence(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Adds `is_first`: whether the row is the first of its lower-cased text in the global order.

    A hot text is no window of its own: its least order key is found by partial aggregation and joined back.
    Texts are told apart by 128 bits."""
    d = df.withColumn("__h", F.md5(F.lower(F.col(text))))
    least = d.groupBy("__h").agg(F.min(F.struct(*order)).alias("__least"))
    return d.join(least, "__h", "left").withColumn("is_first", F.col("__least").eqNullSafe(F.struct(*order))).drop("__h", "__least")


def clean(dataset: DataFrame) -> DataFrame:
    """dataset rows -> (row_id, text, drop_reason): the ladder, then duplicates among its survivors, of which the first in
    the order of balls (match_id, innings, over_no, delivery_seq, row_id) stays. The ladder is walked once: a dropped text is
    in a group of its own."""
    r = lambda c: F.col("record." + c)
    text = rules.strip_html(F.coalesce("target_commentary", F.lit("")))
    people = F.array(r("batter"), r("bowler"), r("non_striker"), r("player_out"))
    involved = names_in(people, F.coalesce(r("fielders"), F.array().cast("array<string>")))
    squad = names_in(F.coalesce(r("squad"), F.array().cast("array<string>")))
    order = ["__m", "__i", "__o", "__q", "row_id"]
    d = dataset.select("row_id", r("match_id").alias("__m"), r("innings").alias("__i"), r("over_no").alias("__o"), r("delivery_seq").alias("__q"), text.alias("text"), involved.alias("involved"), squad.alias("squad"))
    d = d.withColumn("drop_reason", drop_reason(F.col("text"), entity_mismatch(F.col("text"), F.col("involved"), F.col("squad")))).drop("involved", "squad")
    d = cut(d.withColumn("__h", F.when(F.col("drop_reason").isNull(), F.md5(F.lower("text")))), "ladder")
    least = d.filter("__h IS NOT NULL").groupBy("__h").agg(F.min(F.struct(*order)).alias("__least"))
    twice = F.col("__least").isNotNull() & ~F.col("__least").eqNullSafe(F.struct(*order))
    return d.join(least, "__h", "left").select("row_id", "text", F.when(twice, "duplicate").otherwise(F.col("drop_reason")).alias("drop_reason"))


def join_texts(balls: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """Left outer lookup; `has_text` tells the misses, which a dataset build counts and drops."""
    return balls.join(texts.withColumn("has_text", F.lit(True)), key, "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))


def split_counts(n: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole groups per split. Every split with a share is owed a group if there are enough; the other groups go by the
    floor of each share, and what the floors leave belongs to the largest share (to the first of equal ones)."""
    if any(v < 0 for v in shares.values()) or abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError(f"shares must not be negative and must sum to 1: {shares}")
    owed = {s: max(int(n * v), 1 if v > 0 and n >= len(shares) else 0) for s, v in shares.items()}
    largest = max(shares, key=shares.get)
    return owed | {largest: n - sum(k for s, k in owed.items() if s != largest)}


def split_by_group(df: DataFrame, group: str, shares: dict[str, float], seed: str = "13") -> DataFrame:
    """(group, split): groups in the order of a keyed hash, cut at whole counts. Ranks are found within
    1024 hash ranges plus the ranges' starts, so no single task sorts all groups."""
    g = df.select(group).filter(F.col(group).isNotNull()).distinct()
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(group)), 256)
    g = g.withColumn("__h", h).withColumn("__b", F.substr("__h", F.lit(1), F.lit(2)))
    per = g.groupBy("__b").agg(F.count("*").alias("__c"))
    starts = per.withColumn("__s", F.sum("__c").over(Window.orderBy("__b")) - F.col("__c"))  # at most 256 rows
    ranked = g.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h"))).join(F.broadcast(starts), "__b")
    at = F.col("__r") + F.col("__s") - 1
    n = per.agg(F.sum("__c")).first()[0] or 0
    out, lo = None, 0
    for s, k in split_counts(n, shares).items():
        cond = at < lo + k
        out = F.when(cond, s) if out is None else out.when(cond, s)
        lo += k
    return ranked.select(group, (out if out is not None else F.lit(None)).alias("split"))
