"""Cumulative match state over deliveries.

Every window is partitioned by (match_id, innings) or by that and more, so one exchange on those two
keys serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INNINGS = ["match_id", "innings"]
KEY = [*INNINGS, "over_no", "delivery_seq"]
ORDER = ["over_no", "delivery_seq"]


def latest(deliveries: DataFrame) -> DataFrame:
    """One row per delivery: of rows that arrived more than once, the one loaded last."""
    w = Window.partitionBy(*KEY).orderBy(F.col("loaded_at").desc_nulls_last(), F.col("team_score").desc(), F.col("batter").desc())
    return deliveries.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _up_to_now(extra: list[str] | None = None):
    return Window.partitionBy(*INNINGS, *(extra or [])).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def total(c: Column) -> Column:
    return F.sum(c.cast("bigint"))


def running(balls: DataFrame, innings_balls: int | None = None) -> DataFrame:
    """Adds score, wickets, balls and the batter's tally as they stand after each ball (names with a trailing _now)."""
    legal = F.col("is_legal").cast("int")
    w, over, bat = _up_to_now(), _up_to_now(["over_no"]), _up_to_now(["batter"])
    n = F.lit(innings_balls) if innings_balls else F.col("innings_balls_total")
    d = (
        balls.withColumn("score_now", total(F.col("runs_total")).over(w))
        .withColumn("wickets_now", total(F.col("wicket").cast("int")).over(w))
        .withColumn("bowled_now", total(legal).over(w))
        .withColumn("legal_in_over", total(legal).over(over))
        .withColumn("over_runs", total(F.col("runs_total")).over(over))
        .withColumn("batter_runs_now", total(F.col("runs_batter")).over(bat))
        .withColumn("batter_faced_now", total(legal).over(bat))
    )
    d = d.withColumn("remaining_now", F.greatest(n - F.col("bowled_now"), F.lit(0)).cast("bigint"))
    return d.withColumn("ball_now", F.least(F.col("legal_in_over") + F.when(F.col("is_legal"), 0).otherwise(1), F.lit(6)).cast("bigint"))


def over_completion(balls: DataFrame) -> DataFrame:
    """Adds completed_now: the over's runs on the last legal ball of an over of six, else null. Expects running()."""
    whole = Window.partitionBy(*INNINGS, "over_no")
    last = F.max(F.when(F.col("is_legal"), F.col("delivery_seq"))).over(whole)
    return balls.withColumn("completed_now", F.when((F.col("legal_in_over") == 6) & (F.col("delivery_seq") == last), F.col("over_runs")))


def targets(balls: DataFrame) -> DataFrame:
    """(match_id, innings, chase_target): the first innings' total plus one, for the second innings."""
    t = balls.filter("innings IN (1, 2)").groupBy(*INNINGS).agg(total(F.col("runs_total")).alias("made"))
    first = t.filter("innings = 1").select("match_id", (F.col("made") + 1).alias("chase_target"))
    return t.filter("innings = 2").select(*INNINGS).join(first, "match_id", "left").select(*INNINGS, "chase_target")


def momentum(window: int = 12) -> Column:
    """runs of the `window` deliveries before this one; 0 at the start of an innings"""
    w = Window.partitionBy(*INNINGS).orderBy(*ORDER).rowsBetween(-window, -1)
    return F.coalesce(total(F.col("runs_total")).over(w), F.lit(0)).cast("bigint")


def previous_labels(label: Column, depth: int = 4) -> Column:
    """labels of up to `depth` deliveries before this one, the oldest first; to be taken before any row is dropped"""
    return F.collect_list(label).over(Window.partitionBy(*INNINGS).orderBy(*ORDER).rowsBetween(-depth, -1))


def ends_changed(runs_batter: Column, extras: Column, extras_type: Column) -> Column:
    """whether the batters changed ends, by the runs they ran: of wides all but the penalty, of no-balls those of the bat, of other extras these"""
    ran = F.when(extras_type.contains("wides"), extras - 1).when(extras_type.contains("noballs"), runs_batter).when(extras_type != "none", extras).otherwise(runs_batter)
    return F.pmod(ran, F.lit(2)) == 1


def strike_checks(balls: DataFrame) -> DataFrame:
    """(key, kind, batter, expected) of each delivery whose striker follows from the one before in its over; not after a wicket. kind: the extras of that one."""
    w = Window.partitionBy(*INNINGS, "over_no").orderBy(*ORDER)
    prev = {c: F.lag(c).over(w) for c in ("batter", "non_striker", "runs_batter", "wicket", "extras", "extras_type")}
    d = balls.select(*KEY, "batter", *[v.alias("p_" + k) for k, v in prev.items()])
    expected = F.when(ends_changed(F.col("p_runs_batter"), F.col("p_extras"), F.col("p_extras_type")), F.col("p_non_striker")).otherwise(F.col("p_batter"))
    known = F.col("p_batter").isNotNull() & F.col("p_non_striker").isNotNull() & ~F.col("p_wicket")
    return d.filter(known).select(*KEY, F.col("p_extras_type").alias("kind"), "batter", expected.alias("expected"))
