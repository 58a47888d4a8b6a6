"""Game-state features of each ball."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import rules
from seamline.operators import state


def features(balls: DataFrame, cfg: rules.FeatureConfig = rules.DEFAULTS, keep: list[str] | None = None) -> DataFrame:
    """balls (one row a delivery, with the stored state) -> the key, the eight features, and the columns to keep.

    Rates are rounded to 2 digits, salience and tension to 3; tension uses the unrounded rates."""
    c = F.col
    d = balls.withColumn("momentum", state.momentum(cfg.momentum_window)).withColumn("phase", rules.phase(c("over_no"), cfg))
    d = d.withColumn("wickets_in_hand", F.greatest(F.lit(10) - c("team_wickets"), F.lit(0)))
    d = d.withColumn("crr", rules.current_run_rate(c("team_score"), c("balls_bowled")))
    d = d.withColumn("rrr", rules.required_run_rate(c("target"), c("team_score"), c("balls_remaining")))
    d = d.withColumn("salience", rules.salience(c("wicket"), c("runs_batter"), c("runs_total"), c("phase"), cfg))
    t = rules.tension(c("target"), c("team_score"), c("balls_remaining"), c("balls_bowled"), c("innings_balls_total"), c("wickets_in_hand"), c("crr"), c("phase"), c("salience"), cfg)
    d = d.withColumn("tension_raw", t)
    return d.select(
        *state.KEY,
        rules.rounded(c("crr"), 2).alias("current_run_rate"),
        rules.rounded(c("rrr"), 2).alias("required_run_rate"),
        "wickets_in_hand",
        "balls_remaining",
        "phase",
        "momentum",
        rules.rounded(c("salience"), 3).alias("event_salience"),
        rules.rounded(c("tension_raw"), 3).alias("tension"),
        *(keep or []),
    )


def phase_rollup(balls: DataFrame) -> DataFrame:
    """Mean tension, momentum and wickets by phase and innings (first and second, later ones as one)."""
    f = features(balls, keep=["wicket"])
    n = F.least(F.col("innings"), F.lit(3)).alias("innings")
    s = lambda name, k: F.sum(rules.scaled(F.col(name), k)).cast("bigint")
    return f.groupBy("phase", n).agg(
        F.count("*").alias("n_balls"),
        s("tension", 3).alias("tension_milli"),
        F.sum("momentum").cast("bigint").alias("momentum_sum"),
        F.count_if("wicket").alias("n_wickets"),
    )
