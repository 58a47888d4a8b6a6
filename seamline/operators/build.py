"""The dataset build: balls with features and earlier labels, texts looked up, matches split, texts cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import rules
from seamline.operators import features, state, texts

RECORD = [
    "match_id", "innings", "over_no", "ball", "delivery_seq", "is_legal", "batting_team", "bowling_team", "batter", "bowler", "non_striker", "runs_batter", "runs_total", "extras", "extras_type",
    "wicket", "wicket_type", "player_out", "fielders", "team_score", "team_wickets", "target", "balls_remaining", "balls_bowled", "innings_balls_total", "batter_runs_after", "batter_balls_faced",
    "completed_over_runs", "squad",
]
FEATURES = ["current_run_rate", "required_run_rate", "wickets_in_hand", "balls_remaining", "phase", "momentum", "event_salience", "tension"]
#: how many earlier labels a row carries; a context asks for no more
DEPTH = 4


def dataset(balls: DataFrame, text: DataFrame, shares: dict[str, float], context_balls: int = 0, game_state: bool = True, seed: str = "13", data_source: str = "deliveries", reference_source: str = "texts") -> DataFrame:
    """balls (one row a delivery), text(key, text) -> (row_id, record, features, prev_outcomes, linearized_input,
    target_commentary, split, data_source, reference_source, drop_reason): every ball, with the reason why it is left out
    (no_text for a ball that nobody described), or null.

    Earlier labels and features come before any row is dropped, from one exchange by innings. Row ids are hashes of the
    key, so that they do not depend on partitions."""
    if context_balls > DEPTH:
        raise ValueError(f"a context of {context_balls} balls, but rows carry {DEPTH} labels")
    c = F.col
    b = balls.withColumn("__prev", state.previous_labels(rules.outcome_label(c("wicket"), c("wicket_type"), c("runs_batter"), c("extras_type"), c("extras")), DEPTH))
    b = b.withColumn("record", F.struct(*[k for k in RECORD if k in balls.columns]))
    f = features.features(b, keep=["record", "__prev"])
    f = f.select(*state.KEY, "record", F.struct(*FEATURES).alias("features"), c("__prev").alias("prev_outcomes"))
    line = rules.linear_input(lambda k: c("record." + k), lambda k: c("features." + k), c("prev_outcomes") if context_balls else None, context_balls, game_state)
    d = texts.join_texts(f.withColumn("linearized_input", line), text.select(*state.KEY, c("text").alias("target_commentary")), state.KEY)
    d = d.withColumn("row_id", F.xxhash64(*state.KEY)).join(texts.split_by_group(balls.select("match_id"), "match_id", shares, seed), "match_id")
    reason = texts.clean(d.filter("has_text AND target_commentary IS NOT NULL")).select("row_id", "text", "drop_reason")
    d = d.join(reason, "row_id", "left")
    missing = ~c("has_text") | c("target_commentary").isNull()
    return d.select(
        "row_id", "record", "features", "prev_outcomes", "linearized_input", F.coalesce("text", "target_commentary").alias("target_commentary"), "split", F.lit(data_source).alias("data_source"),
        F.lit(reference_source).alias("reference_source"), F.when(missing, "no_text").otherwise(c("drop_reason")).alias("drop_reason"),
    )


def kept(rows: DataFrame) -> DataFrame:
    """the rows that make the dataset"""
    return rows.filter("drop_reason IS NULL").drop("drop_reason")


def statistics(rows: DataFrame) -> DataFrame:
    """Per split: balls, rows kept, matches with a row kept, and what was left out by reason."""
    ok = F.col("drop_reason").isNull()
    out = [F.count_if(F.col("drop_reason") == r).alias(f"n_{r}") for r in ("no_text", "empty", "too_short", "too_long", "entity_mismatch", "duplicate")]
    return rows.groupBy("split").agg(F.count("*").alias("n_balls"), F.count_if(ok).alias("n_rows"), F.count_distinct(F.when(ok, F.col("record.match_id"))).alias("n_matches"), *out)


def relinearized(rows: DataFrame, context_balls: int = 0, game_state: bool = True) -> DataFrame:
    """rows with linearized_input written anew from what they carry; raises where the labels a context needs are missing."""
    if context_balls > DEPTH:
        raise ValueError(f"a context of {context_balls} balls, but rows carry {DEPTH} labels")
    if context_balls and "prev_outcomes" not in rows.columns:
        raise ValueError("rows carry no earlier labels")
    prev = F.col("prev_outcomes") if context_balls else None
    if context_balls:
        prev = F.when(prev.isNull(), F.raise_error("a row carries no earlier labels").cast("array<string>")).otherwise(prev)
    return rows.withColumn("linearized_input", rules.linear_input(lambda k: F.col("record." + k), lambda k: F.col("features." + k), prev, context_balls, game_state))
