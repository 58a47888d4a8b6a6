"""Queries over deliveries: state, features, labels, linear inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import rules
from seamline.operators import features, state
from seamline.session import read_table as t

K = state.KEY


def balls(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(t(spark, d, "deliveries"))


def running_totals(spark, d):
    return state.running(balls(spark, d)).select(*K, "score_now", "wickets_now", "bowled_now", "remaining_now")


def ball_numbering(spark, d):
    return state.running(balls(spark, d)).select(*K, "ball_now", "legal_in_over")


def over_completion(spark, d):
    return state.over_completion(state.running(balls(spark, d))).filter("completed_now IS NOT NULL").select(*K, "completed_now")


def batter_tally(spark, d):
    return state.running(balls(spark, d)).select(*K, "batter", "batter_runs_now", "batter_faced_now")


def target_join(spark, d):
    return state.targets(balls(spark, d))


def strike_faults(spark, d):
    """pairs of balls checked and those at fault, by the kind of extras of the first"""
    x = state.strike_checks(balls(spark, d))
    return x.groupBy("kind").agg(F.count("*").alias("n_checked"), F.count_if(F.col("batter") != F.col("expected")).alias("n_faults"))


def phase_rates(spark, d):
    f = features.features(balls(spark, d))
    return f.select(*K, "phase", rules.scaled(F.col("current_run_rate"), 2).alias("crr_centi"), rules.scaled(F.col("required_run_rate"), 2).alias("rrr_centi"), "wickets_in_hand")


def salience_tension(spark, d):
    f = features.features(balls(spark, d))
    return f.select(*K, rules.scaled(F.col("event_salience"), 3).alias("salience_milli"), rules.scaled(F.col("tension"), 3).alias("tension_milli"))


def momentum(spark, d):
    return balls(spark, d).select(*K, state.momentum().alias("momentum"))


def flagship(spark, d):
    return features.phase_rollup(balls(spark, d))


def _label():
    c = F.col
    return rules.outcome_label(c("wicket"), c("wicket_type"), c("runs_batter"), c("extras_type"), c("extras"))


def prev_outcomes(spark, d):
    return balls(spark, d).select(*K, F.array_join(state.previous_labels(_label()), ",").alias("prev"))


def label_counts(spark, d):
    return balls(spark, d).groupBy(_label().alias("label")).agg(F.count("*").alias("n"))


def _linear(prev: bool, game_state: bool):
    def run(spark, d):
        ds = t(spark, d, "dataset").select("row_id", "record", "features", "prev_outcomes")
        p = F.coalesce(F.col("prev_outcomes"), F.array().cast("array<string>")) if prev else None
        line = rules.linear_input(lambda c: F.col("record." + c), lambda c: F.col("features." + c), p, game_state=game_state)
        return ds.select("row_id", line.alias("line"))

    return run


BALLS = """WITH balls AS (SELECT * FROM deliveries QUALIFY row_number() OVER (PARTITION BY match_id, innings, over_no, delivery_seq ORDER BY loaded_at DESC NULLS LAST, team_score DESC, batter DESC) = 1)"""
P = "PARTITION BY match_id, innings"
O = "ORDER BY over_no, delivery_seq"  # noqa: E741
U = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
KS = "match_id, innings, over_no, delivery_seq"
PHASE = "CASE WHEN over_no BETWEEN 1 AND 6 THEN 'powerplay' WHEN over_no BETWEEN 7 AND 15 THEN 'middle' WHEN over_no BETWEEN 16 AND 20 THEN 'death' WHEN over_no > 20 THEN 'death' ELSE 'middle' END"
MOMENTUM = f"cast(coalesce(sum(runs_total) OVER ({P} {O} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0) AS bigint)"
LABEL = """CASE WHEN wicket THEN 'WICKET(' || upper(replace(coalesce(nullif(wicket_type, ''), 'wicket'), ' ', '_')) || ')'
 WHEN runs_batter = 6 THEN 'SIX' WHEN runs_batter = 4 THEN 'FOUR'
 WHEN extras_type <> 'none' THEN upper(replace(extras_type, '+', '_')) || CASE WHEN extras <> 0 THEN extras::varchar ELSE '' END
 WHEN runs_batter = 0 THEN 'DOT' WHEN runs_batter = 1 THEN 'SINGLE' WHEN runs_batter = 2 THEN 'TWO' WHEN runs_batter = 3 THEN 'THREE' WHEN runs_batter = 5 THEN 'FIVE'
 ELSE 'RUNS(' || runs_batter || ')' END"""
FEATS = f"""{BALLS}, a AS (SELECT *, {PHASE} AS phase, {MOMENTUM} AS momentum, greatest(10 - team_wickets, 0) AS wih,
  CASE WHEN balls_bowled > 0 THEN team_score * 6.0::double / balls_bowled ELSE 0.0::double END AS crr,
  CASE WHEN target IS NULL OR balls_remaining <= 0 THEN NULL WHEN target - team_score <= 0 THEN 0.0::double ELSE (target - team_score) * 6.0::double / balls_remaining END AS rrr FROM balls),
b AS (SELECT *, CASE WHEN wicket THEN 1.0::double WHEN runs_batter = 6 THEN 0.8::double WHEN runs_batter = 4 THEN 0.6::double WHEN runs_total = 0 AND phase = 'death' THEN 0.4::double ELSE runs_total / 10.0::double END AS sal FROM a),
f AS (SELECT *, least(greatest(CASE WHEN target IS NOT NULL THEN
   0.4::double * CASE WHEN target - team_score <= 0 THEN 0.0::double ELSE 1.0::double / (1.0::double + exp(-(coalesce(rrr, greatest(crr, 12.0::double)) - crr) / 2.0::double)) END
   + 0.3::double * (1.0::double - wih / 10.0::double) + 0.3::double * (balls_bowled / innings_balls_total::double)
  ELSE 0.5::double * CASE phase WHEN 'powerplay' THEN 0.5::double WHEN 'middle' THEN 0.35::double ELSE 0.9::double END + 0.5::double * sal END, 0.0::double), 1.0::double) AS ten FROM b)"""


def _big(x: str, k: int) -> str:
    return f"cast(floor({x} * {10**k} + 0.5) AS bigint)"


def _line(prev: bool, game_state: bool) -> str:
    r = LABEL
    for c in ("wicket_type", "runs_batter", "extras_type"):
        r = r.replace(c, "record." + c)
    r = r.replace("WHEN wicket THEN", "WHEN record.wicket THEN").replace("extras <>", "record.extras <>").replace("extras::", "record.extras::")
    parts = [
        "'over=' || (record.over_no - 1) || '.' || record.ball", "'batter=' || record.batter", "'bowler=' || record.bowler", f"'outcome=' || {r}",
        "CASE WHEN record.wicket THEN 'player_out=' || record.player_out END", "'runs=' || record.runs_total", "'score=' || record.team_score || '/' || record.team_wickets",
    ]
    if game_state:
        parts += ["'RRR=' || features.required_run_rate", "'target=' || record.target", "'wkts_in_hand=' || features.wickets_in_hand", "'phase=' || features.phase", "'momentum=' || features.momentum"]
    if prev:
        parts.insert(0, "CASE WHEN len(prev_outcomes) > 0 THEN 'prev=' || array_to_string(prev_outcomes[greatest(len(prev_outcomes) - 1, 1):], ',') ELSE 'prev=NONE' END")
    return f"SELECT row_id, concat_ws(' | ', {', '.join(parts)}) AS line FROM dataset"


QUERIES = {
    "state_running_totals": running_totals,
    "state_ball_numbering": ball_numbering,
    "state_over_completion": over_completion,
    "state_batter_tally": batter_tally,
    "state_target_join": target_join,
    "state_strike_faults": strike_faults,
    "feat_phase_rates": phase_rates,
    "feat_salience_tension": salience_tension,
    "feat_momentum": momentum,
    "feat_flagship_phase_rollup": flagship,
    "prev_outcomes_context": prev_outcomes,
    "outcome_label_counts": label_counts,
    "linearize_flat": _linear(False, True),
    "linearize_context": _linear(True, True),
    "linearize_nostate": _linear(False, False),
}

ORACLE = {
    "state_running_totals": f"""{BALLS}, r AS (SELECT *, cast(sum(runs_total) OVER ({P} {O} {U}) AS bigint) AS score_now, cast(sum(wicket::int) OVER ({P} {O} {U}) AS bigint) AS wickets_now,
 cast(sum(is_legal::int) OVER ({P} {O} {U}) AS bigint) AS bowled_now FROM balls) SELECT {KS}, score_now, wickets_now, bowled_now, greatest(innings_balls_total - bowled_now, 0) AS remaining_now FROM r""",
    "state_ball_numbering": f"""{BALLS}, r AS (SELECT *, cast(sum(is_legal::int) OVER (PARTITION BY match_id, innings, over_no ORDER BY delivery_seq {U}) AS bigint) AS legal_in_over FROM balls)
 SELECT {KS}, cast(least(legal_in_over + CASE WHEN is_legal THEN 0 ELSE 1 END, 6) AS bigint) AS ball_now, legal_in_over FROM r""",
    "state_over_completion": f"""{BALLS}, r AS (SELECT *, sum(is_legal::int) OVER (PARTITION BY match_id, innings, over_no ORDER BY delivery_seq {U}) AS l,
 cast(sum(runs_total) OVER (PARTITION BY match_id, innings, over_no ORDER BY delivery_seq {U}) AS bigint) AS completed_now, max(CASE WHEN is_legal THEN delivery_seq END) OVER (PARTITION BY match_id, innings, over_no) AS z FROM balls)
 SELECT {KS}, completed_now FROM r WHERE l = 6 AND delivery_seq = z""",
    "state_batter_tally": f"""{BALLS} SELECT {KS}, batter, cast(sum(runs_batter) OVER (PARTITION BY match_id, innings, batter {O} {U}) AS bigint) AS batter_runs_now,
 cast(sum(is_legal::int) OVER (PARTITION BY match_id, innings, batter {O} {U}) AS bigint) AS batter_faced_now FROM balls""",
    "state_target_join": f"""{BALLS}, m AS (SELECT match_id, innings, cast(sum(runs_total) AS bigint) AS made FROM balls WHERE innings IN (1, 2) GROUP BY 1, 2)
 SELECT b.match_id, b.innings, a.made + 1 AS chase_target FROM m b LEFT JOIN m a ON a.match_id = b.match_id AND a.innings = 1 WHERE b.innings = 2""",
    "state_strike_faults": f"""{BALLS}, l AS (SELECT *, lag(batter) OVER w AS pb, lag(non_striker) OVER w AS pn, lag(runs_batter) OVER w AS pr, lag(wicket) OVER w AS pw, lag(extras) OVER w AS pe, lag(extras_type) OVER w AS pt FROM balls
 WINDOW w AS (PARTITION BY match_id, innings, over_no ORDER BY delivery_seq)), x AS (SELECT *, CASE WHEN (CASE WHEN contains(pt, 'wides') THEN pe - 1 WHEN contains(pt, 'noballs') THEN pr WHEN pt <> 'none' THEN pe ELSE pr END) % 2 = 1 THEN pn ELSE pb END AS expected FROM l WHERE pb IS NOT NULL AND pn IS NOT NULL AND NOT pw)
 SELECT pt AS kind, count(*) AS n_checked, count(*) FILTER (batter <> expected) AS n_faults FROM x GROUP BY 1""",
    "feat_phase_rates": f"{FEATS} SELECT {KS}, phase, {_big('crr', 2)} AS crr_centi, {_big('rrr', 2)} AS rrr_centi, wih AS wickets_in_hand FROM f",
    "feat_salience_tension": f"{FEATS} SELECT {KS}, {_big('sal', 3)} AS salience_milli, {_big('ten', 3)} AS tension_milli FROM f",
    "feat_momentum": f"{BALLS} SELECT {KS}, {MOMENTUM} AS momentum FROM balls",
    "feat_flagship_phase_rollup": f"""{FEATS} SELECT phase, least(innings, 3) AS innings, count(*) AS n_balls, cast(sum({_big('ten', 3)}) AS bigint) AS tension_milli, cast(sum(momentum) AS bigint) AS momentum_sum,
 count(*) FILTER (wicket) AS n_wickets FROM f GROUP BY 1, 2""",
    "prev_outcomes_context": f"""{BALLS}, l AS (SELECT *, {LABEL} AS lab FROM balls) SELECT {KS}, coalesce(array_to_string(list(lab) OVER ({P} {O} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ','), '') AS prev FROM l""",
    "outcome_label_counts": f"{BALLS} SELECT {LABEL} AS label, count(*) AS n FROM balls GROUP BY 1",
    "linearize_flat": _line(False, True),
    "linearize_context": _line(True, True),
    "linearize_nostate": _line(False, False),
}
