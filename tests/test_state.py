import json

import pytest
from pyspark.sql import functions as F

from seamline.functions import rules
from seamline.operators import features, state
from seamline.sources import files, matches


def ball(batter, runs=0, extras=None, wickets=None, total=None, bowler="Y Bowl", ns="N Strike"):
    e = extras or {}
    d = {"batter": batter, "bowler": bowler, "non_striker": ns, "runs": {"batter": runs, "extras": sum(e.values())}}
    d["runs"]["total"] = total if total is not None else runs + sum(e.values())
    if e:
        d["extras"] = e
    if wickets:
        d["wickets"] = wickets
    return d


@pytest.fixture(scope="module")
def match_dir(tmp_path_factory):
    p = tmp_path_factory.mktemp("matches")
    over = [
        ball("A One", 1), ball("B Two", extras={"wides": 1}), ball("B Two", 4), ball("B Two", wickets=[{"kind": "bowled", "player_out": "B Two"}]),
        ball("C Three", 6), ball("C Three"), ball("C Three", extras={"byes": 2}),
    ]
    doc = {
        "info": {"match_type": "T20", "overs": 20, "teams": ["Reds", "Blues"], "players": {"Reds": ["A One", "B Two", "C Three"], "Blues": ["Y Bowl", "Z Field"]}},
        "innings": [
            {"team": "Reds", "super_over": True, "overs": [{"over": 0, "deliveries": [ball("A One", 6)]}]},
            {"team": "Reds", "overs": [{"over": 0, "deliveries": over}]},
            {"team": "Blues", "target": {"runs": 15}, "overs": [{"over": 0, "deliveries": [ball("Z Field", 2, wickets=[{"kind": "retired hurt", "player_out": "Z Field"}, {"kind": "caught", "player_out": "Y Bowl", "fielders": [{"name": "A One"}, "B Two"]}])]}]},
        ],
    }
    (p / "m1.json").write_text(json.dumps(doc, indent=1))
    (p / "m2.json").write_text(json.dumps({**doc, "info": {**doc["info"], "match_type": "Test"}}))
    return p


def test_cumulative_state_of_a_match_document(spark, match_dir):
    d = matches.deliveries(matches.read_matches(spark, str(match_dir))).orderBy("innings", "over_no", "delivery_seq").collect()
    one = [r for r in d if r.innings == 1]
    assert {r.match_id for r in d} == {"m1"} and {r.innings for r in d} == {1, 2}
    assert [r.ball for r in one] == [1, 2, 2, 3, 4, 5, 6]
    assert [r.team_score for r in one] == [1, 2, 6, 6, 12, 12, 14]
    assert [r.team_wickets for r in one] == [0, 0, 0, 1, 1, 1, 1]
    assert [r.balls_remaining for r in one] == [119, 119, 118, 117, 116, 115, 114]
    assert [r.completed_over_runs for r in one] == [None] * 6 + [14]
    assert one[1].extras_type == "wides" and not one[1].is_legal and one[3].wicket_type == "bowled"
    two = [r for r in d if r.innings == 2][0]
    assert two.target == 15 and two.bowling_team == "Reds" and two.team_wickets == 1
    assert two.wicket_type == "caught" and two.player_out == "Y Bowl" and two.fielders == ["A One", "B Two"]
    assert two.squad == ["A One", "B Two", "C Three", "Y Bowl", "Z Field"]


def test_one_team_raises(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"info": {"match_type": "T20", "teams": ["Reds"]}, "innings": [{"team": "Reds", "overs": [{"over": 0, "deliveries": [ball("A")]}]}]}))
    with pytest.raises(Exception, match="two teams"):
        matches.deliveries(matches.read_matches(spark, str(tmp_path))).collect()


def test_rates_and_momentum(spark):
    r = spark.range(1).select(
        rules.current_run_rate(F.lit(30), F.lit(24)).alias("c"), rules.rounded(rules.required_run_rate(F.lit(100), F.lit(30), F.lit(96)), 2).alias("r"),
        rules.required_run_rate(F.lit(None).cast("int"), F.lit(30), F.lit(96)).alias("n"), rules.required_run_rate(F.lit(20), F.lit(30), F.lit(96)).alias("z"), rules.current_run_rate(F.lit(3), F.lit(0)).alias("o"),
    ).first()
    assert (r.c, r.r, r.n, r.z, r.o) == (7.5, 4.38, None, 0.0, 0.0)
    rows = [("m", 1, 1 + i // 6, 1 + i % 6, 2) for i in range(14)]
    d = spark.createDataFrame(rows, "match_id string, innings int, over_no int, delivery_seq int, runs_total int")
    got = [x.m for x in d.select("*", state.momentum().alias("m")).orderBy("over_no", "delivery_seq").collect()]
    assert got == [min(2 * i, 24) for i in range(14)]


def test_simulated_matches_keep_the_rules(spark):
    x = matches.with_state(files.simulate(spark, 4)).cache()
    assert x.groupBy(*state.KEY).count().filter("count > 1").count() == 0
    s = state.strike_checks(x)
    assert s.count() > 100 and s.filter("batter <> expected").count() == 0
    a, b = (sorted(map(str, files.simulate(spark, 2).collect())) for _ in range(2))
    assert a == b
    f = features.features(x)
    assert f.filter("tension < 0 OR tension > 1 OR event_salience < 0 OR event_salience > 1").count() == 0


def test_empty_deliveries(spark):
    x = matches.with_state(files.simulate(spark, 1)).limit(0)
    assert features.features(x).count() == 0 and features.phase_rollup(x).count() == 0
