import pytest
from pyspark.sql import functions as F

from seamline import config
from seamline.operators import drift
from seamline.operators.components import connected_components
from seamline.operators.drift_sources import all_changes, unified_commentary
from seamline.sources import commentary_csv, commentary_lines, files

HEAD = "match_id,innings,over_ball,batsman,bowler,runs_batter,extras,extras_type,runs_total,commentary"
LINES = "line_id long, feed string, file_name string, file_seq int, line_no int, line string, extra string"
METRICS = "run_dir string, feed string, file_seq int, started_at timestamp, body string"


def lines(spark, *files_):
    rows, n = [], 0
    for seq, text in enumerate(files_, 1):
        for no, x in enumerate(text, 1):
            n += 1
            rows.append((n, "f", f"f_{seq}.csv", seq, no, x, "e"))
    return spark.createDataFrame(rows, LINES)


def test_reject_reasons_in_order(spark):
    body = ["m,1,0.1,A,B,1,0,none,1,fine", 'm,1,0.2,A,B,1,0,,1,"two ""quoted"" words, and a comma"', 'm,1,0.3,A,B,1,0,,1,"left open', 'm,1,0.4,A,B,1,0,,1,"a" b', "m,1,0.5,A,B,1,0,1,short",
            "m,1,tea,A,B,1,0,,x,both", "m,1,20.1,A,B,1,0,,1,beyond", "m,1,0.6,A,B,1,0,,-1,negative", "m,1,1.1,A,B,1,0,,4.0,whole", "m,1,1.2,A,B,1,0,,,blank total", "m,1,1.3,A,B,1,1,odd,1,kind", "m,1,1.4,A,B,1,1,Leg Byes,1,ok", None]
    got = {r.line_id: r.reason for r in commentary_lines.rejects(lines(spark, ["﻿" + HEAD.upper(), *body])).collect()}
    assert got == {4: "quoting", 5: "quoting", 6: "columns", 7: "over_ball", 8: "over_ball", 9: "runs_total", 12: "extras_type", 14: "columns"}


def test_reject_styles_of_position(spark):
    packed = HEAD.replace("over_ball", "ovb")
    a = [packed, *[f"m,1,{o}0{b},A,B,0,0,,0,t" for o in (1, 2) for b in range(1, 7)], "m,1,5,A,B,0,0,,0,first over", "m,1,107,A,B,0,0,,0,no seventh ball", "m,1,2001,A,B,0,0,,0,beyond"]
    b = [HEAD.replace("over_ball", "over,ball"), "m,1,1,6,A,B,0,0,,0,t", "m,1,0,1,A,B,0,0,,0,from one", "m,1,20,6,A,B,0,0,,0,last", "m,1,21,1,A,B,0,0,,0,beyond", "m,1,,1,A,B,0,0,,0,none"]
    got = {r.line_id for r in commentary_lines.rejects(lines(spark, a, b)).collect()}
    assert got == {15, 16, 19, 21, 22}


def test_rejects_of_nothing(spark):
    assert commentary_lines.rejects(lines(spark)).count() == 0
    only = lines(spark, [HEAD]).filter("false")
    assert commentary_lines.strict_load(only).count() == 0
    headless = spark.createDataFrame([(1, "f", "x.csv", 1, 2, "a,b", "e")], LINES)
    assert commentary_lines.rejects(headless).first().reason == "columns"


def drift_files(spark):
    one = [HEAD, *[f"m,1,{o}.{b},A Bat,B Bowl,{b % 3},0,none,{b % 3},some words on ball {b}" for o in range(3) for b in range(1, 7)]]
    two = [h for h in one]
    two[0] = HEAD.replace("batsman", " STRIKER ").replace("runs_total", "total_runs")
    three = [x.replace(f",{b % 3},0,none", f",{b % 3} runs,0,none") for x, b in zip(two, [0, *[b for _ in range(3) for b in range(1, 7)]])]
    four = [",".join(x.split(",")[:3] + x.split(",")[4:]) + (",venue" if i == 0 else ",The Oval") for i, x in enumerate(two)]
    return lines(spark, one, two, three, four)


def test_drift_of_csv_and_runs(spark):
    runs = [("r1", "g", 1, None, '{"run": {"seed": 1, "overrides": ["a.b=1"], "split": "val"}, "metrics": {}}'), ("r2", "g", 2, None, '{"run": {"seed": null, "overrides": "a.b=1", "split": "val"}}'),
            ("r3", "g", 3, None, '{"run": {"seed": "1", "overrides": "", "host": "box"}}'), ("r4", "g", 4, None, "broken")]
    m = spark.createDataFrame(runs, METRICS)
    got = {tuple(r) for r in all_changes(drift_files(spark), m).collect()}
    csv = {x for x in got if x[0].startswith("f_")}
    assert csv == {
        ("f_2.csv", "striker", "renamed"), ("f_2.csv", "total_runs", "renamed"), ("f_3.csv", "runs_batter", "retyped"), ("f_4.csv", "runs_batter", "retyped"), ("f_4.csv", "striker", "removed"), ("f_4.csv", "venue", "added"),
    }
    assert ("r2", "run.overrides", "retyped") in got and ("r3", "run.seed", "retyped") in got
    assert not any(f == "r2" and n == "run.seed" for f, n, _ in got) and not any(f == "r3" and n == "run.overrides" for f, n, _ in got)


def test_unified_commentary(spark):
    d = unified_commentary(drift_files(spark))
    assert d.count() == 72 and d.filter("batter IS NULL").count() == 18 and d.filter("other LIKE '%Oval%'").count() == 18


def test_assignment_is_optimal():
    assert drift.assign([[0.9, 0.8], [0.8, 0.1]]) == [1, 0]
    assert drift.assign([[0.5], [0.9]]) == [-1, 0]
    assert drift.assign([]) == []


def test_components_on_chain_star_and_nulls(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3), (1, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 150)} == {100} and len(got) == 91
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


A = "match_id,innings,over_ball,batting_team,batsman,bowler,non_striker,batsman_runs,extras,extra_type,total_runs,is_wicket,dismissal_kind,player_dismissed,commentary\n"


def test_csv_conventions(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿" + A + 'k1,1,0.1,Reds,A,B,C,1,0,,1,0,,,"one, please"\nk1,1,0.2,Reds,C,B,A,0,1,wides,1,0,,,a wide\nk1,1,0.2,Reds,C,B,A,0,0,,0,1,caught,C,gone\n', encoding="utf-8")
    rows = commentary_csv.read_csv(spark, str(p))
    d = commentary_csv.deliveries(rows).orderBy("over_no", "delivery_seq").collect()
    assert [(r.over_no, r.delivery_seq, r.ball, r.is_legal) for r in d] == [(1, 1, 1, True), (1, 2, 2, False), (1, 3, 2, True)]
    assert [r.team_score for r in d] == [1, 2, 2] and d[2].player_out == "C" and d[0].bowling_team == "opposition-1" and d[0].target is None
    assert [r.text for r in commentary_csv.texts(rows).orderBy("delivery_seq").collect()] == ["one, please", "a wide", "gone"]
    q = tmp_path / "b.csv"
    q.write_text("match,inning,over,ball,team,striker,bowler_name,runs_off_bat,extra_runs,kind_of_extras,text\nk2,1,1,1,Reds,A,B,4,0,,four\nk2,1,2,1,Reds,A,B,0,2,legbyes,pads\n")
    e = commentary_csv.deliveries(commentary_csv.read_csv(spark, str(q))).orderBy("over_no").collect()
    assert [(r.over_no, r.runs_total, r.extras_type) for r in e] == [(1, 4, "none"), (2, 2, "legbyes")]
    with pytest.raises(commentary_csv.ColumnMapError):
        commentary_csv.resolve(["batsman", "bowler", "over_ball", "commentary"])
    with pytest.raises(commentary_csv.ColumnMapError):
        commentary_csv.resolve(["batsman"], {"batter": "nobody"})
    with pytest.raises(ValueError, match="30 of 100"):
        commentary_csv.audit(spark.range(100), F.col("id") < 30)


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "é"), (2, None)], "k int, t string")
    assert files.write_jsonl(d, str(tmp_path / "j")) == 2
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), d.schema).collect())) == [(1, "é"), (2, None)]
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n\nnope\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k int").collect()
    loose = files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k int", strict=False).collect()
    assert [r["_corrupt_record"] for r in loose if r["k"] is None] == ["nope"]
    assert files.read_runs(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "runs/r1").mkdir(parents=True)
    (tmp_path / "runs/r1/metrics.json").write_text('{"run": {}}')
    assert files.read_runs(spark, str(tmp_path / "runs")).first().run_dir == "r1"
    m = spark.createDataFrame([("a", 0.5, None, None), ("b", None, "unavailable", "x")], "path string, value double, status string, reason string")
    page = files.report(m, "run")
    assert "| a | 0.5000 |" in page and "b: unavailable (x)" in page
    assert files.write_stats(spark.createDataFrame([(3,)], "n int"), str(tmp_path / "s.json")) == {"n": 3}


def test_examples_and_guard(spark):
    d = spark.createDataFrame([(1, "four", "a|b"), (2, "four", "c"), (3, "four", "d"), (4, "dot", None)], "k int, what string, text string")
    md = files.examples_table(d, "what", ["k"], ["text"])
    assert md.count("| four |") == 2 and "a\\|b" in md and "| dot |  |" in md
    assert "\\begin{tabular}{ll}" in files.examples_table(d, "what", ["k"], ["text"], tex=True)
    assert files.guard_long_run(300, 3, 0.3) == 1.0
    with pytest.raises(RuntimeError):
        files.guard_long_run(10_000, 3, 3.0)


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("x: {y: 1, z: 2}\n")
    (tmp_path / "b.yaml").write_text("extends: a.yaml\nx: {y: 3}\n")
    (tmp_path / "c.yaml").write_text("extends: b.yaml\nw: 1\n")
    c = config.load(tmp_path / "c.yaml", ["x.q=[1, 2]", "w=true"])
    assert c == {"x": {"y": 3, "z": 2, "q": [1, 2]}, "w": True}
    with pytest.raises(ValueError):
        config.override(c, "w.deep=1")
    with pytest.raises(KeyError):
        config.need(c, "x.none")
