import pytest
from pyspark.sql import functions as F

from seamline.operators import diversity, excitement, factcheck, generate, runs, sampling, stats, surface, texts


def test_splits_by_whole_groups(spark):
    d = spark.createDataFrame([(f"m{i}",) for i in range(20) for _ in range(3)], "g string")
    got = texts.split_by_group(d, "g", {"train": 0.8, "val": 0.1, "test": 0.1}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 16, "val": 2, "test": 2}
    assert set(texts.split_counts(6, {"train": 0.8, "val": 0.1, "test": 0.1}).values()) == {4, 1}
    assert texts.split_by_group(d.limit(0), "g", {"train": 1.0}).count() == 0


def test_drop_ladder(spark):
    inv, squad = F.array(F.lit("Khan")), F.array(F.lit("Khan"), F.lit("Smith"))
    rows = spark.createDataFrame([("",), ("too few here",), ("a Smith drive through the covers",), ("Khan and Smith run a single",), ("x " * 90,)], "t string")
    got = [r.r for r in rows.select(texts.drop_reason(F.col("t"), texts.entity_mismatch(F.col("t"), inv, squad)).alias("r")).collect()]
    assert got == ["empty", "too_short", "entity_mismatch", None, "too_long"]


def test_first_occurrence_ignores_case_and_keeps_order(spark):
    d = spark.createDataFrame([(1, "B"), (2, "a"), (3, "b"), (4, "A")], "k int, t string")
    assert [r.k for r in texts.first_occurrence(d, "t", ["k"]).filter("is_first").orderBy("k").collect()] == [1, 2]


def test_distinct_and_repetition(spark):
    d = spark.createDataFrame([(1, "i", "a b a"), (2, "i", "b c")], "k int, g string, t string")
    r = diversity.distinct_by_group(d, "t", ["g"], 1).first()
    assert (r.distinct_grams, r.grams) == (3, 5)
    e = spark.createDataFrame([(1, "x", "a b"), (2, "y", "a a")], "k int, g string, t string")
    assert diversity.distinct_mean(e, "t", ["g"], 1).first().mean_ratio == 0.75
    s = spark.createDataFrame([(1, "i", "a"), (2, "i", "a"), (3, "i", "b"), (4, "i", "c d e f"), (5, "i", "x c d e f")], "k int, g string, t string")
    assert tuple(diversity.repetition(s, "t", ["g"], ["k"], 4).first()) == (2, 2, 1.0)
    assert diversity.repetition(s.limit(1), "t", ["g"], ["k"], 4).first().rate is None


def test_spearman_ties_constants_and_short_groups(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 2.0), ("c", 2.0, 3.0)], "g string, x double, y double")
    got = {r.g: r.rho for r in stats.spearman(d, "x", "y", ["g"]).collect()}
    assert abs(got["a"] - 0.8660254) < 1e-6 and got["b"] is None and got["c"] is None


def test_confusion(spark):
    d = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (False, False)], "p boolean, g boolean").withColumn("t", F.lit("x")).withColumn("s", F.lit("all"))
    r = stats.confusion(d, F.col("p"), F.col("g"), "t", "s").filter("stratum = 'overall'").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.accuracy) == (1, 1, 1, 2, 0.5, 0.5, 0.6)


def test_excitement_saturates(spark):
    d = spark.createDataFrame([("!!!!",), ("What a massive hit",), ("SIX GONE OVER R K",), ("what\na day",), (None,)], "t string")
    got = [round(r.s, 6) for r in d.select(excitement.score(F.col("t")).alias("s")).collect()]
    assert got == [0.4, round(0.8 / 3, 6), 0.2, round(0.4 / 3, 6), 0.0]
    with pytest.raises(ValueError):
        excitement.mixed(F.lit(1.0), None, (0.0, 0.0))


CASES = [
    ("No run, pushed to cover", []),
    ("That is six, over long-on", [("boundary", 6)]),
    ("They need six from the last over", []),
    ("Six wides in the over", [("extras", 6)]),
    ("not a single run", []),
    ("takes a single", [("runs", 1)]),
    ("a single boundary", [("boundary", None)]),
    ("Bowled him!", [("wicket", "bowled")]),
    ("bowled him a bouncer", []),
    ("beautifully bowled", []),
    ("nearly caught at slip", []),
    ("caught in two minds", []),
    ("gone, way into the stands", []),
    ("gone!", [("wicket", "unspecified")]),
    ("it falls short of the fielder", []),
    ("run out chance missed", []),
    ("wicket in hand", []),
    ("45/2 now", [("score", 45)]),
    ("out for a duck", [("personal_score", 0)]),
    ("his maiden fifty", [("milestone", 50)]),
    ("fifty partnership", []),
    ("a maiden over", [("milestone", "maiden")]),
    ("denied a boundary", []),
]


CASES += [
    ("Twelve needed; she and her partner take 2 runs and wants 3 more", [("runs", 2)]),
    ("3 runs; they cross for two, two more wanted", [("runs", 3)]),
    ("five leg byes and 1 wide", [("extras", 5), ("extras", 1)]),
    ("his six wides went for four", [("extras", 6), ("boundary", 4)]),
    ("a maximum, the boundary riders watch", [("boundary", 6)]),
    ("without conceding a single boundary so far", []),
    ("castled, and almost lbw the ball before", [("wicket", "bowled")]),
    ("bowled her. Run-out as well", [("wicket", "bowled"), ("wicket", "run out")]),
    ("bowled a loose one, stumped for ideas", []),
    ("the ball falls safe, that's out of here", []),
    ("that's out! 7/101 or 101 for 7", [("wicket", "unspecified"), ("score", 7), ("score", 101)]),
    ("falls for 99999999999 no, departs for 12", [("wicket", "unspecified"), ("personal_score", 12)]),
    ("Omar's half-century, her hundred, a ton for Ines", [("milestone", 50), ("milestone", 100)]),
    ("a maiden wicket, needed a maiden", [("wicket", "unspecified")]),
    ("not \u0001four\u0002", []),
    ("'four", [("boundary", 4)]),
    ("", []),
]


def test_claims(spark):
    none = F.array().cast("array<string>")
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(len(CASES), None)], "i int, t string")
    got = {r.i: [(c.slot, c.num if c.num is not None else c.tag if c.tag != "any" else None) for c in r.c if not (c.slot == "runs" and c.num == 0)] for r in factcheck.with_claims(d, F.col("t"), none, none, "c").collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: w for i, (_, w) in enumerate(CASES)} and got[len(CASES)] == []


def test_claims_of_a_long_text(spark):
    """guards look at the last words only, however many matches a text has"""
    long = "need a four. " * 2000 + "he hits a four. " + "x " * 50_000
    none = F.array().cast("array<string>")
    c = factcheck.with_claims(spark.range(1), F.lit(long), none, none).first().claims
    assert [x.slot for x in c] == ["boundary"]


def test_names_behind_by_count_with_a_wicket(spark):
    rows = [("Khan drives, by Smith", record()), ("caught by Smith", record(wicket=True, wicket_type="caught")), ("Smith bowls to Khan", record()), ("Khan drives by Smith plays", record())]
    d = factcheck.check(spark.createDataFrame(rows, SCHEMA), "text")
    got = [sorted((c.tag, c.span) for c in r.claims if c.slot == "attribution") for r in d.collect()]
    assert got == [[("good", "Khan")], [("bad", "Smith")], [("bad", "Smith")], [("bad", "Smith"), ("good", "Khan")]]
    p = {r.slot: (r.n_claims, r.n_false, r.precision) for r in factcheck.slot_precision(d).collect()}
    assert p["attribution"] == (5, 3, 0.4) and p["wicket"] == (1, 0, 1.0)
    more = spark.createDataFrame([("attribution",)] * 9 + [("ner",)], "slot string")
    q = {r.slot: (r.n_claims, r.n_false, r.precision) for r in factcheck.slot_precision(d, extra=more).collect()}
    assert q["attribution"] == (5, 12, 0.0) and q["ner"] == (0, 1, None)
    e = factcheck.examples(d.withColumn("k", F.monotonically_increasing_id()), "violations", "text", ["k"], 2).collect()
    assert [r.text for r in e] == ["caught by Smith", "Smith bowls to Khan"]
    assert factcheck.recogniser_status(spark).first().status == "unavailable"


def record(**over):
    base = dict(batter="A Khan", bowler="B Lee", non_striker="C Roy", player_out="", fielders=[], squad=["A Khan", "B Lee", "C Roy", "D Smith"], runs_batter=0, runs_total=0, extras=0, extras_type="none", wicket=False, wicket_type="", team_score=45, team_wickets=2, batter_runs_after=12, completed_over_runs=None)
    return base | over


SCHEMA = "text string, record struct<batter:string,bowler:string,non_striker:string,player_out:string,fielders:array<string>,squad:array<string>,runs_batter:int,runs_total:int,extras:int,extras_type:string,wicket:boolean,wicket_type:string,team_score:int,team_wickets:int,batter_runs_after:int,completed_over_runs:int>"


def test_verification_and_rates(spark):
    rows = [
        ("Four through the covers", record(runs_batter=4, runs_total=4)),
        ("Played to mid-on", record(wicket=True, wicket_type="caught", player_out="A Khan")),
        ("Khan is caught behind", record()),
        ("Smith drives to long-off", record()),
        ("45/2 on the board", record()),
        ("50/2 on the board", record()),
        ("2 for 45 for the bowler", record()),
        ("bowled him!", record(wicket=True, wicket_type="caught", player_out="A Khan")),
        (None, record()),
    ]
    d = factcheck.check(spark.createDataFrame(rows, SCHEMA), "text")
    got = [[v.slot for v in r.violations] for r in d.collect()]
    assert got == [[], [], ["wicket"], ["attribution"], [], ["score"], [], ["dismissal_type"], []]
    three = factcheck.summary(factcheck.check(spark.createDataFrame(rows[:3], SCHEMA), "text")).first()
    assert (three.hallucination_rate, three.faithfulness_score, three.omission_rate) == (0.3333, 0.6667, 0.5)


def test_overlap_identities(spark):
    t = [("a b c d e f", "a b c d e f"), ("the cat runs home now today", "the cat runs home now today")]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(t)], "k int, g string, r string")
    assert abs(surface.bleu(d, "g", "r").first().bleu - 100) < 1e-9
    assert {r.rouge_l for r in surface.rouge_l(d, "g", "r", "k").collect()} == {1.0}
    e = spark.createDataFrame([(1, "x y z", "a b c"), (2, None, "a"), (3, "running runs", "run runs")], "k int, g string, r string")
    assert [r.rouge_l for r in surface.rouge_l(e, "g", "r", "k").orderBy("k").collect()] == [0.0, 0.0, 1.0]
    assert surface.bleu(e.filter("k = 1"), "g", "r").first().bleu == 0.0
    assert surface.lcs(list("abcbdab"), list("bdcaba")) == 4


def test_samples(spark):
    d = spark.createDataFrame([(i, "rare" if i < 3 else "often") for i in range(200)], "k int, c string")
    got = {r["c"]: r["count"] for r in sampling.stratified(d, "c", "k", 20, floor=4).groupBy("c").count().collect()}
    assert got["rare"] == 3 and sum(got.values()) == 20
    f = sampling.few_shot(d, "c", "k", 2)
    assert {r.c for r in f.collect()} == {"rare", "often"}
    a = d.withColumn("bad", F.col("c") == "rare").withColumn("worse", F.lit(False))
    assert sampling.annotation(a, ["bad", "worse"], "k", 30).filter("stratum = 'bad'").count() == 3


def test_run_leaves_and_rollup(spark):
    body = '{"run": {"name": "b_seed1", "system": "t"}, "metrics": {"a": {"x": 0.5, "y": {"status": "unavailable", "reason": "none"}}, "z": null}}'
    d = spark.createDataFrame([("r1", body), ("r2", body.replace("0.5", "1.5").replace("seed1", "seed2")), ("r3", "not json")], "run_dir string, body string")
    leaves = {(r.run_dir, r.path): (r.value, r.status) for r in runs.flatten(d).collect()}
    assert leaves["r1", "a.x"] == (0.5, None) and leaves["r1", "a.y"] == (None, "unavailable") and ("r1", "z") in leaves
    r = runs.results(d, {"x": "a.x"}).filter("base = 'b'").first()
    assert (r.seeds, r.x_mean, r.system) == (2, 1.0, "t") and abs(r.x_std - 0.70710678) < 1e-6


def test_entities_in_full(spark):
    from seamline.functions import html

    d = spark.createDataFrame([("a&eacute;&#8211;b <b>c</b>\u00a0d ",), (None,), ("",), ("&amp;lt;",)], "t string")
    assert [r.x for r in d.select(html.strip_html(F.col("t")).alias("x")).collect()] == ["aé–b c d", None, "", "&lt;"]


def test_chat_roles(spark):
    m = spark.range(1).select(generate.chat(F.lit("x"), F.lit("y")).alias("m")).first().m
    assert [t.role for t in m] == ["system", "user", "assistant"]


def test_self_bleu_draws_from_all_pairs(spark):
    from seamline.operators import diversity, surface

    assert sorted(diversity.pair_places(10, 50, "a")) == sorted((i, j) for j in range(10) for i in range(j))
    few = diversity.pair_places(1000, 50, "a")
    assert len(set(few)) == 50 and all(0 <= i < j < 1000 for i, j in few) and not diversity.pair_places(1, 50, "a")
    assert surface.sentence_bleu("a b".split(), "a b".split()) == 100 and surface.sentence_bleu(["a"], ["b"]) == 0 == surface.sentence_bleu([], ["a"])
    assert abs(surface.sentence_bleu("a b c d".split(), "a b x d".split()) - 100 * (3 / 4 * 1 / 3 * 1 / 4 * 1 / 4) ** 0.25) < 1e-9
    d = spark.createDataFrame([("m", 1, k, "same words in all of them") for k in range(10)] + [(None, 1, k, x) for k, x in enumerate(["x y", "u v"])] + [("one", 1, 0, "z")], "m string, i int, k int, text string")
    assert diversity.drawn_pairs(d, "text", ["m", "i"], ["k"]).groupBy("m").count().orderBy("count").collect() == [(None, 1), ("m", 45)]
    r = diversity.self_bleu(d, "text", ["m", "i"], ["k"]).first()
    assert r.pairs == 46 and abs(r.self_bleu - 45 / 46) < 1e-9
    assert diversity.self_bleu(d.filter("m = 'one'"), "text", ["m", "i"], ["k"]).first().self_bleu is None
