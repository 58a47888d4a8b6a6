import pytest
from pyspark.sql import functions as F

from seamline import session
from seamline.operators import build, generate, harness, sampling, state, stats, surface
from seamline.sources import commentary_csv, files, matches


@pytest.fixture(scope="module")
def balls(spark):
    return matches.with_state(files.simulate(spark, 3, overs=6)).cache()


def test_dataset_build_and_relinearized_equals_a_rebuild(spark, balls):
    line = generate.reference(F.col, lambda c: F.lit("death" if c == "phase" else 0.9))
    text = balls.select(*state.KEY, F.when(F.col("delivery_seq") == 1, None).otherwise(line).alias("text")).filter("over_no > 1")
    shares = {"train": 0.4, "val": 0.3, "test": 0.3}
    a = build.dataset(balls, text, shares).cache()
    assert a.count() == balls.count() and a.select("row_id").distinct().count() == a.count()
    s = {r.split: r for r in build.statistics(a).collect()}
    assert set(s) == {"train", "val", "test"} and sum(r.n_balls for r in s.values()) == balls.count() and all(r.n_matches <= 1 for r in s.values())
    assert sum(r.n_no_text for r in s.values()) == balls.filter("over_no = 1 OR delivery_seq = 1").count()
    k = build.kept(a)
    assert k.count() == sum(r.n_rows for r in s.values()) and k.filter("target_commentary IS NULL OR size(prev_outcomes) > 4").count() == 0
    b = build.dataset(balls, text, shares, context_balls=2)
    again = build.relinearized(a, 2).select("row_id", "linearized_input")
    assert again.exceptAll(b.select("row_id", "linearized_input")).count() == 0
    with pytest.raises(ValueError, match="labels"):
        build.dataset(balls, text, shares, context_balls=5)
    with pytest.raises(ValueError, match="no earlier labels"):
        build.relinearized(a.drop("prev_outcomes"), 1)
    with pytest.raises(ValueError, match="sum to 1"):
        build.dataset(balls, text, {"train": 0.5, "val": 0.3})
    assert build.dataset(balls.limit(0), text, shares).count() == 0


def test_evaluation_has_every_metric_and_status(spark, balls):
    f = lambda c: {"event_salience": F.rand(1), "tension": F.rand(2), "phase": F.lit("death")}[c]
    feats = F.struct(*[f(c).alias(c) for c in ("event_salience", "tension", "phase")])
    rows = balls.withColumn("record", F.struct(*build.RECORD)).withColumn("features", feats)
    rows = rows.withColumn("generation", generate.template(F.col, lambda c: F.col("features." + c))).withColumn("reference", F.concat(F.lit("In short: "), "generation")).withColumn("took", F.lit(0.5))
    rows = rows.select(*state.KEY, "record", "features", "generation", "reference", "took")
    got = {r.path: r for r in harness.evaluate(rows, state.INNINGS, ["over_no", "delivery_seq"], distinct=(1, 3), repeated=3, seconds="took").collect()}
    assert got["faithfulness.hallucination_rate"].value == 0 and got["faithfulness.ner"].status == "unavailable" and got["surface.bertscore"].status == "unavailable"
    assert {"diversity.distinct_3", "diversity.repetition_3gram_rate", "diversity.self_bleu", "surface.bleu", "surface.rouge_l", "latency.tokens_per_s"} <= set(got)
    assert got["latency.p50_ms"].value == 500 and 0 < got["surface.bleu"].value < 100
    off = {r.path: r.status for r in harness.evaluate(rows, state.INNINGS, ["over_no", "delivery_seq"], surface_metrics=False).collect()}
    assert off["surface.bleu"] == off["surface.bertscore"] == "disabled" and off["latency"] == "unavailable"
    with pytest.raises(LookupError):
        surface.bertscore_status("require")
    with pytest.raises(ValueError, match="nothing to evaluate"):
        harness.evaluate(rows.limit(0), state.INNINGS, ["over_no", "delivery_seq"])


def test_completeness_and_identity(spark, balls):
    ds = balls.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*state.KEY).alias("record"), F.lit("in").alias("linearized_input"), F.lit("ref").alias("target_commentary"), F.lit(1).alias("features"))
    g = balls.select(*state.KEY, F.lit("in").alias("linearized_input"), F.lit("ref").alias("reference"))
    assert harness.complete(g, ds, state.KEY) is g and harness.identical(g, ds, state.KEY) is g
    with pytest.raises(ValueError, match="no generation"):
        harness.complete(g.filter("over_no > 1"), ds, state.KEY)
    with pytest.raises(ValueError, match="other inputs"):
        harness.identical(g.withColumn("reference", F.lit("x")), ds, state.KEY)
    twice = ds.union(ds.withColumn("row_id", F.col("row_id") + 1).withColumn("features", F.lit(2)))
    assert {r.features for r in harness.aligned(g, twice.filter("row_id >= 0"), state.KEY).select("features").distinct().collect()} <= {1, 2}
    assert harness.aligned(g, twice, state.KEY).count() == g.count()


def test_splits_labels_and_categories(spark):
    d = spark.createDataFrame([("train", "y"), ("train", " No ")], "split string, human string")
    assert sampling.of_split(d, "train").count() == 2 == sampling.of_split(d, "all").count()
    with pytest.raises(ValueError, match="no rows"):
        sampling.of_split(d, "test")
    assert [r.human for r in stats.labelled(d, "human").collect()] == [True, False]
    for bad in ("", None, "maybe"):
        with pytest.raises(ValueError, match="y or n"):
            stats.labelled(d.union(spark.createDataFrame([("train", bad)], d.schema)), "human")
    x = spark.createDataFrame([(False, 0, 0, "death", None, 0.9), (False, 1, 1, "middle", 100, 0.7), (False, 1, 1, "middle", None, 0.7), (True, 6, 6, "death", 1, 0.0)], "w boolean, b int, t int, p string, g int, n double")
    c = [F.col(k) for k in "wbtpgn"]
    assert [r.c for r in x.select(sampling.category(*c).alias("c")).collect()] == ["dot_death", "tense_chase", None, "wicket"]


def test_csv_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffMatch,Over_Ball,Striker,Bowler,Runs,Text\nm,0.1,A,B,4,\"four, ok\"\nm,0.2,A,B,0,none\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("over,ball,batsman,bowler,runs,commentary,match_id\n1,3,C,B,1,single,m\n", encoding="utf-8")
    rows = commentary_csv.read_csvs(spark, str(tmp_path))
    got = commentary_csv.deliveries(rows).orderBy("over_no", "delivery_seq").collect()
    assert [(r.over_no, r.delivery_seq, r.batter, r.team_score) for r in got] == [(1, 1, "A", 4), (1, 2, "A", 4), (1, 3, "C", 5)]
    assert [r.text for r in commentary_csv.texts(rows).orderBy("delivery_seq").collect()] == ["four, ok", "none", "single"]
    (tmp_path / "c.csv").write_text("over,ball,batsman,bowler,runs,commentary\n")
    with pytest.raises(commentary_csv.ColumnMapError, match="no record"):
        commentary_csv.read_csvs(spark, str(tmp_path))
    (tmp_path / "c.csv").write_text("")
    with pytest.raises(commentary_csv.ColumnMapError, match="no header"):
        commentary_csv.read_csvs(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        commentary_csv.read_csvs(spark, str(tmp_path / "none"))


def test_bad_lines_are_named(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n{"a": 4}\n')
    with pytest.raises(files.JsonlError, match=r"x\.jsonl:4"):
        files.check_jsonl(spark, str(p), "a int")
    p.write_bytes(b'{"a": "\xe9"}\n')
    with pytest.raises(files.JsonlError, match="UTF-8"):
        files.check_jsonl(spark, str(p), "a string")
    p.write_text('{"a": 1}\n')
    assert files.check_jsonl(spark, str(p), "a int").count() == 1


def test_cut_tables_are_deleted(spark):
    from pathlib import Path

    with session.tables(spark):
        d = session.cut(spark.range(3), "gone")
        path = Path(session._WRITTEN[-1].removeprefix("file://"))
        assert d.count() == 3 and path.exists()
    assert not path.exists()


def test_leaves_of_any_depth_and_pages_that_refuse(spark):
    from seamline.operators import runs

    deep = '{"metrics": {"a": {"b": {"c": {"d": {"e": {"f": 1.5}}}}}, "g": 2}}'
    d = spark.createDataFrame([("r", deep), ("s", None), ("t", "{}")], "run_dir string, body string")
    assert {(r.path, r.value) for r in runs.flatten(d).collect()} == {("a.b.c.d.e.f", 1.5), ("g", 2.0)}
    many = spark.range(10_001).select(F.col("id").cast("string").alias("path"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("reason"))
    with pytest.raises(ValueError, match="no page"):
        files.report(many, "x")
