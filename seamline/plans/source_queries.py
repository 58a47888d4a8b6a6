"""Queries over sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seamline.functions import rules
from seamline.operators import build, state
from seamline.plans import text_queries
from seamline.plans.ball_queries import BALLS
from seamline.session import read_table as t
from seamline.session import shared_dir
from seamline.sources import commentary_csv, files, matches
from seamline.streaming import live


def simulated(spark, d):
    """as many made-up matches as there are infos; state must add up: the second innings' target is the first's total plus one"""
    n = t(spark, d, "match_info").count()
    x = matches.with_state(files.simulate(spark, n))
    y = x.groupBy("match_id", "innings").agg(F.max("team_score").alias("score"), F.max("team_wickets").alias("wickets"), F.max("target").alias("target"), F.count_if("is_legal").alias("legal"))
    one = y.filter("innings = 1").select("match_id", (F.col("score") + 1).alias("t"))
    return y.filter("innings = 2").join(one, "match_id").agg(F.count("*").alias("n_matches"), F.count_if(F.col("t") != F.col("target")).alias("n_wrong"), F.count_if((F.col("wickets") > 10) | (F.col("legal") > 120)).alias("n_beyond"))


def jsonl_round_trip(spark, d):
    x = state.latest(t(spark, d, "deliveries")).drop("loaded_at")
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    n = files.write_jsonl(x, path)
    back = files.read_jsonl(spark, path, x.schema)
    same = back.exceptAll(x).count() + x.exceptAll(back).count()
    return spark.createDataFrame([(n, same)], "n_rows long, n_changed long")


def _stream(spark, d, plan, mode: str):
    """run a stream over the whole table until it has read all, and return what it wrote"""
    src = spark.readStream.schema(t(spark, d, "deliveries").schema).parquet(f"{d}/deliveries*.parquet")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch, no: int) -> None:
        batch.withColumn("batch", F.lit(no)).write.mode("append").parquet(base + "/out")

    q = plan(src).writeStream.outputMode(mode).option("checkpointLocation", base + "/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(base + "/out")


def stream_live(spark, d):
    out = _stream(spark, d, live.live_state, "update")
    last = out.groupBy("match_id", "innings").agg(F.max_by(F.struct("balls", "score", "wickets", "momentum", "run_rate"), "batch").alias("s"))
    return last.select("match_id", "innings", "s.balls", "s.score", "s.wickets", "s.momentum", rules.scaled(F.col("s.run_rate"), 2).alias("rate_centi"))


def stream_arrivals(spark, d):
    out = _stream(spark, d, live.arrivals, "update")
    last = out.groupBy("day").agg(F.max_by(F.struct("n_balls", "runs"), "batch").alias("s"))
    return last.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "s.n_balls", "s.runs")


def running_from_primitives(spark, d):
    """stored state against the state recomputed from the balls: rows that differ, by column"""
    x = state.over_completion(state.running(state.latest(t(spark, d, "deliveries"))))
    c = lambda a, b: F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    return x.agg(F.count("*").alias("n_rows"), c("team_score", "score_now").alias("score"), c("team_wickets", "wickets_now").alias("wickets"), c("balls_bowled", "bowled_now").alias("bowled"), c("ball", "ball_now").alias("ball"), c("batter_runs_after", "batter_runs_now").alias("batter_runs"))


INGESTED = ["match_id", "innings", "over_no", "delivery_seq", "ball", "is_legal", "batting_team", "batter", "runs_batter", "runs_total", "extras", "extras_type", "wicket", "team_score", "team_wickets", "balls_bowled", "balls_remaining", "batter_runs_after", "batter_balls_faced", "completed_over_runs"]


def json_ingest(spark, d):
    """every innings as a nested document of its own, written as JSON files and read back as deliveries"""
    b = state.latest(t(spark, d, "deliveries"))
    kinds = F.split("extras_type", r"\+")
    extras = F.when(F.col("extras_type") != "none", F.map_from_arrays(kinds, F.transform(kinds, lambda k, i: F.when(i == 0, F.col("extras")).otherwise(F.lit(0)))))
    fielder = F.transform(F.coalesce("fielders", F.array().cast("array<string>")), lambda x: F.struct(x.alias("name")))
    wicket = F.when(F.col("wicket"), F.array(F.struct(F.col("wicket_type").alias("kind"), "player_out", fielder.alias("fielders"))))
    ball = F.struct("batter", "bowler", "non_striker", F.struct(F.col("runs_batter").alias("batter"), F.col("extras").alias("extras"), F.col("runs_total").alias("total")).alias("runs"), extras.alias("extras"), wicket.alias("wickets"))
    sides = [F.min(c).alias(c) for c in ("batting_team", "bowling_team", "target")]
    # an innings has a bounded number of balls: it is one document by its nature
    over = b.groupBy("match_id", "innings", "over_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("delivery_seq", ball.alias("d"))), lambda x, y: x["delivery_seq"] - y["delivery_seq"]), lambda x: x["d"]).alias("deliveries"), *sides)
    inn = over.groupBy("match_id", "innings").agg(F.array_sort(F.collect_list(F.struct((F.col("over_no") - 1).alias("over"), "deliveries")), lambda x, y: x["over"] - y["over"]).alias("overs"), *sides)
    info = F.struct(F.lit("T20").alias("match_type"), F.lit(20).alias("overs"), F.array("batting_team", "bowling_team").alias("teams"))
    doc = inn.select(F.concat("match_id", F.lit("|"), "innings").alias("match_id"), info.alias("info"), F.array(F.struct(F.col("batting_team").alias("team"), F.struct(F.col("target").alias("runs")).alias("target"), "overs")).alias("innings"))
    path = f"{shared_dir(spark)}/matches-{uuid.uuid4().hex}"
    doc.write.json(path)
    back = spark.read.schema(StructType([StructField("match_id", StringType()), *matches.MATCH.fields])).json(path)
    return matches.deliveries(back).select(*INGESTED)


def csv_ingest(spark, d):
    """deliveries written as CSV files of two writings (other headers, positions combined or apart), read back by aliases;
    ids are bracketed, as the loader trims them"""
    b = state.latest(t(spark, d, "deliveries")).withColumn("match_id", F.concat(F.lit("["), "match_id", F.lit("]")))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    n = F.col
    common = {"extra_runs": n("extras"), "Kind_of_Extras": n("extras_type"), "batsman": n("batter"), "bowler": n("bowler"), "batsman_runs": n("runs_batter"), "dismissal_kind": n("wicket_type"), "player_dismissed": n("player_out"), "Comment": F.lit("a, \"b\""), "team": n("batting_team")}
    one = {"Match": n("match_id"), "INNINGS": n("innings"), "over.ball": F.concat((n("over_no") - 1).cast("string"), F.lit("."), n("ball").cast("string")), "total_runs": n("runs_total"), **common}
    two = {"striker" if k == "batsman" else k: v for k, v in common.items()} | {"matchid": n("match_id"), "inning": n("innings"), "over": n("over_no"), "ball": n("ball"), "runs": n("runs_total")}
    half = F.pmod(F.xxhash64("match_id"), F.lit(2))
    for k, cols in enumerate((one, two)):
        part = b.filter(half == k).repartition("match_id").sortWithinPartitions("match_id", "innings", "over_no", "delivery_seq")
        part.select(*[c.alias(h) for h, c in cols.items()]).write.option("header", True).option("quote", '"').option("escape", '"').mode("append").csv(path)
    return commentary_csv.deliveries(commentary_csv.read_csvs(spark, path)).select(*INGESTED)


def dataset_build(spark, d):
    """balls, features, texts, splits and cleaning in one; counted per split"""
    text = t(spark, d, "dataset").groupBy(*[F.col("record." + k).alias(k) for k in state.KEY]).agg(F.min("target_commentary").alias("text"))
    rows = build.dataset(state.latest(t(spark, d, "deliveries")), text, {"train": 0.8, "val": 0.1, "test": 0.1})
    return build.statistics(rows)


QUERIES = {
    "json_match_ingest": json_ingest,
    "csv_alias_ingest": csv_ingest,
    "dataset_build": dataset_build,
    "simulated_matches": simulated,
    "jsonl_round_trip": jsonl_round_trip,
    "stream_live_state": stream_live,
    "stream_arrivals": stream_arrivals,
    "state_consistency": running_from_primitives,
}
U = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_LADDER = "CASE WHEN extras <= 0 THEN 'none' WHEN regexp_matches(k, 'wide|wd') THEN 'wides' WHEN regexp_matches(k, 'noball|no ball|no-ball|nb') THEN 'noballs' WHEN contains(k, 'bye') AND contains(k, 'leg') THEN 'legbyes' WHEN contains(k, 'bye') THEN 'byes' WHEN contains(k, 'penalty') THEN 'penalty' ELSE 'byes' END"


def _ingest_sql(source: str) -> str:
    """source: a CTE b(match_id, innings, over_no, seq, batting_team, batter, runs_batter, runs_total, extras, extras_type, is_legal, wicket)"""
    w, o, p = (f"OVER (PARTITION BY match_id, innings{x} ORDER BY over_no, seq {U})" for x in ("", ", over_no", ", batter"))
    return f"""{BALLS}, {source}, r AS (SELECT *, row_number() OVER (PARTITION BY match_id, innings, over_no ORDER BY seq) AS delivery_seq, sum(runs_total) {w} AS s, sum(wicket::int) {w} AS k, sum(is_legal::int) {w} AS bb,
 sum(is_legal::int) {o} AS l, sum(runs_total) {o} AS orr, sum(runs_batter) {p} AS br, sum(is_legal::int) {p} AS bf, max(CASE WHEN is_legal THEN seq END) OVER (PARTITION BY match_id, innings, over_no) AS z FROM b)
 SELECT match_id, innings::int AS innings, over_no::int AS over_no, delivery_seq::int AS delivery_seq, least(l + CASE WHEN is_legal THEN 0 ELSE 1 END, 6)::int AS ball, is_legal, batting_team, batter, runs_batter::int AS runs_batter,
 runs_total::int AS runs_total, extras::int AS extras, extras_type, wicket, s::int AS team_score, k::int AS team_wickets, bb::int AS balls_bowled, greatest(120 - bb, 0)::int AS balls_remaining, br::int AS batter_runs_after,
 bf::int AS batter_balls_faced, CASE WHEN l = 6 AND seq = z THEN orr END::int AS completed_over_runs FROM r"""


_KEYS = "list_sort(string_split(extras_type, '+'))"


ORACLE = {
    "json_match_ingest": _ingest_sql(
        f"""b AS (SELECT match_id || '|' || innings AS match_id, 1 AS innings, over_no, delivery_seq AS seq, min(batting_team) OVER (PARTITION BY match_id, innings) AS batting_team, batter, runs_batter, runs_total, extras,
 array_to_string({_KEYS}, '+') AS extras_type, NOT regexp_matches(extras_type, '(^|[+])(wides|noballs)([+]|$)') AS is_legal, wicket AND wicket_type NOT IN ('retired hurt', 'retired not out') AS wicket FROM balls)"""
    ),
    "csv_alias_ingest": _ingest_sql(
        f"""a AS (SELECT *, lower(trim(extras_type)) AS k FROM balls), c AS (SELECT *, {_LADDER} AS x FROM a), b AS (SELECT '[' || match_id || ']' AS match_id, dense_rank() OVER (PARTITION BY match_id ORDER BY innings) AS innings, over_no, delivery_seq AS seq, batting_team,
 batter, runs_batter, runs_total, extras, x AS extras_type, x NOT IN ('wides', 'noballs') AS is_legal, lower(trim(coalesce(wicket_type, ''))) NOT IN ('', 'nan', 'none', 'not out') AS wicket FROM c)"""
    ),
    "dataset_build": f"""{BALLS}, g AS (SELECT DISTINCT match_id FROM balls WHERE match_id IS NOT NULL), gr AS (SELECT match_id, row_number() OVER (ORDER BY sha256('13|' || match_id)) - 1 AS r FROM g),
 gn AS (SELECT count(*) AS n, greatest(floor(count(*) * 0.1::double)::bigint, 1) AS k FROM g), sp AS (SELECT match_id, CASE WHEN r < n - 2 * k THEN 'train' WHEN r < n - k THEN 'val' ELSE 'test' END AS split FROM gr, gn),
 tx AS (SELECT record.match_id AS match_id, record.innings AS innings, record.over_no AS over_no, record.delivery_seq AS delivery_seq, min(target_commentary) AS raw FROM dataset GROUP BY 1, 2, 3, 4),
 j AS (SELECT b.*, tx.raw, sp.split FROM balls b JOIN sp USING (match_id) LEFT JOIN tx USING (match_id, innings, over_no, delivery_seq)),
 a AS (SELECT *, {text_queries.STRIP.replace("(text,", "(coalesce(raw, ''),")} AS text, list_filter(list_distinct([{text_queries.SURNAME} FOR x IN list_concat([batter, bowler, non_striker, player_out], coalesce(fielders, []))]), lambda y: y <> '') AS inv,
  list_filter(list_distinct([{text_queries.SURNAME} FOR x IN coalesce(squad, [])]), lambda y: y <> '') AS sq FROM j),
 w AS (SELECT *, regexp_extract_all(text, '[A-Z][a-z]+') AS w, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS n FROM a),
 c AS (SELECT *, CASE WHEN raw IS NULL THEN 'no_text' WHEN text = '' THEN 'empty' WHEN n < 4 THEN 'too_short' WHEN n > 80 THEN 'too_long' WHEN list_has_any(w, list_filter(sq, lambda y: NOT list_contains(inv, y))) AND NOT list_has_any(w, inv) THEN 'entity_mismatch' END AS reason FROM w),
 e AS (SELECT *, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL, lower(text) ORDER BY match_id, innings, over_no, delivery_seq) > 1 THEN 'duplicate' END) AS why FROM c)
 SELECT split, count(*) AS n_balls, count(*) FILTER (why IS NULL) AS n_rows, count(DISTINCT CASE WHEN why IS NULL THEN match_id END) AS n_matches, {", ".join(f"count(*) FILTER (why = '{r}') AS n_{r}" for r in ("no_text", "empty", "too_short", "too_long", "entity_mismatch", "duplicate"))} FROM e GROUP BY split""",
    "simulated_matches": "SELECT count(*) AS n_matches, 0 AS n_wrong, 0 AS n_beyond FROM match_info",
    "jsonl_round_trip": f"{BALLS} SELECT count(*) AS n_rows, 0 AS n_changed FROM balls",
    "stream_live_state": f"""{BALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY match_id, innings ORDER BY over_no DESC, delivery_seq DESC) AS back FROM balls)
 SELECT match_id, innings, count(*) AS balls, cast(sum(runs_total) AS bigint) AS score, cast(sum(wicket::int) AS bigint) AS wickets, cast(sum(runs_total) FILTER (back <= 12) AS bigint) AS momentum,
 cast(coalesce(floor(sum(runs_total) * 6.0::double / nullif(sum(is_legal::int), 0) * 100 + 0.5), 0) AS bigint) AS rate_centi FROM n GROUP BY 1, 2""",
    "stream_arrivals": "SELECT strftime(loaded_at, '%Y-%m-%d') AS day, count(*) AS n_balls, cast(sum(runs_total) AS bigint) AS runs FROM deliveries WHERE loaded_at IS NOT NULL GROUP BY 1",
    "state_consistency": f"""{BALLS}, r AS (SELECT *, sum(runs_total) OVER w AS s, sum(wicket::int) OVER w AS k, sum(is_legal::int) OVER w AS b, sum(is_legal::int) OVER (PARTITION BY match_id, innings, over_no ORDER BY delivery_seq {U}) AS l,
 sum(runs_batter) OVER (PARTITION BY match_id, innings, batter ORDER BY over_no, delivery_seq {U}) AS p FROM balls WINDOW w AS (PARTITION BY match_id, innings ORDER BY over_no, delivery_seq {U}))
 SELECT count(*) AS n_rows, count(*) FILTER (team_score IS DISTINCT FROM s) AS score, count(*) FILTER (team_wickets IS DISTINCT FROM k) AS wickets, count(*) FILTER (balls_bowled IS DISTINCT FROM b) AS bowled,
 count(*) FILTER (ball IS DISTINCT FROM least(l + CASE WHEN is_legal THEN 0 ELSE 1 END, 6)) AS ball, count(*) FILTER (batter_runs_after IS DISTINCT FROM p) AS batter_runs FROM r""",
}
