"""Nested match documents -> flat deliveries with cumulative state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.operators import state

_D = T.StructType(
    [
        T.StructField("batter", T.StringType()),
        T.StructField("bowler", T.StringType()),
        T.StructField("non_striker", T.StringType()),
        T.StructField("runs", T.StructType([T.StructField(c, T.IntegerType()) for c in ("batter", "extras", "total")])),
        T.StructField("extras", T.MapType(T.StringType(), T.IntegerType())),
        # a fielder is a record or a bare name: read as text, told apart below
        T.StructField("wickets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("player_out", T.StringType()), T.StructField("fielders", T.ArrayType(T.StringType()))]))),
    ]
)
MATCH = T.StructType(
    [
        T.StructField(
            "info",
            T.StructType(
                [
                    T.StructField("match_type", T.StringType()),
                    T.StructField("overs", T.IntegerType()),
                    T.StructField("teams", T.ArrayType(T.StringType())),
                    T.StructField("players", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
                ]
            ),
        ),
        T.StructField(
            "innings",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("team", T.StringType()),
                        T.StructField("super_over", T.BooleanType()),
                        T.StructField("target", T.StructType([T.StructField("runs", T.IntegerType()), T.StructField("overs", T.DoubleType())])),
                        T.StructField("overs", T.ArrayType(T.StructType([T.StructField("over", T.IntegerType()), T.StructField("deliveries", T.ArrayType(_D))]))),
                    ]
                )
            ),
        ),
    ]
)
NOT_OUT = ["retired hurt", "retired not out"]


def read_matches(spark: SparkSession, path: str, max_matches: int | None = None, kinds: tuple[str, ...] = ("T20", "IT20")) -> DataFrame:
    """(match_id, info, innings) of the documents under path, in the order of their names; the id is the file's stem."""
    d = spark.read.schema(MATCH).option("multiLine", True).json(path).withColumn("match_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    d = d.filter(F.col("info.match_type").isin(*kinds))
    return d.orderBy("match_id").limit(max_matches) if max_matches else d


def deliveries(matches: DataFrame) -> DataFrame:
    """One row a delivery in the canonical schema. Super overs go before innings are numbered; a match must have two teams."""
    c = F.col
    two = F.when(F.size("info.teams") == 2, c("info.teams")).otherwise(F.raise_error(F.concat(F.lit("not two teams in match "), c("match_id"))))
    squad = F.array_sort(F.array_distinct(F.flatten(F.map_values(F.coalesce("info.players", F.create_map().cast("map<string,array<string>>"))))))
    played = F.filter("innings", lambda x: ~F.coalesce(x["super_over"], F.lit(False)))
    m = matches.select("match_id", two.alias("teams"), squad.alias("squad"), F.coalesce("info.overs", F.lit(20)).alias("overs"), F.posexplode(played).alias("i", "inn"))
    m = m.select("match_id", "teams", "squad", "overs", (c("i") + 1).alias("innings"), c("inn.team").alias("batting_team"), c("inn.target.runs").alias("target"), F.explode("inn.overs").alias("o"))
    m = m.select("*", (c("o.over") + 1).alias("over_no"), F.posexplode("o.deliveries").alias("s", "d")).drop("o")
    extras = F.coalesce(c("d.extras"), F.create_map().cast("map<string,int>"))
    keys = F.map_keys(extras)
    counted = F.filter(F.coalesce(c("d.wickets"), F.array().cast(T.ArrayType(_D["wickets"].dataType.elementType))), lambda w: ~w["kind"].isin(NOT_OUT))
    first = F.get(counted, F.lit(0))
    who = F.transform(F.coalesce(first["fielders"], F.array().cast("array<string>")), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    bat, ext = F.coalesce("d.runs.batter", F.lit(0)), F.coalesce("d.runs.extras", F.lit(0))
    flat = m.select(
        "match_id",
        "innings",
        "over_no",
        (c("s") + 1).alias("delivery_seq"),
        ~(F.array_contains(keys, "wides") | F.array_contains(keys, "noballs")).alias("is_legal"),
        "batting_team",
        F.get(F.array_except("teams", F.array("batting_team")), F.lit(0)).alias("bowling_team"),
        c("d.batter").alias("batter"),
        c("d.bowler").alias("bowler"),
        F.coalesce("d.non_striker", F.lit("")).alias("non_striker"),
        bat.alias("runs_batter"),
        F.coalesce("d.runs.total", bat + ext).alias("runs_total"),
        ext.alias("extras"),
        F.coalesce(F.nullif(F.array_join(F.array_sort(keys), "+"), F.lit("")), F.lit("none")).alias("extras_type"),
        (F.size(counted) > 0).alias("wicket"),
        F.size(counted).alias("wickets_here"),
        F.coalesce(first["kind"], F.lit("")).alias("wicket_type"),
        F.coalesce(first["player_out"], F.lit("")).alias("player_out"),
        F.filter(who, lambda x: x.isNotNull()).alias("fielders"),
        "target",
        (c("overs") * 6).alias("innings_balls_total"),
        "squad",
    )
    return with_state(flat.withColumn("is_legal", ~(c("extras_type").rlike(r"(^|\+)(wides|noballs)(\+|$)"))))


def with_state(flat: DataFrame) -> DataFrame:
    """Adds the running columns. `wickets_here` may count several on one ball."""
    d = state.over_completion(state.running(flat))
    wk = F.sum("wickets_here").over(state._up_to_now())
    i = lambda c, n: F.col(c).cast("int").alias(n)
    return d.withColumn("wk", wk).select(
        *state.INNINGS, "over_no", i("ball_now", "ball"), "delivery_seq", "is_legal", "batting_team", "bowling_team", "batter", "bowler", "non_striker", "runs_batter", "runs_total",
        "extras", "extras_type", "wicket", "wicket_type", "player_out", "fielders", i("score_now", "team_score"), i("wk", "team_wickets"), "target", i("remaining_now", "balls_remaining"),
        i("bowled_now", "balls_bowled"), "innings_balls_total", i("batter_runs_now", "batter_runs_after"), i("batter_faced_now", "batter_balls_faced"), i("completed_now", "completed_over_runs"), "squad",
    )
