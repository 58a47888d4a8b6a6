"""Raw lines of commentary CSV feeds -> rows that load, and rows set apart with the reason.

Strict load plus anti-join: each line keeps its offset (line_id); the strict load takes only lines
that split into as many fields as their file's header, whose position is a ball, whose total is a
whole number and whose extras are of a known kind; the loaded offsets are subtracted from the raw
ones; only the remainder is diagnosed.

Defined results: a null line counts as an empty record; a line of a file without a header has the
reason `columns`; blank totals and extras kinds load; an empty table gives empty results; a repeated
line keeps its own line_id and is judged by itself; other columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import records as R
from seamline.session import cut

# Header names accepted for each logical field, in order of preference.
ALIASES: dict[str, list[str]] = {
    "match_id": ["match_id", "matchid", "match", "match_no", "match_name"],
    "innings": ["innings", "inning", "innings_no"],
    "over_ball": ["over_ball", "over.ball", "ball_no"],
    "over": ["over", "over_no", "overs"],
    "ball": ["ball", "ball_in_over", "delivery"],
    "batting_team": ["batting_team", "battingteam", "team_batting", "team"],
    "batter": ["batter", "batsman", "striker", "batsman_name"],
    "bowler": ["bowler", "bowler_name"],
    "non_striker": ["non_striker", "nonstriker", "non_striker_name"],
    "runs_batter": ["runs_batter", "batsman_runs", "runs_off_bat", "batter_runs"],
    "runs_total": ["runs_total", "total_runs", "runs", "total_run"],
    "extras": ["extras", "extra_runs", "extras_run"],
    "extras_type": ["extras_type", "extra_type", "kind_of_extras"],
    "wicket": ["wicket", "is_wicket", "iswicket", "wicket_fallen"],
    "wicket_type": ["wicket_type", "dismissal_kind", "kind", "dismissal"],
    "player_out": ["player_out", "player_dismissed", "dismissed_player"],
    "commentary": ["commentary", "commentary_text", "text", "comment", "description"],
}

DOTTED, DASHED, PACKED = r"^(1?[0-9])\.[1-6]$", r"^(1?[0-9])-[1-6]$", r"^(1?[0-9])?0?[1-6]$"
WHOLE = r"^\+?[0-9]+(\.0*)?$"
#: kinds the loader can tell, anywhere in the value
KIND = r"wide|wd|noball|no ball|no-ball|nb|bye|penalty"
NO_KIND = ["", "none", "nan"]


def first_alias(names: Column, field: str) -> Column:
    """1-based place of the first alias present, else null"""
    places = [F.nullif(F.array_position(names, a), F.lit(0)) for a in ALIASES[field]]
    return F.coalesce(*places).cast("int")


def _mode(c: Column, pattern: str) -> Column:
    return F.count_if(F.trim(c).rlike(pattern))


def headers(lines: DataFrame) -> DataFrame:
    """(feed, file_name, names): by each file's line 1; of two such lines the one of lower line_id holds."""
    h = lines.filter("line_no = 1").groupBy("feed", "file_name").agg(F.min_by("line", "line_id").alias("line"))
    return h.select("feed", "file_name", R.header_names(F.coalesce("line", F.lit(""))).alias("names"))


def split_lines(lines: DataFrame) -> DataFrame:
    """Data lines with `names` of their file, `strict`, and `f`, their fields (null unless strict)."""
    body = lines.filter("line_no IS NULL OR line_no <> 1").withColumn("bare", R.bare_line(F.coalesce("line", F.lit(""))))
    body = body.withColumn("strict", R.is_strict(F.col("bare"))).withColumn("f", F.when(F.col("strict"), R.fields(F.col("bare"))))
    return body.join(headers(lines), ["feed", "file_name"], "left")


def layouts(split: DataFrame) -> DataFrame:
    """For each file where the checked values stand: (feed, file_name, at_pos, at_over, at_ball, at_total, at_kind, style).

    Known names first. Where a file uses none of them, the column whose values are of that sort in
    most of the file's lines is taken: one aggregation over (file, column), no file is gathered. The
    style of a combined position is the file's most frequent one.
    """
    n = F.col("names")
    known = {"at_pos": "over_ball", "at_over": "over", "at_ball": "ball", "at_total": "runs_total", "at_kind": "extras_type"}
    cells = (
        split.filter(F.col("strict") & (F.size("f") == F.size("names")))
        .select("feed", "file_name", F.posexplode(F.arrays_zip(F.col("names").alias("name"), F.col("f").alias("v"))).alias("p", "c"))
        .select("feed", "file_name", (F.col("p") + 1).alias("p"), F.col("c.name").alias("name"), F.trim("c.v").alias("v"))
    )
    low = F.lower("v")
    stat = cells.groupBy("feed", "file_name", "p", "name").agg(
        F.count("*").alias("n"),
        _mode(F.col("v"), DOTTED).alias("dotted"),
        _mode(F.col("v"), DASHED).alias("dashed"),
        _mode(F.col("v"), r"^(1?[0-9])0[1-6]$").alias("packed"),
        F.count_if(low.rlike(KIND)).alias("kinds"),
        F.count_if(low.isin(NO_KIND)).alias("nothing"),
        F.count_if(F.col("v").rlike(WHOLE) & (F.length("v") <= 3)).alias("small"),
        F.avg(F.when(F.col("v").rlike(WHOLE), F.col("v").cast("double"))).alias("mean"),
    )
    pos = F.greatest("dotted", "dashed", "packed")
    named = F.array(*[F.lit(a) for f in ("runs_batter", "extras", "innings", "over", "ball", "wicket") for a in ALIASES[f]])
    per = stat.groupBy("feed", "file_name").agg(
        F.max_by("p", F.when(pos * 2 > F.col("n"), pos)).alias("g_pos"),
        F.max_by("p", F.when((F.col("kinds") > 0) & ((F.col("kinds") + F.col("nothing")) * 10 > F.col("n") * 8), F.col("kinds"))).alias("g_kind"),
        F.max_by("p", F.when((F.col("small") * 10 > F.col("n") * 6) & ~F.array_contains(named, F.col("name")) & F.col("name").rlike("run|tot|score"), F.col("mean"))).alias("g_total"),
        F.collect_list(F.struct("p", "dotted", "dashed", "packed")).alias("stats"),
    )
    files = split.groupBy("feed", "file_name").agg(F.first("names").alias("names")).join(per, ["feed", "file_name"], "left")
    for k, field in known.items():
        files = files.withColumn(k, first_alias(n, field))
    files = files.withColumn("at_pos", F.coalesce("at_pos", F.when(F.col("at_over").isNull(), F.col("g_pos"))))
    files = files.withColumn("at_kind", F.coalesce("at_kind", "g_kind")).withColumn("at_total", F.coalesce("at_total", "g_total"))
    files = files.withColumn("s", F.when(F.size("stats") > 0, F.get(F.filter("stats", lambda x: x["p"] == F.col("at_pos")), 0)))
    style = F.when((F.col("s.packed") > F.col("s.dotted")) & (F.col("s.packed") > F.col("s.dashed")), "packed").when(F.col("s.dashed") > F.col("s.dotted"), "dashed").otherwise("dotted")
    return files.select("feed", "file_name", *known, style.alias("style"))


def _value(at: str) -> Column:
    return F.trim(F.get(F.col("f"), F.col(at) - 1))


def _ball_ok() -> Column:
    v = _value("at_pos")
    combined = F.when(F.col("style") == "packed", v.rlike(PACKED)).when(F.col("style") == "dashed", v.rlike(DASHED)).otherwise(v.rlike(DOTTED))
    apart = _value("at_over").rlike(r"^0*([1-9]|1[0-9]|20)(\.0+)?$") & _value("at_ball").rlike(r"^0*[1-6](\.0+)?$")
    return F.coalesce(F.when(F.col("at_pos").isNotNull(), combined).otherwise(apart), F.lit(False))


def _total_ok() -> Column:
    v = _value("at_total")
    return F.col("at_total").isNull() | (v == "") | v.rlike(WHOLE)


def _kind_ok() -> Column:
    v = F.lower(_value("at_kind"))
    return F.col("at_kind").isNull() | v.isin(NO_KIND) | v.rlike(KIND)


def _width_ok() -> Column:
    return F.coalesce(F.size("f") == F.size("names"), F.lit(False))


def split_table(lines: DataFrame) -> DataFrame:
    """split_lines written once, as the layouts, the load and the diagnosis all read it; a file's header is looked up, not repeated in every line"""
    return cut(split_lines(lines).select("line_id", "feed", "file_name", "file_seq", "line_no", "names", "strict", "f"), "split")


def located(split: DataFrame) -> DataFrame:
    """split_lines with where each file has the checked values"""
    return split.join(layouts(split), ["feed", "file_name"], "left")


def _loaded(split: DataFrame) -> DataFrame:
    good = F.col("strict") & _width_ok() & _ball_ok() & _total_ok() & _kind_ok()
    return located(split).filter(good).select("line_id", "feed", "file_name", "file_seq", "line_no", "names", "f", "at_pos", "at_total", "at_kind")


def strict_load(lines: DataFrame) -> DataFrame:
    """The conforming lines only: (line_id, feed, file_name, file_seq, line_no, names, f, at_pos, at_total, at_kind)."""
    return _loaded(split_table(lines))


def rejects(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of every data line that does not load; the first reason that applies.

    What the load took is subtracted from the raw offsets; only the rest is joined with its file's layout and diagnosed."""
    split = split_table(lines)
    at = cut(layouts(split), "layouts")
    placed = split.join(at, ["feed", "file_name"], "left")
    good = F.col("strict") & _width_ok() & _ball_ok() & _total_ok() & _kind_ok()
    loaded = placed.filter(good).select("line_id")
    rest = split.join(loaded, "line_id", "left_anti").join(at, ["feed", "file_name"], "left")
    reason = (
        F.when(~F.col("strict"), "quoting")
        .when(~_width_ok(), "columns")
        .when(~_ball_ok(), "over_ball")
        .when(~F.coalesce(_total_ok(), F.lit(False)), "runs_total")
        .otherwise("extras_type")
    )
    return rest.select("line_id", reason.alias("reason"))
