"""Texts from records: a template generator, prompts and chat forms. Every variant is picked by a keyed hash."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import rules

PLAIN = {
    "six": ["{batter} clears the ropes off {bowler}, six.", "Six from {batter}, all the way.", "{batter} lofts {bowler} for six."],
    "four": ["{batter} finds the gap, four.", "Four to {batter} off {bowler}.", "{batter} beats the infield for four."],
    "dot": ["{bowler} to {batter}, no run.", "No run, {batter} defends.", "Dot ball from {bowler}."],
    "runs": ["{batter} takes {runs}.", "{Runs} for {batter} off {bowler}.", "They come back for {runs}."],
    "bowled": ["{batter} is bowled by {bowler}.", "{bowler} bowled {batter}."],
    "caught": ["{batter} is caught{by} off {bowler}.", "{batter} caught{by}, {bowler} has the wicket."],
    "lbw": ["{batter} is lbw to {bowler}.", "{bowler} has {batter} lbw."],
    "run out": ["{out} is run out{by}.", "Run out, {out} has to go."],
    "stumped": ["{batter} is stumped{by} off {bowler}.", "{batter} stumped, {bowler} strikes."],
    "wides": ["{bowler} bowls a wide.", "Wide down the leg side from {bowler}."],
    "noballs": ["No ball from {bowler}.", "{bowler} oversteps for a no ball."],
    "byes": ["They steal byes.", "Byes past the keeper."],
    "legbyes": ["Leg byes off the pad.", "They run leg byes."],
    "penalty": ["Penalty runs are given."],
    "no ball six": ["No ball from {bowler} and {batter} hits it for six."],
    "no ball four": ["No ball from {bowler} and {batter} hits it for four."],
}
EXCITED = {
    "six": ["SIX! What a blow from {batter} off {bowler}!", "Massive from {batter}, six into the stands!"],
    "four": ["FOUR! {batter} races it away off {bowler}!", "Superb from {batter}, four!"],
    "dot": ["Dot ball! {bowler} holds firm!", "No run! {batter} cannot score off {bowler}!"],
    "runs": ["{batter} scrambles {runs}!", "{Runs} to {batter}, vital!"],
    "bowled": ["BOWLED! {bowler} beats {batter} all ends up!"],
    "caught": ["CAUGHT{by}! {batter} falls to {bowler}!"],
    "lbw": ["LBW! {bowler} has {batter}!"],
    "run out": ["RUN OUT! {out} is short{by}!"],
    "stumped": ["STUMPED! {batter} is gone, {bowler} roars!"],
}


def _pick(pool: list[str], u: Column) -> Column:
    """one of the pool by a uniform draw"""
    return F.element_at(F.array(*[F.lit(x) for x in pool]), F.floor(u * len(pool)).cast("int") + 1)


def _what(r: Callable[[str], Column]) -> Column:
    """which pool a ball takes its line from: wicket, then a boundary off a no-ball, extras, six, four, dot, runs"""
    bat = r("runs_batter")
    wt = F.when(r("wicket_type").isin("bowled", "caught", "lbw", "run out", "stumped"), r("wicket_type")).otherwise("caught")
    kind = F.split_part(r("extras_type"), F.lit("+"), F.lit(1))
    return (
        F.when(r("wicket"), wt)
        .when(r("extras_type").contains("noballs") & (bat == 6), "no ball six")
        .when(r("extras_type").contains("noballs") & (bat == 4), "no ball four")
        .when(r("extras_type") != "none", F.when(kind.isin("wides", "noballs", "byes", "legbyes", "penalty"), kind).otherwise("penalty"))
        .when(bat == 6, "six")
        .when(bat == 4, "four")
        .when(r("runs_total") == 0, "dot")
        .otherwise("runs")
    )


def _filled(line: Column, r: Callable[[str], Column]) -> Column:
    """the line with the record's names and runs in its places"""
    bat = r("runs_batter")
    word = F.when(bat == 1, "a single").when(bat == 2, "two runs").when(bat == 3, "three runs").when(bat == 5, "five runs").otherwise(F.concat(bat.cast("string"), F.lit(" runs")))
    fielder = F.get(r("fielders"), F.lit(0))
    slots = {
        "{batter}": r("batter"),
        "{bowler}": r("bowler"),
        "{out}": F.coalesce(F.nullif(r("player_out"), F.lit("")), r("batter")),
        "{by}": F.when(F.coalesce(fielder, F.lit("")) != "", F.concat(F.lit(" by "), fielder)).otherwise(""),
        "{runs}": word,
        "{Runs}": F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2))),
    }
    for k, v in slots.items():
        line = F.replace(line, F.lit(k), F.coalesce(v, F.lit("")))
    return line


def template(r: Callable[[str], Column], f: Callable[[str], Column], seed: str = "13", use_game_state: bool = True, gate: float = 0.45) -> Column:
    """A line for each ball: wicket, then a boundary off a no-ball, extras, six, four, dot, runs; excited where
    salience times tension passes the gate; milestones (a hundred before a fifty); the score in a fifth of the lines."""
    key = [F.lit(seed), r("match_id"), r("innings").cast("string"), r("over_no").cast("string"), r("delivery_seq").cast("string")]
    u = rules.uniform(*key, F.lit("variant"))
    bat, after = r("runs_batter"), r("batter_runs_after")
    what = _what(r)
    hot = F.coalesce(f("event_salience") * f("tension") > gate, F.lit(False)) if use_game_state else F.lit(False)
    line = None
    for name, pool in PLAIN.items():
        cold = _pick(pool, u)
        this = F.when(hot, _pick(EXCITED[name], u)).otherwise(cold) if name in EXCITED else cold
        line = F.when(what == name, this) if line is None else line.when(what == name, this)
    line = _filled(line, r)
    crossed = lambda m: (after >= m) & (after - bat < m)
    mile = F.when(crossed(100), F.concat(F.lit("A century for "), r("batter"), F.lit("."))).when(crossed(50), F.concat(F.lit("Fifty for "), r("batter"), F.lit(".")))
    score = F.when(rules.uniform(*key, F.lit("score")) < 0.2, F.concat(F.lit("Score "), r("team_score").cast("string"), F.lit("/"), r("team_wickets").cast("string"), F.lit(".")))
    return F.concat_ws(" ", line, mile, score)


def normal(*key: Column) -> Column:
    """a repeatable draw from the standard normal distribution, of two uniform ones (Box and Muller)"""
    u, v = rules.uniform(*key, F.lit("radius")), rules.uniform(*key, F.lit("angle"))
    return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * math.pi * v)


def reference(r: Callable[[str], Column], f: Callable[[str], Column], seed: str = "13") -> Column:
    """A line as a person might write it: excited by salience times tension with some noise, the score in about a fifth of
    the lines, milestones, and what a chase still needs in a third of its last overs. States nothing but the record."""
    key = [F.lit(seed), r("match_id"), r("innings").cast("string"), r("over_no").cast("string"), r("delivery_seq").cast("string"), F.lit("ref")]
    u = rules.uniform(*key, F.lit("variant"))
    heat = F.coalesce(f("event_salience") * f("tension"), F.lit(0.0)) * 1.7 + 0.18 * normal(*key)
    what = _what(r)
    line = None
    for name, pool in PLAIN.items():
        this = F.when(heat > 0.45, _pick(EXCITED[name], u)).otherwise(_pick(pool, u)) if name in EXCITED else _pick(pool, u)
        line = F.when(what == name, this) if line is None else line.when(what == name, this)
    need = r("target") - r("team_score")
    after, bat = r("batter_runs_after"), r("runs_batter")
    crossed = lambda m: (after >= m) & (after - bat < m)
    more = [
        F.when(rules.uniform(*key, F.lit("score")) < 0.22, F.concat(r("batting_team"), F.lit(" are "), r("team_score").cast("string"), F.lit(" for "), r("team_wickets").cast("string"), F.lit("."))),
        F.when(crossed(100), F.concat(F.lit("A hundred for "), r("batter"), F.lit("!"))).when(crossed(50), F.concat(F.lit("The fifty comes up, well played "), r("batter"), F.lit("!"))),
        F.when((f("phase") == "death") & ~r("wicket") & (need > 0) & (rules.uniform(*key, F.lit("chase")) < 0.3), F.concat(need.cast("string"), F.lit(" needed off "), r("balls_remaining").cast("string"), F.lit("."))),
    ]
    return F.concat_ws(" ", _filled(line, r), *more)


def prompt_block(examples: DataFrame, source: str = "linearized_input", target: str = "target_commentary", order: str = "row_id") -> DataFrame:
    """One row: the few examples as one block of text, in order. The examples are a handful by choice."""
    one = F.struct(order, F.concat(F.lit("Input: "), F.col(source), F.lit("\nCommentary: "), F.col(target)).alias("x"))
    return examples.agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]), "\n\n").alias("block"))


def prompts(rows: DataFrame, examples: DataFrame, key: str, source: str = "linearized_input") -> DataFrame:
    """(key, prompt): the block and the row's input. The block is one row, so it is broadcast."""
    block = prompt_block(examples).select("block", F.lit(1).alias("__j"))
    d = rows.withColumn("__j", F.lit(1)).join(F.broadcast(block), "__j")
    return d.select(key, F.concat(F.col("block"), F.lit("\n\nInput: "), F.col(source), F.lit("\nCommentary:")).alias("prompt"))


def seq2seq(source: Column, prefix: str = "commentary: ") -> Column:
    return F.concat(F.lit(prefix), source)


def chat(source: Column, target: Column | None = None, system: str = "Describe the ball in one line.") -> Column:
    """messages of a chat: system, user and, for training, assistant"""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = [say("system", F.lit(system)), say("user", source)]
    return F.array(*turns, *([say("assistant", target)] if target is not None else []))
