"""Per-ball rules as columns: phase, rates, salience, tension, labels, linear inputs. No Python rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureConfig:
    """The published defaults of the feature formulas."""

    momentum_window: int = 12
    phases: tuple[tuple[str, int, int], ...] = (("powerplay", 1, 6), ("middle", 7, 15), ("death", 16, 20))
    wicket: float = 1.0
    six: float = 0.8
    four: float = 0.6
    dot_in_death: float = 0.4
    rrr_weight: float = 0.4
    wickets_weight: float = 0.3
    progress_weight: float = 0.3
    rrr_scale: float = 2.0
    phase_weight: float = 0.5
    salience_weight: float = 0.5
    phase_weights: dict[str, float] = field(default_factory=lambda: {"powerplay": 0.5, "middle": 0.35, "death": 0.9})


DEFAULTS = FeatureConfig()


def scaled(x: Column, digits: int) -> Column:
    """x * 10^digits rounded half up, as an integer: the form in which two engines agree on doubles"""
    return F.floor(x * (10**digits) + 0.5).cast("bigint")


def rounded(x: Column, digits: int) -> Column:
    return scaled(x, digits) / F.lit(float(10**digits))


def phase(over: Column, cfg: FeatureConfig = DEFAULTS) -> Column:
    """The first range that holds the over; beyond all ranges death, in a gap middle."""
    out = None
    for name, lo, hi in cfg.phases:
        hit = over.between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(over > max(hi for _, _, hi in cfg.phases), "death").otherwise("middle")


def current_run_rate(score: Column, balls: Column) -> Column:
    return F.when(balls > 0, score * 6.0 / balls).otherwise(0.0)


def required_run_rate(target: Column, score: Column, remaining: Column) -> Column:
    """null without a target or a ball left; 0 when the target is reached"""
    needed = target - score
    return F.when(target.isNull() | (remaining <= 0), None).when(needed <= 0, 0.0).otherwise(needed * 6.0 / remaining)


def salience(wicket: Column, runs_batter: Column, runs_total: Column, phase_: Column, cfg: FeatureConfig = DEFAULTS) -> Column:
    return (
        F.when(wicket, cfg.wicket)
        .when(runs_batter == 6, cfg.six)
        .when(runs_batter == 4, cfg.four)
        .when((runs_total == 0) & (phase_ == "death"), cfg.dot_in_death)
        .otherwise(runs_total / 10.0)
    )


def tension(target, score, remaining, bowled, total, wickets_in_hand, crr, phase_, salience_, cfg: FeatureConfig = DEFAULTS) -> Column:
    """Chase: pressure of the required rate, wickets gone, progress. First innings: phase and salience. Clamped to [0, 1]."""
    rrr = F.coalesce(required_run_rate(target, score, remaining), F.greatest(crr, F.lit(12.0)))
    pressure = F.when(target - score <= 0, 0.0).otherwise(1.0 / (1.0 + F.exp(-(rrr - crr) / cfg.rrr_scale)))
    chase = cfg.rrr_weight * pressure + cfg.wickets_weight * (1.0 - wickets_in_hand / 10.0) + cfg.progress_weight * (bowled / total)
    weight = F.lit(0.5)
    for name, w in cfg.phase_weights.items():
        weight = F.when(phase_ == name, w).otherwise(weight)
    first = cfg.phase_weight * weight + cfg.salience_weight * salience_
    return F.least(F.greatest(F.when(target.isNotNull(), chase).otherwise(first), F.lit(0.0)), F.lit(1.0))


def outcome_label(wicket, wicket_type, runs_batter, extras_type, extras) -> Column:
    """The most newsworthy fact first: WICKET(kind), SIX, FOUR, extras with value, run word."""
    tag = F.upper(F.replace(extras_type, F.lit("+"), F.lit("_")))
    kind = F.upper(F.replace(F.coalesce(F.nullif(wicket_type, F.lit("")), F.lit("wicket")), F.lit(" "), F.lit("_")))
    return (
        F.when(wicket, F.concat(F.lit("WICKET("), kind, F.lit(")")))
        .when(runs_batter == 6, "SIX")
        .when(runs_batter == 4, "FOUR")
        .when(extras_type != "none", F.when(extras != 0, F.concat(tag, extras.cast("string"))).otherwise(tag))
        .when(runs_batter == 0, "DOT")
        .when(runs_batter == 1, "SINGLE")
        .when(runs_batter == 2, "TWO")
        .when(runs_batter == 3, "THREE")
        .when(runs_batter == 5, "FIVE")
        .otherwise(F.concat(F.lit("RUNS("), runs_batter.cast("string"), F.lit(")")))
    )


def linear_input(r, f, prev: Column | None = None, context_balls: int = 2, game_state: bool = True) -> Column:
    """r(name), f(name): columns of the record and its features. A null part is left out, which is the rule for
    the optional ones. prev: earlier labels; then the last context_balls of them lead the line, or NONE."""
    kv = lambda k, c: F.concat(F.lit(k + "="), c.cast("string"))
    label = outcome_label(r("wicket"), r("wicket_type"), r("runs_batter"), r("extras_type"), r("extras"))
    parts = [
        F.concat(F.lit("over="), (r("over_no") - 1).cast("string"), F.lit("."), r("ball").cast("string")),
        kv("batter", r("batter")),
        kv("bowler", r("bowler")),
        kv("outcome", label),
        F.when(r("wicket"), kv("player_out", r("player_out"))),
        kv("runs", r("runs_total")),
        F.concat(F.lit("score="), r("team_score").cast("string"), F.lit("/"), r("team_wickets").cast("string")),
    ]
    if game_state:
        parts += [kv("RRR", f("required_run_rate")), kv("target", r("target")), kv("wkts_in_hand", f("wickets_in_hand")), kv("phase", f("phase")), kv("momentum", f("momentum"))]
    if prev is not None:
        last = F.slice(prev, F.greatest(F.size(prev) - context_balls + 1, F.lit(1)), context_balls)
        parts.insert(0, F.when(F.size(prev) > 0, F.concat(F.lit("prev="), F.array_join(last, ","))).otherwise("prev=NONE"))
    return F.concat_ws(" | ", *parts)


def strip_html(c: Column) -> Column:
    """entities first, then tags as blanks, runs of blanks as one, trimmed; the entities are the common named ones and numbers of quotes"""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"[ \t\n\r\f\x0B]+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^ \t\n\r\f\x0B]+"))


def surname(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), r"(\S+)$", 1)


def uniform(*key: Column) -> Column:
    """A repeatable draw in [0, 1) from a key, whatever the order of rows: 52 bits of its SHA-256."""
    return F.conv(F.substr(F.sha2(F.concat_ws("|", *key), 256), F.lit(1), F.lit(13)), 16, 10).cast("bigint") / F.lit(float(1 << 52))
