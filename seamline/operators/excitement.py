"""Lexical excitement of a text and how it follows the match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.operators import stats

# Phrases that mark excitement.
INTENSIFIERS = [
    "what a", "out of here", "into the stands", "absolutely", "massive", "brilliant", "stunning", "miles", "huge", "sensational", "magnificent",
    "unbelievable", "superb", "glorious", "spectacular", "outrageous", "ridiculous", "monstrous", "blistering", "thumping", "electric", "carnage",
    "roars", "launches", "crashes", "smashes", "hammered", "clobbered", "destroyed", "explodes", "screamer", "maximum",
]


def parts(text: Column) -> dict[str, Column]:
    """bangs; phrase hits, each phrase counted by itself; words of 3 or more letters in capitals. Words are runs of A-Z."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    low = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+|[^a-z0-9_\s]"), F.lit(0))
    # single words cannot overlap, so one pass over the words counts them all; phrases are counted one by one
    singles = [p for p in INTENSIFIERS if " " not in p]
    total = F.size(F.filter(low, lambda w: w.isin(singles)))
    line = F.concat(F.lit(" "), F.array_join(low, "  "), F.lit(" "))
    for p in INTENSIFIERS:
        if " " in p:
            total = total + F.regexp_count(line, F.lit(" " + "  ".join(p.split()) + " "))
    return {
        "bangs": F.regexp_count(text, F.lit("!")),
        "intensifiers": total,
        "caps": F.size(F.filter(words, lambda w: (F.length(w) >= 3) & (F.upper(w) == w))),
    }


def score(text: Column) -> Column:
    """0.4 bangs + 0.4 phrases + 0.2 capitals, each saturated, in [0, 1]"""
    p = parts(F.coalesce(text, F.lit("")))
    return 0.4 * (F.least(p["bangs"], F.lit(3)) / 3.0) + 0.4 * (F.least(p["intensifiers"], F.lit(3)) / 3.0) + 0.2 * (F.least(p["caps"], F.lit(2)) / 2.0)


def mixed(heuristic: Column, model: Column | None, weights: tuple[float, float] = (0.5, 0.5), mode: str = "auto") -> Column:
    """Heuristic and model halves by weights renormalised over those that ran; the model half is a score column or none."""
    if mode not in ("auto", "heuristic", "model+heuristic"):
        raise ValueError(f"unknown mode {mode}")
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must not be negative and must not sum to zero")
    if mode == "model+heuristic" and model is None:
        raise ValueError("no model scores")
    if model is None or mode == "heuristic":
        return heuristic
    wh, wm = weights
    return F.coalesce((wh * heuristic + wm * F.least(F.greatest(model, F.lit(0.0)), F.lit(1.0))) / (wh + wm), heuristic)


def correlate(df: DataFrame, text: str, salience: str = "features.event_salience", tension: str = "features.tension", group: list[str] | None = None) -> DataFrame:
    """Rank correlation of excitement with salience times tension, overall or within groups; `passed` where it is positive."""
    group = group or []
    d = df.select(*[F.col(g).alias(g.split(".")[-1]) for g in group], score(F.col(text)).alias("excitement"), (F.col(salience) * F.col(tension)).alias("signal"))
    got = stats.spearman(d, "excitement", "signal", [g.split(".")[-1] for g in group])
    return got.withColumn("passed", F.coalesce(F.col("rho") > 0, F.lit(False)))
