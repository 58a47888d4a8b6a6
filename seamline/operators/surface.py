"""Overlap with reference texts: corpus BLEU (Papineni et al. 2002, 13a tokens, exponential smoothing after
Post 2018) and ROUGE-L (Lin 2004, stemmed). Model-based overlap is reported as unavailable."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions.stem import stem


def tokens_13a(c: Column) -> Column:
    """language-independent marks apart, full stops and commas apart unless between digits, dashes after digits apart"""
    c = F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    c = F.regexp_replace(c, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
    c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
    c = F.regexp_replace(c, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(c, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")


def bleu_counts(df: DataFrame, text: str, reference: str, group: list[str] | None = None) -> DataFrame:
    """The sums of corpus BLEU per group: matches and totals for n = 1..4 and both lengths.

    Clipping counts each n-gram against the reference's, which array functions do in quadratic time; so
    it is done in Arrow batches, which are added up per group before anything is shuffled."""
    group = group or []
    types = dict(df.dtypes)
    names = ["sys_len", "ref_len", *[f"{k}{n}" for n in range(1, 5) for k in "mt"]]

    def grams(w: list[str], n: int) -> Counter:
        return Counter(zip(*[w[i:] for i in range(n)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, r in zip(b["__h"], b["__r"]):
                h, r = list(h), list(r)
                row = [len(h), len(r)]
                for n in range(1, 5):
                    row += [sum((grams(h, n) & grams(r, n)).values()), max(len(h) - n + 1, 0)]
                rows.append(row)
            got = pd.DataFrame(rows, columns=names)
            yield pd.concat([b[group].reset_index(drop=True), got], axis=1).groupby(group, dropna=False, as_index=False).sum() if group else got.sum().to_frame().T

    d = df.select(*group, tokens_13a(F.col(text)).alias("__h"), tokens_13a(F.col(reference)).alias("__r"))
    schema = ", ".join([*[f"{g} {types[g]}" for g in group], *[f"{n} long" for n in names]])
    return d.mapInPandas(run, schema).groupBy(*group).agg(*[F.sum(n).alias(n) for n in names])


def bleu(df: DataFrame, text: str, reference: str, group: list[str] | None = None) -> DataFrame:
    """(group..., bleu) from 0 to 100"""
    c = bleu_counts(df, text, reference, group)
    # zero matches of an order count as 1/2, 1/4, ... of one
    zeros, total = F.lit(0), F.lit(0.0)
    for n in range(1, 5):
        zeros = zeros + F.when(F.col(f"m{n}") == 0, 1).otherwise(0)
        p = F.when(F.col(f"m{n}") == 0, 1.0 / (F.pow(F.lit(2.0), zeros) * F.col(f"t{n}"))).otherwise(F.col(f"m{n}") / F.col(f"t{n}"))
        total = total + F.ln(F.when(F.col(f"t{n}") > 0, p))
    brevity = F.when(F.col("sys_len") < F.col("ref_len"), F.exp(1 - F.try_divide(F.col("ref_len"), F.col("sys_len")))).otherwise(1.0)
    return c.select(*(group or []), F.when(F.col("m1") == 0, 0.0).otherwise(F.coalesce(100.0 * brevity * F.exp(total / 4), F.lit(0.0))).alias("bleu"))


def sentence_bleu(h: list[str], r: list[str]) -> float:
    """BLEU from 0 to 100 of one text's tokens, smoothed as bleu(), over the orders that the text is long enough for"""
    total, zeros, orders = 0.0, 0, min(4, len(h))
    for n in range(1, orders + 1):
        a, b = Counter(zip(*[h[i:] for i in range(n)])), Counter(zip(*[r[i:] for i in range(n)]))
        m, t = sum((a & b).values()), len(h) - n + 1
        if not m:
            if n == 1:
                return 0.0
            zeros += 1
        total += math.log(m / t if m else 1 / (2**zeros * t))
    if not orders:
        return 0.0
    return 100 * math.exp(total / orders + min(0.0, 1 - len(r) / len(h)))


def lcs(a: list, b: list) -> int:
    """length of the longest common subsequence, by bit vectors: one big-integer step a word"""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def rouge_l(df: DataFrame, text: str, reference: str, key: str) -> DataFrame:
    """(key, rouge_l): F-measure of the longest common subsequence of stemmed words"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, str] = {}

        def words(x: str | None) -> list[str]:
            out = []
            for w in re.findall("[a-z0-9]+", (x or "").lower()):
                s = memo.get(w)
                if s is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    s = memo[w] = stem(w) if len(w) > 3 else w
                out.append(s)
            return out

        for b in batches:
            f = []
            for x, y in zip(b["a"], b["b"]):
                x, y = words(x), words(y)
                n = lcs(x, y) if x and y else 0
                f.append(2.0 * n / (len(x) + len(y)) if n else 0.0)
            yield pd.DataFrame({"k": b["k"], "rouge_l": f})

    t = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("a"), F.col(reference).alias("b")).mapInPandas(run, f"k {t}, rouge_l double").withColumnRenamed("k", key)


def bertscore_status(mode: str = "auto") -> list[tuple]:
    """The model-based overlap as (path, value, status, reason): its weights are not available, which is reported, not guessed. require raises."""
    if mode not in ("auto", "off", "require"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "require":
        raise LookupError("the weights of the model-based overlap are not available")
    return [("surface.bertscore", None, "disabled", "switched off") if mode == "off" else ("surface.bertscore", None, "unavailable", "weights missing")]
