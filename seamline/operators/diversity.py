"""Diversity of texts: distinct n-grams, repetition between neighbours, similarity of sampled pairs, self-BLEU."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators.surface import sentence_bleu, tokens_13a

BLANKS = r"[ \t\n\r\f\x0B]+"


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), BLANKS), lambda x: x != "")


def ngrams(t: Column, n: int) -> Column:
    """n-grams of a token array as strings; none if it is shorter"""
    at = F.sequence(F.lit(1), F.size(t) - n + 1)
    return F.when(F.size(t) >= n, F.transform(at, lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def distinct_by_group(df: DataFrame, text: str, group: list[str], n: int) -> DataFrame:
    """(group..., grams, distinct_grams, ratio): pooled over the group's texts. Two hash aggregations, the first with partials."""
    # the tokens are a column of their own: written in place they would be computed again for every n-gram
    t = df.select(*group, tokens(F.col(text)).alias("__t"))
    g = t.select(*group, F.explode(ngrams(F.col("__t"), n)).alias("__gram")).groupBy(*group, "__gram").agg(F.count("*").alias("__c"))
    return g.groupBy(*group).agg(F.sum("__c").alias("grams"), F.count("*").alias("distinct_grams"), (F.count("*") / F.sum("__c")).alias("ratio"))


def distinct_mean(df: DataFrame, text: str, group: list[str], n: int) -> DataFrame:
    """mean of the groups' ratios; a group without an n-gram has none and does not count"""
    return distinct_by_group(df, text, group, n).agg(F.count("*").alias("n_groups"), F.avg("ratio").alias("mean_ratio"))


def repetition(df: DataFrame, text: str, group: list[str], order: list[str], n: int) -> DataFrame:
    """(pairs, repeated, rate) over consecutive texts: equal token lists repeat; pairs with a text shorter than n
    are left out; others repeat if they share an n-gram."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = df.select(*group, *order, tokens(F.col(text)).alias("__t"))
    d = d.withColumn("__p", F.lag("__t").over(w)).filter("__p IS NOT NULL")
    t, p = F.col("__t"), F.col("__p")
    same = t == p
    long = (F.size(t) >= n) & (F.size(p) >= n)
    hit = same | (long & F.arrays_overlap(ngrams(t, n), ngrams(p, n)))
    d = d.filter(same | long).agg(F.count("*").alias("pairs"), F.count_if(hit).alias("repeated"))
    return d.withColumn("rate", F.try_divide("repeated", "pairs"))


def sampled_pairs(df: DataFrame, text: str, group: list[str], key: str, per_group: int = 50, seed: str = "13") -> DataFrame:
    """Pairs of texts of each group that are next to each other in hash order: min(per_group, n - 1) of n texts.

    Places are sampled, not pairs: each drawn text is paired with the next one in hash order, so the
    work is linear in the rows whatever the size of a group."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*group).orderBy("__h", key)
    d = df.withColumn("__h", h).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_group + 1)
    d = d.withColumn("key_b", F.lead(key).over(w)).withColumn("text_b", F.lead(text).over(w))
    return d.filter("key_b IS NOT NULL").select(*group, F.col(key).alias("key_a"), "key_b", F.col(text).alias("text_a"), "text_b")


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def pair_places(n: int, k: int, seed: str) -> list[tuple[int, int]]:
    """min(k, n(n-1)/2) different pairs i < j of n places, drawn alike from all of them by their numbers (Floyd), by keyed hash."""
    total = n * (n - 1) // 2
    drawn: set[int] = set()
    for top in range(max(total - k, 0), total):
        x = int.from_bytes(hashlib.sha256(f"{seed}|{top}".encode()).digest()[:16], "big") % (top + 1)
        drawn.add(top if x in drawn else x)
    out = []
    for p in sorted(drawn):  # pair number j(j-1)/2 + i
        j = (1 + math.isqrt(8 * p + 1)) // 2
        out.append((p - j * (j - 1) // 2, j))
    return out


def drawn_pairs(df: DataFrame, text: str, group: list[str], order: list[str], per_group: int = 50, seed: str = "13") -> DataFrame:
    """(group..., __a, __b, text_a, text_b), the places of the pair and its texts: min(per_group, n(n-1)/2) pairs of a group's n texts, drawn from all of them.

    Pair numbers are drawn first, by the group's size alone; only texts that are drawn are joined. order must tell a
    group's rows apart. No pair is built that is not drawn."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.select(*group, F.col(text).alias("__x"), (F.row_number().over(w) - 1).cast("long").alias("__i"))
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [pair_places(n, per_group, f"{seed}|{g}") for n, g in zip(b["__n"], b["__g"])]
            keys = b[group].loc[b.index.repeat([len(x) for x in got])].reset_index(drop=True)
            flat = [p for x in got for p in x]
            yield keys.assign(__a=[p[0] for p in flat], __b=[p[1] for p in flat])

    named = F.to_json(F.array(*[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group]))
    sizes = df.groupBy(*group).agg(F.count("*").alias("__n")).withColumn("__g", named)
    pairs = sizes.mapInPandas(run, ", ".join([*[f"{g} {types[g]}" for g in group], "__a long", "__b long"]))
    for place, name in (("__a", "text_a"), ("__b", "text_b")):
        r = rows.select(*[F.col(g).alias(f"__of_{g}") for g in group], "__i", F.col("__x").alias(name))
        on = F.col(place) == F.col("__i")
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
        pairs = pairs.join(r, on).drop("__i", *[f"__of_{g}" for g in group])
    return pairs


def self_bleu(df: DataFrame, text: str, group: list[str], order: list[str], per_group: int = 50, seed: str = "13") -> DataFrame:
    """(pairs, self_bleu): mean from 0 to 1 of sentence BLEU both ways over the drawn pairs; null without a pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"score": [(sentence_bleu(list(x), list(y)) + sentence_bleu(list(y), list(x))) / 200 for x, y in zip(b["a"], b["b"])]}, dtype="float64")

    p = drawn_pairs(df, text, group, order, per_group, seed).select(tokens_13a(F.col("text_a")).alias("a"), tokens_13a(F.col("text_b")).alias("b"))
    return p.mapInPandas(run, "score double").agg(F.count("*").alias("pairs"), F.when(F.count("*") > 0, F.least(F.avg("score"), F.lit(1.0))).alias("self_bleu"))
