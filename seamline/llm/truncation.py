"""Texts cut off by field limits or in transfer.

A stack automaton reads each text to its end (markup, brackets, quotes, escapes, broken characters),
the corpus tells which word sequences can end (endings.py), and each source has a baseline: a length
at which its texts pile up (the field limit), and its share of unfinished ends. A text counts as cut
when it ends without terminator and

  * in a broken escape, entity, tag or character, or
  * at the length limit of its source, or
  * in a sequence that goes on elsewhere (or a word met nowhere else), weighed by the source's baseline, or
  * within a tag, quote or bracket that the stack still holds, unless the source's ended texts leave such
    things open as well.

A closing ellipsis ('…', '...', '[…]') is an open end: what stands before it is judged, its length is that
of the text with the mark, as the limit counts it.

Defined results: null and blank texts and texts without a word are not cut; an ended sentence is
whole even where markup is left open; repeated texts are judged alike and each comes out; a null
source is a source of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.endings import BROKEN, end_of, is_terminated, sequence_counts, unclosed, unmarked
from seamline.session import cut, spread

#: what the automaton may leave open, and the share of a source's ended texts from which on that is a habit
OPEN, HABIT = ("tag", "quote", "bracket"), 0.02
#: the share of a source's texts, surely reached, at one length that makes it a limit; the share of broken ends, surely passed, that makes it unclean
PILE, UNCLEAN = 0.012, 0.001
#: how many occurrences of its class a word's own count must outweigh
PRIOR = 3

SCHEMA = "doc_id long, source string, len int, bytes int, h string, ended boolean, broken boolean, marked boolean, open_tag boolean, open_quote boolean, open_bracket boolean, s0 string, s1 string, s2 string, s3 string, s4 string"


def surely(k: Column, n: Column, z: float) -> Column:
    """The lower bound of a share seen k times in n (Wilson): what holds at every size, in place of least counts."""
    k, n = k.cast("double"), n.cast("double")
    p, q = F.try_divide(k, n), F.try_divide(F.lit(z * z), n)
    return F.coalesce((p + q / 2 - z * F.sqrt(F.try_divide(p * (1 - p) + q / 4, n))) / (1 + q), F.lit(0.0))


def features(docs: DataFrame) -> DataFrame:
    """One row per text that is not blank: how it ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, source, text, h in zip(b["doc_id"], b["source"], b["text"], b["h"]):
                ended = is_terminated(text)
                end = None if ended else end_of(text)
                bare, marked = unmarked(text)
                broken = not ended and bool(BROKEN.search(bare))
                left = unclosed(text)
                left = any(x[0].isalpha() for x in left), '"' in left, any(x in "([{" for x in left)
                rows.append((i, source, len(text), len(text.encode("utf-8", "surrogatepass")), h, ended or end is None, broken, marked, *left, *(end or (None,) * 5)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    d = docs.filter("text IS NOT NULL AND length(trim(text)) > 0").select("doc_id", "source", "text", F.md5("text").alias("h"))
    return spread(d).mapInPandas(run, SCHEMA)


def judged(docs: DataFrame) -> DataFrame:
    """features with limit (the source's length limit, if it has one), rate (how often such an end ends elsewhere), known and cut."""
    f = cut(features(docs), "ends")
    texts = docs.filter("text IS NOT NULL AND length(trim(text)) > 0").select("text", F.md5("text").alias("h")).dropDuplicates(["h"])
    counts = cut(sequence_counts(texts), "sequences")
    # the limit of a source, in characters or bytes: its greatest length, if more texts have it than chance allows
    total = f.groupBy("source").agg(F.count("*").alias("docs"), F.max("len").alias("len"), F.max("bytes").alias("bytes"))
    x = f
    for m, name in (("len", "limit"), ("bytes", "byte_limit")):
        at = f.groupBy("source", m).agg(F.count("*").alias("c"), F.count_if(~F.col("ended")).alias("u"))
        kinds = at.groupBy(F.col("source").alias("src")).agg(F.count("*").alias("kinds"))
        top = at.alias("b").join(total.alias("t"), F.expr(f"b.source <=> t.source AND b.{m} = t.{m}")).join(kinds, F.expr("t.source <=> src")).drop("src")
        usual = (F.col("docs") - F.col("c")) / F.greatest(F.col("kinds") - 1, F.lit(1))  # texts of any other length
        piled = (surely(F.col("c"), F.col("docs"), 2) > PILE) & (F.col("u") > 0.5 * F.col("c")) & (F.col("c") > 4 * usual)
        top = top.select(F.col("t.source").alias("src"), F.when(piled, F.col(f"t.{m}")).alias(name), *([F.col("t.docs").alias("docs")] if m == "len" else []))
        x = x.join(top, F.expr("source <=> src"), "left").drop("src")
    # what a source's ended texts leave open is its habit; the whole corpus counts as one text more
    c = f.groupBy("source").agg(F.count_if("ended").alias("n"), *[F.count_if(F.col("ended") & F.col(f"open_{k}")).alias(k) for k in OPEN])
    all_c = c.agg(F.sum("n").alias("all_n"), *[F.sum(k).alias(f"all_{k}") for k in OPEN])
    habit = c.crossJoin(F.broadcast(all_c)).select(
        F.col("source").alias("src"), *[((F.col(k) + F.coalesce(F.try_divide(f"all_{k}", "all_n"), F.lit(1.0))) / (F.col("n") + 1) >= HABIT).alias(f"habit_{k}") for k in OPEN]
    )
    x = x.join(habit, F.expr("source <=> src"), "left").drop("src")
    within = F.lit(False)
    for k in OPEN:
        within = within | (F.col(f"open_{k}") & ~F.col(f"habit_{k}"))
    x = x.withColumn("within", within).drop(*[f"habit_{k}" for k in OPEN])
    open_ = x.filter("NOT ended")
    want = open_.select(F.explode(F.array(*[f"s{k}" for k in range(5)])).alias("seq")).distinct()
    few = cut(counts.join(want, "seq", "left_semi"), "wanted")

    def rated(ends: DataFrame, clean: DataFrame) -> DataFrame:
        """ends with rate and known: by the corpus, and by ends of other texts in the sources of `clean`"""
        once = ends.join(clean, F.expr("source <=> src"), "left_semi").dropDuplicates(["h"])
        eot = once.select(F.explode(F.array(*[f"s{k}" for k in range(5)])).alias("seq")).groupBy("seq").agg(F.count("*").alias("e"))
        stat = few.join(eot, "seq", "full").select("seq", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("final", F.lit(0)).alias("f"), F.coalesce("e", F.lit(0)).alias("e"))
        stat = cut(stat, "rates")
        y = ends.join(clean.withColumn("own", F.lit(1)), F.expr("source <=> src"), "left").drop("src")
        own = F.coalesce("own", F.lit(0))  # a text does not speak for its own end
        for k in range(5):
            y = y.join(stat.select(F.col("seq").alias(f"s{k}"), *[F.col(c).alias(f"{c}{k}") for c in "nfe"]), f"s{k}", "left")
            e = F.greatest(F.coalesce(f"e{k}", F.lit(0)) - own, F.lit(0))
            m = F.coalesce(f"n{k}", F.lit(0)) + e
            y = y.withColumn(f"m{k}", m).withColumn(f"f{k}", F.coalesce(f"f{k}", F.lit(0)) + e)
        # longer sequences first, each smoothed by the shorter one
        by_words = F.col("f1") / F.greatest("m1", F.lit(1))
        for k in (2, 3):
            by_words = (F.col(f"f{k}") + 10 * by_words) / (F.col(f"m{k}") + 10)
        name = F.col("s1").isin("1 Aa", "1 A")
        # names and numbers say little by themselves: the sentence's first word does ('Umpires: ...', 'Att: ...')
        by_head = F.when((name | (F.col("s1") == "1 0")) & (F.col("m4") >= 4), F.col("f4") / F.col("m4"))
        # a capital may be a name or the start of a sentence: the more often it is met, the more it speaks for itself
        by_words = F.when(F.col("s1") == "1 Aa", (F.col("f0") + PRIOR * by_words) / (F.col("m0") + PRIOR)).otherwise(by_words)
        y = y.withColumn("rate", F.greatest(by_words, by_head))
        new = F.col("m0") == 0
        y = y.withColumn("unfinished", (F.col("rate") < 0.02) | (new & (F.col("rate") < 0.03)) | (new & ~name & ~F.col("s1").startswith("1 0")))
        return y.select(*ends.columns, "rate", "m0", "m3", "unfinished")

    # blanks before a mark of omission are stripped, so that such a text may fall two short of the limit
    short = F.when(F.col("marked"), 2).otherwise(0)
    at_limit = F.coalesce(F.col("len") >= F.col("limit") - short, F.lit(False)) | F.coalesce(F.col("bytes") > F.col("byte_limit") - 4 - short, F.lit(False))
    all_sources = total.select(F.col("source").alias("src"))
    none = all_sources.limit(0)
    # first by the corpus alone; the sources that then look whole may say which ends are usual
    rough = rated(open_, none)
    share = rough.filter(~at_limit).groupBy("source").agg(F.count_if("broken").alias("b"), F.max("docs").alias("docs"), F.max(F.coalesce("limit", "byte_limit")).alias("limit"))
    clean = cut(share.filter(F.col("limit").isNull() & (surely(F.col("b"), F.col("docs"), 3) <= UNCLEAN)).select(F.col("source").alias("src")), "clean")
    x = cut(rated(open_, clean), "judged")
    return x.withColumn("cut", F.col("broken") | at_limit | F.col("unfinished") | F.col("within"))


def truncated(docs: DataFrame) -> DataFrame:
    return judged(docs).filter("cut").select("doc_id")


def source_report(docs: DataFrame) -> DataFrame:
    """Per source: texts, cut ones and their share (null and blank texts count as texts)."""
    hit = judged(docs).filter("cut").groupBy("doc_id").agg(F.lit(1).alias("is_cut"))
    d = docs.select("doc_id", "source").join(hit, "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n_texts"), F.count("is_cut").alias("n_cut"), F.round(F.count("is_cut") / F.count("*"), 4).alias("share_cut"))
