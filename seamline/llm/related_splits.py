"""Splits that keep related records together.

match_key() brings every spelling of a match id to one form; related_edges() states which keys are
one match; hooking and shortcutting (operators.components) finds the classes; allot() gives each
class a split so that the totals come as close to the wanted shares as class sizes allow, by
subset-sum bitsets over size multiplicities.

Defined results: a null match id, or one without a key, is a record of its own class per row key (it is never torn, as it
relates to nothing); empty tables give empty results; repeated rows count as often as they occur;
`match_0`, the id of files without one, is one class and is never joined with others.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.operators.components import connected_components
from seamline.session import cut

PLACEHOLDER = "match_0"


def match_key(c: Column | str) -> Column:
    """lower case; folders and a file ending dropped; '-', ' ' and '_' alike; numbers without leading zeros."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    c = F.regexp_replace(c, r"^.*[/\\]", "")
    c = F.regexp_replace(c, r"\.(json|jsonl|csv|yaml|yml|xml|txt|parquet|gz)$", "")
    c = F.regexp_replace(F.trim(c), r"[\s_\-.]+", "_")
    return F.nullif(F.regexp_replace(c, r"(^|_)0+(?=\d)", "$1"), F.lit(""))


def related_edges(info: DataFrame) -> DataFrame:
    """(a, b) between match keys, or a key and the node of its fixture (two teams, venue, date).

    A fixture node instead of pairs keeps the edges linear in the rows, also where one fixture is
    stated by a third of them."""
    k, p = match_key("match_id"), match_key("prior_id")
    prior = info.select(k.alias("a"), p.alias("b"))
    team = F.array_sort(F.transform("teams", lambda t: F.lower(F.trim(t))))
    named = info.filter(
        F.col("venue").isNotNull() & F.col("match_date").isNotNull() & (F.size("teams") == 2) & ~F.exists("teams", lambda t: t.isNull() | (F.trim(t) == ""))
    )
    fixture = F.concat(F.lit("~"), F.sha2(F.concat_ws("\u0001", team, F.lower(F.trim("venue")), F.col("match_date").cast("string")), 256))
    both = prior.unionByName(named.select(k.alias("a"), fixture.alias("b")))
    return both.filter((F.col("a") != PLACEHOLDER) & (F.col("b") != PLACEHOLDER))


def match_classes(records: DataFrame, info: DataFrame) -> DataFrame:
    """records(match_id, ...) -> the same with `component`. A key without relations is its own class."""
    comp = connected_components(related_edges(info)).filter(~F.col("node").startswith("~"))
    keyed = records.withColumn("__key", match_key("match_id"))
    return keyed.join(comp.withColumnRenamed("node", "__key"), "__key", "left").withColumn("component", F.coalesce("component", "__key")).drop("__key")


def torn_ids(dataset: DataFrame, info: DataFrame) -> DataFrame:
    """Every match id occurring in dataset whose class has rows in more than one split.

    The rows are first reduced to (id, splits) by partial aggregation, so no hot id is shuffled as rows.
    """
    ids = dataset.groupBy(F.col("record.match_id").alias("match_id")).agg(F.collect_set("split").alias("splits")).filter("match_id IS NOT NULL")
    with_class = cut(match_classes(ids, info), "classes")
    # size of a class is not bounded: min and max of the splits tell whether there are two
    torn = (
        with_class.filter(F.size("splits") > 0)
        .select("component", F.array_min("splits").alias("lo"), F.array_max("splits").alias("hi"))
        .groupBy("component")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter("lo <> hi")
        .select("component")
    )
    return with_class.join(torn, "component", "left_semi").select("match_id")


def closest_subset(sizes: list[tuple[int, int]], target: int) -> dict[int, int]:
    """(size, how many) -> how many to take of each so that no other choice comes nearer to target (of two equally near sums, the lower).

    Sums are multiples of the sizes' common divisor; `aim` is the multiple nearest to target, and a choice that meets it is the nearest.
    Largest sizes first is tried before; if it fails, it is the choice to beat, and subset sums are bits of one integer. A
    multiplicity is added as powers of two, heaviest first, until aim is met. Sums further above the target than the choice to beat is
    off are not kept, so the work is at most (distinct sizes) x log(multiplicity) shifts of that many bits, whatever the sizes;
    pieces_of() finds the choice again with a few such integers at a time. Sizes are counted in rows, never rounded."""
    left = {s: m for s, m in sizes if m > 0 and 0 < s < 2 * target}  # none at all is as near as a class of twice the target
    if not left:
        return {}
    unit = gcd(*left)
    left = {s // unit: m for s, m in left.items()}
    floor = target // unit
    aim = floor if 2 * (target % unit) <= unit else floor + 1
    take: dict[int, int] = {}
    missing = aim
    for s in sorted(left, reverse=True):
        if k := min(left[s], missing // s):
            take[s] = k
            missing -= k * s
    more = min((s for s, m in left.items() if m > take.get(s, 0)), default=None)
    if missing > 0 and more is not None:
        off = min(abs(target - unit * (aim - missing)), abs(target - unit * (aim - missing + more)))
        top = (target + off) // unit
        parts: list[tuple[int, int]] = []
        for s, m in left.items():
            m, k = min(m, top // s), 1
            while m > 0:
                n = min(k, m)
                parts.append((s, n))
                m -= n
                k *= 2
        parts.sort(key=lambda p: (p[0] * p[1], p[0]), reverse=True)
        bits, used = 1 << top, 0  # bit i: the sum top - i
        while used < len(parts) and not (bits >> (top - aim)) & 1:
            s, n = parts[used]
            bits |= bits >> (s * n)
            used += 1
        below = bits >> (top - floor)
        low = floor + 1 - (below & -below).bit_length()
        high = top + 1 - (bits & ((1 << (top - floor)) - 1)).bit_length()  # top + 1: there is none
        goal = low if high > top or target - unit * low <= unit * high - target else high
        take = {}
        for s, n in pieces_of(goal, parts[:used]):
            take[s] = take.get(s, 0) + n
    return {s * unit: k for s, k in take.items()}


def pieces_of(goal: int, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Some of parts(size, how many) that sum to goal, which must be one of their sums.

    Sums of one half, and what the other half leaves of goal, are bits of two integers; a bit they share splits goal between the
    halves, which are solved alike. So no integer is kept from step to step, and all levels together double the first one's work."""
    out: list[tuple[int, int]] = []
    todo = [(goal, parts)]
    while todo:
        goal, parts = todo.pop()
        parts = [(s, n) for s, n in parts if s * n <= goal]
        if goal == 0:
            continue
        if len(parts) == 1:
            out += parts
            continue
        half = len(parts) // 2
        front, back, mask = 1, 1 << goal, (1 << (goal + 1)) - 1
        for s, n in parts[:half]:
            front |= (front << (s * n)) & mask
        for s, n in parts[half:]:
            back |= back >> (s * n)
        mid = (front & back).bit_length() - 1
        todo += [(mid, parts[:half]), (goal - mid, parts[half:])]
    return out


def allot(classes: DataFrame, plan: list[tuple[str, float]], seed: str = "13") -> DataFrame:
    """classes(component, n) -> (component, n, split): whole classes, totals nearest to the shares.

    Only the histogram of sizes comes to the driver; it has at most sqrt(2 * rows) entries. The smaller
    shares are filled first, the largest takes the rest.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    sized = classes.withColumn("__u", F.col("n"))
    left = {r["__u"]: r["m"] for r in sized.groupBy("__u").agg(F.count("*").alias("m")).collect()}
    rest = max(plan, key=lambda p: p[1])[0] if plan else None
    quota: list[tuple[int, str, int, int]] = []
    start = dict.fromkeys(left, 0)
    for name, share in sorted(plan, key=lambda p: (p[1], p[0])):
        if name == rest:
            continue
        for u, k in closest_subset(list(left.items()), round(share * total)).items():
            quota.append((u, name, start[u], start[u] + k))
            start[u] += k
            left[u] -= k
    spark = classes.sparkSession
    q = spark.createDataFrame(quota or [(0, "", 0, 0)], "__u long, split string, lo long, hi long")
    # a rank within (size, bucket) plus the bucket's start replaces one sort of all classes of a size
    h = F.pmod(F.xxhash64(F.lit(seed), F.col("component")), F.lit(1024))
    b = sized.withColumn("__b", h)
    from pyspark.sql import Window

    counts = b.groupBy("__u", "__b").agg(F.count("*").alias("c"))
    starts = counts.withColumn("__s", F.sum("c").over(Window.partitionBy("__u").orderBy("__b")) - F.col("c")).drop("c")
    ranked = b.withColumn("__r", F.row_number().over(Window.partitionBy("__u", "__b").orderBy(F.xxhash64("component"), "component")))
    ranked = ranked.join(starts, ["__u", "__b"]).withColumn("__r", F.col("__r") + F.col("__s") - 1)
    cond = (ranked["__u"] == q["__u"]) & (ranked["__r"] >= q["lo"]) & (ranked["__r"] < q["hi"])
    return ranked.join(F.broadcast(q), cond, "left").select("component", "n", F.coalesce(q["split"], F.lit(rest)).alias("split"))


def assign_splits(dataset: DataFrame, info: DataFrame, plan: DataFrame) -> DataFrame:
    """dataset -> (row_id, match_id, component, split): every row, all rows of one match together."""
    shares = [(r["split"], r["fraction"]) for r in plan.filter("split IS NOT NULL AND fraction IS NOT NULL").collect()]
    # a null id, or one without a key (blank, '.json'), gets a key of its own, so that such rows neither cling together nor get lost
    rows = dataset.select("row_id", F.col("record.match_id").alias("match_id"))
    has_key = match_key("match_id").isNotNull()
    ids = rows.filter(has_key).groupBy("match_id").agg(F.count("*").alias("n"))
    lone = rows.filter(~has_key).groupBy("row_id").agg(F.count("*").alias("n"))
    cls = cut(match_classes(ids, info), "classes")
    by_class = cls.groupBy("component").agg(F.sum("n").alias("n"))
    by_row = lone.select(F.concat(F.lit("row~"), F.coalesce(F.col("row_id").cast("string"), F.lit("null"))).alias("component"), "n")
    split = cut(allot(by_class.unionByName(by_row), shares), "allotted").select("component", "split")
    known = cls.select("match_id", "component").join(split, "component")
    a = rows.filter(has_key).join(known, "match_id")
    b = (
        rows.filter(~has_key)
        .withColumn("component", F.concat(F.lit("row~"), F.coalesce(F.col("row_id").cast("string"), F.lit("null"))))
        .join(split, "component")
    )
    return a.select("row_id", "match_id", "component", "split").unionByName(b.select("row_id", "match_id", "component", "split"))
