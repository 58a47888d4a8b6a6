import datetime
import itertools

import pytest

from seamline.llm.related_splits import allot, assign_splits, closest_subset, torn_ids

DS = "row_id long, record struct<match_id:string>, split string, extra int"
INFO = "match_id string, prior_id string, teams array<string>, venue string, match_date date, row_id int"
PLAN = "split string, fraction double"
DAY = datetime.date(2020, 1, 2)


def ds(spark, *rows):
    return spark.createDataFrame([(i, (m,), s, 0) for i, (m, s) in enumerate(rows)], DS)


def info(spark, *rows):
    return spark.createDataFrame([(*r, 0) for r in rows], INFO)


def test_spellings_chains_and_fixtures(spark):
    d = ds(spark, ("ab_2020_0000012", "train"), ("raw/AB-2020-12.json", "val"), ("c_1", "train"), ("e_5", "test"), ("x_1", "train"), ("y_1", "val"), ("z_1", "train"), ("z_1", None), ("match_0", "train"), ("match_0", "test"), ("w_1", "val"), (None, "train"), (None, "val"))
    i = info(
        spark, ("c_1", "d_9", ["A", "B"], None, None), ("d_09", "E-5", ["A", "B"], None, None),
        ("x_1", None, ["P", "Q"], "Oval", DAY), ("y_1", None, ["Q", "P"], "Oval", DAY), ("w_1", None, ["P", "Q"], "Oval", None), ("match_0", "w_1", [], None, None),
    )
    got = {r.match_id for r in torn_ids(d, i).collect()}
    assert got == {"ab_2020_0000012", "raw/AB-2020-12.json", "c_1", "e_5", "x_1", "y_1", "match_0"}
    assert torn_ids(d.limit(0), i).count() == 0 and {r.match_id for r in torn_ids(d, i.limit(0)).collect()} == {"ab_2020_0000012", "raw/AB-2020-12.json", "match_0"}


@pytest.mark.parametrize("sizes", [[(5, 3), (3, 2), (1, 1)], [(7, 2)], [], [(2, 5), (9, 1)]])
@pytest.mark.parametrize("target", [0, 1, 4, 8, 13])
def test_subset_sum_is_the_nearest(sizes, target):
    take = closest_subset(sizes, target)
    got = sum(s * k for s, k in take.items())
    best = min((abs(target - sum(s * k for (s, _), k in zip(sizes, ks))) for ks in itertools.product(*[range(m + 1) for _, m in sizes])), default=target)
    assert abs(got - target) == best and all(take[s] <= m for s, m in sizes if s in take)


def test_assignment_is_whole_and_near_the_shares(spark):
    d = ds(spark, *[(f"m_{i % 37}", "train") for i in range(400)], *[(None, "val")] * 20)
    plan = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], PLAN)
    got = assign_splits(d, info(spark, ("m_1", "m_2", [], None, None)), plan).collect()
    assert sorted(r.row_id for r in got) == list(range(420))
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    n = {s: sum(r.split == s for r in got) for s in ("train", "val", "test")}
    assert abs(n["val"] - 42) <= 5 and abs(n["test"] - 42) <= 5
    assert assign_splits(d.limit(0), info(spark), plan).count() == 0


def test_rows_of_ids_without_a_key_get_a_split(spark):
    d = ds(spark, *[(f"m_{i % 7}", "train") for i in range(40)], *[(x, "val") for x in ("", " ", ".json", "a/.json", None) for _ in range(4)])
    plan = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], PLAN)
    got = assign_splits(d, info(spark), plan).collect()
    assert sorted(r.row_id for r in got) == list(range(60)) and all(r.split for r in got)
    assert len({r.component for r in got}) == 7 + 20


def test_shares_of_a_skewed_histogram():
    """1.5 M classes of one row and 500 of 3,000: no rounding of sizes, whatever the number of rows"""
    sizes = [(1, 1_500_000), (3000, 500)]
    left = dict(sizes)
    for share in (0.1, 0.1):
        take = closest_subset(list(left.items()), round(share * 3_000_000))
        assert sum(s * k for s, k in take.items()) == 300_000 and all(k <= left[s] for s, k in take.items())
        left = {s: m - take.get(s, 0) for s, m in left.items()}
    assert sum(s * k for s, k in closest_subset([(10**9, 2), (7, 50)], 150_000_003).items()) == 350
    take = closest_subset([(10**8, 9), (10**6, 3), (3, 10**6), (2, 1)], 5 * 10**8 + 1_234_567)
    assert sum(s * k for s, k in take.items()) == 5 * 10**8 + 1_234_567
    assert closest_subset([(10**9, 1)], 6 * 10**8) == {10**9: 1} and closest_subset([(10**9, 1)], 4 * 10**8) == {}


@pytest.mark.parametrize("factor", [1, 100_000])
@pytest.mark.parametrize("sizes, target", [([(21, 1), (6, 1)], 21), ([(40, 3), (35, 2), (9, 1)], 70), ([(10, 2), (7, 2)], 14), ([(11, 2), (4, 2)], 13), ([(9, 1), (5, 1)], 7)])
def test_the_nearest_sum_does_not_depend_on_the_number_of_rows(sizes, target, factor):
    sums = {sum(s * k for (s, _), k in zip(sizes, ks)) for ks in itertools.product(*[range(m + 1) for _, m in sizes])}
    want = min(sums, key=lambda s: (abs(target - s), s))
    big = [(s * factor, m) for s, m in sizes]
    for given in (big, big[::-1], [*big, (10**12 + 1, 1)]):
        take = closest_subset(given, target * factor)
        assert sum(s * k for s, k in take.items()) == want * factor and all(k <= dict(given)[s] for s, k in take.items())
    near = closest_subset([*big, (1, 1)], target * factor + 1)  # one more row than what the large ones alone can do: no common divisor
    assert abs(sum(s * k for s, k in near.items()) - target * factor - 1) <= abs(want - target) * factor + 1


def test_shares_of_large_classes(spark):
    classes = spark.createDataFrame([("a", 210_000), ("b", 60_000), ("c", 1_830_000)], "component string, n long")
    got = {r.component: r.split for r in allot(classes, [("train", 0.9), ("test", 0.1)]).collect()}
    assert got == {"a": "test", "b": "train", "c": "train"}
