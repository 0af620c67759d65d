"""Numeric functions that make rows or cross ranges: against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import numeric as N


def swaps(items):
    """All orders by Heap's recursion: each one swap from the one before."""
    now, out = list(items), []

    def visit(k):
        if k <= 1:
            out.append(now[:])
            return
        for i in range(k):
            visit(k - 1)
            if i < k - 1:
                j = i if k % 2 == 0 else 0
                now[j], now[k - 1] = now[k - 1], now[j]

    visit(len(now))
    return out


def test_permutations_in_swap_order(spark):
    lists = [list(range(n)) for n in range(8)] + [[7, 7, 1], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, items array<int>")
    got = {}
    for r in N.permutations(df, "items").collect():
        got.setdefault(r.id, {})[r.position] = r.arrangement
    assert got.keys() == set(range(9))
    for i, x in enumerate(lists[:-1]):
        assert [got[i][p] for p in range(len(got[i]))] == swaps(x)


def test_ten_items_are_split_over_tasks(spark):
    df = spark.createDataFrame([(list("abcdefghij"),)], "items array<string>")
    rows = N.permutations(df, "items")
    r = rows.select(F.spark_partition_id().alias("t"), "position", F.array_join("arrangement", "").alias("a")).agg(F.countDistinct("t"), F.count("*"), F.sum("position"), F.count_if(F.length("a") == 10)).first()
    n = math.factorial(10)
    assert r[0] > 1 and tuple(r)[1:] == (n, n * (n - 1) // 2, n)
    with pytest.raises(ValueError, match="20"):
        N.permutations(spark.createDataFrame([(list(range(21)),)], "items array<int>"), "items")


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_combinations(spark, k):
    from itertools import combinations_with_replacement

    lists = [[], ["a"], list("abc"), list("aab"), list("abcdefg"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, items array<string>")
    got = sorted((r.id, r.position, r.combination) for r in N.combinations_with_replacement(df, "items", k).collect())
    want = [(i, p, list(c)) for i, x in enumerate(lists) for p, c in enumerate(combinations_with_replacement(x or [], k))]
    assert got == want


def test_many_combinations(spark):
    df = spark.createDataFrame([(list(range(60)),)], "items array<int>")
    rows = N.combinations_with_replacement(df, "items", 4)
    r = rows.agg(F.count("*"), F.max("position"), F.count_if(F.array_sort("combination") == F.col("combination")), F.countDistinct("combination")).first()
    n = math.comb(63, 4)
    assert tuple(r) == (n, n - 1, n, n)
    assert rows.where("position IN (0, 59, 60)").orderBy("position").select("combination").collect() == [([0, 0, 0, 0],), ([0, 0, 0, 59],), ([0, 0, 1, 1],)]
    with pytest.raises(ValueError, match="1 or more"):
        N.combinations_with_replacement(df, "items", 0)


def plain(values):
    total = lost = 0.0
    for x in values:
        x = float("nan") if x is None else x
        t = total + x
        lost += (total - t) + x if abs(total) >= abs(x) else (x - t) + total
        total = t
    return total + lost


def bits(x):
    return "nan" if math.isnan(x) else np.float64(x).tobytes()


def test_sum_carried_over_ranges(spark):
    """Keys over many ranges, ties, null keys and orders: bit for bit as one pass in order, and as the folded arrays."""
    r = random.Random(4)
    number = lambda: r.choice([1.0, -1.0]) * 10 ** r.uniform(-12, 16)
    rows = [("hot", i // 2, number()) for i in range(6000)] + [("warm", None if i % 5 == 0 else i, number()) for i in range(900)]
    rows += [(k, i, number()) for k in ("a", "b", None) for i in range(20)] + [("missing", i, None if i == 500 else 1.0) for i in range(1000)] + [("inf", 0, math.inf), ("inf", 1, 1.0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at int, x double").repartition(7)
    order = lambda row: ((row[1] is not None, row[1] or 0), (row[2] is not None, row[2] or 0.0))
    want = {}
    for k in {row[0] for row in rows}:
        values = [row[2] for row in sorted((row for row in rows if row[0] == k), key=order)]
        want[k] = (bits(plain(values)), bits(plain(values) / len(values)))
    for options in ({}, {"most": 500, "ranges": 9}, {"most": 0, "ranges": 5}, {"most": 5000, "ranges": 1}, {"most": 2000}):
        got = {row.key: (bits(row.total), bits(row["mean"])) for row in N.compensated_sum_by(df, ["key"], "x", "at", **options).collect()}
        assert got == want, options
    assert N.compensated_sum_by(df.where("false"), ["key"], "x", "at").count() == 0


def test_poisson_rows(spark):
    rates = [0.5, 1.0, 2.0, 10.0, 100.0, 800.0, 1e5, 0.0, -1.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rates)], "id int, rate double")
    rows = N.poisson_rows(df, "rate")
    got = {r.id: r for r in rows.groupBy("id").agg(F.count("*").alias("n"), F.sum("p").alias("sum"), F.max(F.struct("k", "p")).alias("last")).collect()}
    assert got.keys() == {0, 1, 2, 3, 4, 5, 6} and [got[i].n for i in (1, 2, 3, 4)] == [7, 10, 25, 140]
    for r in got.values():
        assert r.last["k"] == r.n - 1 and r.sum >= 1 - N.EPSILON - 1e-9 and r.sum - r.last["p"] < 1 - N.EPSILON + 1e-9
    for r in rows.where("k % 97 = 3").collect():
        exact = math.exp(r.k * math.log(r.rate) - r.rate - math.lgamma(r.k + 1))
        assert math.isclose(r.p, exact, rel_tol=1e-8, abs_tol=1e-300)
    arrays = df.where("id < 6").select("id", N.poisson_cells(F.col("rate")).alias("cells")).collect()
    assert all(len(a.cells) == got[a.id].n for a in arrays)


def test_a_large_group_is_no_array(spark):
    """Three million rows of one key, in ranges of a million: the bits of one pass."""
    n = 3_000_000
    df = spark.range(n, numPartitions=6).select(F.lit("k").alias("key"), (F.col("id") * 7919 % n).alias("at"), ((F.col("id") * 7919 % n) * 1e9 + F.pow(F.lit(0.1), F.col("id") * 7919 % n % 17)).alias("x"))
    want = N.fold(np.array([float(i) * 1e9 for i in range(n)]) + np.array([0.1 ** (i % 17) for i in range(n)]), 0.0, 0.0)
    got = N.compensated_sum_by(df, ["key"], "x", "at", most=999_999).first()
    assert math.isclose(got.total, sum(want), rel_tol=1e-15) and got["mean"] == got.total / n
