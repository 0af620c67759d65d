"""Compensated sum and mean, Poisson cells, permutations, combinations: as expressions over arrays, and as tables of rows
for whatever does not fit into one row."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations_with_replacement as combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import written

EPSILON = 0.0001


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compensated_sum(values: Column) -> Column:
    """Left-to-right sum that carries the lost low-order part; empty: 0; a missing number makes it NaN."""
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))

    def add(acc: Column, raw: Column) -> Column:
        x = F.coalesce(raw.cast("double"), F.lit(float("nan")))
        t = acc["total"] + x
        lost = F.when(F.abs(acc["total"]) >= F.abs(x), (acc["total"] - t) + x).otherwise((x - t) + acc["total"])
        return F.struct(t.alias("total"), (acc["lost"] + lost).alias("lost"))

    return F.aggregate(values, zero, add, lambda acc: acc["total"] + acc["lost"])


def compensated_mean(values: Column) -> Column:
    return F.when(F.size(values) == 0, F.raise_error(F.lit("mean requires at least one data point")).cast("double")).otherwise(compensated_sum(values) / F.size(values))


def fold(values: np.ndarray, total: float, lost: float) -> tuple[float, float]:
    """The same sum carried on over further values: both running sums are left to right."""
    with np.errstate(all="ignore"):
        sums = np.add.accumulate(np.concatenate([[total], values]))
        before, after = sums[:-1], sums[1:]
        gaps = np.where(np.abs(before) >= np.abs(values), (before - after) + values, (values - after) + before)
        return float(sums[-1]), float(np.add.accumulate(np.concatenate([[lost], gaps]))[-1])


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that fit into one row each."""
    lists = rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("values_"))
    return lists.select(*keys, compensated_sum(F.col("values_")).alias("total"), compensated_mean(F.col("values_")).alias("mean"))


def _on(left: list[str], right: list[str]) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]


def compensated_sum_by(df: DataFrame, keys: list[str], value: str, order: str, most: int = 1_000_000, ranges: int | None = None) -> DataFrame:
    """keys, total, mean: compensated sum and mean of each group, folded in the order of ``order``, of equal ones by
    value, nulls first.

    Groups of up to ``most`` rows are folded as arrays. The fold can't be merged from parts, so larger groups go in order:
    their rows are dealt into ranges of about ``most`` rows by key and order, and written; each range folds its part of a key and hands its state
    to the next. A round is one job over the ranges that are due, one for each such key, and reads only those. No row,
    task or array holds more of a key than one range does, and at most one key crosses each border.
    """
    k = [f"key{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(order).alias("at"), F.col(value).cast("double").alias("x"))
    other = [f"c_{n}" for n in k]
    counted = rows.groupBy(*k).count().where(F.col("count") > most)
    n_large = counted.agg(F.sum("count")).first()[0]
    if not n_large:
        return _folded(rows, k).toDF(*keys, "total", "mean")
    large = written(counted.select(*k).toDF(*other), "large")
    ranges = ranges or -(-n_large // max(most, 1))
    small = _folded(rows.join(large, _on(k, other), "left_anti"), k)
    return small.unionByName(_carried(rows.join(large, _on(k, other), "left_semi"), k, ranges)).toDF(*keys, "total", "mean")


def _carried(rows: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    spark = rows.sparkSession
    dealt = written(rows.repartitionByRange(ranges, *keys, "at", "x").withColumn("part", F.spark_partition_id()), "ranges", "part")
    spans = dealt.groupBy(*keys).agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last").collect()  # fewer than there are ranges
    if not spans:
        return _folded(dealt, keys)
    other = [f"c_{n}" for n in keys]
    kind = ", ".join(f"`{o}` {dealt.schema[n].dataType.simpleString()}" for n, o in zip(keys, other, strict=True))
    key = [tuple(r[n] for n in keys) for r in spans]
    state = [(0.0, 0.0, 0) for _ in spans]

    def carry(t: pa.Table) -> pa.Table:
        x = t.sort_by([("row", "ascending")])["x"].to_numpy()
        total, lost = fold(x, t["total"][0].as_py(), t["lost"][0].as_py())
        return pa.table({"id": t["id"].slice(0, 1), "total": [total], "lost": [lost], "n": [t["n"][0].as_py() + len(x)]})

    for step in range(max(r["last"] - r["first"] for r in spans) + 1):
        due = [(i, r["first"] + step) for i, r in enumerate(spans) if r["first"] + step <= r["last"]]
        begun = spark.createDataFrame([(*key[i], i, part, *state[i]) for i, part in due], f"{kind}, id int, due int, total double, lost double, n bigint")
        part = dealt.where(F.col("part").isin([p for _, p in due])).join(F.broadcast(begun), [*_on(keys, other), F.col("part") == F.col("due")])
        # Spark's order decides, so that null, NaN and any type of order lie as they do in the ranges
        part = part.repartition("id").sortWithinPartitions("id", "at", "x").select("id", "total", "lost", "n", F.coalesce("x", F.lit(float("nan"))).alias("x"), F.monotonically_increasing_id().alias("row"))
        for r in part.groupBy("id").applyInArrow(carry, "id int, total double, lost double, n bigint").collect():  # a row for each key due
            state[r["id"]] = (r["total"], r["lost"], r["n"])
    sums = spark.createDataFrame([(*key[i], total + lost, (total + lost) / n) for i, (total, lost, n) in enumerate(state)], f"{kind}, total double, mean double")
    inside = dealt.join(F.broadcast(sums.select(other)), _on(keys, other), "left_anti")
    return _folded(inside, keys).unionByName(sums.toDF(*keys, "total", "mean"))


def div(a: Column, b: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


#: log(k!) less its leading terms, for k from 0: below 16 from the factorial, above from the series.
def _log_factorial_rest(k: Column) -> Column:
    exact = [0.0, *[math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]]
    x = 1 / (k * k)
    series = (F.lit(1 / 12) - x * (F.lit(1 / 360) - x * (F.lit(1 / 1260) - x * F.lit(1 / 1680)))) / k
    return F.when(k < 16, F.get(F.array(*map(F.lit, exact)), k.cast("int"))).otherwise(series)


def poisson_cell(rate: Column, k: Column) -> Column:
    """Probability of ``k`` events, in closed form: deviance from the rate, and the series of log(k!). Cells below the
    least double are 0."""
    kd = k.cast("double")
    off = (kd - rate) / rate
    # k log(k / rate) + rate - k, without cancellation where k is near the rate
    deviance = F.when(F.abs(off) < 0.1, rate * ((1 + off) * F.log1p(off) - off)).otherwise(kd * F.log(kd / rate) + rate - kd)
    return F.when(k == 0, F.exp(-rate)).otherwise(F.exp(-_log_factorial_rest(kd) - deviance) / F.sqrt(2 * math.pi * kd))


def poisson_last(rate: Column) -> Column:
    """The cell at which the sum from 0 on reaches 1 - EPSILON; NULL for a rate <= 0. Only cells within twelve standard
    deviations of the rate are summed; those below add less than 1e-30."""
    begin = F.greatest(F.floor(rate - 12 * F.sqrt(rate) - 24), F.lit(0))
    steps = F.sequence(begin, F.ceil(rate + 12 * F.sqrt(rate) + 24))
    zero = F.struct(F.lit(0.0).alias("sum"), (begin - 1).alias("k"))
    add = lambda acc, k: F.when(acc["sum"] < 1 - EPSILON, F.struct((acc["sum"] + poisson_cell(rate, k)).alias("sum"), k.alias("k"))).otherwise(acc)
    return F.when(rate > 0, F.aggregate(steps, zero, add, lambda acc: acc["k"]))


def poisson_cells(rate: Column) -> Column:
    """Probabilities of 0, 1, ... until they reach 1 - EPSILON, the crossing cell included, as an array; NULL for a rate <= 0."""
    return named(poisson_last(rate), lambda last: F.when(last.isNotNull(), F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda k: poisson_cell(rate, k))))


def numbered(df: DataFrame, count: Column, name: str, most: int, run: int = 4096) -> DataFrame:
    """Each row ``count`` times, at most ``most``, with ``name`` from 0 on. Where ``most`` is above ``run``, the numbers are
    cut into runs that go to tasks by themselves, so that one row's share is split. No array has more numbers than the
    larger of ``run`` and ``most / run ** 2``."""
    cut = df.withColumn("count_", count.cast("bigint")).where("count_ > 0")
    if most <= run:
        return cut.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count_") - 1))).drop("count_")
    cut = cut.withColumn("step_", div(F.col("count_") + (run - 1), run))
    cut = cut.withColumn("from_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count_") - 1, F.col("step_")))).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("to_", F.least(F.col("from_") + F.col("step_"), F.col("count_")) - 1)
    cut = cut.withColumn("from_", F.explode(F.sequence("from_", "to_", F.lit(run).cast("bigint"))))
    return cut.withColumn(name, F.explode(F.sequence("from_", F.least(F.col("from_") + (run - 1), F.col("to_"))))).drop("count_", "step_", "from_", "to_")


def poisson_rows(df: DataFrame, rate: str) -> DataFrame:
    """The columns of ``df``, ``k`` and ``p``: a row for each cell."""
    known = df.withColumn("last_", poisson_last(F.col(rate).cast("double"))).where("last_ IS NOT NULL")
    most = known.agg(F.max("last_")).first()[0] or 0
    return numbered(known, F.col("last_") + 1, "k", most + 1).withColumn("p", poisson_cell(F.col(rate).cast("double"), F.col("k"))).drop("last_")


def swap_orders(n: int) -> list[list[list[int]]]:
    """``[i][d]``: which place each place takes its item from, after ``d`` of the swaps that bring new items to place ``i``
    and the full rounds of the places before it that come between them."""
    full, out = list(range(n)), []  # what a full round of the places before ``i`` does
    for i in range(n):
        now = list(range(n))
        ways = [now]
        for d in range(i):
            now = [now[j] for j in full]
            a = d if i % 2 else 0
            now[a], now[i] = now[i], now[a]
            ways.append(now)
        out.append(ways)
        full = [now[j] for j in full]
    return out


#: Rows of a table of orders or choices that may be broadcast.
TABLE_ROWS = 4096


def _from_table(items: DataFrame, column: str, ways: dict[int, list], name: str) -> DataFrame:
    """The other columns of ``items``, position and ``name``: the items at the places that a table has for arrays of their
    size. The table has ``TABLE_ROWS`` rows at most."""
    table = items.sparkSession.createDataFrame([(n, p, list(w)) for n, all_ in ways.items() for p, w in enumerate(all_)], "n_ int, position bigint, places_ array<int>")
    rows = items.join(F.broadcast(table), F.size(column) == F.col("n_"))
    return rows.select(*[c for c in items.columns if c != column], "position", F.transform("places_", lambda at: F.get(column, at)).alias(name))


def _order_at(ways: list[list[list[int]]], n: int, position: int) -> list[int]:
    now = list(range(n))
    for i in range(n - 1, 0, -1):
        digit, position = divmod(position, math.factorial(i))
        now = [now[j] for j in ways[i][digit][:n]]
    return now


def permutations(items: DataFrame, column: str) -> DataFrame:
    """The other columns of ``items``, ``position`` from 0 and ``arrangement``: all orders of the array of each row, each
    one swap from the one before. A null array has none, an empty one has one.

    The order at a position follows from the position's digits in the factorial base: digit ``d`` of place ``i`` says how
    often the item there has been swapped. So rows are made independently, in many tasks, and nothing is built in memory.
    Where no array has more than six items, the few orders there are come from a table.
    """
    size = F.size(column)
    n = items.agg(F.max(size)).first()[0] or 0
    if n > 20:
        raise ValueError("more than 20 items have more orders than a bigint can number")
    ways = swap_orders(max(n, 1))
    if math.factorial(n) * 2 <= TABLE_ROWS:
        return _from_table(items, column, {m: [_order_at(ways, m, p) for p in range(math.factorial(m))] for m in range(n + 1)}, "arrangement")
    ways = F.array(*[F.array(*[F.array(*map(F.lit, w)) for w in own]) for own in ways])
    factorials = F.array(*[F.lit(math.factorial(i)).cast("bigint") for i in range(n + 1)])
    rows = numbered(items.where(F.col(column).isNotNull()), F.get(factorials, size), "position", math.factorial(n))
    digit = lambda i: (div(F.col("position"), F.get(factorials, i)) % (i + 1)).cast("int")

    def place(order: Column, i: Column) -> Column:
        return named(F.get(F.get(ways, i), digit(i)), lambda way: F.transform(order, lambda _, at: F.get(order, F.get(way, at))))

    start = F.transform(F.col(column), lambda _, at: at)
    order = F.when(size < 2, start).otherwise(F.aggregate(F.sequence(size - 1, F.lit(1), F.lit(-1)), start, place))
    others = [c for c in items.columns if c != column]
    return rows.select(*others, "position", F.transform(order, lambda at: F.get(column, at)).alias("arrangement"))


def combinations_with_replacement(items: DataFrame, column: str, k: int) -> DataFrame:
    """The other columns of ``items``, ``position`` from 0 and ``combination``: all choices of ``k`` places of the array of
    each row, repetition allowed, in lexicographic order of places. Null and empty arrays have none.

    Counted from the end, a position is a sum of binomials of falling tops, which are the chosen places; each top is found
    by bisection. So rows are made independently, in many tasks. Where there are few choices of any size of array, they
    come from a table.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    n = items.agg(F.max(F.size(column))).first()[0] or 0
    if n and math.comb(n + k - 1, k) * (n + k) >= 1 << 63:
        raise ValueError("more combinations than a bigint can number")
    if n and sum(math.comb(m + k - 1, k) for m in range(1, n + 1)) <= TABLE_ROWS:
        return _from_table(items, column, {m: list(combinations(range(m), k)) for m in range(1, n + 1)}, "combination")
    one = F.lit(1).cast("bigint")

    def choose(top: Column, j: Column) -> Column:
        return F.when(top < j, F.lit(0).cast("bigint")).otherwise(F.aggregate(F.sequence(F.lit(1), j), one, lambda b, i: div(b * (top - i + 1), i)))

    size = F.size(column)
    rows = numbered(items.where(size > 0), choose((size + (k - 1)).cast("bigint"), F.lit(k)), "position", math.comb(n + k - 1, k) if n else 0)
    bits = F.array(*[F.lit(1 << b).cast("bigint") for b in range((n + k).bit_length() - 1, -1, -1)])

    def largest(left: Column, j: Column) -> Column:
        """The largest top of a binomial of ``j`` that is not above ``left``."""
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda top, bit: F.when((top + bit < size + k) & (choose(top + bit, j) <= left), top + bit).otherwise(top))

    def pick(acc: Column, j: Column) -> Column:
        return named(largest(acc["left"], j), lambda top: F.struct((acc["left"] - choose(top, j)).alias("left"), F.concat(acc["places"], F.array((size - 1 - (top - (j - 1))).cast("int"))).alias("places")))

    start = F.struct((choose((size + (k - 1)).cast("bigint"), F.lit(k)) - 1 - F.col("position")).alias("left"), F.array().cast("array<int>").alias("places"))
    places = F.aggregate(F.sequence(F.lit(k), F.lit(1), F.lit(-1)), start, pick, lambda acc: acc["places"])
    others = [c for c in items.columns if c != column]
    return rows.select(*others, "position", F.transform(places, lambda at: F.get(column, at)).alias("combination"))
