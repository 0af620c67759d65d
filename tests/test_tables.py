"""Filters, typed cells, whole-table order and neighbours: against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.patterns import java_pattern
from tallyforge.operators import tables as T

CASES = [
    # pattern, text, whether it is valid, whether the row matches
    ("a++", "xa++y", False, True), ("a++", "aaa", False, False), ("[^]", "", True, False), ("^[^]$", "\n", True, True), ("[]", "[]", True, False),
    ("é", "É", True, True), ("ΣΑΣ", "σας", True, True), ("s", "ſ", True, False), ("ſ", "ſ", True, True), ("k", "\u212a", True, False), ("\u212a", "\u212a", True, True),
    ("end$", "the end\n", True, False), ("end$", "the END", True, True), ("a{,2}", "a{,2}", True, True), ("x{2,1}", "x{2,1}", False, True), ("x{1}{2}", "xx", False, False),
    ("(?i)a", "(?I)A", False, True), ("(?>a)", "a", False, False), (r"\v", "\x0b", True, True), (r"\v", "\n", True, False), (r"\h\Q\E", "hQe", True, True), (r"\p{L}", "p{l}", True, True),
    (r"^\s$", "\ufeff", True, True), (r"\cA", "\x01", True, True), (r"\c!", r"\c!", True, True), (r"\0", "\0", True, True), (r"\101", "a", True, True), (r"\x4", "x4", True, True), (r"\u00e9", "É", True, True),
    (r"(a)\1", "aa", True, True), (r"^\1(a)$", "a", True, True), (r"(?<q>.)\k<q>", "zz", True, True), (r"\k<q>", "k<q>", True, True), (r"(?<q>a)\k<r>", "aa", False, False),
    ("[b-a]", "[b-a]", False, True), (r"^[\w-z]$", "-", True, True), ("[a&&b]", "&", True, True), ("^[[a]$", "[", True, True), ("]", "]", True, True), ("a]b}", "A]B}", True, True),
    ("(?=a)*b", "b", True, True), ("(?<=a)*b", "b", False, False), ("(?<!a)b", "cb", True, True), ("(", "(", False, True), (")", ")", False, True), ("*", "*", False, True), ("a|*", "a", False, False), ("a\\", "a\\", False, True),
    (r"\bé", "é", True, False), (r"a\b", "aé", True, True), (".", "\u2028", True, False), (".", "\x85", True, True), ("", "anything", True, True), ("a|", "b", True, True), ("(?:a|b)+?c", "ABC", True, True),
]


def test_filter_dialect(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(CASES)], "id int, t string")
    for pattern in dict.fromkeys(c[0] for c in CASES):
        got = {r.id for r in T.filter_rows(df, pattern, ["t"]).collect()}
        for i, (p, text, valid, match) in enumerate(CASES):
            if p == pattern:
                assert (java_pattern(p) is not None) == valid, p
                assert (i in got) == match, (p, text)


def test_plain_patterns_mean_the_same(spark):
    """Patterns that mean the same here and there, at random."""
    r = random.Random(9)
    texts = ["".join(r.choice("abc \n") for _ in range(r.randrange(8))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")

    def make(depth):
        part = lambda: r.choice(["a", "b", ".", "[ab]", "[^a]", r"\s", r"\w", f"(?:{make(depth - 1)})" if depth else "c", f"({make(depth - 1)})" if depth else "b"]) + r.choice(["", "", "*", "+?", "{1,2}", "?"])
        return r.choice(["", "^", "|"]) + "".join(part() for _ in range(r.randint(1, 3)))

    for _ in range(25):
        p = make(2)
        got = {x.id for x in T.filter_rows(df, p, ["t"]).collect()}
        assert got == {i for i, t in enumerate(texts) if re.search(p, t, re.I | re.A)}, p


def test_number_cells(spark):
    nan, inf = math.nan, math.inf
    cases = {"": 0, " \t \ufeff": 0, "12": 12, " +5. ": 5, ".5": 0.5, "-1e3": -1000, "0x1f": 31, "0B101": 5, "0o17": 15, "Infinity": inf, "-Infinity": -inf, "infinity": nan, "1d": nan, "nan": nan, "NaN": nan, "1_0": nan, "-0x1": nan, "0x": nan, "1 2": nan, ".": nan, "1e": nan, "1f": nan, "80%": nan, "0xffffffffffffffffff": float(0xFFFFFFFFFFFFFFFFFF), None: 0}
    got = [r.n for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", T.number_cell(F.col("c")).alias("n")).orderBy("i").collect()]
    for c, a, b in zip(cases, got, cases.values(), strict=True):
        assert a == b or math.isnan(a) and math.isnan(b), c


def test_order_of_text_and_numbers(spark):
    names = ["\U0001f600", "\uff21", "a", "B", None, "é", "a"]
    df = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(zip(names, [1.0, math.nan, None, -1.0, 0.0, 2.0, math.nan], strict=True))], "pos int, name string, x double")
    order = lambda c, d: [r.pos for r in T.sort_by(df, c, "pos", d).collect()]
    units = sorted((i for i in range(7) if names[i] is not None), key=lambda i: names[i].encode("utf-16-be"))
    assert order("name", False) == [*units, 4] and order("name", False).index(0) < order("name", False).index(1)
    assert order("name", True) == [1, 0, 5, 2, 6, 3, 4]  # ties stay in order
    assert order("x", False) == [3, 2, 4, 0, 5, 1, 6] and order("x", True) == [5, 0, 2, 4, 3, 1, 6]


def ring(items):
    return {x: (items[(i + 1) % len(items)], items[i - 1]) for i, x in enumerate(items)}


@pytest.mark.parametrize("options", [{"ranges": 8}, {"ranges": 1}, {}])
def test_positions_and_neighbours_of_a_whole_table(spark, options):
    r = random.Random(3)
    rows = [(i, r.choice("abcd"), r.randrange(4)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, name string, n int").repartition(6)
    state = T.SortState(T.columns_of(df))
    state.click(2)  # descending, with many ties
    placed = state.positions(df, "id", **options)
    assert {x.id: x.position for x in placed.collect()} == {x[0]: i + 1 for i, x in enumerate(sorted(rows, key=lambda x: (-x[2], x[0])))}
    near = T.with_neighbours(df, "id", "n", **options)
    assert {x.id: (x.next_, x.previous_) for x in near.collect()} == ring([x[0] for x in sorted(rows, key=lambda x: (x[2], x[0]))])
    for plan in (placed, near):
        text = plan._jdf.queryExecution().analyzed().toString()
        assert "windowspecdefinition(" not in text or "windowspecdefinition(part_" in text
    one = df.where("id = 7")
    assert [(x.next_, x.previous_) for x in T.with_neighbours(one, "id", "n", **options).collect()] == [(7, 7)]
    assert T.with_neighbours(df.where("false"), "id", "n", **options).count() == 0 and state.positions(df.where("false"), "id", **options).count() == 0


@pytest.mark.parametrize("most", [0, 10, 10**6])
def test_large_partitions_cross_ranges(spark, most):
    r = random.Random(5)
    rows = [(i if i % 50 else None, r.choice(["hot", "hot", "hot", "b", None]), i) for i in range(400)] + [(1000, "single", 3)]
    df = spark.createDataFrame(rows, "id int, p string, n int").repartition(5)
    want_next, want_place = {}, {}
    for p in {x[1] for x in rows}:
        own = [x for x in sorted(rows, key=lambda x: x[2]) if x[1] == p]
        for i, x in enumerate(own):
            want_place[x[2], p] = i + 1
            want_next[x[2], p] = (own[(i + 1) % len(own)][0], own[i - 1][0])
    near = T.with_neighbours(df, "id", "n", ["p"], most=most, ranges=7).collect()
    assert {(x.n, x.p): (x.next_, x.previous_) for x in near} == want_next and len(near) == len(rows)
    placed = T.with_positions(df, [F.col("n").asc()], ["p"], most=most, ranges=7).collect()
    assert {(x.n, x.p): x.position for x in placed} == want_place


def test_clicks_on_a_fixed_column_do_nothing(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a")], "pos int, name string")
    state = T.SortState(T.columns_of(df, fixed=("name",)))
    state.click(1)
    assert (state.index, state.descending) == (0, False)
