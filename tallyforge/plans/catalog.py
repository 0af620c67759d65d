"""All queries of the library over the driver's tables, each with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexing as X
from ..functions import numeric as N
from ..functions import ratios as R
from ..functions.text import line_list, property_of
from ..operators import reconcile as C
from ..operators import results as O
from ..operators import tables as T

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcome_rate(spark: SparkSession, d: str) -> DataFrame:
    hit = F.count_if(F.col("value") > 50)
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total"), hit.alias("passed"), R.rate_or_zero(hit, F.count("*")).alias("pass_rate"))


def funnel(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(*O.funnel(F.lit(True), F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))


def rollup_total(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("File")).agg(F.count_if(F.col("l_discount") > 0.05).alias("covered"), F.count("*").alias("total"))
    return O.with_total(li, "File", ["covered"], ["total"]).withColumn("covered_pct", F.round("covered_pct", 6))


def left_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    rolled = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return O.all_files(read(spark, d, "customer").select("c_custkey"), rolled, ["c_custkey"])


def no_report(spark: SparkSession, d: str) -> DataFrame:
    return O.missing_reports(read(spark, d, "part").select("p_partkey"), read(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


def _by_priority(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("c"), F.count("*").alias("t"))


def pct_round2(spark: SparkSession, d: str) -> DataFrame:
    return _by_priority(spark, d).select("o_orderpriority", R.percent_rounded(F.col("c"), F.col("t")).alias("pct"), R.percent_rounded(F.col("c"), F.lit(0)).alias("pct_of_none"))


def pct_floor2(spark: SparkSession, d: str) -> DataFrame:
    return _by_priority(spark, d).select("o_orderpriority", R.percent_truncated(F.col("c"), F.col("t")).alias("pct"), R.percent_truncated(F.lit(0), F.lit(0)).alias("pct_of_none"), R.percent_text(F.col("c"), F.lit(0)).alias("overall"))


def coverage_class(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").groupBy("event_type").agg(R.percent_exact(F.count_if(F.col("value") > 20), F.count("*")).alias("p"))
    return rows.select("event_type", R.coverage_class(F.col("p")).alias("class"))


def regex_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.filter_rows(read(spark, d, "part").select("p_partkey", "p_name", "p_type"), "(1|3)5$", ["p_name", "p_type", "p_partkey"])


def regex_fallback(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", F.concat(F.col("s_name"), F.lit(" (A[")).alias("name"))
    return T.filter_rows(s, "1 (a[", ["name"])


def sorted_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    state = T.SortState(T.columns_of(rows))
    state.click(2)  # a number: descending at first
    return state.positions(rows, "s_suppkey", ["s_nationkey"]).select("s_suppkey", "s_nationkey", F.col("position").cast("int").alias("position"))


def whole_positions(spark: SparkSession, d: str) -> DataFrame:
    """The place of each order in a table sorted by a text column, descending."""
    rows = read(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    state = T.SortState(T.columns_of(rows))
    state.click(0)  # the first column is in order already, so it flips
    return state.positions(rows, "o_orderkey")


def next_prev_wrap(spark: SparkSession, d: str) -> DataFrame:
    return T.with_neighbours(read(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_nationkey", ["n_regionkey"])


def whole_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The lines without a discount, each with the next and the one before in the whole table."""
    rows = read(spark, d, "lineitem").where("l_discount = 0").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line")).distinct()
    return T.with_neighbours(rows, "line", "line")


def uncovered_spans(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(F.count_if(F.col("l_quantity") > 25).alias("hits"))
    spans = lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") * 100 + 1).alias("parent"), "hits", F.lit("medium").alias("pct_class"))
    return T.uncovered_spans(spans).select("id", "hits")


def low_cells(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose lines are seldom large, and suppliers that are so as a whole: parts under such a supplier are left out."""
    li = read(spark, d, "lineitem")
    share = R.percent_exact(F.count_if(F.col("l_quantity") > 25), F.count("*"))
    top = li.groupBy("l_suppkey").agg(share.alias("pct")).select(F.col("l_suppkey").alias("id"), F.lit(None).cast("bigint").alias("parent"), "pct")
    parts = li.groupBy("l_suppkey", "l_partkey").agg(share.alias("pct")).select((F.col("l_suppkey") * 10_000_000 + F.col("l_partkey") + 1_000_000).alias("id"), F.col("l_suppkey").alias("parent"), "pct")
    spans = top.unionByName(parts).withColumns({"hits": F.lit(1), "pct_class": R.coverage_class(F.col("pct"))})
    return T.uncovered_spans(spans).select("id", "parent", "pct_class")


def uncovered_list(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").where("l_discount = 0").groupBy("l_orderkey").agg(line_list(F.col("l_linenumber")).alias("uncovered"))


def hit_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.line_counts(read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") > 10, 1).otherwise(0).alias("hits")), ["l_suppkey"])


def kahan(spark: SparkSession, d: str) -> DataFrame:
    out = N.compensated_sum_by(read(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")
    return out.select("o_custkey", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"))


def poisson_cells(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "region").select("r_regionkey", (F.col("r_regionkey") + F.lit(1.0)).alias("rate"))
    return N.poisson_rows(r, "rate").select("r_regionkey", F.col("k").cast("int").alias("k"), F.round("p", 9).alias("p"))


def poisson_of_counts(spark: SparkSession, d: str) -> DataFrame:
    """Shares of customers with so many orders, if orders fell to the customers of a nation by chance."""
    counts = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rates = read(spark, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg((F.coalesce(F.sum("n"), F.lit(0)) / F.count("*")).alias("rate"))
    return N.poisson_rows(rates, "rate").select("c_nationkey", "k", F.round("p", 9).alias("p"))


def permutations(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "region").agg(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey"))), lambda s: s["r_regionkey"].cast("string")).alias("items"))
    return N.permutations(items, "items").select("position", F.array_join("arrangement", ",").alias("arrangement"))


def order_permutations(spark: SparkSession, d: str) -> DataFrame:
    """All orders of the (return flag, line status) pairs of each order."""
    items = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("items"))
    return N.permutations(items, "items").select("l_orderkey", "position", F.array_join("arrangement", ",").alias("arrangement"))


def combinations_repl(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "region").agg(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda s: s["r_name"]).alias("items"))
    rows = N.combinations_with_replacement(items, "items", 2)
    return rows.select("position", F.get("combination", F.lit(0)).alias("first"), F.get("combination", F.lit(1)).alias("second"))


def order_combinations(spark: SparkSession, d: str) -> DataFrame:
    """All triples of the lines of each order, repetition allowed."""
    items = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("items"))
    rows = N.combinations_with_replacement(items, "items", 3)
    return rows.select("l_orderkey", "position", F.array_join(F.transform("combination", lambda x: x.cast("string")), ",").alias("lines"))


def type_cast_nan(spark: SparkSession, d: str) -> DataFrame:
    cell = T.number_cell(F.substring("o_orderpriority", 1, 1))
    bad = T.number_cell(F.col("o_orderpriority"))
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.max(cell).alias("number"), F.max(F.isnan(bad).cast("int")).alias("is_nan"))


def prop_lookup(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.transform(F.map_entries(F.from_json("props", "map<string,string>")), lambda e: F.struct(e["key"].alias("_name"), e["value"].alias("_value")))
    return read(spark, d, "events").select("event_id", property_of(pairs, "k").alias("k"), property_of(pairs, "absent").alias("absent"))


def branch_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_discount") > 0.05, F.col("l_linenumber")).otherwise(0).alias("taken"))
    return O.branch_counts(rows, ["l_suppkey"])


def shared_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber").alias("line"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("hits"))
    return O.shared_lines_once(rows, ["l_partkey"])


def _statement_files(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.floor("l_quantity").cast("bigint").alias("q"), "l_linenumber")
    condition = F.col("l_returnflag") != "N"
    lines = rows.select("l_suppkey", (F.col("q") % 7).alias("count"), F.when(condition, F.col("q") % 3).alias("truecount"), F.when(condition, F.lit(2) - F.col("q") % 3).alias("falsecount"))
    return O.statement_metrics(lines, ["l_suppkey"])


def file_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _statement_files(spark, d)


def all_metrics(spark: SparkSession, d: str) -> DataFrame:
    files = _statement_files(spark, d).withColumns({"methods": F.lit(1).cast("bigint"), "coveredmethods": F.when(F.col("coveredstatements") > 0, 1).otherwise(0).cast("bigint")})
    return O.project_metrics(files)


def file_rollup(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    name = F.split("p_name", " ")
    counts = {f"{m}_{s}": F.pmod(F.col("p_size") * (i + 1) + F.col("p_partkey"), F.lit(k)).cast("int") for i, m in enumerate(O.MEASURES) for s, k in (("MISSED", 5), ("COVERED", 11))}
    classes = part.select(F.lower(F.regexp_replace("p_type", " ", ".")).alias("PACKAGE"), F.concat(name[0], F.lit("."), F.col("p_partkey").cast("string")).alias("CLASS"), *[c.alias(k) for k, c in counts.items()])
    return O.classes_to_files(classes).select("File", "LINE_MISSED", "LINE_COVERED", "BRANCH_MISSED", "BRANCH_COVERED")


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "errored").when(F.col("o_totalprice") > 300000, "failed").when(F.col("o_totalprice") < 20000, "skipped").otherwise("passed")
    cases = read(spark, d, "orders").select("o_custkey", "o_orderpriority", status.alias("status"), F.lit(0.0).alias("time"))
    suites = O.suite_counts(cases, ["o_orderpriority", "o_custkey"])
    return O.with_rates(O.run_counts(suites, ["o_orderpriority"]))


def compiled_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("value"))
    counted = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 12).cast("string").alias("value"))
    return O.compiled_counts(orders, counted, ["c_custkey"])


def reconciled_orders(spark: SparkSession, d: str) -> DataFrame:
    """What orders and their lines say of an order's price and lines."""
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"))
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("lines"))
    return C.reconcile({"orders": orders, "items": lines}, ["o_orderkey"], ["total", "lines"], 0.005).withColumn("gap", F.round("gap", 2))


def shared_line_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.col("l_linenumber").alias("line"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("hits"))
    return C.shared_line_gap(rows, ["l_partkey"], "l_returnflag")


def source_tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.token_rows(read(spark, d, "events").select("event_id", "props"), "props").drop("props")


def page_markup(spark: SparkSession, d: str) -> DataFrame:
    """Comments, declarations, tags and characters of each page."""
    pages = read(spark, d, "pages").select("page_id", "html")
    rows = X.token_rows(pages, "html", "markup").groupBy("page_id")
    part = F.substring("html", F.col("start") + 1, F.col("stop") - F.col("start"))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.agg(count("com").alias("comments"), count("dec").alias("declarations"), F.count_if((F.col("kind") == "tag") & part.startswith("<")).alias("tags"), F.sum(F.col("stop") - F.col("start")).alias("chars"))


FILES = "SELECT l_suppkey, count(*) AS statements, count(*) FILTER (CAST(floor(l_quantity) AS BIGINT) % 7 > 0) AS coveredstatements, CAST(coalesce(sum(CASE WHEN l_returnflag <> 'N' THEN 2 ELSE 0 END), 0) AS BIGINT) AS conditionals, CAST(coalesce(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_quantity) AS BIGINT) % 3 ELSE 0 END), 0) AS BIGINT) AS coveredconditionals FROM lineitem GROUP BY 1"

#: Every order of a list, one swap from the one before: ``c`` counts the swaps at each place, ``i`` is the place at hand.
SWAPS = """WITH RECURSIVE b AS ({items}), s AS (SELECT {keys}a, list_transform(range(len(a)), lambda x: 0) AS c, 1 AS i, CAST(0 AS BIGINT) AS position, true AS shown, len(a) AS n FROM b
UNION ALL SELECT {keys}CASE WHEN c[i + 1] < i THEN list_transform(a, lambda x, k: CASE WHEN k = i + 1 THEN a[CASE WHEN i % 2 = 0 THEN 1 ELSE c[i + 1] + 1 END] WHEN k = CASE WHEN i % 2 = 0 THEN 1 ELSE c[i + 1] + 1 END THEN a[i + 1] ELSE x END) ELSE a END,
CASE WHEN c[i + 1] < i THEN list_transform(c, lambda x, k: CASE WHEN k = i + 1 THEN x + 1 ELSE x END) ELSE list_transform(c, lambda x, k: CASE WHEN k = i + 1 THEN 0 ELSE x END) END,
CASE WHEN c[i + 1] < i THEN 1 ELSE i + 1 END, CASE WHEN c[i + 1] < i THEN position + 1 ELSE position END, c[i + 1] < i, n FROM s WHERE i < n)
SELECT {keys}position, array_to_string(a, ',') AS arrangement FROM s WHERE shown"""

ALL: dict[str, tuple[Query, str | None]] = {
    "outcome_rate": (outcome_rate, "SELECT event_type, count(*) AS total, count(*) FILTER (value > 50) AS passed, coalesce(count(*) FILTER (value > 50) / nullif(count(*), 0), 0.0) AS pass_rate FROM events GROUP BY event_type"),
    "funnel": (funnel, "SELECT o_orderpriority, count(*) AS generated, count(*) FILTER (o_orderstatus <> 'P') AS syntax_ok, count(*) FILTER (o_orderstatus = 'F') AS compiled, count(*) FILTER (o_orderstatus <> 'P') / count(*) AS syntax_rate, count(*) FILTER (o_orderstatus = 'F') / count(*) AS compile_rate FROM orders GROUP BY o_orderpriority"),
    "rollup_total": (rollup_total, "WITH g AS (SELECT l_returnflag AS \"File\", count(*) FILTER (l_discount > 0.05) AS covered, count(*) AS total FROM lineitem GROUP BY 1) SELECT \"File\", covered, total, round(100.0 * covered / total, 2) AS covered_pct FROM g UNION ALL SELECT 'Total', CAST(sum(covered) AS BIGINT), CAST(sum(total) AS BIGINT), round(100.0 * sum(covered) / sum(total), 6) FROM g"),
    "left_zero_fill": (left_zero_fill, "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey"),
    "no_report": (no_report, "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"),
    "pct_round2": (pct_round2, "SELECT o_orderpriority, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS pct, CAST(0 AS DOUBLE) AS pct_of_none FROM orders GROUP BY 1"),
    "pct_floor2": (pct_floor2, "SELECT o_orderpriority, floor(count(*) FILTER (o_orderstatus = 'F') * 10000 / count(*)) / 100 AS pct, CAST(100 AS DOUBLE) AS pct_of_none, 'Unknown%' AS overall FROM orders GROUP BY 1"),
    "coverage_class": (coverage_class, "SELECT event_type, CASE WHEN p >= 80 THEN 'high' WHEN p >= 50 THEN 'medium' ELSE 'low' END AS class FROM (SELECT event_type, 100.0 * count(*) FILTER (value > 20) / count(*) AS p FROM events GROUP BY 1)"),
    "regex_filter": (regex_filter, "SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(concat_ws(chr(10), p_name, p_type, CAST(p_partkey AS VARCHAR)), '(1|3)5$', 'i')"),
    "regex_fallback": (regex_fallback, "SELECT s_suppkey, s_name || ' (A[' AS name FROM supplier WHERE contains(lower(s_name || ' (A['), '1 (a[')"),
    "sorted_positions": (sorted_positions, "SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS position FROM supplier"),
    "next_prev_wrap": (next_prev_wrap, "SELECT n_nationkey, n_regionkey, coalesce(lead(n_nationkey) OVER w, first_value(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_, coalesce(lag(n_nationkey) OVER w, last_value(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_ FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)"),
    "whole_positions": (whole_positions, "SELECT o_orderpriority, o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS position FROM orders"),
    "whole_neighbours": (whole_neighbours, "WITH l AS (SELECT DISTINCT l_orderkey * 100 + l_linenumber AS line FROM lineitem WHERE l_discount = 0) SELECT line, coalesce(lead(line) OVER w, min(line) OVER ()) AS next_, coalesce(lag(line) OVER w, max(line) OVER ()) AS previous_ FROM l WINDOW w AS (ORDER BY line)"),
    "uncovered_spans": (uncovered_spans, "WITH s AS (SELECT l_orderkey * 100 + l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 100 + 1 END AS parent, count(*) FILTER (l_quantity > 25) AS hits FROM lineitem GROUP BY l_orderkey, l_linenumber), u AS (SELECT * FROM s WHERE hits = 0) SELECT id, hits FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.id = u.parent)"),
    "low_cells": (low_cells, "WITH s AS (SELECT l_suppkey AS id, CAST(NULL AS BIGINT) AS parent, 100.0 * count(*) FILTER (l_quantity > 25) / count(*) AS pct FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey * 10000000 + l_partkey + 1000000, l_suppkey, 100.0 * count(*) FILTER (l_quantity > 25) / count(*) FROM lineitem GROUP BY l_suppkey, l_partkey), u AS (SELECT * FROM s WHERE pct < 50) SELECT id, parent, 'low' AS pct_class FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.id = u.parent)"),
    "uncovered_list": (uncovered_list, "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS uncovered FROM lineitem WHERE l_discount = 0 GROUP BY 1"),
    "hit_counts": (hit_counts, "SELECT l_suppkey, count(*) AS lines_found, count(*) FILTER (l_quantity > 10) AS lines_hit FROM lineitem GROUP BY 1"),
    "kahan": (kahan, "SELECT o_custkey, round(fsum(o_totalprice), 2) AS total, round(fsum(o_totalprice) / count(*), 6) AS mean FROM orders GROUP BY 1"),
    "poisson_cells": (poisson_cells, "WITH RECURSIVE c AS (SELECT r_regionkey, r_regionkey + 1.0::DOUBLE AS l, 0 AS k, exp(-(r_regionkey + 1.0::DOUBLE)) AS p, exp(-(r_regionkey + 1.0::DOUBLE)) AS s FROM region UNION ALL SELECT r_regionkey, l, k + 1, p * l / (k + 1), s + p * l / (k + 1) FROM c WHERE s < 0.9999) SELECT r_regionkey, k, round(p, 9) AS p FROM c"),
    "poisson_of_counts": (poisson_of_counts, "WITH RECURSIVE r AS (SELECT c_nationkey, coalesce(sum(n), 0) / count(*) AS l FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1), c AS (SELECT c_nationkey, l, CAST(0 AS BIGINT) AS k, exp(-l) AS p, exp(-l) AS s FROM r WHERE l > 0 UNION ALL SELECT c_nationkey, l, k + 1, p * l / (k + 1), s + p * l / (k + 1) FROM c WHERE s < 0.9999) SELECT c_nationkey, k, round(p, 9) AS p FROM c"),
    "permutations": (permutations, SWAPS.format(keys="", items="SELECT list(CAST(r_regionkey AS VARCHAR) ORDER BY r_regionkey) AS a FROM region")),
    "order_permutations": (order_permutations, SWAPS.format(keys="l_orderkey, ", items="SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS a FROM lineitem GROUP BY 1")),
    "combinations_repl": (combinations_repl, "SELECT row_number() OVER (ORDER BY a.r_regionkey, b.r_regionkey) - 1 AS position, a.r_name AS first, b.r_name AS second FROM region a JOIN region b ON a.r_regionkey <= b.r_regionkey"),
    "order_combinations": (order_combinations, "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS x FROM lineitem) SELECT a.l_orderkey, row_number() OVER (PARTITION BY a.l_orderkey ORDER BY a.x, b.x, c.x) - 1 AS position, concat_ws(',', a.x, b.x, c.x) AS lines FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.x <= b.x JOIN l c ON a.l_orderkey = c.l_orderkey AND b.x <= c.x"),
    "type_cast_nan": (type_cast_nan, "SELECT o_orderpriority, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS number, max(CASE WHEN try_cast(o_orderpriority AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS is_nan FROM orders GROUP BY o_orderpriority"),
    "prop_lookup": (prop_lookup, "SELECT event_id, props->>'$.k' AS k, props->>'$.absent' AS absent FROM events"),
    "branch_totals": (branch_totals, "SELECT l_suppkey, count(*) AS branches_found, count(*) FILTER (l_discount > 0.05 AND l_linenumber > 0) AS branches_hit FROM lineitem GROUP BY 1"),
    "shared_lines": (shared_lines, "SELECT l_partkey, count(DISTINCT l_linenumber) AS lines_found, count(DISTINCT l_linenumber) FILTER (l_quantity > 25) AS lines_hit FROM lineitem GROUP BY 1"),
    "file_metrics": (file_metrics, f"SELECT * FROM ({FILES})"),
    "all_metrics": (all_metrics, f"SELECT *, statements + conditionals + methods AS elements, coveredstatements + coveredconditionals + coveredmethods AS coveredelements FROM (SELECT CAST(sum(statements) AS BIGINT) AS statements, CAST(sum(coveredstatements) AS BIGINT) AS coveredstatements, CAST(sum(conditionals) AS BIGINT) AS conditionals, CAST(sum(coveredconditionals) AS BIGINT) AS coveredconditionals, count(*) AS methods, count(*) FILTER (coveredstatements > 0) AS coveredmethods FROM ({FILES}))"),
    "file_rollup": (file_rollup, "SELECT replace(lower(p_type), ' ', '/') || '/' || split_part(p_name, ' ', 1) || '.java' AS \"File\", CAST(sum((p_size * 3 + p_partkey) % 5) AS BIGINT) AS \"LINE_MISSED\", CAST(sum((p_size * 3 + p_partkey) % 11) AS BIGINT) AS \"LINE_COVERED\", CAST(sum((p_size * 2 + p_partkey) % 5) AS BIGINT) AS \"BRANCH_MISSED\", CAST(sum((p_size * 2 + p_partkey) % 11) AS BIGINT) AS \"BRANCH_COVERED\" FROM part GROUP BY 1"),
    "run_totals": (run_totals, "WITH s AS (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'errored' WHEN o_totalprice > 300000 THEN 'failed' WHEN o_totalprice < 20000 THEN 'skipped' ELSE 'passed' END AS st FROM orders) SELECT o_orderpriority, count(*) AS tests, count(*) FILTER (st = 'failed') AS failures, count(*) FILTER (st = 'errored') AS errors, count(*) FILTER (st = 'skipped') AS skipped, count(*) FILTER (st = 'passed') AS passed, count(*) FILTER (st <> 'skipped') AS total, coalesce(count(*) FILTER (st = 'passed') / nullif(count(*) FILTER (st <> 'skipped'), 0), 0.0) AS pass_rate FROM s GROUP BY 1"),
    "compiled_counts": (compiled_counts, "SELECT c_custkey, coalesce(n, 0) AS listed, CAST(c_custkey % 12 AS BIGINT) AS counted, coalesce(n, 0) = c_custkey % 12 AS agrees FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey"),
    "reconciled_orders": (reconciled_orders, "WITH i AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, count(*) AS lines FROM lineitem GROUP BY 1), b AS (SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, o_orderkey IS NULL AS no_order, l_orderkey IS NULL AS no_items, o_totalprice, total, CAST(lines AS DOUBLE) AS lines FROM orders FULL JOIN i ON o_orderkey = l_orderkey) SELECT o_orderkey, 'total' AS metric, o_totalprice AS orders, total AS items, CASE WHEN no_order THEN 'missing in orders' WHEN no_items THEN 'missing in items' WHEN abs(o_totalprice - total) > 0.005 THEN 'differs' ELSE 'equal' END AS status, round(abs(o_totalprice - total), 2) AS gap FROM b UNION ALL SELECT o_orderkey, 'lines', NULL, lines, 'missing in orders', NULL FROM b WHERE NOT no_items"),
    "shared_line_gap": (shared_line_gap, "WITH c AS (SELECT l_partkey, l_returnflag, l_linenumber, max(l_quantity) > 25 AS hit FROM lineitem GROUP BY 1, 2, 3), f AS (SELECT l_partkey, l_linenumber, max(l_quantity) > 25 AS hit FROM lineitem GROUP BY 1, 2), x AS (SELECT l_partkey, count(*) AS class_found, count(*) FILTER (hit) AS class_hit FROM c GROUP BY 1), y AS (SELECT l_partkey, count(*) AS lines_found, count(*) FILTER (hit) AS lines_hit FROM f GROUP BY 1) SELECT l_partkey, class_found, class_hit, lines_found, lines_hit, class_found - lines_found AS found_gap, class_hit - lines_hit AS hit_gap FROM x JOIN y USING (l_partkey)"),
    "source_tokens": (source_tokens, r"""WITH t AS (SELECT event_id, unnest(x) AS token, generate_subscripts(x, 1) - 1 AS n FROM (SELECT event_id, regexp_extract_all(props, '\s+|"(?:[^"\\]|\\.)*"|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|[A-Za-z_$][A-Za-z0-9_$]*|.') AS x FROM events)), s AS (SELECT *, sum(length(token)) OVER (PARTITION BY event_id ORDER BY n) AS stop FROM t) SELECT event_id, CAST(n AS INTEGER) AS n, CASE WHEN regexp_matches(token, '^\s') THEN 'pln' WHEN token[1] = '"' THEN 'str' WHEN regexp_matches(token, '^[0-9]') OR token IN ('true', 'false', 'null') THEN 'lit' WHEN regexp_matches(token, '^[A-Za-z_$]') THEN 'pln' ELSE 'pun' END AS kind, CAST(stop - length(token) AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM s"""),
    "page_markup": (page_markup, r"""WITH p AS (SELECT page_id, length(html) AS chars, regexp_replace(html, '(?is)(<(script|style)(?:\s[^>]*)?>).*?(</(?:script|style)[\s/>])', '\1\3', 'g') AS h FROM pages) SELECT page_id, len(regexp_extract_all(h, '(?s)<!--.*?-->')) AS comments, len(regexp_extract_all(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '<[!?]')) AS declarations, len(regexp_extract_all(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '</?[A-Za-z]')) AS tags, chars FROM p WHERE chars > 0"""),
}


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ALL.items() if sql}
