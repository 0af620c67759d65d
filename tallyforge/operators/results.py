"""Outcomes, counts and coverage roll-ups of test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratios as R
from ..functions.text import source_file

MEASURES = ["INSTRUCTION", "BRANCH", "LINE", "COMPLEXITY", "METHOD"]


def outcome(failure: Column, error: Column) -> Column:
    return F.when(failure.isNotNull(), "failed").when(error.isNotNull(), "errored").otherwise("passed")


def suite_counts(cases: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    count = lambda x: F.count_if(F.col(status) == x)
    return cases.groupBy(*keys).agg(F.count("*").alias("tests"), count("failed").alias("failures"), count("errored").alias("errors"), count("skipped").alias("skipped"), F.sum("time").alias("case_time"))


def run_counts(suites: DataFrame, keys: list[str]) -> DataFrame:
    sums = suites.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tests", "failures", "errors", "skipped")])
    return sums.withColumn("passed", F.col("tests") - F.col("failures") - F.col("errors") - F.col("skipped"))


def with_rates(runs: DataFrame) -> DataFrame:
    """total = passed + failures + errors (skipped do not count) and the unrounded pass rate, 0 without any."""
    total = F.col("passed") + F.col("failures") + F.col("errors")
    return runs.withColumn("total", total).withColumn("pass_rate", R.rate_or_zero(F.col("passed"), total))


def funnel(generated: Column, parsed: Column, compiled: Column) -> list[Column]:
    """Three stages with their share of the first; aggregates over boolean columns."""
    n, p, c = F.count_if(generated), F.count_if(generated & parsed), F.count_if(generated & parsed & compiled)
    return [n.alias("generated"), p.alias("syntax_ok"), c.alias("compiled"), R.rate_or_zero(p, n).alias("syntax_rate"), R.rate_or_zero(c, n).alias("compile_rate")]


def classes_to_files(classes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Missed and covered counts of each source file, summed over its classes. A line that two classes share counts
    twice here, as class rows do not say which lines they have."""
    rows = classes.withColumn("File", source_file(F.col("PACKAGE"), F.col("CLASS")))
    return rows.groupBy(*keys, "File").agg(*[F.sum(f"{m}_{s}").alias(f"{m}_{s}") for m in MEASURES for s in ("MISSED", "COVERED")])


def all_files(files: DataFrame, rolled: DataFrame, keys: list[str]) -> DataFrame:
    """Every file, with zeros where no class was measured."""
    counts = [c for c in rolled.columns if c not in keys]
    return files.join(rolled, keys, "left").na.fill(0, counts)


def with_total(df: DataFrame, label: str, parts: list[str], wholes: list[str]) -> DataFrame:
    """Rows with two-decimal percentages and one ``Total`` row with unrounded ones: the ratio of the sums."""
    named = dict(zip(parts, wholes, strict=True))
    body = df.select(label, *parts, *wholes, *[R.percent_rounded(F.col(p), F.col(w)).alias(f"{p}_pct") for p, w in named.items()])
    sums = df.agg(*[F.sum(c).alias(c) for c in (*parts, *wholes)])
    total = sums.select(F.lit("Total").alias(label), *parts, *wholes, *[R.percent_exact(F.col(p), F.col(w)).alias(f"{p}_pct") for p, w in named.items()])
    return body.unionByName(total)


def line_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """LF and LH: lines found and lines hit."""
    return lines.groupBy(*keys).agg(F.count("*").alias("lines_found"), F.count_if(R.is_hit(F.col("hits"))).alias("lines_hit"))


def branch_counts(branches: DataFrame, keys: list[str]) -> DataFrame:
    """BRF and BRH: branches found and branches taken."""
    return branches.groupBy(*keys).agg(F.count("*").alias("branches_found"), F.count_if(R.is_hit(F.col("taken"))).alias("branches_hit"))


def trace_totals(records: DataFrame) -> DataFrame:
    """The four totals of each trace record, counted from its lines and branches."""
    hit = lambda a, f: F.size(F.filter(a, lambda x: R.is_hit(x[f])))
    return records.select("path", "file", F.size("lines").alias("lines_found"), hit("lines", "hits").alias("lines_hit"), F.size("branches").alias("branches_found"), hit("branches", "taken").alias("branches_hit"))


def shared_lines_once(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, hits) of several classes -> lines found and hit of each file; a line that classes share counts once
    and is hit if any of them hits it."""
    once = lines.groupBy(*keys, "line").agg(F.max("hits").alias("hits"))
    return line_counts(once, keys)


COVERED = ("statements", "conditionals", "methods")


def statement_metrics(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of a file from its lines (count, truecount, falsecount): each line is a statement, each way of a condition
    a conditional."""
    ways = lambda *c: F.coalesce(F.sum(sum((F.coalesce(x, F.lit(0)) for x in c), F.lit(0))), F.lit(0))
    return lines.groupBy(*keys).agg(
        F.count("*").alias("statements"),
        F.count_if(R.is_hit(F.col("count"))).alias("coveredstatements"),
        ways(F.col("truecount"), F.col("falsecount")).alias("conditionals"),
        ways(F.col("truecount")).alias("coveredconditionals"),
    )


def project_metrics(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sums over the files, and their elements: statements, conditionals and methods together."""
    sums = files.groupBy(*keys).agg(*[F.coalesce(F.sum(p + c), F.lit(0)).alias(p + c) for c in COVERED for p in ("", "covered")])
    whole = lambda p: sum((F.col(p + c) for c in COVERED), F.lit(0))
    return sums.withColumns({"elements": whole(""), "coveredelements": whole("covered")})


def compiled_counts(listed: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value) of both -> keys, listed (non-blank lines), counted (the number on record), agrees. The number on
    record stands; a list may be empty although a class was compiled."""
    names = listed.groupBy(*keys).agg(F.count("*").alias("listed"))
    numbers = counted.groupBy(*keys).agg(F.max(F.col("value").try_cast("bigint")).alias("counted"))
    both = numbers.join(names, keys, "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    return both.select(*keys, "listed", "counted", (F.col("listed") == F.col("counted")).alias("agrees"))


def missing_reports(compiled: DataFrame, suites: DataFrame, keys: list[str]) -> DataFrame:
    """Compiled classes that no suite reports on."""
    return compiled.join(suites.select(*keys).distinct(), keys, "left_anti")


def time_is_consistent(suites: DataFrame) -> DataFrame:
    """Suites whose own time is below the sum of their cases': should be empty."""
    return suites.where(F.col("time") < F.col("case_time") - 1e-9)
