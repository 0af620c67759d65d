"""Figures that several sources state: side by side, with what is equal, what differs and what is missing where.

Sources of one run contradict each other: a summary says 0 % where the coverage table has a total, a count file says one
class where the list is empty, a file's line total is below the sum of its classes. Nothing is mended here; each figure
keeps its source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratios as R
from .results import MEASURES, classes_to_files, shared_lines_once


def reconcile(sources: dict[str, DataFrame], keys: list[str], metrics: list[str], tolerance: float = 0.0) -> DataFrame:
    """keys, metric, a column for each source, status, gap: one row for each key of any source and each metric.

    Status: ``equal``; ``differs`` by more than ``tolerance``; ``missing in a, b`` where these sources have no row of the
    key, or no such metric; ``blank in a`` where the row has a null; ``several in a`` where rows of one key disagree. ``gap``
    is the largest figure less the smallest, null with fewer than two. Rows meet in one aggregation, which is combined
    before the shuffle; null keys are keys.
    """
    long = []
    for name, df in sources.items():
        some = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics if m in df.columns]
        if some:
            long.append(df.select(*keys, F.lit(name).alias("source_"), F.inline(F.array(*some))))
    here = lambda name: F.col("source_") == name
    figures = []
    for i, name in enumerate(sources):
        value = F.when(here(name), F.col("value"))
        figures += [F.max(value).alias(f"high{i}_"), F.min(value).alias(f"low{i}_"), F.count_if(here(name)).alias(f"rows{i}_")]
    rows = reduce(DataFrame.unionByName, long).groupBy(*keys, "metric").agg(*figures)

    def where(test) -> Column:
        """The names of the sources for which a test holds."""
        return F.array_join(F.array_compact(F.array(*[F.when(test(i), F.lit(n)) for i, n in enumerate(sources)])), ", ")

    rows = rows.select("*", where(lambda i: F.col(f"rows{i}_") == 0).alias("missing_"), where(lambda i: (F.col(f"rows{i}_") > 0) & F.col(f"high{i}_").isNull()).alias("blank_"), where(lambda i: F.col(f"high{i}_") > F.col(f"low{i}_")).alias("several_"))
    known = F.array_compact(F.array(*[F.col(f"high{i}_") for i in range(len(sources))]))
    gap = F.when(F.size(known) > 1, F.array_max(known) - F.array_min(known))
    status = F.when(F.col("several_") != "", F.concat(F.lit("several in "), "several_")).when(F.col("missing_") != "", F.concat(F.lit("missing in "), "missing_")).when(F.col("blank_") != "", F.concat(F.lit("blank in "), "blank_"))
    return rows.select(*keys, "metric", *[F.col(f"high{i}_").alias(n) for i, n in enumerate(sources)], status.when(gap > tolerance, "differs").otherwise("equal").alias("status"), gap.alias("gap"))


def coverage_figures(runs: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Line and branch coverage in percent of run summaries against the total rows of their coverage tables."""
    share = lambda m: (F.col(f"coverage_summary.{m}_coverage") * 100).alias(f"{m}_percent")
    percent = lambda m, part, whole: R.percent_exact(F.col(part), F.col(whole)).alias(f"{m}_percent")
    summary = runs.where(F.col("coverage_summary").isNotNull()).select(*keys, share("line"), share("branch"))
    tables = totals.select(*keys, percent("line", "Line_Covered", "Total_Lines"), percent("branch", "Branch_Covered", "Total_Branches"))
    return reconcile({"summary": summary, "table": tables}, keys, ["line_percent", "branch_percent"], 0.005)


def compiled_figures(runs: DataFrame, counted: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Compiled classes: of the summary, of the count on record, and of the list (runs without a listed class count 0)."""
    names = listed.groupBy(*keys).agg(F.count("*").alias("n"))
    lists = counted.select(*keys).distinct().join(names, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("compiled"))
    counts = counted.select(*keys, F.col("value").try_cast("bigint").alias("compiled"))
    return reconcile({"summary": runs.select(*keys, F.col("compile_pass").alias("compiled")), "count": counts, "list": lists}, keys, ["compiled"])


def funnel_figures(runs: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Generated and compiled tests of run summaries against the head of their console report."""
    summary = runs.select(*keys, F.col("compile_total").alias("tried"), F.col("compile_pass").alias("compiled"))
    return reconcile({"summary": summary, "report": heads.select(*keys, F.col("generated").alias("tried"), "compiled")}, keys, ["tried", "compiled"])


def file_figures(classes: DataFrame, files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts of source files summed over their classes against those on record. A file's own may be lower, as a line that
    classes share counts once in it."""
    at = [*keys, "File"]
    rolled = classes_to_files(classes, list(keys)).select(*at, *[(F.col(f"{m}_MISSED") + F.col(f"{m}_COVERED")).alias(f"{m}_TOTAL") for m in MEASURES], *[f"{m}_COVERED" for m in MEASURES])
    own = files.select(*at, F.col("Total_Lines").alias("LINE_TOTAL"), F.col("Line_Covered").alias("LINE_COVERED"), F.col("Total_Branches").alias("BRANCH_TOTAL"), F.col("Branch_Covered").alias("BRANCH_COVERED"))
    return reconcile({"classes": rolled, "file": own}, at, ["LINE_TOTAL", "LINE_COVERED", "BRANCH_TOTAL", "BRANCH_COVERED"])


def function_figures(blocks: DataFrame, files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Line and branch percentages of a report's functions, summed for each file, against the row of the file in its table.
    A function's lines also count blank and comment lines, so the two need not agree."""
    at, percent = [*keys, "file"], lambda part, whole: R.percent_exact(F.sum(part), F.sum(whole))
    summed = blocks.groupBy(*at).agg(percent("lines_hit", "lines_total").alias("lines"), percent("branches_hit", "branches_total").alias("branches"))
    table = files.select(*at, F.col("pct_lines").alias("lines"), F.col("pct_branch").alias("branches"))
    return reconcile({"functions": summed, "table": table}, at, ["lines", "branches"], 0.01)


def repeated_names(classes: DataFrame, name: str, keys: list[str] = ()) -> DataFrame:
    """Simple names that several classes of full ``name`` share, and how many: a key has to be the full name."""
    out = classes.select(*keys, F.col(name).alias("full_")).distinct().groupBy(*keys, F.substring_index("full_", ".", -1).alias("simple"))
    return out.agg(F.count("*").alias("classes")).where("classes > 1")


def shared_line_gap(lines: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """(keys, cls, line, hits) -> the sums over classes, the figures with shared lines once, and how much the sums are above."""
    by_class = shared_lines_once(lines, [*keys, cls]).groupBy(*keys).agg(F.sum("lines_found").alias("class_found"), F.sum("lines_hit").alias("class_hit"))
    both = by_class.join(shared_lines_once(lines, keys), keys)
    return both.select(*keys, "class_found", "class_hit", "lines_found", "lines_hit", (F.col("class_found") - F.col("lines_found")).alias("found_gap"), (F.col("class_hit") - F.col("lines_hit")).alias("hit_gap"))
