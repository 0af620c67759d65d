"""Readers and writers of run artifacts, each with a declared schema. Every reader adds ``path``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import ColumnInfo, number_cell

MAVEN_RUN = """total bigint, syntax_correct bigint, syntax_correct_rate double, compile_pass bigint,
test_summary struct<total bigint, passed bigint, failures bigint, errors bigint, pass_rate double>,
coverage_summary struct<instruction_coverage double, branch_coverage double, line_coverage double, complexity_coverage double, method_coverage double>"""
JEST_RUN = """compile_pass bigint, compile_total bigint, compile_pass_rate double,
testcase struct<total bigint, passed bigint, failed bigint, skipped bigint, test_pass_rate double, run_pass_rate double, num_total_suites bigint, num_passed_suites bigint, num_reported_test_suites bigint>,
coverage struct<total_line_coverage double, total_branch_coverage double, total_function_coverage double, total_statement_coverage double, file_coverage map<string,string>, summary map<string,string>>"""
OUTCOME = "struct<_type string, _message string, _VALUE string>".replace(" string", ":string")
CASE = f"_name string, _classname string, _time double, failure {OUTCOME}, error {OUTCOME}, skipped {OUTCOME}, `system-err` string"
SUITE = "_name string, _time double, _tests bigint, _errors bigint, _skipped bigint, _failures bigint, _version string, properties struct<property:array<struct<_name:string,_value:string>>>, testcase array<struct<_name:string,_classname:string,_time:double,failure:" + OUTCOME + ",error:" + OUTCOME + ",skipped:" + OUTCOME + ",`system-err`:string>>"
CLASS_COVERAGE = "GROUP string, PACKAGE string, CLASS string, " + ", ".join(f"{m}_{s} int" for m in ("INSTRUCTION", "BRANCH", "LINE", "COMPLEXITY", "METHOD") for s in ("MISSED", "COVERED"))
FILE_COVERAGE = "File string, Line_Missed int, Line_Covered int, Total_Lines int, `Line_Coverage%` double, Branch_Missed int, Branch_Covered int, Total_Branches int, `Branch_Coverage%` double"
CLOVER_FILE = "_name string, _path string, metrics struct<_statements:bigint,_coveredstatements:bigint,_conditionals:bigint,_coveredconditionals:bigint,_methods:bigint,_coveredmethods:bigint>, line array<struct<_num:bigint,_count:bigint,_type:string,_truecount:bigint,_falsecount:bigint>>"
#: How a run's folder is named: [specification_]framework_model, with a stray 1 allowed at the end.
RUN_NAME = r"^(specification_)?(junit4|junit5|jest)_(CodeLlama-7b|DS6\.7b|DSv3\.2|gpt4o)1?$"


def with_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.col("_metadata.file_path"))


def dimensions(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds project, run, specification, framework, model; names that do not parse keep NULL dimensions."""
    run = F.regexp_extract(path, r"test_results/([^/]+)/([^/]+)/", 2)
    part = lambda i: F.nullif(F.regexp_extract("run", RUN_NAME, i), F.lit(""))
    df = df.withColumn("project", F.nullif(F.regexp_extract(path, r"test_results/([^/]+)/", 1), F.lit(""))).withColumn("run", F.nullif(run, F.lit("")))
    known = F.col("run").rlike(RUN_NAME)
    return df.withColumn("specification", F.when(known, part(1).isNotNull())).withColumn("framework", part(2)).withColumn("model", part(3))


def maven_runs(spark: SparkSession, path: str) -> DataFrame:
    return with_path(spark.read.schema(MAVEN_RUN).option("multiLine", True).json(path))


def jest_runs(spark: SparkSession, path: str) -> DataFrame:
    return with_path(spark.read.schema(JEST_RUN).option("multiLine", True).json(path))


def all_runs(maven: DataFrame, jest: DataFrame) -> DataFrame:
    """Both kinds in one shape; what a kind lacks is NULL, and ``source`` keeps contradictory figures apart."""
    left = maven.select("path", F.lit("maven").alias("source"), "test_summary.*", "compile_pass", "syntax_correct")
    t = F.col("testcase")
    right = jest.select("path", F.lit("jest").alias("source"), t["total"].alias("total"), t["passed"].alias("passed"), t["failed"].alias("failures"), t["test_pass_rate"].alias("pass_rate"), "compile_pass", "compile_total")
    return left.unionByName(right, allowMissingColumns=True)


def suites(spark: SparkSession, path: str) -> DataFrame:
    return with_path(spark.read.format("xml").option("rowTag", "testsuite").schema(SUITE).load(path))


def cases(spark: SparkSession, path: str) -> DataFrame:
    return with_path(spark.read.format("xml").option("rowTag", "testcase").schema(CASE).load(path))


def class_coverage(spark: SparkSession, path: str) -> DataFrame:
    return with_path(spark.read.schema(CLASS_COVERAGE).option("header", True).csv(path))


def file_coverage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows of files, total rows)."""
    rows = with_path(spark.read.schema(FILE_COVERAGE).option("header", True).csv(path))
    return rows.where("File <> 'Total'"), rows.where("File = 'Total'")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines: compiled classes, or their count."""
    return with_path(spark.read.text(path)).withColumn("value", F.trim("value")).where("value <> ''")


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of a trace file: file, functions, lines, branches and the recorded totals."""
    rows = with_path(spark.read.option("lineSep", "end_of_record").text(path)).where("trim(regexp_replace(value, '\\\\s', '')) <> ''")
    ints = lambda pattern, i: F.transform(F.regexp_extract_all("value", F.lit(pattern), F.lit(i)), lambda x: x.cast("bigint"))
    text = lambda pattern, i: F.regexp_extract_all("value", F.lit(pattern), F.lit(i))
    one = lambda tag: F.regexp_extract("value", rf"(?m)^{tag}:(\d+)", 1).try_cast("int").alias(tag.lower())
    da, brda, fn, fnda = r"(?m)^DA:(\d+),(\d+)", r"(?m)^BRDA:(\d+),(\d+),(\d+),(\d+|-)", r"(?m)^FN:(\d+),(.+)$", r"(?m)^FNDA:(\d+),(.+)$"
    rows = rows.withColumn("hits_", F.arrays_zip(text(fnda, 2).alias("name"), ints(fnda, 1).alias("hits")))
    last = lambda name: F.try_element_at(F.filter("hits_", lambda h: h["name"] == name), F.lit(-1))["hits"]  # noqa: E731  of repeated names the last counts
    functions = F.transform(F.arrays_zip(ints(fn, 1).alias("line"), text(fn, 2).alias("name")), lambda f: F.struct(f["line"].cast("int").alias("line"), f["name"].alias("name"), last(f["name"]).alias("hits")))
    branches = F.transform(F.arrays_zip(ints(brda, 1).alias("line"), ints(brda, 2).alias("block"), ints(brda, 3).alias("branch"), text(brda, 4).alias("taken")), lambda b: F.struct(b["line"].alias("line"), b["block"].alias("block"), b["branch"].alias("branch"), F.coalesce(b["taken"].try_cast("bigint"), F.lit(0)).alias("taken")))
    return rows.select(
        "path", F.regexp_extract("value", r"(?m)^SF:(.+)$", 1).alias("file"), functions.alias("functions"), F.arrays_zip(ints(da, 1).alias("line"), ints(da, 2).alias("hits")).alias("lines"), branches.alias("branches"),
        *[one(t) for t in ("FNF", "FNH", "LF", "LH", "BRF", "BRH")],
    )


def clover(spark: SparkSession, path: str) -> DataFrame:
    return with_path(spark.read.format("xml").option("rowTag", "file").schema(CLOVER_FILE).load(path))


def clover_lines(files: DataFrame) -> DataFrame:
    """A row for each line of each file; files without lines have none."""
    rows = files.select("path", F.col("_name").alias("file"), F.explode("line").alias("l"))
    return rows.select("path", "file", F.col("l._num").alias("line"), F.col("l._type").alias("type"), F.col("l._count").alias("count"), F.col("l._truecount").alias("truecount"), F.col("l._falsecount").alias("falsecount"))


def clover_metrics(files: DataFrame) -> DataFrame:
    """The metrics of each file as recorded."""
    names = [p + c for c in ("statements", "conditionals", "methods") for p in ("", "covered")]
    return files.select("path", F.col("_name").alias("file"), *[F.col(f"metrics._{n}").alias(n) for n in names])


def console_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a pipe-separated console table: file and its four percentages, and uncovered lines as text."""
    cells = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    rows = with_path(spark.read.text(path)).where(F.size(F.split("value", r"\|")) == 6).withColumn("c", cells).where("try_cast(c[1] AS double) IS NOT NULL")
    names = ["pct_stmts", "pct_branch", "pct_funcs", "pct_lines"]
    return rows.select("path", F.col("c")[0].alias("file"), *[F.col("c")[i + 1].try_cast("double").alias(n) for i, n in enumerate(names)], F.col("c")[5].alias("uncovered"))


def function_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks headed by file and function labels (in Chinese) with hit and total lines and branches."""
    text = with_path(spark.read.text(path, wholetext=True))
    block = r"文件[::]\s*(.+?)\s*\n\s*函数[::]\s*(.+?)\s*\n\D*?行覆盖率[^\n]*?(\d+)\s*/\s*(\d+)[^\n]*\n\D*?分支覆盖率[^\n]*?(\d+)\s*/\s*(\d+)"
    got = lambda i: F.regexp_extract_all("value", F.lit(block), F.lit(i))
    names = ["file", "function", "lines_hit", "lines_total", "branches_hit", "branches_total"]
    rows = text.select("path", F.explode(F.arrays_zip(*[got(i + 1).alias(n) for i, n in enumerate(names)])).alias("b"))
    return rows.select("path", "b.file", "b.function", *[F.col(f"b.{n}").cast("int").alias(n) for n in names[2:]])


def funnel_head(spark: SparkSession, path: str) -> DataFrame:
    """The head of a console report: tests generated, those that parse, those that compile; null where a line is missing."""
    text = with_path(spark.read.text(path, wholetext=True))
    number = lambda label: F.regexp_extract("value", rf"(?m)^{label}:\s*(\d+)", 1).try_cast("bigint")
    return text.select("path", number("Total tests generated").alias("generated"), number("Syntax check passed").alias("syntax_ok"), number("Compile/runtime check passed").alias("compiled"))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in the text of a tag, quoted in any way or bare, its entities read; null without one."""
    found = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    value = F.regexp_replace(found, "(?s)^[\"'](.*)[\"']$", "$1")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.when(found != "", value)


def html_columns(spark: SparkSession, path: str) -> DataFrame:
    """The columns that the header of each summary table declares: (path, i, key, sortable, type, descending_first)."""
    text = with_path(spark.read.text(path, wholetext=True))
    heads = text.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<th(?=[\s>])[^>]*>"), F.lit(0))).alias("i", "tag"))
    kind = F.coalesce(F.nullif(attribute(F.col("tag"), "data-type"), F.lit("")), F.lit("string"))
    fixed = F.coalesce(attribute(F.col("tag"), "data-nosort"), F.lit("")) != ""
    return heads.select("path", "i", attribute(F.col("tag"), "data-col").alias("key"), (~fixed).alias("sortable"), kind.alias("type"), (~fixed & (kind == "number")).alias("descending_first"))


def html_table(spark: SparkSession, path: str) -> DataFrame:
    """Cells of summary tables: (path, row, i, col, value, number). A cell belongs to the column at its place in the row, also
    if it has no value; those of columns of numbers are read as numbers, and one without a value counts as 0."""
    text = with_path(spark.read.text(path, wholetext=True))
    rows = text.select("path", F.posexplode(F.filter(F.regexp_extract_all("value", F.lit(r"(?is)<tr(?=[\s>])[^>]*>(.*?)(?:</tr>|\z)"), F.lit(1)), lambda x: x.rlike(r"(?i)<td[\s>]"))).alias("row", "html"))
    cells = rows.select("path", "row", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<td(?=[\s>])[^>]*>"), F.lit(0))).alias("i", "tag"))
    known = html_columns(spark, path).select("path", "i", F.col("key").alias("col"), "type")
    cells = cells.join(known, ["path", "i"], "left").withColumn("value", attribute(F.col("tag"), "data-value"))
    return cells.select("path", "row", "i", "col", "value", F.when(F.col("type") == "number", number_cell(F.col("value"))).alias("number"))


def table_of(cells: DataFrame, columns: list[ColumnInfo]) -> DataFrame:
    """Cells of one shape of table as rows: path, row, and a typed column for each of ``columns``."""
    pick = lambda c: F.max(F.when(F.col("col") == c.key, F.col("number" if c.type == "number" else "value"))).alias(c.key)
    return cells.groupBy("path", "row").agg(*[pick(c) for c in columns])


def timestamp_of(millis: Column) -> Column:
    return F.timestamp_millis(millis.cast("bigint"))


def write_file_coverage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_runs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_lcov(records: DataFrame, path: str) -> None:
    """(file, lines) as trace records."""
    lines = F.transform("lines", lambda x: F.concat(F.lit("DA:"), x["line"].cast("string"), F.lit(","), x["hits"].cast("string")))
    found, hit = F.size("lines"), F.size(F.filter("lines", lambda x: x["hits"] > 0))
    body = F.concat_ws("\n", F.concat(F.lit("SF:"), F.col("file")), F.concat_ws("\n", lines), F.concat(F.lit("LF:"), found.cast("string")), F.concat(F.lit("LH:"), hit.cast("string")), F.lit("end_of_record"))
    records.select(body.alias("value")).write.mode("overwrite").text(path)
