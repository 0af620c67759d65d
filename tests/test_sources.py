"""Readers on small files of their own."""

import math

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import numeric as N
from tallyforge.functions.text import class_of_path, path_of_class, property_of, source_file
from tallyforge.operators import results as O
from tallyforge.operators.results import outcome
from tallyforge.operators.tables import SortState, columns_of, filter_rows
from tallyforge.sources import artifacts as A

SUITE = """<?xml version="1.0"?>
<testsuite name="a.B" time="0.5" tests="3" errors="1" skipped="0" failures="1" version="3.0">
  <properties><property name="os.name" value="Linux"/></properties>
  <testcase name="one" classname="a.B" time="0.1"/>
  <testcase name="two" classname="a.B" time="0.1"><failure type="E" message="m"><![CDATA[trace]]></failure></testcase>
  <testcase name="three" classname="a.B" time="0.1"><error type="N">trace</error></testcase>
</testsuite>
"""
LCOV = "TN:\nSF:a.js\nFN:3,f\nFNF:1\nFNH:1\nFNDA:2,f\nDA:1,5\nDA:2,0\nLF:2\nLH:1\nBRDA:1,0,0,1\nBRDA:1,0,1,0\nBRF:2\nBRH:1\nend_of_record\n"


def test_suites_and_outcomes(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SUITE)
    rows = A.cases(spark, str(tmp_path / "s.xml")).select("_name", outcome(F.col("failure"), F.col("error")).alias("o")).collect()
    assert {r["_name"]: r["o"] for r in rows} == {"one": "passed", "two": "failed", "three": "errored"}
    suite = A.suites(spark, str(tmp_path / "s.xml")).first()
    assert (suite["_tests"], suite["_failures"], suite["_errors"], len(suite["testcase"])) == (3, 1, 1, 3)


def test_lcov_totals(spark, tmp_path):
    (tmp_path / "lcov.info").write_text(LCOV)
    r = A.lcov(spark, str(tmp_path / "lcov.info")).first()
    assert (r["file"], r["lf"], r["lh"], r["brf"], r["brh"]) == ("a.js", 2, 1, 2, 1)
    assert [tuple(x) for x in r["lines"]] == [(1, 5), (2, 0)] and r["functions"][0]["hits"] == 2 and len(r["branches"]) == 2


def test_csv_text_json_and_dimensions(spark, tmp_path):
    run = tmp_path / "test_results" / "p" / "specification_junit5_gpt4o"
    run.mkdir(parents=True)
    (run / "file_coverage.csv").write_text("File,Line_Missed,Line_Covered,Total_Lines,Line_Coverage%,Branch_Missed,Branch_Covered,Total_Branches,Branch_Coverage%\na.java,1,3,4,75.00,0,0,0,0.00\nTotal,,3,4,75.0,,0,0,0.0\n")
    (run / "summary.json").write_text('{"total": 2, "compile_pass": 1, "test_summary": {"total": 2, "passed": 1, "failures": 1, "errors": 0, "pass_rate": 0.5}}')
    (run / "compiled_tests_list.txt").write_text("./target/test-classes/a/B.class\n\n")
    files, total = A.file_coverage(spark, str(run / "file_coverage.csv"))
    assert files.count() == 1 and total.first()["Total_Lines"] == 4
    r = A.dimensions(A.maven_runs(spark, str(run / "summary.json"))).first()
    assert (r["project"], r["framework"], r["model"], r["specification"], r["coverage_summary"]) == ("p", "junit5", "gpt4o", True, None)
    assert A.lines_of(spark, str(run / "compiled_tests_list.txt")).select(class_of_path(F.col("value")).alias("c")).collect()[0]["c"] == "a.B"


def test_functions(spark):
    one = spark.range(1)
    total = one.select(N.compensated_sum(F.array(*map(F.lit, [1.0, 1e100, 1.0, -1e100]))).alias("s"), N.compensated_sum(F.array().cast("array<double>")).alias("e")).first()
    assert (total["s"], total["e"]) == (2.0, 0.0)
    sizes = one.select(*[F.size(N.poisson_cells(F.lit(float(x)))).alias(f"c{x}") for x in (1, 2, 10, 100)]).first()
    assert tuple(sizes) == (7, 10, 25, 140)
    assert one.select(N.poisson_cells(F.lit(0.0)).alias("p")).first()["p"] is None
    large = one.select(N.poisson_cells(F.lit(800.0)).alias("p")).first()["p"]
    assert 0.9999 <= sum(large) < 1 and sum(large[:-1]) < 0.9999 and math.isclose(large[800], 0.0141032, rel_tol=1e-4)
    with pytest.raises(Exception, match="at least one data point"):
        one.select(N.compensated_mean(F.array().cast("array<double>"))).collect()
    orders = N.permutations(spark.createDataFrame([(1, [1, 2, 3]), (2, [])], "id int, items array<int>"), "items").orderBy("id", "position").collect()
    assert ["".join(map(str, r.arrangement)) for r in orders] == ["123", "213", "312", "132", "231", "321", ""]
    assert math.isclose(N.EPSILON, 1e-4)
    names = one.select(source_file(F.lit("a.b"), F.lit("C.D")).alias("f"), path_of_class(F.lit("a.C")).alias("p")).first()
    assert tuple(names) == ("a/b/C.java", "./target/test-classes/a/C.class")


def test_filter_and_sort_state(spark):
    df = spark.createDataFrame([(0, "Ab", 2.0), (1, "cd(", 1.0), (2, "ef", 2.0)], "pos int, name string, n double")
    assert filter_rows(df, "aB|EF", ["name"]).count() == 2 and filter_rows(df, "D(", ["name"]).count() == 1
    state = SortState(columns_of(df))
    state.click(2)
    assert [r.pos for r in state.apply(df, "pos").collect()] == [0, 2, 1]
    state.click(2)
    assert [r.pos for r in state.apply(df, "pos").collect()] == [1, 0, 2]


def test_counts_of_suites_and_runs(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SUITE)
    cases = A.cases(spark, str(tmp_path / "s.xml")).select(F.col("_classname").alias("suite"), outcome(F.col("failure"), F.col("error")).alias("status"), F.col("_time").alias("time"))
    counted = O.suite_counts(cases, ["suite"])
    r = counted.first()
    assert (r["tests"], r["failures"], r["errors"], r["skipped"]) == (3, 1, 1, 0) and math.isclose(r["case_time"], 0.3)
    run = O.with_rates(O.run_counts(counted.withColumn("run", F.lit("x")), ["run"])).first()
    assert (run["passed"], run["total"]) == (1, 3) and math.isclose(run["pass_rate"], 1 / 3)
    times = counted.join(A.suites(spark, str(tmp_path / "s.xml")).select(F.col("_name").alias("suite"), F.col("_time").alias("own")), "suite")
    assert O.time_is_consistent(times.withColumn("time", F.col("own"))).isEmpty() and O.time_is_consistent(times.withColumn("time", F.lit(0.1))).count() == 1
    suite = A.suites(spark, str(tmp_path / "s.xml")).select(property_of(F.col("properties.property"), "os.name").alias("os"), property_of(F.col("properties.property"), "none").alias("none")).first()
    assert tuple(suite) == ("Linux", None)


def test_trace_totals_count_what_the_record_says(spark, tmp_path):
    (tmp_path / "lcov.info").write_text(LCOV.replace("FNDA:2,f", "FNDA:1,f\nFNDA:2,f"))
    records = A.lcov(spark, str(tmp_path / "lcov.info"))
    r, recorded = O.trace_totals(records).first(), records.first()
    assert (r["lines_found"], r["lines_hit"], r["branches_found"], r["branches_hit"]) == tuple(recorded[k] for k in ("lf", "lh", "brf", "brh"))
    assert recorded["functions"][0]["hits"] == 2
    A.write_lcov(records, str(tmp_path / "out"))
    again = A.lcov(spark, str(tmp_path / "out")).first()
    assert (again["file"], again["lf"], again["lh"], again["lines"]) == ("a.js", 2, 1, recorded["lines"])


CLOVER = """<?xml version="1.0"?><coverage><project>
<file name="a.js" path="/s/a.js"><metrics statements="3" coveredstatements="2" conditionals="2" coveredconditionals="1" methods="1" coveredmethods="1"/>
<line num="1" count="4" type="cond" truecount="1" falsecount="1"/><line num="2" count="0" type="stmt"/><line num="5" count="1" type="stmt"/></file>
<file name="b.js" path="/s/b.js"><metrics statements="1" coveredstatements="1" conditionals="0" coveredconditionals="0" methods="0" coveredmethods="0"/><line num="7" count="2" type="stmt"/></file>
</project></coverage>"""


def test_clover_metrics(spark, tmp_path):
    (tmp_path / "clover.xml").write_text(CLOVER)
    files = A.clover(spark, str(tmp_path / "clover.xml"))
    recorded = {r["file"]: r for r in A.clover_metrics(files).collect()}
    for r in O.statement_metrics(A.clover_lines(files), ["file"]).collect():
        assert all(r[k] == recorded[r["file"]][k] for k in ("statements", "coveredstatements", "conditionals", "coveredconditionals"))
    whole = O.project_metrics(A.clover_metrics(files)).first()
    assert (whole["elements"], whole["coveredelements"], whole["methods"]) == (4 + 2 + 1, 3 + 1 + 1, 1)


def test_other_readers(spark, tmp_path):
    (tmp_path / "jest.json").write_text('{"compile_pass": 0, "compile_total": 3, "testcase": {"total": 31, "passed": 15, "failed": 16, "test_pass_rate": 0.48}, "coverage": {}}')
    jest = A.jest_runs(spark, str(tmp_path / "jest.json"))
    r = A.all_runs(A.maven_runs(spark, str(tmp_path / "jest.json")).where("false"), jest).first()
    assert (r["source"], r["total"], r["failures"], r["errors"], r["compile_total"]) == ("jest", 31, 16, None, 3)
    measures = [f"{m}_{s}" for m in O.MEASURES for s in ("MISSED", "COVERED")]
    (tmp_path / "classes.csv").write_text("GROUP,PACKAGE,CLASS," + ",".join(measures) + "\ng,a.b,C," + ",".join("1" * len(measures)) + "\ng,a.b,C.D," + ",".join("2" * len(measures)) + "\n")
    rolled = O.classes_to_files(A.class_coverage(spark, str(tmp_path / "classes.csv"))).collect()
    assert [(r["File"], r["LINE_MISSED"]) for r in rolled] == [("a/b/C.java", 3)]
    (tmp_path / "table.txt").write_text("File | % Stmts | % Branch | % Funcs | % Lines | Uncovered\n-----|---|---|---|---|---\n a.js | 96.38 | 87.5 | 100 | 96.05 | 22,34 \n")
    r = A.console_table(spark, str(tmp_path / "table.txt")).first()
    assert (r["file"], r["pct_stmts"], r["uncovered"]) == ("a.js", 96.38, "22,34")
    (tmp_path / "blocks.txt").write_text("文件: a.js\n函数: sum\n  行覆盖率: 25/25 (100.00%)\n  分支覆盖率: 5/8 (62.50%)\n", encoding="utf-8")
    r = A.function_blocks(spark, str(tmp_path / "blocks.txt")).first()
    assert (r["file"], r["function"], r["lines_hit"], r["lines_total"], r["branches_hit"], r["branches_total"]) == ("a.js", "sum", 25, 25, 5, 8)
    (tmp_path / "page.html").write_text('<table>\n<tr><th data-col="file">F</th><th data-col="pct" data-type="number">P</th></tr><tr> <td data-value="a.js">a</td><td data-value="80">80%</td></tr>\n<tr>\n<td data-value="b.js">b</td><td data-value="x">?</td></tr></table>')
    cells = A.html_table(spark, str(tmp_path / "page.html")).orderBy("row", "col").collect()
    assert [(c["col"], c["value"]) for c in cells] == [("file", "a.js"), ("pct", "80"), ("file", "b.js"), ("pct", "x")]
    assert cells[1]["number"] == 80 and math.isnan(cells[3]["number"]) and cells[0]["number"] is None


def test_compiled_counts_and_shared_lines(spark):
    listed = spark.createDataFrame([("r1", "a"), ("r1", "b")], "run string, value string")
    counted = spark.createDataFrame([("r1", "2"), ("r2", "1")], "run string, value string")
    assert {tuple(r) for r in O.compiled_counts(listed, counted, ["run"]).collect()} == {("r1", 2, 2, True), ("r2", 0, 1, False)}
    lines = spark.createDataFrame([("f", 1, 0), ("f", 1, 3), ("f", 2, 0)], "file string, line int, hits int")
    assert tuple(O.shared_lines_once(lines, ["file"]).first()) == ("f", 2, 1)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a.java", 1, 3, 4, 75.0, 0, 0, 0, 0.0)], A.FILE_COVERAGE)
    A.write_file_coverage(rows, str(tmp_path / "csv"))
    files, _ = A.file_coverage(spark, str(tmp_path / "csv"))
    assert files.drop("path").collect() == rows.collect()
    A.write_lines(rows, "Total_Lines", str(tmp_path / "txt"))
    assert [r["value"] for r in A.lines_of(spark, str(tmp_path / "txt")).collect()] == ["4"]
    runs = spark.createDataFrame([(5, 2)], "total long, compile_pass long")
    A.write_runs(runs, str(tmp_path / "json"))
    assert A.maven_runs(spark, str(tmp_path / "json")).first()["total"] == 5
