"""Tokens, headers of summary tables, and figures of several sources."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import lexing as X
from tallyforge.operators import reconcile as C
from tallyforge.operators.tables import ColumnInfo, SortState, declared_columns
from tallyforge.sources import artifacts as A

SCRIPT = """/* a comment
 over "lines" */ const s = 'it\\'s "one"'; // end 'here
let t = `x ${ f({a: `in ${"n"} ner`}) } y
z`, n = 0x1F + .5e-3, r = a / b / 2, q = /[/"]\\//g.test(s) && true;
class Foo extends Bar { get() { return /x/ } }
const open = "no end
next = 'goes on \\
here'; `left ${ open"""


def cut(text, language="script"):
    out = list(X.LANGUAGES[language](text))
    assert [a for _, a, _ in out] == [0, *[b for *_, b in out]][: len(out)] and (not text or out[-1][2] == len(text)) and all(a < b for _, a, b in out)
    return [(k, text[a:b]) for k, a, b in out]


def test_script_tokens():
    got = cut(SCRIPT)
    of = lambda kind: [t for k, t in got if k == kind]
    assert of("com") == ['/* a comment\n over "lines" */', "// end 'here"]
    assert of("str") == ["'it\\'s \"one\"'", "`x ", "`in ", '"n"', " ner`", " y\nz`", '/[/"]\\//g', "/x/", '"no end', "'goes on \\\nhere'", "`left "]
    assert of("lit") == ["0x1F", ".5e-3", "2", "true"] and of("typ") == ["Foo", "Bar"]
    assert of("kwd") == ["const", "let", "class", "extends", "get", "return", "const"]


@pytest.mark.parametrize("text", ["/* open\n", "`a${`b${`c", "'", '"\\', "`\\", "`$", "`${", "}", "`${}}`", "/", "a\n/b/", "${", "é = «ß»", "", " //x y", "{`${ {} }`}"])
def test_open_and_odd_scripts_are_tiled(text):
    cut(text)


def test_random_texts_are_tiled():
    r = random.Random(1)
    for _ in range(600):
        text = "".join(r.choice(["`", "${", "}", "{", "'", '"', "\\", "/", "*", "\n", "a", "1", ".", " ", "<", ">", "=", "!--", "-->", "<script>", "</script>", "p"]) for _ in range(r.randrange(14)))
        cut(text)
        cut(text, "markup")


def test_markup_tokens():
    text = '<!DOCTYPE html><p class="a>b" id=x hidden>Hi<br/>there <!-- <p> --><SCRIPT>var t="</p>";</SCRIPT><style>/* c */</style></p> 1 < 2 <!-- open'
    got = cut(text, "markup")
    of = lambda kind: [t for k, t in got if k == kind]
    assert of("dec") == ["<!DOCTYPE html>"] and of("com") == ["<!-- <p> -->", "/* c */", "<!-- open"] and of("atn") == ["class", "id", "hidden"] and of("atv") == ['"a>b"', "x"]
    assert of("tag") == ["<p", ">", "<br", "/>", "<SCRIPT", ">", "</SCRIPT", ">", "<style", ">", "</style", ">", "</p", ">"] and of("kwd") == ["var"] and of("str") == ['"</p>"']
    assert cut("<script>never closed", "markup")[2:] == [("pln", "never"), ("pln", " "), ("pln", "closed")]


def test_token_rows_and_lines(spark):
    texts = [SCRIPT, None, "", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, source string").repartition(2)
    rows = X.token_rows(df, "source")
    got = {(r.id, r.n): (r.kind, SCRIPT[r.start : r.stop] if r.id == 0 else "a") for r in rows.collect()}
    assert [got[0, n] for n in range(len(got) - 1)] == cut(SCRIPT) and got[3, 0] == ("pln", "a") and len({i for i, _ in got}) == 2
    lines = {}
    for r in X.by_line(rows, "source", ["id"]).where("id = 0").collect():
        lines.setdefault(r.line, []).append((r.begin, r.text, r.kind))
    assert ["".join(t for _, t, _ in sorted(lines.get(i + 1, []))) for i in range(SCRIPT.count("\n") + 1)] == SCRIPT.split("\n")
    assert lines[2][0][2] == "com" or ("com" in {k for *_, k in lines[2]})


PAGE = """<table class="coverage-summary"><thead><tr>
<th data-col="file" data-fmt="html" class="file">File</th><th data-col='pic' data-type="number" data-nosort="true"></th><th data-type=number data-col="pct">%</th><th data-col="raw" data-type="">n</th></tr></thead>
<tbody><tr class="x">
<td class="file" data-value="a&amp;b.js"><a>a</a></td><td><div></div></td><td data-value="80" class="pct high">80%</td><td data-value="1/2">1/2</td></tr>
<tr><td data-value="c.js"></td><td data-value="0x10"></td><td>none</td><td data-value=" ">?</td></tr><tr><td data-value="d.js"><td data-value="5"><td data-value="x"></tr></tbody></table>"""


def test_header_columns_and_cells(spark, tmp_path):
    (tmp_path / "page.html").write_text(PAGE)
    columns = declared_columns(A.html_columns(spark, str(tmp_path / "page.html")))
    assert columns == [ColumnInfo("file", True, "string", False), ColumnInfo("pic", False, "number", False), ColumnInfo("pct", True, "number", True), ColumnInfo("raw", True, "string", False)]
    cells = A.html_table(spark, str(tmp_path / "page.html"))
    got = {(r.row, r.col): (r.value, r.number) for r in cells.collect()}
    assert len(got) == 11 and got[0, "file"] == ("a&b.js", None) and got[0, "pic"] == (None, 0.0) and got[0, "pct"] == ("80", 80.0) and got[0, "raw"] == ("1/2", None)
    assert got[1, "pic"] == ("0x10", 16.0) and got[1, "pct"] == (None, 0.0) and got[1, "raw"] == (" ", None) and math.isnan(got[2, "pct"][1])
    state = SortState(columns)
    state.click(1)
    assert state.index == 0  # a fixed column
    state.click(2)
    assert [r.file for r in state.apply(A.table_of(cells, columns), "row").collect()] == ["a&b.js", "c.js", "d.js"]  # NaN comes last


def test_reconcile_states(spark):
    a = spark.createDataFrame([("k1", 1.0, 5), ("k2", 2.0, None), ("k3", 3.0, 1), ("k3", 4.0, 1), (None, 9.0, 9)], "key string, x double, y int")
    b = spark.createDataFrame([("k1", 1.004), ("k2", 2.5), ("k4", 7.0), (None, 9.0)], "key string, x double")
    got = {(r.key, r.metric): (r.a, r.b, r.status, r.gap) for r in C.reconcile({"a": a, "b": b}, ["key"], ["x", "y"], 0.005).withColumn("gap", F.round("gap", 3)).collect()}
    assert got == {
        ("k1", "x"): (1.0, 1.004, "equal", 0.004), ("k2", "x"): (2.0, 2.5, "differs", 0.5), ("k3", "x"): (4.0, None, "several in a", None), ("k4", "x"): (None, 7.0, "missing in a", None), (None, "x"): (9.0, 9.0, "equal", 0.0),
        ("k1", "y"): (5.0, None, "missing in b", None), ("k2", "y"): (None, None, "missing in b", None), ("k3", "y"): (1.0, None, "missing in b", None), (None, "y"): (9.0, None, "missing in b", None),
    }
    c = spark.createDataFrame([("k1", None)], "key string, x double")
    assert C.reconcile({"a": a.where("key = 'k1'"), "c": c}, ["key"], ["x"]).first().status == "blank in c"
    assert C.reconcile({"a": a.where("false"), "b": b.where("false")}, ["key"], ["x"]).count() == 0


def test_figures_of_runs(spark, tmp_path):
    for run, summary, count, listed in (("junit4_gpt4o", '{"compile_pass": 2, "coverage_summary": {"line_coverage": 0.0, "branch_coverage": 0.5}}', "2", "a\nb\n"), ("junit5_gpt4o", '{"compile_pass": 1}', "1", "\n")):
        at = tmp_path / "test_results" / "p" / run
        at.mkdir(parents=True)
        (at / "summary.json").write_text(summary)
        (at / "count.txt").write_text(count)
        (at / "list.txt").write_text(listed)
        (at / "files.csv").write_text("File,Line_Missed,Line_Covered,Total_Lines,Line_Coverage%,Branch_Missed,Branch_Covered,Total_Branches,Branch_Coverage%\na/C.java,1,3,4,75.00,1,1,2,50.00\nTotal,,3,4,75.0,,1,2,50.0\n")
    on = lambda name: str(tmp_path / "test_results" / "*" / "*" / name)
    keys = ["project", "run"]
    runs = A.dimensions(A.maven_runs(spark, on("summary.json")))
    files, totals = A.file_coverage(spark, on("files.csv"))
    got = {(r.run, r.metric): r.status for r in C.coverage_figures(runs, A.dimensions(totals), keys).collect()}
    assert got == {("junit4_gpt4o", "line_percent"): "differs", ("junit4_gpt4o", "branch_percent"): "equal", ("junit5_gpt4o", "line_percent"): "missing in summary", ("junit5_gpt4o", "branch_percent"): "missing in summary"}
    compiled = C.compiled_figures(runs, A.dimensions(A.lines_of(spark, on("count.txt"))), A.dimensions(A.lines_of(spark, on("list.txt"))), keys)
    assert {r.run: (r.status, r.list) for r in compiled.collect()} == {"junit4_gpt4o": ("equal", 2.0), "junit5_gpt4o": ("differs", 0.0)}
    classes = spark.createDataFrame([("a", "C", 1, 3), ("a", "C.D", 0, 1)], "PACKAGE string, CLASS string, m int, c int")
    for m in ("INSTRUCTION", "BRANCH", "LINE", "COMPLEXITY", "METHOD"):
        classes = classes.withColumns({f"{m}_MISSED": F.col("m"), f"{m}_COVERED": F.col("c")})
    one = files.where(F.col("path").contains("junit4"))
    got = {r.metric: (r.classes, r.file, r.gap) for r in C.file_figures(classes, one).collect()}
    assert got["LINE_TOTAL"] == (5.0, 4.0, 1.0) and got["LINE_COVERED"] == (4.0, 3.0, 1.0)


def test_head_of_a_console_report(spark, tmp_path):
    at = tmp_path / "test_results" / "p" / "jest_gpt4o"
    at.mkdir(parents=True)
    (at / "r.txt").write_text("Total tests generated: 4\nSyntax check passed: 4 (100.00%)\nCompile/runtime check passed: 3 (75.00%)\nFile | x\n")
    (at / "s.json").write_text('{"compile_pass": 0, "compile_total": 3}')
    head = A.dimensions(A.funnel_head(spark, str(at / "r.txt")))
    assert (lambda r: (r.generated, r.syntax_ok, r.compiled))(head.first()) == (4, 4, 3)
    got = {r.metric: (r.summary, r.report, r.status) for r in C.funnel_figures(A.dimensions(A.jest_runs(spark, str(at / "s.json"))), head, ["project", "run"]).collect()}
    assert got == {"tried": (3.0, 4.0, "differs"), "compiled": (0.0, 3.0, "differs")}


def test_shared_line_gap(spark):
    lines = spark.createDataFrame([("f", "A", 1, 1), ("f", "A", 2, 0), ("f", "B", 2, 5), ("f", "B", 3, 0)], "file string, cls string, line int, hits int")
    assert tuple(C.shared_line_gap(lines, ["file"], "cls").first()) == ("f", 4, 2, 3, 2, 1, 0)


def test_functions_against_files_and_repeated_names(spark):
    blocks = spark.createDataFrame([("sum.js", "sum", 25, 25, 5, 8), ("a.js", "f", 1, 2, 0, 0), ("a.js", "g", 1, 2, 0, 0)], "file string, function string, lines_hit int, lines_total int, branches_hit int, branches_total int")
    table = spark.createDataFrame([("sum.js", 80.0, 62.5), ("a.js", 50.0, 0.0), ("b.js", 1.0, 1.0)], "file string, pct_lines double, pct_branch double")
    got = {(r.file, r.metric): r.status for r in C.function_figures(blocks, table).collect()}
    assert got == {("sum.js", "lines"): "differs", ("sum.js", "branches"): "equal", ("a.js", "lines"): "equal", ("a.js", "branches"): "equal", ("b.js", "lines"): "missing in functions", ("b.js", "branches"): "missing in functions"}
    names = spark.createDataFrame([("p.A",), ("q.A",), ("q.A",), ("p.B",)], "cls string")
    assert [tuple(r) for r in C.repeated_names(names, "cls").collect()] == [("A", 2)]
