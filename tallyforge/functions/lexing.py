"""Source text cut into tokens for highlighting: comments, strings, keywords, types, literals, punctuation, tags, attributes.

Tokens tile the text: each begins where the one before ends. What a comment, string or template has begun is carried over
line ends, so a text is one row; ``by_line`` cuts tokens at line ends afterwards. Kinds: ``com`` comment, ``str`` string or
regular expression, ``kwd`` keyword, ``typ`` capitalised name, ``lit`` number or constant, ``pun`` punctuation, ``tag`` tag,
``atn`` and ``atv`` attribute name and value, ``dec`` declaration, ``pln`` everything else. What is left open at the end of
the text ends there; a quoted string also ends, open, before a line end that no backslash precedes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Token = tuple[str, int, int]
TOKENS = "array<struct<kind:string,start:int,stop:int>>"
KEYWORDS = frozenset("async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new of return set static super switch this throw try typeof var void while with yield abstract boolean byte char double enum final float goto implements int interface long native package private protected public short synchronized throws transient volatile".split())
CONSTANTS = frozenset("true false null undefined NaN Infinity".split())
#: After one of these, or at the start, a slash begins a regular expression.
BEFORE_VALUE = frozenset("return typeof case do else in instanceof new of throw void delete yield await".split())

SCRIPT = re.compile(
    r"""(?P<pln>\s+)|(?P<com>//[^\n\r\u2028\u2029]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:[^"\\\n\r]|\\.)*(?:"|\\?\Z)?|'(?:[^'\\\n\r]|\\.)*(?:'|\\?\Z)?)"""
    r"""|(?P<lit>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<pun>.)""",
    re.S,
)
TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?P<end>`|\$\{|\\?\Z)", re.S)
EXPRESSION = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/\w*")
MARKUP = re.compile(r"(?P<com><!--.*?(?:-->|\Z))|(?P<dec><[!?][^>]*>?)|(?P<tag></?[A-Za-z][^\s/>]*)|(?P<pln>[^<]+|<)", re.S)
INSIDE = re.compile(r"""(?P<pln>\s+)|(?P<tag>/?>)|(?P<pun>=)|(?P<atv>"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|(?P<atn>[^\s=/>"']+|/)""", re.S)
UNQUOTED = re.compile(r"""[^\s>"']+""")
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}


def script_tokens(text: str, at: int = 0, end: int | None = None) -> Iterator[Token]:
    """Tokens of a script, from ``at`` to ``end``."""
    end = len(text) if end is None else end
    depths: list[int] = []  # open braces in the expression of each open template, the innermost last
    value_before = False
    while at < end:
        resumed = bool(depths) and depths[-1] == 0 and text[at] == "}"
        if resumed or text[at] == "`":
            if resumed:
                depths.pop()
                yield "pun", at, at + 1
                at += 1
            m = TEMPLATE.match(text, at if resumed else at + 1, end)
            value_before = m["end"] != "${"
            stop = m.end() if value_before else m.end() - 2
            if at < stop:
                yield "str", at, stop
            if not value_before:
                yield "pun", stop, m.end()
                depths.append(0)
            at = m.end()
            continue
        m = None if value_before or text[at] != "/" else EXPRESSION.match(text, at, end)
        if m:
            kind = "str"
        else:
            m = SCRIPT.match(text, at, end)
            kind = m.lastgroup
        found = m[0]
        if kind == "word":
            kind = "kwd" if found in KEYWORDS else "lit" if found in CONSTANTS else "typ" if found[0].isupper() and any(map(str.islower, found)) else "pln"
            value_before = found not in BEFORE_VALUE
        elif kind in ("str", "lit"):
            value_before = True
        elif kind == "pun":
            value_before = found in ")]}"
            if depths:
                depths[-1] += (found == "{") - (found == "}")
        yield kind, at, m.end()
        at = m.end()


def markup_tokens(text: str) -> Iterator[Token]:
    """Tokens of markup; what stands in script and style elements goes by the rules of scripts."""
    at, end, tag, value = 0, len(text), "", False
    while at < end:
        m = (INSIDE if tag else MARKUP).match(text, at)
        kind = m.lastgroup
        if tag and value and kind in ("atn", "pun"):
            m, kind = UNQUOTED.match(text, at), "atv"
        yield kind, at, m.end()
        at = m.end()
        if tag and kind == "tag":
            name, tag = tag[1:].lower(), ""
            if name in RAW and m[0] == ">":
                close = RAW[name].search(text, at)
                yield from script_tokens(text, at, close.start() if close else end)
                at = close.start() if close else end
        elif kind == "tag":
            tag = m[0]
        value = bool(tag) and (kind == "pun" or value and kind == "pln")


LANGUAGES = {"script": script_tokens, "markup": markup_tokens}


def tokens(text: Column, language: str = "script") -> Column:
    """The tokens of each text, in order; positions count characters. A null text has none."""
    cut = LANGUAGES[language]

    @F.arrow_udf(returnType=TOKENS)
    def run(texts: pa.Array) -> pa.Array:
        ends, kinds, starts, stops = [0], [], [], []
        for t in texts.to_pylist():
            for kind, start, stop in cut(t or ""):
                kinds.append(kind)
                starts.append(start)
                stops.append(stop)
            ends.append(len(kinds))
        items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["kind", "start", "stop"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    return run(text)


def token_rows(df: DataFrame, column: str, language: str = "script") -> DataFrame:
    """The columns of ``df``, and a row for each token: n from 0, kind, start, stop."""
    return df.select(*df.columns, F.posexplode(tokens(F.col(column), language)).alias("n", "token")).select(*df.columns, "n", "token.*")


def by_line(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Token rows cut at line ends: keys, line from 1, kind, begin, text; ``begin`` counts from the start of the line. Pieces
    without a character are left out, and so are line ends."""
    part = F.substring(F.col(column), F.col("start") + 1, F.col("stop") - F.col("start"))
    before = F.substring(F.col(column), F.lit(1), F.col("start"))
    first = F.size(F.split(before, "\n", -1))
    column_of = F.length(F.substring_index(before, "\n", -1))
    pieces = rows.select(*keys, "kind", first.alias("first_"), column_of.alias("column_"), F.posexplode(F.split(part, "\n", -1)).alias("i_", "text"))
    return pieces.where("text <> ''").select(*keys, (F.col("first_") + F.col("i_")).alias("line"), "kind", F.when(F.col("i_") == 0, F.col("column_")).otherwise(0).alias("begin"), "text")
