"""Quality rules: a table of thresholds, compiled into one projection without user functions.

A rule bounds a share of two counts in percent, ``least <= 100 * part / whole <= most``, and holds for texts of at least
``words`` words; comparisons are between integers, so that a share at a bound is within it. All counts come from the
text by built-in functions: length (words, their code points), symbols, stop words, lines, words that stand in a window
of five words found twice or more in the text. A text whose window hashes all differ repeats none; in the others the
windows themselves are compared, sorted, so the cost is n log n in the words of one text and nothing is shuffled.

A text fails the base rules with under 10 words or with more than 20 % repeated words; it is kept if it fails neither
those nor any rule of the table. Defined cases: a null text counts as empty (no words: base_failed, not kept); repeated
rows each get their own result; null and repeated ids are passed through; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
COUNTS = "n_words word_chars n_symbols n_stop_words n_letter_words n_lines n_dup_lines n_bullet_lines n_open_lines n_repeat_words".split()
#: Function words of the four languages; at least a few of them stand in any prose of some length.
STOP_WORDS = "the of and to in a is it that for was on are as with at by de la le et les des un une est dans que qui en el los las y se del por con der die das und ist von den mit nicht ein eine zu im".split()


@dataclass(frozen=True)
class Rule:
    name: str
    part: str
    whole: str
    least: int = 0
    most: int | None = None
    words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", least=250, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=30),
    Rule("stop_words", "n_stop_words", "n_words", least=2, words=50),
    Rule("letters", "n_letter_words", "n_words", least=70),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90, words=50),
    Rule("open_lines", "n_open_lines", "n_lines", most=30, words=50),
)


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the whole."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def holds(rule: Rule, m: Column) -> Column:
    part, whole = m[rule.part] * 100, m[rule.whole]
    within = part >= whole * rule.least
    if rule.most is not None:
        within &= part <= whole * rule.most
    return within if not rule.words else (m["n_words"] < rule.words) | within


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words of a text stand in windows found twice or more; ``hashes`` has one for each window."""
    high, low = F.lit(-(1 << 32)), F.lit((1 << 32) - 1)
    places = F.sort_array(F.transform(hashes, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("bigint"))))

    def twins(items: Column, same: Callable[[Column], Column]) -> Column:
        near = lambda x, i: same(F.get(items, i)).eqNullSafe(same(x))
        return F.filter(items, lambda x, j: near(x, j - 1) | near(x, j + 1))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.get(at, k + 1) - p, F.lit(WINDOW).cast("bigint"))), F.lit(0).cast("bigint"), lambda n, x: n + x)

    def exact(maybe: Column) -> Column:
        windows = F.array_sort(F.transform(maybe, lambda x: F.struct(F.concat_ws(" ", F.slice(words, x.bitwiseAND(low).cast("int") + 1, WINDOW)).alias("window"), x.bitwiseAND(low).alias("at"))))
        return named(windows, lambda w: named(F.array_sort(F.transform(twins(w, lambda x: x["window"]), lambda x: x["at"])), covered))

    sure = F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint"))
    return sure.otherwise(named(places, lambda s: named(twins(s, lambda x: x.bitwiseAND(high)), exact)))


def repeated(words: Column) -> Column:
    def windows(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
        return F.transform(F.slice(hashes, F.lit(1), last), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))

    return named(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: named(windows(hashes), lambda w: repeated_words(words, w)))


def measures(text: Column) -> Column:
    """All counts of a text that rules speak of, as one struct."""
    long = lambda c: c.cast("bigint")

    def counted(words: Column, lines: Column) -> Column:
        like = lambda pattern: long(F.size(F.filter(lines, lambda x: x.rlike(pattern))))
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(F.array_join(words, ""))).alias("word_chars"),
            long(F.regexp_count(text, F.lit(SYMBOL))).alias("n_symbols"),
            long(F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
            long(F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))).alias("n_letter_words"),
            long(F.size(lines)).alias("n_lines"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            like(r"^[\x20\x09]*[-*•]").alias("n_bullet_lines"),
            like(r"(\.\.\.|…)[\x20\x09\x0D]*$").alias("n_open_lines"),
            repeated(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return named(F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines")), lambda t: counted(t["words"], t["lines"]))


def verdict(text: Column, rules: tuple[Rule, ...] = RULES, least_words: int = 10, most_repeated: int = 20) -> Column:
    """The counts, base_failed, the names of the rules of the table that failed, and kept, as one struct."""

    def judged(m: Column) -> Column:
        base = (m["n_words"] < least_words) | (m["n_repeat_words"] * 100 > m["n_words"] * most_repeated)
        failed = F.array_join(F.array_compact(F.array(*[F.when(~holds(r, m), F.lit(r.name)) for r in rules])), ",") if rules else F.lit("")
        return named(F.struct(base.alias("base"), failed.alias("failed")), lambda v: F.struct(*[m[c].alias(c) for c in COUNTS], v["base"].alias("base_failed"), v["failed"].alias("failed"), (~v["base"] & (v["failed"] == "")).alias("kept")))

    return named(measures(F.coalesce(text, F.lit(""))), judged)


def apply_rules(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, failed, kept."""
    return docs.select("doc_id", verdict(F.col("text"), **options).alias("verdict")).select("doc_id", "verdict.*")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return docs.where(verdict(F.col("text"), **options)["kept"])


def sql_rule(rule: Rule) -> str:
    ok = f"100 * {rule.part} >= {rule.least} * {rule.whole}" + (f" AND 100 * {rule.part} <= {rule.most} * {rule.whole}" if rule.most is not None else "")
    return f"(n_words < {rule.words} OR ({ok}))"


ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT row_number() OVER () AS k, doc_id, text, regexp_extract_all(text, '[^ \x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines FROM d),
w AS (SELECT k, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM t)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM w) WHERE c > 1),
q AS (SELECT k, count(DISTINCT i + j) AS n FROM r, range(5) AS o(j) GROUP BY k),
m AS (SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
len(list_filter(words, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(x)))) AS n_stop_words, len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \x09]*[-*\x{{2022}}]'))) AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \x09\x0D]*$'))) AS n_open_lines, coalesce(n, 0) AS n_repeat_words FROM t LEFT JOIN q USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, array_to_string(list_filter([{", ".join(f"CASE WHEN NOT {sql_rule(r)} THEN '{r.name}' END" for r in RULES)}], lambda x: x IS NOT NULL), ',') AS failed FROM m)
SELECT *, NOT base_failed AND failed = '' AS kept FROM b"""
