"""Spelling variant grouping: words one letter apart, found by sums of letter powers.

The anagram key of a word is the sum of the fifth powers of its code points (modulo 2^61 - 1). Words that are one added,
removed or exchanged letter apart have keys that differ by the power of that letter, or by the difference of two powers,
and no two pairs of letters share a difference. So each word puts forth its own key and its key less each of its letters,
and equal values are joined: a word's own with another's reduced one for an added letter, two reduced ones for an
exchanged letter. What is left of letter order goes into the join as well: an edit leaves the first or the second half
of the word as it is, so the reduced key is joined together with that half, for either half (an edit in the middle, or in
a run across it, counts as one of the second half). So a join value holds words that agree in one half and in the letters of the other, not
all anagrams. Pairs that meet are verified by their edit distance, and each comes up once.

Words are counted before anything is joined, so one very frequent word is one row. The form of a word is its most
frequent near word, of equal ones the first in code-point order, if that is ``ratio`` times as frequent. Since counts grow
by ``ratio`` with each step, the way from a word to its root is short; roots are found by doubling the steps, each round
written to a table.

Defined cases: null and empty texts have no run; a null doc_id counts as the empty text in the hash; repeated rows count
again; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MODULUS = (1 << 61) - 1


def word_counts(docs: DataFrame, drop_every: int = 31, least_letters: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) of the runs of letters in all texts. Of one run in about ``drop_every``, chosen by the crc32 of
    ``<doc_id>:<run>``, one letter is left out."""
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(id_.alias("id"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_letters)
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    low = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = low.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def power(letter: Column) -> Column:
    code = F.ascii(letter).cast("bigint")
    return code * code * code * code * code


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def join_values(words: DataFrame) -> DataFrame:
    """(value, word, n, gone, side): ``gone`` is the code point of the letter taken away, 0 where none is; ``side`` is 0
    if the first half stays as it is and 1 if the second does."""
    size = F.length("word")
    key = F.aggregate(letters(F.col("word")), F.lit(0).cast("bigint"), lambda k, c: (k + power(c)) % MODULUS)
    rows = words.select("word", "n", size.alias("size"), key.alias("key"))
    size, word = F.col("size"), F.col("word")

    def half(side: int, begin: Column, length: Column, left: Column, gone: Column, rest: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(side), F.substring(word, begin, length), left, rest).alias("value"), gone.alias("gone"), F.lit(side).alias("side"))

    def reduced(side: int) -> Column:
        left = size - 1
        cut = F.floor(left / 2).cast("int")
        part = F.substring(word, cut + 1, size) if side == 0 else F.substring(word, F.lit(1), cut + 1)
        begin, length = (F.lit(1), cut) if side == 0 else (cut + 2, size)
        return F.transform(F.array_distinct(letters(part)), lambda c: half(side, begin, length, left, F.ascii(c), (F.col("key") + MODULUS - power(c)) % MODULUS))

    middle = F.floor(size / 2).cast("int")
    own = F.array(half(0, F.lit(1), middle, size, F.lit(0), F.col("key")), half(1, middle + 1, size, size, F.lit(0), F.col("key")))
    return rows.select("word", "n", F.explode(F.concat(own, reduced(0), reduced(1))).alias("x")).select("x.value", "word", "n", "x.gone", "x.side")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words one letter apart, once, ``word`` before ``near``."""
    rows = join_values(words)
    first = F.substring(F.col("word"), F.lit(1), F.floor((F.length("word") - F.when(F.col("gone") > 0, 1).otherwise(0)) / 2).cast("int"))
    left = rows.withColumn("first", F.when(F.col("side") == 1, first))
    right = left.toDF("value", "near", "near_n", "near_gone", "near_side", "near_first")
    met = left.join(right, "value").where((F.col("word") < F.col("near")) & (F.col("gone") != F.col("near_gone")) & (F.col("side") == F.col("near_side")) & ~F.coalesce(F.col("first") == F.col("near_first"), F.lit(False)))
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def follow(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the form of the form, and so on to the last. Forms may not lead in a circle."""
    step = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while step.where("moved").limit(1).count():
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        written = materialize(moved, "roots")
        discard(step)
        step = written
    return step.drop("moved")


def group_variants(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n), words distinct -> word, form, root, n, n_near, form_n."""
    words = materialize(counts, "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("other_n")), F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), (-F.col("best.less")).alias("top"), F.col("best.other").alias("other"))
    takes = F.col("top") >= F.col("n") * ratio
    found = materialize(joined.select("word", "n", "n_near", F.when(takes, F.col("other")).alias("form"), F.when(takes, F.col("top")).alias("form_n")), "forms")
    discard(words)
    roots = follow(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS crcs FROM range(256) AS v(i))"
ORACLE = f"""WITH RECURSIVE a AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
b AS (SELECT id, translate(run, '{UPPER}', '{LOWER}') AS run FROM a WHERE length(run) >= 7),
c AS (SELECT run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM b GROUP BY id, run),
h AS (SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda s, y: xor(crcs[CAST(xor(s, y) % 256 AS BIGINT) + 1], s // 256)), 4294967295) AS h FROM c, {_CRC_TABLE}),
e AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
l AS (SELECT word, n, i, word[:i - 1] AS l, word[i + 1:] AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM l a JOIN l b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word UNION SELECT l.word, w.word, w.n FROM l JOIN w ON l.l || l.r = w.word UNION SELECT w.word, l.word, l.n FROM l JOIN w ON l.l || l.r = w.word),
o AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN best END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM w LEFT JOIN o USING (word)),
s AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT s.word, s.next, f.form FROM s JOIN f ON f.word = s.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN s ON s.word = f.word AND s.next IS NULL"""
