"""Quality rules, ranked search and spelling groups against plain Python: nulls, empty and long texts, ties, repeats, clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import lexical_search as L
from tallyforge.llm import quality_rules as Q
from tallyforge.llm import spelling as P


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "a", *("".join(r.choice("aeinrst") for _ in range(r.randint(2, 9))) for _ in range(3))]) for _ in range(n))


TEXTS = [
    prose(80, 1), prose(80, 1), prose(60, 2) + "\n" + prose(60, 2), None, "", " \t\n\x0b\f\r", "ten words are not many but they will do here", "one two three four five " * 6,
    "a b c d e f g h i j\nsame line of words here\n\nsame line of words here\r\n same line of words here", "# * $ % & | < > word joined 😀 ÉCOLE", "\n".join(f"- item {i} of the list" for i in range(40)),
    "what comes next of the ...\n" * 30, prose(9000, 3) + " " + prose(300, 4) + " " + prose(300, 4), "x" * 70000 + " " + "é" * 500, "1 2 3 4 5 6 7 8 9 10 11 12", "Zürich zürich ZÜRICH café CAFÉ cafe",
]
#: Columns that are named like those in use inside.
SCHEMA = "doc_id long, text string, words string, n int, hashes string, row int, term string, value int, word string, item int"


def rows_of(texts):
    rows = [(i, t, "x", i, "y", 1, "z", 2, "w", 3) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, texts[0], *rows[0][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3)


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_rules_equal_plain_python(docs):
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r) for r in Q.apply_rules(docs).collect()), key=lambda x: x[0])
    assert [i for i, _ in got] == sorted(-1 if r[0] is None else r[0] for r in rows_of(TEXTS))
    for i, r in got:
        want = measures(TEXTS[max(i, 0)])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed and r.failed == "")
    by = {i: r for i, r in got}
    assert by[0].kept and by[3].base_failed and by[4].base_failed and by[7].base_failed and by[14].failed == "word_length,letters" and "bullet_lines" in by[10].failed and "open_lines" in by[11].failed and by[9].failed


def test_rules_at_their_bounds_and_others(spark, docs):
    one = spark.createDataFrame([(1, "aa bb cc dd #")], "doc_id long, text string")
    run = lambda *rules: Q.apply_rules(one, rules=rules, least_words=1).first()
    assert run(Q.Rule("s", "n_symbols", "n_words", most=20)).kept and not run(Q.Rule("s", "n_symbols", "n_words", most=19)).kept
    assert run(Q.Rule("w", "word_chars", "n_words", least=180)).kept and run(Q.Rule("w", "word_chars", "n_words", least=181)).failed == "w"
    assert run(Q.Rule("w", "word_chars", "n_words", least=999, words=6)).kept and run().kept
    plan = Q.apply_rules(spark.createDataFrame(rows_of(TEXTS), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert Q.apply_rules(docs.where("false")).count() == 0
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.apply_rules(docs).where("kept").collect()}


def test_colliding_hashes_are_told_apart(spark):
    """With all hashes of windows alike only the windows themselves decide."""
    words = "a b c d e f a b c d e g h i j k".split()
    df = spark.createDataFrame([(words,)], "w array<string>").withColumn("h", F.transform(F.sequence(F.lit(1), F.lit(len(words) - 4)), lambda x: F.lit(7).cast("bigint")))
    assert df.select(Q.repeated_words(F.col("w"), F.col("h")).alias("n")).first().n == 10


def ranked(texts, items, k):
    low = str.maketrans(L.UPPER, L.LOWER)
    terms = lambda t: re.findall(L.TERM, (t or "").translate(low))
    held = [(i, Counter(t), len(t)) for i, x in texts if (t := terms(x))]
    total, df = sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    wanted = defaultdict(set)
    for i, x in items:
        wanted[i] |= set(terms(x))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, c, n in held:
            m = 50 + 50 * n * len(held) // total
            scores.append((sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t]), i))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, place + 1, i, s) for place, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize(("k", "block"), [(3, 50_000), (7, 10), (50, 40)])
def test_search_equals_brute_force(spark, docs, k, block):
    more = [(100 + i, prose(30 + i, 50 + i % 7)) for i in range(60)]  # many ties: texts that share a beginning
    table = docs.select("doc_id", "text", "term", "item", "n").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).repartition(5)
    items = [(1, prose(30, 50)), (2, "The AND of"), (3, None), (4, ""), (5, "nothing🙂here"), (6, "zürich CAFÉ"), (None, "the item of a null id"), (1, "one id more text and the words"), (7, TEXTS[13])]
    asked = spark.createDataFrame([(*x, 0, "t") for x in items], "item_id long, text string, item int, term string")
    got = [tuple(r) for r in L.search(table, asked, k, block).collect()]
    want = ranked([(r[0], r[1]) for r in rows_of(TEXTS)] + more, items, k)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_search_of_empty_tables(spark, docs):
    asked = spark.createDataFrame([(1, "the")], "item_id long, text string")
    for d, q in ((docs.where("false"), asked), (docs, asked.where("false")), (docs.where("text IS NULL"), asked)):
        out = L.search(d, q)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_pruned_terms_make_no_candidates():
    """A document of pruned terms alone is left out, whatever is left is scored with all terms."""
    import numpy as np

    items = L.Items.of(np.array([0, 0, 0]), np.array([0, 1, 2]), np.array([100, 2, 1]), np.array([0, 0, 0]), np.array([50, 10, 10]))
    items.bound[:] = 31
    best = L.Best(items, 2)
    doc = np.arange(3)
    L.score_block(items, best, doc, np.zeros(3, np.int64), np.array([50, 50, 50]), np.array([2, 2, 1]), np.array([0, 2, 1, 2, 1]), np.array([1, 1, 1, 1, 1]))
    assert items.rest.tolist() == [5030, 30, 10] and best.rows[0][2].tolist() == [0] and best.rows[0][0][0] == 101 * (10**9 // 2000)


def grouped(texts, ratio=10):
    n = Counter()
    for i, t in texts:
        for run in re.findall(P.RUN, t or ""):
            run = run.translate(str.maketrans(P.UPPER, P.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[word] += len(word) >= 7
    n = {w: c for w, c in n.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= ratio * n[w] else None, len(others))
    for w, (form, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        yield w, form, root, n[w], count, n[form] if form else None


def variants(seed):
    """Words with edits at every place, in counts that make chains of forms, and ties."""
    r = random.Random(seed)
    bases, text = ["ananasan", "aaaaaaaa", "spelling", "übergröße", "palindrome", "aabbaabb"], []
    for b in bases:
        text += [b] * 400
        for i in range(len(b) + 1):
            edits = [b[:i] + b[i + 1 :], b[:i] + r.choice("abnsé") + b[i + 1 :], b[:i] + r.choice("abnsé") + b[i:]]
            text += [w for w in edits for _ in range(r.choice([1, 2, 3, 30]))]
            j = r.randrange(len(b))
            text += [edits[1][:j] + edits[1][j + 1 :]] * 3 + ["".join(r.sample(b, len(b)))] * 2
    r.shuffle(text)
    return [" ".join(text[i : i + 50]) for i in range(0, len(text), 50)]


def test_spelling_equals_brute_force(spark):
    texts = [*variants(1), *TEXTS, "SPELLING Spelling spel-ling", "×÷×÷×÷×÷ ×÷×÷×÷×÷", "y" * 30000 + " " + "y" * 30000 + " " + "y" * 29999 + " " + "y" * 29999]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in P.group_variants(P.word_counts(docs)).collect()), key=lambda r: r[0])
    want = sorted(grouped([(r[0], r[1]) for r in rows_of(texts)]), key=lambda r: r[0])
    assert got == want and any(r[1] and r[1] != r[2] for r in want) and sum(r[4] for r in want) > 100


def test_spelling_pairs_come_once_and_letters_differ(spark):
    words = spark.createDataFrame([(w, 2) for w in {*(x for t in variants(2) for x in t.split() if len(x) >= 7)}], "word string, n long")
    pairs = [(r.word, r.near) for r in P.near_pairs(words).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    alphabet = [ord(c) ** 5 for c in [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]]
    gaps = [a - b for a in alphabet for b in alphabet if a != b]
    assert len(set(gaps)) == len(gaps) and not set(gaps) & set(alphabet)


def test_spelling_of_nothing(spark, docs):
    for d in (docs.where("false"), docs.where("text IS NULL"), docs.where("doc_id = 4")):
        assert P.group_variants(P.word_counts(d)).count() == 0
