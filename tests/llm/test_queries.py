"""The registered queries over the smallest tables: against their SQL, or against plain Python where SQL can't say them."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from tallyforge.llm import queries, secrets
from tallyforge.llm import shingling as S
from tallyforge.llm.common import table

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def run(spark, name):
    return {r[0]: r for r in queries.queries()[name](spark, SF).collect()}


def tokenizer(name):
    t = tokenizers.Tokenizer.from_file(str(public_tokenizers.path(name)))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(want.fetchall())


def test_op1(spark, texts):
    lib = tokenizer("word_bpe_49k.json")
    got = run(spark, "op1_bpe")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize(("name", "label", "of", "out", "least"), [("op2_toxicity", "toxic", 4, 2, 0.8), ("op8_quality", "quality", 5, 0, 0.8)])
def test_classifiers(spark, texts, name, label, of, out, least):
    got = run(spark, name)
    assert got.keys() == texts.keys()
    gold = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % of == out) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [i for i in gold if i in got and got[i].held_out and gold[i] is not None]
    assert np.mean([got[i].predicted == gold[i] for i in held]) >= least


def test_op5(spark, texts):
    got = run(spark, "op5_secrets")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        spans = sorted((m.start(), no, f"{kind}:{m.start()}:{m.end()}") for no, (kind, pattern, group, least, _) in enumerate(secrets.KINDS) for m in re.finditer(pattern, t or "", re.A) if len(m[group]) >= least)
        base = [(no, s) for _, no, s in spans if no < secrets.BASE]
        assert got[i].spans == ",".join(s for *_, s in spans)
        assert got[i].base_sha256 == hashlib.sha256(",".join(s for _, s in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(no == k for no, _ in base) for k in range(3))
        assert got[i].n_live + got[i].n_example == len({tuple(s.split(":")[1:]) for *_, s in spans})


def test_op6(spark, texts):
    """Passages of over 50 words that an earlier document holds go for the greater part; documents that share no line and
    no 20 words in a row with others, or with themselves, keep all."""
    got = run(spark, "op6_paragraph_dedup")
    assert got.keys() == texts.keys()
    words = {i: S.plain_words(t) for i, t in texts.items()}
    first, seen, lines = {}, {}, {}
    need = {}
    for i in sorted(texts):
        inside = set()
        for k in range(len(words[i]) - 50):
            if first.setdefault(tuple(words[i][k : k + 51]), i) < i:
                inside.update(range(k, k + 51))
        if inside:
            need[i] = sum(len(words[i][k]) + 1 for k in inside)
        for k in range(len(words[i]) - 19):
            seen.setdefault(tuple(words[i][k : k + 20]), []).append(i)
        for line in (texts[i] or "").split("\n"):
            w = S.plain_words(line)
            for k in range(len(w) - 4):
                lines.setdefault(tuple(w[k : k + 5]), []).append(i)
    assert need and all(got[i].n_removed >= 0.5 * n for i, n in need.items())
    shared = {i for own in (*seen.values(), *lines.values()) if len(own) > 1 for i in own}
    for i, t in texts.items():
        if i not in shared:
            assert got[i].n_removed == 0 and got[i].kept_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_op9(spark, texts):
    lib = tokenizer("byte_bpe_50k.json")
    got = run(spark, "op9_token_store")
    assert got.keys() == texts.keys()
    start = 0
    for i in sorted(texts):
        ids = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
