"""Cases that earlier versions got wrong: short items, long keys, characters of a recent Unicode."""

import random
import unicodedata

import duckdb
import pytest
import regex

from tallyforge.llm import bpe, common, decontaminate, jaccard_join, lexical_search, paragraph_dedup, secrets, spelling, token_store

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def test_short_items_inside_long_texts(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    docs = [(1, f"{text(300)} Blue, whale! {text(300)}"), (2, "blue whale"), (3, f"{text(40)} blue {text(3)} whale"), (4, f"{text(50)} one two three four {text(9)}"), (5, "zebra"), (6, f"{text(10)} zebra"), (7, None), (8, ""), (9, f"one two three {text(30)}")]
    items = [(10, "Blue Whale"), (11, "one two three FOUR"), (12, "zebra"), (13, "..."), (14, None), (15, text(30))]
    docs += [(20, f"{text(5)} {items[5][1]} {text(5)}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/b")
    got = decontaminate.contained_items(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/b"))
    rows = sorted(tuple(x) for x in got.collect())
    assert {(a, b) for a, b, *_ in rows} == {(1, 10), (2, 10), (4, 11), (5, 12), (6, 12), (20, 15)}
    con = duckdb.connect()
    for name, at in (("documents", "d"), ("benchmark", "b")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{at}/*.parquet')")
    assert sorted(con.execute(decontaminate.ORACLE).fetchall()) == rows
    left = decontaminate.drop_contaminated(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/b"))
    assert sorted(x.doc_id for x in left.collect()) == [3, 7, 8, 9]


@pytest.mark.parametrize("lines", [500, 2000, 50_000])
def test_long_private_keys(spark, lines):
    r = random.Random(lines)
    body = "\n".join("".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(64)) for _ in range(lines))
    dashed = "\n".join(f"Header-{i}: a-b--c" for i in range(lines)) + "\n" + body
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = [f"a {begin}\n{body}\n{end} z", f"b {begin}\n{body}\nand so on", f"c {begin}\n{dashed}\n{end} z", f"d {begin}\n{body}\n{begin}\n{body}\n{end} z"]
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    spans = {x.doc_id: [s for s in x.spans.split(",") if s.startswith("pem:")] for x in secrets.scan_secrets(df).collect()}
    whole = len(begin) + 1 + len(body)
    assert spans[0] == [f"pem:2:{len(texts[0]) - 2}"] and spans[1] == [f"pem:2:{2 + whole}"] and spans[2] == [f"pem:2:{len(texts[2]) - 2}"]
    assert spans[3] == [f"pem:2:{2 + whole}", f"pem:{3 + whole}:{len(texts[3]) - 2}"]


def test_characters_of_a_recent_unicode():
    """Letters, numbers and marks that Python does not know yet, and all that ``regex`` calls a letter or number."""
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    lib = tokenizers.Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    with open(path, encoding="utf-8") as f:
        codec = bpe.Codec.from_json(f.read())
    odd = regex.findall(r"[\p{L}\p{N}\p{M}]", "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn"))
    assert len(odd) > 1000
    for c in odd:
        text = f"a{c}b?{c}1{c}"
        assert codec.encode(text) == lib.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_shards_roll_by_documents(spark, tmp_path):
    """Empty texts have hardly any bytes, yet a shard holds only so many of them; also with repeated keys at a border."""
    rows = [(i // 3, "" if i % 50 else "one two") for i in range(3000)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = token_store.write_shards(docs, str(public_tokenizers.path("byte_bpe_50k.json")), folder=f"file://{tmp_path}/t", shard_docs=100)
    made = manifest.collect()
    assert sum(r.n_docs for r in made) == len(rows) and all(r.n_docs <= 100 for r in made) and len(made) >= 31
    got = sorted(token_store.read_shards(manifest).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((i is None, i or 0, {"": 1, "x": 2, "one two": 3}[t]) for i, t in rows)
    assert token_store.TokenStore(manifest).get(500) is not None


@pytest.mark.parametrize(
    ("make", "stay"),
    [
        (jaccard_join.jaccard_classes, {"items", "named"}),
        (jaccard_join.keep_one_of_each, {"items", "named", "stay"}),
        (paragraph_dedup.remove_repeated_paragraphs, {"kept", "gone"}),
        (lambda d: lexical_search.search(d, d.select(d.doc_id.alias("item_id"), "text")), {"best"}),
        (lambda d: spelling.group_variants(spelling.word_counts(d, least_letters=3)), {"forms", "roots"}),
    ],
)
def test_only_what_the_result_reads_stays(spark, tmp_path, monkeypatch, make, stay):
    r = random.Random(1)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    shared = line(30)
    rows = [(i, "\n".join([line(20), shared, line(20)]) if i % 3 else f"{shared} {shared[:50]}{i}") for i in range(40)]
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    out = make(spark.createDataFrame(rows, "doc_id long, text string"))
    left = [p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").iterdir()]
    assert sorted(left) == sorted(stay) and out.count() >= 0
