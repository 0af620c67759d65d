"""The label model, the fixed lists without labels, and recall on the given labels."""

import os
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import toxicity as T


def scores(model, *texts):
    return T.score_texts(pa.array(texts, pa.large_string()), model)


@pytest.mark.parametrize(("texts", "y"), [([], []), (["one text", "two texts"] * 5, [0] * 10), (["an idiot"] * 4, [1] * 4)])
def test_without_labels_of_both_kinds_the_fixed_lists_count(texts, y):
    model = T.fit(texts, np.array(y, np.int64))
    got = scores(model, "you idiot moron stupid loser", "ein Trottel", "quel imbécile", "qué asqueroso", "hello there friend", "", None)
    assert (got[:4] > 0.3).all() and (got[4:] < 0.3).all()


def test_votes_that_only_toxic_texts_get_are_certain():
    """However many voters copy each other; abstentions do not count against it."""
    v = np.full((200, 8), T.ABSTAIN)
    v[:6, :5] = 1  # five voters say the same of the same few texts
    v[6:9, 0] = 1  # one of them speaks alone
    v[20:, 6] = 0
    post = T.label_model(v, 0.1)
    assert (post[:9] > 0.5).all() and (post[20:] < 0.05).all() and np.allclose(post[9:20], 0.1)


def test_a_voter_that_speaks_against_the_rest_loses_weight():
    v = np.full((300, 4), T.ABSTAIN)
    v[:30, :2] = 1
    v[30:, 3] = 0
    v[30:90, 2] = 1  # says toxic of texts that the good voter calls clean
    post = T.label_model(v, 0.1)
    assert (post[:30] > 0.9).all() and (post[90:] < 0.15).all() and (post[30:90] < post[:30].min() - 0.1).all()


def test_clusters_are_components():
    c = np.eye(5)
    c[0, 2] = c[2, 0] = c[2, 4] = c[4, 2] = 0.9
    assert T.clusters(c, 0.5).tolist() == [0, 1, 0, 3, 0]


@pytest.mark.parametrize(("sf", "train", "held"), [("sf0.001", 0.6, 0.0), ("sf0.01", 0.8, 0.7), ("sf0.1", 0.9, 0.9)])
def test_recall_on_given_labels(sf, train, held):
    """At most 1 % of clean texts are predicted toxic. On the small tables some languages have too few toxic texts to learn from."""
    at = f"/root/testdata/{sf}"
    if not os.path.isdir(at):
        pytest.skip("the tables are not here")
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{at}/documents.parquet' JOIN '{at}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    out, y = np.array([zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]), np.array([r[2] for r in rows])
    model = T.fit([r[1] for r, o in zip(rows, out, strict=True) if not o][:4000], y[~out][:4000])
    said = scores(model, *[r[1] for r in rows]) >= 0.3
    for part, least in ((~out, train), (out, held)):
        assert said[part & (y == 1)].mean() >= least and said[part & (y == 0)].mean() <= 0.01
    assert said[out].any()
