"""Keys of small sets of shingles, and the verification of many small groups at once."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import lsh, paragraph_dedup
from tallyforge.llm import shingling as S


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
@pytest.mark.parametrize("alphabet", [2, 3, 8, 100])
def test_small_sets_meet_if_they_are_linked(threshold, alphabet):
    r = random.Random(alphabet)
    texts = []
    for _ in range(150):
        w = [f"w{r.randrange(alphabet)}" for _ in range(r.randrange(5, 16))]
        texts += [w, w[1:], w[:-1], w + w[-1:]]
    words, items, rows, _ = lsh.items_of(pa.array([" ".join(w) for w in texts if len(w) > 4]), "text")
    hashes, of = S.shingles(words, items, len(rows), 5)
    item, key, first, large = lsh.set_keys(hashes, of, lsh.repeating(words, items, len(rows), 4), threshold)
    sets = [set(hashes[of == i].tolist()) for i in range(len(rows))]
    keys = [set(key[item == i].tolist()) for i in range(len(rows))]
    assert (np.bincount(item[first], minlength=len(rows)) == ~large).all()
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both >= threshold * len(sets[i] | sets[j]) - 1e-9:
            assert keys[i] & keys[j] or (large[i] and large[j])


def test_units_send_few_keys(spark, monkeypatch):
    """About half of the band keys are not needed: most units are so short that only equal ones, or one with a word
    more, are linked with them."""
    r = random.Random(5)
    docs = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(300))) for i in range(40)]
    sent, real = [], lsh.collisions
    monkeypatch.setattr(lsh, "collisions", lambda pairs: sent.append(pairs.count()) or real(pairs))
    got = paragraph_dedup.remove_repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(x.n_removed == 0 for x in got)
    words, item, rows, _ = lsh.items_of(pa.array([t for _, t in docs]), "unit")
    units = int((np.bincount(item) >= 5).sum())
    bands, _ = lsh.tune_bands(0.8, 1e-2, width=2)
    assert units < sent[1] < 0.6 * bands * units


def test_small_and_large_groups_are_verified_alike(spark):
    """Counts and components of groups of one node to several chunks, repeated rows included, as brute force has them."""
    r = random.Random(9)
    rows, want, node = [], {}, 0
    for grp, size in enumerate([1, 2, 2, 3, 5, 40, lsh.FEW, lsh.FEW + 1, 150] + [2] * 60):
        base = np.array([r.randrange(1 << 40) for _ in range(60)], np.uint64)
        own = []
        for _ in range(size):
            some = np.unique(np.concatenate([base[r.randrange(12) :], np.array([r.randrange(1 << 40) for _ in range(r.randrange(6))], np.uint64)]))
            own.append((node, r.randrange(1, 4), some))
            node += 1
        for k, copies, some in own:
            _, sig = S.minhashes(some, np.zeros(len(some), np.int64), 32, seed=2)
            rows += [(grp, size, k, copies, sig.astype(np.uint16).tobytes(), some.tobytes())] * (1 + k % 2)
            near = [c for j, c, x in own if j != k and (n := len(np.intersect1d(some, x))) >= 0.8 * (len(some) + len(x) - n) - 1e-9]
            want[k] = sum(near)
    members = spark.createDataFrame(rows, "grp long, size long, node long, copies long, sig binary, grams binary")
    got = lsh.verify(members, 0.8, lsh.pruner(0.8, 32, 1e-6), chunk=100).collect()
    count: dict[int, int] = {}
    for x in got:
        if x.kind == 0:
            count[x.a] = count.get(x.a, 0) + x.b
    assert count == {k: n for k, n in want.items() if n}
    assert {x.a for x in got if x.kind == 1} | {x.b for x in got if x.kind == 1} == set(count)
