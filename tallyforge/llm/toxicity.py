"""Toxicity: many weak voters, a generative model of their accuracies and correlations, a linear classifier.

Voters are lexicons and patterns. Each says toxic, clean, or nothing:

* fixed lists of insults: one English word, two of them, and a German, French or Spanish one;
* lexicons of words, and of word beginnings of 4, 5 and 6 bytes, that are far more frequent in toxic than in clean
  texts of the learning sample, dealt by hash over several voters; texts without any such word get a clean vote;
* beginnings that words of toxic texts come back to: at least two words of a text and one in 200 begin so, and hardly
  any clean text does that with the same beginning. This finds insults with many endings, in any language;
* the share of such words in a text; shouting; an insult beside a second-person word.

The generative model treats the true label as hidden. Expectation-maximisation estimates how right each voter is with each
answer it gives (an abstention is missing, not an answer), and after some rounds the correlations of the voters' residuals
given the label: voters that copy one another form a cluster, of which one full vote counts. The posterior label of each
learning row follows. A logistic regression in numpy learns these posteriors from the votes and the lexicon features, and
scores every text.

At most ``most`` labelled rows outside the held-out fold are learned from (a documented bound). Defined cases: null
and empty texts have no feature and get the score of the bias; with no labelled rows, or labels of one kind only, just the fixed lists count; null
labels and ids are not learned from; of several texts of one labelled id one is, and of several labels the toxic one;
each of several repeated rows gets its own row and the same score; a score at the threshold is predicted toxic. An empty
table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import fold, labelled_sample, sigmoid
from .shingling import minhashes, mix, powers, shingles, slices, word_hashes

INSULTS = "idiot moron stupid loser trash scum worthless pathetic disgusting clown dumb fool imbecile jerk bastard vermin filth".split()
#: Insults of further languages, one voter each.
FURTHER = (
    "trottel dummkopf abschaum versager wertlos ekelhaft schwachkopf drecksack arschloch widerlich".split(),
    "imbécile crétin abruti salaud minable dégoûtant racaille connard vaurien pourriture".split(),
    "imbécil estúpido basura escoria inútil patético asqueroso payaso perdedor cretino".split(),
)
SECOND_PERSON = "you your youre tu du te dich usted vous".split()
STEMS = (4, 5, 6)
GROUPS = 6
FIXED = 2 + len(FURTHER)
N_VOTERS = FIXED + GROUPS + 2 * len(STEMS) + 3
ABSTAIN = -1


def hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(word_hashes(pa.array([" ".join(words)]))[0])


def counted(texts: pa.Array) -> dict[str, np.ndarray]:
    """Hashes of the words and of their beginnings, with their rows."""
    words, rows, starts, ends, raw, offsets = word_hashes(texts)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=prefix[1:])
    inverse = powers(len(raw) + 1, inverse=True)
    out = {"words": words, "rows": rows, "n": len(texts), "shout": shouting(texts)}
    for k in STEMS:
        some = ends - starts > k
        at = starts[some]
        out[f"stem{k}"] = mix((prefix[at + k] - prefix[at]) * inverse[at] + np.uint64(k))
        out[f"of{k}"] = rows[some]
    return out


def shouting(texts: pa.Array) -> np.ndarray:
    upper = pc.fill_null(pc.count_substring_regex(texts.cast(pa.large_string()), r"\b[A-Z]{4,}\b"), 0).to_numpy(zero_copy_only=False)
    return upper


def inside(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table; a bit filter keeps most from the search."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    bits = np.zeros(1 << 16, bool)
    bits[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(values & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    out = np.zeros(len(values), bool)
    out[maybe[table[at] == values[maybe]]] = True
    return out


@dataclass
class Model:
    insults: np.ndarray
    second: np.ndarray
    further: list[np.ndarray]
    lexicon: np.ndarray
    stems: dict[int, np.ndarray]
    dense: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float


def dense_pairs(values: np.ndarray, rows: np.ndarray, total: np.ndarray, share: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """(value, row) pairs, each once, whose value stands at least twice in the row and for ``share`` of its words."""
    _, once, count = np.unique(values + mix(rows), return_index=True, return_counts=True)
    once = once[(count >= 2) & (count >= share * total[rows[once]])]
    return values[once], rows[once]


def votes(found: dict[str, np.ndarray], lex: np.ndarray, stems: dict[int, np.ndarray], dense: dict[int, np.ndarray], insults: np.ndarray, second: np.ndarray, further: list[np.ndarray]) -> np.ndarray:
    """One row of votes (1 toxic, 0 clean, -1 none) for each text."""
    n, words, rows = found["n"], found["words"], found["rows"]
    out = np.full((n, N_VOTERS), ABSTAIN, np.int8)
    total = np.bincount(rows, minlength=n)
    insult = inside(words, insults)
    fixed = np.bincount(rows[insult], minlength=n)
    out[fixed > 0, 0] = 1
    out[fixed > 1, 1] = 1
    for i, own in enumerate(further):
        out[np.bincount(rows[inside(words, own)], minlength=n) > 0, 2 + i] = 1
    learned = inside(words, lex)
    group = (words[learned] >> np.uint64(40)) % np.uint64(GROUPS)
    any_hit = fixed + (out[:, 2:FIXED] == 1).sum(1)
    for g in range(GROUPS):
        hit = np.bincount(rows[learned][group == g], minlength=n)
        any_hit += hit
        out[hit > 0, FIXED + g] = 1
    for i, k in enumerate(STEMS):
        hit = np.bincount(found[f"of{k}"][inside(found[f"stem{k}"], stems[k])], minlength=n)
        out[hit > 0, FIXED + GROUPS + i] = 1
        any_hit += hit
        known = inside(found[f"stem{k}"], dense[k])
        hit = np.bincount(dense_pairs(found[f"stem{k}"][known], found[f"of{k}"][known], total)[1], minlength=n)
        out[hit > 0, FIXED + GROUPS + len(STEMS) + i] = 1
        any_hit += hit
    at = FIXED + GROUPS + 2 * len(STEMS)
    out[any_hit == 0, at] = 0
    out[any_hit > 0.002 * np.maximum(total, 1), at] = 1
    out[(any_hit == 0) & (total > 0), at + 1] = 0
    beside = np.zeros(len(words), bool)
    if len(words) > 1:
        me = inside(words, second)
        bad = insult | learned
        beside[1:] = bad[1:] & me[:-1] & (rows[1:] == rows[:-1])
        beside[:-1] |= bad[:-1] & me[1:] & (rows[1:] == rows[:-1])
    out[np.bincount(rows[beside], minlength=n) > 0, at + 1] = 1
    out[(found["shout"] > 0) & (any_hit > 0), at + 2] = 1
    return out


def frequent_in(values: np.ndarray, rows: np.ndarray, y: np.ndarray, clean: float = 0.02, least: int = 3) -> np.ndarray:
    """Sorted values that mark toxic texts: in at least ``least`` of them, and in at most ``clean`` times as many clean ones;
    and seldom enough in the clean ones for the number of toxic ones not to be chance. (value, row) pairs are distinct."""
    distinct, place = np.unique(values, return_inverse=True)
    toxic = y[rows] == 1
    bad, good = np.bincount(place[toxic], minlength=len(distinct)), np.bincount(place[~toxic], minlength=len(distinct))
    share = y.mean()
    # of so many texts with the value, all but ``good`` toxic: chance, times the number of values that so many texts hold
    held = np.bincount(bad + good)
    alike = np.maximum(held[bad + good], 1)
    chance = np.log(alike) + bad * np.log(share) + good * np.log(np.maximum(bad + good, 1))
    return distinct[(bad >= least) & (good <= clean * bad) & (chance <= np.log(0.5))]


def clusters(corr: np.ndarray, least: float) -> np.ndarray:
    """The smallest voter that each voter is tied to by correlations of at least ``least``, directly or through others."""
    of = np.arange(len(corr))
    for _ in of:
        of = np.where(corr >= least, of[None, :], len(of)).min(1, initial=len(of)).clip(max=of)
    return of


def label_model(v: np.ndarray, share: float, rounds: int = 30, copies: float = 0.3, belief: float = 0.9) -> np.ndarray:
    """Posterior probability of the toxic label for each row of votes, by EM.

    A voter has an accuracy for each answer it gives; an abstention says nothing. Before any row is seen a toxic vote is held
    to be right with probability ``belief``, at the weight of two rows: what no other voter speaks for or against stays
    there. Voters whose answers agree beyond what
    the label explains, by a correlation of their residuals of ``copies`` or more, are copies of one another: of a cluster
    the strongest answer given counts, and counts in full.
    """
    patterns, place, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    place = place.reshape(-1)
    answers = (patterns == 0, patterns == 1)
    post = np.where(answers[1].any(1), np.clip(answers[1].sum(1) / np.maximum((patterns >= 0).sum(1), 1), 0.5, 0.98), np.where(answers[0].any(1), 0.02, share))
    cluster = np.arange(v.shape[1])
    base = np.log(share / (1 - share))
    for r in range(rounds):
        # what an answer adds to the log-odds: those of the label among rows with this answer, less those of all rows
        add = []
        for said, hope in zip(answers, (share * (1 - belief), belief), strict=True):
            rows = (said * counts[:, None]).sum(0)
            toxic = (said * (counts * post)[:, None]).sum(0)
            add.append(np.log((toxic + 2 * hope) / (rows - toxic + 2 * (1 - hope))) - base)
        gives = np.where(answers[1], np.maximum(add[1], 0), np.where(answers[0], np.minimum(add[0], 0), 0.0))
        up = np.stack([np.where(cluster == c, gives, 0).max(1) for c in np.unique(cluster)], axis=1)
        down = np.stack([np.where(cluster == c, gives, 0).min(1) for c in np.unique(cluster)], axis=1)
        post = sigmoid(up.sum(1) + down.sum(1) + base)
        if r == rounds // 3:
            value = np.where(patterns < 0, 0.0, 2.0 * patterns - 1)
            cov = np.zeros((v.shape[1],) * 2)
            for m in (counts * (1 - post), counts * post):
                off = value - (m[:, None] * value).sum(0) / max(m.sum(), 1e-9)
                cov += (m[:, None] * off).T @ off / counts.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            cluster = clusters(cov / np.outer(sd, sd), copies)
    return post[place]


def unlike(texts: list[str], bands: int = 16, rows: int = 2) -> list[int]:
    """Places of the texts that are near copies of no earlier one: a text copied often would make a lexicon of its own words."""
    arr, kept, seen = pa.array(texts, pa.large_string()), [], set()
    for at, n in slices(arr):
        words, of, *_ = word_hashes(arr.slice(at, n))
        have, values = minhashes(*shingles(words, of, n, 5), bands * rows)
        keys = mix(values[:, :bands] * np.uint64(3) + values[:, bands:] + np.arange(bands, dtype=np.uint64))
        for i, own in zip(have.tolist(), keys.tolist(), strict=True):
            if seen.isdisjoint(own):
                kept.append(at + i)
            seen.update(own)
    return kept


def fit(texts: list[str], y: np.ndarray) -> Model:
    kept = unlike(texts)
    texts, y = [texts[i] for i in kept], y[kept] if len(y) else y
    arr = pa.array(texts, pa.large_string())
    both_kinds = len(y) > 0 and 0 < y.sum() < len(y)
    insults, second, further = hashes_of(INSULTS), hashes_of(SECOND_PERSON), [hashes_of(w) for w in FURTHER]

    def marks(pick: Callable[[dict[str, np.ndarray], int], tuple[np.ndarray, np.ndarray]], **options) -> np.ndarray:
        """The marks among the (value, row) pairs that ``pick`` takes from each slice. One kind of pairs is held at a time, and
        texts are counted again for the next, so that the driver's memory stays small."""
        values, rows = [], []
        for at, n in slices(arr) if both_kinds else ():
            value, row = pick(counted(arr.slice(at, n)), n)
            values.append(value)
            rows.append((row + at).astype(np.int32))
        return frequent_in(np.concatenate(values), np.concatenate(rows), y, **options) if values else np.empty(0, np.uint64)

    def distinct(name: str, of: str) -> Callable[[dict[str, np.ndarray], int], tuple[np.ndarray, np.ndarray]]:
        def pick(found: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
            _, once = np.unique(found[name] + mix(found[of]), return_index=True)
            return found[name][once], found[of][once]

        return pick

    lex = marks(distinct("words", "rows"))
    stems = {k: marks(distinct(f"stem{k}", f"of{k}")) for k in STEMS}
    dense = {k: marks(lambda found, n, k=k: dense_pairs(found[f"stem{k}"], found[f"of{k}"], np.bincount(found["rows"], minlength=n)), clean=0.1) for k in STEMS}
    if not both_kinds:
        weights = np.zeros(2 * N_VOTERS + 3)
        weights[N_VOTERS : N_VOTERS + FIXED] = 4.0
        return Model(insults, second, further, lex, stems, dense, weights, -2.0)
    said, features = [], []
    for at, n in slices(arr):
        found = counted(arr.slice(at, n))
        said.append(votes(found, lex, stems, dense, insults, second, further))
        features.append(design(found, said[-1], lex, stems))
    x = np.concatenate(features)
    target = label_model(np.concatenate(said), float(y.mean()))
    weights, bias = np.zeros(x.shape[1]), 0.0
    for step in range(400):
        gap = sigmoid(x @ weights + bias) - target
        rate = 2.0 / (1 + step / 100)
        weights -= rate * (x.T @ gap / len(x) + 1e-4 * weights)
        bias -= rate * gap.mean()
    return Model(insults, second, further, lex, stems, dense, weights, float(bias))


def design(found: dict[str, np.ndarray], v: np.ndarray, lex: np.ndarray, stems: dict[int, np.ndarray]) -> np.ndarray:
    """Features of the linear classifier: clean votes, toxic votes, and how many lexicon words and beginnings."""
    n = found["n"]
    n_lex = np.bincount(found["rows"][inside(found["words"], lex)], minlength=n)
    n_stem = np.bincount(found[f"of{STEMS[0]}"][inside(found[f"stem{STEMS[0]}"], stems[STEMS[0]])], minlength=n)
    total = np.bincount(found["rows"], minlength=n)
    more = np.stack([np.log1p(n_lex), np.log1p(n_stem), 20 * (n_lex + n_stem) / np.maximum(total, 10)], axis=1)
    return np.concatenate([v == 0, v == 1, more], axis=1).astype(float)


def score_texts(texts: pa.Array, m: Model) -> np.ndarray:
    found = counted(texts)
    return sigmoid(design(found, votes(found, m.lexicon, m.stems, m.dense, m.insults, m.second, m.further), m.lexicon, m.stems) @ m.weights + m.bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 4000, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    texts, y = labelled_sample(docs, labels, "toxic", 4, 2, most)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, y))  # lexicons of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, n in slices(batch.column(2)):
                score = score_texts(batch.column(2).slice(at, n), model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; labels are read for training only."""
    threshold = options.pop("threshold", 0.3)
    texts, y = labelled_sample(docs, labels, "toxic", 4, 2, options.pop("most", 4000))
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, y))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for begin, n in slices(batch.column(at)):
                part = batch.slice(begin, n)
                yield part.filter(pa.array(score_texts(part.column(at), model) < threshold))

    return docs.mapInArrow(run, docs.schema)
