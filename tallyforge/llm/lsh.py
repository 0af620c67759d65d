"""Banded MinHash over documents, lines or passages: colliding pairs, pruned, then exact Jaccard inside tiles of a group.

An *item* is a document, a line, or a unit: a passage between two borders that its own words set. Its *node* is the
64-bit key of its word sequence, so that exact copies are one node. A row is told by its key and ``body``, a hash of its
text, so that rows without a key, or with equal keys and different texts, are never mixed up. Steps, each cut by a
written table:

1. ``items_table``: the node of each item. ``band_rows``: one key for each band of each distinct node; lines and units
   of few shingles get fewer keys, which say what they can be linked with (``set_keys``). A node's keys
   are sent once per partition, so a text that fills a third of all rows costs each partition one set of keys.
2. ``collisions``: (key, node) pairs are range-partitioned and sorted by both columns, so one frequent key spreads over
   as many partitions as it needs. The ranges come from some texts, so that no key is computed twice for them. Runs of a key inside one Arrow batch are listed; runs that a batch's border cuts
   become stars, joined over partitions by border rows alone (two for a partition).
3. ``surviving``: within each listed run nodes are compared by further MinHash values, as ``prune`` says; those pairs
   that survive give a spanning forest, and its components are groups. Unlike texts that share a band don't meet.
4. ``verify``: a group is cut into chunks, and each pair of chunks is one tile; small tiles are verified many at once. A tile counts links for each node and
   keeps only the components they make, as stars, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingling as S
from .common import connected_components, discard, materialize, parts

#: Nodes of which a partition remembers that their keys were sent; then it starts anew.
REMEMBERED = 500_000
#: A unit starts at a word pair whose hash is the least among so many pairs on either side.
REACH = 4


def tune_bands(threshold: float, missed: float, width: int = 0, widths=range(2, 9), most: int = 256) -> tuple[int, int]:
    """(bands, rows): the steepest banding that misses a pair at ``threshold`` with probability ``missed`` at most."""
    best = None
    for rows in [width] if width else widths:
        bands = int(np.ceil(np.log(missed) / np.log1p(-(threshold**rows))))
        if bands * rows <= most and (best is None or rows > best[1]):
            best = bands, rows
    if best is None:
        raise ValueError("no banding within the number of hashes reaches this recall")
    return best


def unit_starts(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words that start a unit: the first of each row, and those where the hash of the pair that begins there is least
    among ``REACH`` pairs on either side in its row (the leftmost of equal ones)."""
    n = len(words)
    fresh = np.ones(n, bool)
    if n < 2:
        return np.flatnonzero(fresh)
    w = S.weights(2)
    top = np.iinfo(np.uint64).max
    pairs = S.mix(words[:-1] * w[0] + words[1:] * w[1])
    pairs[rows[1:] != rows[:-1]] = top
    place = np.arange(n - 1) + REACH * (rows[:-1] + 1)  # rows are so far apart that none sees another
    line = np.full(int(place[-1]) + REACH + 1, top, np.uint64)
    line[place] = pairs
    before = after = np.full(n - 1, top, np.uint64)
    for k in range(1, REACH + 1):
        before = np.minimum(before, line[place - k])
        after = np.minimum(after, line[place + k])
    fresh[1:] = rows[1:] != rows[:-1]
    fresh[:-1] |= (pairs < before) & (pairs <= after)
    return np.flatnonzero(fresh)


def items_of(texts: pa.Array, mode: str):
    """(word hashes, item of each word, row of each item, number of the item in its row); ``mode``: text, line or unit."""
    words, rows, starts, _, raw, offsets = S.word_hashes(texts)
    n = len(texts)
    if mode == "text":
        return words, rows, np.arange(n), np.zeros(n, np.int64)
    if mode == "line":
        breaks = np.flatnonzero(raw == 10)
        begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        begin = begin[begin < len(raw)] if len(raw) else begin[:0]
        item = np.searchsorted(begin, starts, side="right") - 1
        row = np.searchsorted(offsets, begin, side="right") - 1
    else:
        begin = unit_starts(words, rows)
        fresh = np.zeros(len(words), np.int64)
        fresh[begin] = 1
        item = np.cumsum(fresh) - 1
        row = rows[begin]
    first = np.searchsorted(row, np.arange(n))
    return words, item, row, np.arange(len(row)) - first[row]


def items_table(docs: DataFrame, mode: str, min_words: int) -> DataFrame:
    """(key, body, item, node): one row for each item that has ``min_words`` words. docs: (key, body, text)."""
    key_type = docs.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in S.slices(batch.column(2)):
                words, item, row, number = items_of(batch.column(2).slice(at, n), mode)
                nodes = S.sequence_keys(words, item, len(row))
                keep = np.flatnonzero(np.bincount(item, minlength=len(row)) >= max(min_words, 1))
                of = pa.array(row[keep] + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(number[keep], pa.int32()), pa.array(nodes[keep].view(np.int64), pa.int64())], names=["key", "body", "item", "node"])

    return docs.mapInArrow(run, f"key {key_type.simpleString()}, body long, item int, node long")


def small_sizes(threshold: float, most: int = 32) -> tuple[int, int]:
    """(least, large). Sets of which one has fewer than ``large`` members reach ``threshold`` only if they are equal or
    one is the other and one member more; the larger has ``least`` members or more then."""
    least = next((n for n in range(2, most) if n - 1 >= threshold * n - 1e-9), most)
    large = next((n for n in range(1, most) if n >= threshold * (n + 2) - 1e-9), most)
    return least, large


def repeating(words: np.ndarray, items: np.ndarray, n_items: int, width: int) -> np.ndarray:
    """Items in which some ``width`` words in a row may occur twice; of all others it is sure that none do."""
    out = np.zeros(n_items, bool)
    if width < 1:
        return ~out
    if len(words) <= width:
        return out
    w = S.weights(width)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * w[k]
    whole = items[: len(total)] == items[width - 1 :]
    bits = np.uint64(max(1, int(n_items).bit_length()))
    line = np.sort(items[: len(total)][whole].astype(np.uint64) << (np.uint64(64) - bits) | S.mix(total[whole]) >> bits)
    out[(line[1:][line[1:] == line[:-1]] >> (np.uint64(64) - bits)).astype(np.int64)] = True
    return out


def set_keys(hashes: np.ndarray, of: np.ndarray, loose: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, key, first, large): keys by which small sets of shingles meet if, and but for hashes only if, they are equal
    or one is the other without a shingle; first: the key of the whole set; large: items that need band keys, too.

    A text without a repeated overlap of two shingles holds a set of one shingle less only as its own begin or end, so
    for it two such keys do; ``loose`` items get one for each shingle."""
    least, big = small_sizes(threshold)
    n = len(loose)
    extra = loose[of]
    again, of_again = hashes[extra], of[extra]
    order = np.lexsort((again, of_again))
    again, of_again = again[order], of_again[order]
    fresh = np.ones(len(again), bool)
    fresh[1:] = (again[1:] != again[:-1]) | (of_again[1:] != of_again[:-1])
    hashes, of = np.concatenate([hashes[~extra], again[fresh]]), np.concatenate([of[~extra], of_again[fresh]])
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    stop = np.append(begin[1:], len(of)).astype(np.int64)
    own, size = of[begin], stop - begin
    large = np.zeros(n, bool)
    large[own[size >= big]] = True
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=total[1:])
    sums = total[stop] - total[begin]
    whole = size < big
    less = (size >= least) & (size <= big)
    plain, each = np.flatnonzero(less & ~loose[own]), np.flatnonzero(less & loose[own])
    lengths = size[each]
    place = np.repeat(begin[each] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    item = np.concatenate([own[whole], own[plain], own[plain], np.repeat(own[each], lengths)])
    key = np.concatenate([sums[whole], sums[plain] - hashes[begin[plain]], sums[plain] - hashes[stop[plain] - 1], np.repeat(sums[each], lengths) - hashes[place]])
    first = np.zeros(len(item), bool)
    first[: int(whole.sum())] = True
    return item, S.mix(key), first, large


def band_rows(texts: DataFrame, mode: str, width: int, bands: int, rows: int, min_words: int, bounds: tuple[np.ndarray, np.ndarray], thin: int = 1, small: float | None = None) -> DataFrame:
    """(band, node, range): all band keys of a node once for each partition that has it, and one of them again (once)
    where the partition has the node twice. range: how many of ``bounds``, ascending (band, node) pairs, are not above;
    one in ``thin`` pairs is given. ``small``: the threshold at which small sets get the keys of ``set_keys`` instead."""
    bound_keys, bound_nodes = bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}
        w = S.weights(rows + 1)
        for batch in batches:
            for at, n in S.slices(batch.column(0)):
                words, item, row, _ = items_of(batch.column(0).slice(at, n), mode)
                nodes = S.sequence_keys(words, item, len(row))
                hashes, of = S.shingles(words, item, len(row), width)
                keep = np.flatnonzero(np.bincount(item, minlength=len(row)) >= max(min_words, 1))
                state = np.zeros(len(row), np.int8)  # 1: new, 2: there for the second time
                for i, k in zip(keep.tolist(), nodes[keep].tolist(), strict=True):
                    was = seen.get(k)
                    if was is None:
                        seen[k] = False
                        state[i] = 1
                    elif not was:
                        seen[k] = True
                        state[i] = 2
                if len(seen) > REMEMBERED:
                    seen.clear()
                some = state[of] > 0
                hashes, of = hashes[some], of[some]
                fixed = fixed_of = np.empty(0, np.uint64)
                if small is not None:
                    fixed_of, fixed, lead, large = set_keys(hashes, of, repeating(words, item, len(row), width - 1), small)
                    some = lead | (state[fixed_of] == 1)
                    some &= (state[fixed_of] == 1) | ~large[fixed_of]
                    fixed_of, fixed = fixed_of[some], fixed[some]
                    some = large[of]
                    hashes, of = hashes[some], of[some]
                have, values = S.minhashes(hashes, of, bands * rows)
                folded = np.zeros((len(have), bands), np.uint64)
                for r in range(rows):
                    folded += values[:, r::rows] * w[r]
                folded = S.mix(folded + np.arange(bands, dtype=np.uint64) * w[rows])
                fresh = state[have] == 1
                key = np.concatenate([folded[fresh].reshape(-1), folded[~fresh, 0], fixed])
                node = np.concatenate([np.repeat(nodes[have[fresh]], bands), nodes[have[~fresh]], nodes[fixed_of.astype(np.int64)]]).view(np.int64)
                key = key.view(np.int64)
                if thin > 1:
                    some = S.mix((key ^ node).view(np.uint64)) % np.uint64(thin) == 0
                    key, node = key[some], node[some]
                at = np.searchsorted(bound_keys, key)
                for i in np.flatnonzero(np.isin(key, bound_keys)).tolist():  # hot keys are cut by node
                    lo, hi = at[i], np.searchsorted(bound_keys, key[i], side="right")
                    at[i] = lo + np.searchsorted(bound_nodes[lo:hi], node[i], side="right")
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(at.astype(np.int32))], names=["band", "node", "range"])

    return texts.mapInArrow(run, "band long, node long, range int")


def range_bounds(texts: DataFrame, n: int, **banding) -> tuple[np.ndarray, np.ndarray]:
    """(band, node) pairs that cut all pairs into ``n`` ranges of about equal size, from the pairs of some texts. They
    decide on the balance of the tasks only. Texts are picked by their hash, so that near copies are as frequent among
    them as among all; what reaches the driver grows with ``n``, not with the texts."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    every = max(1, texts.count() // max(200, 8 * n))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    thin = 1 if banding["mode"] == "text" else 8
    pairs = band_rows(some, bounds=none, thin=thin, **banding).select("band", "node").toPandas()
    if n < 2 or not len(pairs):
        return none
    pairs = pairs.sort_values(["band", "node"])
    at = (np.arange(1, n) * len(pairs)) // n
    return pairs["band"].to_numpy()[at], pairs["node"].to_numpy()[at]


def collisions(pairs: DataFrame) -> DataFrame:
    """pairs: (band, node, range). (kind, a, b), written. kind 0: node a shares a key with node b, in a run that a border cuts; 1: node b has key a, in
    a run with other nodes; 2: node a has several items."""
    spark = pairs.sparkSession
    dealt = pairs.repartitionById(parts(spark), "range").select("band", "node").sortWithinPartitions("band", "node")
    names = ["kind", "a", "b", "key", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, key, first, last, border = TaskContext.get().partitionId(), None, None, None, None

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=names)

        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            if border is None:
                border = int(keys[0]), int(nodes[0])
            fresh = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
            again = ~fresh
            again[1:] &= nodes[1:] == nodes[:-1]
            again[0] &= last is not None and int(nodes[0]) == last
            if again.any():
                twice = np.unique(nodes[again])
                yield out(2, twice, twice)
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
            lead = np.where(at < 0, first if first is not None else 0, nodes[np.maximum(at, 0)])
            cut = (keys == keys[0]) | (keys == keys[-1])
            star = cut & (lead != nodes) & ~again
            if star.any():
                yield out(0, nodes[star], lead[star])
            inner = np.flatnonzero(~cut & ~again)
            if len(inner):
                own = keys[inner]
                edge = np.concatenate([[True], own[1:] != own[:-1]])
                sizes = np.diff(np.append(np.flatnonzero(edge), len(own)))
                inner = inner[np.repeat(sizes > 1, sizes)]
                if len(inner):
                    yield out(1, keys[inner], nodes[inner])
            key, first, last = int(keys[-1]), int(lead[-1]), int(nodes[-1])
        if border is not None:
            # kind 3: the partition's first node and key; kind 4: the first node of its last run, and its key
            yield pa.RecordBatch.from_arrays([pa.array([3, 4], pa.int32()), pa.array([border[1], first]), pa.array([border[1], first]), pa.array([border[0], key]), pa.array([me, me], pa.int32())], names=names)

    held = materialize(dealt.mapInArrow(run, "kind int, a long, b long, key long, part int"), "collisions")
    edge = sorted(held.where("part IS NOT NULL").collect(), key=lambda r: (r["part"], r["kind"]))  # two rows for each partition
    links, lead = [], None
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if lead is not None and lead[0] == a["key"]:
            if lead[1] != a["a"]:
                links.append((0, a["a"], lead[1]))
            if b["key"] == a["key"]:
                continue  # the run goes on
        lead = b["key"], b["a"]
    found = held.where("part IS NULL").select("kind", "a", "b")
    found = found.unionByName(spark.createDataFrame(links, "kind int, a long, b long")) if links else found
    found._written = held._written
    return found


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal leading columns of sorted batches, one after the other."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        begin = np.flatnonzero(change).tolist() + [batch.num_rows]
        for a, b in zip(begin, begin[1:], strict=False):
            this = tuple(k[a] for k in keys)
            if now is not None and this != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = this
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that cut no run of equal leading columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for i in range(n_keys):
            k = batch.column(i).to_numpy(zero_copy_only=False)
            change[1:] |= k[1:] != k[:-1]
        begin = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = [batch.slice(begin)]
        elif held and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(n_keys)):
            held.append(batch)
        else:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (left before right) of places inside each of the runs that begin at ``starts``."""
    place = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    after = np.repeat(starts + sizes, sizes) - place - 1
    left = np.repeat(place, after)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)


def common_members(flat: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted distinct sets; set i is ``flat[offsets[i] : offsets[i + 1]]``."""
    sizes = np.diff(offsets)
    universe, place = np.unique(flat, return_inverse=True)
    line = np.repeat(np.arange(len(sizes)), sizes) * np.int64(len(universe)) + place  # ascending
    swap = sizes[left] > sizes[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    out = np.zeros(len(left), np.int64)
    ends = np.cumsum(sizes[left])
    at = 0
    while at < len(left):  # about PAIRS members at once
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        a, b = left[at:to], right[at:to]
        n = sizes[a]
        member = place[np.repeat(offsets[a] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        want = np.repeat(b, n) * np.int64(len(universe)) + member
        found = line[np.minimum(np.searchsorted(line, want), len(line) - 1)] == want
        out[at:to] = np.bincount(np.repeat(np.arange(to - at), n)[found], minlength=to - at)
        at = to
    return out


def intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted distinct arrays, by products of 0/1 blocks of columns."""
    universe, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    count = np.zeros(len(universe), np.int64)
    np.add.at(count, place, 1)
    common = np.cumsum(count > 1) - 1  # a column that one row has adds nothing
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    some = count[place] > 1
    row, place = row[some], common[place[some]]
    out = np.zeros((len(a), len(b)), np.float64)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    n = int(common[-1]) + 1 if len(common) else 0
    for at in range(0, n, columns):
        lo, hi = np.searchsorted(place, [at, at + columns])
        block = np.zeros((len(a) + len(b), min(columns, n - at)), np.float32)
        block[row[lo:hi], place[lo:hi] - at] = 1
        out += block[: len(a)] @ block[len(a) :].T
    return out.astype(np.int64)


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (left[i], right[i]) of sets have Jaccard similarity ``threshold`` or more."""
    sizes = np.array([len(s) for s in sets])
    both = np.zeros(len(left), np.int64)
    if len(left) <= 4 * len(sets):
        for i, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            both[i] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    else:
        a, b = np.unique(left), np.unique(right)
        grid = intersections([sets[i] for i in a.tolist()], [sets[i] for i in b.tolist()])
        both = grid[np.searchsorted(a, left), np.searchsorted(b, right)]
    union = sizes[left] + sizes[right] - both
    return (union > 0) & (both >= threshold * union - 1e-9)


def stars(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(item, first item of its component) for all items that are not the first, by union-find."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, r) for x in range(n) if (r := find(x)) != x]


#: Picks from pairs those to verify: (MinHash rows, left, right) -> mask.
Filter = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Pairs compared at once.
PAIRS = 1 << 20
#: Tiles of up to so many nodes are verified together, by about so many bytes of their shingles.
FEW, BLOCK = 64, 1 << 22


def forest(sigs: np.ndarray, starts: np.ndarray, prune: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): places of pairs whose components are those of all pairs inside a run that survive ``prune``.

    Each node is compared with the first of its run; only nodes that fail are compared with all others."""
    n = len(sigs)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    lead = starts[run]
    rest = np.flatnonzero(np.arange(n) != lead)
    good = prune(sigs, rest, lead[rest])
    left, right = [rest[good]], [lead[rest[good]]]
    lost = rest[~good]
    stops = np.append(starts[1:], n)
    failed, counts = np.unique(run[lost], return_counts=True)
    ends = np.cumsum(counts)
    for r, begin, end in zip(failed.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
        base = int(starts[r])
        size = int(stops[r]) - base
        if size < 3:
            continue  # two nodes, and they have been compared
        mine, others, own = lost[begin:end] - base, np.arange(1, size), sigs[base : base + size]
        step = max(1, PAIRS // size)
        for at in range(0, len(mine), step):
            a = mine[at : at + step]
            x, y = np.repeat(a, len(others)), np.tile(others, len(a))
            x, y = x[x != y], y[x != y]
            good = prune(own, x, y)
            tree = stars(size, x[good], y[good]) if good.any() else []
            left.append(np.array([i for i, _ in tree], np.int64) + base)
            right.append(np.array([i for _, i in tree], np.int64) + base)
    return np.concatenate(left), np.concatenate(right)


def surviving(met: DataFrame, ready: DataFrame, prune: Filter) -> DataFrame:
    """(src, dst): spanning forests of the pairs that share a key (a, b of ``met``) and survive ``prune``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> pa.RecordBatch:
            keys, nodes = t.column(0).to_numpy(), t.column(1).to_numpy()
            sigs = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint16).reshape(len(nodes), -1)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            left, right = forest(sigs, starts, prune)
            pairs = np.unique(np.stack([nodes[left], nodes[right]]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            begin = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if begin == 0 and held and held[-1].column(0)[-1].as_py() == keys[0]:
                held.append(batch)
                continue
            held.append(batch.slice(0, begin))
            if any(x.num_rows for x in held):
                yield out(pa.Table.from_batches(held))
            held = [batch.slice(begin)]
        if held:
            yield out(pa.Table.from_batches(held))

    rows = met.join(ready.select("node", "sig").hint("merge"), met["b"] == F.col("node")).select("a", "node", "sig")
    dealt = rows.repartition(parts(met.sparkSession), "a").sortWithinPartitions("a")
    return dealt.mapInArrow(run, "src long, dst long")


def tiled(members: DataFrame, group: str, node: str, size: str, chunk: int) -> DataFrame:
    """Adds ``lo, hi, mine``: each row once for each tile (pair of chunks of its group) that its chunk ``mine`` is in."""
    chunks = F.ceil(F.col(size) / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(node)), chunks.cast("long")).cast("int")
    out = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return out.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}).drop("other")


def prepared(held: DataFrame, mode: str, width: int, sketch: int) -> DataFrame:
    """held: (text, wants). (node, copies, sig, grams): MinHash values and sorted shingles of the items that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in S.slices(batch.column(0)):
                lists = batch.column(1).slice(at, n)
                wants = lists.flatten()
                node, copies, number = (wants.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                words, item, row, _ = items_of(batch.column(0).slice(at, n), mode)
                nodes = S.sequence_keys(words, item, len(row))
                of_row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                first = np.searchsorted(row, np.arange(n + 1))
                place = first[of_row] + number
                ok = place < first[of_row + 1]
                ok[ok] = nodes[place[ok]] == node[ok].view(np.uint64)  # bodies may collide: only the text meant counts
                node, copies, place = node[ok], copies[ok], place[ok]
                hashes, of = S.shingles(words, item, len(row), width)
                begin, stop = np.searchsorted(of, place), np.searchsorted(of, place, side="right")
                picked = np.zeros(len(row) + 1, bool)
                picked[place] = True
                some = picked[of]
                have, values = S.minhashes(hashes[some], of[some], sketch, seed=2)
                small = values.astype(np.uint16)
                sigs = [small[i].tobytes() for i in np.searchsorted(have, place).tolist()]
                sets = [np.unique(hashes[x:y]).tobytes() for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(copies, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["node", "copies", "sig", "grams"])

    return held.mapInArrow(run, "node long, copies long, sig binary, grams binary")


def verify(members: DataFrame, threshold: float, prune: Filter, chunk: int = 256) -> DataFrame:
    """members: (grp, size, node, copies, sig, grams). Rows (kind, a, b): kind 0, node a has b linked items in this tile;
    kind 1, the tile's links lead from a to b, the smallest node of that component."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 3):
            t = t.combine_chunks()
            grp, lo, hi, node = (t.column(i).to_numpy() for i in range(4))
            tile = np.cumsum(np.concatenate([[False], (grp[1:] != grp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            order = np.lexsort((node, tile))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(tile[order]) != 0) | (np.diff(node[order]) != 0)
            order = order[fresh]
            t, tile, few = t.take(pa.array(order)), tile[order], lo[order] == hi[order]
            starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            sizes = np.diff(np.append(starts, len(tile)))
            few = few[starts] & (sizes <= FEW)
            for k in np.flatnonzero(~few).tolist():
                yield from one(t.slice(int(starts[k]), int(sizes[k])))
            rows = np.repeat(few & (sizes > 1), sizes)
            if not rows.any():
                continue
            t, tile = t.filter(pa.array(rows)), tile[rows]
            starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            held = np.append(0, np.cumsum(pc.binary_length(t.column("grams")).to_numpy()))
            block = held[starts] // BLOCK
            for first in np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist():
                own = starts[first : first + int(np.searchsorted(block[first:], block[first], side="right"))]
                stop = int(starts[first + len(own)]) if first + len(own) < len(starts) else len(tile)
                yield from many(t.slice(int(own[0]), stop - int(own[0])), own - own[0])

    def joined(t: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        nodes, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        count = np.bincount(left, copies[right], len(nodes)) + np.bincount(right, copies[left], len(nodes))
        some = np.flatnonzero(count)
        tree = stars(len(nodes), left, right)
        return pa.RecordBatch.from_arrays(
            [pa.array([0] * len(some) + [1] * len(tree), pa.int32()), pa.array(np.concatenate([nodes[some], nodes[[x for x, _ in tree]]]).astype(np.int64)), pa.array(np.concatenate([count[some].astype(np.int64), nodes[[y for _, y in tree]]]).astype(np.int64))],
            names=["kind", "a", "b"],
        )

    def alive(t: pa.Table, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right]) - 1e-9 if len(left) else np.zeros(0, bool)
        left, right = left[near], right[near]
        if len(left):
            sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(sizes), -1)
            good = prune(sigs, left, right)
            left, right = left[good], right[good]
        return left, right

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, hi, mine = t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), t.column("mine").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        if lo == hi:
            left, right = np.triu_indices(len(sets), 1)
        else:
            a, b = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
            left, right = np.repeat(a, len(b)), np.tile(b, len(a))
        left, right = alive(t, np.array([len(s) for s in sets]), left, right)
        if len(left):
            good = exact_links(sets, left, right, threshold)
            yield joined(t, left[good], right[good])

    def many(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Tiles of few nodes, which begin at ``starts``."""
        sets = t.column("grams").to_pylist()
        offsets = np.append(0, np.cumsum([len(x) // 8 for x in sets]))
        sizes = np.diff(offsets)
        left, right = alive(t, sizes, *pairs_within(starts, np.diff(np.append(starts, len(sets)))))
        if len(left):
            both = common_members(np.frombuffer(b"".join(sets), np.uint64), offsets, left, right)
            union = sizes[left] + sizes[right] - both
            good = (union > 0) & (both >= threshold * union - 1e-9)
            yield joined(t, left[good], right[good])

    tiles = tiled(members, "grp", "node", "size", chunk).select("grp", "lo", "hi", "node", "mine", "copies", "sig", "grams")
    dealt = tiles.repartition(parts(members.sparkSession), "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    return dealt.mapInArrow(link, "kind int, a long, b long")


def near_classes(docs: DataFrame, *, mode: str, width: int, threshold: float, bands: int, rows: int, min_words: int, sketch: int, prune: Filter) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: (key, body, text). (items, mine, nodes). items: (key, body, item, node), for every item; nodes: (node, copies,
    rep, n_links, cls), for the nodes that have several items or share a band key with others; mine: their items.

    n_links: items of *other* nodes linked with the node; cls: the smallest node of its component; rep: the first
    (key, body, item), rows without a key after all others."""
    items = materialize(items_table(docs, mode, min_words), "items")
    texts, banding = docs.select("text").where("text IS NOT NULL"), {"mode": mode, "width": width, "bands": bands, "rows": rows, "min_words": min_words, "small": None if mode == "text" else threshold}
    met = collisions(band_rows(texts, bounds=range_bounds(texts, parts(docs.sparkSession), **banding), **banding))
    some = materialize(met.select(F.explode(F.array(F.when(F.col("kind") != 1, F.col("a")), F.col("b"))).alias("node")).where("node IS NOT NULL").distinct(), "some")
    at = F.struct("key", "body", "item")
    mine = materialize(items.join(some.hint("merge"), "node", "left_semi"), "mine")
    nodes = materialize(mine.groupBy("node").agg(F.count("*").alias("copies"), F.coalesce(F.min(F.when(F.col("key").isNotNull(), at)), F.min(at)).alias("rep")), "nodes")
    linked = met.where("kind <> 2").select(F.explode(F.array(F.when(F.col("kind") == 0, F.col("a")), F.col("b"))).alias("node")).where("node IS NOT NULL").distinct()
    chosen = nodes.join(linked.hint("merge"), "node", "left_semi").groupBy(F.col("rep.key").alias("rep_key"), F.col("rep.body").alias("rep_body"))
    chosen = materialize(chosen.agg(F.collect_list(F.struct("node", "copies", F.col("rep.item").alias("item"))).alias("wants")), "wants")  # at most the items of one text
    one = docs.select("key", "body", "text").where("text IS NOT NULL")
    held = chosen.hint("merge").join(one, F.col("rep_key").eqNullSafe(F.col("key")) & (F.col("rep_body") == F.col("body"))).select("text", "wants")
    ready = materialize(prepared(held, mode, width, sketch), "ready")
    edges = materialize(surviving(met.where("kind = 1").select("a", "b"), ready, prune).unionByName(met.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct(), "edges")
    joined = connected_components(edges)
    groups = materialize(joined.select("node", F.col("component").alias("grp")), "groups")
    sizes = materialize(groups.groupBy("grp").agg(F.count("*").alias("size")), "sizes")
    members = groups.join(sizes, "grp").join(ready, "node").select("grp", "size", "node", "copies", "sig", "grams")
    out = materialize(verify(members, threshold, prune), "links")
    discard(met, some, chosen, ready, edges, joined, groups, sizes)
    counts = out.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n_links"))
    comps = connected_components(out.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    full = nodes.join(counts, "node", "left").join(comps, "node", "left")
    full = full.select("node", "copies", "rep", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "node").alias("cls"))
    classes = materialize(full, "classes")
    discard(out, comps, nodes)
    return items, mine, classes


def pruner(threshold: float, sketch: int, tolerance: float) -> Filter:
    """Drops a pair as soon as the posterior of reaching ``threshold`` is below ``tolerance``; values are compared 16 at a time."""
    bounds = [(n, least_matches(n, threshold, tolerance)) for n in range(STEP, sketch + 1, STEP)]

    def prune(sigs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        alive = np.arange(len(left))
        matches = np.zeros(len(left), np.int32)
        for n, least in bounds:
            for k in range(n - STEP, n):
                column = np.ascontiguousarray(sigs[:, k])
                matches += column[left[alive]] == column[right[alive]]
            ok = matches >= least
            alive, matches = alive[ok], matches[ok]
            if not len(alive):
                break
        mask = np.zeros(len(left), bool)
        mask[alive] = True
        return mask

    return prune


STEP = 16


def least_matches(seen: int, threshold: float, tolerance: float) -> int:
    """The fewest matches of ``seen`` values at which the posterior P(similarity >= threshold) reaches ``tolerance``.

    With a uniform prior the posterior is Beta(m + 1, seen - m + 1), whose upper tail at t is P(Bin(seen + 1, t) <= m).
    """
    total = 0.0
    for m in range(seen + 2):
        total += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= tolerance:
            return m
    return seen
