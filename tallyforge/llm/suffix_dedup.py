"""Removal of byte strings that an earlier document holds, by suffix sorting of the passages that documents share.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller doc_id.

1. Each window of ``length`` bytes has a *mark*: the smallest hash among its short substrings. Equal windows have equal
   marks, so two documents can share a window only if they share its mark. Consecutive windows with the same mark are
   one run; marks go, packed by bucket, to where it shows which of them several texts have.
2. The runs with such marks are cut out as pieces (the run's windows and the bytes they reach over) and meet by mark.
   Of equal pieces only the smallest document's stays; in the others the whole run goes. Pieces of a mark that very
   many texts have are first dealt by their own hash too, which settles equal ones; the distinct ones that are left are
   cut into runs of windows whose hashes fall into the same part, and dealt by mark and part.
3. Windows of the distinct pieces whose hash no second document has are cut off, equal ranges of the rest are treated
   like equal pieces, and the cut is repeated on the distinct ranges. What is left is concatenated and suffix-sorted by
   grouping: ``suffix_array`` groups suffixes by Lyndon prefix from the highest group down, finding for each suffix the
   previous smaller one by pointers, and then reads the order off the groups without renaming anything. Neighbours in
   the order that agree on ``length`` bytes are one window, and the smallest document among them keeps it.

Marks and hashes only choose what is sorted; they lose no window, since they depend on the window's bytes alone.

Defined cases: null texts count as empty; texts shorter than ``length`` lose nothing; of equal texts the smallest
doc_id keeps its bytes and the others lose all; repeated rows (same id and text) are treated alike; rows with a null
doc_id take no part and keep all. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts
from .lsh import grouped
from .shingling import buffers, mix, powers, slices, weights

GRAM = 20
#: Bytes of pieces that are settled at once, unless a single mark has more.
BLOCK = 1 << 18
#: Pieces of one mark that a task gets; marks with more are dealt over several parts.
HOT = 10_000
#: Bytes of text that are marked at once.
SLICE = 1 << 18


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes of ``text`` (small non-negative numbers), in two linear passes."""
    n = len(text)
    if n < 2:
        return list(range(n))
    sigma = max(text) + 2
    heads = [0] * (sigma + 1)
    for c in text:
        heads[c + 1] += 1
    for c in range(sigma):
        heads[c + 1] += heads[c]
    start = [heads[c] for c in text]  # the first place of each suffix's group names the group
    fill = heads[:]
    members, place = [0] * n, [0] * n
    for i, c in enumerate(text):
        place[i] = fill[c]
        members[fill[c]] = i
        fill[c] += 1
    size = [0] * n
    for c in range(sigma):
        if heads[c + 1] > heads[c]:
            size[heads[c]] = heads[c + 1] - heads[c]
    before = [-1] * n
    end = n
    while end > 0:
        head = start[members[end - 1]]
        group = sorted(members[head:end])
        # the nearest smaller suffix to the left; members of the group and of higher ones are jumped over
        counts: dict[int, int] = {}
        for i in group:
            p = i - 1
            while p >= 0 and start[p] >= head:
                p = before[p]
            before[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in counts.items():
            by_count.setdefault(k, []).append(p)
        # those before most members of the group come last in their own group: split them off its end, step by step
        for k in sorted(by_count, reverse=True):
            touched: dict[int, list[int]] = {}
            for p in by_count[k]:
                touched.setdefault(start[p], []).append(p)
            for s, moved in touched.items():
                whole = size[s]
                if len(moved) == whole:
                    continue
                cut = s + whole - len(moved)
                at = cut
                for p in moved:
                    q, o = place[p], members[at]
                    members[q], members[at] = o, p
                    place[o], place[p] = q, at
                    start[p] = cut
                    at += 1
                size[s], size[cut] = whole - len(moved), len(moved)
        end = head
    order = [-1] * n
    put = list(range(n))  # next free place of each group
    done = bytearray(n)

    def emit(j: int) -> None:
        while j >= 0 and not done[j]:
            s = start[j]
            order[put[s]] = j
            put[s] += 1
            done[j] = 1
            j = before[j]

    emit(n - 1)
    for i in range(n):
        j = order[i] - 1
        if j >= 0:
            emit(j)
    return order


def window_marks(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one mark: (mark, row, first window's start, number of windows)."""
    n = len(raw)
    none = np.empty(0, np.int64)
    if n < length:
        return np.empty(0, np.uint64), none, none, none
    eight = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))  # the bytes from each place on
    m = n - GRAM + 1
    code = np.zeros(m, np.uint64)
    for k, w in zip([*range(0, GRAM - 8, 8), GRAM - 8], weights(-(-GRAM // 8)), strict=True):
        code += eight[k : k + m] * w
    code = mix(code) >> np.uint64(16)
    span = length - GRAM + 1
    padded = np.full(-(-len(code) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(code)] = code
    ahead = np.minimum.accumulate(padded.reshape(-1, span), axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded.reshape(-1, span)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - length + 1
    low = np.minimum(behind[:m], ahead[span - 1 : span - 1 + m])
    inside = np.ones(m, bool)
    for end in offsets[1:].tolist():
        inside[max(end - length + 1, 0) : end] = False
    fresh = inside.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    breaks = np.flatnonzero(fresh | ~inside)
    starts = np.flatnonzero(inside[breaks])
    begin = breaks[starts]
    return low[begin], np.searchsorted(offsets, begin, side="right") - 1, begin, np.append(breaks, m)[starts + 1] - begin


def text_key(text: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little", signed=True)


def shared_marks(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(key, mark, split) of the texts, by their key, for marks that several texts have, with the parts a mark is dealt over."""
    buckets = parts(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            marks, keys = [], []
            for at, n in slices(batch.column(0), SLICE):
                part = batch.column(0).slice(at, n)
                names = np.array([text_key(x) for x in part.to_pylist()], np.int64)
                found, rows, _, _ = window_marks(*buffers(part), length)
                fresh = np.array([k not in seen for k in names.tolist()])
                seen.update(names.tolist())
                some = fresh[rows] if len(rows) else np.zeros(0, bool)
                marks.append(found[some])
                keys.append(names[rows[some]])
            if len(seen) > 500_000:
                seen.clear()
            mark, key = np.concatenate(marks or [np.empty(0, np.uint64)]), np.concatenate(keys or [np.empty(0, np.int64)])
            names, short = np.unique(key, return_inverse=True)  # 4 bytes for each mark instead of the text's 8
            bucket = (mark % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                some = order[cut[b] : cut[b + 1]]
                if len(some):
                    used, local = np.unique(short[some], return_inverse=True)
                    six = mark[some].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]  # marks have 48 bits
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([six.tobytes()], pa.binary()), pa.array([local.astype("<u4").tobytes()], pa.binary()), pa.array([names[used].tobytes()], pa.binary())], names=["bucket", "marks", "local", "names"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, 1):
            marks, keys = [], []
            for six, local, names in zip(t.column("marks").to_pylist(), t.column("local").to_pylist(), t.column("names").to_pylist(), strict=True):
                full = np.zeros((len(six) // 6, 8), np.uint8)
                full[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
                marks.append(full.view("<u8").reshape(-1))
                keys.append(np.frombuffer(names, np.int64)[np.frombuffer(local, "<u4")])
            mark, key = np.concatenate(marks), np.concatenate(keys)
            order = np.argsort(mark, kind="stable")
            mark, key = mark[order], key[order]
            begin = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            several = np.minimum.reduceat(key, begin) != np.maximum.reduceat(key, begin)
            many = np.diff(np.append(begin, len(mark)))  # all of a mark's, since they meet in one bucket
            keep, split = np.repeat(several, many), np.repeat(1 + many // hot, many)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(mark[keep].astype(np.int64)), pa.array(split[keep].astype(np.int32))], names=["key", "mark", "split"])

    sent = docs.select("text").mapInArrow(send, "bucket int, marks binary, local binary, names binary")
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key long, mark long, split int").distinct()


def window_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=prefix[1:])
    return mix((prefix[at + length] - prefix[at]) * powers(len(raw) + 1, inverse=True)[at])


def runs_of_parts(piece: bytes, length: int, split: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, start, bytes) of the runs of windows of a piece whose hashes fall into one part."""
    part = window_hashes(np.frombuffer(piece, np.uint8), np.arange(len(piece) - length + 1), length) % np.uint64(split)
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(part)).tolist(), strict=True):
        yield int(part[a]), a, piece[a : b + length - 1]


def contested(pieces: list[bytes], owners: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window's start in it, number of windows) of the maximal runs of windows whose hash several owners have."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    piece = np.repeat(np.arange(len(pieces)), sizes)
    m = len(raw) - length + 1
    at = np.flatnonzero(piece[:m] == piece[length - 1 :])
    code = window_hashes(raw, at, length)
    of = piece[at]
    order = np.argsort(code)
    own = np.array(owners, np.int64)[of[order]]
    begin = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
    several = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)
    keep = np.zeros(len(at), bool)
    keep[order] = np.repeat(several, np.diff(np.append(begin, len(at))))
    at, of = at[keep], of[keep]
    if not len(at):
        return of, at, at
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])]))
    return of[first], at[first] - offsets[of[first]], np.diff(np.append(first, len(at)))


def in_order(pieces: list[bytes], owners: list[int], length: int) -> Iterator[tuple[int, int]]:
    """(piece, start in it) of the windows that also start in a piece of a smaller owner, by suffix sorting."""
    text: list[int] = []
    origin: list[int] = []
    limit: list[int] = []
    for p, piece in enumerate(pieces):
        base = len(text)
        text += [b + 1 for b in piece]
        text.append(0)
        origin.append(base)
        limit.append(base + len(piece) - length)
    joined = b"\n".join(pieces)  # places as in text
    of = np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in pieces]).tolist()
    held: list[int] = []
    last = None

    def close() -> Iterator[tuple[int, int]]:
        if len(held) > 1:
            least = min(owners[of[i]] for i in held)
            yield from ((of[i], i - origin[of[i]]) for i in held if owners[of[i]] > least)

    for i in suffix_array(text):
        if i > limit[of[i]]:
            continue
        window = joined[i : i + length]
        if window != last:
            yield from close()
            held, last = [], window
        held.append(i)
    yield from close()


def resolve(marks: list[tuple[int, int]], pieces: list[bytes], owners: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(piece, first window's start in it, number of windows) of windows that also start in a piece of a smaller owner.

    Windows that no second owner can have are cut off first, by their hashes. Of equal ranges among the rest the
    smallest owner's stays for the suffix sort; in the others all windows go, as with equal pieces."""
    at: dict[tuple[tuple[int, int], bytes], list[tuple[int, int]]] = {}
    for p, a, c in zip(*(x.tolist() for x in contested(pieces, owners, length)), strict=True):
        at.setdefault((marks[p], pieces[p][a : a + c + length - 1]), []).append((p, a))
    tally: dict[tuple[int, int], int] = {}
    ranges: list[tuple[tuple[int, int], bytes, int, list[tuple[int, int]]]] = []
    for (mark, body), places in at.items():
        least = min(owners[p] for p, _ in places)
        tally[mark] = tally.get(mark, 0) + 1
        ranges.append((mark, body, least, [x for x in places if owners[x[0]] == least]))
        yield from ((p, a, len(body) - length + 1) for p, a in places if owners[p] > least)
    ranges = [r for r in ranges if tally[r[0]] > 1]
    if not ranges:
        return
    # a range whose windows no other range has is settled; what is left of the others goes into the suffix sort
    rest = [(r, a, ranges[r][1][a : a + c + length - 1]) for r, a, c in zip(*(x.tolist() for x in contested([x[1] for x in ranges], [x[2] for x in ranges], length)), strict=True)]
    for k, i in in_order([x[2] for x in rest], [ranges[x[0]][2] for x in rest], length):
        r, begin, _ = rest[k]
        yield from ((p, a + begin + i, 1) for p, a in ranges[r][3])


#: Columns of pieces as they are dealt, and of what settling them gives.
SENT = ["mark", "part", "piece", "doc_id", "start", "split"]
TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
KEPT = {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "mark": pa.int64(), "piece": pa.binary(), "split": pa.int32()}


def repeated_ranges(docs: DataFrame, length: int = 50, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, start, end): byte ranges that go, of the documents that are the first of their text; and these documents."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_key(x) for x in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "key"])

    keyed = docs.select("doc_id", "text").mapInArrow(name, "doc_id long, key long")
    first = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "firsts")
    marks = materialize(shared_marks(docs, length, hot), "marks")
    wanted = marks.groupBy("key").agg(F.collect_list(F.struct("mark", "split")).alias("marks")).join(first, "key").select(F.col("doc_id").alias("id_"), "key", "marks")
    wanted = materialize(wanted, "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1), SLICE):
                part = batch.slice(at, n)
                raw, offsets = buffers(part.column(1))
                marks, rows, starts, count = window_marks(raw, offsets, length)
                names = np.array([text_key(x) for x in part.column(1).to_pylist()], np.int64)
                lists = part.column(3)
                own = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                values, splits = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
                wanted_ = mix(values.astype(np.uint64)) + own.astype(np.uint64)
                order = np.argsort(wanted_)
                asked = mix(marks) + rows.astype(np.uint64)
                found = order[np.minimum(np.searchsorted(wanted_, asked, sorter=order), len(order) - 1)] if len(order) else np.zeros(len(asked), np.int64)
                right = names == part.column(2).to_numpy()
                keep = (wanted_[found] == asked) & right[rows] if len(rows) and len(order) else np.zeros(len(rows), bool)
                split = splits[found[keep]]
                at_, rows_, count_ = starts[keep], rows[keep], count[keep]
                body = raw.tobytes()
                pieces = [body[a : a + c + length - 1] for a, c in zip(at_.tolist(), count_.tolist(), strict=True)]
                dealt_to = [0 if k == 1 else zlib.crc32(x) % k for x, k in zip(pieces, split.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(marks[keep].astype(np.int64)), pa.array(dealt_to, pa.int32()), pa.array(pieces, pa.binary()), part.column(0).take(pa.array(rows_)), pa.array(at_ - offsets[rows_]), pa.array(split, pa.int32())], names=SENT)

    source = docs.select("doc_id", "text")
    held = source.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id_"))).select("doc_id", "text", "key", "marks")
    def deal(pieces: DataFrame) -> DataFrame:
        return pieces.repartition(parts(docs.sparkSession), "mark", "part").sortWithinPartitions("mark", "part", "piece", "doc_id", "start")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for mark, piece, doc, start, split in zip(*(batch.column(k).slice(at, 1000).to_pylist() for k in range(5)), strict=True):
                    # a piece has up to length - GRAM + 1 windows, so that many times the parts keep a part's size
                    rows += [(mark, part, x, doc, start + a, 1) for part, a, x in runs_of_parts(piece, length, split * (length - GRAM + 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=SENT)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges that go; and, with their mark and bytes, the distinct pieces of marks that are dealt over parts."""
        block: list[tuple[tuple[int, int], bytes, int, int]] = []  # mark and part, piece, doc, start: the first of each distinct piece
        out: list[tuple] = []
        mark = piece = owner = None
        bytes_held = 0

        def put(doc: int, a: int, b: int) -> None:
            out.append((doc, a, b, None, None, None))

        def flush() -> None:
            nonlocal bytes_held
            if len(block) > 1:
                gone: dict[int, list[tuple[int, int]]] = {}
                for p, i, n in resolve([r[0] for r in block], [r[1] for r in block], [r[2] for r in block], length):
                    gone.setdefault(p, []).append((i, i + n))
                for p, runs in gone.items():
                    runs.sort()
                    a, b = runs[0]
                    for i, j in runs[1:]:
                        if i > b:
                            put(block[p][2], block[p][3] + a, block[p][3] + b + length - 1)
                            a, b = i, j
                        b = max(b, j)
                    put(block[p][2], block[p][3] + a, block[p][3] + b + length - 1)
            block.clear()
            bytes_held = 0

        def rows() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else [()] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KEPT.values(), strict=True)], names=list(KEPT))
            out.clear()
            return batch

        for batch in batches:
            for m, part, p, doc, start, split in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (m, part) == mark and p == piece and doc != owner:
                    put(doc, start, start + len(p))
                    continue
                if (m, part) != mark and bytes_held > BLOCK:
                    flush()
                if (m, part) != mark or p != piece:
                    mark, piece, owner = (m, part), p, doc
                if split > 1:
                    out.append((doc, start, None, m, p, split))
                else:  # once more where it is again in the same document
                    block.append((mark, p, doc, start))
                    bytes_held += len(p) + 1
            yield rows()
        flush()
        yield rows()

    schema = "mark long, part int, piece binary, doc_id long, start long, split int"
    told = "doc_id long, start long, end long, mark long, piece binary, split int"
    first_told = materialize(deal(held.mapInArrow(cut, schema)).mapInArrow(settle, told), "settled")
    left = first_told.where("piece IS NOT NULL").select("mark", "piece", "doc_id", "start", "split")
    rest = deal(left.mapInArrow(spread, schema)).mapInArrow(settle, told)
    ranges = first_told.where("piece IS NULL").unionByName(rest).select("doc_id", "start", "end")
    return ranges, first


def remove_repeated_bytes(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges, first = repeated_ranges(docs.where("doc_id IS NOT NULL"), length, hot)
    per_doc = ranges.groupBy(F.col("doc_id").alias("id_")).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    firsts = first.select(F.col("doc_id").alias("id_"), "key").groupBy("id_").agg(F.collect_set("key").alias("keys"))
    told = materialize(firsts.join(per_doc.withColumnRenamed("id_", "range_id"), F.col("id_").eqNullSafe(F.col("range_id")), "left").select("id_", "keys", "ranges"), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            held = batch.column(3).fill_null([])
            at = held.offsets.to_pylist()
            begin, stop = (held.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for doc, text, keys, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(3)), at, at[1:], strict=False):
                raw = (text or "").encode()
                spans: list[list[int]] = []
                if doc is None:
                    pass
                elif text_key(text) not in (keys or ()):
                    spans = [[0, len(raw)]] if len(raw) >= length else []
                else:
                    for a, b in sorted(zip(begin[lo:hi].tolist(), stop[lo:hi].tolist(), strict=True)):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = docs.join(told.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id_")), "left").select("doc_id", "text", "keys", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: The same in DuckDB, for ids that are not repeated: bytes as pairs of hexadecimal digits, and the covered ones as runs.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, j, substr(h, 2000 * j + 1, 2098) AS p FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 950) // 1000)) AS j FROM d)),
w AS (SELECT doc_id, 1000 * j + i AS i, hash(substr(p, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, j, p, unnest(range(0, least(1000, len(p) // 2 - 49))) AS i FROM p)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
hit AS (SELECT w.doc_id, i FROM w JOIN f USING (k) WHERE w.doc_id > f.first),
edge AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM edge),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM span GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(h) // 2 AS n, coalesce(len(a), 0) AS spans, CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda j: substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * b[j] + 1 END, CASE WHEN j = len(a) THEN len(h) ELSE 2 * (a[j + 1] - CASE WHEN j = 0 THEN 0 ELSE b[j] END) END)), '') END AS k FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - len(k) // 2 AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept
"""
