"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

From the merge list follows how many symbols to the right can still change a token: the *sufficient lookahead*. The
transducer holds a window of symbols that starts at a token border, merges it, emits the tokens that end at least that
many symbols before the window's end, and slides on. Memory is constant however long a piece is.

Decoding goes the other way: ids are fed to a state machine that holds no more than the bytes of an unfinished
character. ``decoded_sha256`` is the hash of what it gives for the document's ids.

Defined cases: null texts count as empty and have no tokens; ids that are not in the vocabulary decode to nothing; each
of several repeated rows gives a row of its own; rows with a null key are encoded like others; an empty table gives an
empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode defines it.
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Texts without these behave alike under ``re`` and under the full Unicode classes.
_SPECIAL = re.compile(r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeİŉƀ-\U0010ffff]")
_CONTROL = re.compile(r"[\x1c-\x1f]")
_LATIN_PIECE = re.compile(r"[a-z\xdf-\xf6\xf8-ſ\xaa\xb5\xba]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|(?:[^\s\w]|_)+")


#: Pieces of up to ``LONGEST`` characters that a worker remembers; then it starts anew.
REMEMBERED = 700_000
LONGEST = 64
#: Pieces encoded, hashed and decoded at once.
BLOCK = 4096


@functools.cache
def unsure() -> str:
    """Characters that Python's Unicode does not have. The tokenizers library knows some of them, ``regex`` more."""
    return "".join(c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")


@functools.cache
def late_lower() -> dict[int, str]:
    """Letters whose lower case the library knows and Python does not."""
    import tokenizers

    some = regex.findall(r"\p{L}", unsure())
    low = tokenizers.normalizers.Lowercase().normalize_str(" ".join(some)).split(" ")
    return {ord(a): b for a, b in zip(some, low, strict=True) if a != b}


@functools.cache
def has_late() -> re.Pattern:
    return re.compile(f"[{''.join(map(chr, late_lower()))}]" if late_lower() else "(?!)")


@functools.cache
def piece_pattern() -> regex.Pattern:
    """Letters and numbers as the tokenizers library knows them: it is asked about those that Python does not have."""
    import tokenizers

    def late(kind: str) -> str:
        some = regex.findall(rf"\p{{{kind}}}", unsure())
        cut = tokenizers.pre_tokenizers.Split(tokenizers.Regex(rf"\p{{{kind}}}"), "isolated").pre_tokenize_str(" ".join(some))
        known = {piece for piece, _ in cut if len(piece) == 1}
        points = [ord(c) for c in some if c not in known]
        edges = [i for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
        return "".join(f"{chr(points[a])}-{chr(points[b - 1])}" for a, b in zip(edges, [*edges[1:], len(points)], strict=True))

    letters, numbers = late("L"), late("N")
    letter = rf"[\p{{L}}--[{letters}]]" if letters else r"\p{L}"
    number = rf"[\p{{N}}--[{numbers}]]" if numbers else r"\p{N}"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{SPACE}{letter}{number}]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """Symbols to the right of a token that can change it, over all texts.

    A merge can be pre-empted from the right only by an earlier merge whose left part is a token on the right spine of
    what is being merged. So the reach of a merge follows from the reaches of earlier ones, taken in order of rank.
    """
    makers: dict[str, list[int]] = defaultdict(list)
    reach: list[int] = []
    token_reach: dict[str, int] = defaultdict(int)
    by_left: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    most = 0

    def blockers(token: str, rank: int) -> int:
        ranks, best = by_left[token] if token in by_left else ((), ())
        at = bisect_left(ranks, rank)
        return best[at - 1] if at else 0

    def along_spine(token: str, rank: int) -> int:
        worst, todo, done = 0, [(token, rank)], set()
        while todo:
            t, r = todo.pop()
            if (t, r) in done:
                continue
            done.add((t, r))
            worst = max(worst, blockers(t, r))
            todo += [(merges[m][1], m) for m in makers.get(t, ())]
        return worst

    for rank, (x, y) in enumerate(merges):
        far = max(along_spine(y, rank), token_reach[y])
        reach.append(far)
        whole = x + y
        makers[whole].append(rank)
        token_reach[whole] = max(token_reach[whole], far)
        need = length(y) + max(far, token_reach[y])
        most = max(most, need, far)
        ranks, best = by_left[x]
        ranks.append(rank)
        best.append(max(need, best[-1] if best else 0))
    return most


class Codec:
    """Encoder and decoder of one vocabulary. ``suffix`` marks the last symbol of a piece."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "", lookahead: int | None = None, special: dict[str, int] | None = None):
        self.vocab, self.suffix, self.special = vocab, suffix, special or {}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        ids = {}
        for rank, (a, b) in enumerate(merges):
            ids.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.ranks = ids
        self.lookahead = sufficient_lookahead(merges, self.symbols_in) if lookahead is None else lookahead
        self.window = 4 * self.lookahead + 64
        self.alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.raw: dict[bool, dict[int, bytes]] = {}

    @classmethod
    def from_json(cls, text: str, lookahead: int | None = None) -> Codec:
        spec = json.loads(text)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, model.get("end_of_word_suffix") or "", lookahead, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})

    def symbols_in(self, token: str) -> int:
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) else len(token)

    def merge(self, ids: list[int]) -> list[int]:
        ranks = self.ranks
        while len(ids) > 1:
            best, new, pair = None, 0, None
            for p in zip(ids, ids[1:], strict=False):
                hit = ranks.get(p)
                if hit is not None and (best is None or hit[0] < best):
                    best, new = hit
                    pair = p
            if best is None:
                break
            out, i, n = [], 0, len(ids)
            a, b = pair
            while i < n:
                if i + 1 < n and ids[i] == a and ids[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def transduce(self, symbols: Iterable[str]) -> Iterator[int]:
        """Token ids of one piece, given its symbols one by one; each id leaves as soon as it is stable."""
        held: list[int] = []
        last = None
        for s in symbols:
            if last is not None and last in self.vocab:
                held.append(self.vocab[last])
            last = s
            if len(held) >= self.window:
                done, settled = 0, []
                for t in self.merge(held):
                    n = self.symbols_in(self.tokens[t])
                    if done + n + self.lookahead > len(held):
                        break
                    settled.append(t)
                    done += n
                yield from settled
                held = held[done:]
        if last is not None and last + self.suffix in self.vocab:
            held.append(self.vocab[last + self.suffix])
        yield from self.merge(held)

    def pieces(self, text: str) -> list[str]:
        """Lower-cased NFC pieces of a text without special tokens."""
        if text.isascii() and not _CONTROL.search(text) or not _SPECIAL.search(text):
            return _LATIN_PIECE.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        if has_late().search(text):
            text = text.translate(late_lower())
        return piece_pattern().findall(text)

    def segments(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut is not None and "<|" in text else [text]

    def learn(self, piece: str) -> tuple[str, tuple[int, ...]]:
        """The ids of a piece, as decimals joined by one space and as numbers."""
        ids = tuple(self.transduce(piece.encode().decode("latin-1").translate(self.table)))
        got = " ".join(map(str, ids)), ids
        if len(piece) <= LONGEST:
            self.known[piece] = got
        return got

    def encode_blocks(self, text: str) -> Iterator[tuple[str, list[int]]]:
        """The ids of a text, ``BLOCK`` pieces at a time, as decimals joined by one space and as numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for segment in self.segments(text):
            if segment in self.special:
                yield str(self.special[segment]), [self.special[segment]]
                continue
            pieces = self.pieces(segment)
            for at in range(0, len(pieces), BLOCK):
                some = pieces[at : at + BLOCK]
                try:
                    found = [known[p] for p in some]
                except KeyError:
                    found = [known[p] if p in known else self.learn(p) for p in some]
                ids = [*chain.from_iterable([f[1] for f in found])]
                if ids:
                    yield " ".join([f[0] for f in found if f[0]]), ids

    def encode(self, text: str | None) -> list[int]:
        return [i for _, ids in self.encode_blocks(text or "") for i in ids]

    def decode_stream(self, ids: Iterable[int], as_tokens: bool = False) -> Iterator[str]:
        """Text of a stream of ids. ``as_tokens``: the tokens as the vocabulary writes them, one space between."""
        machine = Decoder(self, as_tokens)
        for i in ids:
            yield machine.feed([i])
        yield machine.end()

    def decode(self, ids: Iterable[int], as_tokens: bool = False) -> str:
        return "".join(self.decode_stream(ids, as_tokens))

    def raw_tokens(self, as_tokens: bool) -> dict[int, bytes]:
        """The bytes of each id; ``as_tokens`` with one space before."""
        if as_tokens not in self.raw:
            self.raw[as_tokens] = {i: self.bytes_of_token(t, as_tokens) for i, t in self.tokens.items()}
        return self.raw[as_tokens]

    def bytes_of_token(self, token: str, as_tokens: bool) -> bytes:
        if as_tokens:
            return b" " + token.encode()
        if token in self.special:
            return token.encode()
        end = bool(self.suffix) and token.endswith(self.suffix)
        return bytes(map(self.bytes_of.__getitem__, token[: -len(self.suffix)] if end else token)) + (b" " if end else b"")


class Decoder:
    """From ids to text, as they come: the state is whether any token was seen, and the bytes of an unfinished character."""

    def __init__(self, codec: Codec, as_tokens: bool = False):
        self.raw, self.as_tokens, self.first = codec.raw_tokens(as_tokens), as_tokens, True
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: list[int]) -> str:
        try:
            raw = b"".join([*map(self.raw.__getitem__, ids)])
        except KeyError:  # ids that are not in the vocabulary decode to nothing
            raw = b"".join([self.raw.get(i, b"") for i in ids])
        if self.first and raw:
            self.first, raw = False, raw[1:] if self.as_tokens else raw
        return self.state.decode(raw)

    def end(self) -> str:
        return self.state.decode(b"", True)


_codecs: dict[str, Codec] = {}


def codec_of(text: str, lookahead: int) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = hashlib.sha1(text.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec.from_json(text, lookahead)
    return _codecs[key]


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256 of the whole text; ``with_ids`` adds ids and decoded.

    ``tokenizer``: the path of the vocabulary file on the driver, whence it is broadcast (a few MB, fixed).
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    lookahead = Codec.from_json(spec).lookahead
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, lookahead)
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1):
                machine, n, hashed, read = Decoder(codec, as_tokens=True), 0, hashlib.sha256(), hashlib.sha256()
                held: list[int] = []
                parts: list[str] = []
                for written, ids in codec.encode_blocks(value.as_py() or ""):
                    hashed.update(written.encode() if not n else b" " + written.encode())
                    n += len(ids)
                    decoded = machine.feed(ids)
                    read.update(decoded.encode())
                    if with_ids:
                        held += ids
                        parts.append(decoded)
                last = machine.end()
                read.update(last.encode())
                rows.append((n, hashed.hexdigest(), read.hexdigest(), *((held, "".join([*parts, last])) if with_ids else ())))
            cols = list(zip(*rows, strict=True)) or [()] * (5 if with_ids else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=names[: len(cols) + 1])

    kind = docs.schema[key].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
