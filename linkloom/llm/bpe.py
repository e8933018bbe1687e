"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over code points cuts each text where its content says so, so that documents that share a passage share
its chunks wherever it stands in them. A chunk that a worker has met before is not encoded again: its ids are kept (in a
store of bounded size) and only the joins between chunks are repaired: the fragments that meet at a cut are encoded
again together with one word from either side, then two, four and so on, until the outer words get exactly the ids that
they have in their own chunk. Ids are the tokenizers library's own throughout.

The vocabulary splits at white space before anything else, so a chunk is encoded word by word, and words seen before are
looked up as well.

Defined results: a null text is empty and has no ids; null ids, repeated rows and an empty table need no care, as every
row stands alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress, count, repeat
from operator import is_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: White space as the tokenizer has it (Unicode White_Space); str.split() also splits at these four separators.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_SPACES = re.compile(f"{_SPACE.pattern}+")

#: Units (pieces or words) and chunks that a worker keeps: two generations of at most about so many.
UNITS_KEPT, CHUNKS_KEPT = 600_000, 8_000
#: Texts of letters below U+0180 and common punctuation (without characters that lower-case oddly or that the classes
#: below take otherwise): normalising leaves them alone, and the vocabulary's pattern can be applied to the lower-cased text.
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0132-\u017e\u2010-\u2027\u2030-\u205e]*")
#: The vocabulary's own pattern, 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+, as it reads on such texts.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Code points hashed together, the mean distance of cuts (a power of two), and the least and most between two cuts.
ROLL, MEAN, LEAST, MOST = 24, 1024, 256, 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> list[str]:
    """The white-space-delimited words of a text, as the tokenizer sees them."""
    if _SEPARATORS.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def units_of(text: str) -> list[str]:
    """Strings that are encoded one by one: pieces of a plain text, words of any other."""
    if _PLAIN.fullmatch(text) and "<|" not in text:
        return _PIECE.findall(text.lower())
    return split_words(text)


class Recent:
    """A mapping in two generations that forgets what was not asked for while the newer one filled up."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def keep(self, keys: set) -> set:
        """Bring the known ones of ``keys`` into ``new``; the others are returned."""
        for k in keys & self.old.keys():
            self.new[k] = self.old[k]
        return keys - self.new.keys()

    def turn(self) -> None:
        """To be called between batches, so that what a batch has put in stays for as long as the batch needs it."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}


class WordCodec:
    """Ids of texts (little-endian unsigned 32-bit), unit by unit through a store of units.

    New pieces are encoded many at a time, joined by spaces: each ends in an id of its own kind. Words of texts that are
    not plain are given to the library one by one.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.ends = np.asarray([n.endswith("</w>") for n in self.names])
        self.known = Recent(UNITS_KEPT)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, units: set[str]) -> None:
        """Have the ids of all ``units`` in ``known.new``."""
        new, known = self.known.keep(units), self.known.new
        single = [u for u in new if _PIECE.fullmatch(u)]
        for s in range(0, len(single), 2_000):
            part = single[s : s + 2_000]
            ids = np.asarray(self.whole_ids(" ".join(part)), dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        rest = [u for u in new if u not in known]
        known.update(zip(rest, self.whole(rest), strict=True))

    def whole_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[bytes]:
        self.known.turn()
        get, found, gaps, new = self.known.new.get, [], [], set()
        for n, t in enumerate(texts):
            units = units_of(t)
            ids = list(map(get, units))
            found.append(ids)
            if None in ids:
                at = list(compress(count(), map(is_, ids, repeat(None))))
                missing = [units[i] for i in at]
                gaps.append((n, at, missing))
                new.update(missing)
        self.learn(new)
        known = self.known.new
        for n, at, missing in gaps:
            ids = found[n]
            for i, u in zip(at, missing, strict=True):
                ids[i] = known[u]
        return [b"".join(ids) for ids in found]

    def decode(self, ids: bytes) -> str:
        """As the library decodes with a vocabulary that names no decoder: pieces joined by spaces."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec per worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text; a cut depends on the ROLL code points before it."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    powers = _powers(n)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points + np.uint64(1)) * powers, out=prefix[1:])
    rolled = prefix[ROLL:] - prefix[:-ROLL]  # of points[i : i + ROLL], times base ** i
    hashes = rolled * _inverses(n - ROLL + 1)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    marks = np.flatnonzero((hashes >> np.uint64(40)) % np.uint64(MEAN) == 0) + ROLL
    out, start = [], 0
    for m in marks.tolist():
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST and m < n:
            out.append(m)
            start = m
    while n - start > MOST:
        start += MOST
        out.append(start)
    return [*out, n] if start < n else out


_tables: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        _tables[name] = have = np.multiply.accumulate(out)
    return have[:n]


def _powers(n: int) -> np.ndarray:
    return _table("power", int(_BASE), n)


def _inverses(n: int) -> np.ndarray:
    return _table("inverse", pow(int(_BASE), -1, 1 << 64), n)


class Chunk:
    """Ids of a chunk's inner words, and the fragments before its first and after its last white space."""

    __slots__ = ("head", "tail", "inner", "ids")

    def __init__(self, text: str):
        self.inner, self.ids = "", b""
        self.head, self.tail = text, None
        if found := _SPACE.search(text):
            self.head = text[: found.start()]
            last = _last_space(text)
            self.tail = text[last + 1 :]
            self.inner = text[found.start() : last + 1]


def edge_words(text: str, k: int, last: bool) -> list[str]:
    """The last (or first) k words of a text."""
    if _SEPARATORS.search(text):
        words = split_words(text)
        return words[-k:] if last else words[:k]
    return text.rsplit(None, k)[-k:] if last else text.split(None, k)[:k]


def _last_space(text: str) -> int:
    i = len(text) - 1
    while not _SPACE.match(text[i]):
        i -= 1
    return i


class ChunkCodec:
    """Encodes texts chunk by chunk; chunks met before are reused."""

    def __init__(self, path: str):
        self.words = codec(path)
        self.chunks = Recent(CHUNKS_KEPT)
        self.encoded = self.reused = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        self.chunks.turn()
        plans, mine = [], {}
        for t in texts:
            keys, start = [], 0
            for end in cuts(t):
                piece = t[start:end]
                key = hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                mine[key] = piece
                keys.append(key)
                start = end
            plans.append(keys)
        new = {k: Chunk(mine[k]) for k in self.chunks.keep(set(mine))}
        self.encoded += len(new)
        self.reused += sum(map(len, plans)) - len(new)
        for c, ids in zip(new.values(), self.words.encode([c.inner for c in new.values()]), strict=True):
            c.ids = ids
        self.chunks.new.update(new)
        found = self._joined([[self.chunks.new[k] for k in keys] for keys in plans])
        alone = [d for d, ids in enumerate(found) if ids is None]
        for d, ids in zip(alone, self.words.whole([texts[d] for d in alone]) if alone else [], strict=True):
            found[d] = ids
        return found

    def _joined(self, plans: list[list[Chunk]]) -> list[bytes | None]:
        """The chunks' ids with the ids of the fragments that meet between them; None for a text of which a join never agrees."""
        parts: list[list] = []
        joins: list[tuple[int, int, str, str, str]] = []
        for d, plan in enumerate(plans):
            out: list = []
            left = fragment = ""
            for c in plan:
                fragment += c.head
                if c.tail is None:  # no white space in it
                    continue
                if fragment:
                    joins.append((d, len(out), left, fragment, c.inner))
                    out.append(None)
                out.append(c.ids)
                left, fragment = c.inner, c.tail
            if fragment:
                joins.append((d, len(out), left, fragment, ""))
                out.append(None)
            parts.append(out)
        for (d, i, *_), found in zip(joins, self._repair([x[2:] for x in joins]), strict=True):
            parts[d][i] = found
        return [None if None in p else b"".join(p) for p in parts]

    def _repair(self, joins: list[tuple[str, str, str]]) -> list[bytes | None]:
        """Ids of each fragment, from windows that grow until the words around it agree with their own ids; None where they never do."""
        done: list = [None] * len(joins)
        todo, k = list(range(len(joins))), 1
        while todo:
            sides = [(edge_words(joins[i][0], k, True), edge_words(joins[i][2], k, False)) for i in todo]
            whole = self.words.whole([" ".join([*a, joins[i][1], *b]) for i, (a, b) in zip(todo, sides, strict=True)])
            around = self.words.encode([" ".join(x) for side in sides for x in side])
            again = []
            for n, (i, found) in enumerate(zip(todo, whole, strict=True)):
                before, after = around[2 * n], around[2 * n + 1]
                if found.startswith(before) and found.endswith(after) and len(found) >= len(before) + len(after):
                    done[i] = found[len(before) : len(found) - len(after)]
                elif max(map(len, sides[n])) >= k:
                    again.append(i)
            todo, k = again, 2 * k
        return done


_chunk_codecs: dict[str, ChunkCodec] = {}


def chunk_codec(path: str) -> ChunkCodec:
    if path not in _chunk_codecs:
        _chunk_codecs[path] = ChunkCodec(path)
    return _chunk_codecs[path]


def slices(texts: list[str], most: int = 4_000_000) -> Iterator[slice]:
    """Consecutive slices of a batch of at most ``most`` code points (or one text), so that memory stays bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = chunk_codec(tokenizer)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            for part in slices(texts):
                ids = c.encode(texts[part])
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[part],
                        "n_tokens": [len(x) // 4 for x in ids],
                        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                        "decoded_sha256": [hashlib.sha256(c.words.decode(x).encode()).hexdigest() for x in ids],
                    }
                )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
