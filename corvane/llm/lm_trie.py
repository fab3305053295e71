"""Language-model scoring with an Elias-Fano n-gram trie of order 3.

Documents are cut into blocks, which are stored as numbers of their distinct words.  Everything between blocks and the
model goes through ordinary shuffles of packed rows, one for each pair of a block and a shard that have n-grams in
common; so there are never more rows than n-grams, which grow with the tokens, and no task holds more than a block or a
shard.  First the shards of words sum their counts and number them; numbers are exact, so no two n-grams are ever taken
for one another.  Then each block sends its distinct pairs, their successors and their counts in training documents to
the shards of pairs.  Each shard builds its part of the trie and looks up what every block asked for.  The block turns the
answers into scores.  Parts of the trie are rows of a table in the shared folder (see `fit`), from which other documents
can be scored (`score_with`).

A part has the sorted pairs (Elias-Fano), monotone pointers to the range of each pair's successors (Elias-Fano), the
successors in order within their pair, in as many bits as words need, and an 8-bit logarithmic code of each node's count
(exact up to 32).  Pairs of at most 32-bit numbers are mixed by a bijection; wider ones have 64-bit hashes.  A lookup
finds the pair, then searches its own successors only.  The layout is read in place, from a row or a mapped file; high
bits stay packed, with one sample for each word of them.  The smoothed probability of a node and the weight of its
context are ratios of codes, P_n = (c + s P_(n-1)) / (C + s), down to P_1 = (c + 1) / (N + V + 1) (Dirichlet smoothing).

Successors of very frequent pairs are spread over all shards (which pairs, comes from a bounded sample by hash over the
whole table; this routes only, results do not depend on it).

Defined cases: null text is empty (one end token); a null id counts as a training document; repeated rows are learned
and scored each; a text longer than a block is a block of its own; the order of rows, and whether `docs` gives them in
the same order twice, does not matter; columns other than the id and the text are passed over, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import textkit
from corvane.llm.shared import bounded_sample, discard, stored

_U = np.uint64
BOS, END = _U(0x5AFE5AFE5AFE0001), _U(0x5AFE5AFE5AFE0002)
STRENGTH = {2: 60.0, 3: 12.0}
BLOCK_BYTES, SHARD_BYTES, WORD_SHARD_BYTES = 12 << 20, 6 << 20, 64 << 20
MIN_SHARDS, MIN_WORD_SHARDS = 24, 6
SAMPLE_ROWS, SAMPLE_BYTES, MAX_HOT = 1000, 1 << 16, 256


def join_parts(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def split_parts(blob) -> list[np.ndarray]:
    """Views of the parts."""
    data = np.frombuffer(blob, np.uint8) if not isinstance(blob, np.ndarray) else blob
    n = int(data[:8].view("<i8")[0])
    ends = np.cumsum(np.concatenate([[8 * (n + 1)], data[8 : 8 * (n + 1)].view("<i8")])).tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]


# --- Elias-Fano ---------------------------------------------------------------------------------------------------


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """`width` low bits of each value, end to end, and 8 spare bytes so that any field can be read as one word."""
    out = []
    if width:
        for lo in range(0, len(values), 1 << 16):  # whole bytes, as 2^16 is a multiple of 8
            part = values[lo : lo + (1 << 16)].astype("<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)], axis=1, bitorder="little", count=width)
            out.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(out) + bytes(8)


def read_bits(data: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    """Fields of packed bits by number; width is at most 56."""
    if not width:
        return np.zeros(len(index), np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    at = index.astype(np.int64) * width
    return (words[at >> 3] >> (at & 7).astype(np.uint64)) & _U((1 << width) - 1)


def ef_encode(values: np.ndarray) -> bytes:
    """A sorted sequence of 64-bit numbers: low bits as they are, high bits in unary, in whole words."""
    n = len(values)
    if not n:
        return struct.pack("<qqQq", 0, 0, 0, 0)
    base = values[0]
    v = values - base
    width = min(56, max(0, (int(v[-1]) // n).bit_length()))
    ones = (v >> _U(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(ones[-1]) // 64 + 1) * 64, np.uint8)
    bits[ones] = 1
    low = pack_bits(v, width)
    return struct.pack("<qqQq", n, width, int(base), len(low)) + low + np.packbits(bits, bitorder="little").tobytes()


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)  # place of each 1 of a byte


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the 1 of each rank; before: the number of 1s before each word."""
    word = np.searchsorted(before, rank, "right") - 1
    part = words[word].view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(np.bitwise_count(part), axis=1, dtype=np.int64)
    left = rank - before[word]
    byte = (upto <= left[:, None]).sum(1)
    rows = np.arange(len(rank))
    left = left - np.where(byte > 0, upto[rows, np.maximum(byte - 1, 0)], 0)
    return word * 64 + byte * 8 + _PLACE[part[rows, byte], left]


class EliasFano:
    """Reads an encoded sequence in place (bytes, a view or a memory map); only a count for each word of high bits is added."""

    def __init__(self, data: np.ndarray):
        self.n, self.width, base, size = struct.unpack("<qqQq", data[:32].tobytes())
        self.base = _U(base)
        if not self.n:
            return
        self.low = data[32 : 32 + size]
        high = data[32 + size :]
        self.words = np.ndarray((len(high) // 8,), "<u8", high, 0)
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate([[0], ones[:-1]])
        self.zeros = np.arange(len(ones)) * 64 - self.before
        self.top = int(_select(self.words, self.before, np.array([self.n - 1]))[0]) - (self.n - 1)

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        high = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little")) - np.arange(self.n)
        return ((high.astype(np.uint64) << _U(self.width)) | read_bits(self.low, np.arange(self.n), self.width)) + self.base

    def get(self, index: np.ndarray) -> np.ndarray:
        high = (_select(self.words, self.before, index) - index).astype(np.uint64)
        return ((high << _U(self.width)) | read_bits(self.low, index, self.width)) + self.base

    def _below(self, high: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is below each of the given ones (at most top + 1)."""
        out = np.where(high > self.top, self.n, 0)
        inner = np.flatnonzero((high > 0) & (high <= self.top))
        out[inner] = _select(~self.words, self.zeros, high[inner] - 1) + 1 - high[inner]
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, or -1: the high part gives a short range, whose low parts are searched."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        inside = np.flatnonzero(values >= self.base)
        v = values[inside] - self.base
        fits = (v >> _U(self.width)) <= _U(self.top)
        inside, v = inside[fits], v[fits]
        high = (v >> _U(self.width)).astype(np.int64)
        out[inside] = successor(lambda i: read_bits(self.low, i, self.width), self._below(high), self._below(high + 1), v & _U((1 << self.width) - 1))
        return out


def successor(read, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Binary search of each wanted value in its own sorted range [lo, hi); -1 where it is not."""
    out = np.full(len(lo), -1, np.int64)
    some = np.flatnonzero(lo < hi)
    lo, end, want = lo[some], hi[some], want[some]
    span = end - lo  # lo moves to the last place whose value is not above the wanted one
    while len(span) and (most := int(span.max())) > 1:
        open_ = np.flatnonzero(span > 1) if most > 2 else slice(None)
        half = span[open_] >> 1
        place = lo[open_] + half
        right = read(place) <= want[open_] if most > 2 else (read(place) <= want) & (half > 0)
        lo[open_] = np.where(right, place, lo[open_])
        span[open_] = np.where(right, span[open_] - half, half) if most > 2 else 1
    hit = read(lo) == want
    out[some[hit]] = lo[hit]
    return out


# --- codes --------------------------------------------------------------------------------------------------------

EXACT, STEP = 32, np.log(1e13 / 32) / 223
#: The count that a code stands for.
COUNTS = np.concatenate([np.arange(EXACT + 1.0), EXACT * np.exp(STEP * np.arange(1, 224))])


def quantise(counts: np.ndarray) -> np.ndarray:
    """8-bit codes of counts."""
    large = EXACT + np.rint(np.log(np.maximum(counts, 1) / EXACT) / STEP)
    return np.where(counts <= EXACT, counts, np.clip(large, EXACT, 255)).astype(np.uint8)


def pack_counts(counts: np.ndarray) -> bytes:
    """Bytes, with 255 for what follows in full."""
    large = counts >= 255
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes(), 1)


def unpack_counts(data, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts, without those of sum 0."""
    keys, counts = keys[counts > 0], counts[counts > 0]
    by = np.argsort(keys, kind="stable")  # merges sorted runs
    keys, counts = keys[by], counts[by]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


# --- blocks -------------------------------------------------------------------------------------------------------


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Block:
    """The tokens of some documents as numbers of its words (frequent ones first), one end after each document."""

    def __init__(self, ids: list, sizes: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.ids, self.sizes, self.words, self.tokens = ids, sizes, words, tokens
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.held = np.array([held_out(i) for i in ids], bool)
        self.trains = ~np.repeat(self.held, sizes)

    @classmethod
    def of(cls, ids: list, buf: np.ndarray, offs: np.ndarray) -> Block:
        n = len(ids)
        _, _, rows, hashes = textkit.words(buf, offs, lower=True)
        sizes = np.bincount(rows, minlength=n) + 1
        tokens = np.full(len(hashes) + n, END)
        tokens[np.arange(len(hashes)) + rows] = hashes
        words, number, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        by = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[by] = np.arange(len(words), dtype=np.uint32)
        return cls(ids, sizes, words[by], rank[number])

    def pack(self) -> bytes:
        # frequent words have small numbers, so most bytes of the higher planes are 0
        planes = [zstandard.compress(np.ascontiguousarray(p)) for p in self.tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T]
        ids = pa.array(self.ids, pa.int64()).fill_null(0).to_numpy()
        head = zstandard.compress(ids.astype("<i8").tobytes() + self.sizes.astype("<i8").tobytes() + bytes(i is None for i in self.ids))
        # in the order of hashes; counts give the other order back, in which words of the same count are sorted too
        by = np.argsort(self.words)
        return join_parts([head, ef_encode(self.words[by]), pack_counts(np.bincount(self.tokens, minlength=len(by))[by]), *planes])

    @classmethod
    def unpack(cls, blob) -> Block:
        head, words, counts, *planes = split_parts(blob)
        head = zstandard.decompress(head)
        n = len(head) // 17
        ids, sizes, nulls = np.frombuffer(head, "<i8", n), np.frombuffer(head, "<i8", n, 8 * n), head[16 * n :]
        known = [None if none else i for i, none in zip(ids.tolist(), nulls)]
        words = EliasFano(words).all()
        words = words[np.argsort(-unpack_counts(counts, len(words)), kind="stable")]
        tokens = np.stack([np.frombuffer(zstandard.decompress(p), np.uint8) for p in planes], axis=1).view("<u4").ravel()
        return cls(known, sizes, words, tokens)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trains], minlength=len(self.words))


def _pack_docs(limit: int):
    """For mapInArrow over id, text: packed blocks of about `limit` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def whole():
            ids = [i for h in held for i in h[0].to_pylist()]
            offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
            return pa.RecordBatch.from_arrays([pa.array([Block.of(ids, np.concatenate([h[1] for h in held]), offs).pack()], pa.binary())], ["docs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            buf, offs = textkit.flatten(batch.column(1))
            for lo, hi in textkit.blocks(offs, max(1, limit // 8)):
                held.append((batch.column(0).slice(lo, hi - lo), buf[offs[lo] : offs[hi]].copy(), offs[lo : hi + 1] - offs[lo]))
                size += int(offs[hi] - offs[lo])
                if size >= limit:
                    yield whole()
                    held, size = [], 0
        if held:
            yield whole()

    return run


# --- words --------------------------------------------------------------------------------------------------------


def _share(x: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Shard of each number of so many bits, in the order of the numbers."""
    top = x >> _U(bits - 32) if bits > 32 else x << _U(32 - bits)
    return ((top * _U(shards)) >> _U(32)).astype(np.int64)


def _rows(shards: list, block: int, asks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([block] * len(shards), pa.int64()), pa.array(asks, pa.binary())], ["shard", "block", "ask"])


_ASKS, _ANSWERS = "shard int, block bigint, ask binary", "kind int, shard int, block bigint, answer binary"


def _word_slices(block: Block, shards: int):
    """The block's words in the order of their hashes, and the slice of each shard that has any."""
    by = np.argsort(block.words)
    cuts = np.searchsorted(_share(block.words[by], 64, shards), np.arange(shards + 1))
    return by, [(s, slice(cuts[s], cuts[s + 1])) for s in np.flatnonzero(np.diff(cuts)).tolist()]


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block.unpack(blob.as_buffer())
                counts = block.word_counts()
                by, slices = _word_slices(block, shards)
                asks = [join_parts([ef_encode(block.words[by[part]]), pack_counts(counts[by[part]])]) for _, part in slices]
                yield _rows([s for s, _ in slices], number, asks)

    return run


def _answer(shard: int, blocks: list[int], answers: list[bytes], part: bytes | None, kind: int) -> pa.Table:
    """Answers to blocks; the shard's part of the model, if given, has the block -1."""
    blocks, answers = (blocks, answers) if part is None else ([*blocks, -1], [*answers, part])
    n = len(blocks)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "block": pa.array(blocks, pa.int64()), "answer": pa.array(answers, pa.binary())})


def _look_up_words(part, asked: np.ndarray) -> bytes:
    """Which of the sorted hashes are known, their places among the shard's words (sorted as well), and their counts."""
    words, counts = split_parts(part)
    at = EliasFano(words).find(asked)
    known = at[at >= 0]
    return join_parts([zlib.compress(np.packbits(at >= 0).tobytes(), 1), ef_encode(known.astype(np.uint64)), pack_counts(counts.view("<i8")[known])])


def _words_found(answer, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place plus one (0: unknown) and count of each of n words."""
    known, places, counts = split_parts(answer)
    known = np.unpackbits(np.frombuffer(zlib.decompress(known), np.uint8), count=n).astype(bool)
    out = np.zeros((2, n), np.int64)
    places = EliasFano(places).all()
    out[0, known], out[1, known] = places.astype(np.int64) + 1, unpack_counts(counts, len(places))
    return out[0].astype(np.uint64), out[1]


def _number_words(table: pa.Table) -> pa.Table:
    """For applyInArrow on a shard of words."""
    asks = [split_parts(x.as_buffer()) for x in table.column("ask")]
    hashes = [EliasFano(a[0]).all() for a in asks]
    words, counts = _sums(np.concatenate(hashes), np.concatenate([unpack_counts(a[1], len(h)) for a, h in zip(asks, hashes)]))
    part = join_parts([ef_encode(words), counts.astype("<i8").tobytes()])
    return _answer(table.column("shard")[0].as_py(), table.column("block").to_pylist(), [_look_up_words(part, h) for h in hashes], part, 1)


# --- pairs and their successors -----------------------------------------------------------------------------------


@dataclass
class Meta:
    """What all blocks and shards must agree on: shards, bits of a word's number, frequent pairs (by hashes), and totals."""

    word_shards: int
    shards: int
    bits: int
    hot: list[tuple[int, int]]
    tokens: int
    types: int
    texts: int
    strength: dict[int, float] = field(default_factory=lambda: dict(STRENGTH))

    @property
    def key_bits(self) -> int:
        return min(64, 2 * self.bits)

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for each pair of word numbers: a bijection of the pair, unless it has more than 64 bits."""
        if 2 * self.bits > 64:
            return textkit.mix64(textkit.mix64(a + _U(1)) + b)
        k = self.key_bits
        mask, x = _U((1 << k) - 1), (a << _U(self.bits)) | b
        for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
            x = (x * _U(odd)) & mask
            x ^= x >> _U((k + 1) // 2)
        return x


class Numbered:
    """A block whose words have the model's numbers: its n-grams, the distinct ones, and who is asked for them."""

    def __init__(self, block: Block, answers: list[tuple[int, bytes]], meta: Meta):
        self.block, self.meta = block, meta
        ids, self.counts = np.zeros(len(block.words), np.uint64), np.zeros(len(block.words), np.int64)
        by, slices = _word_slices(block, meta.word_shards)
        answers = dict(answers)
        for s, part in slices:
            place, self.counts[by[part]] = _words_found(answers[s], part.stop - part.start)
            ids[by[part]] = np.where(place > 0, (place - _U(1)) * _U(meta.word_shards) + _U(s) + _U(2), 0)  # 0: unknown, 1: start
        t, n = ids[block.tokens], len(block.tokens)
        start = np.zeros(n, bool)
        start[block.first] = True
        one, two = np.ones(n, np.uint64), np.ones(n, np.uint64)  # the words before: the start, but for what follows
        one[1:], two[2:] = t[:-1], t[:-2]
        one[start] = 1
        two[start] = 1
        second = block.first + 1
        two[second[block.sizes > 1]] = 1
        self.before, known = one, (one > 0) & (t > 0)
        pair, context = meta.keys(one, t), meta.keys(two, one)
        self.has_pair, self.has_context = known, (two > 0) & (one > 0)
        # start-start pairs are no events, but contexts: they are counted once a text
        opening, trains = meta.keys(np.ones(1, np.uint64), np.ones(1, np.uint64)), block.trains
        every = np.concatenate([pair[known], opening])
        self.keys, number = np.unique(every, return_inverse=True)
        self.pair = np.zeros(n, np.int64)
        self.pair[known] = number[:-1]
        self.key_counts = np.bincount(number[:-1], trains[known], len(self.keys)).astype(np.int64)
        self.key_counts[number[-1]] += int((~block.held).sum())
        # contexts are pairs of this block too
        self.context = np.zeros(n, np.int64)
        self.context[self.has_context] = np.searchsorted(self.keys, context[self.has_context])
        triple = self.has_context & (t > 0)
        self.has_triple = triple
        child = (self.context[triple].astype(np.uint64) << _U(meta.bits)) | t[triple] if meta.bits + int(len(self.keys)).bit_length() <= 64 else None
        if child is None:
            raise ValueError("a block has too many pairs")
        self.children, number = np.unique(child, return_inverse=True)
        self.triple = np.zeros(n, np.int64)
        self.triple[triple] = number
        self.child_counts = np.bincount(number, trains[triple], len(self.children)).astype(np.int64)
        self._route(ids)

    def _route(self, ids: np.ndarray) -> None:
        """Slices of pairs, of their successors, and of the spread successors for each shard."""
        meta = self.meta
        places = np.arange(meta.shards + 1)
        self.cuts = np.searchsorted(_share(self.keys, meta.key_bits, meta.shards), places)
        parent = (self.children >> _U(meta.bits)).astype(np.int64)
        known = dict(zip(self.block.words.tolist(), ids.tolist())) | {int(BOS): 1} if meta.hot else {}
        found = np.full(len(self.keys), -1, np.int64)
        for k, (a, b) in enumerate(meta.hot):
            if known.get(a) and known.get(b):
                key = meta.keys(np.array([known[a]], np.uint64), np.array([known[b]], np.uint64))
                i = int(np.searchsorted(self.keys, key)[0])
                if i < len(self.keys) and self.keys[i] == key[0]:
                    found[i] = k
        hot = found[parent] >= 0
        self.plain = np.flatnonzero(~hot)
        self.child_cuts = np.searchsorted(parent[self.plain], self.cuts)
        self.sizes = np.bincount(parent[self.plain], minlength=len(self.keys))
        spread = np.flatnonzero(hot)
        key = (found[parent[spread]].astype(np.uint64) << _U(meta.bits)) | (self.children[spread] & _U((1 << meta.bits) - 1))
        shard = _share(textkit.mix64(key), 64, meta.shards)
        by = np.lexsort((key, shard))
        self.spread, self.spread_keys, self.spread_cuts = spread[by], key[by], np.searchsorted(shard[by], places)

    def asked(self) -> list[int]:
        some = (np.diff(self.cuts) > 0) | (np.diff(self.spread_cuts) > 0)
        return np.flatnonzero(some).tolist()

    def slices(self, s: int) -> tuple[slice, np.ndarray, np.ndarray, slice]:
        pairs, spread = slice(self.cuts[s], self.cuts[s + 1]), slice(self.spread_cuts[s], self.spread_cuts[s + 1])
        return pairs, self.plain[self.child_cuts[s] : self.child_cuts[s + 1]], self.spread[spread], spread

    def ask(self, s: int) -> bytes:
        pairs, plain, spread, at = self.slices(s)
        words = self.children[plain] & _U((1 << self.meta.bits) - 1)
        counts = np.concatenate([self.key_counts[pairs], self.child_counts[plain], self.child_counts[spread]])
        return join_parts([ef_encode(self.keys[pairs]), pack_counts(self.sizes[pairs]), pack_bits(words, self.meta.bits), ef_encode(self.spread_keys[at]), pack_counts(counts)])


class Ask:
    """What a block asks of a shard: pairs, successors by pair, and spread successors."""

    def __init__(self, blob, bits: int):
        keys, sizes, words, spread, counts = split_parts(blob)
        self.keys, self.spread = EliasFano(keys).all(), EliasFano(spread).all()
        self.sizes = unpack_counts(sizes, len(self.keys))
        n = int(self.sizes.sum())
        self.words, self.parent = read_bits(words, np.arange(n), bits), np.repeat(np.arange(len(self.keys)), self.sizes)
        self.packed = counts

    def counts(self) -> list[np.ndarray]:
        all_ = unpack_counts(self.packed, len(self.keys) + len(self.words) + len(self.spread))
        return np.split(all_, [len(self.keys), len(self.keys) + len(self.words)])


class Trie:
    """One shard's levels, read in place from a row of the model or from a mapped file."""

    @staticmethod
    def build(pairs: tuple[np.ndarray, np.ndarray], parent: np.ndarray, words: np.ndarray, counts: np.ndarray, spread: tuple[np.ndarray, np.ndarray], bits: int) -> bytes:
        """pairs, spread: sorted keys and counts.  parent, words, counts: successors, sorted by pair (its place) and word."""
        pointers = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=len(pairs[0])))]).astype(np.uint64)
        return join_parts([struct.pack("<q", bits), ef_encode(pairs[0]), quantise(pairs[1]).tobytes(), ef_encode(pointers), pack_bits(words, bits), quantise(counts).tobytes(), ef_encode(spread[0]), quantise(spread[1]).tobytes()])

    def __init__(self, data):
        bits, pairs, self.codes, pointers, self.words, self.child_codes, spread, self.spread_codes = split_parts(data)
        self.bits = int(bits.view("<i8")[0])
        self.pairs, self.pointers, self.spread = EliasFano(pairs), EliasFano(pointers), EliasFano(spread)

    @classmethod
    def open(cls, path: str) -> Trie:
        return cls(np.memmap(path, np.uint8, "r"))

    def look_up(self, ask: Ask) -> np.ndarray:
        """Codes of the pairs, their successors and the spread successors asked for; 0 for what is not in the trie."""
        at = self.pairs.find(ask.keys)
        there = at >= 0
        out = [np.zeros(len(ask.keys), np.uint8), np.zeros(len(ask.words), np.uint8), np.zeros(len(ask.spread), np.uint8)]
        out[0][there] = self.codes[at[there]]
        lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if there.any():
            lo[there], hi[there] = self.pointers.get(at[there]), self.pointers.get(at[there] + 1)
        found = successor(lambda i: read_bits(self.words, i, self.bits), lo[ask.parent], hi[ask.parent], ask.words)
        out[1][found >= 0] = self.child_codes[found[found >= 0]]
        at = self.spread.find(ask.spread)
        out[2][at >= 0] = self.spread_codes[at[at >= 0]]
        return np.concatenate(out)


def _ask_grams(meta: Meta):
    """For cogrouped applyInArrow on a block and the answers to its words."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_batches([_rows([], 0, [])])
        block = Numbered(Block.unpack(docs.column("docs")[0].as_buffer()), _pairs(answers, 1), meta)
        shards = block.asked()
        return pa.Table.from_batches([_rows(shards, docs.column("block")[0].as_py(), [block.ask(s) for s in shards])])

    return run


def _pairs(answers: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return [(s, a.as_buffer()) for k, s, a in zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("answer")) if k == kind]


def _build(bits: int, keep: bool):
    """For applyInArrow on a shard of pairs: sums the counts of all blocks, builds the trie, and answers every block.

    keep: whether the trie is returned as well, for those who score other documents by it.
    """

    def run(table: pa.Table) -> pa.Table:
        asks = [Ask(x.as_buffer(), bits) for x in table.column("ask")]
        counts = [a.counts() for a in asks]
        pairs = _sums(np.concatenate([a.keys for a in asks]), np.concatenate([c[0] for c in counts]))
        # successors of pairs that training documents have, by the pair's place here
        parent = np.concatenate([np.searchsorted(pairs[0], a.keys)[a.parent] for a in asks])
        words, n = np.concatenate([a.words for a in asks]), np.concatenate([c[1] for c in counts])
        seen = n > 0
        parent, words, n = parent[seen], words[seen], n[seen]
        by = np.lexsort((words, parent))
        parent, words, n = parent[by], words[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (words[1:] != words[:-1])])) if len(by) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, first) if len(first) else n
        spread = _sums(np.concatenate([a.spread for a in asks]), np.concatenate([c[2] for c in counts]))
        part = Trie.build(pairs, parent[first], words[first], n, spread, bits)
        trie = Trie(part)
        return _answer(table.column("shard")[0].as_py(), table.column("block").to_pylist(), [zlib.compress(trie.look_up(a).tobytes(), 1) for a in asks], part if keep else None, 2)

    return run


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(meta: Meta):
    """For cogrouped applyInArrow on a block and all answers to it."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not docs.num_rows:
            return schema.empty_table()
        block = Block.unpack(docs.column("docs")[0].as_buffer())
        grams = Numbered(block, _pairs(answers, 1), meta)
        pair_codes, child_codes = np.zeros(len(grams.keys), np.uint8), np.zeros(len(grams.children), np.uint8)
        given = dict(_pairs(answers, 2))
        for s in grams.asked():
            pairs, plain, spread, _ = grams.slices(s)
            codes = np.frombuffer(zlib.decompress(given[s]), np.uint8) if s in given else np.zeros(len(grams.keys[pairs]) + len(plain) + len(spread), np.uint8)
            n = pairs.stop - pairs.start
            pair_codes[pairs], child_codes[plain], child_codes[spread] = codes[:n], codes[n : n + len(plain)], codes[n + len(plain) :]
        c1 = grams.counts[block.tokens]
        p1 = (c1 + 1) / (meta.tokens + meta.types + 1)
        # the context of a pair is a word, whose count is exact, or the start
        whole = np.zeros(len(c1))
        whole[1:] = c1[:-1]
        whole[block.first] = meta.texts
        c2 = np.where(grams.has_pair, COUNTS[pair_codes[grams.pair]], 0.0)
        p2 = (np.minimum(c2, whole) + meta.strength[2] * p1) / (whole + meta.strength[2])
        whole = np.where(grams.has_context, COUNTS[pair_codes[grams.context]], 0.0)
        c3 = np.where(grams.has_triple, COUNTS[child_codes[grams.triple]] if len(child_codes) else 0.0, 0.0)
        p3 = (np.minimum(c3, whole) + meta.strength[3] * p2) / (whole + meta.strength[3])
        total = lambda x: np.add.reduceat(x, block.first)
        columns = [block.ids, block.held, block.sizes, total((c1 > 0).astype(np.int64)), np.full(len(block.ids), meta.tokens, np.int64), total(np.log10(p1)), total(np.log10(p3))]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


# --- the model ----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """A trained model: rows (shard, answer) of the words and of the trie in the shared folder, and what its users must know."""

    words: DataFrame
    trie: DataFrame
    meta: Meta


def _hot_pairs(docs: DataFrame, shards: int) -> list[tuple[int, int]]:
    """The start of texts, and pairs of words with over a quarter of a mean shard, at most MAX_HOT, by the SAMPLE_ROWS texts of at most SAMPLE_BYTES with the least hashes of the whole table."""
    sample = bounded_sample(docs.where(F.octet_length("text") <= SAMPLE_BYTES), SAMPLE_ROWS, F.col("doc_id"), F.col("text")).select("text").collect()
    if not sample:
        return [(int(BOS), int(BOS))]
    block = Block.of(list(range(len(sample))), *textkit.flatten(pa.array([r.text for r in sample], pa.string())))
    words, after = np.append(block.words, BOS), block.tokens.astype(np.int64)
    before = np.concatenate([[0], after[:-1]])
    before[block.first] = len(words) - 1
    pairs, counts = np.unique(before * len(words) + after, return_counts=True)
    top = np.argsort(-counts, kind="stable")[:MAX_HOT]
    top = top[counts[top] * 4 * shards > len(after)]
    return [(int(BOS), int(BOS)), *((int(words[p // len(words)]), int(words[p % len(words)])) for p in pairs[top].tolist())]


def _blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    packed = docs.mapInArrow(_pack_docs(block_bytes), "docs binary").withColumn("block", F.monotonically_increasing_id())
    return docs, stored(packed.select("block", "docs"), "blocks")


def _fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", strength: dict[int, float] | None = None, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS, keep: bool = True):
    """blocks, answers to their words, answers to their n-grams (all stored), and Meta."""
    docs, blocks = _blocks(docs, doc_id, text, block_bytes)
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    word_shards, shards = max(MIN_WORD_SHARDS, -(-size // WORD_SHARD_BYTES)), max(min_shards, -(-size // shard_bytes))
    words = stored(blocks.mapInArrow(_ask_words(word_shards), _ASKS).groupBy("shard").applyInArrow(_number_words, _ANSWERS), "words")
    totals = words.where("block < 0").select("answer").mapInArrow(_totals, "tokens bigint, types bigint, texts bigint").agg(F.sum("tokens"), F.sum("types"), F.max("types"), F.sum("texts")).collect()[0]
    tokens, types, most, texts = (int(v or 0) for v in totals)
    meta = Meta(word_shards, shards, max(1, (most * word_shards + 2).bit_length()), _hot_pairs(docs, shards), tokens, types, texts, STRENGTH | (strength or {}))
    asked = blocks.groupBy("block").cogroup(words.where("block >= 0").groupBy("block")).applyInArrow(_ask_grams(meta), _ASKS)
    grams = stored(asked.groupBy("shard").applyInArrow(_build(meta.bits, keep), _ANSWERS), "grams")
    return blocks, words, grams, meta


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens, words and texts (ends) of each shard of words."""
    for batch in batches:
        for part in batch.column(0):
            words, counts = split_parts(part.as_buffer())
            counts, end = counts.view("<i8"), int(EliasFano(words).find(np.array([END]))[0])
            yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())]), pa.array([len(counts)]), pa.array([int(counts[end]) if end >= 0 else 0])], ["tokens", "types", "texts"])


def fit(docs: DataFrame, **options) -> Model:
    """The model of the training documents."""
    blocks, words, grams, meta = _fit(docs, **options)
    discard(blocks)
    return Model(words.where("block < 0").select("shard", "answer"), grams.where("block < 0").select("shard", "answer"), meta)


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """log10 probability of every text under the model learned from the training documents, and under single words."""
    blocks, words, grams, meta = _fit(docs, keep=False, **options)
    answers = words.where("block >= 0").unionAll(grams.where("block >= 0"))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(meta), _SCORES)


def score_with(model: Model, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same for any documents under a trained model."""
    _, blocks = _blocks(docs, doc_id, text, block_bytes)
    meta, bits = model.meta, model.meta.bits

    def words_of(asks: pa.Table, part: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return _answer(0, [], [], None, 1)
        found = part.column("answer")[0].as_buffer() if part.num_rows else join_parts([ef_encode(np.zeros(0, np.uint64)), b""])
        return _answer(asks.column("shard")[0].as_py(), asks.column("block").to_pylist(), [_look_up_words(found, EliasFano(split_parts(a.as_buffer())[0]).all()) for a in asks.column("ask")], None, 1)

    def grams_of(asks: pa.Table, part: pa.Table) -> pa.Table:
        if not asks.num_rows or not part.num_rows:
            return _answer(0, [], [], None, 2)
        trie = Trie(part.column("answer")[0].as_buffer())
        return _answer(asks.column("shard")[0].as_py(), asks.column("block").to_pylist(), [zlib.compress(trie.look_up(Ask(a.as_buffer(), bits)).tobytes(), 1) for a in asks.column("ask")], None, 2)

    words = stored(blocks.mapInArrow(_ask_words(meta.word_shards), _ASKS).groupBy("shard").cogroup(model.words.groupBy("shard")).applyInArrow(words_of, _ANSWERS), "words")
    asked = blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_ask_grams(meta), _ASKS)
    grams = stored(asked.groupBy("shard").cogroup(model.trie.groupBy("shard")).applyInArrow(grams_of, _ANSWERS), "grams")
    return blocks.groupBy("block").cogroup(words.unionAll(grams).groupBy("block")).applyInArrow(_score(meta), _SCORES)
