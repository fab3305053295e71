"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

A byte string has one valid BPE token sequence, and the valid sequence of a prefix that ends in token t is the valid
sequence of the shorter prefix followed by t.  So it is enough to store, for every prefix, its unique last token: the
token t that ends there such that BPE keeps the pair (last token of the rest, t) as it stands.  Reading the table from
the end gives the encoding; bytes appended extend the table without changing it, and an edit re-encodes from the edited
byte until the table is again what it was.

Null text: encoded as empty (no tokens, empty bytes).  Rows are independent: repeated rows give equal results, an empty
table gives an empty table, texts of any length are processed whole.  Columns of the input other than `keep` and the
text are not read, so they cannot clash with the output names.
"""

from __future__ import annotations

import base64
import functools
import gc
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import keeps_memory, small_batches, text_blocks


#: In place of a token where a text begins.
START = 1 << 31


class Vocabulary:
    """Ranks of byte strings, and which token pairs BPE leaves unmerged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.token = [b""] * (max(ranks.values()) + 1)
        #: Nested by byte: the token that ends there (-1: none) and what follows.
        self.trie: dict[int, tuple[int, dict]] = {}
        for piece, rank in sorted(ranks.items()):  # shorter pieces come before those that go on
            self.token[rank] = piece
            node = self.trie
            for byte in piece[:-1]:
                if byte not in node:
                    node[byte] = (-1, {})
                node = node[byte][1]
            node[piece[-1]] = (rank, {})
        self.size, self.packed = [len(x) for x in self.token], [struct.pack("<I", k) for k in range(len(self.token))]
        #: The two tokens whose merge makes a token; None for tokens that BPE never makes (and so cannot emit inside a piece).
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.kept: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """Plain BPE by lowest rank first, leftmost on ties; only merges that make ranks under `below`."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def made_of(self, token: int) -> tuple[int, int] | None:
        """The last merge that makes the token; single bytes and tokens that merging never makes have none."""
        try:
            return self.halves[token]
        except KeyError:
            parts = self.merge(self.token[token], below=token)
            self.halves[token] = out = (parts[0], parts[1]) if len(parts) == 2 else None
            return out

    def reachable(self, token: int) -> bool:
        return len(self.token[token]) == 1 or self.made_of(token) is not None

    def keeps(self, pair: int) -> bool:
        """Whether BPE of two tokens' bytes is just these two tokens; pair is left << 32 | right, left START for none.

        The last merges of both sides are undone, latest first.  A merge across the border would have happened
        before every merge of a higher rank that is still standing; equal ranks merge from the left.
        """
        if len(self.kept) > 600_000:
            self.kept.clear()
        left, right = pair >> 32, pair & 0xFFFFFFFF
        self.kept[pair] = out = self.reachable(right) and (left == START or self._keeps(left, right))
        return out

    def _keeps(self, left: int, right: int) -> bool:
        token, ranks = self.token, self.ranks
        bound = len(token)  # crossing merges under this rank would have come first
        while True:
            crossing = ranks.get(token[left] + token[right])
            if crossing is not None and crossing < bound:
                return False
            # undo the later merge of the two sides; with the same rank on both, the left one came first
            a, b = self.made_of(left), self.made_of(right)
            if a is not None and (b is None or left > right):
                left, bound = a[1], left
            elif b is not None:
                right, bound = b[0], right + 1
            else:
                return True

    def fill(self, text: bytes, last: list[int], left: int = START) -> None:
        """The last tokens of the prefixes of text where they are -1; those given are final.  left: the token before the text.

        Tokens are walked forward from each start, whose own last token is final by then, so a token is tried exactly
        once for each place it can begin.
        """
        kept, keeps, root, n = self.kept, self.keeps, self.trie, len(text)
        for start in range(n):
            before, node = left << 32, root
            for at in range(start, n):
                found = node.get(text[at])
                if found is None:
                    break
                token, node = found
                if token >= 0 and last[at] < 0:
                    pair = before | token
                    if kept[pair] if pair in kept else keeps(pair):
                        last[at] = token
            left = last[start]
            if left < 0:
                raise ValueError("a byte is no token of this vocabulary")

    def encode(self, text: bytes) -> bytes:
        """Little-endian ids of a text, by a prefix table that is not kept."""
        last, out, at = [-1] * len(text), [], len(text)
        self.fill(text, last)
        size, packed = self.size, self.packed
        while at:
            token = last[at - 1]
            out.append(packed[token])
            at -= size[token]
        out.reverse()
        return b"".join(out)


class PrefixTable:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Extends the table; entries made before stay as they are, and only the last of them are read."""
        old = len(self.last)
        self.data += data
        self.last += [-1] * len(data)
        self._fill(old, len(self.last))

    def _fill(self, lo: int, hi: int) -> None:
        """The entries from lo to hi, which are -1 until then; those before are final."""
        last, longest = self.last, self.vocabulary.longest
        base = lo - longest if lo > longest else 0
        part = last[base:hi]
        self.vocabulary.fill(bytes(self.data[base:hi]), part, last[base - 1] if base else START)
        last[lo:hi] = part[lo - base :]

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replaces bytes start to end; returns how many entries were computed again.

        An entry depends on the bytes and entries no further back than the longest token.  So once that many entries
        behind the edit are what they were before, all that follow are too, and are taken over.
        """
        longest, tail = self.vocabulary.longest, self.last[end:]
        self.data[start:end] = data
        self.last[start:] = [-1] * (len(data) + len(tail))
        done, cut, n = start, start + len(data), len(self.last)
        while done < n:
            to = min(n, max(done, cut) + longest)
            self._fill(done, to)
            done = to
            if to - longest >= cut and self.last[to - longest : to] == tail[to - longest - cut : to - cut]:
                self.last[to:] = tail[to - cut :]
                break
        return done - start

    def tokens(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            out.append(self.last[at - 1])
            at -= self.vocabulary.size[out[-1]]
        return out[::-1]


class _Pieces(dict):
    """Little-endian ids of each match of the pattern; computed by the prefix table when a match is new."""

    LIMIT = 600_000

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def encode(self, piece: str) -> bytes:
        data = piece.encode()
        rank = self.vocabulary.ranks.get(data)
        return self.vocabulary.encode(data) if rank is None else self.vocabulary.packed[rank]

    def __missing__(self, piece: str) -> bytes:
        out = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = out
        return out


class _Chunks(dict):
    """Ids of the text between two spaces, with the first space where there is one.

    A border between a non-space and a space always parts two matches.  A chunk that is empty or ends in white space
    can belong to a longer run of white space; it is None here, and the text then goes through the pattern whole.
    """

    LIMIT = 800_000

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk: str) -> bytes | None:
        e, out = self.encoder, None
        if chunk and not chunk[-1].isspace():
            found = e.findall(self.lead + chunk)
            out = e.pieces[found[0]] if len(found) == 1 else b"".join(map(e.pieces.__getitem__, found))
        if len(chunk) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    """Splits text by the pattern and encodes each match on its own."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary.load(path)
        self.findall = regex.compile(pattern).findall
        self.pieces, self.first, self.chunks = _Pieces(self.vocabulary), _Chunks(self, ""), _Chunks(self, " ")

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        try:
            return b"".join([self.first[first], *map(self.chunks.__getitem__, rest)])
        except TypeError:  # a None among them
            return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker, kept between batches."""
    return Encoder(path, pattern)


def _release() -> None:
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its caches refer to each other


keeps_memory(__name__, _release)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds token_ids (little-endian unsigned 32-bit) and decoded (the bytes of these ids) to the `keep` columns.

    One narrow map over the scan: no shuffle, nothing sent to the driver; memory is bounded by a block of rows.
    """
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def block(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        e = encoder(path, pattern)
        ids = [e.encode(x) if x else b"" for x in rows.column(rows.schema.get_field_index(text)).to_pylist()]
        out = [rows.column(rows.schema.get_field_index(k)) for k in keep]
        return pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.binary()), pa.array(map(e.decode, ids), pa.binary())], [*keep, "token_ids", "decoded"])

    return small_batches(docs).select(*dict.fromkeys([*keep, text])).mapInArrow(text_blocks(block, text), schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encode_documents(docs, path, pattern).select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
