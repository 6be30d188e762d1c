"""Operator 1: byte-level BPE encoding and decoding with a segment tree per pre-token."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import only, slices, texts

#: Distinct pre-tokens of a generation that a worker remembers, of two. Only speed depends on it.
REMEMBERED = 1 << 18
_NONE = 1 << 62
#: Pre-tokens of so many bytes at most are merged together, so many of them at once.
FOREST_BYTES, FOREST_PIECES = 64, 1 << 13
#: Characters of text whose new pre-tokens are merged together.
LOT = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file (lines ``base64 rank``); as large as the vocabulary, whatever the corpus."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PairTree:
    """Segment tree over the byte positions of one pre-token.

    The leaf of position i holds the rank of the pair formed by the symbol that starts at
    i and its right neighbour; inner nodes hold the smaller child. A leaf's value is
    (rank, position) in one integer, so the root is the leftmost pair of least rank. A
    merge changes three leaves (the merged symbol, its dead right half, the left
    neighbour), each in O(log n) steps: n bytes cost O(n log n) however long they are.
    """

    def __init__(self, piece: bytes, ranks: dict[bytes, int], longest: int) -> None:
        n = len(piece)
        self.piece, self.ranks, self.longest, self.n = piece, ranks, longest, n
        self.right = list(range(1, n + 1))  # start of the next live symbol
        self.left = list(range(-1, n - 1))
        self.width = 1 << max(n - 1, 1).bit_length()
        self.shift = self.width.bit_length()  # short pieces have small values
        get, shift = ranks.get, self.shift
        ranked = [get(piece[i : i + 2]) for i in range(n - 1)]
        level = [_NONE if rank is None else rank << shift | i for i, rank in enumerate(ranked)]
        level += [_NONE] * (self.width - len(level))
        levels = [level]
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        self.tree = [_NONE]
        for level in reversed(levels):
            self.tree += level

    def merge_all(self) -> list[bytes]:
        right, left, tree, piece = self.right, self.left, self.tree, self.piece
        n, width, shift, longest, get = self.n, self.width, self.shift, self.longest, self.ranks.get
        low = (1 << shift) - 1
        while (best := tree[1]) != _NONE:
            i = best & low
            dead = right[i]
            right[i] = after = right[dead]
            if after < n:
                left[after] = i
            # all three leaves are set before their paths are mended, so that paths that
            # meet are mended once
            tree[width + dead] = _NONE
            changed = (i, left[i], dead) if left[i] >= 0 else (i, dead)
            for first in changed[:-1]:
                value, second = _NONE, right[first]
                if second < n and (end := right[second]) - first <= longest:
                    rank = get(piece[first:end])
                    if rank is not None:
                        value = rank << shift | first
                tree[width + first] = value
            for leaf in changed:
                k = (width + leaf) >> 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    if b < a:
                        a = b
                    if tree[k] == a:
                        break
                    tree[k] = a
                    k >>= 1
        out, i = [], 0
        while i < n:
            out.append(piece[i : right[i]])
            i = right[i]
        return out


class PairForest:
    """The trees of :class:`PairTree` for many short pre-tokens at once, one row of an array each.

    A step merges the pair at the root of every tree that still has one and mends the same
    three leaves and their paths. Symbols are ranks; the rank of a pair comes from a table of
    all splits of a vocabulary word into two others.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = (np.append(np.array(x, np.int64)[order], last) for x, last in ((keys, _NONE), (values, 0)))
        byte = self.bytes[:, None] * self.size + self.bytes[None, :]
        self.byte_pairs = self._ranked(byte.ravel())

    @staticmethod
    def fits(ranks: dict[bytes, int]) -> bool:
        """Whether every symbol that can come up has a rank."""
        return all(bytes([b]) in ranks for b in range(256))

    def _ranked(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``_NONE`` if they make no word."""
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], _NONE)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece (one byte at least) as little-endian unsigned 32-bit integers."""
        count, n = len(pieces), np.array(list(map(len, pieces)))
        width = 1 << int(n.max() - 1).bit_length()
        shift = width.bit_length()
        low, place = (1 << shift) - 1, np.arange(width)
        inside = place < n[:, None]
        raw = np.zeros((count, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.bytes[raw]
        right = np.broadcast_to(place + 1, (count, width)).copy().ravel()
        left = np.broadcast_to(place - 1, (count, width)).copy().ravel()
        tree = np.full((count, 2 * width), _NONE)
        pair = self.byte_pairs[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        tree[:, width : 2 * width - 1] = np.where(inside[:, 1:] & (pair != _NONE), pair << shift | place[:-1], _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live, symbols, tree = inside.ravel(), symbols.ravel(), tree.ravel()
        row = np.flatnonzero(tree[1 :: 2 * width] != _NONE)
        while len(row):
            end, base, root = n[row], row * width, 2 * width * row
            best = tree[root + 1]
            i = best & low
            dead = right[base + i]
            after = right[base + dead]
            right[base + i] = after
            symbols[base + i] = best >> shift
            live[base + dead] = False
            inner = np.flatnonzero(after < end)
            left[(base + after)[inner]] = i[inner]
            before = left[base + i]
            outer = np.flatnonzero(before >= 0)
            first = np.concatenate([(base + i)[inner], (base + before)[outer]])
            second = np.concatenate([(base + after)[inner], (base + i)[outer]])
            rank = self._ranked(symbols[first] * self.size + symbols[second])
            value = np.where(rank != _NONE, rank << shift | first & width - 1, _NONE)
            tree[root + width + dead] = _NONE
            tree[root + width + i] = _NONE
            tree[(root + width + i)[inner]] = value[: len(inner)]
            tree[(root + width + before)[outer]] = value[len(inner) :]
            base = np.concatenate([root, root, root[outer]])
            k = np.concatenate([i, dead, before[outer]]) + width >> 1
            while k[0]:
                at = base + 2 * k
                tree[base + k] = np.minimum(tree[at], tree[at + 1])
                k >>= 1
            row = row[tree[root + 1] != _NONE]
        packed = symbols[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.reshape(count, width).sum(1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encoder and decoder of one worker; remembers the ids of pre-tokens it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.longest = max(map(len, ranks), default=0)
        self.words: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.forest = PairForest(ranks) if PairForest.fits(ranks) else None

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return [self.ranks[symbol] for symbol in PairTree(piece, self.ranks, self.longest).merge_all()]

    def packed(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        got = self.known.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                ids = self.piece_ids(piece.encode())
                got = pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:  # a long piece hardly comes twice
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[piece] = got
        return got

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of new short pre-tokens, those of like length together."""
        by_width: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if len(raw) <= FOREST_BYTES and raw not in self.ranks:
                names, raws = by_width.setdefault((len(raw) - 1).bit_length(), ([], []))
                names.append(piece)
                raws.append(raw)
        for names, raws in by_width.values():
            for at in range(0, len(raws), FOREST_PIECES):
                part = slice(at, at + FOREST_PIECES)
                self.known.update(zip(names[part], self.forest.merge_all(raws[part])))

    def forget(self) -> None:
        """Drop the remembered pre-tokens: workers live on after a task, and other stages need the memory."""
        self.known, self.older = {}, {}

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.packed, self.find(text)))

    def encode_all(self, lot: list[str]) -> Iterator[bytes]:
        """The ids of every text; what is new in some texts is merged together."""
        first = 0
        while first < len(lot):
            last, size = first, 0
            while last < len(lot) and size < LOT:
                size += len(lot[last])
                last += 1
            found = list(map(self.find, lot[first:last]))
            if self.forest is not None:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                known, older = self.known, self.older
                self.learn({p for p in set().union(*found) if p not in known and p not in older})
            for k, pieces in enumerate(found):
                found[k] = None
                try:
                    yield b"".join(map(self.known.__getitem__, pieces))
                except KeyError:
                    yield b"".join(map(self.packed, pieces))
            first = last

    def decode(self, packed_ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(packed_ids, "<u4").tolist()))


def codec_of(ranks: Broadcast, pattern: str) -> Codec:
    """The worker's codec for broadcast ranks, built once per Python worker and kept until another one is asked for."""
    return _codec(ranks, pattern)


@lru_cache(maxsize=1)
def _codec(ranks: Broadcast, pattern: str) -> Codec:
    return Codec(ranks.value, pattern)


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """Read the rank file on the driver and broadcast it: about 50,000 entries, fixed by the tokenizer."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: token ids of every whole text, without special tokens.

    One output row per input row, without a shuffle: repeated rows and repeated or null
    ids stay as they are, null and empty texts give an empty list, other columns of the
    input are dropped, an empty table gives an empty table.
    """
    ranks = share_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        for batch in slices(batches):
            ids = [np.frombuffer(x, "<u4").astype("<i4") for x in codec.encode_all(texts(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )
        codec.forget()
        pa.default_memory_pool().release_unused()

    rows = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded binary``: the bytes of every id list; null or empty lists give no bytes."""
    ranks = share_ranks(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, "")
        for batch in slices(batches):
            lists = (np.asarray(x or [], "<u4").tobytes() for x in batch.column("ids").to_pylist())
            out = pa.array([codec.decode(x) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "decoded"])

    rows = only(encoded, doc_id=(id_col, "bigint"), ids=(ids_col, "array<int>"))
    return rows.mapInArrow(run, "doc_id bigint, decoded binary")


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes every whole text.

    The ids live only inside the task, so a row of a few hundred bytes leaves it however
    long the text is. Rows in and out as in :func:`encode`.
    """
    ranks = share_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        sha = hashlib.sha256
        for batch in slices(batches):
            counts, ids_sha, text_sha = [], [], []
            for ids in codec.encode_all(texts(batch)):
                counts.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.forget()
        pa.default_memory_pool().release_unused()

    rows = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
