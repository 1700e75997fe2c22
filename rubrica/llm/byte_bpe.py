"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, and a heap over linked bytes for the rest.

A file of ranks (a base64 token and its rank a line) becomes a ``Ranks`` on the driver and is broadcast; its size is that
of the vocabulary. A text is cut to pre-tokens by character classes, as the pattern of byte-level tokenizers cuts it. All
distinct pre-tokens of a slice are looked up at once: a displacement for each bucket of keys places every vocabulary entry
in a slot of its own, with no slot left over, and a found slot counts only if its bytes are equal. What isn't in the
vocabulary is merged pair by pair, lowest rank and then leftmost first, with a heap of pairs over linked bytes.

Null texts are empty and have no ids; long texts are encoded whole, in time n log n even where they are one pre-token. Rows
that repeat give equal results, an empty table gives an empty one, and other columns, whatever their names, are neither
read nor returned. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import cut
from .common import arrow_map, table, texts_of

#: Base of the rolling hash, odd, so that it has an inverse among the 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
ZERO = np.zeros(1, np.uint64)
#: Merged words that a worker remembers, each of at most ``KEPT_BYTES``; they only save work.
KEPT_WORDS, KEPT_BYTES = 300_000, 64
#: Entry of a pair without a rank, above all others.
NONE = 1 << 62


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of bytes, from one pass over ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)), out=sums[1:])
    rolled = (sums[ends] - sums[starts]) * _powers(pow(BASE, -1, 1 << 64), len(data) + 1)[starts]
    return _mixed(rolled, (ends - starts).astype(np.uint64))


def _mixed(h: np.ndarray, salt) -> np.ndarray:
    x = h + (salt + np.uint64(1)) * np.uint64(BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _within(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    stops = np.cumsum(sizes)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts - stops + sizes, sizes)


class PerfectHash:
    """A minimal perfect hash of distinct, non-empty byte strings: hash, bucket, displacement, slot."""

    def __init__(self, keys: list[bytes], load: int = 4):
        self.n, self.buckets = len(keys), max(1, -(-len(keys) // load))
        sizes = np.array([len(k) for k in keys], np.int64)
        data, ends = np.frombuffer(b"".join(keys), np.uint8), np.cumsum(sizes)
        h = hashes(data, ends - sizes, ends)
        if len(np.unique(h)) < len(keys):
            raise ValueError("keys repeat or their 64-bit hashes collide")
        bucket = _within(_mixed(h, ZERO), self.buckets)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        firsts = np.cumsum(counts) - counts
        self.moves = np.zeros(self.buckets, np.int64)
        self.slots = np.full(self.n, -1, np.int64)  # the key in each slot
        for b in np.argsort(-counts, kind="stable"):
            own = order[firsts[b] : firsts[b] + counts[b]]
            if len(own) == 1:
                break
            if len(own):
                self.moves[b], place = self._moved(h[own])
                self.slots[place] = own
        free = np.flatnonzero(self.slots < 0)
        alone = np.flatnonzero(counts == 1)
        self.moves[alone] = -1 - free  # buckets of one key name their slots
        self.slots[free] = order[firsts[alone]]
        take = _ranges((ends - sizes)[self.slots], sizes[self.slots])
        self.bytes, self.ends = data[take], np.cumsum(sizes[self.slots])

    def _moved(self, h: np.ndarray, tries: int = 128) -> tuple[int, np.ndarray]:
        """The first displacement that sends the keys of a bucket to free slots, all different."""
        first = 0
        while True:
            places = np.sort(_within(_mixed(h[None], np.arange(first + 1, first + 1 + tries, dtype=np.uint64)[:, None]), self.n), 1)
            fits = (self.slots[places] < 0).all(1) & (np.diff(places, axis=1) > 0).all(1)
            if fits.any():
                move = first + int(np.argmax(fits))
                return move, _within(_mixed(h, np.array([move + 1], np.uint64)), self.n)
            first += tries

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each key ``data[start:end]``, or -1."""
        out = np.full(len(starts), -1, np.int64)
        if not self.n or not len(starts):
            return out
        h = hashes(data, starts, ends)
        move = self.moves[_within(_mixed(h, ZERO), self.buckets)]
        slot = np.where(move < 0, -1 - move, _within(_mixed(h, np.maximum(move, 0).astype(np.uint64) + np.uint64(1)), self.n))
        begin = np.concatenate([[0], self.ends[:-1]])
        sizes = ends - starts
        like = np.flatnonzero((sizes > 0) & (self.ends[slot] - begin[slot] == sizes))
        if not len(like):
            return out
        same = data[_ranges(starts[like], sizes[like])] == self.bytes[_ranges(begin[slot[like]], sizes[like])]
        like = like[np.logical_and.reduceat(same, np.cumsum(sizes[like]) - sizes[like])]
        out[like] = self.slots[slot[like]]
        return out


def merge(word: bytes, pairs: list[int], ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, and of those the leftmost, becomes one token until none has a rank.

    ``pairs``: rank << 32 | place of each two bytes that follow each other, ``NONE`` or more without a rank.
    """
    n = len(word)
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n - 1))  # start of the token before the one that starts here
    current = [*pairs, NONE]  # the entry that holds for the pair that starts here; others in the heap are outdated
    heap = pairs[:]
    heapq.heapify(heap)
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    while heap and (top := pop(heap)) < NONE:
        i = top & 0xFFFFFFFF
        if current[i] != top:
            continue
        j = end[i]
        k = end[i] = end[j]
        current[i] = current[j] = NONE
        if k < n:
            before[k] = i
            if (r := get(word[i : end[k]])) is not None:
                current[i] = r << 32 | i
                push(heap, current[i])
        if i:
            b = before[i]
            current[b] = NONE
            if (r := get(word[b:k])) is not None:
                current[b] = r << 32 | b
                push(heap, current[b])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Ranks:
    """A vocabulary of ranks with its perfect hash."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = list(self.ranks)
        self.of_key = np.array([self.ranks[t] for t in tokens], np.int64)
        self.hash = PerfectHash(tokens)
        self.pieces: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.pieces[rank] = token
        self.piece_len = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.two = np.full(1 << 16, NONE >> 32, np.int64)  # ranks of two bytes
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        self.kept: dict[bytes, list[int]] = {}

    def merge_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Ids of each pre-token ``data[start:end]``, none of them a vocabulary entry."""
        sizes = ends - starts
        flat = data[_ranges(starts, sizes)]
        stops = np.cumsum(sizes)
        at = np.arange(len(flat)) - np.repeat(stops - sizes, sizes)
        pairs = (self.two[flat[:-1].astype(np.int64) << 8 | flat[1:]] << 32 | at[:-1]).tolist()
        raw, out, kept = flat.tobytes(), [], self.kept
        for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
            word = raw[a:b]
            ids = kept.get(word)
            if ids is None:
                ids = merge(word, pairs[a : b - 1], self.ranks)
                if b - a <= KEPT_BYTES:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = ids
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts side by side, where each text's begin and the end)."""
        data, bounds, owner = cut(texts, "byte")
        words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        ids, at = self.encode_words(words.dictionary)
        index = words.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(at)[index]
        by_text = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        return ids[_ranges(at[index], sizes)], np.concatenate([[0], np.cumsum(by_text)])

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct pre-tokens: whole ones by the hash, the others merged."""
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        key = self.hash.find(data, bounds[:-1], bounds[1:])
        new = np.flatnonzero(key < 0)
        merged = self.merge_words(data, bounds[new], bounds[new + 1])
        sizes = np.ones(len(key), np.int64)
        sizes[key < 0] = [len(x) for x in merged]
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(int(at[-1]), np.int64)
        ids[at[:-1][key >= 0]] = self.of_key[key[key >= 0]]
        ids[_ranges(at[:-1][key < 0], sizes[key < 0])] = [i for x in merged for i in x]
        return ids, at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts side by side, bounds)."""
        sizes = self.piece_len[ids]
        return self.piece_bytes[_ranges(self.piece_at[ids], sizes)].tobytes(), np.concatenate([[0], np.cumsum(sizes)])[at]


def _source(df: DataFrame, column: str, id_column: str) -> tuple[DataFrame, str]:
    return df.select(F.col(f"`{id_column}`").alias("__i"), F.col(f"`{column}`").alias("__t")), df.schema[id_column].dataType.simpleString()


def encode_texts(df: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id and ``ids`` (array) of each row."""
    held = df.sparkSession.sparkContext.broadcast(Ranks(path))

    def part(batch: pa.RecordBatch) -> dict:
        ids, at = held.value.encode(texts_of(batch, "__t"))
        return {id_column: batch.column("__i"), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))}

    source, kind = _source(df, text, id_column)
    return arrow_map(source, ["__i", "__t"], f"`{id_column}` {kind}, ids array<int>", part, "__t")


def decode_ids(df: DataFrame, path: str, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """The id and ``bytes`` of each row's array of ids; null arrays count as empty. Ids beyond the vocabulary raise."""
    held = df.sparkSession.sparkContext.broadcast(Ranks(path))

    def part(batch: pa.RecordBatch) -> dict:
        lists = [x or [] for x in batch.column("__t").to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        data, bounds = held.value.decode(np.array([i for x in lists for i in x], np.int64), at)
        return {id_column: batch.column("__i"), "bytes": [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]}

    source, kind = _source(df, ids, id_column)
    sized = source.withColumn("__n", F.expr("repeat(' ', greatest(0, coalesce(size(__t), 0)))"))
    return arrow_map(sized, ["__i", "__t", "__n"], f"`{id_column}` {kind}, bytes binary", part, "__n")


def round_trip(df: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256 (of decimal ids, one blank between), decoded_sha256 (of the decoded bytes)."""
    held = df.sparkSession.sparkContext.broadcast(Ranks(path))
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def part(batch: pa.RecordBatch) -> dict:
        ids, at = held.value.encode(texts_of(batch, "__t"))
        data, bounds = held.value.decode(ids, at)
        return {
            id_column: batch.column("__i"),
            "n_tokens": np.diff(at),
            "ids_sha256": [sha(" ".join(map(str, ids[a:b].tolist())).encode()) for a, b in zip(at, at[1:], strict=False)],
            "decoded_sha256": [sha(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)],
        }

    source, kind = _source(df, text, id_column)
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(source, ["__i", "__t"], schema, part, "__t")


def op12_byte_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
