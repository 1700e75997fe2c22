"""BPE encoding and decoding with a minimal acyclic transducer for frequent words.

A tokenizer file becomes a ``Model`` on the driver and is broadcast; its size is that of the vocabulary. Frequent words
(the vocabulary's own, and those counted over every row of the table) are compiled with their ids into a minimal acyclic
transducer: words share prefixes and suffixes, arcs carry numbers whose sum along a path is the word's place in the list
of outputs. It is written once as a file, which the workers of a machine map together, read-only. Words it doesn't hold are merged exactly, all distinct words of a slice at a time.
The lexicon only saves work; ids don't depend on it.

Texts are cut to words by rules on character classes, the same as the tokenizers' patterns give. Special tokens in a text
count as such. Null texts are empty and have no ids; long texts are encoded whole. Rows that repeat give equal results, an
empty table gives an empty one, and other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, scratch_dir, table, texts_of

LETTER, NUMBER, OTHER, SPACE = 1, 2, 0, 3
BEYOND = re.compile("[\u0530-\U0010ffff]")
NEVER = np.int32(2**31 - 1)
#: Words of more symbols than this are merged with a heap, one at a time.
LONG_WORD = 1024


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of each code point, by the tokenizers' own regular expressions, whose version of Unicode then holds."""
    from tokenizers import Regex, pre_tokenizers

    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        finder = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for low, high in ((0, 0xD800), (0xE000, 0x3A000), (0xE0000, 0xE1000)):  # what lies between is unassigned or private
            for _, (a, b) in finder.pre_tokenize_str("".join(map(chr, range(low, high)))):
                out[low + a : low + b] = kind
    return out


class Table:
    """Open-addressing map from integers to rows of int32, made of plain arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.zeros((size, values.shape[1]), np.int32)
        left = np.arange(len(keys))
        place = self._place(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[place[left]] < 0]
            first, pick = np.unique(place[free], return_index=True)
            put = free[pick]
            self.keys[first], self.values[first] = keys[put], values[put]
            left = left[~np.isin(left, put)]
            place[left] = (place[left] + 1) & (size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys, or -1."""
        place = self._place(keys)
        got = self.keys[place]
        out = np.where(got == keys, place, -1)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            p = (place[open_] + 1) & (len(self.keys) - 1)
            place[open_] = p
            got = self.keys[p]
            out[open_[got == keys[open_]]] = p[got == keys[open_]]
            open_ = open_[(got != keys[open_]) & (got >= 0)]
        return out


class Transducer:
    """Minimal acyclic transducer: a word's output is the sum of the numbers on its arcs, which is its rank in order."""

    def __init__(self, words: list[bytes]):
        """``words``: distinct, in byte order."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # parent, byte, child of the last word

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, byte, child = path.pop()
                same = register.setdefault((final[child], tuple(arcs[child].items())), child)
                arcs[parent][byte] = same

        last = b""
        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            settle(common)
            state = path[-1][2] if path else 0
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[state][byte] = len(arcs) - 1
                path.append((state, byte, len(arcs) - 1))
                state = len(arcs) - 1
            final[state] = True
            last = word
        settle(0)
        order, seen, stack = [], {0}, [(0, iter(arcs[0].values()))]
        while stack:  # children before parents
            state, rest = stack[-1]
            child = next((c for c in rest if c not in seen), None)
            if child is None:
                order.append(state)
                stack.pop()
            else:
                seen.add(child)
                stack.append((child, iter(arcs[child].values())))
        words_below = {}
        rows = []
        number = {s: i for i, s in enumerate(reversed(order))}
        for state in order:
            before = int(final[state])
            for byte, child in sorted(arcs[state].items()):
                rows.append((number[state] << 8 | byte, number[child], before))
                before += words_below[child]
            words_below[state] = before
        self.final = np.zeros(len(order), np.int32)
        for state in order:
            self.final[number[state]] = final[state]
        rows = np.array(rows or [(-2, 0, 0)], np.int64)
        self.arcs = Table(rows[:, 0], rows[:, 1:])

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank of each word ``data[start:end]``, or -1."""
        out = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero(ends > starts)
        state, rank = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        at = 0
        while len(live):
            p = self.arcs.find(state << 8 | data[starts[live] + at])
            ok = p >= 0
            live, p = live[ok], p[ok]
            state, rank = self.arcs.values[p, 0].astype(np.int64), rank[ok] + self.arcs.values[p, 1]
            at += 1
            done = ends[live] - starts[live] == at
            hit = done & (self.final[state] == 1)
            out[live[hit]] = rank[hit]
            live, state, rank = live[~done], state[~done], rank[~done]
        return out

    def stored(self) -> bytes:
        """The arrays as the bytes of a file; what is left of the object tells where they lie in it."""
        parts = [np.ascontiguousarray(p) for p in (self.final, self.arcs.keys, self.arcs.values)]
        self.layout = [(p.dtype, p.shape, sum(q.nbytes for q in parts[:i])) for i, p in enumerate(parts)]
        self.final = self.arcs.keys = self.arcs.values = None
        return b"".join(p.tobytes() for p in parts)

    def mapped(self, name: str) -> Transducer:
        """Itself with its arrays mapped, read-only, from the file that ``stored`` gave the bytes of."""
        self.final, self.arcs.keys, self.arcs.values = (np.memmap(name, dtype, "r", at, shape) for dtype, shape, at in self.layout)
        return self


def cut(texts: list[str], kind_of_words: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, byte ranges' starts with the end as last, index of each word's text). White space that the
    kind drops is a word here, with text -1."""
    joined = "".join(texts)
    data = joined.encode("utf-8", "replace")
    if not joined:
        return data, np.zeros(1, np.int64), np.zeros(0, np.int64)
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    n = len(cp)
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0]
    kind = character_classes()[cp]
    before = np.empty_like(kind)
    before[0], before[1:] = 9, kind[:-1]
    before[firsts] = 9
    blank = kind == SPACE
    start = before != kind
    if kind_of_words == "byte":
        after = np.empty_like(kind)
        after[-1], after[:-1] = SPACE, kind[1:]
        after[firsts[1:] - 1] = SPACE
        start |= blank & (after != SPACE)
        attached = np.zeros(n, bool)
        attached[1:] = (cp[:-1] == 32) & ~blank[1:]
        attached[firsts] = False
        start &= ~attached
    else:
        start |= kind == NUMBER
    quotes = np.flatnonzero((cp == 39) & start)
    if len(quotes):
        edge = np.zeros(n + 4, bool)
        edge[firsts] = True
        edge[n] = True
        wide = np.concatenate([cp, np.zeros(4, np.uint32)])
        a, b = wide[quotes + 1], wide[quotes + 2]
        a = np.where(edge[quotes + 1], 0, a)
        b = np.where(edge[quotes + 1] | edge[quotes + 2], 0, b)
        short = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        hit = quotes[short | pair]
        stop = hit + np.where(short[short | pair], 2, 3)
        start[hit + 1] = False
        inside = stop[stop < n]
        start[inside[kind[inside] == LETTER]] = True
    at = np.flatnonzero(start)
    owner = np.searchsorted(firsts, at, "right") - 1
    owner = np.flatnonzero(sizes > 0)[owner]
    if kind_of_words == "word":
        owner[blank[at]] = -1
    if len(data) == n:
        starts = at
    else:
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        starts = (np.cumsum(width) - width)[at]
    return data, np.append(starts, len(data)).astype(np.int64), owner


class Model:
    """A BPE vocabulary. ``kind`` is byte (words keep a leading blank) or word (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.kind = "word" if self.end else "byte"
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        chars = byte_characters()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + self.end] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        rank = np.arange(len(made))
        #: Where each merge's parts are older than it, all places of a word's best pair can be merged in one step.
        self.ordered = bool((born[left] < rank).all() and (born[right] < rank).all())
        _, first = np.unique(left << 32 | right, return_index=True)
        self.pairs = Table((left << 32 | right)[first], np.stack([rank[first].astype(np.int32), made[first]], 1))
        back = {c: b for b, c in chars.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            self.pieces[i] = bytes(back[c] for c in body)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.lexicon: Transducer | None = None
        self.word_ids = self.word_at = None

    # words

    def normal(self, text: str) -> str:
        if self.kind == "byte":
            return text
        if text.isascii():
            return text.lower()
        if BEYOND.search(text):  # there the library's version of Unicode may differ from Python's
            return self._normalizer().normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _normalizer(self):
        if "_steps" not in self.__dict__:
            from tokenizers import normalizers

            self._steps = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        return self._steps

    def words(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        return cut(texts, self.kind)

    # merging

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words side by side, where each word's begin and the end) by exact merging."""
        count = len(starts)
        lengths = ends - starts
        long = np.flatnonzero((lengths > LONG_WORD) | (not self.ordered))
        short = np.flatnonzero((lengths <= LONG_WORD) & self.ordered)
        results: list[tuple[np.ndarray, np.ndarray]] = []  # word of each id, id
        for w in long:
            ids = self.merge_one(data[starts[w] : ends[w]])
            results.append((np.full(len(ids), w), ids))
        n = lengths[short]
        word = np.repeat(short, n)
        head = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
        place = np.arange(int(n.sum())) - np.repeat(head, n) + starts[word]
        sym = self.inner[data[place]]
        tail = head + n - 1
        sym[tail] = self.last[data[place[tail]]]
        rank, made = self._ranked(sym, word, np.arange(len(sym)))
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(sym)))
            done = np.repeat(best == NEVER, sizes)
            if done.any():
                results.append((word[done], sym[done]))
                keep = ~done
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
                best, sizes = best[best != NEVER], sizes[best != NEVER]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            if len(hit) > 1:  # of overlapping places, every other from the left
                new = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
                run = np.flatnonzero(new)
                hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            at = moved[hit]
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near], made[near] = self._ranked(sym, word, near)
        if not results:
            return np.zeros(0, np.int32), np.zeros(count + 1, np.int64)
        owners, ids = (np.concatenate(x) for x in zip(*results, strict=True))
        order = np.argsort(owners, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=count))])
        return ids[order].astype(np.int32), bounds

    def _ranked(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made symbol) of the pairs that begin ``at``."""
        rank, made = np.full(len(at), NEVER, np.int32), np.zeros(len(at), np.int32)
        inner = np.flatnonzero(at + 1 < len(sym))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        a = at[inner]
        p = self.pairs.find(sym[a].astype(np.int64) << 32 | sym[a + 1])
        inner, p = inner[p >= 0], p[p >= 0]
        rank[inner], made[inner] = self.pairs.values[p, 0], self.pairs.values[p, 1]
        return rank, made

    def merge_one(self, word: np.ndarray) -> np.ndarray:
        """Exact merging of one word with a heap: for very long words."""
        sym = [int(x) for x in self.inner[word]]
        sym[-1] = int(self.last[word[-1]])
        after, before = [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
        look = self._pair_dict()
        heap = [(*look[p], i) for i in range(len(sym) - 1) if (p := (sym[i], sym[i + 1])) in look]
        heapq.heapify(heap)
        while heap:
            rank, made, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j < 0 or look.get((sym[i], sym[j])) != (rank, made):
                continue
            sym[i], sym[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (sym[a], sym[b])) in look:
                    heapq.heappush(heap, (*look[p], a))
        return np.array([s for s in sym if s >= 0], np.int32)

    def _pair_dict(self) -> dict:
        if "_look" not in self.__dict__:
            at = np.flatnonzero(self.pairs.keys >= 0)
            self._look = {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(m)) for k, (r, m) in zip(self.pairs.keys[at], self.pairs.values[at], strict=True)}
        return self._look

    # lexicon

    def compile(self, more: list[bytes] = ()) -> Model:
        """Compiles the vocabulary's words and ``more`` into the lexicon."""
        own = {p for i, p in enumerate(self.pieces) if p and i not in set(self.special.values())}
        words = sorted(own | {w for w in more if w})
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        self.lexicon = Transducer(words)
        self.word_ids, self.word_at = self.merge(data, ends - sizes, ends)
        return self

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts side by side, where each text's begin and the end)."""
        parts, owner_of, special_at = [], [], []
        for i, text in enumerate(texts):
            if self.split and "<|" in text and self.split.search(text):
                for piece in self.split.split(text):
                    if piece in self.special:
                        special_at.append((len(parts), self.special[piece]))
                        piece = ""
                    parts.append(self.normal(piece))
                    owner_of.append(i)
            else:
                parts.append(self.normal(text))
                owner_of.append(i)
        data, bounds, owner = self.words(parts)
        keep = owner >= 0
        array = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)[keep]
        owner = owner[keep]
        ids, at = self.encode_words(coded.dictionary)
        if special_at:  # each as a word of its own, in its place
            extra = np.array([s for _, s in special_at], np.int32)
            where = np.array([p for p, _ in special_at])
            index = np.concatenate([index, len(at) - 1 + np.arange(len(extra))])
            owner = np.concatenate([owner, where])
            order = np.argsort(owner, kind="stable")
            index, owner = index[order], owner[order]
            at = np.concatenate([at, at[-1] + 1 + np.arange(len(extra))])
            ids = np.concatenate([ids, extra])
        sizes = np.diff(at)[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.arange(total) + np.repeat(at[index] - ends + sizes, sizes)] if total else np.zeros(0, np.int32)
        by_text = np.bincount(np.array(owner_of, np.int64)[owner], weights=sizes, minlength=len(texts)).astype(np.int64)
        return flat.astype(np.uint32), np.concatenate([[0], np.cumsum(by_text)])

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct words: from the lexicon where it has them, else merged."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        starts, ends = offsets[:-1], offsets[1:]
        rank = self.lexicon.find(data, starts, ends) if self.lexicon else np.full(len(starts), -1, np.int64)
        new = np.flatnonzero(rank < 0)
        merged, bounds = self.merge(data, starts[new], ends[new])
        sizes = np.empty(len(starts), np.int64)
        begin = np.empty(len(starts), np.int64)
        sizes[new], begin[new] = np.diff(bounds), bounds[:-1]
        known = np.flatnonzero(rank >= 0)
        if len(known):
            r = rank[known]
            begin[known] = len(merged) + self.word_at[r]
            sizes[known] = self.word_at[r + 1] - self.word_at[r]
            merged = np.concatenate([merged, self.word_ids])
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = merged[np.arange(total) + np.repeat(begin - stops + sizes, sizes)] if total else np.zeros(0, np.int32)
        return ids, np.concatenate([[0], stops])

    def decode_bytes(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts side by side, bounds)."""
        ids = ids.astype(np.int64)
        sizes = self.piece_len[ids]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        flat = self.piece_bytes[np.arange(total) + np.repeat(self.piece_at[ids] - stops + sizes, sizes)] if total else np.zeros(0, np.uint8)
        return flat.tobytes(), np.concatenate([[0], stops])[at]


_MAPPED: dict[str, Model] = {}


class Shared:
    """A model as executors see it: its tables broadcast once, its lexicon a file that Spark brings to each machine once.

    The file is written to the shared folder and added to the session; all workers of a machine map the same pages of it.
    """

    def __init__(self, spark: SparkSession, model: Model):
        self.file = f"lexicon-{uuid.uuid4().hex}"
        if model.lexicon:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{self.file}")
            stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path)
            stream.write(model.lexicon.stored())
            stream.close()
            spark.sparkContext.addFile(path.toString())
        self.held = spark.sparkContext.broadcast(model)

    def get(self) -> Model:
        if self.file not in _MAPPED:
            model = self.held.value
            if model.lexicon:
                model.lexicon.mapped(SparkFiles.get(self.file))
            _MAPPED.clear()
            _MAPPED[self.file] = model
        return _MAPPED[self.file]


def frequent_words(model: Model, df: DataFrame, text: str, longest: int, most: int) -> list[bytes]:
    """The most frequent words of at most ``longest`` bytes, counted over every row; only speed depends on them.

    Words of close counts come together, as many such classes as ``most`` words allow, so no more than those are gathered.
    """

    def part(batch: pa.RecordBatch) -> dict:
        data, bounds, owner = model.words([model.normal(t) for t in texts_of(batch, "__t")])
        array = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        counts = array.filter(pa.array((owner >= 0) & (np.diff(bounds) <= longest))).value_counts()
        return {"word": counts.field("values"), "n": counts.field("counts")}

    scratch = Scratch(df.sparkSession)
    try:
        every = df.select(F.col(text).alias("__t"))
        counted = arrow_map(every, ["__t"], "word binary, n long", part, "__t").groupBy("word").agg(F.sum("n").alias("n"))
        counted = scratch.written(counted.where("n > 1"))
        classes = counted.groupBy(F.floor(F.log2("n") * 8).alias("class")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("words")).collect()
        total, least = 0, None
        for c in sorted(classes, key=lambda c: -c.least):
            total += c.words
            if total > most:
                break
            least = c.least
        return [] if least is None else [bytes(r.word) for r in counted.where(F.col("n") >= least).collect()]
    finally:
        scratch.clear()


def shared_model(spark: SparkSession, path: str, df: DataFrame, text: str = "text", longest: int = 64, most: int = 100_000) -> Shared:
    """The model of a tokenizer file, with the lexicon of its own words and the frequent ones of the whole ``df``."""
    model = Model(path)
    return Shared(spark, model.compile(frequent_words(model, df, text, longest, most)))


def encode_texts(df: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id and ``ids`` (array) of each row."""
    shared = shared_model(df.sparkSession, path, df, text)

    def part(batch: pa.RecordBatch) -> dict:
        ids, at = shared.get().encode(texts_of(batch, "__t"))
        return {id_column: batch.column("__i"), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))}

    kind = df.schema[id_column].dataType.simpleString()
    return arrow_map(df.selectExpr(f"`{id_column}` AS __i", f"`{text}` AS __t"), ["__i", "__t"], f"{id_column} {kind}, ids array<int>", part, "__t")


def decode_ids(df: DataFrame, path: str, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """The id and ``text`` of each row's array of token ids; null arrays count as empty."""
    model = Model(path)
    shared = Shared(df.sparkSession, model)

    def part(batch: pa.RecordBatch) -> dict:
        lists = [x or [] for x in batch.column("__d").to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        data, bounds = shared.get().decode_bytes(np.array([i for x in lists for i in x], np.int64), at)
        return {id_column: batch.column("__i"), "text": [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]}

    kind = df.schema[id_column].dataType.simpleString()
    sized = df.selectExpr(f"`{id_column}` AS __i", f"`{ids}` AS __d", f"repeat(' ', coalesce(size(`{ids}`), 0)) AS __n")
    return arrow_map(sized, ["__i", "__d", "__n"], f"{id_column} {kind}, text string", part, "__n")


def round_trip(df: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256, decoded_sha256."""
    shared = shared_model(df.sparkSession, path, df, text)

    def part(batch: pa.RecordBatch) -> dict:
        model = shared.get()
        ids, at = model.encode(texts_of(batch, "__t"))
        data, bounds = model.decode_bytes(ids, at)
        raw = ids.astype("<u4").tobytes()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return {
            id_column: batch.column("__i"),
            "n_tokens": np.diff(at),
            "ids_sha256": [sha(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)],
            "decoded_sha256": [sha(data[a:b].decode("utf-8", "replace").encode()) for a, b in zip(bounds, bounds[1:], strict=False)],
        }

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(df.selectExpr(f"`{id_column}` AS __i", f"`{text}` AS __t"), ["__i", "__t"], schema, part, "__t")


def op4_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
