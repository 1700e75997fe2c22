"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of a vector of its own, if it is frequent in training, and the mean of hashed vectors of its
character n-grams, so that inflected or altered forms share what was learned. Windows of ``WINDOW`` words, ``STRIDE`` apart, cover a text whole; a
gated recurrent network reads each in both directions, attention pools its states to one logit, and a text's score is
that of its worst window. Training minimises the log loss of texts whose windows are pooled by a soft maximum.

Training takes at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled rows of up to ``MOST_CHARS`` characters, chosen by hash
of their ids among rows with crc32(id as text) mod 3 other than 1; the bound keeps it on the driver. Scoring is narrow:
weights of a few MB are broadcast, and slices of bounded size are scored task by task.

Every step takes whole texts, however long, and their number is the same for every sample.

Nulls and texts without a word score 0. Without labelled rows of both classes there is nothing to learn: all score 0.
Rows that repeat score alike, an empty table gives an empty result, and other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, character_classes, cut
from .common import SLICE_BYTES, arrow_map, small_batches, table, texts_of

WINDOW, STRIDE = 48, 32
DIM, HIDDEN = 16, 12
GRAM_ROWS = 1 << 15
#: Words that occur less often in the training texts have no vector of their own, only their grams.
LEAST_SEEN = 3
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1500, 4000, 8000
STEPS, BATCH_WINDOWS, RATE, SHARPNESS = 240, 400, 0.02, 3.0
THRESHOLD = 0.7


def coded(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the words of all texts as codes of distinct ones, number of words of each text)."""
    data, bounds, owner = cut([t.lower() for t in texts], "word")
    if not len(owner):
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts), np.int64)
    first = np.frombuffer(data, np.uint8)[bounds[:-1]]
    keep = (owner >= 0) & ((first >= 128) | ((first >= 97) & (first <= 122)))
    wide = np.flatnonzero(keep & (first >= 128))
    if len(wide):  # beyond ASCII, letters only
        heads = [data[bounds[i] : bounds[i] + 4].decode("utf-8", "ignore")[:1] for i in wide]
        keep[wide] = character_classes()[[ord(h) if h else 0 for h in heads]] == LETTER
    array = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
    return array.filter(pa.array(keep)).dictionary_encode(), np.bincount(owner[keep], minlength=len(texts))


def inputs(texts: list[str], at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(index of each word among the distinct ones, bounds by text, features of the distinct words).

    Texts are cut about ``at_once`` characters at a time, which bounds the memory for it.
    """
    parts, counts, start, held = [], [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > at_once or i + 1 == len(texts):
            part, count = coded(texts[start : i + 1])
            parts.append(part)
            counts.append(count)
            start, held = i + 1, 0
    if not parts:
        parts, counts = [coded([])[0]], [np.zeros(0, np.int64)]
    together = pa.chunked_array(parts).unify_dictionaries()
    words = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in together.chunks]).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(np.concatenate(counts))]), features(together.chunk(0).dictionary)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(words: pa.Array, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``some_features`` of all words, some at a time to bound the memory for it."""
    parts = [some_features(words.slice(i, at_once)) for i in range(0, max(len(words), 1), at_once)]
    hashes, grams, at = zip(*parts, strict=True)
    before = np.cumsum([0, *map(len, grams[:-1])])
    return np.concatenate(hashes), np.concatenate(grams), np.concatenate([a + b for a, b in zip(at, before, strict=True)])


def some_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, rows of its 3- and 4-byte grams, where each word's grams begin)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    n = len(sizes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    at = np.cumsum(sizes + 2) - sizes - 2  # each word between two marks
    flat = np.full(int((sizes + 2).sum()) + 3, 1, np.uint64)
    flat[np.arange(len(data)) + np.repeat(at - (offsets[:-1] - offsets[0]) + 1, sizes)] = data
    place = np.arange(len(flat) - 3) - np.repeat(at, sizes + 2)
    power = np.uint64(1_000_003) ** np.arange(int(place.max(initial=0)) + 1, dtype=np.uint64)
    word_hash = mixed(np.add.reduceat(flat[:-3] * power[place], at))
    three = flat[:-3] << np.uint64(16) | flat[1:-2] << np.uint64(8) | flat[2:-1]
    four = three << np.uint64(8) | flat[3:] | np.uint64(1 << 40)
    left = np.repeat(sizes + 2, sizes + 2) - place
    rows3, rows4 = (mixed(x) % np.uint64(GRAM_ROWS) for x in (three, four))
    ok3, ok4 = left >= 3, left >= 4
    grams = np.stack([rows3, rows4], 1).reshape(-1).astype(np.int32)
    grams = grams[np.stack([ok3, ok4], 1).reshape(-1)]
    count = sizes + np.maximum(sizes - 1, 0)
    return word_hash, grams, np.cumsum(count) - count


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of all windows; the last of a text ends with it."""
    n = np.diff(bounds)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return bounds[text] + start, np.minimum(n[text], WINDOW), text


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights: vectors of the known words W (row 0: all others) and grams G; per direction input A, state U and bias B; attention P, q; output o, b."""

    def __init__(self, seed: int = 7, known: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.known = np.zeros(0, np.uint64) if known is None else known  # sorted hashes
        new = lambda *shape, s=0.2: (rng.standard_normal(shape) * s).astype(np.float32)
        h = HIDDEN
        self.w = {"W": np.zeros((len(self.known) + 1, DIM), np.float32), "G": new(GRAM_ROWS, DIM, s=0.1), "P": new(2 * h, h), "q": new(h), "o": new(2 * h), "b": np.full(1, -1, np.float32)}
        for d in "fr":
            self.w |= {f"A{d}": new(DIM, 3 * h, s=0.3), f"U{d}": new(h, 3 * h, s=0.3), f"B{d}": np.zeros(3 * h, np.float32)}

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def vectors(self, feats: tuple) -> np.ndarray:
        hashes, grams, at = feats
        if not len(hashes):
            return np.zeros((0, DIM), np.float32)
        count = np.diff(np.append(at, len(grams)))
        return self.w["W"][self.rows(hashes)] + np.add.reduceat(self.w["G"][grams], at) / count[:, None].astype(np.float32)

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: ``index`` (windows, words) into the vectors ``x``, ``mask`` for words that are there."""
        h, (n, t) = HIDDEN, index.shape
        states = np.zeros((t, n, 2 * h), np.float32)
        saved = {}
        for d in "fr":
            gx = x @ self.w[f"A{d}"] + self.w[f"B{d}"]
            u = self.w[f"U{d}"]
            s = np.zeros((n, h), np.float32)
            side = slice(0, h) if d == "f" else slice(h, 2 * h)
            steps = []
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                a = gx[index[:, i]]
                c = s @ u
                zr = sigmoid(a[:, : 2 * h] + c[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(a[:, 2 * h :] + r * c[:, 2 * h :])
                m = mask[:, i : i + 1]
                after = s + m * (1 - z) * (new - s)
                if keep:
                    steps.append((i, s, z, r, new, c[:, 2 * h :]))
                s = after
                states[i][:, side] = s
            saved[d] = steps
        tanh = np.tanh(states @ self.w["P"])
        e = tanh @ self.w["q"] + (mask.T - 1) * 1e4
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = (e[..., None] * states).sum(0)
        logits = pooled @ self.w["o"] + self.w["b"][0]
        return (logits, (states, saved, tanh, e, pooled)) if keep else logits

    def backward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, kept: tuple, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """(gradients of the small weights, gradient by vector in ``x``)."""
        h = HIDDEN
        states, saved, tanh, e, pooled = kept
        g = {"o": pooled.T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.w["o"]
        ds = e[..., None] * dpool
        de = (states * dpool).sum(-1)
        de = e * (de - (e * de).sum(0))
        dt = de[..., None] * self.w["q"] * (1 - tanh * tanh)
        g["q"] = np.tensordot(de, tanh, ((0, 1), (0, 1)))
        g["P"] = np.tensordot(states, dt, ((0, 1), (0, 1)))
        ds += dt @ self.w["P"].T
        dx = np.zeros_like(x)
        for d in "fr":
            u, side = self.w[f"U{d}"], slice(0, h) if d == "f" else slice(h, 2 * h)
            du, dgx = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
            back = np.zeros((len(index), h), np.float32)
            for i, s, z, r, new, cn in reversed(saved[d]):
                back = back + ds[i][:, side]
                m = mask[:, i : i + 1]
                dnew = back * m * (1 - z) * (1 - new * new)
                dz = -back * m * (new - s) * z * (1 - z)
                dr = dnew * cn * r * (1 - r)
                da = np.concatenate([dz, dr, dnew], 1)
                dc = np.concatenate([dz, dr, dnew * r], 1)
                du += s.T @ dc
                np.add.at(dgx, index[:, i], da)
                back = back * (1 - m * (1 - z)) + dc @ u.T
            g[f"U{d}"], g[f"B{d}"] = du, dgx.sum(0)
            g[f"A{d}"] = x.T @ dgx
            dx += dgx @ self.w[f"A{d}"].T
        return g, dx

    def grid(self, starts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, mask) of windows; places past a short window repeat its last word, masked."""
        step = np.arange(int(sizes.max(initial=1)))
        index = words[starts[:, None] + np.minimum(step, sizes[:, None] - 1)]
        return index, (step < sizes[:, None]).astype(np.float32)

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
        """Trained by ``steps`` steps, whatever the number of texts, each on all windows of some texts in shuffled order."""
        rng = np.random.default_rng(seed)
        words, bounds, feats = inputs(texts)
        starts, sizes, owner = windows(bounds)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        hashes, grams, at = feats
        self.__init__(known=np.sort(hashes[np.bincount(words, minlength=len(hashes)) >= LEAST_SEEN]))
        scale = {k: np.full_like(v, 1e-8) if k not in ("W", "G") else np.full(len(v), 1e-8, np.float32) for k, v in self.w.items()}
        count = np.diff(np.append(at, len(grams)))
        many = np.diff(first)
        order: list[int] = []
        for step in range(steps if many.any() else 0):
            rate = RATE * (1 - 0.8 * step / max(1, steps - 1))
            batch: list[int] = []
            held = 0
            while held < BATCH_WINDOWS and len(batch) < len(texts):
                order = order or rng.permutation(len(texts)).tolist()
                batch.append(order.pop())
                held += many[batch[-1]]
            doc = np.repeat(np.arange(len(batch)), many[batch])
            pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch]).astype(np.int64)
            y = labels[batch].astype(np.float32)
            if not len(pick):
                continue
            index, mask = self.grid(starts[pick], sizes[pick], words)
            used, index = np.unique(index, return_inverse=True)
            index = index.reshape(len(pick), -1)
            sub = (hashes[used], np.concatenate([grams[a : a + c] for a, c in zip(at[used], count[used], strict=True)]), np.cumsum(count[used]) - count[used])
            x = self.vectors(sub)
            logits, kept = self.forward(x, index, mask, True)
            top = np.full(len(y), -np.inf, np.float32)
            np.maximum.at(top, doc, logits)
            soft = np.exp(SHARPNESS * (logits - top[doc]))
            soft /= np.bincount(doc, soft, len(y))[doc]
            z = np.bincount(doc, soft * logits, len(y))
            dz = (sigmoid(z) - y) / max(1, len(np.unique(doc)))
            dlogit = (soft * dz[doc]).astype(np.float32)
            g, dx = self.backward(x, index, mask, kept, dlogit)
            for k, v in g.items():
                scale[k] = 0.95 * scale[k] + 0.05 * v * v
                self.w[k] -= rate * 0.3 * v / (np.sqrt(scale[k]) + 1e-6)
            own = self.rows(sub[0])
            self._rows("W", own[own > 0], dx[own > 0], scale["W"], rate)
            spread = np.repeat(dx / count[used][:, None], count[used], 0).astype(np.float32)
            self._rows("G", sub[1], spread, scale["G"], rate)
        return self

    def _rows(self, name: str, rows: np.ndarray, grad: np.ndarray, scale: np.ndarray, rate: float) -> None:
        """A step of row-wise adaptive descent on the vectors that were used."""
        if not len(rows):
            return
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total = np.add.reduceat(grad[order], heads)
        used = rows[heads]
        scale[used] = 0.9 * scale[used] + 0.1 * (total * total).mean(1)
        self.w[name][used] -= rate * 0.5 * total / (np.sqrt(scale[used])[:, None] + 1e-5)

    def score(self, texts: list[str], at_once: int = 4096) -> np.ndarray:
        """A score from 0 to 1 for each text: that of its worst window; 0 without words."""
        words, bounds, feats = inputs(texts)
        starts, sizes, owner = windows(bounds)
        x = self.vectors(feats)
        top = np.full(len(texts), -np.inf)
        order = np.argsort(sizes, kind="stable")  # windows of like lengths together
        for a in range(0, len(order), at_once):
            pick = order[a : a + at_once]
            index, mask = self.grid(starts[pick], sizes[pick], words)
            np.maximum.at(top, owner[pick], self.forward(x, index, mask))
        return np.round(sigmoid(np.maximum(top, -60)), 6) * (top > -np.inf)


def fold(id_column) -> F.Column:
    """crc32 of an id as text, mod 3; null ids count as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int, most_chars: int) -> DataFrame:
    """(text, toxic) of the bounded sample; its ids, bounded too, are broadcast to the texts."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    by_hash = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = by_hash(1, most_toxic).unionByName(by_hash(0, most_clean)).select(F.col("doc_id").alias("__id"), "toxic")
    texts = docs.select(F.col("doc_id").alias("__id"), "text").where(F.col("text").isNotNull() & (F.char_length("text") <= most_chars))
    return texts.join(F.broadcast(chosen), "__id").orderBy("__id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS) -> Network | None:
    """The network fitted to the bounded sample; None where it lacks one of the classes."""
    rows = training_rows(docs, labels, most_toxic, most_clean, most_chars).collect()
    y, texts = np.array([r.toxic for r in rows], np.int64), [r.text for r in rows]
    del rows
    if not len(y) or y.min() == y.max():
        return None
    return Network().fit(texts, y)


def score_texts(df: DataFrame, network: Network | None, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``df``: the id, held_out, score, predicted."""
    held = df.sparkSession.sparkContext.broadcast(network)

    def part(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch, "__t")
        score = held.value.score(texts) if held.value else np.zeros(len(texts))
        return {id_column: batch.column("__i"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    kind = df.schema[id_column].dataType.simpleString()
    out = arrow_map(df.selectExpr(f"`{id_column}` AS __i", f"`{text}` AS __t"), ["__i", "__t"], f"{id_column} {kind}, score double, predicted int", part, "__t")
    return out.select(id_column, (fold(F.col(id_column)) == 1).alias("held_out"), "score", "predicted")


def drop_toxic(df: DataFrame, network: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without the rows whose text scores ``threshold`` or more."""
    held = df.sparkSession.sparkContext.broadcast(network)
    if network is None:
        return df
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep, start, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > SLICE_BYTES or i + 1 == len(texts):
                    keep.append(held.value.score(texts[start : i + 1]) < threshold)
                    start, size = i + 1, 0
            if keep:
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(np.concatenate(keep))).columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def op7_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
