"""Cost-balanced packing of token ids into fixed-length sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: the attention inside a document grows with its square. Long
documents are cut to full sequences and a rest. Of each block of rests, as many sequences are opened as the block's tokens
fill, and the documents, by descending length, go to the sequence of lowest cost among those with room; one that fits
nowhere is cut to fill the cheapest open sequence. What the block's sequences can't hold waits for the next block, and the
last tokens of a task go to sequences of power-of-two lengths, which need no padding.

Each task packs its own rows, block by block: no shuffle, bounded memory, and a lost task is packed again to the same
sequences. Null texts are empty documents, of which only the end token is left. Ids may repeat or be
null, an empty table gives no pieces, and other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import shared_model
from .common import slices, small_batches, table, texts_of

LENGTH = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
BLOCK_TOKENS = 1 << 20
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


class Packer:
    """Packs documents (key, ids) that come one after another; pieces are (key, start, ids, document's tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.next, self.length = first_sequence, length
        self.pool: list[tuple] = []  # (key, start, ids, document's tokens)
        self.held = 0

    def open(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        """Takes a document; gives the full sequences that it fills alone."""
        full = len(ids) // self.length * self.length
        for at in range(0, full, self.length):
            yield key, at, ids[at : at + self.length], len(ids), self.open(), 0
        if full < len(ids):
            self.pool.append((key, full, ids[full:], len(ids)))
            self.held += len(ids) - full

    def settle(self) -> Iterator[tuple]:
        """Packs the pool to full sequences and keeps what is left over."""
        count = self.held // self.length
        if not count:
            return
        first = self.next
        self.next += count
        room = np.full(count, self.length)
        costs = np.zeros(count)
        rest = []
        for key, start, ids, total in sorted(self.pool, key=lambda p: -len(p[2])):
            while len(ids):
                fits = np.flatnonzero(room >= len(ids))
                if not len(fits):
                    fits = np.flatnonzero(room)
                    if not len(fits):
                        rest.append((key, start, ids, total))
                        break
                s = int(fits[np.argmin(costs[fits])])
                n = min(len(ids), int(room[s]))
                yield key, start, ids[:n], total, first + s, self.length - int(room[s])
                room[s] -= n
                costs[s] += cost(n)
                start, ids = start + n, ids[n:]
        self.pool, self.held = rest, sum(len(p[2]) for p in rest)

    def finish(self) -> Iterator[tuple]:
        """Packs all that is held; the last tokens go to sequences of power-of-two lengths."""
        yield from self.settle()
        left, pool = self.held, self.pool[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            sequence, offset = self.open(), 0
            left -= room
            while room:
                key, start, ids, total = pool.pop()
                n = min(room, len(ids))
                yield key, start, ids[:n], total, sequence, offset
                if n < len(ids):
                    pool.append((key, start + n, ids[n:], total))
                room, offset = room - n, offset + n
        self.pool, self.held = [], 0


def pack(df: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", end_id: int = 1, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each piece: the id and ``PIECES``. Sequences are numbered by task, then by order in it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    shared = shared_model(df.sparkSession, path, df, text)
    schema = StructType.fromDDL(f"{id_column} {df.schema[id_column].dataType.simpleString()}, {PIECES}")
    arrow = to_arrow_schema(schema)

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        key, start, ids, total, sequence, offset = zip(*pieces, strict=True)
        columns = [key, start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], total, sequence, offset]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.get()
        packer = Packer(TaskContext.get().partitionId() << 33, length)
        end = np.array([end_id], np.uint32)
        for part in slices(batches, "__t"):
            ids, at = model.encode(texts_of(part, "__t"))
            pieces = []
            for key, a, b in zip(part.column("__i").to_pylist(), at, at[1:], strict=False):
                pieces += packer.add(key, np.concatenate([ids[a:b], end]))
            if packer.held >= block_tokens:
                pieces += packer.settle()
            if pieces:
                yield batch_of(pieces)
        if pieces := list(packer.finish()):
            yield batch_of(pieces)

    return df.selectExpr(f"`{id_column}` AS __i", f"`{text}` AS __t").mapInArrow(run, schema)


def op6_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
