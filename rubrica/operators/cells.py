"""Cells of near vectors: a tree of pivots, and joins of vectors with the blocks that can hold near ones.

Rows (key, v of unit length, weight) are split into cells of the nearest pivot; a cell of more than ``block_rows`` rows is
split again, by pivots among its own rows, so that the depth follows the row count and every leaf is a block of bounded
size. A row can only be near rows of a cell whose pivot is no further from it than its reach and the cell's radius (the
triangle inequality); it goes down the tree to the leaves that are left. Cells of many rows, and leaves that many rows ask,
are dealt to several tasks. Pivots are tables, never gathered; rows meet them by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of a leaf at most, pivots that a cell is split by at most, and pairs of a block and a slice that a task holds at once.
BLOCK_ROWS, FAN, PAIRS = 16_384, 64, 4 << 20
#: Bytes of a packed block.
PACKED_BYTES = 5 << 20
#: Slack of the triangle inequality for rounding.
SLACK = 1e-7


def distances(a, b):
    """Euclidean distances of the rows of two arrays."""
    import numpy as np

    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def matrix(column: pa.Array):
    """An array of vectors of one width as a matrix."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def pairs_of_blocks(rows: DataFrame, block_rows: int, parts: tuple[int, int]) -> DataFrame:
    """q, own, b, other: each block of ``rows`` with each, both as Arrow streams of up to ``block_rows`` rows
    or about PACKED_BYTES bytes; q and b name them.

    Blocks lie in the shared folder once, in ``parts[0]`` partitions, and each of ``parts[1]`` groups of those meets each of them by
    a Cartesian product of partitions, which shuffles nothing. A task holds one group; the pairs of a q come together in it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count, most = [], 0, None

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema) as writer:
                writer.write_table(pa.Table.from_batches(waiting).combine_chunks())
            return pa.RecordBatch.from_pydict({"block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            if most is None and batch.num_rows:
                most = max(1, min(block_rows, PACKED_BYTES * batch.num_rows // max(1, batch.nbytes)))
            while batch.num_rows:
                waiting.append(batch.slice(0, most - count))
                count += waiting[-1].num_rows
                batch = batch.slice(waiting[-1].num_rows)
                if count == most:
                    yield out()
                    waiting, count = [], 0
        if waiting:
            yield out()

    blocks = cut(rows.repartition(parts[0], "key").mapInArrow(pack, "block binary").withColumn("id", F.monotonically_increasing_id()))
    other = blocks.select(F.col("id").alias("b"), F.col("block").alias("other")).coalesce(parts[1])
    return blocks.select(F.col("id").alias("q"), F.col("block").alias("own")).crossJoin(other.hint("shuffle_replicate_nl"))


def unpacked(block: bytes) -> pa.Table:
    """The rows of a packed block."""
    with pa.ipc.open_stream(block) as reader:
        return reader.read_all().combine_chunks()


def met_by(held: DataFrame, asked: DataFrame, by: list[str], schema: str, fn: Callable) -> DataFrame:
    """``fn(held rows, a slice of asked rows)`` for each group of ``by``, both as record batches of the columns that the
    tables have in common with the other's as null. A task holds a group's held rows and one slice of its asked ones.
    """
    both = held.withColumn("__role", F.lit(0)).unionByName(asked.withColumn("__role", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "__role"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        group, kept, block, waiting, count, held_rows = None, [], None, [], 0, 0

        def out():
            nonlocal block
            if not (kept and waiting):
                return None
            block = pa.Table.from_batches(kept).combine_chunks().to_batches(1 << 30)[0] if block is None else block
            return fn(block, pa.Table.from_batches(waiting).combine_chunks().to_batches(1 << 30)[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(b).to_pylist() for b in [*by, "__role"]), strict=True))
            starts = [0, *(np.flatnonzero([x != y for x, y in zip(keys, keys[1:], strict=False)]) + 1).tolist(), len(keys)]
            for start, stop in zip(starts, starts[1:], strict=False):
                *own, role = keys[start]
                if own != group:
                    if (done := out()) is not None:
                        yield done
                    group, kept, block, waiting, count, held_rows = own, [], None, [], 0, 0
                part = batch.slice(start, stop - start)
                if not role:
                    kept.append(part)
                    held_rows += part.num_rows
                    continue
                most = min(8192, max(64, PAIRS // max(1, held_rows)))
                while part.num_rows:
                    take = part.slice(0, most - count)
                    waiting.append(take)
                    count += take.num_rows
                    part = part.slice(take.num_rows)
                    if count == most:
                        if (done := out()) is not None:
                            yield done
                        waiting, count = [], 0
        if (done := out()) is not None:
            yield done

    dealt = both.repartition(*by).sortWithinPartitions(*by, "__role").select(*names, "__role")
    return dealt.mapInArrow(run, schema)


def in_parts(df: DataFrame, cell: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(``df`` with part, a table of cell and part): each cell dealt to as many parts as hold about ``rows`` rows each."""
    sizes = df.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    dealt = df.join(sizes, cell).withColumn("part", F.pmod(F.xxhash64("key", "v"), "parts").cast("int")).drop("parts")
    return dealt, sizes.select(cell, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


class PivotTree:
    """The cells of ``rows`` (key, v, weight, any others); ``placed`` has each row with its leaf."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS, fan: int = FAN):
        self.block_rows, self.fan = block_rows, fan
        #: A table for each level: cell, leaf (of its parts), pivot, radius.
        self.levels: list[DataFrame] = []
        self.key = rows.schema["key"].dataType.simpleString()
        left, settled = cut(rows.select("key", "v", "weight", F.lit("").alias("leaf"))), None
        while True:
            sizes = left.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
            large = cut(sizes.withColumn("p", F.least(F.lit(fan), F.ceil(F.col("n") * 2 / block_rows)).cast("int")))
            done = left.join(large, "leaf", "left_anti")
            settled = done if settled is None else settled.unionByName(done)
            if large.isEmpty():
                break
            left = self._split(left, large)
        self.placed = settled

    def _split(self, left: DataFrame, large: DataFrame) -> DataFrame:
        depth = len(self.levels)
        open_ = left.join(large, "leaf")
        draw = F.pmod(F.xxhash64("key", F.lit(depth)), F.lit(1 << 40)) / (1 << 40)
        few = open_.withColumn("draw", draw).where(F.col("draw") * F.col("n") < F.greatest(F.lit(32), F.col("p") * 4))
        rank = F.row_number().over(Window.partitionBy("leaf").orderBy("draw", "key"))  # of a bounded draw of each cell
        pivots = cut(few.withColumn("rank", rank).where(F.col("rank") <= F.col("p")).select("leaf", F.concat_ws("/", "leaf", "rank").alias("child"), F.col("v").alias("pivot")))
        dealt, parts = in_parts(open_.select("leaf", "key", "v", "weight", F.pmod(F.xxhash64("key"), F.lit(1 << 20)).alias("tie")), "leaf", 64 * self.block_rows)

        def nearest(own: pa.RecordBatch, ask: pa.RecordBatch) -> pa.RecordBatch:
            import numpy as np

            d = distances(matrix(ask.column("v")), matrix(own.column("pivot")))
            first = d <= d.min(1)[:, None]  # equal vectors go to equal pivots in turn, so that a cell of copies is split too
            best = (first.cumsum(1) == (ask.column("tie").to_numpy() % first.sum(1) + 1)[:, None]).argmax(1)
            columns = [ask.column(c) for c in ("key", "v", "weight")]
            return pa.RecordBatch.from_arrays([*columns, own.column("child").take(pa.array(best)), pa.array(d[np.arange(len(d)), best])], ["key", "v", "weight", "leaf", "d"])

        schema = f"key {self.key}, v array<double>, weight long, leaf string, d double"
        moved = cut(met_by(pivots.join(parts, "leaf"), dealt, ["leaf", "part"], schema, nearest))
        radius = moved.groupBy(F.col("leaf").alias("child")).agg(F.max("d").alias("radius"))
        self.levels.append(cut(pivots.join(radius, "child").select(F.col("leaf").alias("cell"), F.col("child").alias("leaf"), "pivot", "radius")))
        return moved.drop("d")

    def _down(self, rows: DataFrame, fn: Callable) -> DataFrame:
        """key, leaf: ``rows`` (key, v, weight, any others; unique keys) led from level to level by ``fn``, which says which cells
        of a level a row goes on to. Only keys are kept from level to level, not the vectors, of which there are many copies."""
        left, settled = cut(rows.select("key", F.lit("").alias("leaf"))), None  # cut, as a join by a constant becomes one without keys
        for level in self.levels:
            cells = level.select(F.col("cell").alias("leaf")).distinct()
            done = left.join(cells, "leaf", "left_anti")
            settled = done if settled is None else settled.unionByName(done)
            going = left.join(cells, "leaf", "left_semi").withColumnRenamed("leaf", "cell").join(rows, "key")
            dealt, parts = in_parts(going, "cell", 64 * self.block_rows)
            kind = rows.schema["key"].dataType.simpleString()
            left = cut(met_by(level.join(parts, "cell"), dealt, ["cell", "part"], f"key {kind}, leaf string", fn))
        return left if settled is None else settled.unionByName(left)

    def asked(self, rows: DataFrame) -> DataFrame:
        """key, leaf: ``rows`` (with reach) at each leaf that can hold a row within their reach."""

        def near(own: pa.RecordBatch, ask: pa.RecordBatch) -> pa.RecordBatch:
            import numpy as np

            limit = ask.column("reach").to_numpy()[:, None] + own.column("radius").to_numpy()[None] + SLACK
            i, j = np.nonzero(distances(matrix(ask.column("v")), matrix(own.column("pivot"))) <= limit)
            return pa.RecordBatch.from_arrays([ask.column("key").take(pa.array(i)), own.column("leaf").take(pa.array(j))], ["key", "leaf"])

        return self._down(rows, near)

    def home(self, rows: DataFrame) -> DataFrame:
        """key, leaf: ``rows`` at the leaf of the nearest pivots, where rows near them are likely."""

        def nearest(own: pa.RecordBatch, ask: pa.RecordBatch) -> pa.RecordBatch:
            best = distances(matrix(ask.column("v")), matrix(own.column("pivot"))).argmin(1)
            return pa.RecordBatch.from_arrays([ask.column("key"), own.column("leaf").take(pa.array(best))], ["key", "leaf"])

        return self._down(rows, nearest)

    def blocks(self, asked: DataFrame, rows: DataFrame, schema: str, fn: Callable, held: DataFrame | None = None) -> DataFrame:
        """``fn(a leaf's rows, a slice of the rows that ask it)``: ``rows`` (key, v, weight, any others) as ``asked`` (key, leaf);
        ``held``: the tree's rows (with leaf) or some of them."""
        dealt, parts = in_parts(asked.join(rows, "key"), "leaf", 32 * self.block_rows)
        return met_by((self.placed if held is None else held).join(parts, "leaf"), dealt, ["leaf", "part"], schema, fn)
