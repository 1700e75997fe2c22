"""Conversation structure repair: the cheapest edits that give a conversation its form, by bidirectional Dijkstra.

A conversation's rows, in the order of turn (nulls first), then role, then text, are edited until their roles' initials are
``(s?(ua)+)?``. The edit lattice has a node for each number of rows used up and each state of that form (start, after s,
after u, after a). A letter string names a path, and so an audit: K keeps a row, R gives it the role that the form asks
for, D deletes it, I inserts an empty row. A heap from the first node and one from the accepted last nodes grow towards
each other until no cheaper or equal crossing can be left; of all crossings of least cost, the least concatenated letters
win. Nodes of equal distance leave a heap in the order of rows, so that a node's least letters are known when it leaves:
two audits of equal cost that end in one node are never one the other's beginning, since more letters for as many rows are
more inserts, which cost.

Rows are dealt by ranges of (conversation, turn, role, text), rows that repeat in full having been counted first, so that
a conversation of any length is cut where partitions end. A conversation within one partition is repaired where it lies.
Of those cut (at most one a partition's end), segments of at most ``SEGMENT`` rows give the least edits from each state to
each other, which are then joined pairwise, letter strings included; only the digest of the repaired text, which has to be
taken in order, and the audit, a letter a row, pass one task for each such conversation, segment by segment.

Nulls in role and text, and in the checksum's conversation and turn, count as one blank; null conversations are one, null
turns come first. Empty texts and roles, very long texts and repeated rows are ordinary rows. An empty table gives an empty
one. Gaps beyond a long are null. Other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .common import Scratch, small_batches, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The next state after each initial that the form allows.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a reroled or inserted row takes in each state, and the state after it.
GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ENDS = (START, ASSISTANT)
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a segment, within which a path is searched at once.
SEGMENT = 512
#: A row as the lattice sees it: initial, fault ("", "blank", "duplicate", "truncated") and how often it stands there.
Row = tuple[str, str, int]


# one stretch of rows


class Lattice:
    """Edges between nodes (rows used up, state); ``rows`` are those of one stretch."""

    def __init__(self, rows: list[Row]):
        self.rows = rows

    def _steps(self, row: Row, state: int) -> Iterator[tuple[int, int, str]]:
        initial, fault, many = row
        if fault in ("blank", "duplicate"):
            yield state, DELETE * many, "D" * many
            return
        rest, letters = DELETE * (many - 1), "D" * (many - 1)  # the row's repeats are duplicates
        extra = TRUNCATED if fault == "truncated" else 0
        if (state, initial) in NEXT:
            yield NEXT[state, initial], KEEP + extra + rest, "K" + letters
        yield GIVEN[state][1], REROLE + extra + rest, "R" + letters
        yield state, DELETE + rest, "D" + letters

    def after(self, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
        """(node, cost, letters) of the edges that leave ``node``."""
        at, state = node
        if at < len(self.rows):
            for new, cost, letters in self._steps(self.rows[at], state):
                yield (at + 1, new), cost, letters
        yield (at, GIVEN[state][1]), INSERT, "I"

    def before(self, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
        """(node, cost, letters) of the edges that come to ``node``."""
        at, state = node
        for old in range(4):
            if at:
                for new, cost, letters in self._steps(self.rows[at - 1], old):
                    if new == state:
                        yield (at - 1, old), cost, letters
            if GIVEN[old][1] == state:
                yield (at, old), INSERT, "I"


def least_edits(rows: list[Row], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of ``rows`` from state ``start`` to one of ``ends``, ASCII-least; None without any."""
    lattice, n = Lattice(rows), len(rows)
    sides: list[tuple[Callable, int]] = [(lattice.after, 1), (lattice.before, -1)]
    reached: list[dict] = [{(0, start): (0, "")}, {(n, e): (0, "") for e in ends}]  # best distance and letters so far
    settled: list[dict] = [{}, {}]
    heaps = [[(0, 0, start)], [(0, -n, e) for e in ends]]
    best: tuple[float, str] = (math.inf, "")

    def met(front: tuple[int, str], cost: int, letters: str, back: tuple[int, str]) -> None:
        nonlocal best
        total = front[0] + cost + back[0]
        if total <= best[0]:
            audit = front[1] + letters + back[1]
            if total < best[0] or audit < best[1]:
                best = (total, audit)

    while heaps[0] or heaps[1]:
        tops = [h[0][0] if h else 0 for h in heaps]
        if tops[0] + tops[1] > best[0]:
            break
        side = 0 if heaps[0] and (not heaps[1] or tops[0] <= tops[1]) else 1
        edges, way = sides[side]
        distance, at, state = heapq.heappop(heaps[side])
        node = (at * way, state)
        if node in settled[side] or distance > reached[side][node][0]:
            continue
        own = settled[side][node] = reached[side][node]
        other = settled[1 - side]
        if node in other:
            met(*((own, 0, "", other[node]) if side == 0 else (other[node], 0, "", own)))
        for new, cost, letters in edges(node):
            if new in other:
                met(*((own, cost, letters, other[new]) if side == 0 else (other[new], cost, letters, own)))
            label = (distance + cost, own[1] + letters if side == 0 else letters + own[1])
            if new not in settled[side] and (new not in reached[side] or label < reached[side][new]):
                if new not in reached[side] or label[0] < reached[side][new][0]:
                    heapq.heappush(heaps[side], (label[0], new[0] * way, new[1]))
                reached[side][new] = label
    return None if best[0] == math.inf else (int(best[0]), best[1])


#: (cost, audit) from each state to each other, None where there is no way.
Matrix = list[list[tuple[int, str] | None]]


def matrix(rows: list[Row]) -> Matrix:
    return [[least_edits(rows, a, (b,)) for b in range(4)] for a in range(4)]


def joined(left: Matrix, right: Matrix) -> Matrix:
    """The least edits of two stretches that follow each other."""
    pick = lambda ways: min(ways, default=None)
    return [[pick([(x[0] + y[0], x[1] + y[1]) for m in range(4) if (x := left[a][m]) and (y := right[m][b])]) for b in range(4)] for a in range(4)]


def folded(parts: list[Matrix]) -> Matrix:
    """All of ``parts`` joined, in pairs of neighbours, so that letters are copied once a level."""
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def finished(whole: Matrix) -> tuple[int, str]:
    return min(way for e in ENDS if (way := whole[START][e]))


def repair(rows: list[Row]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if len(rows) <= SEGMENT:
        return least_edits(rows, START, ENDS)
    return finished(folded([matrix(rows[i : i + SEGMENT]) for i in range(0, len(rows), SEGMENT)]))


def replayed(lines: list[tuple[str, str, int]], audit: str, state: int) -> tuple[list[str], int, int]:
    """(repaired ``role:text`` lines, letters used, state after them) of (role, text, repeats) under an audit that may go on
    beyond them; inserts behind the last row are left for what follows."""
    out, at = [], 0

    def given(text: str) -> None:
        nonlocal state
        role, state = GIVEN[state]
        out.append(f"{role}:{text}")

    for role, text, many in lines:
        while audit[at] == "I":
            given("")
            at += 1
        letter = audit[at]
        if letter == "K":
            state = NEXT[state, role[:1]]
            out.append(f"{role}:{text}")
        elif letter == "R":
            given(text)
        at += many
    return out, at, state


def inserted(audit: str, state: int) -> list[str]:
    """The lines of an audit's inserts behind all rows."""
    out = []
    for _ in audit:
        role, state = GIVEN[state]
        out.append(f"{role}:")
    return out


def fault_of(text: str, seen: bool) -> str:
    body = text.rstrip(BLANKS)
    return "blank" if not body else "duplicate" if seen else "truncated" if body[-1] not in ".!?" else ""


class Counts:
    """Faults, order and turns of a stretch of rows; stretches that follow each other are added."""

    FIELDS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first_turn long, last_turn long, first string, last string, any boolean"

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = self.first = self.last = None
        self.any = False

    def row(self, turn: int | None, initial: str, fault: str, many: int) -> None:
        one = Counts()
        one.blank = many if fault == "blank" else 0
        one.duplicate = 0 if fault == "blank" else many if fault == "duplicate" else many - 1
        one.truncated = int(fault == "truncated")
        one.illegal = (many - 1) * (initial * 2 not in ("su", "ua", "au"))
        one.turns = int(turn is not None)
        one.low = one.high = one.first_turn = one.last_turn = turn
        one.first = one.last = initial
        one.any = True
        self.add(one)

    def add(self, other: Counts) -> None:
        if not other.any:
            return
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.any:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
            self.turns -= other.first_turn is not None and self.last_turn == other.first_turn
        else:
            self.first, self.first_turn = other.first, other.first_turn
        self.low = other.low if self.low is None else self.low
        self.high = other.high if other.high is not None else self.high
        self.last, self.last_turn, self.any = other.last, other.last_turn, True

    @property
    def gaps(self) -> int | None:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps if gaps < 1 << 63 else None

    @classmethod
    def of(cls, fields: dict) -> Counts:
        out = cls()
        out.__dict__.update(fields)
        return out


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def result(counts: Counts, cost: int, audit: str, digest: str) -> tuple:
    return counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, digest


def judged(rows: list[tuple[int | None, str, str, int]]) -> tuple:
    """The result's columns for all rows (turn, role, text, repeats) of one conversation, in order."""
    counts, seen, lattice = Counts(), set(), []
    for turn, role, text, many in rows:
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = fault_of(text, mark in seen)
        seen.add(mark)
        counts.row(turn, role[:1], fault, many)
        lattice.append((role[:1], fault, many))
    cost, audit = repair(lattice)
    lines, used, state = replayed([r[1:] for r in rows], audit, START)
    lines += inserted(audit[used:], state)
    return result(counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


# tables


def damaged(df: DataFrame) -> DataFrame:
    """conv, turn, role, text, many: the rows after damage, those that repeat in full counted; dropped ones have none."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col("conv_id").alias("conv"), "turn", F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))), F.lit(20)).alias("h"), blank("role").alias("role"), blank("text").alias("text"))
    h = F.col("h")
    rows = rows.select(
        "conv", F.when(h != 0, F.col("turn")).alias("turn"), F.when(h == 0, None).when(h == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(h == 0, None).when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("long").alias("many"),
    )
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("many").alias("many"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, their places in order: partitions are ranges, so a long conversation has several."""
    keys = ["conv", "turn", "role", F.substring("text", 1, 32)]
    return cut(rows.repartitionByRange(*keys).sortWithinPartitions("conv", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id()))


def split_conversations(rows: DataFrame) -> DataFrame:
    """conv of those that lie in more than one partition: a partition's last that is the next one's first."""
    part = F.shiftright("at", 33)
    ends = rows.groupBy(part.alias("part")).agg(F.struct(F.min_by("conv", "at").alias("conv")).alias("first"), F.struct(F.max_by("conv", "at").alias("conv")).alias("last"))
    before = F.lag("last").over(Window.orderBy("part"))  # a row a partition
    return ends.withColumn("before", before).where(F.col("before").eqNullSafe(F.col("first"))).select("first.conv").distinct()


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other and agree in ``by``."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[b] for b in by)
            if held and own != key:
                yield key, held
                held = []
            key = own
            held.append(row)
    if held:
        yield key, held


def _mapped(df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[list[dict]]]) -> DataFrame:
    """``fn`` over a partition's batches; it gives lists of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in fn(batches):
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, kinds)


def _gathered(rows: Iterator[dict], most: int = 1000) -> Iterator[list[dict]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _whole(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations that lie in one partition."""

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        runs = ((conv, [(r["turn"], r["role"], r["text"], r["many"]) for r in held if r["many"]]) for (conv,), held in _runs(batches, ["conv"]))
        yield from _gathered({"conv": conv} | dict(zip(NAMES, judged(own), strict=True)) for conv, own in runs)

    return _mapped(rows.select("conv", "turn", "role", "text", "many"), f"conv {kind}, {RESULT}", repaired)


def _by_segments(rows: DataFrame, kind: str, scratch: Scratch) -> DataFrame:
    """Results of conversations of any length, in segments."""
    rows = rows.where("many > 0").withColumn("segment", F.shiftright("at", SEGMENT.bit_length() - 1))
    alike = ["conv", "role", F.sha2("text", 256)]
    first = rows.groupBy(*alike).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))  # joined on unique places
    seen = rows.join(first, "at", "left").withColumn("seen", F.col("first").isNull())
    dealt = seen.repartition("segment").sortWithinPartitions("segment", "at").select("conv", "segment", "turn", "role", "text", "many", "seen")
    ways = "array<array<struct<cost:long,audit:string>>>"
    fields = Counts.FIELDS.replace(" ", ":").replace(",:", ",")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        for (conv, segment), held in _runs(batches, ["conv", "segment"]):
            counts, lattice = Counts(), []
            for r in held:
                fault = fault_of(r["text"], r["seen"])
                counts.row(r["turn"], r["role"][:1], fault, r["many"])
                lattice.append((r["role"][:1], fault, r["many"]))
            named = [[{"cost": w[0], "audit": w[1]} if w else None for w in ways_] for ways_ in matrix(lattice)]
            yield [{"conv": conv, "segment": segment, "counts": counts.__dict__, "ways": named, "lines": [{"role": r["role"], "text": r["text"], "many": r["many"]} for r in held]}]

    segments = scratch.written(_mapped(dealt, f"conv {kind}, segment long, counts struct<{fields}>, ways {ways}, lines array<struct<role:string,text:string,many:long>>", summed))

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        for (conv,), held in _runs(batches, ["conv"]):
            counts = Counts()
            for r in held:
                counts.add(Counts.of(r["counts"]))
            parts = [[[(w["cost"], w["audit"]) if w else None for w in ways_] for ways_ in r["ways"]] for r in held]
            cost, audit = finished(folded(parts))
            state, at, out = START, 0, []
            for r in held:
                used, after = _advanced(audit, at, r["roles"], state)
                out.append({"conv": conv, "segment": r["segment"], "state": state, "piece": audit[at:used]})
                state, at = after, used
            out[-1]["piece"] += audit[at:]  # inserts behind the last row
            out[0] |= dict(zip(NAMES, result(counts, cost, audit, ""), strict=True))
            yield from _gathered(iter(out))

    roles = F.transform("lines", lambda x: F.struct(F.substring(x.role, 1, 1).alias("initial"), x.many.alias("many")))
    in_order = segments.select("conv", "segment", "counts", "ways", roles.alias("roles")).repartition("conv").sortWithinPartitions("conv", "segment")
    pieces = scratch.written(_mapped(in_order, f"conv {kind}, segment long, state int, piece string, {RESULT}", folds))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        for batch in batches:
            for r in batch.to_pylist():
                own, used, state = replayed([(x["role"], x["text"], x["many"]) for x in r["lines"]], r["piece"], r["state"])
                own += inserted(r["piece"][used:], state)
                yield [{"conv": r["conv"], "segment": r["segment"], "body": "\n".join(own), "lines": len(own)}]

    keys = ["conv", "segment"]
    both = segments.select("segment", F.col("conv").alias("own"), "lines").join(pieces.select(*keys, "state", "piece"), (F.col("own").eqNullSafe(F.col("conv"))) & (segments["segment"] == pieces["segment"]))
    bodies = _mapped(both.select("conv", pieces["segment"], "state", "piece", "lines"), f"conv {kind}, segment long, body string, lines long", lines)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        conv, digest, begun = None, None, False
        for batch in batches:
            for r in batch.to_pylist():
                if digest is None or r["conv"] != conv:
                    if digest is not None:
                        yield [{"conv": conv, "repaired_sha256": digest.hexdigest()}]
                    conv, digest, begun = r["conv"], hashlib.sha256(), False
                if r["lines"]:
                    digest.update(("\n" if begun else "").encode() + r["body"].encode())
                    begun = True
        if digest is not None:
            yield [{"conv": conv, "repaired_sha256": digest.hexdigest()}]

    shas = _mapped(bodies.repartition("conv").sortWithinPartitions("conv", "segment"), f"conv {kind}, repaired_sha256 string", digests).withColumnRenamed("conv", "own")
    found = pieces.where("cost IS NOT NULL").drop("repaired_sha256").join(shas, F.col("own").eqNullSafe(F.col("conv")))
    return found.select("conv", *NAMES)


def _advanced(audit: str, at: int, roles: list[dict], state: int) -> tuple[int, int]:
    """Where the letters of a segment's rows end, and the state there."""
    for r in roles:
        while audit[at] == "I":
            state = GIVEN[state][1]
            at += 1
        if audit[at] == "K":
            state = NEXT[state, r["initial"]]
        elif audit[at] == "R":
            state = GIVEN[state][1]
        at += r["many"]
    return at, state


def repair_conversations(df: DataFrame) -> DataFrame:
    """A row for each conversation of ``df`` (conv_id, turn, role, text), damaged by rule and repaired: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    small_batches(df.sparkSession)
    kind = df.schema["conv_id"].dataType.simpleString()
    scratch = Scratch(df.sparkSession)
    rows = placed(damaged(df))
    split = scratch.written(split_conversations(rows))  # at most one a partition
    marked = rows.join(F.broadcast(split.select(F.col("conv").alias("own"), F.lit(True).alias("split"))), F.col("conv").eqNullSafe(F.col("own")), "left").drop("own")
    whole = _whole(marked.where("split IS NULL"), kind)
    long = marked.where("split")
    parts = _by_segments(long, kind, scratch)
    # conversations cut by a partition's end of which all rows were dropped
    none = long.groupBy("conv").agg(F.sum("many").alias("many")).where("many = 0").select("conv")
    empty = dict(zip(NAMES, judged([]), strict=True))
    none = none.select("conv", *(F.lit(empty[x.split()[0]]).cast(x.split()[1]).alias(x.split()[0]) for x in RESULT.split(", ")))
    return whole.unionByName(parts).unionByName(none).withColumnRenamed("conv", "conv_id")


def op13_conversation_repair(spark, sf_dir) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))
