"""MinHash near-dedup with b-bit signatures, confirmed on full shingle sets.

1. Each text becomes its set of word shingles (64-bit hashes), a few dozen band keys of some minima each, and the lowest
   ``BITS`` bits of all minima, packed to bit planes. Texts with equal sets form a class, which one row stands for.
2. Members of a band bucket are candidates. Buckets are never paired out: a first round links members with the smallest of
   their buckets' smallest members, then with the others; later rounds look only at buckets that still hold several
   components. There, members outside the largest component meet the others in blocks of bounded size, compared by bit
   counts: first each one's best partner, then all partners left. A pair goes on if its
   collision-corrected similarity is no more than ``MARGIN`` below the threshold; few pairs at the threshold lie lower.
   In the later rounds it must also pass a bound that no linked pair fails: a bit that only one set's bitmap has stands
   for at least one shingle that the other set lacks.
3. Candidates are confirmed on the full sets, from the texts, next to their leader; leaders of many pairs are salted.
4. Confirmed links are contracted to components by joins. Pairs inside one component need no further look, as they can't
   change the result; all others that share a bucket are looked at, so no bucket is capped.

A pair at the threshold shares no bucket with a chance of at most ``MISS``. Null and empty texts have no shingles and are linked
with nothing. Rows with a null id are linked with nothing, have a null component and are kept. Rows that share an id count
as one document. An empty table gives an empty result. Other columns of the table, whatever their names, are not read by
``near_duplicates`` and are carried along as they are by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, clear, mark, small_batches, slices, table, written

BITS = 2
PERMUTATIONS = 256
#: The chance that a pair at the threshold shares no bucket is at most this.
MISS = 1e-5
MARGIN = 0.13
BLOCK = 512
#: Bits of a set's bitmap, whose differences bound an overlap from above.
MAP_BITS = 2048
PLANES = BITS * PERMUTATIONS // 64
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word: a sum over bytes, each mixed with its place."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    sizes = np.diff(offsets)
    at = offsets[:-1] - offsets[0]
    place = (np.arange(len(data)) - np.repeat(at, sizes)).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed((place << np.uint64(8) | data) + np.uint64(0x9E3779B97F4A7C15)))])
    return mixed(total[at + sizes] - total[at])


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(lower)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    empty = pc.equal(pc.binary_length(lower), 0).to_numpy(zero_copy_only=False)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    h = word_hashes(coded.dictionary.cast(pa.binary()))[coded.indices.to_numpy(zero_copy_only=False)]
    bounds = bounds - bounds[0]
    full = h[: len(h) - k + 1] if len(h) >= k else h[:0]
    rolled = np.full(len(full), 0x5851F42D4C957F2D, np.uint64)
    for i in range(k):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(full)])
    out = []
    for a, b, none in zip(bounds, bounds[1:], empty, strict=False):
        if none:
            out.append(np.zeros(0, np.uint64))
        elif b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        else:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mixed(np.array([whole]) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
            out.append(np.array([whole], np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each set (none of them empty) under each permutation."""
    flat = np.concatenate(sets)
    flat = (mixed(flat) >> np.uint64(32)).astype(np.uint32)
    heads = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    turned = np.empty_like(flat)
    for i in range(PERMUTATIONS):
        np.multiply(flat, FACTORS[i], out=turned)
        turned += SHIFTS[i]
        out[:, i] = np.minimum.reduceat(turned, heads)
    return out


def rows_a_band(threshold: float) -> int:
    """The most minima a band may have, as the bands that the permutations give then miss a pair at most rarely."""
    return max((r for r in range(1, 17) if (1 - threshold**r) ** (PERMUTATIONS // r) <= MISS), default=1)


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    bands = PERMUTATIONS // rows
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None] << np.uint64(40), len(minima), 0)
    for r in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, r : bands * rows : rows].astype(np.uint64))
    return keys.view(np.int64)


def packed(minima: np.ndarray) -> np.ndarray:
    """Bit planes of the low bits, 64 permutations a number; the planes of one bit stand together."""
    low = (minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    planes = [np.packbits((low >> np.uint32(b) & np.uint32(1)).astype(np.uint8), 1, "little").view(np.int64) for b in range(BITS)]
    return np.concatenate(planes, 1)


def bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    out = []
    for s in sets:
        bits = np.zeros(MAP_BITS, np.uint8)
        bits[(s >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits).tobytes())
    return out


def similarity(same: np.ndarray) -> np.ndarray:
    """Similarity by the share of equal low bits, corrected for chance collisions."""
    chance = 0.5**BITS
    return (same - chance) / (1 - chance)


def described(df: DataFrame, text: str, id_column: str, k: int, rows: int) -> DataFrame:
    """Per row: the id, n_shingles, cls (key of its set), planes, bands, bits (its bitmap); the last four null without shingles."""

    def part(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column("__t"), k)
        full = [i for i, s in enumerate(sets) if len(s)]
        planes, bands, bits = ([None] * len(sets) for _ in range(3))
        if full:
            minima = signatures([sets[i] for i in full])
            for i, p, b, m in zip(full, packed(minima), band_keys(minima, rows), bitmaps([sets[i] for i in full]), strict=True):
                planes[i], bands[i], bits[i] = p, b, m
        return {
            "id": batch.column("__i"), "n_shingles": [len(s) for s in sets],
            "cls": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], "planes": planes, "bands": bands, "bits": bits,
        }

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_shingles long, cls binary, planes array<long>, bands array<long>, bits binary"
    return arrow_map(df.selectExpr(f"`{id_column}` AS __i", f"`{text}` AS __t"), ["__i", "__t"], schema, part, "__t")


def estimate(a: str, b: str):
    """Column: estimated similarity of two arrays of planes."""
    half = PLANES // BITS
    differ = [
        F.bit_count(F.expr(" | ".join(f"(get({a}, {bit * half + i}) ^ get({b}, {bit * half + i}))" for bit in range(BITS))))
        for i in range(half)
    ]
    total = differ[0]
    for d in differ[1:]:
        total = total + d
    return similarity(1 - total / F.lit(float(PERMUTATIONS)))


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int, per_leader: int = 64) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose full sets reach ``percent``. ``texts``: node, text.

    A pair's two texts meet in the group of its leader a; a leader of many pairs has several groups, each with its text.
    """
    salts = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_leader).alias("salts")))
    dealt = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    members = dealt.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("role"))
    leaders = dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("role"))
    rows = members.unionByName(leaders).join(texts, "node").select("a", "salt", "role", "node", "text")
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, None
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), k)
            found = []
            keys = zip(*(part.column(c).to_pylist() for c in ("a", "salt", "role", "node")), sets, strict=True)
            for a, salt, role, node, own in keys:
                if (a, salt) != group:
                    group, leader = (a, salt), []
                if not role:
                    leader.append(own)  # more than one where rows share an id
                    continue
                for other in leader:
                    small, large = sorted((own, other), key=len)
                    if 100 * len(small) < percent * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * both >= percent * (len(small) + len(large) - both):
                        found.append((a, node))
                        break
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, part.schema.field("a").type), pa.array(b, part.schema.field("node").type)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, f"a {kind}, b {kind}")


def contracted(links: DataFrame, hops: int = 2) -> DataFrame:
    """node, component (its smallest node) of all nodes of ``links`` (a, b): a few joins a round, rows shrink each round.

    Each round every node takes its smallest neighbour as parent, ``hops`` doublings of these pointers follow, and links
    are drawn between parents. What the rounds map is composed into the result.
    """
    edges = written(links.where("a <> b").select("a", "b").distinct())
    result = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("node"), "p"))
        for _ in range(hops):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = written(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")))
        if result is None:
            result = parent.select("node", F.col("p").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), F.col("p").alias("to"))
            result = written(result.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        pa_, pb = (parent.select(F.col("node").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        moved = edges.join(pa_, "a").join(pb, "b").where("pa <> pb")
        edges = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if result is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return result


def block_cells(open_: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``open_`` (bucket, node, component) dealt to cells (bucket, i, j) of bounded size, with ``asks`` and ``large``.

    Only pairs across components matter. So a bucket's members beside its largest component ask, in blocks i, and all its
    members answer, in blocks j; a large component never meets itself. Rows made are members × blocks that ask and the
    reverse: linear in the bucket where few members stand outside the largest component. A bucket of one block has a row a
    member, which asks (unless it is of the largest component) and answers; elsewhere ``asks`` tells rows apart.
    """
    per = open_.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    sizes = written(whole.select("bucket", "largest", F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("is_"), F.ceil(F.col("all") / block).cast("int").alias("js")))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = open_.join(sizes, "bucket").withColumn("large", F.col("component") == F.col("largest"))
    one = (F.col("is_") == 1) & (F.col("js") == 1)
    asks = dealt.where(~F.col("large") & ~one).select("bucket", own("is_").alias("i"), each("js").alias("j"), F.lit(True).alias("asks"), "large", "node", "component")
    answers = dealt.select("bucket", each("is_").alias("i"), own("js").alias("j"), F.when(one, F.when(F.col("large"), F.lit(False))).otherwise(F.lit(False)).alias("asks"), "large", "node", "component")
    return asks.unionByName(answers)


def block_pairs(open_: DataFrame, reps: DataFrame, least: float, percent: int, best_only: bool) -> DataFrame:
    """Candidate pairs (a, b) of different components that share a bucket of ``open_`` (bucket, node, component).

    A task compares the askers of a cell (``block_cells``) with its answers by bit counts; with ``best_only``, each asker
    gives its best partner in the cell alone.
    """
    rows = block_cells(open_).join(reps.select("node", "n_shingles", "planes", "bits"), "node")
    small_batches(open_.sparkSession)
    half = PLANES // BITS

    def pairs_of(rows: list[tuple]) -> list[tuple]:
        nodes = [r[0] for r in rows]
        component = np.unique([str(r[1]) for r in rows], return_inverse=True)[1]
        n = np.array([r[2] for r in rows], np.int64)
        bits = np.array([r[3] for r in rows], np.int64)
        asks, large = [r[4] for r in rows], np.array([r[5] for r in rows])  # null: asks and answers
        maps = np.frombuffer(b"".join(r[6] for r in rows), np.uint64).reshape(len(rows), -1)
        found = []
        answers = np.array([i for i, a in enumerate(asks) if not a], np.int64)
        for x in (i for i, a in enumerate(asks) if a is not False):
            y = answers[component[answers] != component[x]]
            if not best_only:  # two askers meet in two cells, from either side
                y = y[[large[z] or nodes[z] > nodes[x] for z in y]]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            if not len(y):
                continue
            differ = np.zeros((len(y), half), np.int64)
            for b in range(BITS):
                differ |= bits[y, b * half : (b + 1) * half] ^ bits[x, b * half : (b + 1) * half]
            s = similarity(1 - np.bitwise_count(differ.view(np.uint64)).sum(1) / PERMUTATIONS)
            ok = np.flatnonzero(s >= least)
            only = lambda a, b: np.bitwise_count(a & ~b).sum(1)
            other = maps[y[ok]]
            most = np.minimum(n[x] - only(maps[x][None], other), n[y[ok]] - only(other, maps[x][None]))
            ok = ok[100 * most >= percent * (n[x] + n[y[ok]] - most)]
            if best_only and len(ok):
                ok = ok[[np.argmax(s[ok])]]
            found += [(min(nodes[x], nodes[z]), max(nodes[x], nodes[z])) for z in y[ok]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, kind = None, [], None

        def out(found: list[tuple]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

        for batch in batches:
            kind = batch.schema.field("node").type
            columns = (batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "component", "n_shingles", "planes", "asks", "large", "bits"))
            for bucket, i, j, *row in zip(*columns, strict=True):
                if (bucket, i, j) != group:
                    if len(held) > 1 and (found := pairs_of(held)):
                        yield out(found)
                    group, held = (bucket, i, j), []
                held.append(row)
        if len(held) > 1 and (found := pairs_of(held)):
            yield out(found)

    id_kind = reps.schema["node"].dataType.simpleString()
    grouped = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return grouped.select("bucket", "i", "j", "node", "component", "n_shingles", "planes", "asks", "large", "bits").mapInArrow(run, f"a {id_kind}, b {id_kind}")


def near_duplicates(df: DataFrame, text: str = "text", id_column: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of ``df``: the id, n_shingles, component_id, kept.

    Texts are linked whose sets of ``k``-word shingles share at least ``percent`` of a hundred of their union; a component's
    id is its smallest document id.
    """
    start = mark()
    least = percent / 100 - MARGIN
    docs = written(described(df, text, id_column, k, rows_a_band(percent / 100)))
    known = docs.where("cls IS NOT NULL AND id IS NOT NULL")
    reps = written(
        known.groupBy("cls").agg(F.min("id").alias("node"), F.min_by("n_shingles", "id").alias("n_shingles"), F.min_by(F.struct("planes", "bands", "bits"), "id").alias("s"))
        .select("cls", "node", "n_shingles", "s.planes", "s.bands", "s.bits")
    )
    exploded = reps.select("node", F.explode("bands").alias("bucket"))
    leaders = written(exploded.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("bucket", "leader"))
    buckets = written(exploded.join(leaders, "bucket").select("bucket", "leader", "node"))
    wanted = buckets.select("node").distinct()
    source = df.select(F.col(id_column).alias("node"), F.col(text).alias("text"))
    texts = written(source.join(wanted, "node", "left_semi"))
    sig = reps.select("node", "n_shingles", "planes")

    star = buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sides = (sig.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("planes").alias(f"p{c}")) for c in "ba")
    for side in sides:
        star = star.join(side, side.columns[0])
    close = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate("pa", "pb") >= least)
    star = written(star.where(close).select("a", "b"))
    # each text goes to one leader first; other leaders of it count only where that leaves components apart
    tried = written(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = written(confirmed(tried, texts, k, percent))
    components = contracted(links)
    ends = (components.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    apart = star.join(tried, ["a", "b"], "left_anti")
    for end in ends:
        apart = apart.join(end, end.columns[0], "left")
    apart = written(apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    if not apart.isEmpty():
        tried = tried.unionByName(apart)
        links = links.unionByName(written(confirmed(apart, texts, k, percent)))
        components = contracted(links)
    for best_only in (True, False):
        placed = buckets.join(components, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        placed = written(placed)
        several = written(placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket"))
        if several.isEmpty():
            break
        open_ = written(placed.join(several, "bucket"))
        candidates = block_pairs(open_, reps, least, percent, best_only).distinct().join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        candidates = written(candidates)
        if candidates.isEmpty():
            continue  # the best partners may all have been tried, but not the others
        tried = tried.unionByName(candidates)
        more = written(confirmed(candidates, texts, k, percent))
        links = links.unionByName(more)
        components = contracted(links)
    by_class = written(reps.select("cls", "node").join(components, "node", "left").select("cls", F.coalesce("component", "node").alias("component")))
    slim = written(docs.select("id", "n_shingles", "cls"))
    clear(df.sparkSession, start, (slim, by_class))
    alone = slim.where("cls IS NULL").withColumn("component", F.lit(None).cast(slim.schema["id"].dataType))  # linked with nothing, and no key of a join
    classed = slim.where("cls IS NOT NULL").join(by_class, "cls", "left").select(*alone.columns)
    component = F.coalesce("component", "id")
    return classed.unionByName(alone).select(
        F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(df: DataFrame, text: str = "text", id_column: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """``df`` without the rows that a smaller id of their component stands for. Of rows that share an id, the longest stays.

    Ids that repeat are found on ids alone; only their rows meet by id.
    """
    marked = near_duplicates(df, text, id_column, k, percent)
    lost = written(marked.where("NOT kept").select(F.col(id_column).alias("id")).distinct())
    ids = df.select(F.col(id_column).alias("id")).where("id IS NOT NULL")
    repeated = written(ids.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")  # so that no column of df can clash with ours
    left = df.select(F.col(id_column).alias("id"), F.char_length(text).alias("n"), row).join(lost, "id", "left_anti")
    if not repeated.isEmpty():
        first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n")))
        of_repeated = left.join(repeated, "id", "left_semi").withColumn("place", first).where("place = 1").drop("place")
        left = left.join(repeated, "id", "left_anti").unionByName(of_repeated)
    return left.select("row.*")


def op2_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
