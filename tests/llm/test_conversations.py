"""Conversation repair against plain relaxation over the same edits, row by row, and over tables cut anywhere."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rubrica.llm import conversations

FORM = re.compile(r"(s?(ua)+)?")
PIECES = ["system", "user", "assistant", "usher", "tool", "", " ", "User"]
TEXTS = ["Yes.", "No", "", " \t", "Why?", "Go!  ", "Yes.", "a.b"]


def plain_rows(rows):
    """Rows (turn, role, text) of one conversation → (initial, fault) by the rules as they are written."""
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append((role[:1], "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, repaired) by relaxing least suffixes until nothing changes; one row at a time, copies included."""
    faults, n = plain_rows(rows), len(rows)
    best = {(n, ""): (0, "", []), (n, "a"): (0, "", [])}
    turn_of = {"": "u", "s": "u", "u": "a", "a": "u"}
    changed = True
    while changed:
        changed = False
        for i in range(n, -1, -1):
            for state in ("", "s", "u", "a"):
                role = {"u": "user", "a": "assistant"}[turn_of[state]]
                ways = [(3, "I", (i, turn_of[state]), [f"{role}:"])]
                if i < n:
                    initial, fault = faults[i]
                    ways.append((4, "D", (i + 1, state), []))
                    if fault not in ("blank", "duplicate"):
                        late = 3 * (fault == "truncated")
                        ways.append((3 + late, "R", (i + 1, turn_of[state]), [f"{role}:{rows[i][2]}"]))
                        if initial in ("s", "u", "a") and (state + initial) in ("s", "u", "su", "ua", "au"):
                            ways.append((late, "K", (i + 1, initial), [f"{rows[i][1]}:{rows[i][2]}"]))
                for cost, letter, node, lines in ways:
                    if node in best:
                        new = (cost + best[node][0], letter + best[node][1], lines + best[node][2])
                        if (i, state) not in best or new[:2] < best[i, state][:2]:
                            best[i, state] = new
                            changed = True
    return best[0, ""]


def damage(rows):
    """Rows (conv_id, turn, role, text) → conv_id → its rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def plain(rows):
    for conv, own in damage(rows).items():
        turns = [t for t, _, _ in own if t is not None]
        faults = [f for _, f in plain_rows(own)]
        initials = [r[1][:1] for r in own]
        cost, audit, lines = plain_repair(own)
        yield (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )


def check(spark, rows, schema="conv_id long, turn long, role string, text string"):
    order = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(map(tuple, conversations.repair_conversations(spark.createDataFrame(rows, schema)).collect()), key=order)
    assert got == sorted(plain([r[:4] for r in rows]), key=order)


ROW = st.tuples(st.sampled_from("suaxU") | st.just(""), st.sampled_from(["", "", "blank", "duplicate", "truncated"]), st.integers(1, 3))


def spread(rows):
    """Rows as single ones: the repeats of one without a fault are duplicates."""
    out = []
    for initial, fault, many in rows:
        out += [(initial, fault if fault in ("blank", "duplicate") or not j else "duplicate") for j in range(many)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=9))
def test_least_edits_equal_plain(rows):
    one_by_one = spread(rows)
    cost, audit = conversations.repair(rows)
    state, used = "", 0
    for letter in audit:  # the audit is a way through the rows at its cost, and gives the form
        if letter == "I":
            state += {"": "u", "s": "u", "u": "a", "a": "u"}[state[-1:]]
            continue
        initial, fault = one_by_one[used]
        used += 1
        assert letter == "D" or fault not in ("blank", "duplicate")
        state += {"K": initial, "R": {"": "u", "s": "u", "u": "a", "a": "u"}[state[-1:]], "D": ""}[letter]
    assert used == len(one_by_one) and FORM.fullmatch(state)
    assert (cost, audit) == exhaustive(one_by_one)


def exhaustive(rows):
    """(cost, audit) of rows (initial, fault) by least suffixes, in rounds."""
    n, turn_of = len(rows), {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {(n, ""): (0, ""), (n, "a"): (0, "")}
    for _ in range(4 * n + 8):
        for i, state in itertools.product(range(n, -1, -1), turn_of):
            ways = [(3, "I", (i, turn_of[state]))]
            if i < n:
                initial, fault = rows[i]
                ways.append((4, "D", (i + 1, state)))
                if fault not in ("blank", "duplicate"):
                    late = 3 * (fault == "truncated")
                    ways.append((3 + late, "R", (i + 1, turn_of[state])))
                    if initial and state + initial in ("s", "u", "su", "ua", "au"):
                        ways.append((late, "K", (i + 1, initial)))
            found = [(c + best[v][0], x + best[v][1]) for c, x, v in ways if v in best]
            best[i, state] = min([*found, best.get((i, state), (10**9, ""))])
    return best[0, ""]


@settings(max_examples=100, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=14), st.integers(1, 5))
def test_joined_segments_equal_one_search(rows, size):
    parts = [conversations.matrix(rows[i : i + size]) for i in range(0, len(rows), size)]
    assert conversations.finished(conversations.folded(parts)) == conversations.least_edits(rows, conversations.START, conversations.ENDS)


def test_heaps_meet(monkeypatch):
    """Both heaps take part in a long conversation with one fault in the middle."""
    rows = [("u" if i % 2 == 0 else "a", "", 1) for i in range(400)]
    rows[200] = ("x", "", 1)
    asked = []
    for name in ("after", "before"):
        edges = getattr(conversations.Lattice, name)
        monkeypatch.setattr(conversations.Lattice, name, lambda self, node, edges=edges, name=name: asked.append(name) or edges(self, node))
    assert conversations.least_edits(rows, 0, conversations.ENDS) == (3, "K" * 200 + "R" + "K" * 199)
    assert min(asked.count("after"), asked.count("before")) > 100


def random_rows(rng, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(longest)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn - 1]), rng.choice([*PIECES[:3], *PIECES, None]), rng.choice([*TEXTS, None, f"text {turn}.", f"text {turn}"])))
    return rows


def test_tables_equal_plain(spark):
    check(spark, random_rows(random.Random(1), 60, 12))


def test_edges(spark):
    rows = [(None, 1, "user", "No id."), (None, None, None, None), (7, 1, "user", "Hi."), (7, 2, "assistant", "x " * 100_000 + "."), (8, 1, "", ""), (9, 5, "user", "Same."), (9, 5, "user", "Same.")]
    rows += [(10, 2**62, "user", "Far."), (10, -(2**62), "user", "Off."), (11, 1, "user", None)]
    check(spark, [(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, at int")
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "Gone.")])
    got = conversations.repair_conversations(spark.createDataFrame([(dropped, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(got)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversation_is_cut(spark, monkeypatch):
    """One conversation with most rows, many of them alike, over several partitions and segments."""
    monkeypatch.setattr(conversations, "SEGMENT", 8)
    rng = random.Random(2)
    rows = random_rows(rng, 20, 6)
    rows += [(7, t, rng.choice(PIECES[:3]), rng.choice([*TEXTS, f"turn {t}.", f"turn {t}"])) for t in range(300)]
    rows += [(7, None, "user", "Hot.")] * 200
    rows += [(None, t, rng.choice(PIECES[:3]), f"turn {t}.") for t in range(100)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        placed = conversations.placed(conversations.damaged(df))
        assert 7 in [r.conv for r in conversations.split_conversations(placed).collect()]
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("text, fault", [("", "blank"), (" \t\x0b", "blank"), ("\x85", "truncated"), ("a. ", ""), ("a", "truncated"), ("?", "")])
def test_faults(text, fault):
    assert conversations.fault_of(text, False) == fault
