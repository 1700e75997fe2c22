"""Secret scan: three fixed patterns, and a randomness test battery for further tokens.

The fixed patterns (assignments, access keys, long hex) find their spans first. The method then looks at every run of
20 or more characters of base64 and its URL form. The smallest alphabet that holds a run's characters is its inferred
encoding. Against it the battery runs
- three screens that must not reject randomness at ``BATTERY_P``: a chi-squared test of alphabet uniformity, a runs test
  about the alphabet's middle, and a lag-1 serial correlation test;
- an equivalence test whose null hypothesis is "ordinary text": a chain of character classes (lower, upper, digit, sign)
  that mostly stays in its class, with the letter shares of English, blended with even ones. The statistic is the
  likelihood ratio of that text to even draws. Its null distribution is computed for the run's own length and alphabet
  (exact cumulants by transfer matrices, tail by Lugannani and Rice), so short runs can't be called random by luck.
Runs that fail a screen, or that no alphabet holds, are no candidates and don't count as tests. The p-values of the other
runs of one text go through Benjamini-Hochberg at ``FDR``; being per text, equal texts give equal results whatever else
the table holds.

Nulls count as empty texts, which have no spans. Rows are independent; repeated rows repeat, and an empty
table gives an empty result. ``scan_secrets`` reads no other columns, whatever their names; ``redact_secrets`` carries them
along. Whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from math import erf, erfc, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches, table, texts_of

#: Fixed values of the contract.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
FDR = 0.01
#: A test that must not reject randomness rejects below this.
BATTERY_P = 0.002
#: Alphabets, smallest first: name, members in order.
ALPHABETS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("upperhex", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
SETS = [(name, {c: i for i, c in enumerate(members)}) for name, members in ALPHABETS]
#: Ordinary text: percent of each letter from a to z, and of each digit in numbers.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.07)
DIGITS = (28, 19, 12, 9, 8, 6, 5, 5, 4, 4)
#: The share of lower, upper, digits and signs; the chance to stay in a class; the part of even shares within a class.
CLASSES, STAY, BLEND = (0.55, 0.2, 0.1, 0.15), 0.8, 0.25
#: Exponents at which cumulants are held; at 1 even draws are the tilted text.
TILTS = np.arange(0, 2.01, 0.02)


class Ordinary:
    """The chain of ordinary text over one alphabet, restricted to its classes."""

    def __init__(self, members: str):
        self.size = len(members)
        kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in members]
        have = sorted(set(kind))
        self.kind = np.array([have.index(k) for k in kind])
        weight = np.array([LETTERS[ord(c.lower()) - 97] if c.isalpha() else 1.0 for c in members])
        total = np.bincount(self.kind, weight)
        self.within = (1 - BLEND) * weight / total[self.kind] + BLEND / np.bincount(self.kind)[self.kind]
        if have == [2]:
            self.within = np.array(DIGITS) / sum(DIGITS)
        share = np.array([CLASSES[k] for k in have])
        self.first = share / share.sum()
        self.move = np.ones((1, 1))
        if len(have) > 1:
            self.move = (1 - STAY) * share[None] / (share.sum() - share)[:, None]
            np.fill_diagonal(self.move, STAY)

    def ratio(self, codes: np.ndarray) -> float:
        """Logarithm of the likelihood of text to that of even draws."""
        kind = self.kind[codes]
        return float(np.log(self.within[codes] * self.size).sum() + np.log(self.move[kind[:-1], kind[1:]]).sum() + np.log(self.first[kind[0]]))

    def cumulants(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cumulant function of the negative ratio of ``n`` characters of text at TILTS, and its two derivatives."""
        rest = 1 - TILTS[:, None]
        powers = self.within[None] ** rest * float(self.size) ** -TILTS[:, None]
        weight = np.stack([powers[:, self.kind == k].sum(1) for k in range(len(self.first))], 1)
        state, scale = self.first[None] ** rest * weight, np.zeros(len(TILTS))
        step, step_scale = self.move[None] ** rest[:, :, None] * weight[:, None, :], np.zeros(len(TILTS))
        left = n - 1
        while left:
            if left & 1:
                state, scale = np.einsum("tg,tgh->th", state, step), scale + step_scale
                top = state.max(1)
                state, scale = state / top[:, None], scale + np.log(top)
            step, step_scale = step @ step, 2 * step_scale
            top = step.max((1, 2))
            step, step_scale = step / top[:, None, None], step_scale + np.log(top)
            left >>= 1
        held = np.log(state.sum(1)) + scale
        slope = np.gradient(held, TILTS, edge_order=2)
        return held, slope, np.maximum(np.gradient(slope, TILTS, edge_order=2), 1e-9)


ORDINARY = {name: Ordinary(members) for name, members in ALPHABETS}


@lru_cache(4096)
def cumulants(name: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ORDINARY[name].cumulants(n)


def text_tail(name: str, n: int, ratio: float) -> float:
    """The chance that ``n`` characters of ordinary text have at most this ratio; 1 from its mean on."""
    held, slope, bend = cumulants(name, n)
    if -ratio <= slope[0]:
        return 1.0
    tilt = float(np.interp(-ratio, slope, TILTS))
    root = sqrt(max(2 * (-tilt * ratio - float(np.interp(tilt, TILTS, held))), 0))
    if root < 0.1:
        return 1.0
    spread = tilt * sqrt(float(np.interp(tilt, TILTS, bend)))
    return min(max(0.5 * erfc(root / sqrt(2)) + exp(-root * root / 2) / sqrt(2 * pi) * (1 / spread - 1 / root), 0.0), 1.0)


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + erf(z / sqrt(2)))


def battery(run: str) -> tuple[str, float | None]:
    """(encoding, p-value of the null that the run is ordinary text); None where a screen finds structure."""
    body = run.rstrip("=")
    chars = set(body)
    name, place = next(((n, p) for n, p in SETS if chars <= p.keys()), ("", {}))
    n, k = len(body), len(place)
    if not name or n < 20:
        return name, None
    codes = np.fromiter(map(place.__getitem__, body), dtype=np.float64, count=n)
    counts = np.bincount(codes.astype(np.int64), minlength=k)
    chi = float((counts * counts).sum()) * k / n - n
    free = k - 1
    upper = 1 - normal_cdf((chi - free) / sqrt(2 * free * (n - 1) / n))
    high = codes >= k / 2
    ups, downs = int(high.sum()), int(n - high.sum())
    if not ups or not downs:
        return name, None
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * ups * downs / n
    var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    p_runs = 2 * (1 - normal_cdf(abs(runs - mean) / sqrt(var)))
    centred = codes - codes.mean()
    power = float(centred @ centred)
    serial = float(centred[1:] @ centred[:-1]) / power if power else 1.0
    p_serial = 2 * (1 - normal_cdf(abs(serial + 1 / n) * sqrt(n)))
    if min(upper, p_runs, p_serial) < BATTERY_P:
        return name, None
    return name, text_tail(name, n, ORDINARY[name].ratio(codes.astype(np.int64)))


def random_runs(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the runs that stand after false-discovery control."""
    tested = []
    for m in RUN.finditer(text):
        name, p = battery(m.group())
        if p is not None:
            tested.append((p, m.start(), f"random_{name}", m.end()))
    tested.sort()
    passed = [i for i, x in enumerate(tested, 1) if x[0] <= FDR * i / len(tested)]
    return [x[1:] for x in tested[: passed[-1]]] if passed else []


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def in_order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]) if s[1] in KINDS else len(KINDS), s[1], s[2]))


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in in_order(spans))


def scan(text: str) -> tuple:
    base = base_spans(text)
    kinds = [s[1] for s in base]
    return (*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + random_runs(text)))


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span, or overlapping spans together, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(base_spans(text) + random_runs(text)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """A row for each row of ``df``: its id and the columns of ``RESULT``. Narrow: no shuffle."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def part(batch: pa.RecordBatch) -> dict:
        rows = [scan(t) for t in texts_of(batch, "__t")]
        return {id_column: batch.column("__i")} | dict(zip(names, map(list, zip(*rows)), strict=True))

    kind = df.schema[id_column].dataType.simpleString()
    return arrow_map(df.selectExpr(f"`{id_column}` AS __i", f"`{text}` AS __t"), ["__i", "__t"], f"{id_column} {kind}, {RESULT}", part, "__t")


def redact_secrets(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``df`` with secrets in ``text`` replaced; ``length``, where it is a column, follows. Null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redacted(t))

    small_batches(df.sparkSession)
    out = df.withColumn(text, clean(F.col(text)))
    if length in df.columns:
        out = out.withColumn(length, F.char_length(F.col(text)).cast(df.schema[length].dataType))
    return out


def op3_secret_scan(spark, sf_dir) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
