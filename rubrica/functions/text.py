"""Text expressions: cleaning, question form, shingles, fenced programs. Built-in functions, except ``syntax_ok`` and hashed shingles.

A line ends at a newline, with or without a carriage return. Null texts count as empty unless a function says otherwise.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

# Words whose lines don't count as a text's first, and the words that open a question or a request.
GREETINGS = ["hi", "hello", "hey", "greetings", "thanks", "thank", "dear"]
GREETING_CHARS = 60
LEAD_WORDS = [
    "how", "what", "why", "when", "where", "which", "who", "whose", "whom", "can", "could", "does", "do", "did", "is", "are",
    "was", "were", "will", "would", "should", "shall", "has", "have", "had", "am", "may", "might", "explain", "show", "help",
    "describe", "tell", "give", "provide", "write", "make", "create", "add", "support", "allow", "implement", "fix", "clarify",
    "document", "consider", "suggest", "share", "expose", "enable", "let", "please",
]

# What is noise in a markdown text, in the order in which it goes, and what stands instead; lines that carry no prose.
MARKDOWN_NOISE = [(r"(?s)<!--.*?-->", " "), (r"(?s)```.*?(```|\z)", " [code] "), (r"<[^>\n]{1,80}>", " ")]
SKIPPED_LINES = r"(?md)^\s*[#>|].*$"

#: Frequent short words by language, our own choice, for the vote of ``detect_language``.
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "is", "in", "it", "that", "was", "for", "with", "this", "are", "be"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "mit", "zu", "von", "den", "auf", "eine"],
    "fr": ["le", "la", "les", "et", "des", "est", "un", "une", "que", "pour", "dans", "du", "par", "sur"],
    "es": ["el", "los", "las", "y", "es", "una", "por", "con", "para", "del", "se", "no", "al", "como"],
}


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once: inside higher-order functions an expression would run for each element."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def lines(c: Column) -> Column:
    return F.split(empty(c), r"\r?\n")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_markdown(c: Column) -> Column:
    """Prose of a markdown text: no comments, tags, quotes, headings or table rows; code fences become ``[code]``.

    Lines are never taken apart: rows to skip, then the white space around line ends, go by expressions over the whole text.
    """
    prose = empty(c)
    for noise, instead in MARKDOWN_NOISE:
        prose = F.regexp_replace(prose, noise, instead)
    packed = stripped(F.regexp_replace(F.regexp_replace(prose, SKIPPED_LINES, ""), r"\s*\n\s*", "\n"))
    return F.trim(F.regexp_replace(packed, r"[ \t]+", " "))


def first_word(c: Column) -> Column:
    """First word, lower case, of the first line that is neither empty nor a short greeting; else empty.

    Leading brackets go before a line is judged, so a line ``[code]`` counts, as the word ``code``.
    """

    def judged(line: Column) -> Column:
        """The line's word, perhaps empty; null for a line that doesn't count."""
        bare = F.regexp_replace(F.regexp_replace(stripped(line), r"^[*_`]+|[*_`]+$", ""), r"^[\[\]() .]+", "")
        word = F.lower(F.regexp_extract(bare, r"^[A-Za-z']+", 0))
        passed_over = (bare == "") | (word.isin(GREETINGS) & (F.char_length(bare) <= GREETING_CHARS))
        return F.when(~passed_over, word)

    return F.coalesce(F.get(F.array_compact(F.transform(lines(c), judged)), F.lit(0)), F.lit(""))


def is_question_form(title: Column, body: Column) -> Column:
    return first_word(title).isin(LEAD_WORDS) | first_word(clean_markdown(body)).isin(LEAD_WORDS)


def normalize_text(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends. Single blanks, the common case, match nothing."""
    return F.trim(F.regexp_replace(F.lower(empty(c)), r"\s{2,}|[^\S ]", " "))


def length_between(c: Column, low: int = 30, high: int = 20_000) -> Column:
    return F.char_length(empty(c)).between(low, high)


def language_votes(c: Column, chars: int = 1500) -> dict[str, Column]:
    words = F.split(normalize_text(F.substring(empty(c), 1, chars)), r"[^\p{L}]+")
    count = lambda own: F.size(F.filter(words, lambda w: w.isin(own)))
    return {lang: count(own) for lang, own in STOP_WORDS.items()}


def detect_language(c: Column, chars: int = 1500) -> Column:
    """The language whose stop words are most frequent in the first ``chars`` characters; ``unknown`` without any.

    Ties go to the first in the order of ``STOP_WORDS``.
    """
    votes = language_votes(c, chars)
    most = F.greatest(*votes.values())
    pick = F.when(most == 0, "unknown")
    for lang, n in votes.items():
        pick = pick.when(n == most, lang)
    return pick


def _grams(c: Column, k: int, short, gram) -> Column:
    """Distinct ``gram`` of each run of ``k`` words of the normalized text; ``short`` of all words where they are fewer."""

    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: gram(*(F.get(words, i + j) for j in range(k))))
        return F.when(F.size(words) < k, F.array(short(words))).otherwise(F.array_distinct(runs))

    norm = normalize_text(c)
    kind = gram(F.lit("")).alias("g")
    return F.when(norm == "", F.array_remove(F.array(kind), kind)).otherwise(let(F.split(norm, " "), of))


def shingles(c: Column, k: int = 3) -> Column:
    """Distinct word k-grams of the normalized text; a shorter text is one shingle, an empty one has none."""
    return _grams(c, k, lambda words: F.array_join(words, " "), lambda *w: F.concat_ws(" ", *w))


def shingle_hashes(c: Column, k: int = 3) -> Column:
    """The set of ``shingles`` as 64-bit hashes, without making their strings; in no order."""
    return _hasher(k)(normalize_text(c))


@functools.cache
def _hasher(k: int):
    """Hashes of all runs of ``k`` words of normalized texts: a rolling hash of the bytes gives that of any run at once."""

    @F.arrow_udf(ArrayType(LongType()))
    def hashes(texts: pa.Array) -> pa.Array:
        parts = []
        start, held = 0, 0
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for i, n in enumerate([*sizes.tolist(), None]):  # slices, so that memory doesn't follow a batch of long texts
            if n is None or held and held + n > SLICE_BYTES:
                parts.append(_run_hashes(texts.slice(start, i - start), k))
                start, held = i, 0
            held += n or 0
        return pa.concat_arrays(parts)

    return hashes


#: Bytes of text whose runs are hashed at once; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Base of the rolling hash, odd, so that it has an inverse among the 64-bit numbers.
ROLL = 0x9E3779B97F4A7C15


def _run_hashes(texts: pa.Array, k: int) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] if len(bounds) else 0 : bounds[-1] if len(bounds) else 0]
    bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
    filled = np.flatnonzero(np.diff(bounds))
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.sort(np.concatenate([bounds[filled], spaces + 1])), np.sort(np.concatenate([bounds[filled + 1], spaces]))
    owner = np.searchsorted(bounds[filled], starts, "right") - 1  # of each word, among the texts that have any
    first = np.searchsorted(owner, np.arange(len(filled)))
    words = np.diff(np.append(first, len(owner)))
    runs = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :]) if len(owner) >= k else np.zeros(0, np.int64)
    few = np.flatnonzero(words < k)  # shorter texts are one run
    low = np.concatenate([starts[runs], starts[first[few]]])
    high = np.concatenate([ends[runs + k - 1], ends[first[few] + words[few] - 1]])
    of = np.concatenate([owner[runs], few])
    factor = np.full(len(data) + 1, ROLL, np.uint64)
    factor[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(factor)[:-1], out=sums[1:])
    factor[1:] = pow(ROLL, -1, 1 << 64)
    h = (sums[high] - sums[low]) * np.cumprod(factor)[low] + (high - low).astype(np.uint64) * np.uint64(ROLL)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    counts = np.zeros(len(texts), np.int64)
    counts[filled] = np.bincount(of[new], minlength=len(filled))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(h[new].view(np.int64)))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def fenced_blocks(c: Column) -> Column:
    """Struct: count of fenced blocks, the longest block's body (the first of equal ones), and the text outside fences."""
    bodies = F.regexp_extract_all(empty(c), F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    longest = F.aggregate(bodies, F.lit("").cast("string"), lambda best, x: F.when(F.char_length(x) > F.char_length(best), x).otherwise(best))
    outside = stripped(F.regexp_replace(empty(c), r"(?s)```[^\n]*\n.*?```", ""))
    return F.struct(F.size(bodies).alias("blocks"), longest.alias("longest"), outside.alias("outside"))


@F.pandas_udf(BooleanType())
def syntax_ok(programs):
    """Whether each program parses as Python; nothing is executed. Null and unparsable programs are false."""
    import ast
    import warnings

    def parses(program) -> bool:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(program)
            return True
        except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
            return False

    return programs.map(parses)


def numbered_line(number: Column, line: Column) -> Column:
    """``0001: line``: at least four digits, more where the number has them."""
    digits = number.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")), F.lit(": "), line)


def number_lines(c: Column) -> Column:
    """Each line after its number: ``0001: …``."""
    return F.array_join(F.transform(lines(c), lambda x, i: numbered_line(i + 1, x)), "\n")
