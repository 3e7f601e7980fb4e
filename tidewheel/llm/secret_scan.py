"""Secrets in texts: fixed patterns, and values in credential contexts whose cost to guess is high.

Kinds, each leftmost and not overlapping itself: `assign` (a credential name, an assignment sign and a value of 12 or more
characters), `access` (AKIA and capitals or digits, 18 or more), `hex` (16 or more lower-case hexadecimal
digits), and `guess`: the value that follows a credential name, a header word or a user in an address, if the cheapest way to
guess it costs at least MIN_DECADES powers of ten. The cost is a dynamic programme over positions of the value: it is cut in
common words, dates, repeats of what stands before, keyboard walks and brute-force spans, a cut's cost is the sum of its parts' and a charge for
each further part, and the cheapest cut counts. A `guess` span equal to a base span's value is still listed. A value ends at a blank, quote, comma,
semicolon, @, < or >, so a secret that holds one is found up to there.

Code and placeholders: a value without quotes that is an expression of names (`process.env.API_TOKEN`, `get_token(request)`) is one guess, which
costs what its dearest name's dearest word does and a little for each further word; so does a placeholder (`${DB_PASSWORD}`, `your-api-key-here`), quoted or
not. A passphrase of words in one case change after the other, without quotes, reads as such a name. `redacted` leaves `assign` spans of
such values as they are; the spans are listed all the same.

Defined results: null text is the empty text and has no spans; repeated rows give equal results; whole texts of any
length are scanned. Columns of the output's names are replaced, all others stay.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import textkit as tk

KINDS = ("assign", "access", "hex", "guess")
#: A value of this guess cost or more, as a power of ten, is a secret.
MIN_DECADES = 9.0
#: Characters of the shortest repeat.
REPEAT = 3
#: The vocabulary whose whole words, by rank, a guesser tries.
WORDS = "byte_bpe_multi_50k.tiktoken"

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?ai:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth(?:orization)?|bearer|credentials?)\b["']?\x20*(?:=>|:=|[:=]|\bis\b)\x20*(?:bearer\x20+|basic\x20+)?["'`]?|://[^\s:/@]+:)([^\s"'`<>,;@]{6,})"""
)
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "://")

# Frequent words in passwords, by rank, and the rows of a keyboard.
COMMON = (
    "password admin welcome login letmein monkey dragon master qwerty football baseball shadow michael jordan hunter "
    "sunshine princess iloveyou trustno batman test user guest root secret pass token key hello love example sample "
    "changeme default temp demo the and for you with your none null true false value string insert here some this that "
    "server data system access private public client service account database summer winter spring autumn january february "
    "march april june july august september october november december monday friday sunday dog cat horse battery staple "
    "correct blue red green black white star super man girl boy"
).split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

# Words that mark a placeholder, and short words of names in code.
MARKERS = frozenset("your my example sample dummy placeholder here change changeme insert todo redacted replace xxx fixme".split())
SHORT = frozenset("to is id db of in on or no by at do go if it me my os fs io ui ok js py vm fn re as we an be he up us so am".split())
_CODE = re.compile(r"[A-Za-z0-9_$.:>?()\[\]{}%#&*-]+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_WRAPPED = re.compile(r"\$\{.*\}?|\$\(.*\)?|\{\{.*|%[A-Za-z0-9_]+%|\$[A-Za-z_].*")
_SAID = re.compile(r"[aeiouy]", re.I), re.compile(r"[^aeiouy]{5}", re.I)
#: Decades of a name's word that is not in the list, if it can be said, and of each further word.
OWN_WORD, FURTHER = 6.0, 0.4
_PLAIN = str.maketrans("4@310!5$7", "aaeioisst")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


@lru_cache(maxsize=1)
def _ranked() -> tuple[dict[str, int], int]:
    """The rank of each word of three letters or more, and the greatest length."""
    out = {w: i + 1 for i, w in enumerate(COMMON)}
    for token, rank in sorted(bpe.ranks(public_tokenizers.path(WORDS)).items(), key=lambda x: x[1]):
        if token[:1] == b" " and len(token) > 3:
            word = token[1:].decode("utf-8", "ignore").lower()
            if len(word) > 2 and word.isalpha() and word.encode() == token[1:].lower():
                out.setdefault(word, rank + 1)
    return out, max(map(len, out))


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, str]:
    """The keys beside each key: in its row, and above and below it."""
    at = {c: (x, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    return {a: "".join(b for b, (u, v) in at.items() if a != b and abs(u - x) <= 1 and abs(v - y) <= 1) for a, (x, y) in at.items()}


def _charset(part: str) -> int:
    """The number of characters that one who guesses by force must try for each place."""
    size = 0
    if not part.isascii():
        size += 100
    if part.isascii() and all(c in "0123456789abcdefABCDEF" for c in part) and any(c.isdigit() for c in part):
        return 16
    size += 26 * any("a" <= c <= "z" for c in part) + 26 * any("A" <= c <= "Z" for c in part) + 10 * any("0" <= c <= "9" for c in part)
    return size + 33 * any(c.isascii() and not c.isalnum() for c in part) or 10


def _runs(n: int, goes_on: Callable[[int], bool]) -> list[int]:
    """For each position, how many of the next ones go on."""
    out = [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        out[i] = out[i + 1] + 1 if goes_on(i) else 0
    return out


def repeats(text: str) -> list[int]:
    """From each place, how many characters occur in the same order from an earlier place as well, which they may overlap.

    Ranks of pieces of 1, 2, 4, ... characters give the order of all suffixes; of those before and after a suffix in that order, the nearest
    that start earlier share most with it. Work is some n log(n)^2."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rank, width = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable") if width == 1 else order
        if rank[order[-1]] == n - 1:
            break
        after = np.zeros(n, dtype=np.int64)
        if width < n:
            after[:-width] = rank[width:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(both[order[1:]] != both[order[:-1]])))
        width *= 2
    place, where = order.tolist(), rank.tolist()
    shared, k = [0] * n, 0  # of each suffix with the one before it in order
    for i in range(n):
        if where[i]:
            j = place[where[i] - 1]
            while i + k < n and j + k < n and text[i + k] == text[j + k]:
                k += 1
            shared[where[i]] = k
            k = max(0, k - 1)
        else:
            k = 0
    out, held = [0] * n, []  # held: suffixes in order whose later neighbours are not known yet, starts growing
    for at in range(n + 1):
        i, k = (place[at], shared[at]) if at < n else (-1, 0)
        while held and held[-1][0] > i:
            j, own = held.pop()
            out[j] = max(own, k)
            k = min(own, k)
        held.append((i, k))
    return out


def expression(value: str, quoted: bool = False) -> float | None:
    """log10 of the guesses for a value that is an expression of names, or a placeholder; None for another. Quoted, only a placeholder."""
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", value) if p]
    marked = _WRAPPED.fullmatch(value) is not None or any(p.lower() in MARKERS for p in parts)
    if not parts or not _CODE.fullmatch(value) or (quoted and not marked) or ("-" in value.replace("->", "") and not marked):
        return None
    rank_of, costs = _ranked()[0], []
    for part in parts:
        words = _WORDS.findall(part)
        for word in words:
            lower = word.lower()
            if (rank := rank_of.get(lower)) is not None:
                costs.append(math.log10(rank + 1))
            elif word.isdigit() and len(word) <= 4:
                costs.append(float(len(word)))
            elif word.isalpha() and (len(word) <= 4 if len(words) == 1 else lower in SHORT):
                costs.append(len(word) * math.log10(26))
            elif len(word) > 2 and word.isalpha() and _SAID[0].search(word) and not _SAID[1].search(word):
                costs.append(min(OWN_WORD, len(word) * math.log10(26)))
            else:
                return None
    if len(costs) < 2 and not marked and parts[0] == value:
        return None
    return max(costs) + FURTHER * (len(costs) - 1)


@lru_cache(maxsize=1 << 16)
def guess_decades(value: str, quoted: bool = True) -> float:
    """log10 of the guesses that the cheapest way of guessing the value takes; 0 for the empty value. Work grows with its length."""
    if not value:
        return 0.0
    lower = value.lower()
    if len(lower) != len(value):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    n, size = len(value), math.log10(_charset(value))
    (rank_of, longest), near = _ranked(), _neighbours()
    plain = lower.translate(_PLAIN)
    texts = [(lower, 0.0), (plain, 0.7)] if plain != lower else [(lower, 0.0)]
    walks = _runs(n, lambda i: lower[i + 1] in near.get(lower[i], ""))
    steps = [_runs(n, lambda i: ord(lower[i + 1]) - ord(lower[i]) == step) for step in (1, -1)]
    again, far = repeats(lower), math.log10(n)
    best = [0.0] + [math.inf] * n
    open_: list[tuple[float, int]] = []  # repeats that have begun: what the value costs to their end, and the last place for that
    for i in range(n + 1):
        if i >= REPEAT and again[i - REPEAT] >= REPEAT:
            # From which earlier place, and how many characters: so much is guessed. All that go on are among `ways`.
            heapq.heappush(open_, (best[i - REPEAT] + math.log10(max(i - REPEAT, 1)) + far + 0.3, i - REPEAT + again[i - REPEAT]))
        while open_ and open_[0][1] < i:
            heapq.heappop(open_)
        if open_:
            best[i] = min(best[i], open_[0][0])
        if i == n:
            break
        ways = [(1, size)]
        if not i and (cost := expression(value, quoted)) is not None:
            ways.append((n, cost))
        if again[i] >= REPEAT:
            ways.append((again[i], math.log10(i) + 0.3))
        for width in range(3, min(longest, n - i) + 1):
            for text, more in texts:
                if (rank := rank_of.get(text[i : i + width])) is not None:
                    shape = value[i : i + width]
                    ways.append((width, math.log10(rank + 1) + more + (0.0 if shape == lower[i : i + width] else 0.5)))
                    break
        if lower[i].isdigit() and (m := _DATE.match(value, i)):
            ways.append((m.end() - i, 4.5 if m.end() - i > 4 else 2.1))
        if (width := walks[i] + 1) >= 3:
            ways.append((width, 1.7 + 0.6 * math.log10(width) + 0.2 * (width - 1)))
        for run in steps:
            if (width := run[i] + 1) >= 3:
                ways.append((width, 1.3 + math.log10(width)))
        for width, cost in ways:
            joint = 0.3 if i and width > 1 else 0.0
            best[i + width] = min(best[i + width], best[i] + cost + joint)
    return best[n]


def spans(text: str) -> list[tuple[int, int, int]]:
    """All spans (start, kind's number, end), sorted."""
    out = []
    lower = text.lower()
    if "pass" in lower or "secret" in lower or "token" in lower or "api" in lower:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in lower for h in _CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".")
            if len(value) >= 6 and guess_decades(value, _quoted(text, m.start(1))) >= MIN_DECADES:
                out.append((m.start(1), 3, m.start(1) + len(value)))
    return sorted(out)


def _quoted(text: str, start: int) -> bool:
    return start > 0 and text[start - 1] in "\"'`"


def _is_code(text: str, start: int, end: int) -> bool:
    """Whether an `assign` span's value is a cheap expression of several names, or a call."""
    m = ASSIGN.match(text, start, end)
    cost = expression(m[2], _quoted(text, m.start(2)))
    return cost is not None and cost < MIN_DECADES and (re.search(r"[._-]", m[2]) is not None or text[end : end + 1] in ("(", "["))


def found(text: Column) -> Column:
    """The spans of each text: array<struct<kind,start,end>>, in order of start, then of kind."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    @tk.lean
    def scan(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t or "")] for t in column.to_pylist()], kind)

    return scan(text)


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with the spans of secrets in column `out`."""
    return docs.withColumn(out, found(F.col(text)))


def redacted(text: Column, mark: str = "[SECRET]") -> Column:
    """Each text with its secrets replaced by the mark, spans that overlap as one; null stays null. Assigned values that are code stay."""

    @F.arrow_udf("string")
    @tk.lean
    def cleaned(column: pa.Array) -> pa.Array:
        out = []
        for value in column.to_pylist():
            parts, at = [], 0
            for start, kind, end in spans(value) if value else ():
                if kind == 0 and _is_code(value, start, end):
                    continue
                if start >= at:
                    parts += [value[at:start], mark]
                at = max(at, end)
            out.append("".join([*parts, value[at:]]) if parts else value)
        return pa.array(out, pa.string())

    return cleaned(text)
