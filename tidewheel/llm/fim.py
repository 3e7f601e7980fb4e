"""Fill-in-the-middle transformation of texts held as ropes.

A rope is a binary tree whose leaves hold at most LEAF code points of the text, and whose nodes cache the code points and the closed units
below them. A unit ends with the delimiter (a line, by default); the last one may end with the text. A text is cut by splitting its tree at two
unit ranks: the prefix ends after the smaller, the middle after the larger, the suffix is the rest. The three subtrees are joined in another order
with sentinels before them, and nothing is copied but at the two leaves that a cut goes through. The transformation is undone by splitting
the output's tree at its sentinels, by code points.

Forms: `plain`, the text itself; `psm`, prefix, suffix, middle; `spm`, suffix, prefix, middle; each part follows its sentinel. A
text that is empty, or has one of the sentinels in it, stays plain, so the first places of the sentinels in an output are the true ones.

The ranks and the form of a row come from the first four groups of eight digits of the SHA-256 of `seed:key`, so they don't depend on how the
rows are dealt; equal rows come out alike. Every row is worked on alone, whole, with memory in proportion to its text: nothing is shuffled.

Defined results: a null text counts as empty, a null key as an empty one; the length in characters of prefix and middle is null in plain
rows. `restored` of a null output or form, of an unknown form, or of an output without its sentinels in order is null. A column of
the output's name is replaced; all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

LEAF = 2048
#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The order of the parts, 0 to 2 as in SENTINELS, in each form but plain.
FORMS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}


class Rope:
    """A leaf with text, or a node of two ropes; counts of all below it."""

    __slots__ = ("text", "left", "right", "chars", "closed")

    def __init__(self, text: str = "", delimiter: str = "\n", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.chars, self.closed = len(text), text.count(delimiter)
        else:
            self.chars, self.closed = left.chars + right.chars, left.closed + right.closed

    @classmethod
    def of(cls, text: str, delimiter: str = "\n", leaf: int = LEAF) -> Rope:
        """A balanced rope of a text."""
        level = [cls(text[i : i + leaf], delimiter) for i in range(0, len(text), leaf)] or [cls()]
        while len(level) > 1:
            pairs = [cls(left=a, right=b) for a, b in zip(level[::2], level[1::2])]
            level = pairs + level[2 * len(pairs) :]
        return level[0]

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            at = todo.pop()
            if at.left is None:
                yield at.text
            else:
                todo += (at.right, at.left)

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __add__(self, other: Rope) -> Rope:
        if not self.chars or not other.chars:
            return other if not self.chars else self
        return Rope(left=self, right=other)

    def _last(self) -> str:
        at = self
        while at.left is not None:
            at = at.right
        return at.text

    def units(self, delimiter: str = "\n") -> int:
        return self.closed + bool(self.chars and not self._last().endswith(delimiter))

    def split_units(self, rank: int, delimiter: str = "\n") -> tuple[Rope, Rope]:
        """The first `rank` units, and the rest."""
        if rank <= 0:
            return Rope(), self
        if rank > self.closed:
            return self, Rope()
        if self.left is not None:
            if rank <= self.left.closed:
                a, b = self.left.split_units(rank, delimiter)
                return a, b + self.right
            a, b = self.right.split_units(rank - self.left.closed, delimiter)
            return self.left + a, b
        at = 0
        for _ in range(rank):
            at = self.text.index(delimiter, at) + len(delimiter)
        return Rope(self.text[:at], delimiter), Rope(self.text[at:], delimiter)

    def split_chars(self, rank: int, delimiter: str = "\n") -> tuple[Rope, Rope]:
        """The first `rank` code points, and the rest."""
        if rank <= 0:
            return Rope(), self
        if rank >= self.chars:
            return self, Rope()
        if self.left is not None:
            if rank <= self.left.chars:
                a, b = self.left.split_chars(rank, delimiter)
                return a, b + self.right
            a, b = self.right.split_chars(rank - self.left.chars, delimiter)
            return self.left + a, b
        return Rope(self.text[:rank], delimiter), Rope(self.text[rank:], delimiter)

    def find(self, mark: str, start: int = 0) -> int:
        """The place of the first `mark` from `start` on, in code points; -1 if there is none."""
        at, tail = 0, ""
        for text in self.leaves():
            whole, base = tail + text, at - len(tail)
            if (place := whole.find(mark, max(0, start - base))) >= 0:
                return base + place
            at += len(text)
            tail = whole[len(whole) - min(len(whole), len(mark) - 1) :]
        return -1


def cut(text: str, form: str, first: int, second: int, sentinels: tuple[str, str, str] = SENTINELS, delimiter: str = "\n", leaf: int = LEAF) -> tuple[int, int | None, int | None, str]:
    """Units, characters of prefix and middle, and the output. The ranks are taken modulo the units and one."""
    rope = Rope.of(text, delimiter, leaf)
    n = rope.units(delimiter)
    if form not in FORMS:
        return n, None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    prefix, rest = rope.split_units(low, delimiter)
    middle, suffix = rest.split_units(high - low, delimiter)
    parts, out = (prefix, suffix, middle), Rope()
    for k in FORMS[form]:
        out = out + Rope(sentinels[k], delimiter) + parts[k]
    return n, prefix.chars, middle.chars, str(out)


def restore(output: str | None, form: str | None, sentinels: tuple[str, str, str] = SENTINELS, leaf: int = LEAF) -> str | None:
    """The text that an output was made of."""
    if output is None or form == "plain":
        return output
    if form not in FORMS:
        return None
    rest, parts, order = Rope.of(output, leaf=leaf), {}, FORMS[form]
    if rest.find(sentinels[order[0]]) != 0:
        return None
    for k, following in zip(order, (*order[1:], None)):
        rest = rest.split_chars(len(sentinels[k]))[1]
        place = rest.find(sentinels[following]) if following is not None else rest.chars
        if place < 0:
            return None
        parts[k], rest = rest.split_chars(place)
    return str(parts[0] + parts[2] + parts[1])


def _draws(key: Column, seed: int) -> list[Column]:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "fim", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, delimiter: str = "\n") -> DataFrame:
    """docs with column `out`: struct<n, form, prefix_chars, middle_chars, output>. Of a hundred texts `rate` are cut, and of a hundred of those
    `spm` get that form."""
    whole = F.coalesce(F.col(text), F.lit(""))
    first, second, third, fourth = _draws(F.col(key), seed)
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | F.contains(whole, F.lit(s))
    form = F.when((whole == "") | marked | (third % 100 >= rate), "plain").when(fourth % 100 < spm, "spm").otherwise("psm")

    @F.arrow_udf("struct<n:long,prefix_chars:long,middle_chars:long,output:string>")
    @tk.lean
    def done(texts: pa.Array, forms: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        rows = [cut(*row, sentinels, delimiter) for row in zip(*(c.to_pylist() for c in (texts, forms, firsts, seconds)))]
        kinds = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
        columns = zip(*rows) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    made = docs.withColumn(out, F.struct(form.alias("form"), done(whole, form, first, second).alias("x")))
    x, form = F.col(f"`{out}`.x"), F.col(f"`{out}`.form")
    return made.withColumn(out, F.struct(x["n"].alias("n"), form.alias("form"), x["prefix_chars"].alias("prefix_chars"), x["middle_chars"].alias("middle_chars"), x["output"].alias("output")))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that each output was made of."""

    @F.arrow_udf("string")
    @tk.lean
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([restore(a, b, sentinels) for a, b in zip(outputs.to_pylist(), forms.to_pylist())], pa.string())

    return back(output, form)
