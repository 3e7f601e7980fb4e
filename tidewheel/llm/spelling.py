"""Spelling variants by anagram hashing.

A word's anagram key is the sum of its letters' fifth powers (of their code points, modulo 2**64): a whole number that all orders of the
same letters share. Two words that differ by one letter have keys that differ by that letter's power, or by the difference of two letters'.
Such keys are joined on what they have in common:

* an addition or removal: the shorter word's key is the longer one's less the power of one of its letters;
* an exchange: the keys of two words of one length are equal, each less the power of one of its letters.

So a word gives its own key, and its key less each of its letters, instead of its key and all of the alphabet's differences. As the words of
many texts have large groups of anagrams, keys meet only if the order of letters agrees in three of four blocks of the word as well: the
change lies in the fourth. A key is joined together with a hash of the letters outside that block. Of words whose keys meet the order of all letters is
verified: exactly one letter is inserted, deleted or replaced.

A word's form is its near word of the largest count, if that is at least RATIO times the word's own; forms of forms lead to a root. As counts
grow by RATIO at each step, there are few steps, and the links are followed by doubling.

How it is distributed. Words are counted before the shuffle; keys are made of the different words and met by a join, which holds no group of
equal keys in memory. A word gives a row for each different letter of each block, so a very long one gives no more rows than the alphabet and the
blocks allow.

Defined results: a null text has no words; a null or empty word is not counted. Repeated rows count again. An empty table gives no rows. Of near
words with equal counts the first in code-point order is the form. Only the words' columns (word, n) are read; others are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import stored

#: Letters besides A-Z and a-z, a range of code points.
MORE = "À-ÿ"
LENGTH, OFTEN, RATIO = 7, 2, 10
BLOCKS, POWER = 4, 5
#: Bytes of words whose keys are made together.
SLICE = 1 << 17
_KEYS = "anagram long, rest long, part tinyint, word string, n long"


def runs(text: Column, least: int = 1, more: str = MORE) -> Column:
    """The maximal runs of `least` letters or more of a text, with A-Z in lower case."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.regexp_extract_all(low, F.lit(f"[a-z{more}]{{{least},}}"), F.lit(0))


def counted(words: DataFrame, word: str = "word", length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """(word, n): the different words of at least `length` letters, and how often each occurs, if `often` or more times."""
    return words.where(F.length(word) >= length).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def _outside(data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A hash of each word's letters before `low` and from `high` on, and of the tag."""
    before, after = tk.hashes(data, start, start + low), tk.hashes(data, start + high, end)
    return tk.mix64(before + tk.mix64(after ^ tk.mix64(tag.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))))


def keys(words: list[str], blocks: int = BLOCKS) -> tuple[np.ndarray, ...]:
    """(word's place, anagram key, hash of the rest, part) of rows that meet: part 0 meets 0, an exchange; 1, a word itself, meets 2, a word less a
    letter."""
    data = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size)
    start = end - size
    power = np.ones(len(data), dtype=np.uint64)
    for _ in range(POWER):
        power = power * data
    own = np.add.reduceat(power, start)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(data)) - start[word]
    out = []
    each = np.repeat(np.arange(len(words)), blocks)
    block = np.tile(np.arange(blocks), len(words))
    n = size[each]
    out.append((each, own[each], _outside(data, start[each], end[each], block * n // blocks, (block + 1) * n // blocks, (n * 2 + 1) * blocks + block), np.ones(len(each), np.int8)))
    for part, less in ((0, 0), (2, 1)):
        n = size[word] - less  # the length that blocks are cut by: of the shorter word
        block = np.minimum(((at + 1) * blocks - 1) // np.maximum(n, 1), blocks - 1)  # the last whose first letter is at or before the place
        low, high = block * n // blocks, (block + 1) * n // blocks
        letter = (word.astype(np.uint64) * np.uint64(blocks) + block.astype(np.uint64)) * np.uint64(1 << 21) + data
        first = np.unique(letter, return_index=True)[1]  # a letter of a block gives the same row wherever it stands there
        w, b = word[first], block[first]
        rest = _outside(data, start[w], end[w], low[first], high[first] + less, (n[first] * 2 + less) * blocks + b)
        out.append((w, own[w] - power[first], rest, np.full(len(first), part, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("n")
        for a, b in tk.slices(words, SLICE):
            place, anagram, rest, part = keys(words[a:b])
            taken = pa.array(place + a)
            columns = [pa.array(anagram.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(part), batch.column("word").take(taken), counts.take(taken)]
            yield pa.RecordBatch.from_arrays(columns, names=["anagram", "rest", "part", "word", "n"])
    tk.released()


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): the pairs of different words that are one letter apart, each in both directions. words has (word, n), every word once."""
    given = words.where("word <> ''").select("word", "n").mapInArrow(_made, _KEYS)
    # Parts 0 and 0, or 1 and 2, as a condition on both sides: so both read the same rows, which are made and shuffled once.
    parts = (F.col("a.part") * 3 + F.col("b.part")).isin(0, 5) & ((F.col("a.part") > 0) | (F.col("a.word") < F.col("b.word")))
    same = (F.col("a.anagram") == F.col("b.anagram")) & (F.col("a.rest") == F.col("b.rest"))
    met = given.alias("a").join(given.alias("b"), same & parts & (F.levenshtein("a.word", "b.word", 1) == 1))
    pairs = met.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct()
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame, rounds: int = 16) -> DataFrame:
    """(word, root) of links (word, form), without circles: each round doubles the steps that are taken. More rounds are an error."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        step = now.join(now.select(F.col("word").alias("at"), F.col("root").alias("next")), F.col("root") == F.col("at"), "left")
        new = stored(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now
    raise RuntimeError(f"links of more than 2 ** {rounds} steps, or in a circle")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """The words (word, n), every word once, with `form`, `root`, `n_near` and `form_n`."""
    words = stored(words.select("word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    around = near(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    taken = -F.col("best.less") >= F.col("n") * ratio
    formed = stored(around.select("word", "n_near", F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "spelling-near")
    ends = roots(formed.where("form is not null"))
    met = words.join(formed, "word", "left").join(ends, "word", "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
