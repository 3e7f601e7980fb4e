"""Anagram hashing against brute force over all pairs of words."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidewheel.llm import spelling


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(seed=1):
    """Few letters, so that anagrams, repeated letters and near words are many."""
    r = random.Random(seed)
    words = {"".join(r.choice("abñ") for _ in range(r.randint(1, 9))) for _ in range(250)}
    words |= {"".join(r.sample("edcbaéÿ", 7)) for _ in range(150)} | {"a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 150, "😀bc", "😀b", "bc"}
    for w in sorted(words)[:60]:
        i = r.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :]}
    return sorted(words - {""})


def test_keys_meet():
    words = vocabulary()
    place, anagram, rest, part = spelling.keys(words)
    by = {}
    for p, a, r, k in zip(place.tolist(), anagram.tolist(), rest.tolist(), part.tolist()):
        by.setdefault((a, r), []).append((p, k))
    met = set()
    for rows in by.values():
        met |= {frozenset((x, y)) for x, k in rows for y, m in rows if x != y and (k, m) in ((0, 0), (1, 2))}
    near = {frozenset(x) for x in combinations(range(len(words)), 2) if one_apart(words[x[0]], words[x[1]])}
    assert near <= met and len(near) > 300
    assert len(met) < 1.3 * len(near)  # the order of letters outside the block leaves few others
    long = spelling.keys(["ab" * 5000])
    assert len(long[0]) <= 2 * 2 * spelling.BLOCKS + spelling.BLOCKS
    ana = spelling.keys(["listen", "silent"])
    assert len(set(ana[1][ana[3] == 1].tolist())) == 1 and int(ana[1][ana[3] == 1][0]) == sum(ord(c) ** 5 for c in "listen") and ana[1].dtype == np.uint64


def brute(counts, ratio):
    out = {}
    for w, n in counts.items():
        near = [(-counts[x], x) for x in counts if one_apart(w, x)]
        top = min(near, key=lambda x: (x[0], x[1].encode())) if near else None
        taken = top and -top[0] >= ratio * n
        out[w] = [top[1] if taken else None, None, n, len(near), -top[0] if taken else None]
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def test_variants(spark):
    r = random.Random(2)
    counts = {w: r.choice([1, 2, 5, 10, 11, 20, 100, 110, 1000, 12000]) for w in vocabulary()}
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.variants(rows, ratio=5).collect()}
    want = brute(counts, 5)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 80 and any(want[v[0]][0] for v in want.values() if v[0])
    assert spelling.variants(rows.where("false")).count() == 0


def test_long_chains(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(40)]
    assert {r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()} == {"w40"}


def test_runs_and_counts(spark, edge, none):
    rows = spark.createDataFrame([("Ünïcode123École-naïve ABCDEFGH", 1), (None, 2), ("", 3), ("日本abcdefgh", 4)], "text string, k int")
    got = [r["r"] for r in rows.select(spelling.runs(F.col("text"), 5).alias("r")).collect()]
    assert got == [["Ünïcode", "École", "naïve", "abcdefgh"], None, [], ["abcdefgh"]]
    words = rows.select(F.explode(spelling.runs(F.col("text"), 5)).alias("word"))
    assert [tuple(r) for r in spelling.counted(words).collect()] == [("abcdefgh", 2)]
    own = edge.select(F.explode(spelling.runs(F.col("text"), 7)).alias("word"))
    counts = {r["word"]: r["n"] for r in spelling.counted(own).collect()}
    texts = [r["text"] or "" for r in edge.collect()]
    want = Counter(w for t in texts for w in re.findall("[a-zÀ-ÿ]{7,}", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    assert counts == {w: n for w, n in want.items() if n > 1} and len(counts) > 500
    assert spelling.counted(none.select(F.explode(spelling.runs(F.col("text"))).alias("word"))).count() == 0
