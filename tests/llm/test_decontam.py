"""The positional index against brute force over all windows, on texts of few words, so that many lists meet."""

import math
import random
import re
from collections import Counter

import pytest

from tidewheel.llm import decontam

KIND = "doc_id long, text string, items string, c0 string, row string"


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size, slop, least):
    """{(doc, item, start, first, n)}; a document is its place in the list."""
    often = Counter(w for t in docs for w in split(t))
    out = set()
    for name, text in items:
        words = split(text)
        for first in range(max(0, len(words) - size) + 1) if words else ():
            places = list(range(first, min(first + size, len(words))))
            if any(not often[words[p]] for p in places):
                continue
            rare = sorted(places, key=lambda p: (often[words[p]], p))[:2]
            for k, t in enumerate(docs):
                own = split(t)
                near = lambda p, start: any(0 <= start + p + e < len(own) and own[start + p + e] == words[p] for e in range(-slop, slop + 1))
                for start in range(-len(words) - slop, len(own)):
                    at = start + rare[0]
                    if not (0 <= at < len(own) and own[at] == words[rare[0]]):
                        continue
                    if (len(rare) < 2 or near(rare[1], start)) and sum(near(p, start) for p in places) >= math.ceil(len(places) * least):
                        out.add((k, name, start + first, first, len(places)))
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    letters = "a B c d e é F 日本 g1".split()
    say = lambda n, k=9: r.choice([" ", ". ", "-", "\n"]).join(r.choice(letters[:k]) for _ in range(n))
    items = [(1, say(6)), (2, say(4)), (3, say(2)), (4, "é"), (5, ""), (6, None), (None, say(5)), (7, "nowhere here a"), (8, say(8, 2)), (9, "...")]
    items += [(10, items[0][1].upper().replace("É", "é")), (1, items[0][1]), (11, say(5, 3))]
    docs = [say(r.randint(0, 60)) for _ in range(25)] + [f"({say(9)} {t or ''}) {say(3)}" for _, t in items] + [None, "", " .", items[0][1]] * 2
    return docs, items


@pytest.mark.parametrize(("size", "slop", "least"), [(4, 0, 1.0), (10, 0, 1.0), (3, 1, 1.0), (4, 2, 0.7)])
def test_matches(spark, corpus, size, slop, least):
    docs, items = corpus
    rows = spark.createDataFrame([(k, t, "mine", None, "r") for k, t in enumerate(docs)], KIND)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.phrases(rows, tests, size=size, slop=slop, least=least).collect()]
    want = brute(docs, [(None if n is None else str(n), t) for n, t in items], size, slop, least)
    assert set(got) == want and len(got) == len(set(got)) and len(want) > 50


def test_same_rows_beyond_the_bound(spark, corpus):
    """Joined by shuffle, the lists give the same."""
    docs, items = corpus
    rows = spark.createDataFrame([(k, t, "mine", None, "r") for k, t in enumerate(docs)], KIND)
    tests = decontam.Items(spark.createDataFrame(items, "item_id long, text string"))
    one, two = (decontam.Index(rows, tests, small=n).matches(4).drop("item") for n in (1, 10**6))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_contamination(spark, corpus, edge, none):
    docs, items = corpus
    rows = spark.createDataFrame([(k if k % 3 else None, t, "mine", str(k), "r") for k, t in enumerate(docs)], KIND)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(rows, tests, size=4)
    assert got.columns == ["doc_id", "text", "c0", "row", "n_words", "n_hit", "items", "contaminated"]
    found = {int(r["c0"]): r for r in got.collect()}
    want = brute(docs, [(None if n is None else str(n), t) for n, t in items], 4, 0, 1.0)
    assert len(found) == len(docs)
    for k, t in enumerate(docs):
        own = [m for m in want if m[0] == k]
        hit = {p for _, _, start, _, n in own for p in range(start, start + n)}
        names = sorted({m[1] for m in own} - {None})
        assert (found[k]["n_words"], found[k]["n_hit"], found[k]["items"], found[k]["contaminated"]) == (len(split(t)), len(hit), names, bool(hit)), k
    passage = " ".join(edge.where("doc_id = 7").first()["text"].split()[15_000:15_030])
    whole = decontam.contamination(edge, spark.createDataFrame([(1, passage), (2, "one")], "item_id long, text string"))
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in whole.where("contaminated").collect()} == {7: (30, ["1"]), 9: (1, ["2"])}
    assert whole.count() == edge.count() and "class_id" in whole.columns
    assert decontam.contamination(none, tests).count() == 0
    assert decontam.contamination(edge, tests.where("false")).where("contaminated or n_hit > 0 or size(items) > 0").count() == 0


def test_no_python(spark, corpus):
    docs, items = corpus
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    plan = decontam.contamination(rows, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
