"""Ropes and the fill-in-the-middle transformation against slices of lists of lines."""

import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import fim

PIECES = st.lists(st.sampled_from(["a", "b", "\n", "\n\n", "ü", "日本", "😀", " ", "<", "<S", "S>", "M>", ">", "x" * 9]), max_size=40).map("".join)


@given(PIECES, st.integers(1, 7), st.integers(0, 60))
def test_splits(text, leaf, rank):
    rope, lines = fim.Rope.of(text, leaf=leaf), re.findall(r"[^\n]*\n|[^\n]+", text)
    assert str(rope) == text and rope.chars == len(text) and rope.units() == len(lines)
    a, b = rope.split_units(rank)
    assert (str(a), str(b)) == ("".join(lines[:rank]), "".join(lines[rank:])) and a.units() == len(lines[:rank]) and b.chars == len(str(b))
    a, b = rope.split_chars(rank)
    assert (str(a), str(b)) == (text[:rank], text[rank:]) and a.closed == text[:rank].count("\n")
    for mark in ("\n\n", "a", "<S>", "日本"):
        assert rope.find(mark, rank) == text.find(mark, rank)


@given(PIECES, st.sampled_from(["psm", "spm", "plain"]), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(1, 9))
def test_round_trip(text, form, first, second, leaf):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if any(s in text for s in fim.SENTINELS):
        form = "plain"
    n, prefix, middle, out = fim.cut(text, form, first, second, leaf=leaf)
    i, j = sorted((first % (len(lines) + 1), second % (len(lines) + 1)))
    p, m, s = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    assert (n, out) == (len(lines), want)
    assert (prefix, middle) == ((None, None) if form == "plain" else (len(p), len(m)))
    assert fim.restore(out, form, leaf=leaf) == text


def test_not_outputs():
    assert fim.restore(None, "psm") is None and fim.restore("x", None) is None and fim.restore("x", "other") is None
    assert fim.restore("<P>a<M>b<S>c", "psm") is None and fim.restore("a<P><S><M>", "psm") is None and fim.restore("<P><S><M>", "psm") == ""


def test_rows(spark, edge, none):
    docs = edge.withColumn("form", F.lit("mine"))
    rows = fim.transform(docs).collect()
    assert len(rows) == edge.count() and {r["form"] for r in rows} == {"mine"}
    for r in rows:
        text, x = r["text"] or "", r["fim"]
        h = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
        form = "plain" if not text else "spm" if h[3] % 100 < 50 else "psm"
        assert (x["n"], x["prefix_chars"], x["middle_chars"], x["output"]) == fim.cut(text, form, h[0], h[1], leaf=10**9) and x["form"] == form
    same = fim.transform(docs).select(fim.restored(F.col("fim.output"), F.col("fim.form")).alias("a"), F.coalesce("text", F.lit("")).alias("b"))
    assert same.where("not (a <=> b)").count() == 0
    assert fim.transform(none).count() == 0
    half = fim.transform(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\n").alias("text")), rate=50, spm=0).groupBy("fim.form").count().collect()
    counts = {r["form"]: r["count"] for r in half}
    assert set(counts) == {"plain", "psm"} and 140 < counts["psm"] < 260


def test_marked_texts_stay(spark):
    rows = spark.createDataFrame([(1, "a<P>b\n"), (2, "a\n<M>"), (3, "<S>")], "doc_id long, text string")
    assert [(r["fim"]["form"], r["fim"]["output"] == r["text"]) for r in fim.transform(rows).collect()] == [("plain", True)] * 3
