"""Language identification by rank-order profiles.

A profile is a language's PROFILE most frequent character n-grams (1 to 4 letters, words joined by a boundary mark), in order of
frequency. A text's own most frequent n-grams are compared with each profile: an n-gram costs the distance between its
two ranks, or PROFILE if the profile lacks it, and the language with the least sum wins.

Profiles are fitted on about SAMPLE different labelled texts of each language, chosen by a hash of the text; copies count once. Whole texts are
used in fitting and in prediction.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text where nothing was
learned; rows without a label are not learned from. Ties between n-grams go by code, between languages by name. The score
is the winner's lead over the next language, 0 to 1. A column of the output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

ORDERS = 4
PROFILE = 400
#: About as many different labelled texts of each language are learned from; it bounds the fit, not the prediction.
SAMPLE = 4000
UNKNOWN = "und"
_EDGE = 0x5F


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, as codes of 16 bits a letter in ascending order, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.where(codes > 0xFFFF, 0xE000 + codes % 0x1800, codes)
    codes = np.where(letter, codes, _EDGE)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    own = np.concatenate(([_EDGE], codes[kept], [_EDGE])).astype(np.uint64)
    if own[1] == _EDGE:
        own = own[1:]
    if own[-2] == _EDGE:
        own = own[:-1]
    grams = [own[own != _EDGE]]
    run = own
    for n in range(2, ORDERS + 1):
        run = (run[:-1] << np.uint64(16)) | own[n - 1 :] if len(run) > 1 else run[:0]
        grams.append(run)
    return np.unique(np.concatenate(grams), return_counts=True)


def _ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


class Profiles:
    """The learned languages, in order of name, and the rank of each known n-gram in each; -1 where it has none."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.names = sorted(ranked)
        self.codes = np.array(sorted({c for codes in ranked.values() for c in codes}), dtype=np.uint64)
        self.ranks = np.full((len(self.names), len(self.codes)), -1, dtype=np.int64)
        for row, name in enumerate(self.names):
            self.ranks[row, np.searchsorted(self.codes, np.array(ranked[name], dtype=np.uint64))] = np.arange(len(ranked[name]))

    def predict(self, text: str) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = _ranked(codes, counts)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == top, self.ranks[:, at], -1)
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        order = np.argsort(apart, kind="stable")
        best = float(apart[order[0]])
        other = float(apart[order[1]]) if len(order) > 1 else float(PROFILE * len(top))
        return self.names[order[0]], (other - best) / other if other else 0.0


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles of the labels in docs; rows with a null text or label are left out."""
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")
    rows = rows.withColumn("name", F.xxhash64(F.lit("langid"), "text"))
    sizes = {r["label"]: r["count"] for r in rows.select("label", "name").distinct().groupBy("label").count().collect()}
    if not sizes:
        return Profiles({})
    share = F.element_at(F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / n)))), F.col("label"))
    chosen = rows.where(F.pmod("name", F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["label", "name"]).select("text", "label")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, tuple[list, list]] = {}
            for one, name in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                codes, counts = ngrams(one)
                held = by.setdefault(name, ([], []))
                held[0].append(codes)
                held[1].append(counts)
            for name, (codes, counts) in by.items():
                different, where = np.unique(np.concatenate(codes), return_inverse=True)
                sums = np.bincount(where, weights=np.concatenate(counts), minlength=len(different))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(different), pa.string()), pa.array(different.view(np.int64)), pa.array(sums.astype(np.int64))],
                    names=["label", "code", "n"],
                )

    counts = chosen.mapInArrow(counted, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("label").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PROFILE).collect()
    ranked: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: r["rank"]):
        ranked.setdefault(r["label"], []).append(r["code"] % (1 << 64))
    return Profiles(ranked)


def language(text: Column, profiles: Profiles) -> Column:
    """struct<lang, score> of each text."""

    @F.arrow_udf("struct<lang:string,score:double>")
    @tk.lean
    def predicted(column: pa.Array) -> pa.Array:
        out = [profiles.predict(t or "") for t in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], names=["lang", "score"])

    return predicted(text)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", out: str = "language") -> DataFrame:
    """docs with the predicted language of each text and its score in column `out`."""
    return docs.withColumn(out, language(F.col(text), profiles))
