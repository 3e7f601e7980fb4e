"""Toxicity of texts, read through a noisy channel.

Insults are often written with leetspeak, spacing or repeated letters. A token that may hide a word becomes a lattice: each
character may stand for itself, for the letters it imitates, for a mere separator, or for the repetition of the
letter before it; in runs of single characters, separators may also be the edge of a word. Viterbi's algorithm picks the reading with the best sum of channel costs and of log-probabilities
under a character trigram model, and the restored words are scored.

* The character model counts the letter trigrams of all documents, in a table of at most ALPHABET**3 cells, and gives the
  learned lexicon a fixed share of its mass, so that a hidden insult is worth reading as one.
* The lexicon holds words that labelled texts of class 1 have far more often than others, by a
  likelihood ratio, and seldom otherwise. It is learned from about SAMPLE labelled texts, chosen by a hash of their key; four fifths of
  them give the lexicon, the rest the logistic calibration of a text's score; where a part lacks a class, all of them take its place.

Defined results: null and empty texts have no findings and get the score of any text without findings; without labels
every score is the prior 0.5, and 0 where all labels are of one class: nothing sets toxic texts apart then. Where no word was
learned (`Model.learned`), scores are the same for all texts and are no reason to drop one. Several labels of a key count as 1 if any is 1; null labels are left out. Labels
whose key is null or unknown have no effect. Repeated rows get equal scores. A column of the output's name is replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from . import textkit as tk
from .scratch import stored

#: About as many labelled texts are learned from; it bounds the fit, not the scoring.
SAMPLE = 30_000
#: The lexicon's entries have at least this likelihood ratio (twice the log). That takes several texts of the sample each, so the sample bounds their number.
EVIDENCE = 25.0
#: And at least this share of the texts that have an entry is of class 1.
PURITY = 0.75
#: Of the character model's mass, the lexicon's share.
LEXICON_SHARE = 0.1
#: Entries kept by a worker of what tokens say; only time depends on it.
CACHE = 1 << 18
#: A word with a doubled letter that so many clean texts of the sample have is a plain word.
PLAIN_TEXTS = 2

# Letters with a class of their own, and the letters that each character imitates.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüÿß"
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "×": "x",
}
SEPARATORS = " .-_*~'`,:;/\\+|!#%&$=^\"()[]{}<>?"

ALPHABET = 64
_CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
_OTHER = len(LETTERS) + 1
_SAME, _IMITATED, _SKIPPED, _REPEATED = 0.0, 1.0, 1.5, 0.7
_DRESS = re.compile(r"([^\w\s])\1+$|^([^\w\s])\2+")
_STRIP = " .,;:?\"'()[]{}<>«»“”„-–—_*#%&^~`/\\="
_PLAIN_CUT = re.compile(r"[^\W\d_]+")
_TWICE, _THRICE = re.compile(r"([^\W\d_])\1"), re.compile(r"(.)\1\1")
_BETWEEN = re.compile("[" + re.escape("".join(c for c in SEPARATORS if c not in IMITATES)) + "]+")
# Letters that one character imitates count as one, and a character that imitates letters as them.
_LIKE = str.maketrans({"l": "i", "g": "b"} | {c: x[0].translate({108: "i", 103: "b"}) for c, x in IMITATES.items() if c not in SEPARATORS})
_EITHER = frozenset(IMITATES) & frozenset(SEPARATORS)
_AGAIN = re.compile(r"(.)\1+")
_ALONE = "[" + re.escape("".join(c for c in IMITATES if not c.isalnum())) + "]"
#: Three or more single characters, with anything but letters and digits between two: letters and digits, or characters that imitate letters.
_SPACED = re.compile(
    rf"(?:(?<!\S){_ALONE}[\s.\-_*]++)*(?<![^\W_])[^\W_](?:[\W_]++[^\W_](?![^\W_]))+(?:[\s.\-_*]++{_ALONE}(?!\S))*|(?<!\S)(?:{_ALONE}[\s.\-_*]++)+[^\W_](?![^\W_])(?:[\s.\-_*]++{_ALONE}(?!\S))*"
    rf"|(?<![^\W_])[^\W_](?:[\s.\-_*]++{_ALONE}(?!\S)){{2,}}|(?<!\S)(?:{_ALONE}[\s.\-_*]++){{2,}}{_ALONE}(?!\S)"
)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.fromiter((_OTHER if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.int64, count=0x110000)
    for c, k in _CLASS.items():
        out[ord(c)] = k
        if len(c.upper()) == 1:
            out[ord(c.upper())] = k
    return out


def _trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams of letter classes in a text; 0 is a word's edge, and two of them precede a word."""
    own = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    own = np.concatenate(([0], own, [0]))
    kept = own > 0
    kept[1:] |= own[:-1] > 0
    own = own[kept]
    before = np.concatenate(([0], own[:-1]))
    before2 = np.where(before == 0, 0, np.concatenate(([0, 0], own[:-2]))[: len(own)])
    return (before2 * ALPHABET + before) * ALPHABET + own


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each trigram occurs in all texts; a task holds one table, and the driver gets their sum."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, dtype=np.int64)
        for batch in batches:
            for part in joined_slices(batch.column(0).to_pylist()):
                total += np.bincount(_trigrams(part), minlength=ALPHABET**3)
        tk.released()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["cell", "n"])

    rows = docs.select(text).mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(ALPHABET**3, dtype=np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out


def joined_slices(texts: list) -> Iterator[str]:
    """The texts joined by new lines, about a megabyte at a time."""
    texts = [t or "" for t in texts]
    for a, b in tk.slices(texts):
        yield "\n".join(texts[a:b])


class CharacterModel:
    """Interpolated log-probabilities of a letter after two others."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * ALPHABET)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        logs = np.log((three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)).astype(np.float32)
        self.logs = array("f", logs.tobytes())

    def decode(self, token: str, split: bool = False) -> str:
        """The best reading of a lower-case token: letters, and, if `split`, a blank at each edge that was read within it.

        All states are kept: the class before the last letter, and the last letter; so at most ALPHABET**2 but for letters without a class."""
        logs, paths = self.logs, {(0, ""): (0.0, None)}
        for i, c in enumerate(token):
            reads = [(x, _CLASS[x], _IMITATED) for x in IMITATES.get(c, "")]
            if c.isalpha():
                reads.append((c, _CLASS.get(c, _OTHER), _SAME))
            skips, imitated = not c.isalpha() and (not reads or c in SEPARATORS), IMITATES.get(c, "")
            new: dict[tuple[int, str], tuple[float, tuple | None]] = {}
            for (a, last), (cost, text) in paths.items():
                b = (_CLASS.get(last, _OTHER) if last else 0)
                at = (a * ALPHABET + b) * ALPHABET
                for x, k, more in reads:
                    value, state = cost + more - logs[at + k], (b, x)
                    if state not in new or value < new[state][0]:
                        new[state] = (value, (text, x))
                if skips and ((a, last) not in new or cost + _SKIPPED < new[a, last][0]):
                    new[a, last] = (cost + _SKIPPED, text)
                if skips and split and last:
                    value = cost + _SKIPPED - logs[at]
                    if (0, "") not in new or value < new[0, ""][0]:
                        new[0, ""] = (value, (text, " "))
                if last and i and (c == token[i - 1] or last in imitated or last == c):
                    value = cost + _REPEATED
                    if (a, last) not in new or value < new[a, last][0]:
                        new[a, last] = (value, text)
            paths = new or paths
        ends = ((cost - (logs[(a * ALPHABET + _CLASS.get(last, _OTHER)) * ALPHABET] if last else 0.0), a, last) for (a, last), (cost, _) in paths.items())
        _, a, last = min(ends)
        out, link = [], paths[a, last][1]
        while link is not None:
            link, x = link
            out.append(x)
        return "".join(reversed(out))


def suspicious(token: str) -> bool:
    """Whether a token, stripped of what surrounds it, may hide a word: a letter twice in a row, or letters or imitations of letters
    mixed with anything else. Numbers are plain."""
    if token.isalpha():
        return _TWICE.search(token) is not None
    return any(c.isalpha() or c in IMITATES and not c.isdigit() for c in token)


def outline(token: str) -> str:
    """What all whole readings of a token have in common, if it has no character of _EITHER: its letters, with likes as one and repetitions once."""
    return _AGAIN.sub(r"\1", "".join(filter(str.isalpha, token.translate(_LIKE))))


def mixed(token: str) -> bool:
    """Whether a token can't be a plain or a compound word: letters mixed with imitations, or thrice a letter."""
    return _THRICE.search(token) is not None or not token.isalpha() and any(c in IMITATES or c in "*_.-" for c in token) and any(c.isalpha() for c in token)


def plain_words(text: str) -> set[str]:
    return set(_PLAIN_CUT.findall(text.lower()))


class Model:
    """lexicon: the weight of each word; curve: intercept and factors of the calibration; plain: words with a doubled letter that hide none."""

    def __init__(self, lexicon: dict[str, float], counts: np.ndarray, curve: tuple[float, float, float] = (0.0, 0.0, 0.0), plain: frozenset[str] = frozenset()):
        counts = counts.astype(np.float64)
        if lexicon:
            share = np.zeros_like(counts)
            for word in lexicon:
                np.add.at(share, _trigrams(word), 1.0)
            counts = counts * (1 - LEXICON_SHARE) + share * (LEXICON_SHARE * max(counts.sum(), 1.0) / share.sum())
        self.lexicon, self.characters, self.curve, self.plain = lexicon, CharacterModel(counts), curve, plain
        self.outlines = frozenset(map(outline, lexicon))
        self.known: dict[str, tuple[tuple[str, float], ...]] = {}

    @property
    def learned(self) -> bool:
        """Whether a text can be told from others; without it, every text has one score."""
        return bool(self.lexicon)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def readings(self, bare: str) -> list[str]:
        """Decoded readings of a stripped token that may hide a word: whole, and, where separators stand in it, with edges between words and by parts."""
        if bare in self.plain or bare in self.lexicon or not suspicious(bare):
            return []
        out = [self.characters.decode(bare)]
        if not bare.isalpha() and _BETWEEN.search(bare):
            out.append(self.characters.decode(bare, True))
            parts = _BETWEEN.split(bare)
            out += [self.characters.decode(p) for p in parts if len(p) > 1 and p not in self.plain and suspicious(p)]
        return out

    def may_hide(self, bare: str) -> bool:
        """False only where no reading of a stripped token has a word of the lexicon: every word read is a run of its outline's letters."""
        if not _EITHER.isdisjoint(bare):
            return True
        own = outline(bare)
        return own in self.outlines or not bare.isalpha() and _BETWEEN.search(bare) is not None and any(x in own for x in self.outlines)

    def restored(self, token: str) -> str:
        """A lower-case token as it is meant; a plain or compound word is read anew only if the reading is a known word."""
        bare = _DRESS.sub("", token).strip(_STRIP)
        read = self.readings(bare)
        return next((x for x in read[:2] if self._weights(x.split())), read[0] if read and mixed(bare) else bare)

    def _weights(self, words: list[str]) -> tuple[tuple[str, float], ...]:
        return tuple((w, self.lexicon[w]) for w in words if w in self.lexicon)

    def says(self, token: str) -> tuple[tuple[str, float], ...]:
        """The words in a token, as written, as its letters alone and as restored, that the lexicon knows, with their weights."""
        bare = _DRESS.sub("", token).strip(_STRIP)
        words = _PLAIN_CUT.findall(bare)
        for read in self.readings(bare) if suspicious(bare) and self.may_hide(bare) else ():
            words += _PLAIN_CUT.findall(read)
        if not bare.isalpha():
            words.append("".join(filter(str.isalpha, bare)))
        return self._weights(list(dict.fromkeys(words)))

    def findings(self, text: str) -> dict[str, float]:
        """Known words of the whole text with their weights."""
        if len(self.known) > CACHE:
            self.known.clear()
        lower, known, out = text.lower(), self.known, {}
        for token in set(lower.split()):
            if (said := known.get(token)) is None:
                said = known[token] = self.says(token)
            if said:
                out.update(said)
        for m in _SPACED.finditer(lower):
            out.update(self._weights([*self.spaced(m[0]), "".join(filter(str.isalpha, m[0]))]))
        return out

    def spaced(self, run: str) -> list[str]:
        """The words of a run of single characters: of its reading with edges, and that as one word. A run of numbers has none."""
        run = " ".join(run.split())
        if not any(c.isalpha() or c in IMITATES and not c.isdigit() for c in run):
            return []
        return [*self.characters.decode(run, True).split(), self.characters.decode(run)]

    def inputs(self, text: str) -> tuple[float, float]:
        """What the calibration sees: the greatest weight of a known word, and the logarithm of all weights' sum."""
        found = self.findings(text)
        return max(found.values(), default=0.0), math.log1p(sum(found.values()))

    def score(self, text: str) -> float:
        if self.curve[0] == -math.inf:
            return 0.0
        a, b = self.inputs(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * a + self.curve[2] * b))))


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, with a small quadratic penalty on the factors."""
    design, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.1, 0.1])
        w = w - np.linalg.solve(hessian, design.T @ (p - y) + np.array([0, 0.1, 0.1]) * w)
    return tuple(float(v) for v in w)


def _without_copies(rows: DataFrame) -> DataFrame:
    """Rows of a sample without copies and most near copies, whose words would else pass for evidence: of the texts that
    share the least hash of their word 5-grams one stays, and so again for two more hashes."""
    sketch = jaccard.signed(F.col("text"), jaccard.N, 3, 1)["bands"]
    narrow = rows.select("name", sketch.alias("least"), "label").groupBy("name").agg(F.first("least").alias("least"), F.max("label").alias("label"))
    narrow = narrow.select("name", *[F.coalesce(F.get("least", F.lit(i)), "name").alias(f"m{i}") for i in range(3)])
    for i in range(3):
        narrow = narrow.groupBy(f"m{i}").agg(F.min(F.struct("name", *[f"m{j}" for j in range(3) if j != i])).alias("x")).select(f"m{i}", "x.*")
    kept = rows.groupBy("name").agg(F.first("text").alias("text"), F.max("label").alias("label"), F.min("fold").alias("fold"))
    return kept.join(narrow.select("name"), "name")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of the labels. All of docs give the character model; docs and labels meet on the key, which is not null."""
    counts = character_counts(docs, text)
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label is not null")
    marks = marks.groupBy("key").agg(F.max("label").alias("label"))
    n = marks.count()
    share = F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 20)))
    chosen = marks.where(F.pmod(F.xxhash64(F.lit("toxicity"), "key"), F.lit(1 << 20)) < share)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(5)))
    # Its rows are bounded by `sample`, about 20 bytes each.
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    rows = _without_copies(stored(rows.select("text", "label", "fold", F.xxhash64("text").alias("name")), "toxicity-sample"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for one, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen[mark > 0].update(plain_words(one or ""))
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[0][f] for f in names], pa.int64()), pa.array([seen[1][f] for f in names], pa.int64())],
                names=["feature", "n0", "n1"],
            )

    total = {(r["rest"], r["toxic"]): r["count"] for r in rows.groupBy((F.col("fold") == 0).alias("rest"), (F.col("label") > 0).alias("toxic")).count().collect()}
    t1, t0 = (sum(n for (_, toxic), n in total.items() if toxic == x) for x in (True, False))
    if not t1 or not t0:
        return Model({}, counts, (-math.inf, 0.0, 0.0) if t1 or t0 else (0.0, 0.0, 0.0))
    whole = F.lit(True)
    first = rows.where(F.col("fold") != 0 if (False, True) in total and (False, False) in total else whole)
    if (False, True) in total and (False, False) in total:
        t1, t0 = total[False, True], total[False, False]
    prior = t1 / (t0 + t1)
    seen = first.mapInArrow(features, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rate = F.col("n1") / (F.col("n0") + F.col("n1"))
    ratio = 2 * (F.col("n1") * F.log(rate / prior) + F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - rate) / (1 - prior))).otherwise(0.0))
    kept = seen.where((F.col("n1") > 0) & (rate > max(PURITY, prior))).withColumn("ratio", ratio).where(F.col("ratio") >= EVIDENCE)
    odds = lambda r: math.log((r["n1"] + 0.5) / (r["n0"] + 0.5) * (1 - prior) / prior)
    lexicon = {r["feature"]: odds(r) for r in kept.collect()}
    doubled = seen.where((F.col("n0") >= PLAIN_TEXTS) & (rate <= prior) & F.col("feature").rlike(r"(\p{L})\1"))
    model = Model(lexicon, counts, plain=frozenset(r["feature"] for r in doubled.select("feature").collect()))

    @F.arrow_udf("array<double>")
    @tk.lean
    def seen_by(column: pa.Array) -> pa.Array:
        return pa.array([list(model.inputs(t or "")) for t in column.to_pylist()], pa.list_(pa.float64()))

    rest = rows.where(F.col("fold") == 0 if (True, True) in total and (True, False) in total else whole)
    seen_rows = rest.select(seen_by("text").alias("x"), (F.col("label") > 0).cast("double").alias("y")).collect()
    model.curve = _fitted(np.array([r["x"] for r in seen_rows]), np.array([r["y"] for r in seen_rows]))
    return model


def score(text: Column, model: Model) -> Column:
    """The score of each text, 0 to 1."""

    @F.arrow_udf("double")
    @tk.lean
    def scored(column: pa.Array) -> pa.Array:
        return pa.array([model.score(t or "") for t in column.to_pylist()], pa.float64())

    return scored(text)


def score_all(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with the score of each text in column `out`."""
    return docs.withColumn(out, score(F.col(text), model))


def restore(docs: DataFrame, model: Model, text: str = "text", out: str = "restored") -> DataFrame:
    """docs with the whole text as it is meant, in lower case, tokens joined by blanks; null stays null."""

    @F.arrow_udf("string")
    @tk.lean
    def read(column: pa.Array) -> pa.Array:
        def one(t: str) -> str:
            spaced = _SPACED.sub(lambda m: " ".join(model.spaced(m[0])[:-1]) or m[0], t.lower())
            return " ".join(map(model.restored, spaced.split()))

        return pa.array([None if t is None else one(t) for t in column.to_pylist()], pa.string())

    return docs.withColumn(out, read(F.col(text)))
