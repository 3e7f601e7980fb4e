"""Language-model scores by a weighted backoff automaton over words and, below them, over letters.

States are contexts of the training texts: no word (the root), a word, or two words; the start of a text counts as a word, which is
the end of another. A state's arcs carry log-probabilities of a next token and lead to the state of the longest known context that the
token makes. A token without an arc follows the state's failure arc to the context without its first word, whose weight is
added. At the root, a token without an arc is spelled. A text is read once, from left to right, with its state: see `Automaton`.

* after two words: p(w|gh) = (1 - v) c(ghw) / c(gh) + v p(w|h), and after one, p(w|h) = (1 - v) c(hw) / c(h) + v p(w); the failure weight
  v = (1 + c / KNEE) ** -SLOPE of the context's count c falls as the share of new words does that one meets in running text; 1 for c = 0
* word alone: p(w) = max(c(w) - D, 0) / N + D V / N q(w): absolute discounting, whose failure weight is D V / N
* spelling: q(w), the product over a word's bytes and an end of byte probabilities, each after up to three bytes, longer
  contexts backing off to shorter ones in the same way; contexts of three bytes share rows of a table by hash.

Every level sums to one, so scores are log-probabilities of texts. Counts are taken over all training texts, whole.

How it is distributed. Texts are packed, in the order they are read, into units of about UNIT bytes, which are
written once. Each unit asks for its different n-grams (hashes), already counted within the unit, and builds the part of the automaton that its
texts can pass from the sums. Requests go up a tree: FAN units' requests for one of FAN ranges of the hashes meet in a task, which
sums them; where there are more than FAN units, the sums go on, in FAN narrower ranges, to be met by those of FAN such groups, and so on;
the sums of the last step go the same way back. Fewer units than FAN meet in as few ranges as they need. So a unit has FAN rows for each order and a level adds no more than that, every task
holds about a unit's n-grams, and what is shuffled are different n-grams, not tokens. No task holds the whole model. The
table of byte counts has a fixed size and is broadcast.

Defined results: null is the empty text, which is one end token; tokens are words with A-Z in lower case. Without training
rows every token is unknown. Repeated rows count and score separately. Columns of the outputs' names are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import stored, unused

#: Bytes of text that a task reads, counts and scores together, and how many requests meet in a task at most.
UNIT, FAN = 8 << 20, 4096
#: Of the failure weights of one and of two words, and of the words alone.
KNEE, SLOPE, D = (20.0, 5.0), (0.2, 0.3), 0.7
#: Tokens of a long text that are read in one go: pieces of a text are read side by side, each after the two tokens before it, which lead from any state to the text's own.
PIECE = 512
#: Rows of the byte tables, by number of bytes of context, and pseudo-counts.
ROWS, BYTE_A = (1, 1 << 8, 1 << 12, 1 << 14), 4.0
ORDERS = (1, 2, 3)
_LN10 = np.log(10.0)
_END = np.uint64(0xE7D0C0DE5EED0001)


def _sums(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order, and the sum of their weights."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    order = np.argsort(hashes)
    hashes, sums = hashes[order], np.concatenate(([0], np.cumsum(weights[order])))
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[first], np.diff(sums[np.append(first, len(hashes))])


class Grams:
    """Different n-grams of one order: hashes in order, the number of each place's n-gram, and a place of each."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        new = np.ones(len(order), dtype=bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        self.first = order[new]
        self.values = hashes[self.first]
        self.number = np.empty(len(order), dtype=np.int32)
        self.number[order] = np.cumsum(new) - 1

    def counts(self, learned: np.ndarray) -> np.ndarray:
        return np.bincount(self.number, weights=learned, minlength=len(self.values)).astype(np.int64)


class Unit:
    """The tokens of texts, in order: words, and an end after each text; and their n-grams."""

    def __init__(self, texts: list[bytes]):
        parts, at = [], 0
        for a, b in tk.slices(texts):
            found = tk.words([t.lower() for t in texts[a:b]])
            count = np.bincount(found.doc, minlength=b - a) + 1
            word = np.ones(int(count.sum()), dtype=bool)
            word[np.cumsum(count) - 1] = False
            token, start, end = np.full(len(word), _END), np.full(len(word), -1), np.full(len(word), -1)
            token[word], start[word], end[word] = found.hash, found.start + at, found.end + at
            parts.append((found.data, token, start, end, count))
            at += len(found.data)
        self.data, token, self.start, self.end, self.count = (np.concatenate(x) for x in zip(*parts))
        self.begin = np.cumsum(self.count) - self.count
        self.opens = np.zeros(len(token), dtype=bool)
        self.opens[self.begin] = True
        before = np.where(self.opens, _END, np.concatenate((token[:1], token[:-1])))
        # 48 bits, as only n-grams of one order meet.
        pair = tk.mix64(before * np.uint64(0x9FB21C651E98DF25) + token) >> np.uint64(16) << np.uint64(16)
        #: Places with two tokens before them, of which the start may be one.
        self.inner = np.flatnonzero(~self.opens)
        triple = tk.mix64(pair[self.inner - 1] * np.uint64(0xD6E8FEB86659FD93) + token[self.inner]) >> np.uint64(16) << np.uint64(16)
        self.words, self.pairs, self.triples = Grams(token), Grams(pair), Grams(triple)
        self.end_word = int(np.searchsorted(self.words.values, _END))

    def counted(self, training: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The different n-grams of each order, and their counts in the training texts."""
        learned = np.repeat(training, self.count)
        return [(g.values, g.counts(x)) for g, x in ((self.words, learned), (self.pairs, learned), (self.triples, learned[self.inner]))]

    def cells(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of the spelling of the training texts' words, and their counts."""
        often = self.words.counts(np.repeat(training, self.count))
        words = np.flatnonzero((often > 0) & (self.start[self.words.first] >= 0))
        values, weights = [], []
        for own in np.array_split(words, len(words) // (1 << 15) + 1):
            at = self.words.first[own]
            cells, word = Spelling.cells(self.data, self.start[at], self.end[at])
            one = _sums(cells.ravel(), np.repeat(often[own][word], cells.shape[1]))
            values.append(one[0])
            weights.append(one[1])
        return _sums(np.concatenate(values), np.concatenate(weights))


class Spelling:
    """Byte counts after contexts of 0 to 3 bytes, as rows of 256; 0x20 ends a word and fills contexts before its start."""

    OFFSETS = np.concatenate(([0], np.cumsum(np.array(ROWS) * 256)))

    @staticmethod
    def cells(tokens_data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every byte of every word and its end: the cells of its counts, a column for each context; and the word."""
        size = end - start + 1
        word = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        place = start[word] + at
        last = at == size[word] - 1
        byte = np.where(last, 32, tokens_data[place]).astype(np.int64)
        back = [np.where(at >= k, tokens_data[place - np.minimum(k, at)], 32).astype(np.int64) for k in (1, 2, 3)]
        two, three = back[0] | back[1] << 8, back[0] | back[1] << 8 | back[2] << 16
        hashed = [(tk.mix64(x.astype(np.uint64)) % np.uint64(rows)).astype(np.int64) for x, rows in ((two, ROWS[2]), (three, ROWS[3]))]
        contexts = (np.zeros_like(byte), back[0], *hashed)
        return np.stack([Spelling.OFFSETS[k] + c * 256 + byte for k, c in enumerate(contexts)], axis=1), word

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.n = [counts[self.OFFSETS[k] : self.OFFSETS[k + 1]].reshape(rows, 256).sum(axis=1) for k, rows in enumerate(ROWS)]

    def logs(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log10 q of each word."""
        out = np.zeros(len(start))
        for a in range(0, len(start), 1 << 16):
            cells, word = self.cells(data, start[a : a + (1 << 16)], end[a : a + (1 << 16)])
            p = np.full(len(word), 1 / 256)
            for k in range(len(ROWS)):
                own = cells[:, k]
                n = self.n[k][(own - self.OFFSETS[k]) >> 8]
                p = (self.counts[own] + BYTE_A * p) / (n + BYTE_A)
            out[a : a + (1 << 16)] = np.bincount(word, weights=np.log10(p), minlength=min(1 << 16, len(start) - a))
        return out


def _units(rows: DataFrame, size: int) -> DataFrame:
    """Units (unit, rows, sizes, texts, training) of rows (text, training, row): texts packed with zstd, and the rows' own columns."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = tk.as_bytes(batch.column("text")), batch.column("training").to_pylist()
            ids = batch.column("row")
            for a, b in tk.slices(texts, size):
                sizes = np.array([len(t) for t in texts[a:b]], dtype=np.int64)
                whole = b"".join(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().int >> 65], pa.int64()),
                        pa.array([ids[a:b].to_pylist()], pa.list_(ids.type)),
                        pa.array([sizes.tolist()], pa.list_(pa.int64())),
                        pa.array([bytes(pa.compress(whole, "zstd", asbytes=True))], pa.binary()),
                        pa.array([marks[a:b]], pa.list_(pa.bool_())),
                    ],
                    names=["unit", "rows", "sizes", "texts", "training"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(packed, f"unit long, rows array<{kind}>, sizes array<long>, texts binary, training array<boolean>")


def _texts(sizes: list[int], texts: bytes) -> list[bytes]:
    whole = pa.decompress(texts, int(sum(sizes)), "zstd", asbytes=True) if sum(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [whole[e - n : e] for n, e in zip(sizes, ends)]


def _coded(values: np.ndarray) -> bytes:
    """Ascending values as differences, compressed byte by byte of their places."""
    steps = np.diff(values, prepend=np.zeros(1, dtype=values.dtype)).astype(np.uint64)
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _decoded(n: int, coded: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(coded, 8 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _counts(values: np.ndarray) -> bytes:
    """Counts, compressed, after the number of bytes that each takes: four, or eight where one needs them."""
    width = 4 if values.max(initial=0) < 1 << 32 else 8
    return bytes([width]) + pa.compress(values.astype(f"<u{width}").tobytes(), "zstd", asbytes=True)


def _read_counts(n: int, coded: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(coded[1:], coded[0] * n, "zstd", asbytes=True), dtype=f"<u{coded[0]}").astype(np.int64)


def _requests(fan: int):
    """Rows (unit, order, part, n, values, counts): the n-grams that a unit asks for, and, of order 0, its byte counts."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("unit", "sizes", "texts", "training")}
                unit, training = Unit(_texts(row["sizes"], row["texts"])), np.array(row["training"], dtype=bool)
                held = [unit.cells(training), *unit.counted(training)]
                del unit
                out = []
                for order, (values, counts) in enumerate(held):
                    out += _ranges(row["unit"], order, 0, 0, values.astype(np.uint64), counts, fan)
                del held
                yield from _table(out, _ASKED).to_batches()
                del out
                tk.released()

    return asked


_ASKED = pa.schema([("unit", pa.int64()), ("order", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("values", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([*_ASKED, ("totals", pa.list_(pa.int64()))])
_ASKED_SQL = "unit long, order int, part long, n long, values binary, counts binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def _ranges(unit: int, order: int, part: int, level: int, values: np.ndarray, counts: np.ndarray, fan: int) -> list[tuple]:
    """Rows of a request, in `fan` parts of the range that `part` is at a level: of 2 ** (64 - level * log2(fan)) hashes, and of all byte
    counts, which are few enough to stay in the parts of the first level."""
    if order == 0:
        if level:
            return [(unit, 0, part, len(values), _coded(values), _counts(counts))]
        bounds = np.searchsorted(values, np.arange(fan + 1) * int(Spelling.OFFSETS[-1]) // fan)
    else:
        width = fan.bit_length() - 1
        own = (values >> np.uint64(64 - width * (level + 1))) & np.uint64(fan - 1)
        bounds = np.searchsorted(own, np.arange(fan + 1, dtype=np.uint64))
    bounds = bounds.tolist()
    return [(unit, order, part * fan + p, b - a, _coded(values[a:b]), _counts(counts[a:b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]


def _met(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The values of each request, all different values, and their sums."""
    sizes = group["n"].to_pylist()
    values = [_decoded(n, v) for n, v in zip(sizes, group["values"].to_pylist())]
    counts = [_read_counts(n, v) for n, v in zip(sizes, group["counts"].to_pylist())]
    return values, *_sums(np.concatenate(values), np.concatenate(counts))


def _given(group: pa.Table, values: list[np.ndarray], own: np.ndarray, sums: np.ndarray, more: tuple = ()) -> list[tuple]:
    """Rows that give each request the sums of its values."""
    order, part = group["order"][0].as_py(), group["part"][0].as_py()
    return [(unit, order, part, len(v), None, _counts(sums[np.searchsorted(own, v)]), *more) for unit, v in zip(group["unit"].to_pylist(), values)]


def _last(group: pa.Table) -> pa.Table:
    """Where all requests for a range meet: their answers, and a row without a unit, with the range's totals or byte counts."""
    order, part = group["order"][0].as_py(), group["part"][0].as_py()
    values, own, sums = _met(group)
    if order == 0:
        return _table([(None, 0, part, len(own), _coded(own), _counts(sums), None)], _ANSWER)
    totals = [int(sums.sum()), int((sums > 0).sum())]
    out = _table([*_given(group, values, own, sums, (None,)), (None, order, part, 0, None, None, totals)], _ANSWER)
    del values, own, sums
    tk.released()
    return out


def _answers(requests: DataFrame, n: int, level: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """The sums that each of n units asked for, and the totals of all."""
    if n <= fan:
        answers = stored(requests.groupBy("part", "order").applyInArrow(_last, _ASKED_SQL + ", totals array<long>"), "lm-answers")
        return answers.where("unit is not null").drop("totals"), answers.where("unit is null")
    groups = -(-n // fan)
    grouped = stored(requests, "lm-requests").withColumn("over", F.pmod("unit", F.lit(groups)))

    def summed(group: pa.Table) -> pa.Table:
        _, own, sums = _met(group)
        return _table(_ranges(group["over"][0].as_py(), group["order"][0].as_py(), group["part"][0].as_py(), level + 1, own, sums, fan), _ASKED)

    def handed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _ASKED)
        values, own, _ = _met(left)
        sums = np.concatenate([_read_counts(n, c) for _, n, c in sorted(zip(right["part"].to_pylist(), right["n"].to_pylist(), right["counts"].to_pylist()))])
        return _table(_given(left, values, own, sums), _ASKED)

    above, totals = _answers(grouped.groupBy("over", "part", "order").applyInArrow(summed, _ASKED_SQL), groups, level + 1, fan)
    above = above.withColumns({"over": F.col("unit"), "under": F.floor(F.col("part") / fan)})
    below = grouped.where("order > 0").groupBy("over", "part", "order").cogroup(above.groupBy("over", "under", "order"))
    return stored(below.applyInArrow(handed, _ASKED_SQL), "lm-answers"), totals


class Totals:
    """Tokens and different tokens of the training texts, and the spelling table."""

    def __init__(self, tokens: int, different: int, cells: np.ndarray):
        self.tokens, self.different, self.cells = tokens, different, cells


class Automaton:
    """What the texts of a unit can pass of the automaton, given the counts of the unit's n-grams.

    State 0 is the root, 1 + i the unit's word i, and after these stand its pairs. An arc's key is its state and its word. The
    root's arcs are the words themselves; those that are unknown are spelled, and lead back to the root."""

    def __init__(self, unit: Unit, counts: list[np.ndarray], totals: Totals, spelling: Spelling):
        one, two, three = counts
        words, pairs, triples, n = unit.words, unit.pairs, unit.triples, totals.tokens
        spelled = np.full(len(words.values), np.log(0.01))
        places = np.flatnonzero(unit.start[words.first] >= 0)
        at = words.first[places]
        spelled[places] = np.log(0.99) + spelling.logs(unit.data, unit.start[at], unit.end[at]) * _LN10
        ways = [np.log((1 + c / knee) ** -slope) for c, knee, slope in ((one, KNEE[0], SLOPE[0]), (two, KNEE[1], SLOPE[1]))]
        with np.errstate(divide="ignore"):
            self.root = np.logaddexp(np.log(np.maximum(one - D, 0) / n), np.log(D * totals.different / n) + spelled) if n else spelled
        self.known = one > 0
        second = words.number[pairs.first].astype(np.int64)
        first = np.where(unit.opens[pairs.first], unit.end_word, words.number[pairs.first - 1]).astype(np.int64)
        base = 1 + len(words.values)
        self.weight = np.concatenate(([0.0], *ways))
        self.fail = np.concatenate((np.zeros(base, dtype=np.int64), 1 + second))

        def arc(held: np.ndarray, seen: np.ndarray, way: np.ndarray, shorter: np.ndarray) -> np.ndarray:
            return np.logaddexp(np.log(-np.expm1(way)) + np.log(held) - np.log(seen), way + shorter)

        some = np.flatnonzero(two)
        after = np.full(len(two), -np.inf)
        after[some] = arc(two[some], one[first[some]], ways[0][first[some]], self.root[second[some]])
        keys, logs, to = [(1 + first[some]) << 32 | second[some]], [after[some]], [base + some]
        some = np.flatnonzero(three)
        place = unit.inner[triples.first[some]]
        context, last = pairs.number[place - 1].astype(np.int64), pairs.number[place].astype(np.int64)
        keys.append((base + context) << 32 | words.number[place])
        logs.append(arc(three[some], two[context], ways[1][context], after[last]))
        to.append(base + last)
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, self.logs, self.to = keys[order], np.concatenate(logs)[order], np.concatenate(to)[order]
        self.start = 1 + unit.end_word if self.known[unit.end_word] else 0

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads a word in each state: the logarithms of their probabilities, and the next states."""
        total, at, out = np.zeros(len(states)), states.copy(), np.zeros(len(states), dtype=np.int64)
        todo = np.arange(len(states))
        while len(todo):
            own, word = at[todo], words[todo]
            ends = own == 0
            done = todo[ends]
            total[done] += self.root[word[ends]]
            out[done] = np.where(self.known[word[ends]], 1 + word[ends], 0)
            todo, own, word = todo[~ends], own[~ends], word[~ends]
            if not len(todo):
                break
            key = own << 32 | word
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            total[todo[hit]] += self.logs[arc[hit]]
            out[todo[hit]] = self.to[arc[hit]]
            todo, own = todo[~hit], own[~hit]
            total[todo] += self.weight[own]
            at[todo] = self.fail[own]
        return total, out

    def read(self, unit: Unit, piece: int = PIECE) -> np.ndarray:
        """log10 of the probability of each text."""
        word = unit.words.number.astype(np.int64)
        pieces = -(-unit.count // piece)
        text = np.repeat(np.arange(len(unit.count)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = unit.begin[text] + nth * piece
        size = np.minimum(piece, unit.begin[text] + unit.count[text] - begin)
        order = np.argsort(-size, kind="stable")
        text, nth, begin, size = text[order], nth[order], begin[order], size[order]
        states, sums = np.where(nth == 0, self.start, 0), np.zeros(len(text))
        later = np.flatnonzero(nth > 0)
        for back in (2, 1):
            states[later] = self.step(states[later], word[begin[later] - back])[1]
        live = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")
        for i, m in enumerate(live.tolist()):
            logs, states[:m] = self.step(states[:m], word[begin[:m] + i])
            sums[:m] += logs
        return np.bincount(text, weights=sums, minlength=len(unit.count)) / _LN10


def _scores(texts: list[bytes], counts, totals: Totals, spelling: Spelling) -> np.ndarray:
    """Of each text: tokens, known tokens, base score, score. counts: of the unit's n-grams of each order, ascending by hash."""
    unit = Unit(texts)
    one = counts[0][unit.words.number]
    base = np.log10((one + 0.1) / (totals.tokens + 0.1 * (totals.different + 1)))
    score = Automaton(unit, counts, totals, spelling).read(unit)
    return np.stack([unit.count, np.add.reduceat(one > 0, unit.begin, dtype=np.int64), np.add.reduceat(base, unit.begin), score], axis=1)


def score(docs: DataFrame, training: Column, text: str = "text", prefix: str = "", unit: int = UNIT, fan: int | None = None) -> DataFrame:
    """docs with `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`, each named with the prefix.

    training is a condition on columns of docs that marks the rows to learn from. All columns of docs ride with the texts. fan is a power of two, by default the least that
    all units can meet in, or FAN."""
    spark = docs.sparkSession
    (none,) = unused(docs.columns, "none")
    row = F.struct(F.col(text).isNull().alias(none), *[F.col(f"`{c}`") for c in docs.columns if c != text])
    units = stored(_units(docs.select(F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"), row.alias("row")), unit), "lm-units")
    n = units.count()
    fan = fan or min(FAN, max(2, 1 << (n - 1).bit_length()))
    given, sums = _answers(units.mapInArrow(_requests(fan), _ASKED_SQL), n, 0, fan)
    total = sums.where("order = 1").agg(F.sum(F.get("totals", F.lit(0))), F.sum(F.get("totals", F.lit(1)))).first()
    tokens, different = total[0] or 0, total[1] or 0
    cells = np.zeros(int(Spelling.OFFSETS[-1]), dtype=np.int64)
    for r in sums.where("order = 0").select("n", "values", "counts").toLocalIterator():  # at most fan rows: the byte table
        cells[_decoded(r["n"], bytes(r["values"])).astype(np.int64)] = _read_counts(r["n"], bytes(r["counts"]))
    held = spark.sparkContext.broadcast(Totals(tokens, different, cells.astype(np.float32)))
    kinds = units.schema["rows"].dataType.elementType
    names = [f"{prefix}{c}" for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        totals: Totals = held.value
        parts_of: dict[int, list] = {k: [] for k in ORDERS}
        for order, _, n, counts in sorted(zip(right["order"].to_pylist(), right["part"].to_pylist(), right["n"].to_pylist(), right["counts"].to_pylist())):
            parts_of[order].append(_read_counts(n, counts))
        rows, texts = left["rows"].combine_chunks().flatten(), _texts(left["sizes"][0].as_py(), left["texts"][0].as_py())
        sums = [np.concatenate(parts_of[k] or [np.zeros(0, np.int64)]) for k in ORDERS]
        found = _scores(texts, sums, totals, Spelling(totals.cells))
        out = pa.table(
            {
                "row": rows,
                "text": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_tokens": pa.array(found[:, 0].astype(np.int64)),
                "n_known": pa.array(found[:, 1].astype(np.int64)),
                "base": pa.array(found[:, 2]),
                "score": pa.array(found[:, 3]),
            }
        )
        tk.released()
        return out

    kind = f"row {kinds.simpleString()}, text string, n_tokens long, n_known long, base double, score double"
    given = given.select("unit", "order", "part", "n", "counts")
    out = units.select("unit", "rows", "sizes", "texts").groupBy("unit").cogroup(given.groupBy("unit")).applyInArrow(scored, kind)
    shown = [F.when(~F.col(f"row.{none}"), F.col("text")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in names]
    results = (F.col("n_tokens"), F.col("n_known"), F.lit(tokens).cast("long"), F.col("base"), F.col("score"))
    return out.select(*shown, *[v.alias(c) for c, v in zip(names, results)])
