"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file (base64 token, rank) becomes a tokenizers BPE model: every byte is written as a printable character,
every way to cut a token in two known tokens becomes a merge at the token's rank, and a piece that is itself a token
is taken whole. `encode` gives ids, and on request the character offsets of each token; `decode` reverses the
byte table. A character cut by token borders gives tokens that share its offsets; decoding joins bytes before it
reads them as UTF-8, so cut characters come back whole, and ids that end within a character give U+FFFD in text.

Defined results: null text encodes like the empty text, to no ids; empty ids decode to empty bytes; null ids, or an id
that is not in the table, decode to null. Repeated rows and ties do not matter, as rows are independent. A column of
the output's name is replaced; all other columns stay as they are.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from . import textkit as tk

#: Different pieces that a worker keeps with their ids, some 40 bytes each; only time depends on it.
CACHE = 1 << 20
#: Blanks other than the six of ASCII: texts that have one are encoded as they are.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# A task has its core; the library must not start threads of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character for each byte: printable Latin-1 as itself, the others from U+0100 on, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    known, shown = ranks(path), byte_characters()
    text = {token: "".join(shown[b] for b in token) for token in known}
    merges = [
        (text[token[:k]], text[token[k:]])
        for token in sorted(known, key=known.get)
        for k in range(1, len(token))
        if token[:k] in known and token[k:] in known
    ]
    model = models.BPE(vocab={text[t]: r for t, r in known.items()}, merges=merges, ignore_merges=True)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return out


class Encoder:
    """Encodes texts piece by piece: a word with the blanks before it, as matches of the pattern start where blanks start.

    Each different piece is encoded once and kept by its hash. The ids are decoded and compared with the texts, so that
    pieces whose hashes agree by chance are found out, and those texts are encoded as they are."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer, self.table = tokenizer(path, pattern), _table(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as bytes of int32."""
        out: list[bytes] = []
        for a, b in tk.slices(texts):
            out += self._slice(texts[a:b])
        return out

    def _slice(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if t and not _ODD.search(t)]
        out = dict(zip(plain, self._pieces([texts[i].encode() for i in plain]))) if plain else {}
        rest = [i for i in range(len(texts)) if out.get(i) is None]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        out |= {i: np.array(x.ids, dtype=np.int32).tobytes() for i, x in zip(rest, found)}
        return [out[i] for i in range(len(texts))]

    def _pieces(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of texts that are not empty; None where hashes misled."""
        whole = b"".join(texts)
        data, ends = np.frombuffer(whole, dtype=np.uint8), np.cumsum([len(t) for t in texts])
        space = tk.SPACE[data]
        begins = np.append(False, space[1:] & ~space[:-1])
        begins[np.append(0, ends[:-1])] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(data))
        hashed = tk.hashes(data, starts, stops)
        order = np.argsort(hashed)
        new = np.append(True, hashed[order[1:]] != hashed[order[:-1]])
        first, where = order[new], np.empty(len(order), dtype=np.int64)
        where[order] = np.cumsum(new) - 1
        different = hashed[first]
        if len(self.known) + len(different) > CACHE:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, different), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != different) if len(self.known) else np.arange(len(different))
        if len(new):
            self._learn(whole, data, different[new], starts[first[new]], stops[first[new]])
        place = np.searchsorted(self.known, different)[where]
        size = self.size[place]
        last = np.cumsum(size)
        flat = self.flat[np.arange(last[-1]) + np.repeat(self.start[place] - last + size, size)]
        bounds = last[np.searchsorted(stops, ends)].tolist()
        if self.table.joined(flat) == whole:
            return [flat[a:b].tobytes() for a, b in zip([0, *bounds], bounds)]
        parts = [flat[a:b] for a, b in zip([0, *bounds], bounds)]
        return [p.tobytes() if self.table.joined(p) == t else None for p, t in zip(parts, texts)]

    def _learn(self, whole: bytes, data: np.ndarray, hashed: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Encodes pieces: words with blanks before them in one text, which their lengths divide again, the others one by one."""
        spaced = tk.SPACE[data[start]] & ~tk.SPACE[data[stop - 1]]
        bare = [whole[a:b].decode() for a, b in zip(start[~spaced].tolist(), stop[~spaced].tolist())]
        found = [np.array(x.ids, dtype=np.int32) for x in self.tokenizer.encode_batch_fast(bare, add_special_tokens=False)]
        order = np.concatenate((np.flatnonzero(~spaced), np.flatnonzero(spaced)))
        sizes = [np.array([len(x) for x in found], dtype=np.int64)]
        if spaced.any():
            joined = "".join([whole[a:b].decode() for a, b in zip(start[spaced].tolist(), stop[spaced].tolist())])
            flat = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = np.searchsorted(np.cumsum(self.table.size[flat]), np.cumsum(stop[spaced] - start[spaced])) + 1
            found.append(flat)
            sizes.append(np.diff(ends, prepend=0))
        size = np.concatenate(sizes)
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, *found))
        known = np.concatenate((self.known, hashed[order]))
        sort = np.argsort(known, kind="stable")
        self.known, self.start, self.size = known[sort], np.concatenate((self.start, begin))[sort], np.concatenate((self.size, size))[sort]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(text, add_special_tokens=False).offsets


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def ids(text: Column, path: str, pattern: str) -> Column:
    """The ids of each text, array<int>."""

    @F.arrow_udf("array<int>")
    @tk.lean
    def encoded(column: pa.Array) -> pa.Array:
        found = encoder(path, pattern).ids(tk.as_texts(column))
        ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
        joined = b"".join(found)
        return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), len(joined) // 4, [None, pa.py_buffer(joined)]))

    return encoded(text)


def offsets(text: Column, path: str, pattern: str) -> Column:
    """The character range of each token, array<struct<start,end>>; tokens that share a character share its range."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def found(column: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"start": a, "end": b} for a, b in own.offsets(t or "")] for t in column.to_pylist()], kind)

    return found(text)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", with_offsets: str | None = None) -> DataFrame:
    """docs with the ids of `text` in column `out`, and the tokens' character ranges in `with_offsets`, if named. A match of the pattern must
    not go on over the first blank after a character that is none, as those of the public tokenizers' patterns don't."""
    more = {out: ids(F.col(text), path, pattern)}
    if with_offsets:
        more[with_offsets] = offsets(F.col(text), path, pattern)
    return docs.withColumns(more)


class Table:
    """The bytes of each id, one after the other."""

    def __init__(self, path: str):
        shown = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = {"".join(byte_characters()[b] for b in t): r for t, r in ranks(path).items()}
        tokens = {r: bytes(shown[c] for c in token) for token, r in vocabulary.items()}
        every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.size = np.array([len(t) for t in every], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(every), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes | None:
        """The ids' bytes; None if one isn't in the table."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.size) or not (size := self.size[ids]).all():
            return None
        ends = np.cumsum(size)
        return self.data[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + size, size)].tobytes()


@lru_cache(maxsize=4)
def _table(path: str) -> Table:
    return Table(path)


def decoded(tokens: Column, path: str) -> Column:
    """The bytes that ids stand for, binary."""

    @F.arrow_udf("binary")
    @tk.lean
    def joined(column: pa.Array) -> pa.Array:
        table, values, starts = _table(path), column.values.fill_null(-1).to_numpy(), column.offsets.to_numpy()
        valid = column.is_valid().to_pylist()
        return pa.array([table.joined(values[a:b]) if ok else None for a, b, ok in zip(starts, starts[1:], valid)], pa.binary())

    return joined(tokens)


def decode(docs: DataFrame, path: str, tokens: str = "ids", out: str = "decoded", text_out: str | None = None) -> DataFrame:
    """docs with the bytes of `tokens` in column `out`, and with the text they spell in `text_out`, if named."""
    done = docs.withColumn(out, decoded(F.col(tokens), path))

    @F.arrow_udf("string")
    def spelled(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    return done.withColumn(text_out, spelled(F.col(out))) if text_out else done
