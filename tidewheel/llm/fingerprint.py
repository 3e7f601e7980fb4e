"""One-permutation MinHash fingerprints: bins filled once, optimal densification, packed low-order bits.

A text's shingles (runs of five words) are hashed once. The hash's high bits choose one of BINS bins, and each bin
keeps its smallest hash. An empty bin takes the value of another bin, chosen by a hash of its number and of a count
of attempts that all texts share, so that two texts borrow alike (optimal densification). Of each value BITS low-order bits
are kept, two bins to a byte. Equal bits also arise by chance, once in 2**BITS; `likeness` corrects for that.

Defined results: null text is the empty text; a text without words has the fingerprint '' (likeness 1 to another
such, else 0); a text of one to four words is one shingle. Equal texts have equal fingerprints. Ties in the order of
documents go by a hash of the text, then by text; rows that are wholly equal follow each other. A null doc_id comes last; keys are whole numbers. A table of one row is
its own next document; an empty table gives no rows. Columns of the output's names are replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import stored

BINS = 512
#: Bytes of text of a partition, and partitions at most: a partition is streamed, so that larger ones take time, not memory.
PART_BYTES, PARTS = 16 << 20, 50_000
BITS = 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(texts: list[bytes], n: int = 5) -> np.ndarray:
    """One row of BINS low-order values for each text; a text without words has -1 throughout."""
    found, docs = tk.shingles(tk.words(texts), len(texts), n)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    table = np.full(len(texts) * BINS, _EMPTY, dtype=np.uint64)
    np.minimum.at(table, docs * BINS + (found >> shift).astype(np.int64), tk.mix64(found) >> np.uint64(1))
    table = table.reshape(len(texts), BINS)
    filled = table != _EMPTY
    out = np.where(filled, table, 0)
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 1
    while len(row):
        borrow = tk.mix64(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)
        borrow = borrow.astype(np.int64)
        done = filled[row, borrow]
        out[row[done], col[done]] = table[row[done], borrow[done]]
        row, col, attempt = row[~done], col[~done], attempt + 1
    # A value that several bins hold is mixed with the bin's number, so that it agrees by chance in each bin anew.
    own = tk.mix64(out ^ tk.mix64(np.arange(1, BINS + 1, dtype=np.uint64)))
    low = (own & np.uint64((1 << BITS) - 1)).astype(np.int8)
    low[~filled.any(axis=1)] = -1
    return low


def packed(low: np.ndarray) -> list[str]:
    """Rows of `fingerprints` in hexadecimal; '' for texts without words."""
    digits = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
    return ["" if row[0] < 0 else digits[row].tobytes().decode() for row in low]


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of `fingerprints`, corrected for equal bits by chance; 0 to 1."""
    chance = 2.0**-BITS
    same = (a == b).mean(axis=1)
    out = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return np.where((a[:, 0] < 0) != (b[:, 0] < 0), 0.0, out)


def fingerprint(text: Column) -> Column:
    """The fingerprint of each text, in hexadecimal."""

    @F.arrow_udf("string")
    @tk.lean
    def made(column: pa.Array) -> pa.Array:
        texts, out = tk.as_bytes(column), []
        for a, b in tk.slices(texts):
            out += packed(fingerprints(texts[a:b]))
        return pa.array(out, pa.string())

    return made(text)


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints, by their digits alone."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    near = F.greatest(F.lit(0.0), (same / F.lit(BINS) - 2.0**-BITS) / (1 - 2.0**-BITS))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(near)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the first as many characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_sequence(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (key, text, bucket, visitor) dealt so that each partition holds whole buckets, sorted by bucket, with every
    row followed by the next one in descending order of key; `visitor` rows are the first of the next bucket.

    Buckets are ranges of the key between approximate quantiles, for PART_BYTES each. A key that several quantiles share, as null may, has a
    bucket of its own, which ranges of the text's hash divide."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    hashed = rows.withColumn("hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
    # All that is asked of the texts before they are dealt comes from one scan of them.
    marks = stored(hashed.select("key", "hash", F.octet_length("text").alias("bytes")), "fingerprint-marks")
    size = marks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("key").isNull()).alias("none"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    parts = parts or max(1, min(-(-size["bytes"] // PART_BYTES), size["n"], PARTS))
    steps = [i / parts for i in range(1, parts)]
    found = Counter(marks.select("key").approxQuantile("key", steps, 0.1 / parts) if steps else [])
    alone = [b for b, n in found.items() if n > 1 and b + 1 > b]
    bounds = np.array(sorted({*found, *(b + 1 for b in alone)}), dtype=np.float64)
    # By bucket before its division: from the largest keys to the smallest, then null.
    cuts = np.ones(len(bounds) + 2, dtype=np.int64)
    for b in alone:
        cuts[len(bounds) - np.searchsorted(bounds, b, side="right")] = found[b] + 1
    cuts[-1] = max(1, -(-size["none"] * parts // max(size["n"], 1)))
    starts = np.cumsum(cuts) - cuts

    def bucket_of(keys: pa.Array, hashes: pa.Array) -> np.ndarray:
        values = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        whole = np.where(np.asarray(keys.is_null()), len(bounds) + 1, len(bounds) - np.searchsorted(bounds, values, side="right"))
        share = hashes.to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5
        return starts[whole] + np.minimum((share * cuts[whole]).astype(np.int64), cuts[whole] - 1)

    @F.arrow_udf("int")
    @tk.lean
    def bucket(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(bucket_of(keys, hashes).astype(np.int32))

    first = marks.select(bucket("key", "hash").alias("bucket"), "key", "hash").groupBy("bucket").agg(F.max(F.struct("key", F.bitwise_not("hash").alias("hash"))).alias("head"))
    heads = {r["bucket"]: (r["head"]["key"], ~r["head"]["hash"]) for r in first.collect()}  # a row a bucket
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    @F.arrow_udf("array<int>")
    @tk.lean
    def places(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        own = bucket_of(keys, hashes).tolist()
        out = [[b, before[b]] if x == heads[b] else [b] for b, x in zip(own, zip(keys.to_pylist(), hashes.to_pylist()))]
        return pa.array(out, pa.list_(pa.int32()))

    dealt = hashed.select("key", "text", "hash", F.posexplode(places("key", "hash")).alias("visitor", "bucket"))
    return dealt.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "visitor", F.desc_nulls_last("key"), "hash", "text")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document the fingerprints of its text and of its edited text, and its likeness to the edited text
    and to the next document. Buckets are streamed; a task holds a slice of whole texts at a time."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "text", "bucket", "visitor")]
            rows = list(zip(*columns))
            sizes = [r[1] or "" for r in rows]
            for a, b in tk.slices(sizes, tk.SLICE_BYTES // 2):
                part = ([last] if last else []) + rows[a:b]
                last = part[-1]
                pairs = [i for i in range(len(part) - 1) if not part[i][3] and part[i][2] == part[i + 1][2]]
                if not pairs:
                    continue
                texts = [r[1] or "" for r in part]
                changed = [edited(texts[i], texts[i + 1]) for i in pairs]
                coded = [t.encode() for t in changed]
                own, new = fingerprints([t.encode() for t in texts]), fingerprints(coded)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part[i][0] for i in pairs], pa.int64()),
                        pa.array([len(texts[i]) for i in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in coded]),
                        pa.array(packed(own[pairs])),
                        pa.array(packed(new)),
                        pa.array(likenesses(own[pairs], new)),
                        pa.array(likenesses(own[pairs], own[[i + 1 for i in pairs]])),
                    ],
                    names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_sequence(docs, key, text).mapInArrow(compared, schema).withColumnRenamed("key", key)
