"""Benchmark decontamination by a distributed positional inverted index, with DataFrame operations only.

1. The index. Every training text is cut into words; of words that some test item has, the postings (term, row, position) are written to the
   shared folder, each task's as it reads the texts. A row is named by its key and a hash of its text.
2. The test items are cut into windows of WINDOW consecutive words; a shorter item is one window. Terms are rare by the number of their
   postings. A window with a term that has none is in no text. Of each other window the two rarest terms are taken.
3. Intersection. Each posting of a window's rarest term gives a start: its position less the term's offset in the window. Starts that the second term's
   list gives as well are kept. Windows of an item that share both terms share their lists.
4. The lists of the window's other terms, of the rows that are left, are intersected with the starts in the same way. A start that all lists
   give is an occurrence of the phrase. With `slop`, a list gives a start where it has a term at most that many places off: a proximity match.

How it is distributed. Texts aren't shuffled. The words of the test items, and the pairs of rare terms, are broadcast while their
counted number is at most SMALL, beyond it they are joined by shuffle, as are the rows that are left. What is shuffled of the index are the lists of the two
rarest terms of each window, each under its row, so a frequent passage is spread over the rows that have it. Work grows with the texts, and with the test items
times the length of the lists of their rare terms.

Defined results: a null or empty text, or one without letters and digits, has no words and no matches; such an item has no windows. Equal items (in
words) are one phrase with several names; an item without a name counts in `n_hit`, not among `items`. Rows that are equal in key and text, as
repeated rows, have equal results; keys may be null or repeated. Empty tables give no rows, or rows without matches. Other columns of the
texts stay; those of the outputs' names are replaced.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

WINDOW = 10
#: Rows that are broadcast at most: test words, pairs of rare terms, rows with a start.
SMALL = 1_000_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_OPENS = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    """The text with A-Z, and no other letters, in lower case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words(text: Column) -> Column:
    """The words of a text: runs of letters and digits, and of characters beyond ASCII."""
    return F.filter(F.split(lowered(text), _BETWEEN), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def row_of(key: Column, text: Column) -> Column:
    """The name of a row: nulls in it are values, so it can be joined on."""
    return F.struct(key.alias("key"), F.xxhash64(text).alias("name"))


def _held(rows: DataFrame, small: int) -> DataFrame:
    """rows, which are written, as a side of a join: broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(small + 1).count() <= small else rows


class Items:
    """Test items: `phrases` (item, words), different in words; `names` (item, name); `terms` (term, word)."""

    def __init__(self, items: DataFrame, name: str = "item_id", text: str = "text"):
        named = items.select(F.col(name).cast("string").alias("name"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
        whole = named.groupBy("words").agg(F.collect_set("name").alias("names")).withColumn("item", F.monotonically_increasing_id())
        whole = stored(whole, "decontam-items")
        self.phrases = whole.select("item", "words")
        self.names = whole.select("item", F.explode("names").alias("name"))
        different = whole.select(F.explode("words").alias("word")).distinct()
        self.terms = stored(different.withColumn("term", F.monotonically_increasing_id()), "decontam-terms")


class Index:
    """The postings (row, term, position) of the training texts for the words of test items."""

    def __init__(self, docs: DataFrame, items: Items, key: str = "doc_id", text: str = "text", small: int = SMALL):
        self.items, self.small = items, small
        own = F.col(text)
        cut = docs.select(row_of(F.col(key), own).alias("row"), F.rlike(own, F.lit(_OPENS)).cast("int").alias("skipped"), F.split(lowered(own), _BETWEEN).alias("words"))
        placed = cut.select("row", "skipped", F.posexplode("words").alias("at", "word"))
        met = placed.join(_held(items.terms, small), "word")
        self.postings = stored(met.select("row", "term", (F.col("at") - F.col("skipped")).alias("at")), "decontam-postings")
        self.often = stored(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("often")), "decontam-often")

    def _windows(self, size: int) -> DataFrame:
        """(pair, item, windows, term, offset, term2, offset2): windows array<struct<first, size>> that share their two rarest places. Windows
        with a term that no text has are left out."""
        placed = self.items.phrases.select("item", F.posexplode("words").alias("at", "word")).join(self.items.terms, "word")
        counted = placed.join(self.often, "term", "left").select("item", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "at", "term").alias("x"))
        terms = counted.groupBy("item").agg(F.array_sort(F.collect_list("x"), lambda a, b: a["at"] - b["at"]).alias("terms"))
        first = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("terms") - size))).alias("first")
        part = terms.select("item", "terms", first).select("item", "first", F.slice("terms", F.col("first") + 1, size).alias("part"))
        rare = part.where(~F.exists("part", lambda x: x["often"] == 0)).withColumn("rare", F.array_sort("part"))
        a, b = F.get("rare", F.lit(0)), F.get("rare", F.lit(1))
        ends = [a["term"].alias("term"), a["at"].alias("offset"), b["term"].alias("term2"), b["at"].alias("offset2")]
        pairs = rare.groupBy("item", *ends).agg(F.collect_list(F.struct("first", F.size("part").alias("size"))).alias("windows"))
        return stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "decontam-pairs")

    def _starts(self, pairs: DataFrame, slop: int) -> DataFrame:
        """(pair, row, start): where both lists of a pair give the start, or the first does and the second one at most slop places off. A start is of the
        item's first word, in places of the row."""
        one = pairs.select("pair", "term", "offset", F.col("term2").isNull().alias("single"))
        two = pairs.where("term2 is not null").select("pair", F.col("term2").alias("term"), F.col("offset2").alias("offset"))
        a = self.postings.join(_held(one, self.small), "term").select("pair", "row", "single", (F.col("at") - F.col("offset")).alias("start"))
        b = self.postings.join(_held(two, self.small), "term").select("pair", "row", (F.col("at") - F.col("offset")).alias("other"))
        if slop:
            cell = lambda c: F.floor(F.col(c) / (slop + 1))
            b = b.withColumn("cell", F.explode(F.array(*[cell("other") + i for i in (-1, 0, 1)])))
            both = a.where("not single").withColumn("cell", cell("start")).join(b, ["pair", "row", "cell"]).where(F.abs(F.col("start") - F.col("other")) <= slop)
        else:
            both = a.where("not single").join(b.withColumnRenamed("other", "start"), ["pair", "row", "start"])
        return both.select("pair", "row", "start").distinct().unionByName(a.where("single").select("pair", "row", "start").distinct())

    def matches(self, size: int = WINDOW, slop: int = 0, least: float = 1.0) -> DataFrame:
        """(item, row, start, first, size): the window of `size` words that begins at the item's word `first` is met at the row's word `start`.

        With slop 0 these are the exact phrases. Else a match has the window's two rarest words at most slop places off each other's, and of its
        words a share of `least` at most slop places off where they stand if the rarest is in its place."""
        pairs = self._windows(size)
        starts = stored(self._starts(pairs, slop), "decontam-starts")
        named = starts.join(pairs.select("pair", "item", "windows"), "pair")
        wanted = named.groupBy("item", "row", "start").agg(F.array_distinct(F.flatten(F.collect_list("windows"))).alias("windows"))
        reach = lambda w: F.sequence(w["first"], w["first"] + w["size"] - 1)
        probes = wanted.select("item", "row", "start", F.explode(F.array_distinct(F.flatten(F.transform("windows", reach)))).alias("offset"))
        terms = self.items.phrases.select("item", F.posexplode("words").alias("offset", "word")).join(self.items.terms, "word").drop("word")
        probes = probes.join(terms, ["item", "offset"])
        rows = stored(starts.select("row").distinct(), "decontam-rows")
        lists = self.postings.join(_held(rows, self.small), "row", "left_semi")
        at = F.col("start") + F.col("offset")
        if slop:
            probes = probes.withColumn("at", F.explode(F.sequence(at - slop, at + slop)))
        else:
            probes = probes.withColumn("at", at)
        met = probes.join(lists, ["row", "term", "at"]).groupBy("item", "row", "start").agg(F.collect_set("offset").alias("offsets"))
        kept = wanted.join(met, ["item", "row", "start"])
        share = lambda w: F.size(F.array_intersect(reach(w), F.col("offsets"))) >= F.ceil(w["size"] * F.lit(float(least)))
        found = kept.select("item", "row", "start", F.explode(F.filter("windows", share)).alias("w"))
        return found.select("item", "row", (F.col("start") + F.col("w.first")).alias("start"), F.col("w.first").alias("first"), F.col("w.size").alias("size"))


def phrases(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", name: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int = 0, least: float = 1.0) -> DataFrame:
    """The matches of test items in texts: `key`, `item` (its name; null if it has none), the places of the first word in the text and in the
    item, and the number of words. See `Index.matches` for slop and least."""
    tested = Items(items, name, item_text)
    found = Index(docs, tested, key, text).matches(size, slop, least)
    named = found.join(tested.names, "item", "left")
    return named.select(F.col("row.key").alias(key), F.col("name").alias("item"), "start", "first", F.col("size").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", name: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int = 0, least: float = 1.0) -> DataFrame:
    """docs with `n_words`, `n_hit` (words in some match), `items` (the names of the items met, as sorted strings) and `contaminated`."""
    tested = Items(items, name, item_text)
    found = stored(Index(docs, tested, key, text).matches(size, slop, least), "decontam-matches")
    hit = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("row", "item").distinct().join(tested.names, "item").groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("items"))
    sums = hit.join(named, "row", "left")
    out = ("n_words", "n_hit", "items", "contaminated")
    own = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in out}
    packed = docs.select(row_of(F.col(key), F.col(text)).alias("row"), n_words(F.col(text)).alias("n_words"), *[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    met = packed.join(sums, "row", "left")
    hits = F.coalesce("n_hit", F.lit(0))
    values = (F.col("n_words"), hits, F.coalesce("items", F.array().cast("array<string>")), hits > 0)
    return met.select(*[F.col(x).alias(c) for c, x in own.items()], *[v.alias(c) for c, v in zip(out, values)])
