"""The operators' queries over whole tables: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fim, fingerprint, jaccard, langid, licenses, lm, mixing, secret_scan, spelling, topk, toxicity
from .scratch import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, at weights 5, 2, 1 and 150 % of all words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.shared(mixing.sized(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels outside the held-out fold; 0 for all where no word was learned, as nothing sets any apart."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score_all(docs, model, out="score")
    score = F.col("score") if model.learned else F.lit(0.0)
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every text under the backoff automaton, and under unigrams alone."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, _fold(10) != 0)
    held_out = F.coalesce(_fold(10) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, and its number of similar documents."""
    found = jaccard.links(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "n_links")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, by profiles of the texts outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("licences", lambda x: F.concat_ws(":", x["licence"], x["start"].cast("string"), x["end"].cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["licence"])))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    return fingerprint.with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes that they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at two of its lines and rearranged, and the text rebuilt from that, as digests."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = fim.transform(docs).select("doc_id", "fim.*")
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that stand in a passage of a benchmark item, and the items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of all documents, some of which lose a letter by a hash, with the words that they are variants of."""
    docs, run = _table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("run")
    met = docs.select("doc_id", F.explode(spelling.runs(F.col("text"), spelling.LENGTH)).alias("run"))
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (hashed % F.length(run)).cast("int")
    less = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return spelling.variants(spelling.counted(met.select(F.when(hashed % 31 == 0, less).otherwise(run).alias("word"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_toxicity, op3_exact_top_k, op4_lm_scoring, op5_ngram_jaccard, op6_language_id, op7_license_scan, op8_secret_scan, op9_fingerprints, op10_byte_bpe,
        op11_fill_in_middle, op12_decontamination, op13_spelling_variants,
    )
}

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE []::VARCHAR[] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)
  UNION ALL SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON len(x.a) = 0 AND len(y.a) = 0 AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM documents d"""

_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', '0', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS total, list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, total * 2.0::DOUBLE AS cap, total * 2.0::DOUBLE / w AS fill FROM t),
o AS (
  SELECT *, (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM f
  WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (
  SELECT source, total, CASE WHEN common IS NULL OR w * common >= cap THEN cap ELSE w * common END AS target
  FROM (SELECT *, (SELECT min_by(level, fill) FROM o WHERE level < fill) AS common FROM o)),
e AS (SELECT *, floor(target)::BIGINT AS words, CASE WHEN total > 0 THEN floor(target)::BIGINT // total ELSE 0 END AS epochs FROM a),
k AS (SELECT source, key, sum(size)::BIGINT AS size, count(*) AS n FROM d GROUP BY ALL),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k)
SELECT d.doc_id, d.size, e.total AS source_size, e.target,
  (e.epochs * d.size + greatest(0, least(d.size, CASE WHEN p.before + p.size <= e.words - e.epochs * e.total THEN d.size ELSE (e.words - e.epochs * e.total - p.before) // p.n END)))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.key = p.key"""

_FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS a, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (
  SELECT doc_id, t, a, len(a)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(a) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(a) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, coalesce(array_to_string(a[1:least(x, y)], ''), '') AS pre, coalesce(array_to_string(a[least(x, y) + 1:greatest(x, y)], ''), '') AS mid,
    coalesce(array_to_string(a[greatest(x, y) + 1:n], ''), '') AS suf FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256 FROM p"""

_DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS a FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT item_id, least(len(a), 10) AS size, array_to_string(a[i:i + 9], ' ') AS g FROM (SELECT item_id, a, unnest(range(1, greatest(len(a) - 9, 1) + 1)) AS i FROM b WHERE len(a) > 0)),
g AS (SELECT r, size, i, array_to_string(a[i:i + size - 1], ' ') AS g FROM (SELECT r, a, size, unnest(range(1, len(a) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM w) WHERE len(a) >= size)),
m AS (SELECT DISTINCT r, i, g.size, item_id FROM g JOIN w ON g.g = w.g AND g.size = w.size),
h AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
s AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM m WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(a)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)"""

# A CRC-32, four bits at a time: its table of 16 entries follows from the polynomial.
_NIBBLES = [0]
for _i in range(1, 16):
    _NIBBLES.append(_i)
    for _ in range(4):
        _NIBBLES[_i] = _NIBBLES[_i] >> 1 ^ 0xEDB88320 * (_NIBBLES[_i] & 1)
_SPELLING = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS s, w, count(*) AS c FROM r WHERE length(w) >= 7 GROUP BY ALL),
x AS (
  SELECT w, c, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda p: ('0x' || p)::BIGINT),
    lambda a, b: xor(xor(a >> 4, {_NIBBLES}[(xor(a, b) & 15) + 1]) >> 4, {_NIBBLES}[(xor(xor(a >> 4, {_NIBBLES}[(xor(a, b) & 15) + 1]), b >> 4) & 15) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM k),
t AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM x),
v AS (SELECT word, sum(c)::BIGINT AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
del AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (
  SELECT x.word AS a, y.word AS b FROM del x JOIN del y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, y.word FROM del x JOIN v y ON x.rest = y.word UNION SELECT y.word, x.word FROM del x JOIN v y ON x.rest = y.word),
f AS (SELECT a, count(*)::BIGINT AS n_near, max(v.n) AS top, min_by(b, (-v.n, b)) AS best FROM e JOIN v ON v.word = e.b GROUP BY a),
o AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN best END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN f ON f.a = v.word),
p AS (SELECT word, word AS last, 0 AS d FROM v UNION ALL SELECT p.word, o.form, d + 1 FROM p JOIN o ON o.word = p.last WHERE o.form IS NOT NULL)
SELECT o.word, form, root, n, n_near, form_n FROM o JOIN (SELECT word, max_by(last, d) AS root FROM p GROUP BY word) q ON q.word = o.word"""

#: Of the queries that SQL expresses: the others rest on models, on hashes or on libraries.
ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": _MIXING, "op3_exact_top_k": _TOP_K, "op5_ngram_jaccard": _JACCARD, "op11_fill_in_middle": _FILL_IN_MIDDLE, "op12_decontamination": _DECONTAMINATION,
    "op13_spelling_variants": _SPELLING,
}
