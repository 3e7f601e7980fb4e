"""A corpus pipeline of five operators of tidewheel.llm, in the order of STAGES.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs; all
but the last return the columns of documents.

1. toxicity: a model is fitted on the labels; documents of a score of TOXIC or more go; where no word was learned, all stay.
2. near duplicates: one document of each group of similar texts stays, one with the group's smallest doc_id.
3. secrets: their spans are replaced by a mark, and n_chars follows the text; every document stays.
4. mixing: documents are taken or repeated until each source meets its target of words; a document at a budget's edge is
   cut after its last word that is taken.
5. encoding: every text's byte-level BPE ids, and the text decoded from them, which must be the text again.

Nulls: a null text has the score of an empty one, is never a duplicate, has no secrets, is kept once by mixing and encodes to no
ids. Empty tables pass through all stages. Extra columns of documents are kept by stages 1 to 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bpe, jaccard, mixing, secret_scan, toxicity
from tidewheel.llm.scratch import ship, stored

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(F.col("text"), model) < TOXIC) if model.learned else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.unique(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), secret_scan.redacted(F.col("text")).alias("text"))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.coalesce(own["n_chars"] + F.length("text") - F.length("row.text"), own["n_chars"])
    return packed.select(*[(F.col("text") if c == "text" else x).alias(c) for c, x in own.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == whole).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: The stages learn models and search similar texts, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each on the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
