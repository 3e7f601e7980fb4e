"""Columns of the callers that have the names which operators use themselves."""

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import decontam, fim, jaccard, langid, licenses, lm, mixing, scratch, secret_scan, toxicity

NAMES = (
    "__key __text __null __size __source __row __own __before __total __target __epochs __cut __rest __s __k __t __training __words row key own none none_ key_ text_name class name at c0 c1 unit rows "
    "component head first links block word n x z label share curve"
).split()


@pytest.fixture(scope="module")
def named(edge):
    return edge.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(n) for n in NAMES])


def kept(df):
    rows = df.collect()
    assert rows and set(NAMES) <= set(df.columns)
    for r in rows:
        for n in NAMES:
            assert r[n] == f"{n}:{'?' if r['doc_id'] is None else r['doc_id']}", n
    return rows


def test_unused():
    assert scratch.unused(["a", "B_", "b"], "a", "b", "c") == ["a_", "b__", "c"]


def test_columns_stay(spark, named):
    n = named.count()
    for df in (
        mixing.taken(named), mixing.shared(mixing.sized(named)), lm.score(named, F.col("doc_id") % 2 == 1), fim.transform(named), secret_scan.scan(named), licenses.scan(named),
        langid.identify(named, langid.fit(named)), decontam.contamination(named, spark.createDataFrame([(1, "one")], "item_id long, text string")),
    ):
        assert len(kept(df)) == n
    assert mixing.mix(named).columns == named.columns and kept(mixing.mix(named))
    unique = jaccard.unique(named)
    assert unique.columns == named.columns and 0 < len(kept(unique)) < n
    labels = spark.createDataFrame([(1, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(kept(toxicity.score_all(named, toxicity.fit(named, labels)))) == n


def test_stages(spark, named, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = named
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, str(tmp_path)), f"names-{name}")
        assert docs.columns == named.columns
        kept(docs)
