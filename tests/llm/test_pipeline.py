import os
import sys

import corpus_pipeline
from oracle_check import compare, connect
from plumbline.llm import oracle, registry


def test_oracles(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in oracle.sql().items():
        assert compare(spark, con, registry.queries()[name], sql, sf_dir)[0] == "", name


def test_stages(spark, sf_dir):
    """Each stage against what it promises of its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    good = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    whole = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir)
    texts = [r.text.lower() for r in whole.collect()]
    assert whole.columns == docs.columns and len(texts) == len(set(texts))
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    ids = corpus_pipeline.encode(spark, docs, sf_dir)
    assert ids.columns == ["doc_id", "n_tokens", "ids"] and ids.count() == docs.count()


def test_entry_lists_them():
    sys.path.insert(0, os.path.dirname(os.path.abspath(corpus_pipeline.__file__)))
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(registry.queries()) <= names and "pipeline" in names
