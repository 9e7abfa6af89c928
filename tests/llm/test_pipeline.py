"""The pipeline against plain versions of its stages on a small fixture."""

import corpus_pipeline

from ..conftest import SMALL
from .fixtures import awkward, words
from .test_documents import brute_components, brute_contamination, brute_measures


def fails(text):
    """The six rules of the policy in plain Python."""
    n, chars, symbols, again, repeats = brute_measures(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    return n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or (lines >= 4 and 2 * again > lines) or chars > 20 * n or chars < 2 * n


def test_stages_on_small_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sf_dir = SMALL
    columns = docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == set(before)
            break
        assert after.columns == columns
        kept = {r["doc_id"] for r in after.collect()}
        if name == "language_id":
            assert kept == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        if name == "quality_rules":
            assert kept == {i for i, t in before.items() if not fails(t)}
        if name == "ngram_jaccard_join":
            assert kept == {c for _, _, c in brute_components(sorted(before.items()))}
        if name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert kept == {r[0] for r in brute_contamination(sorted(before.items()), items) if r[2] == 0}
        now = after


def test_pipeline_of_awkward_and_empty_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    for rows in ([r[:5] for r in awkward()], []):
        now = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SMALL).cache()
            now.count()
        assert now.columns[0] == "doc_id"
