"""Stages remove rows, not ids: repeated, shared and null ids."""

import corpus_pipeline

from ..conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
COPY = " ".join(f"copy{i}" for i in range(40))
PASSAGE = " ".join(f"leak{i}" for i in range(12))


def documents(spark, path, rows):
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def kept(df):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return sorted(((r["doc_id"], r["source"]) for r in df.collect()), key=str)


def test_one_row_of_each_group_stays(spark, tmp_path):
    apart = [" ".join(f"{name}{i}" for i in range(40)) for name in "xyz"]
    rows = [(5, COPY, "same")] * 3 + [(None, COPY, "null")] * 4 + [(9, COPY + " more", "near"), (9, apart[0], "clean"), (None, apart[1], "clean null")] + [(None, apart[2], "only null")] * 2 + [(7, "", "empty")] * 2
    want = [(5, "same"), (7, "empty"), (7, "empty"), (9, "clean"), (None, "clean null"), (None, "only null")]
    assert kept(corpus_pipeline.near_duplicates(spark, documents(spark, f"{tmp_path}/docs", rows), "")) == want
    frame = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)
    assert kept(corpus_pipeline.near_duplicates(spark, frame, "")) == want


def test_contaminated_rows_go_and_no_others(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(3, "a " + PASSAGE, "hit"), (3, "clean text of the same id", "clean"), (None, PASSAGE + " b", "null hit"), (None, "clean text without id", "clean null")]
    docs = documents(spark, f"{tmp_path}/docs", rows)
    assert kept(corpus_pipeline.decontaminated(spark, docs, str(tmp_path))) == [(3, "clean"), (None, "clean null")]


def test_items_without_id_are_searched(spark, tmp_path):
    spark.createDataFrame([(None, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, f"{tmp_path}/docs", [(3, "a " + PASSAGE, "hit"), (4, "clean text", "clean")])
    assert kept(corpus_pipeline.decontaminated(spark, docs, str(tmp_path))) == [(4, "clean")]


def test_columns_of_the_user_stay(spark, tmp_path):
    mine = {"score": 123.0, "lang_pred": "mine", "held_out": "no", "failed": 7, "ledger": "l", "_measure_n_words": 5, "row": 9, "f": "f", "n": 1, "language": "x", "part": "p"}
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"the {a} and the {b} went over a long road to the {c} where they saw many things of the old town and then came back again to rest" for a, b, c in zip("abcdefghijkl", "mnopqrstuvwx", "yzabcdefghij", strict=True)]
    rows = [(i, t, "en", "s", len(t), *mine.values()) for i, t in enumerate(texts)]
    schema = SCHEMA + ", score double, lang_pred string, held_out string, failed int, ledger string, _measure_n_words int, row int, f string, n int, language string, part string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, docs, str(tmp_path))
        assert now.schema == docs.schema, name
        kept = now.collect()
        assert kept and all(tuple(r)[5:] == tuple(mine.values()) for r in kept), name
        docs = now
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() >= len(kept)


def test_languages_that_were_not_learned_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    import random

    rng = random.Random(1)
    noise = [(10**6 + i, " ".join("".join(rng.choice("qxzjvkwф") for _ in range(rng.randrange(2, 9))) for _ in range(60)), None, "noise", 1) for i in range(20)]
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(noise, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, more, SMALL).select("doc_id").collect()}
    real = {r["doc_id"] for r in docs.filter("rlike(text, '\\\\p{L}')").select("doc_id").collect()}
    assert len(real & left) >= 0.99 * len(real)
    assert sum(i >= 10**6 for i in left) <= 2
