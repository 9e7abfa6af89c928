"""Operator 10's sample: bounded and fair, whatever ids and texts repeat."""

import random

import numpy as np
import pyarrow as pa

from callmetrics.llm import kernel as K
from callmetrics.llm import language


def rows(n, ids):
    rng = random.Random(4)
    words = {"x": ["alpha", "gamma", "delta", "kappa"], "y": ["eins", "zwei", "drei", "vier"]}
    out = []
    for i in range(n):
        lang = "xy"[i % 2]
        out.append((ids(i), " ".join(rng.choice(words[lang]) for _ in range(12)), lang))
    return out


def sampled(spark, data, sample=50):
    found, names = language._thinned(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(7), sample)
    return found.collect(), names


def test_repeated_and_null_ids_are_sampled_like_others(spark):
    for ids in (lambda i: 6, lambda i: None, lambda i: i):
        data = rows(2000, ids)
        got, names = sampled(spark, data)
        assert names == ["x", "y"] and {k: sum(r["lang"] == k for r in got) for k in names} == {"x": 50, "y": 50}
        assert all((r["doc_id"], r["text"], r["lang"]) in data for r in got)
        net = language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), sample=50)
        right = language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string"), net).filter("lang = lang_pred").count()
        assert right > 1950


def test_copies_and_small_languages(spark):
    data = [(6, "one text for all", "x")] * 500 + [(7, "ein Text", "y")] * 3 + [(8, None, "z")]
    got, names = sampled(spark, data)
    assert names == ["x", "y", "z"] and [sum(r["lang"] == k for r in got) for k in names] == [50, 3, 1]


def test_the_sample_does_not_depend_on_partitions(spark):
    data = rows(600, lambda i: i // 3)
    one = {(r["doc_id"], r["text"]) for r in sampled(spark, data)[0]}
    assert one == {(r["doc_id"], r["text"]) for r in sampled(spark, data[::-1])[0]}


def test_equal_probabilities_give_the_first_language():
    net = language.Network.new(["a", "b", "c"], hidden=4)
    net.weights = {k: np.zeros_like(v) for k, v in net.weights.items()}
    p = language.probabilities(net, K.texts(pa.array(["same for all", "", "x"])))
    assert p[0].tolist() == [1 / 3] * 3 or np.allclose(p[0], 1 / 3)
    assert p.argmax(axis=1)[0] == 0
