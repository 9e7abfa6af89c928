import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from callmetrics.llm import kernel as K

from .fixtures import awkward, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab A\n\té日.|'\x00"), max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    t = K.texts(pa.array(texts, pa.string()))
    w = K.words(t)
    want = [words(x) for x in texts]
    got = K.strings(t.data, w.start, w.end)
    assert got == [x for doc in want for x in doc] and w.counts.tolist() == [len(x) for x in want]
    h = K.span_hash(t.data, w.start, w.end)
    assert len(set(h.tolist())) == len(set(got)) and all((h[i] == h[j]) == (got[i] == got[j]) for i in range(len(got)) for j in range(i))


def test_slices_cover_all_rows_once():
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in awkward()]), pa.array([r[1] for r in awkward()])], names=["i", "t"])
    for size in (1, 50, 4000, 1 << 20):
        assert pa.Table.from_batches(list(K.slices(batch, 1, size))).to_pylist() == batch.to_pylist()
    assert list(K.slices(batch.slice(0, 0), 1)) == []


def test_hashes_of_long_spans_differ():
    data = np.append(np.tile(np.arange(50, dtype=np.uint8), 40), np.zeros(8, np.uint8))
    start, end = np.array([0, 50, 0, 1]), np.array([1000, 1050, 999, 1001])
    h = K.span_hash(data, start, end)
    assert h[0] == h[1] and len({*h.tolist()}) == 3
