import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import kernels as K

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab1 é,\n漢", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_and_hashes_are_those_of_each_text_alone(found):
    buf, offsets = K.buffer(pa.array(found, pa.string()))
    starts, ends, counts = K.spans(buf, offsets)
    words = [re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", x or "") for x in found]
    assert np.diff(counts).tolist() == [len(x) for x in words]
    assert [bytes(buf[a:b]).decode() for a, b in zip(starts, ends)] == sum(words, [])
    assert K.hashes(buf, starts, ends).tolist() == K.hash_strings(sum(words, [])).tolist()


def test_passes_cover_a_batch_once_and_a_long_text_is_one_pass():
    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 100, "", "c" * 9]})
    parts = [p.column("text").to_pylist() for p in K.passes(batch, limit=20)]
    assert sum(parts, []) == batch.column("text").to_pylist()
    assert ["b" * 100] in [[x for x in p if x] for p in parts]


def test_grams_of_short_texts_are_the_whole_text():
    h = np.arange(1, 8, dtype=np.uint64)
    g, of = K.grams(h, np.array([0, 2, 2, 7]), 3)
    assert of.tolist() == [0, 2, 2, 2]
    assert len(set(g.tolist())) == 4
