import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from textloom.llm import pieces as X

from .cases import documents, empty


@pytest.fixture(scope="module")
def vocabulary():
    return X.vocabulary()


def round_trip(v, found, seed=0):
    texts = pa.array(found, pa.string())
    pieces, at = X.encode(v, texts, np.arange(len(found)).astype(np.uint64), 0.5, seed)
    flat, off = X.decode(v, pieces, at)
    return [bytes(flat[a:b]).decode() for a, b in zip(off, off[1:])], pieces, at


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="a \n▁é漢🙂", max_size=20)), min_size=1, max_size=6))
def test_round_trip(found):
    got, _, _ = round_trip(_V, found)
    assert got == [x or "" for x in found]


_V = X.vocabulary()


def test_samples_follow_the_lattice(vocabulary):
    m = sentencepiece.SentencePieceProcessor(model_file=X.PIECES)
    ids = {m.id_to_piece(i): i for i in range(259, m.get_piece_size())}
    word = X.SPACE + "there"
    ways = []
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[last:i])
                last = i
        parts.append(word[last:])
        if all(p in ids for p in parts):
            ways.append(tuple(ids[p] for p in parts))
    p = np.array([np.exp(0.5 * vocabulary.log_p[list(w)].sum()) for w in ways])
    p /= p.sum()
    n = 40_000
    _, pieces, at = round_trip(vocabulary, ["there"] * n)
    seen = Counter(tuple(pieces[at[i] : at[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(ways)
    assert max(abs(seen[w] / n - q) for w, q in zip(ways, p)) < 0.015


def test_a_row_is_reproducible_in_any_batch(vocabulary):
    found = ["one two three", "four five  six\nseven", "one two three"]
    keys = np.array([7, 8, 7], np.uint64)
    whole, at = X.encode(vocabulary, pa.array(found), keys, 0.5, 0)
    assert whole[at[0] : at[1]].tolist() == whole[at[2] : at[3]].tolist()
    alone, _ = X.encode(vocabulary, pa.array(found[1:2]), keys[1:2], 0.5, 0)
    assert alone.tolist() == whole[at[1] : at[2]].tolist()
    other = [X.encode(vocabulary, pa.array(found[:1]), keys[:1], 0.5, s)[0].tolist() for s in range(1, 6)]
    assert any(x != whole[: at[1]].tolist() for x in other)


def test_hostile_rows(spark):
    docs = documents(spark)
    encoded = X.encode_texts(docs)
    got = encoded.collect()
    assert len(got) == docs.count() and all(r.lossless in (True, None) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[4].pieces is None and by[5].pieces == [] and by[9].n > 100_000
    want = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert sorted((r.doc_id or 0, r.text or "") for r in X.decode_texts(encoded).collect()) == want
    assert X.encode_texts(empty(spark)).count() == 0
