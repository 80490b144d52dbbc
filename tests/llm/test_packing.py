import random

from textloom.llm import packing as X

from .cases import documents, empty


def brute(lengths, max_len):
    """Shortest pack first, one text at a time."""
    packs = []
    for x in sorted(lengths, reverse=True):
        low = min(packs, key=sum, default=None)
        if low is not None and sum(low) + x <= max_len:
            low.append(x)
        else:
            packs.append([x])
    return sorted(tuple(p) for p in packs)


def test_patterns_are_those_of_one_text_at_a_time():
    rng = random.Random(2)
    for _ in range(100):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(0, 60))]
        got = X.patterns({x: lengths.count(x) for x in set(lengths)}, 20)
        flat = [p for n, p in got for _ in range(n)]
        assert all(sum(p) <= 20 for p in flat)
        assert sorted(x for p in flat for x in p) == sorted(lengths)
        assert len(flat) == len(brute(lengths, 20))
        assert sorted(sum(p) for p in flat) == sorted(map(sum, brute(lengths, 20)))


def test_every_word_is_in_one_pack(spark):
    docs = documents(spark)
    got = X.pack(docs, max_len=64).collect()
    want = sum(len((r.text or "").split()) for r in docs.collect())
    assert sum(r.length for r in got) == want
    packs = {}
    for r in got:
        packs.setdefault(r.pack_id, []).append(r)
    for rows in packs.values():
        assert sum(r.length for r in rows) <= 64
        assert sorted(r.position for r in rows) == list(range(len(rows)))
        assert {r.pack_length for r in rows} == {sum(r.length for r in rows)}
    assert sorted(packs) == list(range(len(packs)))
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 9)
    assert [s for _, s, _ in long] == [64 * i for i in range(len(long))]
    assert sum(r.doc_id == 2 for r in got) == 2  # repeated rows are packed as often
    assert {r.doc_id for r in got}.isdisjoint({4, 5, 6})
    by = {r.doc_id: r.text for r in docs.where("doc_id <> 2").collect()}
    for i in {r.doc_id for r in got} - {2, None}:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert "".join(r.text for r in own) == by[i] and all(len(r.text.split()) == r.length for r in own)


def test_tokens_of_a_vocabulary(spark):
    import os

    import numpy as np

    folder = "/opt/tokenizers"
    found = sorted(x for x in os.listdir(folder) if x.endswith(".tiktoken"))
    if not found:
        import pytest

        pytest.skip("no file of ranks")
    starts = X.tiktoken_starts(f"{folder}/{found[0]}", r"\s*\S+|\s+")
    texts = ["héllo wörld 🙂🙂 日本語", "", "plain words"]
    raw = [t.encode() for t in texts]
    at, counts = starts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert counts[0] == 0 and counts[1] == counts[2] < counts[3] == len(at)
    assert all((b"".join(raw)[i] & 0xC0) != 0x80 for i in at.tolist()) and (np.diff(at) >= 0).all()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = X.pack(docs, max_len=3, starts=starts).collect()
    for i, t in enumerate(texts):
        assert "".join(r.text for r in sorted(got, key=lambda r: r.piece) if r.doc_id == i) == t


def test_empty(spark):
    assert X.pack(empty(spark)).count() == 0
