import random
import re

import numpy as np
import pyarrow as pa

from shopwake.llm.groups import groups, roots
from shopwake.llm.text import SEGMENT, Words, distinct, flat, shingles, slices

TEXTS = [None, "", "  ", "One two, three", "É éÉ x9_y", "a" * 50, "one TWO three four five six", "x\ny\tz", "naïve-café"]


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_words_and_shingles():
    for kind in (pa.string(), pa.large_string()):
        data, offsets = flat(pa.array(TEXTS, kind).slice(1).slice(0, len(TEXTS) - 1))
        words = Words(data, offsets)
        own = TEXTS[1:]
        assert words.counts.tolist() == [len(words_of(t)) for t in own]
        spelled = [w for t in own for w in words_of(t)]
        hashes = words.hash.tolist()
        assert len(set(hashes)) == len(set(spelled)) == len(set(zip(spelled, hashes)))
        cut = [bytes(data[a:b]).lower().decode() for a, b in zip(words.start, words.end)]
        assert [c.lower() for c in cut] == [w.lower() for w in spelled]
        values, at = distinct(*shingles(words, 5))
        expected = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in map(words_of, own)]
        assert np.diff(at).tolist() == [len(e) for e in expected]


def test_long_text_is_hashed_in_segments():
    pick = random.Random(1)
    text = " ".join(pick.choice(["ab", "cde", "f" * 40]) for _ in range(120_000))
    assert len(text) > SEGMENT
    words = Words(*flat(pa.array([text, "ab cde"])))
    assert words.counts.tolist() == [120_000, 2]
    assert set(words.hash[-2:].tolist()) <= set(words.hash[:-2].tolist())
    assert len(set(words.hash.tolist())) == 3


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * n for n in (1, 50, 3, 200, 0)] + [None])})
    got = [t for part in slices(iter([batch]), "text", 60) for t in part.column("text").to_pylist()]
    assert got == batch.column("text").to_pylist()


def test_groups_cross_batches():
    keys = [1, 1, 2, 2, 2, 3]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[a:b], pa.int64())}) for a, b in ((0, 1), (1, 4), (4, 4), (4, 6))]
    assert [g.column("k").to_pylist() for g in groups(iter(batches), "k")] == [[1, 1], [2, 2, 2], [3]]
    assert roots(6, np.array([5, 3, 1]), np.array([4, 4, 2])).tolist() == [0, 1, 1, 3, 3, 3]
