import random
import re
from collections import Counter, defaultdict

import pytest

from shopwake.llm import collocations as C
from shopwake.llm.license_scan import Template, document_licenses, license_spans

DOCS = "doc_id long, text string, lang string, size int, phrase string, n long, words string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def by_hand(rows, longest=3, least=10, within=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", low(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        ranked = []
        for p, a in candidates.items():
            if held[p] and 100 * held[p] >= within * a:
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], score))
        for rank, (*_, p, a, left, right, score) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p, a, left, right, n[lang], score))
    return sorted(out)


def some_texts(seed, n, langs=("en", "de", None, "")):
    pick = random.Random(seed)
    vocabulary = [pick.choice(["a", "b", "xy", "Über", "ß", "ÀB", "K", "w" * 9]) + pick.choice(["", "1", "é"]) for _ in range(14)]
    rows = []
    for i in range(n):
        words = [pick.choice(vocabulary) for _ in range(pick.randrange(0, 90))]
        rows.append((i, "".join(w + pick.choice([" ", " ", "\t", "  ", ". ", "\n", ", "]) for w in words), pick.choice(langs)))
    return rows


@pytest.mark.parametrize("part_bytes", [C.PART_BYTES, 64])
def test_collocations_by_hand(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(C, "PART_BYTES", part_bytes)
    rows = some_texts(1, 120) + [(1, None, "en"), (2, "", None), (3, " .,\t\n", "fr"), (4, "one", "it")]
    rows += [(5, "the same line again. " * 40, "hot")] * 30  # repeated rows, ids too
    rows += [(6, "Tail words here " * 3000, "en")]
    docs = frame(spark, rows)
    if part_bytes == 64:  # a function that workers unpickle reads the module's value there
        docs = docs.repartition(3)
    got = sorted(tuple(r) for r in C.collocations(docs).collect())
    assert got == by_hand(rows)


def test_collocations_other_sizes(spark):
    rows = some_texts(2, 60)
    for longest, top in ((2, 5), (4, 2000)):
        got = sorted(tuple(r) for r in C.collocations(frame(spark, rows), longest=longest, least=4, top=top).collect())
        assert got == by_hand(rows, longest=longest, least=4, top=top)


def test_collocations_of_nothing(spark):
    assert C.collocations(frame(spark, [])).collect() == []
    assert C.collocations(frame(spark, [(1, None, None), (None, "", "en")])).collect() == []


def test_parts_of_a_text():
    import numpy as np

    data = np.frombuffer(b"aa bb. cc dd ee\nff" + b"g" * 50 + b"h. i", np.uint8)
    parts = list(C._parts(data, np.array([0, 18, 18, len(data)]), 8))
    assert parts[0][0] == 0 and parts[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(to in (18, len(data)) or chr(data[to - 1]) in ".\n" for _, to in parts)


def words_of(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", low(text))


BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base_by_hand(text):
    words, places = words_of(text), []
    for phrase, label in BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software"
)


def test_license_bases_by_hand(spark):
    pick = random.Random(3)
    parts = ["Released under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by", "nc", "word", "Ünder", "the mit", "license", "version 2"]
    texts = [" ".join(pick.choice(parts) for _ in range(pick.randrange(0, 40))) for _ in range(80)]
    texts += [None, "", "...", "one", "one two", "cc by nc cc by nc", "under the mit license" * 2, "x cc by nc " * 5000, "ünder the mit license"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "cc by nc", "en")] * 2 + [(7, "cc by nc", None)] * 3
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in document_licenses(frame(spark, rows)).collect())
    assert got == Counter((i, *base_by_hand(t)) for i, t, _ in rows)


def test_license_notices(spark):
    broken = MIT.replace("hereby ", "").replace("merge", "merge join")
    rows = [(1, "intro " * 30 + MIT + " tail", "en"), (2, broken, "en"), (3, "permission to sell copies of the software", "en"), (4, "plain words", "en"),
            (5, "this work is licensed under the gnu general public license, version 3.", "en"), (6, MIT + " and " + MIT, "en")]
    got = {r.doc_id: r for r in document_licenses(frame(spark, rows)).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["mit", "mit", "", "", "gpl-3", "mit"]
    assert got[1].score == 1.0 and 0.8 <= got[2].score < 1.0 and 0 < got[3].score < 0.8 and got[4].score == 0.0
    assert all(r.n_base == 0 and r.first_word is None for r in got.values())
    spans = license_spans(frame(spark, rows)).where("doc_id = 1 and verified").collect()
    assert [(s.label, s.first_word, s.end_word) for s in spans] == [("mit", 30, 30 + len(words_of(MIT)))]


def test_license_of_nothing(spark):
    assert document_licenses(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        document_licenses(frame(spark, []), (Template("x", "two words"),))
