"""The pipeline's stages against plain versions of them."""

import math
import random
import re
from collections import defaultdict

import pytest
from test_links import closed
from test_mixing import plan_by_hand
from test_passages import hits_by_hand
from test_personal_data import by_hand
from test_scores import junk, prose
from test_text import words_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(r, 30)) for i in range(8)] + [(8, None)]
    good = [prose(r, r.randint(40, 160)) for _ in range(200)]
    texts = list(good)
    texts += [" ".join([*g.split()[:-1], "changed."]) for g in good[:20]] + good[20:30]
    texts += [good[50 + i].split(".")[0] + ". " + items[i][1] for i in range(8)]
    texts += [f"{good[70 + i]} Write to a{i}@example.com or +1 (017) 555-77{i}3." for i in range(10)]
    texts += [junk(r, r.randint(60, 160)) for _ in range(40)] + ["", None, "Short."]
    rows = [(i, t, "en", f"s{i % 5}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items, len(texts) - 43


def test_stages(spark, tables, tmp_path):
    folder, rows, items, first_junk = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "ngram_jaccard", "decontaminate", "personal_data", "mix"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS
        kept.append(docs.collect())
    junk_ids = set(range(first_junk, first_junk + 40))
    # 1: junk goes, all else stays.
    assert {x.doc_id for x in kept[0]} >= {x[0] for x in rows} - junk_ids
    assert len({x.doc_id for x in kept[0]} & junk_ids) <= 1
    # 2: one of each group of near copies; texts without words all stay.
    before = kept[0]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words_of(x.text) for x in before)]
    links = [(i, j) for i in range(len(before)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = closed(range(len(before)), links)
    least = defaultdict(lambda: 10**9)
    for i, x in enumerate(before):
        least[label[i]] = min(least[label[i]], x.doc_id)
    assert sorted(x.doc_id for x in kept[1]) == sorted(v for k, v in least.items())
    # 3: contaminated texts go.
    told = hits_by_hand([x.text for x in kept[1]], items, 13)
    assert sorted(x.doc_id for x in kept[2]) == sorted(x.doc_id for x, (n, hit, _) in zip(kept[1], told) if not (hit and 20 * hit >= n))
    assert len(kept[2]) < len(kept[1])
    # 4: every document stays, base spans are masked.
    texts = {x.doc_id: x.text for x in kept[2]}
    assert {x.doc_id for x in kept[3]} == set(texts)
    for x in kept[3]:
        assert not list(by_hand(x.text or "")) and x.n_chars == (len(x.text) if x.text is not None else None)
        want = texts[x.doc_id]
        for kind, a, b in sorted(by_hand(want or ""), key=lambda s: -s[1]):
            want = want[:a] + f"[{kind}]" + want[b:]
        if not re.search("[0-9@]", want or ""):
            assert x.text == want
    # 5: what the mix takes.
    size = {x.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")) for x in kept[3]}
    per = defaultdict(int)
    for x in kept[3]:
        per[x.source] += size[x.doc_id]
    want = plan_by_hand(per, (3, 1, 2), 1.5, 2)
    taken = defaultdict(int)
    for x in kept[4]:
        assert 0 < x.taken <= 2 * x.size == 2 * size[x.doc_id] and math.isclose(x.target, want[x.source])
        assert x.text is not None and x.taken == sum(p.to_word - p.from_word for p in x.pieces)
        taken[x.source] += x.taken
    assert dict(taken) == {s: math.floor(t) for s, t in want.items() if t >= 1}


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.count() > 100 and {"doc_id", "text", "taken", "pieces"} <= set(out.columns)


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables[0]).count() == 0
