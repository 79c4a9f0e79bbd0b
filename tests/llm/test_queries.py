"""Registered queries on the smallest tables against plain versions of what they must return."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
from test_passages import repeats_by_hand

from shopwake.llm import QUERIES

SMALL = "/root/testdata/sf0.001"


def stored(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def found(spark, name, key):
    rows = QUERIES[name](spark, SMALL).collect()
    return len(rows), {r[key]: r for r in rows}


def test_repeated_bytes_query(spark):
    docs = stored("documents")
    n, got = found(spark, "op5_repeated_bytes", "doc_id")
    assert n == len(docs)
    for d, want in zip(docs, repeats_by_hand([d["text"] for d in docs], 400)):
        x = got[d["doc_id"]]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def luhn(digits):
    turned = [int(c) for c in reversed(digits)]
    return (sum(turned[::2]) + sum(sum(divmod(2 * c, 10)) for c in turned[1::2])) % 10 == 0


def base_by_hand(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, pattern, holds in rules for m in re.finditer(pattern, text or "") if holds(m[0])]


def test_personal_data_query(spark):
    docs = stored("documents")
    n, got = found(spark, "op6_personal_data", "doc_id")
    assert n == len(docs)
    for d in docs:
        want, x = base_by_hand(d["text"]), got[d["doc_id"]]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for k, *_ in want) for kind in ("email", "ip", "card", "phone")]
        assert set(filter(None, listed.split(","))) <= set(x.spans.split(","))


def test_embeddings_query(spark):
    rows = stored("embeddings")
    column = next(k for k, v in rows[0].items() if isinstance(v, (list, np.ndarray)))
    v = np.array([r[column] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    n, got = found(spark, "op10_embedding_near", "vec_id")
    assert n == len(rows) and [got[r["vec_id"]].n_links for r in rows] == near.sum(1).tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_scores_and_pages_queries(spark):
    docs, pages = stored("documents"), stored("pages")
    toxic = {r["doc_id"]: r["toxic"] for r in stored("labels")}
    n, got = found(spark, "op2_toxicity", "doc_id")
    assert n == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    from zlib import crc32

    assert all(r.held_out == (crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert sum(got[k].predicted == label for k, label in toxic.items() if label is not None) >= 0.9 * len(toxic)
    n, got = found(spark, "op9_quality", "doc_id")
    assert n == len(docs) and all(r.kept == (r.score >= 0.5) for r in got.values())
    n, got = found(spark, "op8_html_text", "page_id")
    assert n == len(pages) and all(r.n_chars == len(r.text) for r in got.values())
    for p in pages:
        assert all(b == " ".join(b.split()) and b for b in got[p["page_id"]].text.split("\n\n") if got[p["page_id"]].text)
    assert found(spark, "op7_language", "page_id")[0] == len(pages)
