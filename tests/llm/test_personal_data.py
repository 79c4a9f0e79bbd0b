import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopwake.llm import pii
from shopwake.llm.tagger import CLASSES, KINDS, TAGS, Tagger, classes

# The four patterns as stated, without the care for long runs.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_hand(text):
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub(r"\D", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 13 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                yield kind, m.start(), m.end()


def test_patterns():
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("0123456789.@+- ()ab"), 60)) for _ in range(3000)]
    texts += ["".join(r.choice(list("0127.@a-"), 40)) for _ in range(3000)]
    texts += ["a@b@c.d", "x.y@z..w", "é@a.b", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.2.3.4", "4111 1111-1111 1111", "+1 (017) 555-7713)", "@", "+", "1" * 5000, "a" * 200_000, "1.1." * 50_000]
    for text, _ in pii.labelled(100, 5):
        texts.append(text)
    for t in texts:
        if len(t) < 100_000:
            assert pii.patterns(t) == list(by_hand(t)), t
        else:
            pii.patterns(t)


def test_gradients():
    tagger = Tagger(4)
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, CLASSES, (3, 7)), r.integers(0, TAGS, (3, 7))
    _, g = tagger.gradients(ids, tags)
    for k, p in tagger.p.items():
        for _ in range(5):
            at = tuple(r.integers(0, s) for s in p.shape)
            held = p[at]
            p[at] = held + 1e-5
            up, _ = tagger.gradients(ids, tags)
            p[at] = held - 1e-5
            down, _ = tagger.gradients(ids, tags)
            p[at] = held
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6
    e = tagger.emissions(ids)
    best = tagger.decode(e)
    score = lambda t: e[0, np.arange(7), t].sum() + tagger.p["t"][t[:-1], t[1:]].sum()
    assert all(score(best[0]) >= score(r.integers(0, TAGS, 7)) for _ in range(200))


def test_windows_cover_every_hint():
    text = "x" * 100 + "1" + "y" * 300 + "a@b" + "2 " * 200
    cut = [w for run in pii.runs(text) for w in pii.windows(*run)]
    assert all(0 < b - a <= pii.LENGTH for a, b in cut)
    for m in re.finditer("[0-9@]", text):
        assert any(a <= m.start() - min(m.start(), 20) and m.end() + min(20, len(text) - m.end()) <= b for a, b in cut)
    assert pii.runs("") == pii.runs("no hints") == [] and len(classes("aé1\U0001f600")) == 4


def test_held_out_accuracy():
    tagger = pii.model()
    n = found = wrong = 0
    held = [*pii.labelled(150, 99)]
    for (text, spans), every in zip(held, pii.tagged(tagger, [text for text, _ in held])):
        got = set(pii.reconcile(every, []))
        n, found, wrong = n + len(spans), found + len(got & set(spans)), wrong + len(got - set(spans))
    assert found >= 0.8 * n and wrong <= 0.03 * n


class Marker:
    """Stands for a tagger: letters of the class of ``x`` are one e-mail address."""

    def emissions(self, ids):
        return (ids == classes("x")[0]).astype(float)

    def decode(self, e):
        first = np.diff(np.pad(e, ((0, 0), (1, 0))), axis=1) > 0
        return np.where(e > 0, np.where(first, 1, 2), 0)

    def marginals(self, e):
        return None, np.ones((*e.shape, TAGS))


@pytest.mark.parametrize("before, length", [(60, 3), (60, 30), (60, 47), (60, 90), (7, 200), (300, 1000), (0, 400)])
def test_spans_beyond_runs_and_windows(before, length):
    """Spans longer than a window's overlap, a window or the run are found whole."""
    text = "é" * before + "x" * length + "@" + "é" * 100
    assert [f[:3] for f in pii.reconcile(pii.tagged(Marker(), [text])[0], [])] == [("email", before, before + length)]


def test_stitched():
    parts = [("card", 5, 50, 0.9, False, True), ("card", 40, 60, 0.8, True, False), ("card", 45, 50, 1.0, False, True), ("ip", 40, 44, 1.0, True, False)]
    assert pii.stitched(parts[:2]) == [("card", 5, 60, 0.8, False, False)]
    assert pii.stitched(parts[2:]) == [parts[3], parts[2]]
    bad = "9" * 16
    assert pii._card("4111.1111.1111.1111") and not pii._card(bad) and not pii._card("411111111111")


def test_personal_data(spark):
    texts = [None, "", "nothing here", "mail bob@example.com or +1 (017) 555-7713, ip 10.0.0.255", "call (123) 456-7890 now", "é 4111111111111111 " * 200, "1" * 3000]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, spans string, kind int")
    rows = pii.personal_data(df)
    out = {x.doc_id: x for x in rows.select("_row.doc_id", "text", F.col("spans"), pii.listed(F.col("spans")).alias("all"), pii.masked(F.col("text"), F.col("spans")).alias("masked")).collect()}
    assert len(out) == len(texts) + 1
    for i, t in enumerate(texts):
        base = [(s.kind, s.start, s.end) for s in out[i].spans if not s.added]
        assert base == list(by_hand(t or ""))
        added = [s for s in out[i].spans if s.added]
        assert all(b <= s.start or s.end <= a for s in added for _, a, b in base)
    assert out[3]["all"].startswith("email:5:20,ip:") and out[3]["masked"] == "mail [email] or [phone], ip [ip]"
    assert out[0]["masked"] is None and out[1]["masked"] == "" and out[2]["masked"] == "nothing here"
    assert out[7]["all"] == out[3]["all"]
    assert pii.personal_data(df.limit(0)).count() == 0


@pytest.mark.parametrize("spans, wanted", [([("a", 0, 2), ("b", 1, 4)], "[a]e"), ([("a", 1, 1)], "x[a]yzwe"), ([("b", 3, 5), ("a", 3, 4)], "xyz[b]")])
def test_masking_overlaps(spark, spans, wanted):
    df = spark.createDataFrame([("xyzwe", [(*s, False) for s in spans])], "text string, spans array<struct<kind:string,start:long,end:long,added:boolean>>")
    assert df.select(pii.masked(F.col("text"), F.col("spans"))).first()[0] == wanted
