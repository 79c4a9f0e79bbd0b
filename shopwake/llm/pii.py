"""Personal data in texts: fixed patterns, and a character tagger beside them.

The patterns find e-mail and IP addresses, card and phone numbers by rule. The
tagger, a bidirectional LSTM with CRF transitions, reads overlapping windows and
adds spans that the patterns do not touch. All kinds hold a digit or an @ sign, so
windows cover everything within ``AROUND`` characters of one; no span can begin elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tagger import KINDS, LENGTH, Tagger, classes
from .tables import packed, with_fields
from .text import slices

AROUND = 24
STEP = LENGTH // 2  # windows overlap by half
SURE = 0.9  # least probability of any character of an added span
BATCH = 512  # windows decoded at once

# The patterns of the four kinds; quantifiers that never need to
# give back are possessive, so that long runs take linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1)
        if m and start < at:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by rule, by kind as listed and start; places in code
    points, leftmost and without overlap in a kind. A match that fails the rule for
    its numbers is dropped, and search goes on behind it."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not HINT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for kind, pattern, low, high in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def labelled(n: int, seed: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Training texts with spans, written by rule: each kind, also phone numbers
    without a country code, and numbers that are none of them."""
    r = np.random.default_rng(seed)
    letters = np.array(list("etaoinshrdlucmfwygpbvkéäñçß"))
    pick = lambda *x: x[r.integers(len(x))]
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))

    def word() -> str:
        w = "".join(r.choice(letters, r.integers(1, 9)))
        return pick(w, w, w, w.capitalize(), w.upper())

    def name() -> str:
        return "".join(r.choice(letters[:22], r.integers(2, 8)))

    def card() -> str:
        d = digits(r.integers(12, 19))
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        return pick(d, d, pick(" ", "-").join(d[i : i + 4] for i in range(0, len(d), 4)))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        code = pick("1", "44", "49", "33", digits(2))
        return pick(f"+{code} ({a}) {b}-{c}", f"+{code} ({a}) {b}-{c}", f"+{code} {a} {b} {c}", f"+{code}{a}{b}{c}", f"+{code}-{a}-{b}-{c}", f"({a}) {b}-{c}")

    make = {
        "email": lambda: f"{pick(name(), name() + pick('.', '_', '-') + name(), name() + digits(2), name() + '.' + digits(2))}@"
        + f"{pick(name(), 'mail' + digits(1), name() + '-' + name())}.{pick('', name() + '.')}{pick('com', 'org', 'net', 'example.com', 'de', 'co.uk')}",
        "ip": lambda: ".".join(str(x) for x in r.integers(0, 256, 4)),
        "card": card,
        "phone": phone,
    }
    other = (
        lambda: digits(r.integers(1, 11)), lambda: f"{digits(2)}.{digits(2)}.{r.integers(1900, 2100)}", lambda: f"{r.integers(1900, 2100)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(3)}.{digits(2)} {pick('USD', 'EUR')}", lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"@{name()}", lambda: f"{name()}@{name()}", lambda: f"{name()}{digits(3)}", lambda: f"+{digits(2)}%", lambda: f"{digits(1)},{digits(3)}",
    )
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.integers(4, 14)):
            x = r.random()
            if x < 0.3:
                kind = KINDS[r.integers(len(KINDS))]
                value = make[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = other[r.integers(len(other))]() if x < 0.45 else word()
            text += value + pick(" ", " ", " ", ", ", ". ", ".\n", "!! ", "%%% ", " | ")
        yield text, spans


def runs(text: str) -> list[tuple[int, int]]:
    """Stretches of the text within ``AROUND`` characters of a digit or an @ sign."""
    out: list[list[int]] = []
    for m in HINT.finditer(text):
        low, high = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def windows(low: int, high: int) -> list[tuple[int, int]]:
    """Overlapping windows over a run."""
    starts = range(low, max(low + 1, high - LENGTH + STEP), STEP)
    return [(at, min(high, at + LENGTH)) for at in starts]


def _matrix(text_classes: np.ndarray, cut: list[tuple[int, int]]) -> np.ndarray:
    ids = np.zeros((len(cut), LENGTH), np.int64)
    for i, (a, b) in enumerate(cut):
        ids[i, : b - a] = text_classes[a:b]
    return ids


@cache
def model(rows: int = 700, passes: int = 8) -> Tagger:
    """The tagger fitted on ``rows`` labelled texts; once in a process."""
    ids, tags = [], []
    for text, spans in labelled(rows, 11):
        own = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            own[a], own[a + 1 : b] = k, k + 1
        cut = [w for run in runs(text) for w in windows(*run)]
        ids.append(_matrix(classes(text), cut))
        tags.append(_matrix(own, cut))
    tagger = Tagger()
    tagger.fit(np.concatenate(ids), np.concatenate(tags), passes)
    return tagger


def _fragments(tags: np.ndarray, sure: np.ndarray, low: int, high: int, size: int) -> Iterator[tuple]:
    """(kind, start, end, least probability, cut before, cut behind) of one window over
    [low, high) of a text of ``size`` characters; the window's edges cut, the text's do not."""
    n = high - low
    at = 0
    while at < n:
        tag = tags[at]
        end = at + 1
        if tag:
            inner = tag + tag % 2
            while end < n and tags[end] == inner:
                end += 1
            k = (tag - 1) // 2
            least = float(sure[at:end, 1 + 2 * k : 3 + 2 * k].sum(axis=1).min())
            yield KINDS[k], low + at, low + end, least, at == 0 and low > 0, end == n and high < size
        at = end


def stitched(fragments: list[tuple]) -> list[tuple]:
    """The fragments of one run, those of a kind that go on where a window cuts them made one.

    A fragment that its neighbour window shows whole, or not at all, stays cut.
    """
    out: list[tuple] = []
    for kind, a, b, p, before, behind in sorted(fragments, key=lambda f: (KINDS.index(f[0]), f[1], f[2])):
        last = out[-1] if out else None
        if last and last[0] == kind and last[5] and before and a <= last[2]:
            out[-1] = (kind, last[1], max(b, last[2]), min(p, last[3]), last[4], behind)
        else:
            out.append((kind, a, b, p, before, behind))
    return out


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, least probability) of what the tagger finds in each text.

    A span that reaches the outer edge of its run makes the run twice as long on that side, and it is
    decoded again, until the span ends inside. A card must have the digits of one.
    """
    found: list[list] = [[] for _ in texts]
    coded = [classes(t) for t in texts]
    todo = [(i, low, high) for i, t in enumerate(texts) for low, high in runs(t)]
    while todo:
        asked = [(r, *w) for r, (_, low, high) in enumerate(todo) for w in windows(low, high)]
        parts: list[list] = [[] for _ in todo]
        for at in range(0, len(asked), BATCH):
            some = asked[at : at + BATCH]
            ids = np.concatenate([_matrix(coded[todo[r][0]], [(a, b)]) for r, a, b in some])
            e = tagger.emissions(ids)
            tags = tagger.decode(e)
            hits = np.flatnonzero(tags.any(axis=1))
            sure = tagger.marginals(e[hits])[1] if len(hits) else None
            for j, k in enumerate(hits):
                r, a, b = some[k]
                parts[r] += _fragments(tags[k], sure[j], a, b, len(texts[todo[r][0]]))
        again = []
        for (i, low, high), own in zip(todo, parts):
            spans = stitched(own)
            before = any(f[4] and f[1] == low for f in spans)
            behind = any(f[5] and f[2] == high for f in spans)
            if before or behind:
                more = high - low
                again.append((i, max(0, low - more) if before else low, min(len(texts[i]), high + more) if behind else high))
            else:
                found[i] += [f[:4] for f in spans if not (f[4] or f[5]) and (f[0] != "card" or _card(texts[i][f[1] : f[2]]))]
        todo = again
    return found


def _card(span: str) -> bool:
    digits = re.sub(r"[^0-9]", "", span)
    return 13 <= len(digits) <= 19 and luhn(digits)


def reconcile(found: list[tuple[str, int, int, float]], fixed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans to add to the fixed ones: none touches a fixed one or another;
    the surest first, then the longest, then the first."""
    taken = [(a, b) for _, a, b in fixed]
    out = []
    for kind, a, b, p in sorted(set(found), key=lambda s: (-round(s[3], 6), s[1] - s[2], s[1], s[0])):
        if p >= SURE and all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
SPANS = "array<struct<kind:string,start:bigint,end:bigint,added:boolean>>"


def _tag(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            fixed = [patterns(t) for t in texts]
            found = tagged(tagger, texts)
            rows = []
            for own, more in zip(fixed, found):
                every = [(*s, False) for s in own] + [(*s, True) for s in reconcile(more, own)]
                every.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                rows.append([dict(zip(("kind", "start", "end", "added"), s)) for s in every])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("text"), pa.array(rows, _TYPE)], ["_row", "text", "spans"])

    return run


def personal_data(docs: DataFrame, *, fit_rows: int = 700) -> DataFrame:
    """The rows packed as ``_row`` and text, with ``spans``: kind, start, end and whether
    the tagger added it, by kind and start.

    Null and empty texts have no spans; very long ones are cut into windows around digits and @ signs,
    and a span may be longer than a window. Base spans of several kinds may overlap; added ones
    overlap nothing. Repeated rows are tagged each; an empty table gives no rows; other
    columns pass through in the struct.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model(fit_rows))
    rows = packed(docs)
    return rows.mapInArrow(_tag(shared), with_fields(rows, f"spans {SPANS}"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; where spans overlap, the first by
    start, then the longest, names them and all their characters go."""
    ordered = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["end"] - x["end"]).cast("int"))
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        name = F.when(s["start"] >= acc["at"], F.concat(before, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["done"], name).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, empty, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))).otherwise(text)
