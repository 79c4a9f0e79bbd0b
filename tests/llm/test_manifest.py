import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from shopwake.llm import manifests, merkle
from shopwake.llm.merkle import merkle_manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, total int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def by_hand(rows, fan=3):
    """All columns by walking whole trees level by level."""
    sources = defaultdict(list)
    for r in rows:
        text = r[4]
        if text is not None and r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, text), r[0]))

    def climb(nodes):
        """Root, and per node its (left, right) siblings level by level."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, i in zip(ways, at):
                run = i - i % fan
                way.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fan])))
            nodes = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
            at = [i // fan for i in at]
        return nodes[0], ways

    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, _, own, found, doc), way in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1]):
            proof, node = "", found
            for left, right in way + top:
                proof, node = proof + left + right, H(left, node, right)
            out.append((doc, own, trees[s][0], root, H(proof), node, node == root))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


def found(spark, rows, **options):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return Counter(tuple(r) for r in merkle_manifest(frame(spark, rows), {"text": text}, **options).collect())


def some_rows(seed, n):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        source = pick.choice(["hot", "hot", None, "", "ä", "b", f"only-{i}", "Z"])
        rows.append((pick.choice([i, i // 2, -i, None, 2**60 + i]), source, pick.choice(["en", None]), pick.choice([None, i]), pick.choice([None, "", "a\nb", "ü\n", f"text {i}"])))
    return rows


@pytest.mark.parametrize("block", [3, 9, 729])
def test_manifest_by_hand(spark, block):
    rows = some_rows(block, 150) + [(5, "hot", "en", 1, "same\nrow")] * 40 + [(7, "b", "en", 1, "word \n" * 50_000)]
    assert found(spark, rows, block=block) == by_hand(rows)


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 7)
    rows = some_rows(4, 90)
    assert found(spark, rows, block=9) == by_hand(rows)


def test_one_source_one_leaf_and_nothing(spark):
    for rows in ([(1, None, None, None, None)], [(1, "a", "en", 2, "x\n")], [(i, "a", "en", 2, "x") for i in range(10)]):
        assert found(spark, rows) == by_hand(rows)
    assert merkle_manifest(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        merkle_manifest(frame(spark, []), block=10)


def test_nothing_received_is_all_verified(spark):
    rows = some_rows(6, 30)
    got = merkle_manifest(frame(spark, rows)).collect()
    assert len(got) == 30 and all(r.verified and r.folded_root == r.root for r in got)


def test_query_tampers_line_breaks(spark):
    rows = [(i, "a", "en", 1, "one\ntwo") for i in range(40)]
    got = Counter(tuple(r) for r in manifests._manifest(frame(spark, rows), spark, None).collect())
    assert got == by_hand(rows) and 0 < sum(r[-1] for r in got) < 40
