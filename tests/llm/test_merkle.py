import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from verdikt.llm import merkle, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc, text):
    doc_id, _, lang, source, n_chars = doc
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """The top of a plain tree, and each leaf's siblings level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            first = p // 16 * 16
            ways[k].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + 16])))
            at[k] = p // 16
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], ways


def brute(docs):
    groups = defaultdict(list)
    for doc in docs:
        groups[doc[3]].append(doc)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for source in order:
        groups[source].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        tops[source] = climb([leaf(d, d[1]) for d in groups[source]])
    root, over = climb([tops[s][0] for s in order]) if order else (None, [])
    out = []
    for k, source in enumerate(order):
        subroot, ways = tops[source]
        for doc, way in zip(groups[source], ways, strict=True):
            doc_id, text = doc[0], doc[1]
            touched = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            value = leaf(doc, text.translate(LOWER) if touched else text)
            for left, right in way + over[k]:
                value = h(left + value + right)
            proof = h("".join(a + b for a, b in way + over[k]))
            out.append((doc_id, leaf(doc, text), subroot, root, proof, value, value == root))
    return Counter(out)


def got(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r[c] for c in names) for r in df.select(*names).collect())


def run(spark, tmp_path, docs, columns=COLUMNS):
    spark.createDataFrame(docs, columns).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op12_merkle_manifest(spark, str(tmp_path))


def test_groups_of_all_heights(spark, tmp_path):
    """One leaf, a full run, one more, and a hot source of more than a block."""
    docs, key = [], 0
    for source, n in ((None, 3), ("", 1), ("a", 16), ("b", 17), ("ä", 257), ("hot", 4113)):
        for _ in range(n):
            docs.append((key, f"Text {key}" if key % 3 else f"text {key}", "en", source, key))
            key += 1
    docs += [(key + k, "X", None, f"s{k}", None) for k in range(20)]
    random.Random(3).shuffle(docs)
    found = got(run(spark, tmp_path, docs))
    assert found == brute(docs)
    assert {row[-1] for row in found} == {True, False}


def test_odd_rows(spark, tmp_path):
    docs = [(1, None, None, None, None), (1, None, None, None, None), (1, "", "en", "a", 0), (2, "Ä b|C", "en", "a", 3)]
    docs += [(None, "No id", "en", "a", 5), (None, "no id", "en", "a", 5), (5, "LONG " * 50_000, "en", "a", 9), (5, "x", "en", "a", 9)]
    found = run(spark, tmp_path, [(*d, 7, "y", 1) for d in docs], COLUMNS + ", part int, digest string, place long")
    assert got(found) == brute(docs)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []).count() == 0


def test_a_version_shares_what_it_does_not_change():
    leaves = [merkle.digest(str(k).encode()) for k in range(300)]
    nodes = merkle.Nodes(leaves, merkle.height(300))
    before = len(nodes.digests)
    changed = merkle.digest(b"x")
    version = nodes.replaced(nodes.root, 37, changed)
    assert len(nodes.digests) == before + 1 + nodes.levels
    assert nodes.digests[version] == merkle.Nodes([*leaves[:37], changed, *leaves[38:]], 3).digests[-1]
    second = nodes.replaced(version, 299, changed)
    assert nodes.siblings(second, 37)[0] == nodes.siblings(nodes.root, 37)[0]
    # The first version still stands.
    assert merkle.folded(leaves[37], nodes.siblings(nodes.root, 37)) == nodes.digests[nodes.root]


@pytest.mark.parametrize("n, levels", [(1, 0), (2, 1), (16, 1), (17, 2), (256, 2), (257, 3), (4097, 4)])
def test_height(n, levels):
    assert merkle.height(n) == levels


def test_only_digests_are_dealt(spark, sf_dir):
    """No exchange of the plan up to the leaves carries texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = merkle.tree(docs, ["doc_id", "text"], "source", "doc_id", {"text": F.lower("text")}, F.lit(True))
    assert set(leaves.rows.columns) == {"id", "digest", "changed", "part", "place", "n", "block"}
    assert "text" not in leaves.blocks.columns
