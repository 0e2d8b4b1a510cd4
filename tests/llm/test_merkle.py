import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from claimspark.llm.merkle import merkle_manifest, verified_manifest
from tests.llm.data import awkward, documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc, text, source):
    values = [None if doc is None else str(doc), source, "en", None if text is None else str(len(text)), text]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def grow(nodes, arity=3):
    """Root of a list of digests and for each the siblings left and right of it, from below."""
    own, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(own):
            run = at - at % arity
            steps[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + arity])))
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        own = [at // arity for at in own]
    return nodes[0], steps


def expected(texts):
    groups = {}
    for doc, text, source in texts:
        groups.setdefault(source, []).append((doc, leaf_of(doc, text, source), text))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        grown[source] = grow([r[1] for r in groups[source]])
    root, top = grow([grown[s][0] for s in order])
    out = []
    for k, source in enumerate(order):
        subroot, steps = grown[source]
        for (doc, leaf, text), own in zip(groups[source], steps):
            path = own + top[k]
            got = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and text:
                values = [str(doc), source, "en", str(len(text)), text.replace("\n", "")]
                got = sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))
            for before, after in path:
                got = sha(before + got + after)
            out.append((doc, leaf, subroot, root, sha("".join(b + a for b, a in path)), got, got == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.drop("steps").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def many():
    return [(i, f"text {i}\nline" if i % 3 else f"text {i}", f"s{i % 2 if i > 70 else i % 5}") for i in range(200)]


@pytest.mark.parametrize("texts", [awkward(), many(), [(3, "only\n", None)], [(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (2, None, "y")], []])
def test_against_trees_in_memory(spark, texts):
    got = result(verified_manifest(documents(spark, texts)))
    assert got == (expected(texts) if texts else [])
    if len(texts) > 100:
        assert {r[6] for r in got} == {True, False} and len({r[3] for r in got}) == 1


@pytest.mark.parametrize("arity", [2, 4])
def test_other_arities(spark, arity):
    rows = [(i, sha(str(i))) for i in range(23)]
    leaves = spark.createDataFrame(rows, "doc_id long, digest_text string").select("doc_id", F.lit("g").alias("source"), F.unhex("digest_text").alias("leaf"))
    root, steps = grow([d for _, d in rows], arity)
    got = {r.doc_id: r for r in merkle_manifest(leaves, arity=arity).collect()}
    for i, own in enumerate(steps):
        assert got[i].root == root and [(bytes(s.before).hex(), bytes(s.after).hex()) for s in got[i].steps] == own


def test_rows_move_the_root(spark):
    texts = many()
    changed = [(d, t + "." if d == 150 else t, s) for d, t, s in texts]
    one, two = ({r.doc_id: r for r in verified_manifest(documents(spark, x)).collect()} for x in (texts, changed))
    assert one[0].root != two[0].root
    assert [d for d in one if one[d].leaf != two[d].leaf] == [150]
    assert {s for d, _, s in texts if one[d].subroot != two[d].subroot} == {"s0"}
