import random
import re

import numpy as np
import pytest

from claimspark.llm import ngram_join as nj
from claimspark.llm.components import connected_components
from tests.llm.data import awkward, documents, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def expected(texts, percent=80):
    sets = [shingles(t) for _, t, _ in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (doc, _, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if group[j] == group[i] and texts[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def kept_ids(texts):
    """Ids of the rows that stay, each row a document of its own."""
    groups = {}
    for row, _, component in expected([(k, t, s) for k, (_, t, s) in enumerate(texts)]):
        groups.setdefault(component, []).append(row)
    best = [min(own, key=lambda k: (texts[k][0] is None, texts[k][0] or 0, k)) for own in groups.values()]
    return [texts[k][0] for k in best]


def edited(seed, text, share):
    draw = random.Random(seed)
    return " ".join(w if draw.random() > share else f"w{draw.randint(0, 9999)}" for w in text.split(" "))


def test_against_all_pairs(spark):
    texts = awkward() + [(100 + i, edited(i, prose(7 + i % 4, 150), 0.002 + 0.03 * (i % 5) / 5), "a") for i in range(60)]
    texts += [(300 + i, prose(50, 12 + i) + " same last words " * (i % 2), "b") for i in range(12)]
    got = sorted((tuple(r) for r in nj.ngram_join(documents(spark, texts), block_bytes=3000, part_sets=10).collect()), key=str)
    assert got == expected(texts)
    assert sorted((r["doc_id"] for r in nj.one_of_each(documents(spark, texts)).collect()), key=str) == sorted(kept_ids(texts), key=str)


def test_one_row_of_each_component_stays(spark):
    """Rows that share an id or have none are judged by their text."""
    a, b, c, d, e = (prose(70 + i, 40) for i in range(5))
    texts = [(1, a, "x"), (5, b, "x"), (5, a, "x"), (7, c, "x"), (7, c, "x"), (None, d, "x"), (None, d, "x"), (None, e, "x"), (9, e, "x"), (3, None, "x"), (3, None, "x"), (4, "", "x")]
    docs = documents(spark, texts)
    got = nj.one_of_each(docs)
    assert got.columns == docs.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert rows == sorted([(1, a), (5, b), (7, c), (None, d), (9, e), (3, None), (3, None), (4, "")], key=str)


def test_empty_table(spark):
    assert nj.ngram_join(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_every_link(seed):
    draw = random.Random(seed)
    base = [draw.sample(range(400), draw.randint(5, 60)) for _ in range(4)]
    sets = []
    for _ in range(60):
        s = set(draw.choice(base)[: draw.randint(1, 60)]) ^ set(draw.sample(range(400), draw.randint(0, 4)))
        sets.append(np.array(sorted(s), np.uint64) if s else np.array([1], np.uint64))
    sets = list({s.tobytes(): s for s in sets}.values())
    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        label = list(range(len(sets)))
        for x, y in nj.trie_links(sets, side, 60):
            a, b = set(sets[x].tolist()), set(sets[y].tolist())
            assert 100 * len(a & b) >= 60 * len(a | b)
            label = [label[y] if v == label[x] else v for v in label]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                a_, b_ = set(a.tolist()), set(b.tolist())
                if 100 * len(a_ & b_) >= 60 * len(a_ | b_) and (not side.any() or side[i] != side[j]):
                    assert label[i] == label[j]


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
