import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm.mixing import mix, mix_slots, mixed_documents, permuted
from tests.llm.data import awkward, documents, prose


def shared_targets(sizes: dict, most: int = 3) -> dict:
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def many(n=400):
    return [(i, prose(i, 20 + i % 90), "hot" if i % 3 == 0 else f"s{i % 11}" if i % 11 else None) for i in range(n)]


@pytest.mark.parametrize("texts", [many(), awkward(), [(1, "a b c", "x"), (2, prose(1, 3000), "y"), (3, "", "z")]])
def test_targets_takes_and_reruns(spark, texts):
    docs = documents(spark, texts)
    rows = mix(docs, block_words=8, shard_slots=512).collect()
    sizes, taken = {}, {}
    for i, t, s in texts:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = shared_targets(sizes)
    source = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for i, t, s in texts}
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((i or -1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in texts)
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.05 * want[s] + 40
    again = mix(docs.repartition(7), block_words=8, shard_slots=512).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_documents_hold_what_is_taken(spark):
    texts = many(120) + [(900, "a  b\n c", "hot"), (901, None, "hot"), (902, "", None)]
    docs = documents(spark, texts)
    counts = {r["doc_id"]: r["taken"] for r in mix(docs, block_words=8, shard_slots=512).collect()}
    mixed = mixed_documents(docs, block_words=8, shard_slots=512)
    assert mixed.columns == docs.columns
    found, whole = {}, {i: t for i, t, _ in texts}
    for r in mixed.collect():
        words = r["text"].split()
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + len(words)
        own = iter(whole[r["doc_id"]].split())
        assert all(w in own for w in words)  # in order
    assert {i: n for i, n in counts.items() if n} == found


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))
    image = [r["p"] for r in spark.range(100).select(permuted(F.col("id"), F.lit(100).cast("long"), F.lit(3)).alias("p"), "id").orderBy("id").collect()]
    assert abs(np.corrcoef(image, range(100))[0, 1]) < 0.4


def test_empty_table(spark):
    docs = documents(spark, [])
    assert mix(docs).count() == 0 and mixed_documents(docs).count() == 0
    assert [r["taken"] for r in mix(documents(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


@pytest.mark.parametrize("words", [10, 50, 130, 300, 1000])
def test_small_sources_beside_a_hot_one(spark, words):
    """Production parameters: sources held at three times their size are taken whole, others come close to the target."""
    texts = [(i, prose(i % 50, 1000), "hot") for i in range(600)] + [(1000 + i, prose(i, words), f"tail{i:02}") for i in range(20)]
    rows = mix(documents(spark, texts, extra=False)).collect()
    assert {r["taken"] for r in rows if r["doc_id"] >= 1000} == {3 * words} == {round(r["target"]) for r in rows if r["doc_id"] >= 1000}
    hot = [r for r in rows if r["doc_id"] < 1000]
    assert sum(r["taken"] for r in hot) == pytest.approx(hot[0]["target"], rel=0.001)
    even = [(i, prose(i, words), f"s{i}") for i in range(6)]
    for r in mix(documents(spark, even, extra=False)).collect():
        assert r["taken"] == pytest.approx(r["target"], abs=2 * (words // 16 + 1))


def test_slots_of_shards_and_sources(spark):
    """Every shard but the last is full and every source has its slots, however many shards there are."""
    sizes = {"a": 10, "b": 130, "c": 5000, "d": 400_000}
    want = shared_targets(sizes)
    targets = spark.createDataFrame([(k, k, n, float(sum(sizes.values())), want[k]) for k, n in sizes.items()], "key string, source string, source_size long, total double, target double")
    slots = mix_slots(targets, 1, 128, 64, 3).collect()
    shards, keys = {}, {}
    for r in slots:
        shards[r["shard"]] = shards.get(r["shard"], 0) + 1
        keys.setdefault(r["key"], []).append(r["k"])
    assert {shards[i] for i in range(len(shards) - 1)} == {64} and 0 < shards[len(shards) - 1] <= 64
    assert all(sorted(k) == list(range(len(k))) for k in keys.values())
    assert len(keys["a"]) == 30 and len(keys["b"]) == 3 * 15
    assert len({r["shard"] for r in slots if r["key"] == "b"}) > 20  # not in one place
