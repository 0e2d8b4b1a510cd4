import random
import zlib

import xxhash
from pyspark.sql import functions as F

from claimspark.llm.sharding import NODES, SHARDS, SLACK, shard
from tests.llm.data import awkward, documents, prose


def hash_of(text):
    n = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return n - (1 << 64) if n >> 63 else n


def plain(texts, shards=SHARDS, nodes=NODES, slack=SLACK):
    """Shards of rows with distinct ids, row by row."""
    points = sorted((hash_of(f"point:{s}:{i}"), s) for s in range(shards) for i in range(nodes))
    rows = []
    for doc, text, _ in texts:
        size, draw = len((text or "").encode()) + 1, hash_of(str(doc))
        position = hash_of(text or "")
        at = next((i for i, p in enumerate(points) if p[0] >= position), 0)
        rows.append(((64 - size.bit_length(), (draw % (1 << 64)) >> 52, draw), size, at, doc, zlib.crc32((text or "").encode())))
    bound = sum(r[1] for r in rows) * (1 + slack) / shards
    load, full, out, waiting = [0] * shards, set(), {}, rows
    while waiting:
        arrivals = {}
        for row in waiting:
            at = row[2]
            while points[at][1] in full:
                at = (at + 1) % len(points)
            arrivals.setdefault(points[at][1], []).append(row)
        waiting = []
        for s, own in arrivals.items():
            for row in sorted(own):
                if load[s] >= bound:
                    waiting.append(row)
                else:
                    load[s] += row[1]
                    out[row[3]] = s, row
            if load[s] >= bound:
                full.add(s)
    slots = {s: sorted((r, d) for d, (t, r) in out.items() if t == s) for s in range(shards)}
    places = {d: (s, i) for s, own in slots.items() for i, (_, d) in enumerate(own)}
    return sorted((d, r[1], r[4], "bytes", *places[d], None) for d, (_, r) in out.items())


def hot(n=400):
    """A third of the rows are copies; some rows are long."""
    draw = random.Random(5)
    copy = prose(1, 40)
    return [(i, copy if i % 3 == 0 else prose(1000 + i, draw.choice([3, 20, 60, 400])), "a") for i in range(n)] + [(n, None, "a"), (n + 1, "", None)]


def test_against_rows_one_by_one(spark):
    for texts, shards in ((hot(), 8), (hot(), 3), (hot(5), 8)):
        assert sorted(tuple(r) for r in shard(documents(spark, texts), shards=shards).collect()) == plain(texts, shards)


def test_sizes_are_near_equal_and_slots_have_no_gaps(spark):
    rows = shard(documents(spark, hot(1500))).collect()
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_another_shard_moves_little(spark):
    texts = [(i, prose(i, 30), "a") for i in range(1200)]
    before, after = ({r.doc_id: r.shard for r in shard(documents(spark, texts, extra=False), shards=n).collect()} for n in (8, 9))
    assert sum(before[d] != after[d] for d in before) < 0.3 * len(texts)


def test_awkward_rows(spark):
    """NULL ids, repeated rows, empty and NULL texts: every row once, same sizes and checksums."""
    texts = awkward() + [(None, "same", "a")] * 300
    got = shard(documents(spark, texts)).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in texts)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shard(documents(spark, [])).count() == 0


def test_one_row_larger_than_a_shard(spark):
    texts = [(0, "x" * 5000, "a"), *((i, f"t{i}", "a") for i in range(1, 50))]
    rows = shard(documents(spark, texts)).collect()
    assert len(rows) == 50
    own = next(r.shard for r in rows if r.doc_id == 0)
    assert [r.doc_id for r in rows if r.shard == own] == [0]


def test_equal_texts_stay_together(spark):
    texts = [(i, prose(i % 300, 12), "a") for i in range(900)]
    rows = shard(documents(spark, texts, extra=False))
    split = rows.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count()
    assert split < 60
