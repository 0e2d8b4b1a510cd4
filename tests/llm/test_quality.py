import zlib

import numpy as np
from pyspark.sql import functions as F

from claimspark.llm import quality as q
from tests.llm.data import awkward, documents, prose


def corpus(n=300):
    texts = []
    for i in range(n):
        text = prose(i, 60)
        texts.append((i, text.upper().replace(" ", "!! ") if i % 4 == 0 else " ".join(w for w in text.split() for _ in range(3)) if i % 4 == 1 else text, "a"))
    return texts


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_held_out_documents_are_told_apart(spark):
    texts = corpus()
    docs = documents(spark, texts)
    known = labels(spark, [(i, int(i % 4 > 1), 0, "t") for i, _, _ in texts] + [(None, 1, 0, "t"), (3, None, 0, "t"), (4, 7, 0, "t"), (9999, 0, 0, "t")])
    rows = q.score(docs, q.fit(docs, known)).withColumn("held", q.held_out(F.col("doc_id"))).collect()
    assert len(rows) == len(texts) and "text" not in rows[0].asDict() and rows[0]["norm"] == "x"
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 1) for r in held]) > 0.95


def test_labels_of_held_out_documents_do_not_matter(spark):
    texts = corpus(80)
    docs = documents(spark, texts)
    one = [(i, int(i % 4 > 1), 0, "t") for i, _, _ in texts]
    other = [(i, v if zlib.crc32(str(i).encode()) % 5 else 1 - v, 1, "t") for i, v, _, _ in one]
    (a, b), (c, d) = q.fit(docs, labels(spark, one)), q.fit(docs, labels(spark, other))
    assert (a == c).all() and b == d


def test_awkward_tables(spark):
    docs = documents(spark, awkward())
    none = labels(spark, [])
    assert {r["score"] for r in q.score(docs, q.fit(docs, none)).collect()} == {0.5}
    assert q.fit(docs, labels(spark, [(i, 1, 0, "t") for i in (3, 5, 9, 12, 20, 24)]))[1] > 5
    assert q.score(documents(spark, []), q.fit(docs, none)).count() == 0
    both = q.fit(docs, labels(spark, [(i, i % 2, 0, "t") for i, _, _ in awkward() if i]))
    rows = q.score(docs, both, keep_text=True).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["text"] for r in rows} == {t for _, t, _ in awkward()}


def test_kept_texts_are_sent_to_the_scorer_once_and_come_back_in_slices(spark, monkeypatch):
    monkeypatch.setattr(q, "SLICE_BYTES", 50)
    docs, model = documents(spark, awkward()), (np.random.default_rng(2).normal(size=1 << 10), 0.1)
    kept = q.score(docs, model, keep_text=True)
    assert "score text" not in kept._jdf.queryExecution().analyzed().toString()
    plain = q.score(docs, model)
    assert sorted(map(repr, kept.drop("text").collect())) == sorted(map(repr, plain.select(*kept.drop("text").columns).collect()))
    assert sorted(map(repr, kept.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def test_scores_follow_from_features_whatever_is_kept(monkeypatch):
    draw = np.random.default_rng(0)
    values = draw.normal(size=1 << 10)
    texts = [t.encode() for _, t, _ in corpus(12)] + [b"", b" \n", b"a", "é é x".encode()]

    def plain(text):
        words = text.split()
        total = [values[0]] * sum(a == b for a, b in zip(words, words[1:]))
        for w in words:
            total += list(values[q.word_features([w], len(values))[0]])
        return 1 / (1 + np.exp(-(sum(total) / len(total) if total else 0.0) - 0.3))

    for kept in (1 << 20, 5):
        monkeypatch.setattr(q, "KEPT_WORDS", kept)
        scorer = q.WordScorer(values, 0.3)
        got = np.concatenate([scorer.scores(texts[:5]), scorer.scores(texts[5:])])
        assert np.allclose(got, [plain(t) for t in texts])
    assert len(q.word_features([b"abc"])[0]) == 1 + 3 + 2 + 1
    assert len(q.word_features(["日本語".encode()])[0]) == 1 + 3 + 2 + 1  # characters, not bytes


def test_labels_whose_documents_are_all_long(spark):
    """They are learned from whole; where none fits, the caller is told."""
    import pytest

    texts = [(i, " ".join(prose(i * 90 + j, 60).upper() for j in range(180)) if i % 2 else prose(i, 60), "a") for i in range(24)]
    assert all(len(t) > q.SAMPLE_BYTES for i, t, _ in texts if i % 2)
    docs, known = documents(spark, texts), labels(spark, [(i, 1 - i % 2, 0, "t") for i in range(24)])
    rows = q.score(docs, q.fit(docs, known)).collect()
    assert min(r["score"] for r in rows if r["doc_id"] % 2 == 0) > max(r["score"] for r in rows if r["doc_id"] % 2)
    with pytest.raises(ValueError, match="Both labels exist"):
        q.fit(docs, known, per_label=1)
