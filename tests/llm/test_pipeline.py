"""The stages against plain Python on a small corpus, each on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from claimspark.llm import quality
from claimspark.llm.queries import tokenizer_path
from claimspark.session import materialise
from tests.llm import test_line_dedup, test_ngram_join
from tests.llm.data import awkward, documents, prose

tokenizers = pytest.importorskip("tokenizers")


def test_stages(spark, tmp_path):
    texts = [(i, t, s) for i, t, s in awkward()] + [(100 + i, prose(i, 50), "a") for i in range(60)]
    texts += [(200 + i, prose(i, 50).upper().replace(" ", "!! "), "b") for i in range(40)]
    folder = str(tmp_path)
    documents(spark, texts, extra=False).write.parquet(f"{folder}/documents.parquet")
    known = [(i, int(not 200 <= (i or 0) < 240), 0) for i, _, _ in texts]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")) if n == 0 else None
        docs = materialise(stage(spark, docs, folder), f"stage-{n}")
        rows = docs.collect()
        if n < 4:
            assert docs.columns == columns
            assert all(r["n_chars"] in (None, len(r["text"] or "")) or n == 0 for r in rows)
        if n == 0:
            scorer = quality.WordScorer(model[0].astype(np.float32).astype(np.float64), model[1])
            taken = [(i, t) for (i, t, _), s in zip(before, scorer.scores([(t or "").encode() for _, t, _ in before])) if s >= 0.3]
            want = {i for i, _ in taken}
            assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(taken, key=str)
            assert set(range(100, 160)) <= want and len(want & set(range(200, 240))) < 4 and None in want
        if n == 1:
            assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(((i, t) for i, t, _, _ in test_line_dedup.expected(before)), key=str)
        if n == 2:
            assert sorted((r["doc_id"] for r in rows), key=str) == sorted(test_ngram_join.kept_ids(before), key=str)
        if n == 3:
            whole, words = {i: t.split() for i, t, _ in before}, sum(len(t.split()) for _, t, _ in before)
            for r in rows:
                rest = iter(whole[r["doc_id"]])
                assert all(w in rest for w in r["text"].split())
            assert abs(sum(len(r["text"].split()) for r in rows) - words) <= 0.2 * words + 200
        if n == 4:
            tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
            assert sorted(((r["doc_id"], list(r["ids"])) for r in rows), key=str) == sorted(((i, tokenizer.encode(t, add_special_tokens=False).ids) for i, t, _ in before), key=str)
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
