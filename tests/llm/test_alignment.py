import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.llm.alignment import DOC_BITS, add_postings, align, alignment_index, pack_planes, pair_counts
from claimspark.llm.queries import tokenizer_path
from tests.llm.data import awkward, documents, prose

FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(FILES[0]))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(FILES[1]))


def spans(pieces):
    end, out = 0, []
    for raw in pieces:
        out.append((end, end + len(raw)))
        end += len(raw)
    return out


def plain(coders, texts):
    """Every text for itself, every pair of tokens compared, by the tokenizers' own libraries."""
    a, b = coders
    letters = {}
    spare = 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            letters[chr(x)] = x
        else:
            letters[chr(spare)] = x
            spare += 1
    rows, counts = [], Counter()
    for doc, text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if text and not b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode():
            ids_a, ids_b, raw_a, raw_b = [], [], [], []
        at_a, at_b = spans(raw_a), spans(raw_b)
        links = [(ids_a[i], ids_b[j]) for i, x in enumerate(at_a) for j, y in enumerate(at_b) if x[0] < y[1] and y[0] < x[1]]
        both = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, begin = [], 0
        for end in both:
            parts = [",".join(str(i) for i, (s, e) in zip(ids, at) if begin <= s and e <= end) for ids, at in ((ids_a, at_a), (ids_b, at_b))]
            groups.append("|".join(parts))
            begin = end
        rows.append((doc, len(ids_a), len(ids_b), len(both), links, ";".join(groups)))
        counts.update(set(links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (doc, n_a, n_b, n_groups, len(links), groups, sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links))
        for doc, n_a, n_b, n_groups, links, groups in rows
    ], counts


def test_against_all_pairs(spark, coders):
    texts = [(i, t) for i, t, _ in awkward()] + [
        (60, "a▁b"), (61, "naïve 日本語 text 🙂"), (62, "<s> [INST] <unk> </s> <|endoftext|>"), (63, "\u0000 nul"), (64, " lead"), (65, "the the the"), (66, "<0x41>"),
    ]
    docs = documents(spark, [(i, t, "a") for i, t in texts])
    got = [tuple(r) for r in align(docs, *map(tokenizer_path, FILES)).collect()]
    expected, counts = plain(coders, texts)
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert any(row[1] == 0 for row in got if row[0] == 60)
    pairs = {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.documents for r in pair_counts(alignment_index(docs, *map(tokenizer_path, FILES))).collect()}
    assert pairs == dict(counts)


def test_blocks_of_every_size(spark, coders, monkeypatch):
    """Containers closed after a few documents give the counts of one container."""
    texts = [(i, prose(i % 7, 30 + i % 5)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    expected = sorted(plain(coders, texts)[0])
    monkeypatch.setattr("claimspark.llm.alignment.KEPT_ENTRIES", 100)
    monkeypatch.setattr("claimspark.llm.alignment.SLICE_BYTES", 300)
    assert sorted(tuple(r) for r in align(docs, *map(tokenizer_path, FILES)).collect()) == expected


def test_planes_hold_lists_and_bits():
    draw = random.Random(3)
    held = {(pair, doc): draw.choice([1, 1, 1, 2, 3, 900]) for pair, n in ((5, 4000), (9, 1), (7 << 20 | 3, 256), (7 << 20 | 4, 257)) for doc in draw.sample(range(1 << DOC_BITS), n)}
    keys = np.array(sorted(pair << DOC_BITS | doc for pair, doc in held), np.int64)
    rows = pack_planes(keys, np.array([held[int(k) >> DOC_BITS, int(k) & 4095] for k in keys], np.int64))
    packed = pa.Table.from_batches([rows]).to_pydict()
    assert packed["pair"] == [5, 9, 7 << 32 | 3, 7 << 32 | 4] and packed["documents"] == [4000, 1, 256, 257]
    assert packed["links"] == [sum(n for (p, _), n in held.items() if p == q) for q in (5, 9, 7 << 20 | 3, 7 << 20 | 4)]
    weights = np.array([3, 10, 1000, 7])
    expected = np.zeros(1 << DOC_BITS, np.int64)
    for (pair, doc), n in held.items():
        expected[doc] += n * weights[[5, 9, 7 << 20 | 3, 7 << 20 | 4].index(pair)]
    assert (add_postings(rows.column(3), [weights])[0] == expected).all()


def test_empty_tables(spark):
    paths = [tokenizer_path(f) for f in FILES]
    assert align(documents(spark, []), *paths).count() == 0
    none = align(documents(spark, [(1, None, "a"), (None, "", "b"), (2, "▁", "b")]), *paths)
    assert sorted((tuple(r) for r in none.collect()), key=str) == sorted([(1, 0, 0, 0, 0, "", 0, 0), (None, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)], key=str)
    assert none.select(F.sum("count_sum")).first()[0] == 0
