import hashlib
import random

import numpy as np
import pytest

from claimspark.llm import suffix_dedup as sd
from tests.llm.data import awkward, documents, prose


def expected(texts, length):
    """Bytes covered by an earlier string; equal rows are one document, NULL ids come last."""
    rank = lambda t: int.from_bytes(hashlib.md5(t).digest()[:8], "big", signed=True)
    docs = sorted({(2**63 - 1 if i is None else i, rank((t or "").encode()), (t or "").encode()) for i, t, _ in texts})
    seen, cut = set(), {}
    for doc, _, text in docs:
        covered = bytearray(len(text))
        for s in range(len(text) - length + 1):
            if text[s : s + length] in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(text[s : s + length])
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        cut[doc, text] = len(text), sum(covered), spans, bytes(b for b, c in zip(text, covered) if not c)
    return sorted(((i, *cut[2**63 - 1 if i is None else i, (t or "").encode()]) for i, t, _ in texts), key=str)


@pytest.mark.parametrize("length", [100, 20])
def test_against_every_string(spark, length):
    shared = prose(60, 60)
    texts = awkward() + [(200 + i, prose(200 + i, 30) + shared[i : 300 - i] + prose(400 + i, 10), "a") for i in range(20)]
    texts += [(300, "ab" * 200, "b"), (301, "ba" * 90 + "c", "b"), (302, shared * 3, "b")]
    rows = sd.suffix_dedup(documents(spark, texts), length=length, block_bytes=3000).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows), key=str)
    assert got == expected(texts, length)


def test_empty_table(spark):
    assert sd.suffix_dedup(documents(spark, [])).count() == 0


def test_merge_knows_prefixes():
    draw = random.Random(1)
    runs = []
    for _ in range(13):
        runs.append(sorted(bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(0, 30))))
    coded = [sd.decode_run(*sd.front_code(r)) for r in runs]
    merged = list(sd.merge_runs(coded))
    assert [m[0] for m in merged] == sorted(s for r in runs for s in r)
    for (a, _, _), (b, shared, _) in zip(merged, merged[1:]):
        assert shared == sd.shared_prefix(a, b, 0)
    assert list(sd.merge_runs([])) == []


def test_gram_hashes_and_anchors():
    data = np.frombuffer(b"abcabcabcxyz", np.uint8)
    for width in (1, 3, 5, 6):
        h = sd.gram_hashes(data, width)
        assert len(h) == len(data) - width + 1 and (width > 6 or h[0] == h[3])
    values = np.array([5, 3, 9, 1, 7, 2, 8], np.uint64)
    for width in range(1, 8):
        assert sd._sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(8 - width)]
