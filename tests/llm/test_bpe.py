import json
import os
import random
import re

import numpy as np
import pytest

from claimspark.llm.bpe import TrieEncoder, bpe_decode, bpe_encode
from claimspark.llm.common import give_back
from claimspark.llm.queries import tokenizer_path
from tests.llm.data import awkward, documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_every_kind_of_character_and_random_mixtures(library):
    with open(tokenizer_path(), encoding="utf-8") as file:
        coder = TrieEncoder(file.read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)} x" for c in points[k : k + 60]) for k in range(0, len(points), 240)]
    draw = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'re", "é", "22", "!", "aaa", "<|endoftext|>", "　", "\x85", "\x1c", "the", "ing", "中", "́", " th"]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    encoded = coder.encode(texts)
    for text, own, theirs in zip(texts, encoded, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(own, np.int32)
        assert ids.tolist() == theirs.ids, text
        assert coder.decode(ids) == library.decode(theirs.ids, skip_special_tokens=False)


def test_kept_words_are_forgotten_without_harm(library, monkeypatch):
    monkeypatch.setattr("claimspark.llm.bpe.KEPT_WORDS", 3)
    monkeypatch.setattr("claimspark.llm.bpe.KEPT_PAIRS", 3)
    with open(tokenizer_path(), encoding="utf-8") as file:
        coder = TrieEncoder(file.read())
    for text in ("some words here", "other longer sentences there", "some words here"):
        assert np.frombuffer(coder.encode([text])[0], np.int32).tolist() == library.encode(text).ids


def test_each_merge_is_judged_once(monkeypatch):
    judged = []
    border = TrieEncoder._border
    monkeypatch.setattr(TrieEncoder, "_border", lambda self, *args: judged.append(args) or border(self, *args))
    with open(tokenizer_path(), encoding="utf-8") as file:
        source = file.read()
    TrieEncoder(source)
    assert 0 < len(judged) <= len(json.loads(source)["model"]["merges"])


@pytest.mark.parametrize(("level_bytes", "level_words"), [(0, 5), (6, 1), (9, 5), (48, 3), (400, 1000)])
def test_levels_and_paths_give_the_same(library, monkeypatch, level_bytes, level_words):
    monkeypatch.setattr("claimspark.llm.bpe.LEVEL_BYTES", level_bytes)
    monkeypatch.setattr("claimspark.llm.bpe.LEVEL_WORDS", level_words)
    with open(tokenizer_path(), encoding="utf-8") as file:
        coder = TrieEncoder(file.read())
    draw = random.Random(5)
    texts = ["", "a", "a\0", "\0", "\0\0a a\0b a\0", "é" * 24 + " " + "é" * 25, "x" * 48 + " " + "x" * 49, "the theory then them the", "ab" * 100]
    texts += ["".join(draw.choice("aeinrst éñ\0'9") for _ in range(draw.randint(1, 200))) for _ in range(300)]
    for text, own, theirs in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(own, np.int32).tolist() == theirs.ids, text


def test_documents(spark, library):
    texts = awkward()
    docs = documents(spark, texts)
    rows = bpe_encode(docs, tokenizer_path(), decoded=True).collect()
    want = sorted(((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in texts), key=str)
    assert sorted(((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in rows), key=str) == want
    assert rows[0]["norm"] == "x"
    back = bpe_decode(bpe_encode(docs.select("doc_id", "text"), tokenizer_path()), tokenizer_path()).collect()
    assert sorted(r["decoded"] for r in back) == sorted(t or "" for _, t, _ in texts)
    assert bpe_encode(documents(spark, []), tokenizer_path()).count() == 0


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory cannot be read here")
def test_a_worker_gives_back_what_earlier_stages_freed():
    def held() -> int:
        with open("/proc/self/smaps_rollup") as file:
            return int(re.search(r"Pss_Anon:\s+(\d+)", file.read()).group(1)) >> 10

    arrays = [np.ones(2_000) for _ in range(16_000)]  # 256 MB in pieces that the allocator keeps when they are freed
    pins = arrays[::500]  # some live on between them
    full = held()
    del arrays
    give_back()
    assert full - held() > 150
    assert len(pins) == 32
