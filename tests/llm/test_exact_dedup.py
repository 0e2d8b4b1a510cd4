import hashlib
import re

from pyspark.sql import functions as F

from claimspark.llm.exact_dedup import content_hash, exact_dedup
from tests.llm.data import awkward, documents


def expected(texts):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in texts]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    texts = awkward()
    for hash_of in (content_hash, lambda text: F.unhex(F.hex(F.length(text) % 2))):  # the second collides all the time
        got = [tuple(r) for r in exact_dedup(documents(spark, texts), hash_of=hash_of).collect()]
        assert sorted(got, key=str) == expected(texts)


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).count() == 0
