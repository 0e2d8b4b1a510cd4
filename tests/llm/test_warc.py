import gzip
import hashlib
import io
import random

import pytest

from claimspark.llm import warc
from tests.llm.data import prose

SCHEMA = "page_id long, url string, html string, id long, digest string, payload string"


def pages():
    big, other = "é" * 700, prose(1, 400)
    rows = [(1, "http://a/", big), (7, "http://b/", big), (3, None, big), (4, "http://c/\r\nX: y", other), (5, "http://d/", other), (5, "http://d/", other)]
    rows += [(8, "http://e/", "short"), (9, "http://f/", "short"), (10, "u", None), (11, "u", ""), (None, "u", big), (None, "v", "z" * 2000), (12, "w", "\r\n\r\n" + other)]
    rows += [(20 + i, f"http://n/{i}", prose(i, 300)) for i in range(40)]
    return rows


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if h == html and j is not None]
        alike = [j for j, _, h in rows if (h or "") == (html or "")]
        last = max(ids) if ids and len(alike) > 1 and len(data) >= 1000 else None
        revisit = last is not None and i != last
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [37, 5000, 1 << 25])
def test_round_trip(spark, tmp_path, split):
    rows = pages()
    table = spark.createDataFrame([(*r, 1, "d", "p") for r in rows], SCHEMA).repartition(3)
    files = warc.write_warc(table, str(tmp_path / "w"), file_bytes=9000)
    assert files.count() > 3
    got = warc.read_warc(files, split_bytes=split).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == expected(rows)
    stored = {r["payload_digest"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows} == stored
    assert {r["url"] for r in got if r["page_id"] == 4} == {"http://c/%0D%0AX: y"}


def test_empty_table(spark, tmp_path):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(table, str(tmp_path / "w"))).count() == 0


def test_every_split_owns_its_records():
    draw = random.Random(1)
    payloads = [draw.randbytes(draw.randint(0, 300)) + warc.MAGIC + b"x" for _ in range(20)]
    members = [warc.record_bytes(i, "u", p, "d", None, len(p)) for i, p in enumerate(payloads)]
    data = b"".join(members)
    assert gzip.decompress(data).count(warc.VERSION) == 20
    for size in (1, 50, 333, len(data)):
        found = []
        for start in range(0, len(data), size):
            found += [warc.parse_record(r)[2] for r in warc.records_in(io.BytesIO(data), start, min(start + size, len(data)))]
        assert found == payloads
    # A stored block holds the bytes of another member: it is part of the payload, not a record of its own.
    broken = warc.MAGIC + b"\x00\x01 not a member " + members[3] + warc.MAGIC
    assert [warc.parse_record(r)[2] for r in warc.records_in(io.BytesIO(broken), 0, len(broken))] == [payloads[3]]


@pytest.mark.parametrize("gap", [1, 2, 3])
@pytest.mark.parametrize("size", [(2 << 20), (3 << 20)])
def test_member_that_ends_just_before_a_border(size, gap):
    """A member of more than one read fills a split but for its last bytes; the next member begins there."""
    draw = random.Random(2)
    first = warc.record_bytes(1, "u", draw.randbytes(size), "d", None, size)
    second, third = (warc.record_bytes(i, "u", draw.randbytes(500), "d", None, 500) for i in (2, 3))
    data = first + second + third
    border = len(first) + gap
    assert len(first) > 1 << 20
    found = []
    for start, end in ((0, 100), (100, border), (border, len(data))):
        found += [warc.parse_record(r)[0]["warc-record-id"] for r in warc.records_in(io.BytesIO(data), start, end)]
    assert found == [f"<urn:page:{i}>" for i in (1, 2, 3)]
