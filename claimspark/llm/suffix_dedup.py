"""Remove repeated substrings by a distributed merge sort of text suffixes that knows common prefixes.

A string of ``length`` bytes is judged by an anchor inside it: the leftmost position whose ``GRAM``-byte hash is
the smallest in the string. Equal strings have their anchors at equal places, so

1. blocks of documents ask which anchor grams occur more than once (see ``blocks``); all other strings are unique;
2. neighbouring strings that share a repeated anchor form one suffix, cut after the last of them. Every block sorts
   its suffixes and sends them front-coded (length of the prefix shared with the one before, then the rest);
3. the runs of all blocks are merged by a loser tree that keeps, for every run, the prefix it shares with the last
   winner and compares only behind it. Suffixes equal over their whole length: all but the first are covered;
4. of the suffixes that came first, those whose anchor has several of them are of interest: their single strings are
   asked for in the same way, and those that occur in several suffixes are sent one by one, as suffixes cut at
   ``length`` bytes, and merged again.

Suffixes are dealt by a hash of the whole suffix, so a frequent prefix or anchor does not gather in one task; a
block reports its own repeats itself and sends each distinct suffix once. Documents equal to an earlier one
are found by their hash beforehand and send nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimspark.llm.blocks import (
    BLOCK_BYTES, MESSAGE_SCHEMA, MESSAGES, NO_ID, answered, ask, block_of, chunks, graded, in_blocks, mixed, squeezed, unpacked, unsqueezed,
)
from claimspark.session import materialise

LENGTH = 100
GRAM_SHARE = 0.56  # bytes of the anchor's gram by bytes of the string
ANCHOR_BYTES = 1 << 18  # text whose anchors are looked for in one step; its hashes fit into a core's cache

_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_COPIES = -1  # part number of notes that name copies
_STRINGS = 1 << 30  # added to the part numbers of replies on strings, to tell them from those on anchors


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` bytes of ``data``, by doubling."""

    def join(left, right, left_width, width):
        n = len(data) - width + 1
        return left[:n] + np.uint64(pow(_BASE, left_width, 2**64)) * right[left_width : left_width + n]

    power, size, done, total = _BYTE[data], 1, None, 0
    while True:
        if width & size:
            done = power if done is None else join(done, power, total, total + size)
            total += size
        if total == width:
            return mixed(done)
        power = join(power, power, size, 2 * size)
        size *= 2


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - size :]) if width > size else least


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per document with strings: its number, hash of each anchor, first and last string of each anchor."""
    for first, last in chunks(texts, ANCHOR_BYTES):
        part = [(i, t) for i, t in enumerate(texts[first:last], first) if len(t) >= length]
        if not part:
            continue
        data = np.frombuffer(b"".join(t for _, t in part), np.uint8)
        hashes = gram_hashes(data, gram)
        ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_min(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = 0
        for i, t in part:
            own = place[at : at + len(t) - length + 1]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            yield i, hashes[own[starts]], starts, np.r_[starts[1:], len(own)] - 1
            at += len(t)


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(ordered: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared-prefix lengths, lengths (both 32 bits) and the rests of a sorted run."""
    shared, before = [], b""
    for s in ordered:
        shared.append(shared_prefix(before, s, 0))
        before = s
    rests = b"".join(s[k:] for s, k in zip(ordered, shared))
    return np.array(shared, np.uint32).tobytes(), np.array([len(s) for s in ordered], np.uint32).tobytes(), rests


def decode_run(shared: bytes, lengths: bytes, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """Suffixes of a front-coded run with the prefix length each shares with the one before."""
    before, at = b"", 0
    for k, n in zip(np.frombuffer(shared, np.uint32).tolist(), np.frombuffer(lengths, np.uint32).tolist()):
        before = before[:k] + rests[at : at + n - k]
        at += n - k
        yield before, k


def merge_runs(runs: list[Iterable[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Sorted merge as (suffix, prefix shared with the one before, run).

    Loser tree: every loser keeps the prefix it shares with the suffix that beat it. Of two challengers of the same
    last winner the one sharing more with it comes first; only for equal lengths are bytes compared, behind them.
    """
    sources = [iter(r) for r in runs]
    size = 1
    while size < len(sources):
        size *= 2
    heads: list[bytes | None] = [None] * size
    known = [0] * size
    for i, source in enumerate(sources):
        heads[i] = next(source, (None, 0))[0]
    tree = [0] * size

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one shared with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (i, j) if b is None else (j, i)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        k = shared_prefix(a, b, known[i])
        if k == len(a) == len(b):
            first = i < j
        else:
            first = k == len(a) or (k < len(b) and a[k] < b[k])
        if first:
            known[j] = k
            return i, j
        known[i] = k
        return j, i

    level = list(range(size))
    at = size // 2
    while len(level) > 1:
        winners = []
        for n in range(0, len(level), 2):
            winner, tree[at + n // 2] = play(level[n], level[n + 1])
            winners.append(winner)
        level, at = winners, at // 2
    winner = level[0]
    shared = 0
    while heads[winner] is not None:
        yield heads[winner], shared, winner
        head, own = next(sources[winner], (None, 0))  # the challenger and the prefix it shares with the last winner
        heads[winner], known[winner] = head, own
        node = (winner + size) // 2
        while node:  # ``play``, spelt out because it runs for every suffix and level
            other = tree[node]
            rival = heads[other]
            if rival is not None:
                theirs = known[other]
                ahead = head is None or theirs > own
                if not ahead and theirs == own:
                    k = shared_prefix(head, rival, own)
                    if k == len(head) == len(rival):
                        ahead = other < winner
                    else:
                        ahead = k == len(rival) or (k < len(head) and rival[k] < head[k])
                    known[winner if ahead else other] = k
                if ahead:
                    tree[node] = winner
                    winner, head, own = other, rival, theirs
            node //= 2
        shared = own


# A run: suffixes front-coded, each with document (id and rank among equal ids), place and number of strings, and the hash of
# its anchor. Blocks of found: covered spans (document, rank, first string, number), and the suffixes that came first with the same five.
_RUNS = "bucket long, block long, shared binary, lengths binary, rests binary, places binary, hashes binary"
_RUNS_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("shared", "lengths", "rests", "places", "hashes"))])
_FOUND = "block long, spans binary, places binary, hashes binary, lengths binary, suffixes binary"
_FOUND_SCHEMA = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("spans", "places", "hashes", "lengths", "suffixes"))])
_CUT_SCHEMA = pa.schema([*((n, pa.int64()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))])
_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>"


def _ints(rows: list[tuple] | np.ndarray) -> bytes:
    """Rows of four integers, column by column."""
    return squeezed(np.array(rows, np.int64).reshape(-1, 4).T.tobytes())


def _rows(data: bytes | None) -> list[tuple]:
    return list(map(tuple, np.frombuffer(unsqueezed(data), np.int64).reshape(4, -1).T.tolist())) if data else []


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns.get(f.name, []), f.type) for f in schema], schema=schema)


def _run_table(runs: Iterable[tuple], repeats: np.ndarray, bits: int, block: int) -> pa.Table:
    """Rows of ``_RUNS``: ``(bucket, shared, lengths, rests, places, hashes)`` of each run, and the repeats inside the block without suffixes."""
    out = defaultdict(list)
    for bucket, shared, lengths, rests, places, hashes in runs:
        for name, value in zip(_RUNS_SCHEMA.names, (bucket, block, squeezed(shared), squeezed(lengths), squeezed(rests), _ints(places), hashes)):
            out[name].append(value)
    if len(repeats):
        for name, value in zip(_RUNS_SCHEMA.names, ((1 << bits) + block % (1 << bits), block, None, None, None, _ints(repeats), None)):
            out[name].append(value)
    return _table(out, _RUNS_SCHEMA)


def _sorted_runs(suffixes: list[bytes], places: np.ndarray, hashes: np.ndarray, bits: int, block: int) -> pa.Table:
    """Runs by bucket of the suffixes, which stand in the order of their documents and places."""
    runs: dict[int, list[int]] = defaultdict(list)
    repeats, before = [], None
    for i in sorted(range(len(suffixes)), key=suffixes.__getitem__):
        s = suffixes[i]
        if s == before:
            repeats.append(i)
        else:
            before = s
            runs[zlib.crc32(s) >> (32 - bits)].append(i)
    coded = ((bucket, *front_code([suffixes[i] for i in own]), places[own], hashes[own].tobytes()) for bucket, own in runs.items())
    return _run_table(coded, places[repeats], bits, block)


def _string_runs(strings: np.ndarray, places: np.ndarray, hashes: np.ndarray, bits: int, block: int) -> pa.Table:
    """The same of strings of one length, a row of bytes each, dealt by their hashes."""
    length = strings.shape[1]
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))
    order = order[np.argsort(np.ascontiguousarray(strings[order]).view(f"S{length}").ravel(), kind="stable")] if len(order) else order
    ordered = strings[order]
    again = np.r_[np.zeros(min(1, len(order)), bool), (ordered[1:] == ordered[:-1]).all(axis=1)]
    heads = order[~again]
    buckets = (hashes[heads] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(heads), np.int64)
    dealt = np.argsort(buckets, kind="stable")
    heads, buckets = heads[dealt], buckets[dealt]
    bounds = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True]) if len(heads) else np.zeros(0, np.int64)

    def coded() -> Iterator[tuple]:
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = strings[heads[a:b]]
            shared = np.r_[0, (own[1:] != own[:-1]).argmax(axis=1)]
            rests = own[np.arange(length) >= shared[:, None]]
            lengths = np.full(b - a, length, np.uint32)
            yield int(buckets[a]), shared.astype(np.uint32).tobytes(), lengths.tobytes(), rests.tobytes(), places[heads[a:b]], None

    return _run_table(coded(), places[order[again]], bits, block)


def _merged(rows: pa.Table, keep_firsts: bool) -> pa.Table:
    """Covered spans by block, with the first of each group of equal suffixes if asked for."""
    spans, firsts = defaultdict(list), defaultdict(list)
    runs, places = [], []
    for row in rows.to_pylist():
        own = _rows(row["places"])
        if row["shared"] is None:
            spans[row["block"]] += own
        else:
            runs.append(decode_run(*(unsqueezed(row[n]) for n in ("shared", "lengths", "rests"))))
            hashes = np.frombuffer(row["hashes"], np.uint64).tolist() if keep_firsts else repeat(0)
            places.append((row["block"], zip(own, hashes)))

    def close(group: list[tuple], suffix: bytes) -> None:
        if len(group) > 1:
            group.sort()
        if keep_firsts:
            firsts[group[0][1]].append((suffix, group[0][0], group[0][2]))
        for place, block, _ in group[1:]:
            spans[block].append(place)

    group, last = [], b""
    for suffix, shared, run in merge_runs(runs):
        if group and not (shared == len(suffix) == len(last)):
            close(group, last)
            group = []
        block, own = places[run]
        place, anchor = next(own)
        group.append((place, block, anchor))
        last = suffix
    if group:
        close(group, last)
    out = defaultdict(list)
    for block in spans.keys() | firsts.keys():
        own = firsts.get(block, [])
        for name, value in zip(_FOUND_SCHEMA.names, (
            block, _ints(spans.get(block, [])), _ints([p for _, p, _ in own]), np.array([h for _, _, h in own], np.uint64).tobytes(),
            squeezed(np.array([len(s) for s, _, _ in own], np.int64).tobytes()), squeezed(b"".join(s for s, _, _ in own)),
        )):
            out[name].append(value)
    return _table(out, _FOUND_SCHEMA)


def _anchor_hashes(rows: pa.Table) -> np.ndarray:
    """Anchor hashes of the suffixes of a block that came first."""
    return np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for h in rows["hashes"].to_pylist())])


def _marked(hashes: np.ndarray, bits: int, replies: dict[int, bytes]) -> np.ndarray:
    """Which of the hashes, in any order, occur several times."""
    sort = np.argsort(hashes, kind="stable")
    out = np.empty(len(hashes), bool)
    out[sort] = graded(hashes[sort], bits, replies, False) > 0
    return out


def _strings(rows: pa.Table, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the wanted suffixes among those of a block that came first: their bytes, and for each of their strings start, place and hash."""
    texts, lengths, places = [], [], []
    for suffixes, own, where in zip(*(rows[n].to_pylist() for n in ("suffixes", "lengths", "places"))):
        texts.append(np.frombuffer(unsqueezed(suffixes), np.uint8))
        lengths.append(np.frombuffer(unsqueezed(own), np.int64))
        places.append(np.frombuffer(unsqueezed(where), np.int64).reshape(4, -1).T)
    if not len(wanted):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
    lengths, places = np.concatenate(lengths), np.concatenate(places)[wanted]
    starts, size = (np.cumsum(lengths) - lengths)[wanted], lengths[wanted]
    begin = np.cumsum(size) - size
    data = np.concatenate(texts)[np.repeat(starts - begin, size) + np.arange(size.sum())]
    counts = places[:, 3]
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at, own = np.repeat(begin, counts) + step, np.repeat(places, counts, axis=0)
    own[:, 2] += step
    own[:, 3] = 1
    return data, at, own, gram_hashes(data, length)[at]


def _block_rows(rows: pa.Table) -> list[tuple[int, int, bytes]]:
    """Id, rank among rows of the id with other texts, and bytes of each document of a block."""
    ids, texts = unpacked(rows)
    several = {i for i, n in Counter(ids).items() if n > 1}
    same = defaultdict(set)
    for i, t in zip(ids, texts):
        if i in several:
            same[i].add(hashlib.md5(t).digest())
    ranks = {i: {h: n for n, h in enumerate(sorted(hashes))} for i, hashes in same.items()}
    return [(i, ranks[i][hashlib.md5(t).digest()] if i in several else 0, t) for i, t in zip(ids, texts)]


def _copy_name(doc: int, text: bytes) -> bytes:
    return f"{doc}:{hashlib.md5(text).hexdigest()}".encode()


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (remaining bytes) ``, spans`` (start, end, ...).

    A byte is removed if a string of ``length`` bytes over it also starts earlier: in a smaller id or earlier in the
    same text. Strings are judged on the input; overlaps count; matches never cross documents. NULL text counts as
    empty; NULL ids come last. Different texts under one id are ordered by a hash of the text; rows that repeat
    id and text are one document and have equal results. Other columns are ignored; an empty table gives an
    empty result. All exchanges belong to one plan, so the packed texts move once and are read three times.
    """
    gram = max(1, int(length * GRAM_SHARE))
    texts, n_blocks, bits = in_blocks(docs, id_col, text_col, block_bytes)

    def send(rows: pa.Table) -> pa.Table:
        found = [h for _, h, _, _ in anchors(unpacked(rows)[1], length, gram)]
        return ask(rows["block"][0].as_py(), np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64), bits)

    def suffixes(rows: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(rows):
            return _RUNS_SCHEMA.empty_table()
        noted = list(zip(notes["part"].to_pylist(), notes["payload"].to_pylist()))
        replies, copies = {p: v for p, v in noted if p != _COPIES}, {v for p, v in noted if p == _COPIES}
        own = _block_rows(rows)
        found = list(anchors([t for _, _, t in own], length, gram))
        every = np.concatenate([h for _, h, _, _ in found]) if found else np.zeros(0, np.uint64)
        repeated = _marked(every, bits, replies)
        bounds = np.cumsum([0, *(len(h) for _, h, _, _ in found)])
        out, places, hashes, seen = [], [np.zeros((0, 4), np.int64)], [np.zeros(0, np.uint64)], set()
        for n in sorted(range(len(found)), key=lambda n: own[found[n][0]][:2]):
            i, h, starts, ends = found[n]
            doc, rank, text = own[i]
            if (doc, rank) in seen or (copies and _copy_name(doc, text) in copies):
                continue
            seen.add((doc, rank))
            wanted = np.flatnonzero(repeated[bounds[n] : bounds[n + 1]])
            starts, ends = starts[wanted], ends[wanted]
            out += [text[a : b + length] for a, b in zip(starts.tolist(), ends.tolist())]
            places.append(np.stack([np.full(len(wanted), doc), np.full(len(wanted), rank), starts, ends - starts + 1], axis=1))
            hashes.append(h[wanted])
        return _sorted_runs(out, np.concatenate(places), np.concatenate(hashes), bits, rows["block"][0].as_py())

    def send_anchors(rows: pa.Table) -> pa.Table:
        return ask(rows["block"][0].as_py(), np.sort(_anchor_hashes(rows)), bits)

    def wanted_strings(rows: pa.Table, replies: dict[int, bytes]) -> tuple:
        return _strings(rows, np.flatnonzero(_marked(_anchor_hashes(rows), bits, replies)), length)

    def send_strings(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(rows):
            return MESSAGE_SCHEMA.empty_table()
        answers = dict(zip(replies["part"].to_pylist(), replies["payload"].to_pylist()))
        return ask(rows["block"][0].as_py(), np.sort(wanted_strings(rows, answers)[3]), bits)

    def strings(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(rows):
            return _RUNS_SCHEMA.empty_table()
        answers = list(zip(replies["part"].to_pylist(), replies["payload"].to_pylist()))
        data, at, places, hashes = wanted_strings(rows, {p: v for p, v in answers if p < _STRINGS})
        several = np.flatnonzero(_marked(hashes, bits, {p - _STRINGS: v for p, v in answers if p >= _STRINGS}))
        bytes_of = data[at[several][:, None] + np.arange(length)]
        return _string_runs(bytes_of, places[several], hashes[several], bits, rows["block"][0].as_py())

    def together(found: pa.Table, more: pa.Table) -> pa.Table:
        block = (found if len(found) else more)["block"][0].as_py()
        rows = [r for t in (found, more) if len(t) for data in t["spans"].to_pylist() for r in _rows(data)]
        return _table({"block": [block], "part": [0], "payload": [_ints(rows)]}, MESSAGE_SCHEMA)

    def cut(rows: pa.Table, marks: pa.Table) -> pa.Table:
        out, gone, by_doc = defaultdict(list), set(), defaultdict(list)
        for part, payload in zip(marks["part"].to_pylist(), marks["payload"].to_pylist()) if len(marks) else ():
            if part == _COPIES:
                gone.add(payload)
            else:
                for doc, rank, place, count in _rows(payload):
                    by_doc[doc, rank].append((place, place + count - 1 + length))
        for doc, rank, text in _block_rows(rows) if len(rows) else ():
            removed: list[list[int]] = []
            if len(text) >= length and gone and _copy_name(doc, text) in gone:
                removed = [[0, len(text)]]
            else:
                for a, b in sorted(by_doc.get((doc, rank), ())):
                    if removed and a <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], b)
                    else:
                        removed.append([a, b])
            ends = [0, *(x for r in removed for x in r), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
            for name, value in zip(_CUT_SCHEMA.names, (None if doc == NO_ID else doc, len(text), len(text) - len(rest), len(removed), rest, ends[1:-1])):
                out[name].append(value)
        return _table(out, _CUT_SCHEMA)

    # Copies of earlier documents, by hash: all of their bytes go.
    known = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), known.alias("known_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    hashed = materialise(hashed, "suffix-hashes")
    first = hashed.groupBy("hash").agg(F.min("known_id").alias("first_id"), F.count("*").alias("rows")).filter("rows > 1")
    copies = hashed.join(first, "hash").filter("known_id > first_id").select(
        block_of(F.col("doc_id"), n_blocks).alias("block"), F.lit(_COPIES).alias("part"),
        F.encode(F.concat(F.col("known_id").cast("string"), F.lit(":"), "hash"), "utf-8").alias("payload"),
    )
    copies = materialise(copies.distinct(), "suffix-copies")
    replies = answered(texts.groupBy("block").applyInArrow(send, MESSAGES), lambda counts: counts > 1, False)
    runs = texts.groupBy("block").cogroup(replies.unionByName(copies).groupBy("block")).applyInArrow(suffixes, _RUNS)
    found = runs.groupBy("bucket").applyInArrow(lambda rows: _merged(rows, True), _FOUND)
    kinds = answered(found.groupBy("block").applyInArrow(send_anchors, MESSAGES), lambda counts: counts > 1, False)
    asked = found.groupBy("block").cogroup(kinds.groupBy("block")).applyInArrow(send_strings, MESSAGES)
    answers = answered(asked, lambda counts: counts > 1, False).withColumn("part", F.col("part") + F.lit(_STRINGS))
    answers = answers.unionByName(kinds)
    pieces = found.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(strings, _RUNS)
    more = pieces.groupBy("bucket").applyInArrow(lambda rows: _merged(rows, False), _FOUND)
    marks = found.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(together, MESSAGES).unionByName(copies)
    return texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(cut, _CUT)
