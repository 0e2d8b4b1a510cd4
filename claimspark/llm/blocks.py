"""Documents in blocks, and counts of hashed values that come back to the block they were asked from.

A block is a set of whole documents chosen by a hash of their id. A block sends the sorted hashes of its
values to counting groups (a group holds one range of hashes) and gets one small number per value back, in
the order it sent them; neither ids nor texts travel with the values. Blocks times groups is the number of
messages: enlarge ``block_bytes`` with the data (4 MB suits up to some TB, 256 MB 100 TB).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20  # text handled by one vectorised step
MESSAGES = "block long, part int, payload binary"
MESSAGE_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])


NO_ID = 2**63 - 1  # stands for NULL, after all others
BLOCKS = "block long, ids binary, lengths binary, data binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """The documents packed by block (see ``unpacked``), the number of blocks and of bits that name a counting group.

    Texts are compressed together before they are moved; NULL text counts as empty.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    bits = max(0, (n_blocks // 2).bit_length())
    rows = texts.select(block_of(F.col("doc_id"), n_blocks).alias("block"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(blocks, kind="stable")
            starts = np.flatnonzero(np.r_[True, blocks[order][1:] != blocks[order][:-1]]) if len(order) else []
            texts, out = batch.column(2), []
            for own in np.split(order, starts[1:]) if len(order) else []:
                parts = [texts[i].as_buffer() for i in own.tolist()]
                lengths = np.array([p.size for p in parts], np.int64)
                out.append((int(blocks[own[0]]), ids[own].tobytes(), lengths.tobytes(), squeezed(b"".join(parts))))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)

    return rows.mapInArrow(pack, BLOCKS), n_blocks, bits


def block_of(doc_id: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n_blocks))


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "big") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "big"), "zstd", asbytes=True)


def unpacked(rows: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids (``NO_ID`` for NULL) and texts of the documents of one block."""
    ids, texts = [], []
    for own, lengths, data in zip(*(rows[n].to_pylist() for n in ("ids", "lengths", "data"))):
        ids += np.frombuffer(own, np.int64).tolist()
        ends = np.cumsum(np.frombuffer(lengths, np.int64)).tolist()
        data = unsqueezed(data)
        texts += [data[a:b] for a, b in zip([0, *ends], ends)]
    return ids, texts


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring documents with about ``limit`` bytes; longer documents stand alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _split(ordered: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers that occur, and where each begins (one more entry for the end)."""
    if not bits:
        return np.array([0]), np.array([0, len(ordered)])
    part = (ordered >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return part[starts], np.r_[starts, len(ordered)]


def ask(block: int, ordered: np.ndarray, bits: int) -> pa.Table:
    """Messages with the sorted hashes of one block; a message keeps the 32 bits after the group's."""
    if not len(ordered):
        return MESSAGE_SCHEMA.empty_table()
    parts, bounds = _split(ordered, bits)
    values = ((ordered << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    payloads = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.table([pa.array([block] * len(parts), pa.int64()), pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], schema=MESSAGE_SCHEMA)


def answered(messages: DataFrame, grade: Callable[[np.ndarray], np.ndarray], nibbles: bool) -> DataFrame:
    """Replies to ``messages``: ``grade`` of the number of equal values, as 4 bits or as 1 bit each."""

    def count(rows: pa.Table) -> pa.Table:
        payloads = [np.frombuffer(p.as_py(), np.uint32) for p in rows["payload"]]
        _, where, counts = np.unique(np.concatenate(payloads), return_inverse=True, return_counts=True)
        grades = grade(counts)[where].astype(np.uint8)
        replies, at = [], 0
        for p in payloads:
            own = grades[at : at + len(p)]
            at += len(p)
            if nibbles:
                own = np.r_[own, np.uint8(0)] if len(own) % 2 else own
                replies.append((own[0::2] | (own[1::2] << 4)).astype(np.uint8).tobytes())
            else:
                replies.append(np.packbits(own).tobytes())
        return pa.table([rows["block"], rows["part"], pa.array(replies, pa.binary())], schema=MESSAGE_SCHEMA)

    return messages.groupBy("part").applyInArrow(count, MESSAGES)


def graded(ordered: np.ndarray, bits: int, replies: dict[int, bytes], nibbles: bool) -> np.ndarray:
    """The grades of a block's sorted hashes from the replies by group number."""
    out = np.zeros(len(ordered), np.uint8)
    if len(ordered):
        parts, bounds = _split(ordered, bits)
        for part, a, b in zip(parts.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            raw = np.frombuffer(replies[part], np.uint8)
            if nibbles:
                both = np.empty(len(raw) * 2, np.uint8)
                both[0::2], both[1::2] = raw & 15, raw >> 4
            else:
                both = np.unpackbits(raw)
            out[a:b] = both[: b - a]
    return out
