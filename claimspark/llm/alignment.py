"""Alignment of two tokenizers over a corpus, counted in an inverted index of pair bitmaps.

Two encodings of one text cut the same bytes. Every place where a token of either ends is the end of one link: the
tokens of both sides that cover the bytes before it overlap there and nowhere else in one more piece. Links of a
slice of documents are found for all its texts at once. The slices of up to 4,096 documents are OR-merged into a container: for each
pair of ids a bitmap of the documents that hold it, as bit planes of how often each does (plane k holds documents whose number has bit k).
A plane is a sorted list or, when longer, 4,096 bits. A pair's bitmap over the corpus is the list of its containers, which
have no document in common, so their popcounts add up. For the scores of documents the containers meet the
totals of their pairs and go back to the block they came from, where every posting adds to its document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from claimspark.llm.bpe import WORD_PATTERN, byte_letters
from claimspark.session import materialise

DOC_BITS = 12  # documents of a container: 4,096
ID_BITS = 20  # of a token id inside a sort key
LIST_WORDS = 256  # a plane of more documents is stored as 4,096 bits, the same number of 16-bit words
SLICE_BYTES = 1 << 21  # text encoded in one step; a longer text is a step of its own
KEPT_ENTRIES = 1_500_000  # pairs of documents held before a container is closed


class ByteBpe:
    """A byte-level tokenizer file; ids and the bytes of each id."""

    def __init__(self, source: str):
        spec, letters = json.loads(source), byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        for place, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if spec["model"]["vocab"][left + right] != 256 + place:
                raise ValueError("The ids of the tokenizer file do not follow its merges.")
        self.bytes_of = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for raw, i in ranks.items():
            self.bytes_of[i] = raw
        self._coder = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._coder.encode_ordinary(" " + text) for text in texts]


class PieceBpe:
    """A sentence piece model, which puts a space before the text itself; ids and the bytes of each id."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self._coder.id_to_piece(i) for i in range(self._coder.get_piece_size())]
        self.bytes_of = [
            bytes([int(p[1:-1], 16)]) if regex.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._coder.encode(texts, num_threads=1)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to ``size`` - 1 as rows with room for a mark, and their lengths."""
    text = np.array([str(i) for i in range(size)], "S8")
    return text.view(np.uint8).reshape(size, 8), np.char.str_len(text)


class Aligner:
    """Groups and links of slices of texts."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        size = max(len(a.bytes_of), len(b.bytes_of))
        if size > 1 << ID_BITS:
            raise ValueError(f"Vocabularies of more than {1 << ID_BITS} ids are not supported.")
        self._sizes = [np.array([len(x) for x in side.bytes_of], np.int64) for side in (a, b)]
        self._digits, self._digit_count = _digits(size)

    def _tokens(self, texts: list[str | None]) -> tuple[list, list]:
        """Ids of both sides, empty where the bytes of either side are not the text behind a space."""
        raw = [b" " + t.encode() if t else None for t in texts]
        some = [t for t in texts if t]
        found = iter(zip(self.a.encode(some), self.b.encode(some)) if some else ())
        left, right = [], []
        for text in raw:
            ids_a, ids_b = next(found) if text else ([], [])
            same = b"".join(map(self.a.bytes_of.__getitem__, ids_a)) == text == b"".join(map(self.b.bytes_of.__getitem__, ids_b))
            left.append(np.array(ids_a if same else [], np.int64))
            right.append(np.array(ids_b if same else [], np.int64))
        return left, right

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Counts and group strings per text, and the distinct ``(pair, document)`` keys of the links with their numbers."""
        left, right = self._tokens(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
        a, b = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
        ends_a, ends_b = np.cumsum(self._sizes[0][a]), np.cumsum(self._sizes[1][b])
        # The texts stand one behind the other, both sides equally long, so a text's end is always an end of both.
        docs_a = np.repeat(np.arange(len(texts)), n_a)
        common_a = np.isin(ends_a, ends_b, assume_unique=True)
        groups = ends_a[common_a]
        n_groups = np.bincount(docs_a[common_a], minlength=len(texts))
        ends = np.union1d(ends_a, ends_b)
        in_a, in_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        doc = docs_a[in_a]
        keys, times = np.unique((a[in_a] << ID_BITS | b[in_b]) << DOC_BITS | doc, return_counts=True)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(texts)),
            "groups": self._group_strings(a, b, ends_a, ends_b, groups, n_a, n_b), "keys": keys, "times": times,
        }

    def _group_strings(self, a, b, ends_a, ends_b, groups, n_a, n_b) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        place = np.empty(len(a) + len(b), np.int64)  # of the tokens of a, then of b, in the written order
        place[: len(a)] = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place[len(a) :] = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        marks = np.concatenate([np.where(ends_a == groups[group_a], ord("|"), ord(",")), np.where(ends_b == groups[group_b], ord(";"), ord(","))])
        last = np.cumsum(n_b) - 1
        marks[len(a) + last[n_b > 0]] = 0
        ids, order = np.concatenate([a, b]), np.empty(len(place), np.int64)
        order[place] = np.arange(len(place))
        ids, marks = ids[order], marks[order]
        letters = self._digits[ids]
        letters[np.arange(len(ids)), self._digit_count[ids]] = marks
        flat = letters[letters != 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(self._digit_count[ids] + (marks != 0))])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        return [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


def pack_planes(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Sorted ``(pair, document)`` keys with their numbers as one row per pair: its bit planes and totals.

    A row of 16-bit words: number of planes, documents of each plane, then every plane.
    """
    pairs, docs = keys >> DOC_BITS, (keys & ((1 << DOC_BITS) - 1)).astype(np.uint16)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    held = np.diff(np.append(first, len(keys)))
    row = np.repeat(np.arange(len(first)), held)
    planes = np.frexp(np.maximum.reduceat(times, first).astype(np.float64))[1].astype(np.int64)
    bits = [(times >> k) & 1 for k in range(int(planes.max()))]
    counts = [np.add.reduceat(bit, first) for bit in bits]
    words = [np.minimum(c, LIST_WORDS) for c in counts]
    lengths = 1 + planes + sum(words)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint16)
    out[starts] = planes
    at = starts + 1 + planes
    for k, (bit, count, size) in enumerate(zip(bits, counts, words)):
        has = planes > k
        out[starts[has] + 1 + k] = count[has]
        entry = np.flatnonzero(bit)
        own = row[entry]
        listed = count[own] <= LIST_WORDS
        rank = np.arange(len(entry)) - (np.cumsum(count) - count)[own]
        out[(at[own] + rank)[listed]] = docs[entry[listed]]
        dense, own = entry[~listed], own[~listed]
        np.bitwise_or.at(out, at[own] + (docs[dense] >> 4), np.uint16(1) << (docs[dense] & np.uint16(15)))
        at = at + size
    offsets = np.append(starts, len(out)).astype(np.int64) * 2
    binary = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())
    numbers = pairs[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers >> ID_BITS << 32 | numbers & ((1 << ID_BITS) - 1)), pa.array(held), pa.array(np.add.reduceat(times, first)), binary],
        ["pair", "documents", "links", "planes"],
    )


def add_postings(planes: pa.Array, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of pair weights the sum over a document's links, for the documents of one container."""
    sums = [np.zeros(1 << DOC_BITS, np.int64) for _ in weights]
    if not len(planes):
        return sums
    planes = planes.cast(pa.large_binary())
    offsets = np.frombuffer(planes.buffers()[1], np.int64)[planes.offset : planes.offset + len(planes) + 1] // 2
    data = np.frombuffer(planes.buffers()[2], np.uint16)
    starts = offsets[:-1]
    number = data[starts].astype(np.int64)
    at = starts + 1 + number
    for k in range(int(number.max())):
        rows = np.flatnonzero(number > k)
        count = data[starts[rows] + 1 + k].astype(np.int64)
        listed = count <= LIST_WORDS
        own, size = rows[listed], count[listed]
        where = np.repeat(at[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        found = [(np.repeat(own, size), data[where])]
        for row in rows[~listed]:
            bits = np.unpackbits(data[at[row] : at[row] + LIST_WORDS].view(np.uint8), bitorder="little")
            doc = np.flatnonzero(bits)
            found.append((np.full(len(doc), row), doc))
        for row, doc in found:
            for total, weight in zip(sums, weights):
                np.add.at(total, doc, weight[row] << k)
        at[rows] += np.minimum(count, LIST_WORDS)
    return sums


def alignment_index(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """The written index: rows of documents (``pair`` is NULL) and of the postings of pairs, by ``block``.

    ``tokenizer_a`` is the path of a byte-level BPE file, ``tokenizer_b`` of a sentence piece model; both are read by
    the driver and sent to the tasks (their size does not depend on the data). With ``digest``, ``groups`` is the SHA-256 of the string.
    """
    context = docs.sparkSession.sparkContext
    with open(tokenizer_a, encoding="utf-8") as file:
        source_a = context.broadcast(file.read())
    with open(tokenizer_b, "rb") as file:
        source_b = context.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select(
        F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("place"), "doc_id",
        *[F.lit(None).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], F.lit(None).cast("string").alias("groups"),
        *[F.lit(None).cast("long").alias(c) for c in ("pair", "documents", "links")], F.lit(None).cast("binary").alias("planes"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteBpe(source_a.value), PieceBpe(source_b.value))
        types = None
        block, place, held, kept = TaskContext.get().partitionId() << 32, 0, 0, []

        def filled(size: int, columns: dict) -> pa.RecordBatch:
            arrays = [columns.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in types]
            return pa.RecordBatch.from_arrays(arrays, schema=types)

        def postings() -> Iterator[pa.RecordBatch]:
            keys, times = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            order = np.argsort(keys)  # no two slices share a document, so no two keys are equal
            if len(keys):
                packed = pack_planes(keys[order], times[order])
                columns = dict(zip(packed.schema.names, packed.columns))
                yield filled(len(packed), columns | {"block": pa.array(np.full(len(packed), block))})

        for batch in batches:
            if types is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                types = pa.schema([f if f.name != "doc_id" else batch.schema.field("doc_id") for f in to_arrow_schema(schema)])
            at, texts = 0, batch.column(1)
            while at < len(batch):
                end, size = at, 0
                while end < len(batch) and size < SLICE_BYTES and place + end - at < 1 << DOC_BITS:
                    size += len(texts[end].as_buffer()) if texts[end].is_valid else 0
                    end += 1
                part = aligner.align(texts.slice(at, end - at).to_pylist())
                groups = [hashlib.sha256(g).hexdigest() if digest and g else g.decode() for g in part["groups"]]
                yield filled(end - at, {
                    "block": pa.array(np.full(end - at, block)), "place": pa.array(np.arange(place, place + end - at)),
                    "doc_id": batch.column(0).slice(at, end - at), "groups": pa.array(groups, pa.string()),
                } | {c: pa.array(part[c]) for c in ("n_a", "n_b", "n_groups", "n_links")})
                kept.append((part["keys"] + place, part["times"]))
                place, held, at = place + end - at, held + len(part["keys"]), end
                if place == 1 << DOC_BITS or held >= KEPT_ENTRIES:
                    yield from postings()
                    block, place, held, kept = block + 1, 0, 0, []
        if kept:
            yield from postings()

    return materialise(rows.mapInArrow(run, schema), "alignment-index")


def pair_counts(index: DataFrame) -> DataFrame:
    """Per pair of ids ``pair`` (a * 2^32 + b): ``documents`` that hold it linked, ``links``, and whether it is ``best`` for its a.

    Totals are added up in the tasks before the shuffle. The rows of one a are at most the other vocabulary.
    """
    totals = index.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    most = F.max("documents").over(Window.partitionBy(F.shiftright("pair", 32)))
    return totals.withColumn("best", F.col("documents") == most)


def align(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum``.

    Special tokens' strings are plain text. NULL and empty texts, and texts whose bytes one of the tokenizers changes, have no tokens: counts
    of 0 and ``groups`` ''. A pair's count is the number of rows that hold it linked, so repeated rows count
    each; several best pairs of an id all count in ``n_best``. NULL ids pass through. Other columns are ignored. An
    empty table gives an empty result. A text of any length is one piece; memory is that of the longest one. ``groups`` is the string of groups, or its SHA-256 with ``digest``.
    """
    index = alignment_index(docs, tokenizer_a, tokenizer_b, id_col, text_col, digest)
    counts = materialise(pair_counts(index), "alignment-pairs")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    known = index.filter("pair IS NULL").select("block", "place", *columns)
    scored = index.filter("pair IS NOT NULL").select(F.col("block").alias("of_block"), "pair", "planes").join(counts.drop("links").hint("merge"), "pair").drop("pair")
    schema = known.select(*columns).withColumns({"n_best": F.lit(None).cast("long"), "count_sum": F.lit(None).cast("long")}).schema

    def score(members: pa.Table, postings: pa.Table) -> pa.Table:
        postings = postings.combine_chunks()
        weights = [postings.column(c).to_numpy().astype(np.int64) for c in ("best", "documents")]
        planes = postings.column("planes")
        planes = planes.chunk(0) if planes.num_chunks else pa.array([], pa.binary())
        sums = add_postings(planes, weights)
        place = members.column("place").to_numpy()
        out = members.select(columns)
        for name, total in zip(("n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(total[place]))
        return out

    return known.groupBy("block").cogroup(scored.groupBy("of_block")).applyInArrow(score, schema)
