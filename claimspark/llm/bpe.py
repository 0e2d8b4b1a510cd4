"""Byte-level BPE on shared word prefixes.

The encoding of a byte string is the encoding of the string without its last token, then that token. The last token is
the one suffix in the vocabulary that can stand behind the last token of what precedes it, so the state of a prefix
is one token. New words of a batch form a trie in sorted order: only the bytes behind the prefix shared with the word
before get new states. The trie is visited level by level, in numpy for all prefixes of one length; the few words over
``LEVEL_BYTES`` are visited depth first. Encodings are read backwards along the states. Two tokens can stand side by side unless a merge across their border comes before the
merges that use up the two pieces next to it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from claimspark.llm.common import give_back

# Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 200_000  # encodings of words kept by a task between batches
KEPT_PAIRS = 250_000
LEVEL_BYTES = 48  # longer words are visited one after the other
LEVEL_WORDS = 16_384  # words whose states are held at once
SLICE_CHARS = 1 << 18  # text encoded in one step
_NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class TrieEncoder:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, letters = spec["model"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self._data, self._lengths, self._offsets = np.frombuffer(b"".join(self.token_bytes), np.uint8), lengths, np.cumsum(lengths) - lengths
        vocab = model["vocab"]
        self.merged: dict[int, int] = {}  # pair of tokens in one number: rank of the merge
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank of the merge that makes it, its parts
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.merged[left << 32 | right] = rank
            self.parts.setdefault(token, (rank, left, right))
        self._edges: dict[int, tuple[tuple, tuple]] = {}
        # Reversed trie of the tokens that encode themselves: node and byte in one number lead to the node before; the root is 0.
        self.suffixes: dict[int, int] = {}
        self._standing: dict[int, bool] = {}
        at_node = {}
        for token in vocab.values():
            if self._stands(token):
                node = 0
                for b in reversed(self.token_bytes[token]):
                    node = self.suffixes.setdefault(node << 8 | b, len(self.suffixes) + 1)
                at_node[node] = token
        self.node_tokens = np.full(len(self.suffixes) + 2, -1, np.int64)  # the last one stands for no node
        self.node_tokens[list(at_node)] = list(at_node.values())
        self._node_tokens = self.node_tokens.tolist()
        self.pairs: dict[int, bool] = {}  # both tokens in one number
        self.words: dict[str, bytes] = {}
        self._split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._word = regex.compile(WORD_PATTERN)

    def _stands(self, token: int) -> bool:
        """Whether the bytes of ``token`` are encoded as that token."""
        known = self._standing.get(token)
        if known is None:
            if token not in self.parts:
                known = len(self.token_bytes[token]) == 1
            else:
                rank, left, right = self.parts[token]
                known = self._stands(left) and self._stands(right) and self._border(left, right, rank)
            self._standing[token] = known
        return known

    def _spines(self, token: int) -> tuple[tuple, tuple]:
        """Pieces at the right and at the left end of ``token`` while it is made, each with the rank that uses it up."""
        if token not in self._edges:
            ends = []
            for side in (2, 1):
                piece, used, spine = token, _NEVER, []
                while True:
                    spine.append((piece, used))
                    if piece not in self.parts:
                        break
                    used = self.parts[piece][0]
                    piece = self.parts[piece][side]
                ends.append(tuple(spine))
            self._edges[token] = ends[0], ends[1]
        return self._edges[token]

    def _border(self, left: int, right: int, limit: int = _NEVER) -> bool:
        """Whether no merge across the border of two tokens happens before ``limit``; equal ranks go left to right."""
        for a, a_used in self._spines(left)[0]:
            for b, b_used in self._spines(right)[1]:
                rank = self.merged.get(a << 32 | b)
                if rank is not None and rank < min(a_used, limit) and rank <= min(b_used, limit - 1):
                    return False
        return True

    def _neighbours(self, pair: int) -> bool:
        """Whether the second token of ``pair`` can stand behind the first, from now on known."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[pair] = self._border(pair >> 32, pair & 0xFFFFFFFF)
        return known

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word with its ids as 32-bit integers."""
        short, long = [], []
        for w in words:
            raw = w.encode()
            (short if len(raw) <= LEVEL_BYTES else long).append((raw, w))
        if short:
            short.sort()
            for start in range(0, len(short), LEVEL_WORDS):
                yield from self._encode_levels(short[start : start + LEVEL_WORDS])
        if long:
            long.sort()
            yield from self._encode_paths(long)

    def _encode_levels(self, words: list[tuple[bytes, str]]) -> Iterator[tuple[str, bytes]]:
        """Words in sorted order, all prefixes of one length in one step."""
        lengths = np.array([len(raw) for raw, _ in words])
        rows, most = len(words), int(lengths.max())
        if not most:
            yield from ((w, b"") for _, w in words)
            return
        letters = np.frombuffer(np.array([raw for raw, _ in words], f"S{most}").tobytes(), np.uint8).reshape(rows, most).astype(np.int64)
        differ = np.c_[letters[1:] != letters[:-1], np.ones(rows - 1, bool)]
        shared = np.r_[0, np.minimum(differ.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1]))]  # bytes shared with the word before
        states = np.full((rows, most + 1), -1, np.int64)  # last token of each prefix
        step, known, none = self.suffixes.get, self.pairs.get, len(self.node_tokens) - 1
        for end in range(1, most + 1):
            own = np.flatnonzero(lengths >= end)
            first = shared[own] < end
            left = np.flatnonzero(first)  # prefixes without a state yet; one row stands for all that share it
            row = own[left]
            found, node = np.full(len(own), -1, np.int64), np.zeros(len(left), np.int64)
            for at in range(end - 1, -1, -1):
                node = np.fromiter(map(step, (node << 8 | letters[row, at]).tolist(), repeat(none)), np.int64, len(row))
                token = self.node_tokens[node]
                fits = token >= 0
                if at:
                    tried = np.flatnonzero(fits)
                    pairs = (states[row[tried], at] << 32 | token[tried]).tolist()
                    stand = [known(p) for p in pairs]
                    fits[tried] = [self._neighbours(p) if s is None else s for p, s in zip(pairs, stand)] if None in stand else stand
                found[left[fits]] = token[fits]
                on = ~fits & (node != none)
                left, row, node = left[on], row[on], node[on]
                if not len(left):
                    break
            if (found[first] < 0).any():
                raise ValueError(f"The vocabulary cannot spell {words[own[first][found[first] < 0][0]][0][:end]!r}.")
            states[own, end] = found[first][np.cumsum(first) - 1]
        tokens, at, place, counts = np.zeros((rows, most), np.int32), lengths.copy(), most, np.zeros(rows, np.int64)
        live = np.flatnonzero(at)
        while len(live):  # backwards along the states
            place -= 1
            token = states[live, at[live]]
            counts[live] += 1
            tokens[live, most - counts[live]] = token
            at[live] -= self._lengths[token]
            live = live[at[live] > 0]
        data, width = tokens.tobytes(), 4 * most
        starts = (np.arange(1, rows + 1) * width - 4 * counts).tolist()
        yield from ((w, data[a:b]) for (_, w), a, b in zip(words, starts, range(width, rows * width + 1, width)))

    def _encode_paths(self, words: list[tuple[bytes, str]]) -> Iterator[tuple[str, bytes]]:
        """Words in sorted order, one after the other."""
        step, tokens, known, sizes = self.suffixes.get, self._node_tokens, self.pairs.get, self._lengths.tolist()
        path, states = b"", [-1]  # states[i]: last token of the first i bytes of the path
        for raw, word in words:
            n = min(len(raw), len(path))
            if raw[:n] == path[:n]:
                shared = n
            else:
                shared = n - ((int.from_bytes(raw[:n], "big") ^ int.from_bytes(path[:n], "big")).bit_length() + 7) // 8
            del states[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                node, at, state = 0, end, -1
                while at:
                    at -= 1
                    node = step(node << 8 | raw[at])
                    if node is None:
                        break
                    token = tokens[node]
                    if token >= 0:
                        if at:
                            pair = states[at] << 32 | token
                            fits = known(pair)
                            if fits is None:
                                fits = self._neighbours(pair)
                        if not at or fits:
                            state = token
                            break
                if state < 0:
                    raise ValueError(f"The vocabulary cannot spell {raw[:end]!r}.")
                states.append(state)
            path = raw
            ids, at = [], len(raw)
            while at:
                ids.append(states[at])
                at -= sizes[states[at]]
            ids.reverse()
            yield word, array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers; strings of special tokens become their ids."""
        pieces: list[list] = []
        for text in texts:
            parts = self._split.split(text) if self._split and any(s in text for s in self.special) else [text]
            pieces.append([self.special[p] if i % 2 else self._word.findall(p) for i, p in enumerate(parts)])
        new = set().union(*(p for own in pieces for p in own if not isinstance(p, int))).difference(self.words)
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words.clear()
            new = set().union(*(p for own in pieces for p in own if not isinstance(p, int)))
        self.words.update(self.encode_words(list(new)))
        get = self.words.__getitem__
        return [b"".join(np.int32(p).tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in own) for own in pieces]

    def decode(self, ids: np.ndarray) -> str:
        lengths = self._lengths[ids]
        places = np.repeat(self._offsets[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        return self._data[places].tobytes().decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, if asked for, ``decoded`` (their text), instead of the text.

    ``tokenizer`` is the path of a byte-level BPE tokenizer file, read by the driver and sent to the tasks (its size does
    not depend on the data). A NULL or empty text has no ids and decodes to the empty text. All other columns, NULLs
    and repeated rows pass through; columns already named ``ids`` or ``decoded`` are replaced.
    """
    with open(tokenizer, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    names = ["ids", "decoded"] if decoded else ["ids"]
    others = [c for c in docs.columns if c != text_col and c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(text_col), F.lit("")).alias("bpe text"))
    kept = rows.select(*[F.col(f"`{c}`") for c in others])
    schema = kept.withColumn("ids", F.array().cast("array<int>"))
    if decoded:
        schema = schema.withColumn("decoded", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TrieEncoder(source.value)
        give_back()  # what the tokenizer file's JSON and earlier stages took
        for batch in batches:
            at = 0
            texts = batch.column(len(others))
            while at < len(batch):
                end, size = at, 0
                while end < len(batch) and size < SLICE_CHARS:
                    size += len(texts[end].as_buffer())
                    end += 1
                encoded = coder.encode(texts.slice(at, end - at).to_pylist())
                bounds = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
                ids = np.frombuffer(b"".join(encoded), np.int32)
                columns = [batch.column(i).slice(at, end - at) for i in range(len(others))]
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)))
                if decoded:
                    columns.append(pa.array([coder.decode(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*others, *names])
                at = end
        del coder
        give_back()

    return rows.mapInArrow(run, schema.schema)


def bpe_decode(docs: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of ``ids_col``; NULL ids decode to the empty text."""
    with open(tokenizer, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    places = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TrieEncoder(source.value)
        for batch in batches:
            texts = [coder.decode(np.array(ids or [], np.int64)) for ids in batch.column(places).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return docs.mapInArrow(run, docs.withColumn("decoded", F.lit("")).schema)
