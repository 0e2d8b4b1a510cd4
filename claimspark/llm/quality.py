"""Quality classifier: supervised embeddings of hashed words and character n-grams of words.

A document is the average of the vectors of its features: every word, the 3- to 5-grams of the word with end marks,
and one feature for a word that repeats the one before. A softmax over two classes sits on the average. Vectors and
softmax are learned by plain stochastic gradient descent in numpy on a bounded sample of labelled documents. For scoring, the
softmax is multiplied into the vectors: every feature becomes one number, a word the sum over its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from claimspark.llm.blocks import mixed
from claimspark.llm.common import give_back

BUCKETS = 1 << 18
DIMENSIONS = 16
SAMPLE_PER_LABEL = 1200  # documents of each label that are learned from
SAMPLE_BYTES = 1 << 15  # longer documents are learned from only where a label has too few others (all are scored)
EPOCHS = 4
RATE = 0.5
GRAMS = (3, 4, 5)
KEPT_WORDS = 150_000
SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words one after another, and where each word's begin (one more for the end).

    Feature 0 is kept for repeated words.
    """
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    letters = mixed((np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)) * _BASE)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    numbers = [mixed(np.add.reduceat(letters * powers[place], starts))]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        count = np.maximum(lengths - n + 1, 0)
        owner = np.repeat(np.arange(len(words)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
        hashes = np.full(len(at), np.uint64(n))
        for i in range(n):
            hashes = hashes * _BASE + letters[at + i]
        numbers.append(mixed(hashes))
        owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    features = (np.concatenate(numbers)[order] % np.uint64(buckets - 1)).astype(np.int64) + 1
    return features, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]


def split_words(text: bytes) -> list[bytes]:
    return text.split()  # bytes are split at the six ASCII white-space characters


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Learn from the documents; returns one number per feature and the bias, for the log-odds of label 1."""
    numbers: dict[bytes, int] = {}
    bags = []  # distinct words of each document with their counts, and its repeated words
    for text in texts:
        words = split_words(text)
        own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
        bags.append((*np.unique(own, return_counts=True), int(np.count_nonzero(own[1:] == own[:-1]))))
    known, parts, ends = list(numbers), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(known), 20_000):
        some, within = word_features(known[at : at + 20_000], buckets)
        parts.append(some.astype(np.int32))
        ends.append(within[1:] + ends[-1][-1])
    features, bounds = np.concatenate(parts), np.concatenate(ends)
    docs = []
    for own, counts, again in bags:
        size = bounds[own + 1] - bounds[own]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[own], size)
        unique, place = np.unique(features[at], return_inverse=True)
        weight = np.bincount(place, np.repeat(counts, size)) if len(at) else np.zeros(0)
        if again:
            unique, weight = np.r_[np.int32(0), unique], np.r_[again, weight]
        docs.append((unique, (weight / max(1.0, weight.sum())).astype(np.float32)))
    del bags, numbers, known, parts, features
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    softmax, bias = np.zeros((2, dimensions)), np.zeros(2)
    total = max(1, epochs * len(docs))
    step = 0
    for _ in range(epochs):
        for i in draw.permutation(len(docs)):
            index, weight = docs[i]
            mean = weight @ vectors[index]
            logits = softmax @ mean + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[int(labels[i])] -= 1
            now = rate * (1 - step / total)
            vectors[index] -= now * np.outer(weight, error @ softmax) * min(len(index), 50)
            softmax -= now * np.outer(error, mean)
            bias -= now * error
            step += 1
    return (vectors @ (softmax[1] - softmax[0])), float(bias[1] - bias[0])


class WordScorer:
    """Log-odds of texts, with the numbers of words kept between batches."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values, bias
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        split = [split_words(t) for t in texts]
        new = set().union(*split).difference(self.numbers)
        if len(new) + len(self.numbers) > KEPT_WORDS:
            self._clear()
            new = set().union(*split)
        if new:
            new = list(new)
            features, bounds = word_features(new, len(self.values))
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
            self.sums = np.r_[self.sums, np.add.reduceat(self.values[features], bounds[:-1])]
            self.counts = np.r_[self.counts, np.diff(bounds)]
        out = np.empty(len(texts))
        for i, words in enumerate(split):
            own = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            again = np.count_nonzero(own[1:] == own[:-1])
            total = self.counts[own].sum() + again
            out[i] = (self.sums[own].sum() + again * self.values[0]) / total if total else 0.0
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: the remainder of the id's CRC-32 by 5 is 0; NULL ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, float]:
    """Learn from at most ``per_label`` labelled documents of each label, those with the smallest hashes of their ids.

    Documents longer than ``SAMPLE_BYTES`` are taken last, and no label's documents are longer than ``per_label * SAMPLE_BYTES`` together. Of several labels of an id the
    smallest counts; NULL ids and labels, labels other than 0 and 1, labels without a document and documents without words are ignored. The bias
    is shifted to the shares of the labels among all rows that may be learned from. With one label only, or none, among the labelled rows all texts score
    that label's share. Where both labels exist but one of them has no document that fits, a ``ValueError`` says so.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label")).filter(~held_out(F.col("id")))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(shares) < 2:
        chance = 0.5 if not shares else float(*shares)
        return np.zeros(BUCKETS), float(np.log(max(chance, 1e-9) / max(1 - chance, 1e-9)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = texts.select("id", F.octet_length("text").alias("bytes")).filter("bytes > 0").groupBy("id").agg(F.sum("bytes").alias("bytes"))
    offered = known.join(sized, "id")
    chosen = []
    for value in (0, 1):
        order = (F.col("bytes") > SAMPLE_BYTES, F.xxhash64("id"), F.col("id"))
        room = per_label * SAMPLE_BYTES
        for row in offered.filter((F.col("label") == value) & (F.col("bytes") <= room)).orderBy(*order).limit(per_label).collect():
            if row["bytes"] <= room:
                room -= row["bytes"]
                chosen.append((row["id"], value))
    if len({value for _, value in chosen}) < 2:
        raise ValueError(f"Both labels exist, but one has no document with text of at most {per_label * SAMPLE_BYTES} bytes to learn from.")
    wanted = docs.sparkSession.createDataFrame(chosen, known.select("id", F.col("label").cast("int")).schema)
    rows = texts.join(F.broadcast(wanted), "id").select("id", "text", "label").collect()  # at most twice per_label ids
    rows.sort(key=lambda r: (r["id"], r["text"]))
    found = np.array([r["label"] for r in rows], np.int64)
    values, bias = train([r["text"].encode() for r in rows], found)
    seen = found.sum() / (len(found) - found.sum())
    return values, bias + float(np.log(shares[1] / shares[0]) - np.log(seen))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless ``keep_text``, with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    The whole text is scored; a NULL text counts as empty, and without words the bias alone decides. Other columns and
    repeated rows pass through; columns already named like the two are replaced.
    """
    values = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32))
    bias = model[1]
    others = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != text_col)]
    rows = docs.select(*[F.col(f"`{c}`") for c in others])
    schema = rows.withColumn("score", F.lit(0.0)).schema
    place = others.index(text_col) if text_col in others and docs.schema[text_col].dataType == StringType() else len(others)
    if place == len(others):  # else a kept text is moved once, as it is
        rows = docs.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("score text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages took
        scorer = WordScorer(values.value.astype(np.float64), bias)
        for batch in batches:
            texts, at = batch.column(place).cast(pa.binary()), 0
            while at < len(batch):
                start, own, size = at, [], 0
                while at < len(batch) and size < SLICE_BYTES:
                    own.append(texts[at].as_py() or b"")
                    size += len(own[-1])
                    at += 1
                kept = batch.slice(start, at - start).columns[: len(others)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scorer.scores(own))], [*others, "score"])
        scorer = batch = texts = own = kept = None
        give_back()

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
